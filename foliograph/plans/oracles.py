"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

import re
from functools import reduce

from foliograph.functions import text as T

WS = T.WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, pattern: str, put: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(re.sub(r'[$]([0-9])', chr(92) + chr(92) + '1', put))}, 'g')"


def trim(c: str) -> str:
    return rx(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def clean(c: str) -> str:
    c = f"nfc_normalize({c})"
    for glyph, letters in T.LIGATURES.items():
        c = f"replace({c}, {q(glyph)}, {q(letters)})"
    c = f"translate({c}, {q(T.FOLD_FROM)}, {q(T.FOLD_TO)})"
    return trim(reduce(lambda s, rule: rx(s, *rule), T.CLEAN_RULES, c))


def speech_steps() -> list[tuple[str, str]]:
    """RE2 has no look-ahead: what must follow is captured and put back."""
    steps = []
    for pattern, ahead, put, any_case in T.SPEECH_RULES:
        put = re.sub(r"[$]([0-9])", r"\\\1", put)
        if ahead:
            groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
            pattern, put = f"{pattern}({ahead})", f"{put}\\{groups + 1}"
        steps.append((("(?i)" if any_case else "") + pattern.replace("~", r"\b"), put))
    return steps


def speech(c: str) -> str:
    for pattern, put in speech_steps():
        c = f"regexp_replace({c}, {q(pattern)}, {q(put)}, 'g')"
    c = f"regexp_replace({c}, {q(T.CAPITALS.replace('~', chr(92) + 'b'))}, '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    c = f"list_reduce(list_transform(string_split({c}, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE lower(split_part(p, chr(2), 1)) || p[strpos(p, chr(2)) + 1:] END), lambda a, b: a || b)"
    c = rx(c, T.ELLIPSIS, "…")
    for stop in ",.;:!?":
        c = rx(c, re.escape(stop) + "{2,}", stop)
    return trim(rx(c, rf"[{WS}]{{2,}}", " "))


def words(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {q(T.WORD)})) AS BIGINT)"


def tokens(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {q(f'[^{WS}]+')})) AS BIGINT)"


def marked(c: str) -> str:
    c = f"regexp_replace({c}, {q(rf'([.!?\x{{2026}}]{T.CLOSERS}*)([{WS}]+{T.OPENERS})')}, '\\1' || chr(1) || '\\2', 'g')"
    c = f"regexp_replace({c}, {q(rf'(^|[^\p{{L}}])((?i:{T.ABBREVIATION})\.{T.CLOSERS}*)')} || chr(1), '\\1\\2', 'g')"
    return f"regexp_replace({c}, '([0-9][.])' || chr(1) || {q(f'([{WS}]*[0-9])')}, '\\1\\2', 'g')"


def sentence_rows(table: str, keys: str, where: str = "TRUE") -> str:
    """keys, idx, offset, text of a table's text column."""
    return f"""SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS BIGINT) AS idx, CAST(pre + length(raw) - length({rx('raw', rf'\A[{WS}]+', '')}) AS BIGINT) AS "offset", text
FROM (SELECT {keys}, k, raw, {trim('raw')} AS text, coalesce(sum(length(raw)) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
FROM (SELECT {keys}, unnest(range(len(s))) AS k, unnest(s) AS raw FROM (SELECT {keys}, string_split({marked('text')}, chr(1)) AS s FROM {table} WHERE {where}))) WHERE text <> ''"""


LINES = "(SELECT doc_id, source, CAST(unnest(range(len(s))) AS BIGINT) AS li, unnest(s) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))"
DOC_PAGES = "(SELECT doc_id, source, source || '-' || (rn // 10) AS book, rn % 10 + 1 AS page FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents))"
DOC_LINES = f"(SELECT p.book, p.page, l.li AS line_idx, l.line, l.li = 0 OR l.li = max(l.li) OVER (PARTITION BY l.doc_id) AS band FROM {LINES} l JOIN {DOC_PAGES} p ON l.doc_id = p.doc_id)"
DRESSED = f"""(SELECT book, page, line_idx, line, FALSE AS band FROM {DOC_LINES}
UNION ALL SELECT book, page, -1, upper(source) || ' REVIEW VOL ' || page, TRUE FROM {DOC_PAGES}
UNION ALL SELECT book, page, 1000000, CASE page % 5 WHEN 0 THEN '' || page WHEN 1 THEN '- ' || page || ' -' WHEN 2 THEN ['i','ii','iii','iv','v','vi','vii','viii','ix','x'][page] WHEN 3 THEN 'Page ' || page || ' of 10' ELSE page || ' | ' || source END, TRUE FROM {DOC_PAGES})"""
DOC_BLOCKS = """(SELECT doc_id AS book_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, type = 'footnote', li) - 1 AS block_id, chapter, type, line AS text,
CASE WHEN type = 'paragraph' AND li % 2 = 0 OR type = 'footnote' AND li % 5 <> 0 THEN '' || (li % 3) END AS note_ref
FROM (SELECT *, li // 25 AS chapter, CASE (doc_id + li) % 10 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'table' WHEN 3 THEN 'footnote' WHEN 4 THEN 'footnote' ELSE 'paragraph' END AS type FROM """ + LINES + "))"  # fmt: skip
RAW = f"""(SELECT doc_id AS book_id, li AS raw_idx, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN h THEN 'Chapter ' || (li // 25 + 1) ELSE line END AS text, li // 12 + 1 AS page
FROM (SELECT *, doc_id % 2 = 0 AND li % 25 = 0 AS h FROM {LINES}))"""
PLAYLOG = "(SELECT user_id AS reader, CAST(ts AS DATE) AS day, ts, event_id, event_id % 40 AS words, CAST(floor(value * 60) AS BIGINT) AS ms FROM events)"


def last_index(w: str, part: str) -> str:
    return f"(CASE WHEN strpos({w}, {q(part)}) = 0 THEN -1 ELSE length({w}) - strpos(reverse({w}), {q(part[::-1])}) + 1 - {len(part)} END)"


def chunks() -> str:
    strong = f"greatest({last_index('w', '; ')}, {last_index('w', ': ')})"
    weak = f"greatest({last_index('w', ', ')}, {last_index('w', ' — ')}, {last_index('w', ' – ')})"
    rows = "CAST(len(string_split(text, ';')) AS VARCHAR)"
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, block_id = min(block_id) OVER (PARTITION BY book_id, chapter) AS opens_chapter FROM {DOC_BLOCKS}),
s AS MATERIALIZED ({sentence_rows('b', 'book_id, block_id', "type <> 'table'")}),
r AS (SELECT book_id, block_id, idx, "offset" AS base, text, 0::BIGINT AS c, 0 AS k, NULL::VARCHAR AS piece, NULL::BIGINT AS place, NULL::BIGINT AS pause FROM s
UNION ALL SELECT book_id, block_id, idx, base, text, CASE WHEN rest THEN length(text) ELSE c + cut + 1 END, k + 1, {trim('CASE WHEN rest THEN text[c + 1:] ELSE text[c + 1:c + cut + 1] END')}, base + c, CASE WHEN rest THEN 330 ELSE pause END
FROM (SELECT * EXCLUDE (piece, place, pause), length(text) - c <= 260 AS rest, CASE WHEN strong >= 40 THEN strong WHEN weak >= 40 THEN weak WHEN blank >= 40 THEN blank ELSE 259 END AS cut, CASE WHEN strong >= 40 THEN 210 ELSE 130 END AS pause
FROM (SELECT *, {strong} AS strong, {weak} AS weak, {last_index('w', ' ')} AS blank FROM (SELECT *, text[c + 1:c + 260] AS w FROM r WHERE c < length(text))))),
lead AS (SELECT book_id, block_id, -1 AS idx, 0 AS k, CASE type WHEN 'table' THEN 'Table with ' || {rows} || ' rows, skipped.' ELSE CASE WHEN coalesce(note_ref, '') <> '' THEN 'Note ' || note_ref || '.' ELSE 'Note.' END END AS text, 0 AS place, 330 AS pause FROM b WHERE type IN ('table', 'footnote')),
a AS (SELECT book_id, block_id, idx, k, piece AS text, place, pause FROM r WHERE k > 0 AND piece <> '' UNION ALL SELECT * FROM lead),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, block_id ORDER BY idx, k) - 1 AS chunk_idx, count(*) OVER (PARTITION BY book_id, block_id) AS n FROM a)
SELECT n.book_id, n.block_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(place AS BIGINT) AS "offset", n.text,
CAST(CASE WHEN chunk_idx < n - 1 OR b.type = 'table' THEN pause WHEN b.type = 'paragraph' AND NOT regexp_matches({trim('b.text')}, {q(ENDED)}) THEN 130 WHEN b.type = 'heading' THEN CASE WHEN opens_chapter THEN 1100 ELSE 800 END ELSE greatest(pause, 520) END AS BIGINT) AS pause_ms,
{tokens('n.text')} AS words FROM n JOIN b ON n.book_id = b.book_id AND n.block_id = b.block_id"""


ENDED = r"""[.!?\x{2026}]["'\x{201D}\x{2019})\]]*\z"""


def signature(c: str) -> str:
    c = rx(rx(f"lower({c})", "[0-9]+", "#"), r"\b[ivxlcdm]+\b", "#")
    return trim(rx(c, "[^a-z#]+", " "))


def line_keys(lines: str) -> str:
    return f"""(SELECT book, page, line_idx, unnest(CASE WHEN length(sig) < 2 THEN []::VARCHAR[] WHEN len(w) > 4 THEN [sig, array_to_string(w[:4], ' '), array_to_string(w[-4:], ' ')] ELSE [sig] END) AS key
FROM (SELECT book, page, line_idx, sig, list_filter(string_split(sig, ' '), lambda x: x <> '') AS w FROM (SELECT book, page, line_idx, {signature('line')} AS sig FROM {lines} WHERE band)))"""


def running_heads(lines: str) -> str:
    return f"SELECT k.book, k.key, count(DISTINCT k.page) AS pages FROM {line_keys(lines)} k JOIN (SELECT book, count(DISTINCT page) AS n FROM {DOC_PAGES} GROUP BY book) p ON k.book = p.book GROUP BY k.book, k.key, p.n HAVING count(DISTINCT k.page) >= greatest(3, floor(p.n * 0.25))"


def folio(c: str) -> str:
    return f"regexp_matches({trim(c)}, {q(T.FOLIO)})"


def queue(mode: str) -> str:
    notes = "" if mode != "skip" else " WHERE type <> 'footnote'"
    own = f"(SELECT b.*, type = 'footnote' AS is_note, {words('text')} AS words FROM {DOC_BLOCKS} b{notes})"
    order = "chapter, is_note, block_id"
    if mode == "inline":
        own = f"""(SELECT o.*, CASE WHEN NOT is_note THEN block_id ELSE coalesce(a.anchor, 4611686018427387904) END AS place, CASE WHEN is_note AND a.anchor IS NULL THEN coalesce(f.seen, 4611686018427387904) ELSE 0 END AS late
FROM {own} o LEFT JOIN (SELECT book_id, chapter, note_ref, min(block_id) AS anchor FROM {own} WHERE NOT is_note GROUP BY ALL) a USING (book_id, chapter, note_ref)
LEFT JOIN (SELECT book_id, chapter, note_ref, min(block_id) AS seen FROM {own} WHERE is_note GROUP BY ALL) f USING (book_id, chapter, note_ref))"""
        order = "chapter, place, is_note, late, block_id"
    over = f"OVER (PARTITION BY book_id ORDER BY {order}"
    return f"SELECT book_id, CAST(row_number() {over}) - 1 AS BIGINT) AS pos, block_id, CAST(chapter AS BIGINT) AS chapter, words, CAST(coalesce(sum(words) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_words FROM {own}"


def chapter_rows() -> str:
    looks = f"(length({trim('text')}) BETWEEN 1 AND 90 AND (regexp_matches({trim('text')}, {q(T.CHAPTER.replace('~', chr(92) + 'b'))}) OR regexp_matches({trim('text')}, '\\A[0-9]{{1,3}}\\z') OR regexp_matches({trim('text')}, '\\A[IVXLCDM]{{1,7}}\\z')))"
    split = f"regexp_split_to_array({trim('text')}, '[{WS}]+')"
    title = f"""CASE WHEN nf >= 2 THEN CASE WHEN ch THEN text ELSE 'Opening' END WHEN length(array_to_string({split}[:7], ' ')) < 8 THEN 'Page ' || page ELSE 'p.' || page || ' — ' || array_to_string({split}[:7], ' ') || CASE WHEN len({split}) > 7 THEN '…' ELSE '' END END"""
    return f"""WITH m AS (SELECT *, sum(ch::INT) OVER (PARTITION BY book_id) AS nf, count(*) OVER (PARTITION BY book_id) AS n FROM (SELECT *, type = 'heading' AND {looks} AS ch FROM {RAW})),
t AS (SELECT *, CASE WHEN raw_idx = 0 OR CASE WHEN nf >= 2 THEN ch ELSE raw_idx % greatest(25, CAST(ceil(n / 12) AS BIGINT)) = 0 END THEN {title} END AS title FROM m),
c AS (SELECT *, sum((title IS NOT NULL)::INT) OVER (PARTITION BY book_id ORDER BY raw_idx) - 1 AS chapter FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter, type = 'footnote', raw_idx) - 1 AS block_id FROM c)
SELECT book_id, CAST(chapter AS BIGINT) AS chapter, max(title) AS title, 'heuristic' AS source, CAST(min(block_id) AS BIGINT) AS start_block, CAST(max(block_id) + 1 AS BIGINT) AS end_block, arg_min(page, block_id) AS page, CAST(sum({words('text')}) AS BIGINT) AS words FROM b GROUP BY book_id, chapter"""


def paragraph_rows() -> str:
    ends = """regexp_matches(line, '[.!?]["'')\\]]?\\z') AND length(line) < 45"""
    joined = r"CASE WHEN regexp_matches(buf, '[\p{L}\p{N}]-\z') AND regexp_matches(line, '\A\p{Ll}') THEN buf[:-2] || line ELSE buf || ' ' || line END"
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {trim('x')}) AS s FROM documents),
r AS (SELECT doc_id, s, 1 AS i, '' AS buf, []::VARCHAR[] AS out FROM l
UNION ALL SELECT doc_id, s, i + 1, CASE WHEN line = '' THEN '' WHEN buf = '' THEN line WHEN {ends} THEN '' ELSE {joined} END,
CASE WHEN line = '' AND buf <> '' THEN list_append(out, buf) WHEN line <> '' AND buf <> '' AND {ends} THEN list_append(out, {joined}) ELSE out END FROM (SELECT *, s[i] AS line FROM r WHERE i <= len(s))),
f AS (SELECT doc_id, list_filter(list_append(out, buf), lambda p: length(p) > 1) AS p FROM r WHERE i = len(s) + 1)
SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS idx, unnest(p) AS text FROM f"""


def duration(s: str) -> str:
    m = f"CAST(floor({s} / 60 + 0.5) AS BIGINT)"
    return f"CASE WHEN {s} < 0 OR {s} IS NULL THEN '--' WHEN {s} < 60 THEN CAST(floor({s} + 0.5) AS BIGINT) || 's' WHEN {m} < 60 THEN {m} || 'm' WHEN {m} % 60 > 0 THEN ({m} // 60) || 'h ' || ({m} % 60) || 'm' ELSE ({m} // 60) || 'h' END"


def position(queue_sql: str, targets: str) -> str:
    return f"WITH qq AS ({queue_sql}) SELECT b.book_id, b.target, CAST(coalesce(min(pos) FILTER (qq.block_id = b.target), min(pos) FILTER (qq.block_id > b.target), max(pos)) AS BIGINT) AS pos FROM {targets} b JOIN qq ON b.book_id = qq.book_id GROUP BY b.book_id, b.target"


def place_queries() -> dict[str, str]:
    """Places in books: what is stored of them, where they are taken up again, and what remains."""
    own, ch = queue("chapter-end"), chunks()
    places = "(SELECT book_id, count(*) AS n, book_id * 7 % count(*) AS pos FROM qq GROUP BY book_id)"
    sized = f"(SELECT p.book_id, p.n, p.pos, coalesce(c.n, 0) AS nc FROM {places} p JOIN qq ON qq.book_id = p.book_id AND qq.pos = p.pos LEFT JOIN (SELECT book_id, block_id, count(*) AS n FROM cc GROUP BY ALL) c ON c.book_id = qq.book_id AND c.block_id = qq.block_id)"
    narrow = own.replace("FROM " + DOC_BLOCKS + " b)", "FROM " + DOC_BLOCKS + " b WHERE TRUE)")
    inline = queue("inline").replace(f"{DOC_BLOCKS} b)", f"{DOC_BLOCKS} b WHERE type <> 'caption')")
    step = lambda by, d, pos, c: f"SELECT book_id, '{by}' AS by, CAST({d} AS BIGINT) AS delta, CAST({pos} AS BIGINT) AS pos, CAST({c} AS BIGINT) AS chunk_idx FROM z"
    beside = lambda d: f"least(n - 1, greatest(0, pos + {d}))"
    return {
        "progress_records": f"WITH qq AS ({own}), cc AS ({ch}) SELECT qq.book_id, qq.block_id, CAST(coalesce(cc.\"offset\", 0) AS BIGINT) AS \"offset\", round(CASE WHEN t.total > 0 THEN cum_words / t.total ELSE 0 END, 6) AS fraction FROM {places} p JOIN qq ON qq.book_id = p.book_id AND qq.pos = p.pos JOIN (SELECT book_id, sum(words) AS total FROM qq GROUP BY book_id) t ON t.book_id = p.book_id LEFT JOIN cc ON cc.book_id = qq.book_id AND cc.block_id = qq.block_id AND cc.chunk_idx = p.book_id % 2",
        "time_left": f"WITH qq AS ({own}), s AS (SELECT qq.book_id, (t.total - cum_words) / CASE WHEN qq.book_id % 3 = 0 AND qq.book_id % 200 > 40 THEN CAST(qq.book_id % 200 AS DOUBLE) ELSE 165.0 END * 60 AS seconds FROM {places} p JOIN qq ON qq.book_id = p.book_id AND qq.pos = p.pos JOIN (SELECT book_id, sum(words) AS total FROM qq GROUP BY book_id) t ON t.book_id = p.book_id) SELECT book_id, round(seconds, 4) AS seconds, {duration('seconds')} AS \"left\" FROM s",
        "seek_offset": f"WITH cc AS ({ch}), f AS ({position(queue('skip'), '(SELECT book_id, block_id AS target FROM ' + DOC_BLOCKS + ' WHERE (book_id + block_id) % 5 = 0)')}), qs AS ({queue('skip')}) SELECT f.book_id, f.target, CAST(120 AS BIGINT) AS \"offset\", f.pos, CAST(coalesce(max(chunk_idx) FILTER (cc.\"offset\" <= 120), 0) AS BIGINT) AS chunk_idx FROM f JOIN qs ON qs.book_id = f.book_id AND qs.pos = f.pos LEFT JOIN cc ON cc.book_id = f.book_id AND cc.block_id = qs.block_id GROUP BY f.book_id, f.target, f.pos",
        "skip": f"WITH qq AS ({own}), cc AS ({ch}), z AS {sized} {step('chunk', 1, f'CASE WHEN 1 < nc THEN pos ELSE {beside(1)} END', 'CASE WHEN 1 < nc THEN 1 ELSE 0 END')} UNION ALL {step('chunk', -1, beside(-1), '0')} UNION ALL {step('block', 3, beside(3), '0')} UNION ALL {step('block', -3, beside(-3), '0')}",
        "settings_change": f"WITH old AS ({narrow}), held AS (SELECT o.book_id, o.block_id AS target FROM (SELECT book_id, book_id * 7 % count(*) AS pos FROM old GROUP BY book_id) p JOIN old o ON o.book_id = p.book_id AND o.pos = p.pos), x AS ({position(inline, 'held')}) SELECT * FROM x",
    }


def display_queries() -> dict[str, str]:
    """What a player shows and keeps of its reader."""
    kept = f"length(regexp_replace(live[:here], {q(f'[^{WS}]+$')}, ''))"
    return {
        "highlights": f"""WITH cc AS ({chunks()}), l AS (SELECT cc.*, b.text[cc."offset" + 1:cc."offset" + length(cc.text)] AS live, greatest(length({speech('cc.text')}), 1) AS spoken, (cc.block_id * 31 + chunk_idx * 17 + cc.book_id) % (length(cc.text) + 9) AS ci FROM cc JOIN {DOC_BLOCKS} b ON b.book_id = cc.book_id AND b.block_id = cc.block_id),
h AS (SELECT *, greatest(0, least(length(live) - 1, CAST(floor(CAST(ci AS DOUBLE) / spoken * length(live) + 0.5) AS BIGINT))) AS here FROM l)
SELECT book_id, block_id, chunk_idx, CAST("offset" + {kept} AS BIGINT) AS start, regexp_extract(live[{kept} + 1:], {q(f'^[^{WS}]*')}) AS word FROM h""",
        "sizes": """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE (CAST(floor(n / 1048576 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(n / 1048576 * 10 + 0.5) AS BIGINT) % 10) || ' MB' END AS size,
CAST(floor(least(1.0, greatest(0.0, CAST(length(text) AS DOUBLE) / CAST(2000 AS DOUBLE) - CAST(0.1 AS DOUBLE))) * 100 + 0.5) AS BIGINT) || '%' AS share FROM (SELECT doc_id, text, length(text) * (doc_id % 4000 + 1) AS n FROM documents)""",
        "settings": """SELECT DISTINCT user_id AS reader, CASE WHEN user_id % 3 = 0 THEN CAST(0.5 + user_id % 4 * 0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS rate, CAST(1 AS DOUBLE) AS pitch, CAST(1 AS DOUBLE) AS volume, CASE WHEN user_id % 2 = 0 THEN 'inline' ELSE 'chapter-end' END AS footnote_mode,
FALSE AS describe_images, user_id % 7 = 0 AS read_tables, TRUE AS read_captions, TRUE AS announce_chapters, CAST(1 AS DOUBLE) AS pause_scale, CAST(CASE WHEN user_id % 5 = 0 THEN user_id % 90 + 120 ELSE 165 END AS INTEGER) AS base_wpm FROM events""",
        "import_progress": """SELECT page_id, name, round(CASE WHEN n > 0 THEN CASE WHEN page_id % 5 IN (1, 3) THEN page / n * CAST(0.8 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) + page / n * CAST(0.2 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END, 6) AS fraction
FROM (SELECT page_id, 'f' || page_id || ['.pdf', '.PDF', '.txt', '.pdf.zip'][page_id % 4 + 1] AS name, CAST(length(url) % 12 AS DOUBLE) AS page, page_id % 9 AS n FROM pages) WHERE page_id % 4 < 2 OR page_id % 6 = 3""",
        "rate_steps": "SELECT *, least(CAST(2 AS DOUBLE), round(rate + CAST(0.05 AS DOUBLE), 2)) AS faster, greatest(CAST(0.5 AS DOUBLE), round(rate - CAST(0.05 AS DOUBLE), 2)) AS slower FROM (SELECT DISTINCT user_id AS reader, CAST(user_id % 160 + 45 AS DOUBLE) / CAST(100 AS DOUBLE) AS rate FROM events)",
    }


def order_queries() -> dict[str, str]:
    """Orders over whole tables and steps that follow each other."""
    ch, end = chunks(), queue("chapter-end")
    return {
        "auto_advance": """WITH RECURSIVE l AS MATERIALIZED (SELECT user_id AS reader, event_id AS book, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type = 'signup' AS gone, event_type = 'error' AND event_id % 4 = 0 AS unknown, event_type = 'view' AND event_id % 3 = 0 AS ended FROM events),
r AS (SELECT reader, book AS started, place, book AS last, 0 AS n, FALSE AS stopped FROM l WHERE ended
UNION ALL SELECT r.reader, started, l.place, CASE WHEN l.gone OR l.unknown THEN last ELSE l.book END, CASE WHEN l.gone OR l.unknown THEN n ELSE n + 1 END, l.unknown FROM r JOIN l ON l.reader = r.reader AND l.place = r.place + 1 WHERE NOT stopped)
SELECT reader, started AS book_id, CAST(n AS BIGINT) AS played, last AS last_id, CASE WHEN stopped THEN 'unknown' ELSE 'end' END AS stopped_by FROM r QUALIFY row_number() OVER (PARTITION BY reader, started ORDER BY place DESC) = 1""",
        "chapter_jump": f"WITH qq AS ({queue('skip')}), c AS (SELECT book_id, chapter, max(chapter) OVER (PARTITION BY book_id) AS n FROM (SELECT DISTINCT book_id, chapter FROM {DOC_BLOCKS})) SELECT c.book_id, CAST(c.chapter AS BIGINT) AS chapter, CAST(coalesce(min(pos), 0) AS BIGINT) AS pos, CAST(0 AS BIGINT) AS chunk_idx FROM c LEFT JOIN qq ON qq.book_id = c.book_id AND qq.chapter = c.chapter WHERE c.chapter IN (1, c.n - 1) GROUP BY c.book_id, c.chapter",
        "timeline": f"""WITH cc AS ({ch}), qq AS ({end}), x AS (SELECT cc.book_id, pos, chunk_idx, CAST(floor(cc.words * 60000 / CAST(165 * 1.25 AS DOUBLE) + 0.5) AS BIGINT) AS speech_ms, CAST(floor(pause_ms * 1.2 / 1.25 + 0.5) AS BIGINT) AS pause_ms FROM cc JOIN qq ON qq.book_id = cc.book_id AND qq.block_id = cc.block_id)
SELECT book_id, pos, chunk_idx, CAST(coalesce(sum(speech_ms + pause_ms) OVER (PARTITION BY book_id ORDER BY pos, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, speech_ms, pause_ms FROM x""",
        "session_wpm": """WITH e AS (SELECT user_id AS reader, ts, event_id, event_id % 40 AS w, CAST(floor(value * 60) AS BIGINT) AS t, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events),
s AS (SELECT reader, event_id, session, sum(w) OVER o AS words, sum(t) OVER o AS ms FROM e WINDOW o AS (PARTITION BY reader, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT reader, event_id, CAST(session AS BIGINT) AS session, CAST(words AS BIGINT) AS words, CAST(ms AS BIGINT) AS ms, CASE WHEN ms > 20000 THEN CAST(floor(words / ms * 60000 + 0.5) AS DOUBLE) END AS wpm FROM s""",
        "throttled_writes": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS reader, epoch_ms(ts) // 10000 AS t, max(event_id) AS event_id FROM events GROUP BY ALL),
p AS MATERIALIZED (SELECT a.reader, a.t, min(b.t) AS next FROM e a LEFT JOIN e b ON b.reader = a.reader AND b.t >= a.t + 4000 GROUP BY a.reader, a.t),
r AS (SELECT reader, min(t) AS t FROM e GROUP BY reader UNION ALL SELECT p.reader, p.next FROM r JOIN p ON p.reader = r.reader AND p.t = r.t WHERE p.next IS NOT NULL)
SELECT r.reader, r.t AS opened, r.t + 4000 AS due, arg_max(e.event_id, e.t) AS event_id FROM r JOIN e ON e.reader = r.reader AND e.t >= r.t AND e.t < r.t + 4000 GROUP BY r.reader, r.t""",
        "settings_versions": """SELECT reader, CASE WHEN reader % 3 < 2 THEN CAST(reader % 4 * 0.25 + 0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS rate, CAST(1 AS DOUBLE) AS pitch, CAST(1 AS DOUBLE) AS volume, 'chapter-end' AS footnote_mode, FALSE AS describe_images,
reader % 3 = 2 AND reader % 2 = 0 AS read_tables, TRUE AS read_captions, TRUE AS announce_chapters, CAST(1 AS DOUBLE) AS pause_scale, CAST(CASE WHEN reader % 3 > 0 THEN reader % 90 + 120 ELSE 165 END AS INTEGER) AS base_wpm, CASE WHEN reader % 3 = 2 THEN 'theme=t' || (reader % 7) ELSE '' END AS other FROM (SELECT DISTINCT user_id AS reader FROM events)""",
        "stored_blocks": f"SELECT book_id, block_id, CASE WHEN book_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM {DOC_BLOCKS} WHERE book_id % 7 > 0",
        "library": "SELECT doc_id AS book_id, doc_id * 7919 % 1000 AS added_at, row_number() OVER (ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS place FROM documents",
        "bookmark_order": "SELECT event_id % 97 AS book_id, event_id AS mark_id, user_id % 11 AS block_id, row_number() OVER (PARTITION BY event_id % 97 ORDER BY user_id % 11, event_id) - 1 AS place FROM events",
    }


FRACTIONS = "(0.0), (0.1), (0.25), (0.5), (0.75), (0.999), (1.0)"


def oracle_sql() -> dict[str, str]:
    end, inline = queue("chapter-end"), queue("inline")
    sizes = f"(SELECT doc_id AS book_id, {words('text')} AS words FROM documents)"
    progress = "(SELECT user_id AS book_id, max(event_id % 100) / 100.0 AS fraction FROM events GROUP BY user_id)"
    return {
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "speech_text": f"SELECT doc_id, {speech('text')} AS text FROM documents",
        "word_counts": f"SELECT doc_id, {words('text')} AS words, {tokens('text')} AS tokens FROM documents",
        "sentences": f"SELECT lang, count(*) AS sentences, CAST(sum({words('text')}) AS BIGINT) AS words, round(sum({words('text')}) / count(*), 6) AS mean_words FROM ({sentence_rows('documents', 'doc_id, lang')}) GROUP BY lang",
        "sentence_rows": sentence_rows("documents", "doc_id"),
        "roman_values": "WITH RECURSIVE d AS (SELECT DISTINCT p_size + l_linenumber * 50 AS v FROM part, (SELECT DISTINCT l_linenumber FROM lineitem)) SELECT CAST(v AS BIGINT) AS v, CAST(v AS BIGINT) AS value FROM d",
        "numerals": """WITH e AS (SELECT translate(n, '0123456789', 'IVXLCDMivc') AS plain, translate(n, '0123456789', 'iixIJCdXMl') AS odd FROM (SELECT CAST(event_id AS VARCHAR) || CAST(user_id AS VARCHAR) AS n FROM events)),
w AS (SELECT DISTINCT unnest([plain, odd, 'é' || plain, odd[3:]]) AS numeral FROM e),
c AS (SELECT numeral, unnest(range(1, length(numeral) + 1)) AS i FROM w),
v AS (SELECT numeral, i, CASE upper(numeral[i]) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END AS v FROM c),
s AS (SELECT numeral, bool_or(v = 0) AS bad, sum(CASE WHEN v < coalesce(next, 0) THEN -v ELSE v END) AS total FROM (SELECT *, lead(v) OVER (PARTITION BY numeral ORDER BY i) AS next FROM v) GROUP BY numeral)
SELECT w.numeral, CAST(CASE WHEN bad THEN 0 ELSE coalesce(total, 0) END AS BIGINT) AS value FROM w LEFT JOIN s USING (numeral)""",
        "chunks": chunks(),
        "chunk_pacing": f"SELECT book_id, count(*) AS n_chunks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(CAST(floor(pause_ms * 1.2 / 1.5 + 0.5) AS BIGINT)) AS BIGINT) AS pause_ms FROM ({chunks()}) GROUP BY book_id",
        "paragraphs": paragraph_rows(),
        "signatures": f"SELECT * FROM {line_keys(DOC_LINES)}",
        "folios": f"SELECT book, page, line_idx FROM {DRESSED} WHERE band AND {folio('line')}",
        "running_heads": running_heads(DOC_LINES),
        "stripped_lines": f"SELECT l.* FROM {DRESSED} l ANTI JOIN (SELECT book, page, line_idx FROM {DRESSED} WHERE band AND {folio('line')} UNION SELECT k.book, k.page, k.line_idx FROM {line_keys(DRESSED)} k JOIN ({running_heads(DRESSED)}) h ON k.book = h.book AND k.key = h.key) x ON l.book = x.book AND l.page = x.page AND l.line_idx = x.line_idx",
        "chapters": chapter_rows(),
        "durations": f"SELECT book_id, chapter, {duration('(words / 165.0 * 60)')} AS duration FROM ({chapter_rows()})",
        "quality": f"SELECT p.book, count(*) AS n_pages, round(sum((chars >= 1000)::INT) / count(*), 6) AS coverage, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (chars < 1000), '') AS scanned, sum((chars >= 1000)::INT) / count(*) < 0.6 AS needs_ocr FROM {DOC_PAGES} p JOIN (SELECT doc_id, sum(length({trim('line')})) AS chars FROM {LINES} GROUP BY doc_id) c ON p.doc_id = c.doc_id GROUP BY p.book",
        "queue_end": end,
        "queue_inline": inline,
        "queue_skip": queue("skip"),
        "queue_progress": f"WITH qq AS ({end}), t AS (SELECT book_id, sum(words) AS total FROM qq GROUP BY book_id), e AS (SELECT book_id, chapter, min(pos) AS entry, min(cum_words) AS cum FROM qq GROUP BY ALL) SELECT c.book_id, CAST(c.chapter AS BIGINT) AS chapter, CAST(coalesce(entry, 0) AS BIGINT) AS entry, CASE WHEN round(coalesce(cum, 0) / nullif(total, 0), 6) > 0.004 AND round(coalesce(cum, 0) / nullif(total, 0), 6) < 0.996 THEN round(coalesce(cum, 0) / nullif(total, 0), 6) END AS tick FROM (SELECT DISTINCT book_id, chapter FROM {DOC_BLOCKS}) c LEFT JOIN e ON c.book_id = e.book_id AND c.chapter = e.chapter LEFT JOIN t ON c.book_id = t.book_id",
        "seek": f"WITH qq AS ({end}), t AS (SELECT book_id, sum(words) AS total FROM qq GROUP BY book_id), f(fraction) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES {FRACTIONS}) v(x)) SELECT qq.book_id, fraction, CAST(coalesce(max(pos) FILTER (cum_words <= fraction * total), 0) AS BIGINT) AS pos FROM qq JOIN t ON qq.book_id = t.book_id CROSS JOIN f GROUP BY qq.book_id, fraction",
        "position": position(queue("skip"), f"(SELECT book_id, block_id AS target FROM {DOC_BLOCKS} WHERE type = 'footnote')"),
        "reading_window": f"WITH qq AS ({end}) SELECT qq.book_id, h.here, pos, block_id FROM qq JOIN (SELECT book_id, CAST(count(*) // 2 AS BIGINT) AS here FROM qq GROUP BY book_id) h ON qq.book_id = h.book_id WHERE pos >= here - 25 AND pos < here + 45",
        "reading_list": f"SELECT i.pos, i.book_id, b.words, CAST(floor(b.words * (1 - coalesce(p.fraction, 0.0)) + 0.5) AS BIGINT) AS words_left, coalesce(p.fraction, 0.0) > 0.01 AS started FROM (SELECT conv_id AS pos, conv_id * 7 AS book_id FROM conversations GROUP BY conv_id) i JOIN {sizes} b ON i.book_id = b.book_id LEFT JOIN {progress} p ON i.book_id = p.book_id",
        "wpm": f"SELECT reader, CAST(day AS VARCHAR) AS day, words, ms, CAST(wpm AS DOUBLE) AS wpm, CASE WHEN wpm > 40 THEN CAST(wpm AS DOUBLE) ELSE 165.0 END AS effective FROM (SELECT reader, day, CAST(sum(words) AS BIGINT) AS words, CAST(sum(ms) AS BIGINT) AS ms, CASE WHEN sum(ms) > 20000 THEN CAST(floor(sum(words) / sum(ms) * 60000 + 0.5) AS BIGINT) END AS wpm FROM {PLAYLOG} GROUP BY reader, day)",
        "running_wpm": f"SELECT reader, event_id, CASE WHEN t > 20000 THEN CAST(floor(w / t * 60000 + 0.5) AS DOUBLE) END AS wpm FROM (SELECT reader, event_id, sum(words) OVER o AS w, sum(ms) OVER o AS t FROM {PLAYLOG} WINDOW o AS (PARTITION BY reader ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
        "progress_latest": f"SELECT reader, ts, event_id, words FROM {PLAYLOG} QUALIFY row_number() OVER (PARTITION BY reader ORDER BY ts DESC, event_id DESC) = 1",
        "upsert_delete": "SELECT doc_id, lang, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)",
        "edited_blocks": f"SELECT b.book_id, b.block_id, coalesce(e.text, b.text) AS text, e.text IS NOT NULL AS edited, CASE WHEN e.text IS NOT NULL THEN {tokens('e.text')} ELSE {words('b.text')} END AS words FROM {DOC_BLOCKS} b LEFT JOIN (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL) e ON b.book_id = e.conv_id AND b.block_id = e.turn",
        "bookmarks": f"SELECT a.book_id, a.block_id, a.\"offset\", {trim('b.text[a.\"offset\" + 1:a.\"offset\" + 180]')} AS excerpt FROM (SELECT DISTINCT event_id % 97 AS book_id, user_id % 11 AS block_id, event_id % 50 AS \"offset\" FROM events) a JOIN {DOC_BLOCKS} b ON a.book_id = b.book_id AND a.block_id = b.block_id",
        "imported": f"""SELECT page_id AS book_id, CASE WHEN page_id % 4 = 2 THEN {trim("' On ' || url")} ELSE {trim("regexp_replace('my file ' || url, '_+', ' ', 'g')")} END AS title, CASE WHEN page_id % 2 = 0 THEN 'A. Nyone' ELSE '' END AS author, CAST(coalesce(w.words, 0) AS BIGINT) AS words, page_id * 7919 % 1000 AS added_at,
row_number() OVER (PARTITION BY page_id // 1000 ORDER BY page_id * 7919 % 1000 DESC, page_id) AS place FROM pages LEFT JOIN (SELECT book_id, sum({words('text')}) AS words FROM {DOC_BLOCKS} GROUP BY book_id) w ON w.book_id = page_id""",
        "list_edits": """WITH l AS (SELECT user_id AS reader, list_sort(list(DISTINCT event_id % 23))[:8] AS ids FROM events GROUP BY user_id), k AS (SELECT *, CASE WHEN reader % 2 = 0 THEN ids[1] ELSE 5 END AS b FROM l), r AS (SELECT *, list_filter(ids, lambda x: x <> b) AS rest FROM k),
e AS (SELECT reader, CASE WHEN reader % 3 = 0 AND NOT list_contains(ids, b) THEN list_append(ids, b) WHEN reader % 3 = 1 THEN rest WHEN reader % 3 = 2 AND list_contains(ids, b) THEN list_concat(list_append(rest[:2], b), rest[3:]) ELSE ids END AS ids FROM r)
SELECT reader, CAST(unnest(range(len(ids))) AS BIGINT) AS place, unnest(ids) AS book_id FROM e""",
        "shelf": """SELECT doc_id AS book_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'OCR' END, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3 + 1) || ' columns' END, CASE WHEN doc_id % 10 / 10.0 < 0.8 AND doc_id % 7 <> 0 THEN 'sparse text' END,
CASE WHEN f > 0.01 THEN CAST(floor(f * 100 + 0.5) AS BIGINT) || '% read' END], lambda x: x IS NOT NULL), ',') AS badges FROM documents LEFT JOIN (SELECT user_id, max(event_id % 100) / 100.0 AS f FROM events GROUP BY user_id) p ON user_id = doc_id""",
    } | place_queries() | display_queries() | order_queries()
