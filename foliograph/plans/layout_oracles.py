"""DuckDB SQL for the queries over positioned text. Thresholds and patterns are written out here, apart from the operators' own."""

from __future__ import annotations

from foliograph.plans.oracles import LINES, WS, clean, duration, folio, q, signature, trim, words

ITEMS = f"""(WITH sl AS (SELECT doc_id, source, li, k, substr(line, CAST(k * 40 + 1 AS BIGINT), 40) AS slice FROM (SELECT doc_id, source, li, line, unnest(range(greatest(1, CAST(ceil(length(line) / 40) AS BIGINT)))) AS k FROM {LINES})),
s AS (SELECT doc_id, source, slice, row_number() OVER (PARTITION BY doc_id ORDER BY li, k) - 1 AS s, doc_id % 2 = 1 AS two FROM sl WHERE slice <> ''),
p AS (SELECT *, s // CASE WHEN two THEN 80 ELSE 40 END + 1 AS page, 72.0::DOUBLE + 246 * CASE WHEN two THEN s % 80 // 40 ELSE 0 END AS x, 96.0::DOUBLE + 15 * (s % 40) AS y, CASE WHEN two THEN 5.5 ELSE 9.0 END::DOUBLE AS cw,
  CASE WHEN s % 29 = 5 THEN '• ' WHEN s % 31 = 7 THEN 'Figure 3. ' WHEN s % 43 = 11 THEN 'CHAPTER IX' ELSE '' END AS lead,
  CASE WHEN s % 37 BETWEEN 10 AND 12 AND NOT two THEN 60.0 WHEN s % 3 = 0 THEN 0.5 WHEN s % 3 = 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS gap FROM s),
t AS (SELECT *, CASE WHEN s % 43 = 11 THEN lead ELSE lead || substr(slice, 1, 20) END AS a,
  CASE WHEN s % 43 = 11 THEN '' ELSE substr(slice, 21, 20) || CASE WHEN s % 3 = 1 AND regexp_matches(substr(slice, 40, 1), '\\A\\p{{L}}\\z') THEN '-' ELSE '' END END AS b, x + 20 * cw + gap AS r FROM p),
g AS (SELECT doc_id, page, two, min(source) AS source FROM t GROUP BY ALL),
i AS (SELECT doc_id, page, s * 4 + 1 AS n, a AS str, x AS "left", y, length(a) * cw AS width, 10.0::DOUBLE AS size FROM t
UNION ALL SELECT doc_id, page, s * 4 + 2, b, r, y + 0.7::DOUBLE, length(b) * cw, 10.0 FROM t
UNION ALL SELECT doc_id, page, s * 4 + 3, '' || (s % 9 + 1), r + length(b) * cw, y - 3, 3.0, 6.2 FROM t WHERE s % 11 = 0 AND length(slice) = 40
UNION ALL SELECT doc_id, page, 1000000, 'RUNNING HEAD ' || source, 72.0, 50.0, 100.0, 9.0 FROM g UNION ALL SELECT doc_id, page, 1000001, '' || page, 303.0, 750.0, 6.0, 9.0 FROM g
UNION ALL SELECT doc_id, page, 1000002, 'The Title of This Piece', 186.0, 82.0, 240.0, 17.0 FROM g WHERE two AND page = 1
UNION ALL SELECT doc_id, page, 1000003, '1. See note 1, which goes', 72.0, 700.0, 90.0, 7.6 FROM g WHERE NOT two UNION ALL SELECT doc_id, page, 1000004, '2) See note 2', 72.0, 710.0, 90.0, 7.6 FROM g WHERE NOT two
UNION ALL SELECT doc_id, page, 1000005, 'on to a further line.', 72.0, 720.0, 90.0, 7.6 FROM g WHERE NOT two)
SELECT doc_id AS book_id, CAST(page AS BIGINT) AS page, CAST(n AS BIGINT) AS frag_ord, str, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 2 = 0 THEN -size ELSE size END AS scale, "left", 792.0::DOUBLE - y AS base, width,
CASE WHEN n % 5 = 0 THEN 0 ELSE size END AS height, CASE WHEN n % 43 = 2 THEN 'Serif-Bold' ELSE 'Serif' END AS font FROM i)"""

P = "PARTITION BY book_id, page"
NOTE = rf"\A(?:[0-9]{{1,3}}[.)\]]?[{WS}]+|[*†‡§]{{1,3}}[{WS}]*)"
LIST = rf"\A(?:[•–-]|\(?[0-9]{{1,2}}[.)]|\(?[a-z][.)])[{WS}]+"
MARKER = r"\A([0-9]{1,3}|[*†‡§]{1,2})\z"


def needs_blank(size: str) -> str:
    return f"CASE WHEN x - pe > {size} * (0.25::DOUBLE * 0.6::DOUBLE) AND NOT regexp_matches(ps, '[{WS}]\\z') AND NOT regexp_matches(str, '\\A[{WS}]') THEN ' ' ELSE '' END"


def keys(c: str) -> str:
    return f"CASE WHEN length({c}) < 2 THEN []::VARCHAR[] WHEN len(list_filter(string_split({c}, ' '), lambda z: z <> '')) > 4 THEN [{c}, array_to_string(list_filter(string_split({c}, ' '), lambda z: z <> '')[:4], ' '), array_to_string(list_filter(string_split({c}, ' '), lambda z: z <> '')[-4:], ' ')] ELSE [{c}] END"


def rank(c: str, share: float) -> str:
    return f"list_sort(list({c}) OVER ({P}, seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))[CAST(floor((count(*) OVER ({P}, seg) - 1) * {share}::DOUBLE + 0.5) AS BIGINT) + 1]"


STEPS = {
    "fr": f"""SELECT book_id, page, frag_ord, str, "left" AS x, 792.0::DOUBLE - base AS y, width AS w, CASE WHEN height <> 0 THEN height ELSE sz END AS h, sz AS size, font
  FROM (SELECT *, CASE WHEN abs(scale) <> 0 THEN abs(scale) WHEN height <> 0 THEN height ELSE 10.0 END AS sz FROM {ITEMS}) WHERE {trim('str')} <> ''""",
    "fs": "SELECT *, w > 612.0::DOUBLE * 0.72::DOUBLE OR (((x + w) - x) > 612.0::DOUBLE * 0.08::DOUBLE AND abs((x + (x + w)) / 2 - 306.0::DOUBLE) < 612.0::DOUBLE * 0.05::DOUBLE) AS wide FROM fr",
    "bd": f"SELECT * FROM (SELECT *, count(*) OVER ({P}) AS n FROM fs WHERE NOT wide AND y > 792 * 0.09::DOUBLE AND y < 792 * 0.91::DOUBLE) WHERE n >= 12",
    "ev": "SELECT book_id, page, frag_ord, n, x AS place, 1 AS d FROM bd UNION ALL SELECT book_id, page, frag_ord, n, x + w, -1 FROM bd",
    "tn": f"SELECT *, depth <= floor(n * 0.01::DOUBLE) AS clear FROM (SELECT *, sum(d) OVER ({P} ORDER BY place, d DESC, frag_ord ROWS UNBOUNDED PRECEDING) AS depth FROM ev) WHERE (depth <= floor(n * 0.01::DOUBLE)) <> (depth - d <= floor(n * 0.01::DOUBLE))",
    "gp": f"SELECT book_id, page, (since + place) / 2 AS mid FROM (SELECT *, lag(place) OVER ({P} ORDER BY place, d DESC, frag_ord) AS since FROM tn) WHERE NOT clear AND since IS NOT NULL AND place - since >= 612 * 0.018::DOUBLE AND (since + place) / 2 > 612 * 0.2::DOUBLE AND (since + place) / 2 < 612 * 0.8::DOUBLE",
    "gr": f"SELECT *, row_number() OVER ({P} ORDER BY mid) AS rn FROM gp",
    "mg": "SELECT book_id, page, rn, mid AS kept, [mid] AS mids FROM gr WHERE rn = 1 UNION ALL SELECT m.book_id, m.page, g.rn, CASE WHEN g.mid - m.kept > 612 * 0.05::DOUBLE THEN g.mid ELSE m.kept END, CASE WHEN g.mid - m.kept > 612 * 0.05::DOUBLE THEN list_append(m.mids, g.mid) ELSE m.mids END FROM mg m JOIN gr g ON g.book_id = m.book_id AND g.page = m.page AND g.rn = m.rn + 1",
    "cb": """SELECT c.book_id, c.page, any_value(c.b) AS b FROM (SELECT book_id, page, list_concat(list_concat([0.0::DOUBLE], arg_max(mids, rn)), [612.0::DOUBLE]) AS b FROM mg GROUP BY book_id, page) c JOIN
  (SELECT book_id, page, list(x + w / 2) AS cs FROM bd GROUP BY book_id, page) d ON c.book_id = d.book_id AND c.page = d.page WHERE len(c.b) <= 4 AND list_min(list_transform(range(1, len(c.b)), lambda i: len(list_filter(d.cs, lambda z: z >= c.b[i] AND z < c.b[i + 1])))) >= len(d.cs) * 0.15::DOUBLE GROUP BY c.book_id, c.page""",
    "pt": """SELECT f.*, c.b, CASE WHEN c.b IS NULL THEN 0 WHEN wide THEN -1 ELSE coalesce(list_position(list_transform(range(1, len(c.b)), lambda i: x + w / 2 >= c.b[i] AND x + w / 2 < c.b[i + 1]), true) - 1, CASE WHEN x + w / 2 < c.b[2] THEN 0 ELSE len(c.b) - 2 END) END AS part
  FROM fs f LEFT JOIN cb c ON f.book_id = c.book_id AND f.page = c.page""",
    "od": f"SELECT *, row_number() OVER ({P}, part ORDER BY y, x, frag_ord) AS rn, greatest(2.0::DOUBLE, CASE WHEN u <> 0 THEN u ELSE 10 END * 0.45::DOUBLE) AS tol FROM (SELECT *, median(size) OVER ({P}, part) AS u FROM pt)",
    "bl": """SELECT book_id, page, part, rn, y AS mean, 1 AS m, 0 AS g FROM od WHERE rn = 1 UNION ALL SELECT o.book_id, o.page, o.part, o.rn, CASE WHEN abs(o.y - l.mean) <= o.tol THEN (l.mean * l.m + o.y) / (l.m + 1) ELSE o.y END, CASE WHEN abs(o.y - l.mean) <= o.tol THEN l.m + 1 ELSE 1 END,
  CASE WHEN abs(o.y - l.mean) <= o.tol THEN l.g ELSE l.g + 1 END FROM bl l JOIN od o ON o.book_id = l.book_id AND o.page = l.page AND o.part = l.part AND o.rn = l.rn + 1""",
    "fl": f"SELECT o.*, l.g, median(o.size) OVER (PARTITION BY o.book_id, o.page, o.part, l.g) AS ls, lag(str) OVER v AS ps, lag(x + w) OVER v AS pe FROM od o JOIN bl l ON o.book_id = l.book_id AND o.page = l.page AND o.part = l.part AND o.rn = l.rn WINDOW v AS (PARTITION BY o.book_id, o.page, o.part, l.g ORDER BY x, y, frag_ord)",
    "ft": "SELECT book_id, page, part, g, arg_min(font, (-n, o)) AS font FROM (SELECT book_id, page, part, g, font, sum(length(str)) AS n, min((x, y, frag_ord)) AS o FROM fl GROUP BY ALL) GROUP BY book_id, page, part, g",
    "lt": f"""SELECT book_id, page, part, g, any_value(b) AS b, string_agg({needs_blank('ls')} || str, '' ORDER BY x, y, frag_ord) AS text, arg_min(x, (x, y, frag_ord)) AS x, median(y) AS y, arg_max(x + w, (x, y, frag_ord)) AS "right", any_value(ls) AS size,
  greatest(0, max(coalesce(x - pe, 0))) AS max_gap FROM fl GROUP BY book_id, page, part, g""",
    "lb": f"SELECT l.*, f.font, part = -1 AS banner, sum((part = -1)::INT) OVER (PARTITION BY l.book_id, l.page ORDER BY y, (part = -1) DESC, l.g ROWS UNBOUNDED PRECEDING) - (part = -1)::INT AS band FROM lt l JOIN ft f USING (book_id, page, part, g)",
    "ln": f"""SELECT *, row_number() OVER ({P} ORDER BY band, banner, greatest(part, 0), y, x, g) - 1 AS line_idx, greatest(part, 0) AS col, coalesce(len(b) - 1, 1) AS n_columns FROM lb""",
    "kb": f"SELECT book_id, page, line_idx, text, {signature('text')} AS sig FROM ln WHERE y <= 792 * 0.085::DOUBLE OR y >= 792 * (1 - 0.085::DOUBLE)",
    "kk": f"SELECT book_id, page, line_idx, unnest({keys('sig')}) AS key FROM kb",
    "rh": "SELECT k.book_id, key FROM kk k JOIN (SELECT book_id, count(DISTINCT page) AS n FROM ln GROUP BY book_id) b ON k.book_id = b.book_id GROUP BY k.book_id, key, n HAVING count(DISTINCT page) >= greatest(3, floor(n * 0.25))",
    "dr": f"SELECT book_id, page, line_idx FROM kb WHERE {folio('text')} UNION SELECT k.book_id, k.page, k.line_idx FROM kk k JOIN rh r ON k.book_id = r.book_id AND k.key = r.key",
    "kl": "SELECT l.* FROM ln l ANTI JOIN dr d ON l.book_id = d.book_id AND l.page = d.page AND l.line_idx = d.line_idx",
    "sg": f"SELECT *, sum(fresh) OVER ({P} ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, coalesce((col <> lag(col) OVER ({P} ORDER BY line_idx))::INT, 0) AS fresh FROM kl)",
    "ms": f"""SELECT * EXCLUDE (sp), CASE WHEN sp <> 0 THEN sp ELSE 12 END AS spacing FROM (SELECT *, median(CASE WHEN dy > 0 AND dy < 100 THEN dy END) OVER ({P}, seg) AS sp, {rank('x', 0.1)} AS "left", {rank('"right"', 0.9)} AS edge
  FROM (SELECT *, lead(y) OVER ({P}, seg ORDER BY line_idx) - y AS dy FROM sg))""",
    "bs": """SELECT a.book_id, CASE WHEN m <> 0 THEN m ELSE 10 END AS body FROM (SELECT DISTINCT book_id FROM ln) a LEFT JOIN (SELECT book_id, median(s) AS m FROM (SELECT book_id, floor(size * 10 + 0.5) / 10 AS s, unnest(range(least(4, CAST(ceil(length(text) / 20) AS BIGINT)))) AS r FROM ln) GROUP BY book_id) b ON a.book_id = b.book_id""",
    "mk": f"SELECT *, size < ls * 0.84::DOUBLE AND regexp_matches({trim('str')}, '{MARKER}') AS mark FROM fl",
    "rf": f"SELECT book_id, page, part, g, string_agg({trim('str')}, ',' ORDER BY x, y, frag_ord) AS refs, arg_min({trim('str')}, (x, y, frag_ord)) AS ref FROM mk WHERE mark GROUP BY ALL",
    "km": f"SELECT book_id, page, part, g, string_agg({needs_blank('ls')} || str, '' ORDER BY x, y, frag_ord) AS plain FROM (SELECT * EXCLUDE (ps, pe), lag(str) OVER v AS ps, lag(x + w) OVER v AS pe FROM mk WHERE NOT mark WINDOW v AS (PARTITION BY book_id, page, part, g ORDER BY x, y, frag_ord)) GROUP BY ALL",
    "st": f"SELECT m.*, coalesce(r.refs, '') AS refs, r.ref, CASE WHEN r.refs IS NULL THEN m.text ELSE coalesce(k.plain, '') END AS plain, {trim('m.text')} AS t, body FROM ms m LEFT JOIN rf r USING (book_id, page, part, g) LEFT JOIN km k USING (book_id, page, part, g) JOIN bs USING (book_id)",
    "sc": r"""SELECT *, CASE WHEN size >= body * 1.35::DOUBLE THEN 3 WHEN size >= body * 1.15::DOUBLE THEN 2 WHEN size >= body * 1.05::DOUBLE THEN 1 ELSE 0 END + regexp_matches(font, '(?i)bold|black|heavy|semibold|demibold')::INT + CASE WHEN length(t) <= 70 THEN 1 ELSE -3 END + (NOT regexp_matches(t, '[.,;:]\z'))::INT
  + (t = upper(t) AND regexp_matches(t, '[A-Z]') AND length(t) > 2)::INT + 3 * regexp_matches(t, '(?i)\A(chapter|part|book|section|prologue|epilogue|introduction|preface|foreword|afterword|conclusion|appendix|interlude|coda|acknowledg)')::INT + 2 * regexp_matches(t, '\A([IVXLC]{1,7}|[0-9]{1,3})\z')::INT
  + (edge > "left" AND abs((x + "right") / 2 - ("left" + edge) / 2) < (edge - "left") * 0.06::DOUBLE AND "right" - x < (edge - "left") * 0.85::DOUBLE)::INT AS score, regexp_split_to_array(t, '[~WS]+') AS tok,
  y >= 792 * 0.58::DOUBLE AND size < body * 0.92::DOUBLE AND regexp_matches(t, '~NOTE') AND avg((size < body * 0.94::DOUBLE)::INT) OVER (PARTITION BY book_id, page, seg ORDER BY line_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0.7 AS opens FROM st""".replace("~WS", WS).replace("~NOTE", NOTE),  # fmt: skip
    "k1": rf"""SELECT *, CASE WHEN line_idx >= nf THEN 'note' WHEN regexp_matches(t, '(?i)\A(figure|fig|table|plate|chart|exhibit|diagram|map|source|photo)\b') AND size <= body * 1.05::DOUBLE THEN 'caption' WHEN t <> '' AND score >= 4 THEN 'heading'
  WHEN max_gap > body * 2.2::DOUBLE OR (len(tok) >= 3 AND len(list_filter(tok, lambda z: regexp_matches(z, '\A[0-9.,%$()–-]+\z'))) / len(tok) >= 0.6) THEN 'table' WHEN regexp_matches(t, '{LIST}') THEN 'list' ELSE 'body' END AS kind1
  FROM (SELECT *, min(CASE WHEN opens THEN line_idx END) OVER ({P}, seg) AS nf FROM sc)""",
    "k2": f"SELECT *, sum((kind1 IS DISTINCT FROM pk)::INT) OVER ({P}, seg ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS run1 FROM (SELECT *, lag(kind1) OVER ({P}, seg ORDER BY line_idx) AS pk FROM k1)",
    "kd": f"SELECT *, CASE WHEN kind1 = 'table' AND count(*) OVER ({P}, seg, run1) < 3 THEN 'body' ELSE kind1 END AS kind FROM k2",
    "r1": f"""SELECT *, kind IS DISTINCT FROM lag(kind) OVER ({P}, seg ORDER BY line_idx) AS new, dy > spacing * 1.5 OR (regexp_matches({trim('plain')}, '[.!?]["''”’)\\]]?\\z') AND edge > "left" AND ("right" < edge - body * 2.2::DOUBLE OR lead(x) OVER ({P}, seg ORDER BY line_idx) > "left" + body * 0.7::DOUBLE)) AS brk FROM kd""",
    "r2": f"SELECT *, sum(new::INT) OVER ({P}, seg ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS run, coalesce(lag(brk) OVER ({P}, seg ORDER BY line_idx), false) AS broken FROM r1",
    "r3": f"SELECT *, CASE WHEN new OR kind = 'caption' THEN 1 WHEN kind = 'heading' THEN ((row_number() OVER ({P}, seg, run ORDER BY line_idx) - 1) % 3 = 0)::INT WHEN kind = 'note' THEN regexp_matches(t, '{NOTE}')::INT WHEN kind = 'list' THEN (broken OR regexp_matches(t, '{LIST}'))::INT WHEN kind = 'body' THEN broken::INT ELSE 0 END AS starts FROM r2",
    "r4": f"SELECT *, sum(starts) OVER ({P}, seg ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS block FROM r3",
    "r5": f"SELECT *, row_number() OVER ({P}, seg, block ORDER BY line_idx) = 1 AS head, regexp_extract({trim('plain')}, '{NOTE}') AS mark FROM r4",
    "r6": f"SELECT *, {trim('CASE WHEN kind = ' + q('note') + ' AND head THEN substr(' + trim('plain') + ', length(mark) + 1) WHEN kind = ' + q('note') + ' THEN text WHEN kind = ' + q('heading') + ' THEN text ELSE plain END')} AS pc FROM r5",
    "r7": f"SELECT *, lead(pc) OVER ({P}, seg, block ORDER BY line_idx) AS nx FROM r6 WHERE pc <> '' OR kind = 'table'",
    "r8": rf"SELECT *, regexp_matches(pc, '[\p{{L}}\p{{N}}]-\z') AS hy, regexp_matches(coalesce(nx, ''), '\A\p{{Ll}}') AS low FROM r7",
    "r9": f"""SELECT book_id, page, seg, block, any_value(kind) AS kind, CASE any_value(kind) WHEN 'table' THEN string_agg({clean('text')}, '; ' ORDER BY line_idx) WHEN 'heading' THEN string_agg(pc, ' ' ORDER BY line_idx) WHEN 'caption' THEN any_value(pc)
  ELSE string_agg(CASE WHEN nx IS NULL THEN pc WHEN NOT hy THEN pc || ' ' WHEN low THEN pc[:-2] ELSE pc END, '' ORDER BY line_idx) END AS raw, count(*) AS n, sum((hy AND low AND nx IS NOT NULL AND kind IN ('note', 'body', 'list'))::INT) AS hyphens FROM r8 GROUP BY book_id, page, seg, block""",
    "ra": f"SELECT book_id, page, seg, block, arg_min(mark, line_idx) AS mark, arg_min(ref, line_idx) FILTER (ref IS NOT NULL) AS ref FROM r5 GROUP BY book_id, page, seg, block",
    "rw": rf"""SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page, seg, block) - 1 AS BIGINT) AS raw_idx, CASE kind WHEN 'note' THEN 'footnote' WHEN 'body' THEN 'paragraph' ELSE kind END AS type, text, page,
  CASE WHEN kind = 'note' AND mark <> '' THEN regexp_replace({trim('mark')}, '[.)\]]\z', '') WHEN kind IN ('body', 'list') THEN ref END AS note_ref, CASE WHEN kind = 'table' THEN n ELSE 0 END AS n_rows, CAST(hyphens AS BIGINT) AS n_hyphens
  FROM (SELECT r9.*, mark, ref, CASE WHEN kind = 'table' THEN raw ELSE {clean('raw')} END AS text FROM r9 JOIN ra USING (book_id, page, seg, block)) WHERE text <> ''""",
    "mr": "SELECT book_id, k AS mark_ord, k % 3 AS depth, CASE WHEN k = 3 THEN '  ' ELSE '  Section ' || chr(9) || ' ' || k || ' of  ' || book_id || ' ' END AS title, CASE WHEN k = 5 THEN 0 WHEN k = 6 THEN 1 ELSE k // 2 + 1 END AS page FROM (SELECT DISTINCT book_id FROM fr WHERE book_id % 3 = 0), (SELECT unnest(range(8)) AS k)",
    "ol": f"SELECT book_id, CAST(page AS BIGINT) AS page, title, row_number() OVER (PARTITION BY book_id ORDER BY page) AS place FROM (SELECT book_id, page, arg_min(title, mark_ord) AS title FROM (SELECT book_id, page, mark_ord, regexp_replace({trim('title')}, '[{WS}]+', ' ', 'g') AS title FROM mr WHERE depth <= 1 AND page > 0) WHERE title <> '' GROUP BY ALL)",
    "os": "SELECT o.book_id, o.title, coalesce(min(r.raw_idx) FILTER (r.type = 'heading'), min(r.raw_idx)) AS raw_idx FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ol) o LEFT JOIN rw r ON o.book_id = r.book_id AND o.page = r.page WHERE n >= 2 GROUP BY o.book_id, o.page, o.title",
    "ch": rf"""SELECT r.*, length({trim('text')}) BETWEEN 1 AND 90 AND type = 'heading' AND (regexp_matches({trim('text')}, '(?i)\A((chapter|chap\.?|part|book|section|canto|volume)[{WS}]+([0-9]{{1,3}}|[ivxlcdm]{{1,7}}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)|prologue|epilogue|introduction|preface|foreword|afterword|conclusion|appendix|epigraph|dedication|acknowledgements?|acknowledgments?|notes|bibliography|index|glossary|about the author)\b')
  OR regexp_matches({trim('text')}, '\A([0-9]{{1,3}}|[IVXLCDM]{{1,7}})\z')) AS is_ch, s.title AS marked, r.book_id IN (SELECT book_id FROM os) AS outlined, regexp_split_to_array({trim('text')}, '[{WS}]+') AS w FROM rw r LEFT JOIN (SELECT * FROM os WHERE raw_idx IS NOT NULL) s ON r.book_id = s.book_id AND r.raw_idx = s.raw_idx""",
    "ct": """SELECT *, CASE WHEN outlined THEN marked WHEN nf >= 2 THEN CASE WHEN is_ch THEN text END WHEN raw_idx % greatest(25, CAST(ceil(n / 12) AS BIGINT)) = 0 THEN CASE WHEN length(array_to_string(w[:7], ' ')) < 8 THEN 'Page ' || page ELSE 'p.' || page || ' — ' || array_to_string(w[:7], ' ') || CASE WHEN len(w) > 7 THEN '…' ELSE '' END END END AS own
  FROM (SELECT *, sum(is_ch::INT) OVER (PARTITION BY book_id) AS nf, count(*) OVER (PARTITION BY book_id) AS n FROM ch)""",
    "cs": "SELECT *, CAST(sum((title IS NOT NULL)::INT) OVER (PARTITION BY book_id ORDER BY raw_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chapter FROM (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN raw_idx = 0 THEN 'Opening' END AS title FROM ct)",
    "bb": f"SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter, type = 'footnote', raw_idx) - 1 AS BIGINT) AS block_id, type, text, page, chapter, {words('text')} AS words, note_ref, title, CASE WHEN title IS NOT NULL THEN CASE WHEN marked IS NOT NULL THEN 'outline' ELSE 'heuristic' END END AS source FROM cs",
    "pc": f"SELECT book_id, page, CAST(sum(length({trim('text')})) AS BIGINT) AS chars, CAST(max(n_columns) AS BIGINT) AS n_columns, sum(length({trim('text')})) >= 100 AS has_text FROM ln GROUP BY book_id, page",
}


def after(step: str, select: str) -> str:
    """The steps up to the one named, and what is selected from them."""
    names = list(STEPS)
    used = names[: names.index(step) + 1]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('mg', 'bl') else 'MATERIALIZED '}({STEPS[n]})" for n in used) + "\n" + select


def oracle_sql() -> dict[str, str]:
    r = lambda *cs: ", ".join(f'round({c}, 4) AS {c}' for c in cs)
    images = "(SELECT book_id, page, count(*) AS k FROM (SELECT book_id, page, ['paintImageXObject', 'showText', 'paintInlineImageXObject', 'fill'][CAST((book_id + i) % 4 + 1 AS BIGINT)] AS op FROM (SELECT book_id, page, unnest(range((book_id + page) % 5 + 1)) AS i FROM (SELECT DISTINCT book_id, page FROM fr))) WHERE op LIKE 'paint%' GROUP BY ALL)"
    quality = f"""SELECT b.book_id, n_pages, coverage, scanned, n_columns, CAST(coalesce(h.n, 0) AS BIGINT) AS headers, CAST(coalesce(c.footnotes, 0) AS BIGINT) AS footnotes, CAST(coalesce(c.tables, 0) AS BIGINT) AS tables, images, CAST(coalesce(c.hyphens, 0) AS BIGINT) AS hyphens, coverage < 0.6 AND scanned <> '' AS needs_ocr, coverage < 0.85 AS sparse FROM
(SELECT p.book_id, count(*) AS n_pages, round(avg(has_text::INT), 6) AS coverage, CAST(sum(CASE WHEN has_text THEN 0 ELSE coalesce(k, 0) END) AS BIGINT) AS images, max(n_columns) AS n_columns, coalesce(string_agg('' || p.page, ',' ORDER BY p.page) FILTER (NOT has_text AND k > 0), '') AS scanned FROM pc p LEFT JOIN {images} i ON p.book_id = i.book_id AND p.page = i.page GROUP BY p.book_id) b
LEFT JOIN (SELECT book_id, count(*) AS n FROM dr GROUP BY book_id) h ON b.book_id = h.book_id
LEFT JOIN (SELECT book_id, sum((type = 'footnote')::INT) AS footnotes, sum((type = 'table')::INT) AS tables, sum(n_hyphens) AS hyphens FROM rw GROUP BY book_id) c ON b.book_id = c.book_id"""
    return {
        "fragments": after("fr", "SELECT book_id, page, frag_ord, str, x, round(y, 6) AS y, w, h, size, font FROM fr"),
        "read_fragments": after("fr", "SELECT book_id, page, frag_ord, str, x, round(y, 6) AS y, w, h, size, font FROM fr"),
        "column_bounds": after("cb", "SELECT book_id, page, array_to_string(list_transform(b, lambda z: CAST(CAST(floor(z * 100 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS bounds FROM cb"),
        "reading_order": after("ln", f"SELECT book_id, page, CAST(line_idx AS BIGINT) AS line_idx, text, {r('x', 'y', '\"right\"', 'size', 'max_gap')}, font, CAST(col AS BIGINT) AS col, CAST(n_columns AS BIGINT) AS n_columns FROM ln"),
        "page_chars": after("pc", "SELECT * FROM pc"),
        "layout_furniture": after("dr", "SELECT book_id AS book, page, CAST(line_idx AS BIGINT) AS line_idx FROM dr"),
        "segment_measures": after("ms", f"SELECT book_id, page, CAST(seg AS BIGINT) AS seg, {r('spacing', '\"left\"', 'edge')} FROM (SELECT DISTINCT book_id, page, seg, spacing, \"left\", edge FROM ms)"),
        "body_sizes": after("bs", f"SELECT book_id, {r('body')} FROM bs"),
        "line_kinds": after("kd", "SELECT book_id, page, CAST(line_idx AS BIGINT) AS line_idx, CAST(seg AS BIGINT) AS seg, kind, plain, refs FROM kd"),
        "raw_blocks": after("rw", "SELECT * FROM rw"),
        "outline": after("ol", "SELECT * FROM ol"),
        "book_blocks": after("bb", "SELECT book_id, block_id, type, text, page, chapter, words, note_ref FROM bb"),
        "book_chapters": after("bb", "SELECT book_id, chapter, max(title) AS title, max(source) AS source, min(block_id) AS start_block, max(block_id) + 1 AS end_block, arg_min(page, block_id) AS page, CAST(sum(words) AS BIGINT) AS words FROM bb GROUP BY book_id, chapter"),
        "chapter_list": after("bb", f"SELECT book_id, chapter, title, page, {duration('(words / 165.0 * 60)')} AS duration, source = 'heuristic' AS inferred FROM (SELECT book_id, chapter, max(title) AS title, max(source) AS source, arg_min(page, block_id) AS page, sum(words) AS words FROM bb GROUP BY book_id, chapter)"),
        "extraction_quality": after("pc", quality),
    }
