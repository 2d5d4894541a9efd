"""Lines, kinds and blocks of one book after the other, in Python on the executors: the rules of layout.py, furniture.py and blocks.py on a book's own values.

A book is laid out where its text is read; nothing but its result leaves the task. Names and fixed values are those of the modules that have the rules as columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby
from math import ceil, floor
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa

from foliograph.functions import text as T
from foliograph.operators import blocks as B
from foliograph.operators import layout as L

#: Rows that are handed to Spark at once, at least.
ROWS = 10_000


def pattern(java: str) -> re.Pattern:
    """A pattern of the column functions; letters are those of ASCII, as in Java."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", java).replace(r"\z", r"\Z"), re.ASCII)


FOLIO, MARKER, BOLD, HEADING, NUMERAL = map(pattern, (T.FOLIO, B.MARKER, B.BOLD, B.HEADING, B.NUMERAL))
LIST, CAPTION, NOTE, NUMERIC, SENTENCE_END, BLANK = map(pattern, (B.LIST, B.CAPTION, B.NOTE, B.NUMERIC, B.SENTENCE_END, f"{B.S}+"))
DIGITS, ROMAN, OTHER, CAPITAL, MARK_END = map(pattern, ("[0-9]+", "(?<![A-Za-z0-9_])[ivxlcdm]+(?![A-Za-z0-9_])", "[^a-z#]+", "[A-Z]", r"[.)\]]\z"))
RULES = [(pattern(p), put.replace("$1", r"\1")) for p, put in T.CLEAN_RULES]
FOLD = {ord(c): T.FOLD_TO[i] if i < len(T.FOLD_TO) else None for i, c in reversed(list(enumerate(T.FOLD_FROM)))}
WHITE = frozenset(T.BLANKS)
#: What a text must begin or end with for a pattern to hold; looking costs less than the pattern.
HEADING_FIRST, CAPTION_FIRST, NUMERIC_FIRST, ENDS = map(frozenset, ("cpbseifaCPBSEIFA", "ftpcedmsFTPCEDMS", "0123456789.,%$()-–", ".!?"))
FOLDED = re.compile(f"[{re.escape(T.FOLD_FROM)}{re.escape(''.join(T.LIGATURES))}]")
CLOSED = tuple(f" {c}" for c in ",.;:!?%)]}")
SIZE_SCORES = sorted(B.SIZE_SCORES.items(), reverse=True)


class Fragment(NamedTuple):
    x: float
    y: float
    frag_ord: int
    str: str
    w: float
    size: float
    font: str | None


class Line(NamedTuple):
    text: str
    x: float
    y: float
    right: float
    size: float
    font: str | None
    col: int
    max_gap: float
    plain: str
    refs: list[str]
    t: str  # the trimmed text
    trimmed: str  # the trimmed plain text


class Page(NamedTuple):
    page: int
    height: float
    n_columns: int
    lines: list[Line]


def median(values: list[float]) -> float:
    n = len(values)
    if n < 3:
        return values[0] if n == 1 else values[0] * 0.5 + values[1] * 0.5
    v = sorted(values)
    return v[n // 2] if n % 2 else v[n // 2 - 1] * 0.5 + v[n // 2] * 0.5


def spans_page(z: Fragment, width: float) -> bool:
    right = z.x + z.w
    return right - z.x > width * L.WIDE or (right - z.x > width * L.CENTRED and abs((z.x + right) / 2 - width / 2) < width * L.OFF_CENTRE)


def bounds_of(frags: list[Fragment], wide: list[bool], width: float, height: float) -> list[float] | None:
    body = [z for z, across in zip(frags, wide, strict=True) if not across and height * L.BODY_TOP < z.y < height * L.BODY_BOTTOM]
    if len(body) < L.LEAST_FRAGMENTS:
        return None
    noise, depth, since, mids = floor(len(body) * L.NOISE), 0, None, []
    for at, minus, _ in sorted([(z.x, -1, z.frag_ord) for z in body] + [(z.x + z.w, 1, z.frag_ord) for z in body]):
        was, depth = depth, depth - minus
        if (depth <= noise) != (was <= noise):
            if depth > noise and since is not None and at - since >= width * L.GUTTER and width * L.GUTTER_FROM < (since + at) / 2 < width * L.GUTTER_TO:
                mids.append((since + at) / 2)
            since = at
    kept: list[float] = []
    for m in sorted(mids):
        if not kept or m - kept[-1] > width * L.SAME_GUTTER:
            kept.append(m)
    if len(kept) not in (1, 2):
        return None
    bounds, centres = [0.0, *kept, width], [z.x + z.w / 2 for z in body]
    shares = [sum(low <= c < high for c in centres) for low, high in zip(bounds, bounds[1:], strict=False)]
    return None if any(n < len(body) * L.LEAST_SHARE for n in shares) else bounds


def baselines(parts: list[tuple[int, Fragment]]) -> Iterator[tuple[int, float, list[Fragment]]]:
    """part, its median size and the fragments of each line from left to right."""
    for part, own in groupby(sorted([(part, z.y, z.x, z.frag_ord, z) for part, z in parts]), itemgetter(0)):
        frags = [p[-1] for p in own]
        usual = median([z.size for z in frags])
        tolerance = max(L.LEAST_TOLERANCE, (usual or L.LEAST_SIZE) * L.TOLERANCE)
        line: list[Fragment] = []
        mean = 0.0
        for z in frags:
            if line and abs(z.y - mean) <= tolerance:
                mean = (mean * len(line) + z.y) / (len(line) + 1)
                line.append(z)
            else:
                if line:
                    yield part, usual, sorted(line)
                line, mean = [z], z.y
        yield part, usual, sorted(line)


def joined(f: list[Fragment], size: float) -> str:
    out, before = [], None
    for z in f:
        if before and z.x - (before.x + before.w) > size * L.SPACE and before.str[-1] not in WHITE and z.str[0] not in WHITE:
            out.append(" ")
        out.append(z.str)
        before = z
    return "".join(out)


def line_of(part: int, usual: float, f: list[Fragment]) -> Line:
    first, last = f[0], f[-1]
    sizes = [z.size for z in f]
    size = median(sizes) or usual
    limit, widest, pieces, end, font, fonts = size * L.SPACE, 0.0, [first.str], first.x + first.w, first.font, 1
    for i in range(1, len(f)):
        z = f[i]
        gap = z.x - end
        widest = max(widest, gap)
        if gap > limit and pieces[-1][-1] not in WHITE and z.str[0] not in WHITE:
            pieces.append(" ")
        pieces.append(z.str)
        end, fonts = z.x + z.w, fonts + (z.font != font)
    plain, refs, small = (text := "".join(pieces)), [], size * B.MARKER_SIZE
    if min(sizes) < small:
        marks = [z.size < small and bool(MARKER.search(z.str.strip(T.BLANKS))) for z in f]
        refs = [z.str.strip(T.BLANKS) for z, mark in zip(f, marks, strict=True) if mark]
        plain = joined([z for z, mark in zip(f, marks, strict=True) if not mark], size) if refs else text
    if fonts > 1:
        weights: dict[str | None, int] = {}
        for z in f:
            weights[z.font] = weights.get(z.font, 0) + len(z.str)
        font = max(weights, key=weights.__getitem__)
    t = text.strip(T.BLANKS)
    return Line(text, first.x, median([z.y for z in f]), last.x + last.w, size, font, max(part, 0), widest, plain, refs, t, plain.strip(T.BLANKS) if refs else t)


def page_of(page: int, width: float, height: float, frags: list[Fragment]) -> Page:
    """The page's lines in reading order."""
    wide = [spans_page(z, width) for z in frags]
    bounds = bounds_of(frags, wide, width, height)
    parts = []
    for z, across in zip(frags, wide, strict=True):
        if bounds is None or across:
            parts.append((0 if bounds is None else -1, z))
        else:
            centre = z.x + z.w / 2
            parts.append((next((i for i, high in enumerate(bounds[1:-1]) if centre < high), len(bounds) - 2), z))
    found = [(part, line_of(part, usual, f)) for part, usual, f in baselines(parts)]
    banners = [(z.y, -1, i) for i, (part, z) in enumerate(found) if part == -1]
    keyed = [(sum(b < (z.y, -int(part == -1), i) for b in banners) if banners else 0, part == -1, z.col, z.y, z.x, i) for i, (part, z) in enumerate(found)]
    return Page(page, height, len(bounds) - 1 if bounds else 1, [found[k[-1]][1] for k in sorted(keyed)])


def in_band(z: Line, height: float) -> bool:
    return z.y <= height * L.BAND or z.y >= height * (1 - L.BAND)


def keys_of(line: str) -> list[str]:
    sig = OTHER.sub(" ", ROMAN.sub("#", DIGITS.sub("#", line.lower()))).strip(" ")
    words = [w for w in sig.split(" ") if w]
    return [] if len(sig) < 2 else [sig, " ".join(words[:4]), " ".join(words[-4:])] if len(words) > 4 else [sig]


def dropped(pages: list[Page]) -> list[set[int]]:
    """Of each page the places of its lines that are furniture."""
    bands = [{i: keys_of(z.text) for i, z in enumerate(p.lines) if in_band(z, p.height)} for p in pages]
    n_on = Counter(k for band in bands for k in {k for keys in band.values() for k in keys})
    least = max(3, floor(len(pages) * 0.25))
    return [{i for i, keys in band.items() if any(n_on[k] >= least for k in keys) or FOLIO.search(p.lines[i].t)} for p, band in zip(pages, bands, strict=True)]


def body_size(pages: list[Page]) -> float:
    weights: dict[float, int] = defaultdict(int)
    for p in pages:
        for z in p.lines:
            weights[floor(z.size * 10 + 0.5) / 10] += min(4, ceil(len(z.text) / 20))
    total = sum(weights.values())
    if not total:
        return L.LEAST_SIZE
    picked, so_far = [], 0
    for s in sorted(weights):
        so_far += weights[s]
        while len(picked) < 2 and so_far > ((total - 1) // 2, total // 2)[len(picked)]:
            picked.append(s)
    return picked[0] * 0.5 + picked[1] * 0.5 or L.LEAST_SIZE


class Segment(NamedTuple):
    page: int
    seg: int
    height: float
    spacing: float
    left: float
    edge: float
    rows: list[tuple[int, Line, str]]  # line_idx, line, kind


def nearest_rank(values: list[float], share: float) -> float:
    return sorted(values)[floor((len(values) - 1) * share + 0.5)]


@cache
def is_bold(font: str | None) -> bool:
    return bool(font and BOLD.search(font))


def heading_score(z: Line, t: str, body: float, left: float, edge: float) -> int:
    if t == "":
        return 0
    width = edge - left
    score = next((points for times, points in SIZE_SCORES if z.size >= body * times), 0)
    score += is_bold(z.font) + (1 if len(t) <= B.HEADING_LENGTH else -3) + (t[-1] not in ".,;:") + (len(t) > 2 and t == t.upper() and bool(CAPITAL.search(t)))
    centred = width > 0 and abs((z.x + z.right) / 2 - (left + edge) / 2) < width * B.CENTRED_OFF and z.right - z.x < width * B.CENTRED_WIDTH
    return score + 3 * (t[0] in HEADING_FIRST and bool(HEADING.search(t))) + 2 * (len(t) <= 7 and bool(NUMERAL.search(t))) + centred


def is_tabular(z: Line, t: str, body: float) -> bool:
    if z.max_gap > body * B.TABLE_GAP:
        return True
    tokens = t.split() if t.isprintable() else BLANK.split(t)  # a printable text has no white space but blanks
    return len(tokens) >= B.TABLE_TOKENS and len([x for x in tokens if x[:1] in NUMERIC_FIRST and NUMERIC.search(x)]) / len(tokens) >= B.TABLE_SHARE


def is_listed(t: str) -> bool:
    return (t[:1] in "•-–(" or "." in t[:4] or ")" in t[:4]) and bool(LIST.search(t))


def ends_sentence(t: str) -> bool:
    return (t[-1:] in ENDS or t[-2:-1] in ENDS) and bool(SENTENCE_END.search(t))


def kinds_of(own: list[tuple[int, Line]], body: float, height: float, left: float, edge: float) -> list[str]:
    kinds, in_note, small, n = [], False, len([z for _, z in own if z.size < body * B.NOTE_REST]), len(own)
    for i, (_, z) in enumerate(own):
        t = z.t
        in_note = in_note or (z.y >= height * B.NOTE_FLOOR and z.size < body * B.NOTE_SIZE and small / (n - i) > B.NOTE_SHARE and bool(NOTE.search(t)))
        small -= z.size < body * B.NOTE_REST
        kinds.append(
            "note" if in_note else "caption" if z.size <= body * B.CAPTION_SIZE and t[:1] in CAPTION_FIRST and CAPTION.search(t) else "heading" if heading_score(z, t, body, left, edge) >= B.HEADING_SCORE
            else "table" if is_tabular(z, t, body) else "list" if is_listed(t) else "body"
        )
    out: list[str] = []
    for kind, run in groupby(kinds):
        n_run = len(list(run))
        out += ["body" if kind == "table" and n_run < B.TABLE_ROWS else kind] * n_run
    return out


def segments(pages: list[Page], body: float | None = None) -> Iterator[Segment]:
    """The runs of one column in reading order, with the kinds of their lines; furniture is left out."""
    body = body_size(pages) if body is None else body
    for p, gone in zip(pages, dropped(pages), strict=True):
        kept = [(i, z) for i, z in enumerate(p.lines) if i not in gone]
        for seg, (_, run) in enumerate(groupby(kept, lambda r: r[1].col)):
            own = list(run)
            below = [dy for (_, a), (_, b) in zip(own, own[1:], strict=False) if 0 < (dy := b.y - a.y) < L.LARGEST_GAP]
            left, edge = nearest_rank([z.x for _, z in own], 0.1), nearest_rank([z.right for _, z in own], 0.9)
            kinds = kinds_of(own, body, p.height, left, edge)
            yield Segment(p.page, seg, p.height, (median(below) if below else 0) or L.USUAL_SPACING, left, edge, [(i, z, kind) for (i, z), kind in zip(own, kinds, strict=True)])


def clean(s: str) -> str:
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
        if FOLDED.search(s):
            for glyph, letters in T.LIGATURES.items():
                s = s.replace(glyph, letters)
            s = s.translate(FOLD)
    if not s.isprintable():
        for p, put in RULES:
            s = p.sub(put, s)
        return s.strip(T.BLANKS)
    # without signs of control, and with no white space but blanks, most rules are seen not to hold
    holds = "  " in s, any(x in s for x in CLOSED), "( " in s or "[ " in s or "{ " in s, s.count(".") > 3, "___" in s
    if any(holds):
        for p, put in RULES[1:]:
            s = p.sub(put, s)
    return s.strip(T.BLANKS)


def is_letter(c: str, kinds: str = "LN") -> bool:
    return unicodedata.category(c)[0] in kinds


def wrapped(flow: list[str]) -> tuple[str, int]:
    """The text of a paragraph's lines, and how many hyphens were healed."""
    out, healed = [], 0
    for p, after in zip(flow, [*flow[1:], None], strict=True):
        hyphen = len(p) > 1 and p[-1] == "-" and is_letter(p[-2])
        heals = hyphen and after is not None and unicodedata.category(after[0]) == "Ll"
        healed += heals
        out.append(p if after is None else p[:-1] if heals else p if hyphen else p + " ")
    return "".join(out), healed


TYPES = {"note": "footnote", "body": "paragraph"}


def block_of(kind: str, lines: list[Line]) -> tuple[str, str, str | None, int, int] | None:
    """type, text, note_ref, n_rows, n_hyphens; none of an empty text."""
    if kind == "table":
        text = "; ".join(clean(z.text) for z in lines)
        return ("table", text, None, len(lines), 0) if text else None
    ref, healed = None, 0
    if kind == "heading":
        flow = [z.t for z in lines]
    else:
        flow = [z.trimmed for z in lines]
    if kind == "note":
        found = NOTE.match(flow[0])
        mark = found[0] if found else ""
        flow = [flow[0][len(mark) :].strip(T.BLANKS), *[z.t for z in lines[1:]]]
        ref = MARK_END.sub("", mark.strip(T.BLANKS)) if mark else None
    elif kind in ("body", "list"):
        ref = next((r for z in lines for r in z.refs), None)
    flow = [p for p in flow if p]
    if kind in ("note", "body", "list"):
        whole, healed = wrapped(flow)
    else:
        whole = " ".join(flow)
    text = clean(whole)
    return (TYPES.get(kind, kind), text, ref, 0, healed) if text else None


def raw_blocks(pages: list[Page]) -> Iterator[tuple]:
    """raw_idx, type, text, page, note_ref, n_rows, n_hyphens."""
    body, n = body_size(pages), 0
    for s in segments(pages, body):
        made: list[tuple[str, list[Line]]] = []
        place, broken, before, wide = 0, False, None, s.edge > s.left
        for (_, z, kind), (_, after, _) in zip(s.rows, [*s.rows[1:], (0, None, "")], strict=True):
            place = place + 1 if kind == before else 0
            starts = (
                kind != before or kind == "caption" or (kind == "heading" and place % B.TITLE_LINES == 0) or (kind == "note" and bool(NOTE.search(z.t)))
                or (kind == "list" and (broken or is_listed(z.t))) or (kind == "body" and broken)
            )
            if starts:
                made.append((kind, []))
            made[-1][1].append(z)
            may_end = wide and (z.right < s.edge - body * B.SHORT_LINE or (after is not None and after.x > s.left + body * B.INDENT))
            broken = (after is not None and after.y - z.y > s.spacing * B.BREAK_GAP) or (may_end and ends_sentence(z.trimmed))
            before = kind
        for kind, lines in made:
            if found := block_of(kind, lines):
                yield n, found[0], found[1], s.page, *found[2:]
                n += 1


def of_books(rows: Callable[[int, str | None, str], Iterable[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (book_id, source, text), which gives the rows of each book behind its book_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for book, source, text in zip(*batch.columns, strict=True):
                if text.is_valid:
                    out += [(book.as_py(), *r) for r in rows(book.as_py(), source.as_py(), text.as_py())]
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run
