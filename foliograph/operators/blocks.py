"""From lines in reading order to typed blocks: headings, tables, notes, captions, lists, paragraphs."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators.arrays import bound
from foliograph.operators.layout import LEAST_SIZE, PAGE, joined, or_else

S = f"[{T.WS}]"

# They must equal the reference's for equal results.
MARKER_SIZE, MARKER = 0.84, r"\A(?:[0-9]{1,3}|[*†‡§]{1,2})\z"
BOLD = r"(?i)bold|black|heavy|semibold|demibold"
HEADING = r"(?i)\A(?:chapter|part|book|section|prologue|epilogue|introduction|preface|foreword|afterword|conclusion|appendix|interlude|coda|acknowledg)"
NUMERAL = r"\A(?:[IVXLC]{1,7}|[0-9]{1,3})\z"
LIST = rf"\A(?:[•\-–]|\(?[0-9]{{1,2}}[.)]|\(?[a-z][.)]){S}+"
CAPTION = r"(?i)\A(?:fig(?:ure)?|table|plate|chart|exhibit|diagram|map|source|photo)(?![A-Za-z0-9_])"
NOTE = rf"\A(?:[0-9]{{1,3}}[.)\]]?{S}+|[*†‡§]{{1,3}}{S}*)"
NUMERIC = r"\A[0-9.,%$()\-–]+\z"
SENTENCE_END = r"""[.!?]["'”’)\]]?\z"""
HEADING_SCORE, CAPTION_SIZE = 4, 1.05
SIZE_SCORES = {1.35: 3, 1.15: 2, 1.05: 1}
HEADING_LENGTH, CENTRED_OFF, CENTRED_WIDTH = 70, 0.06, 0.85
TABLE_GAP, TABLE_TOKENS, TABLE_SHARE, TABLE_ROWS, TITLE_LINES = 2.2, 3, 0.6, 3, 3
NOTE_FLOOR, NOTE_SIZE, NOTE_REST, NOTE_SHARE = 0.58, 0.92, 0.94, 0.7
BREAK_GAP, SHORT_LINE, INDENT = 1.5, 2.2, 0.7
# End of the fixed values.
#: Between the cells of a table while they are made normal: noncharacters, which no text has.
CELL = "\uFDD0\uFDD1\uFDD0"


def weighted_sizes() -> Column:
    """The sizes of a page's lines, to a tenth, each weighted by up to four times twenty characters: an array of (s, weight), what has no weight stays out (B1)."""
    size = lambda z: F.floor(z["size"] * 10 + 0.5) / 10
    weight = lambda s: F.aggregate("lines", F.lit(0).cast("long"), lambda a, z: a + F.when(size(z).eqNullSafe(s), F.least(F.lit(4), F.ceil(F.length(z["text"]) / 20))).otherwise(0))
    return F.filter(F.transform(F.array_distinct(F.transform("lines", size)), lambda s: F.struct(s.alias("s"), weight(s).alias("weight"))), lambda x: x["weight"] > 0)


def unmarked(f: Column, size: Column, text: Column) -> Column:
    """plain, a line's text without superscript note markers, and refs, those markers."""
    marks = lambda z: (z["size"] < size * MARKER_SIZE) & T.js_trim(z["str"]).rlike(MARKER)
    plain = lambda refs: F.when(F.size(refs) == 0, text).otherwise(bound(F.filter(f, lambda z: ~marks(z)), lambda kept: joined(kept, size)))
    return bound(F.transform(F.filter(f, marks), lambda z: T.js_trim(z["str"])), lambda refs: F.struct(plain(refs).alias("plain"), refs.alias("refs")))


def heading_score(t: Column) -> Column:
    """How much a trimmed line speaks for a heading."""
    size, body, width = F.col("size"), F.col("body"), F.col("edge") - F.col("left")
    point = lambda test, n=1: F.when(test, n).otherwise(0)
    centred = (width > 0) & (F.abs((F.col("x") + F.col("right")) / 2 - (F.col("left") + F.col("edge")) / 2) < width * CENTRED_OFF) & (F.col("right") - F.col("x") < width * CENTRED_WIDTH)
    larger = F.greatest(F.lit(0), *[F.when(size >= body * times, points) for times, points in SIZE_SCORES.items()])
    score = larger + point(F.col("font").rlike(BOLD)) + F.when(F.length(t) <= HEADING_LENGTH, 1).otherwise(-3) + point(~t.rlike(r"[.,;:]\z")) + point((t == F.upper(t)) & t.rlike("[A-Z]") & (F.length(t) > 2))
    return F.when(t == "", 0).otherwise(score + point(t.rlike(HEADING), 3) + point(t.rlike(NUMERAL), 2) + point(centred))


def is_tabular(t: Column) -> Column:
    """A line with a wide gap, or mostly of numbers."""
    tokens = F.split(t, f"{S}+")
    return (F.col("max_gap") > F.col("body") * TABLE_GAP) | ((F.size(tokens) >= TABLE_TOKENS) & (F.size(F.filter(tokens, lambda x: x.rlike(NUMERIC))) / F.size(tokens) >= TABLE_SHARE))


def labelled(segs: DataFrame) -> DataFrame:
    """The lines of segments with kind (note, caption, heading, table, list or body), plain, refs and t, the trimmed text (B7 to B9). segs: of layout.segments(), with body (of sizes, or null), the lines with unmarked.

    All that a line's neighbours say is asked in one order of the segment's lines, so they are sorted once.
    """
    rows = segs.select(*PAGE, "page_height", or_else(F.col("body"), LEAST_SIZE).alias("body"), "seg", "spacing", "left", "edge", F.inline("lines"))
    rows = rows.withColumn("plain", F.col("unmarked.plain")).withColumn("refs", F.col("unmarked.refs")).drop("unmarked").withColumn("t", T.js_trim(F.col("text")))
    order = Window.partitionBy(*PAGE, "seg").orderBy("line_idx")
    whole, up_to = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    # of the lines from here on: what the segment has less what stands before
    is_small = (F.col("size") < F.col("body") * NOTE_REST).cast("int")
    rows = rows.withColumn("is_small", is_small).withColumn("small", (F.sum("is_small").over(whole) - F.sum("is_small").over(up_to) + F.col("is_small")) / (F.count("*").over(whole) - F.row_number().over(order) + 1))
    opens = (F.col("y") >= F.col("page_height") * NOTE_FLOOR) & (F.col("size") < F.col("body") * NOTE_SIZE) & F.col("t").rlike(NOTE) & (F.col("small") > NOTE_SHARE)
    rows = rows.withColumn("in_note", F.coalesce(F.max(opens).over(up_to), F.lit(False)))
    kind = (
        F.when(F.col("in_note"), "note").when(F.col("t").rlike(CAPTION) & (F.col("size") <= F.col("body") * CAPTION_SIZE), "caption")
        .when(heading_score(F.col("t")) >= HEADING_SCORE, "heading").when(is_tabular(F.col("t")), "table").when(F.col("t").rlike(LIST), "list").otherwise("body")
    )
    rows = rows.withColumn("kind", kind).drop("is_small", "small", "in_note")
    # a table has TABLE_ROWS lines one after the other
    near = {at: F.coalesce(F.lag("kind", -at).over(order) == "table", F.lit(False)) for at in range(1 - TABLE_ROWS, TABLE_ROWS) if at}
    in_table = reduce(or_, [reduce(and_, [near[at] for at in range(first, first + TABLE_ROWS) if at]) for first in range(1 - TABLE_ROWS, 1)])
    return rows.withColumn("kind", F.when((F.col("kind") == "table") & ~in_table, "body").otherwise(F.col("kind")))


def heals(parts: Column, i: Column) -> Column:
    """Whether the hyphen at the end of line i goes: one behind a letter or digit, before a lower-case letter."""
    return F.get(parts, i).rlike(r"[\p{L}\p{N}]-\z") & F.coalesce(F.get(parts, i + 1).rlike(r"\A\p{Ll}"), F.lit(False))


def wrapped(parts: Column) -> Column:
    """Trimmed, non-empty lines of one paragraph in one text (B15): a hyphen goes or stays, without a blank; else a blank stands between."""

    def piece(p: Column, i: Column) -> Column:
        hyphen = p.rlike(r"[\p{L}\p{N}]-\z")
        return F.when(F.get(parts, i + 1).isNull(), p).when(~hyphen, F.concat(p, F.lit(" "))).when(heals(parts, i), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)

    return F.array_join(F.transform(parts, piece), "")


def raw_blocks(rows: DataFrame) -> DataFrame:
    """book_id, raw_idx, type, text, page, note_ref, n_rows, n_hyphens of labelled lines.

    Where a block begins is told by a line and its neighbours; the running count of beginnings numbers the blocks of a segment.
    """
    order = Window.partitionBy(*PAGE, "seg").orderBy("line_idx")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    kind, before = F.col("kind"), F.lag("kind").over(order)
    rows = rows.withColumn("new", F.coalesce(kind != before, F.lit(True))).withColumn("nth", F.row_number().over(order))
    place = F.col("nth") - F.max(F.when(F.col("new"), F.col("nth"))).over(up_to)
    wide = F.col("edge") > F.col("left")
    ends = T.js_trim(F.col("plain")).rlike(SENTENCE_END)
    short, indented = wide & (F.col("right") < F.col("edge") - F.col("body") * SHORT_LINE), wide & (F.lead("x").over(order) > F.col("left") + F.col("body") * INDENT)
    breaks = (F.col("dy") > F.col("spacing") * BREAK_GAP) | (ends & short) | (ends & indented)
    rows = rows.withColumn("place", place).withColumn("breaks", F.coalesce(breaks, F.lit(False))).withColumn("broken", F.coalesce(F.lag("breaks").over(order), F.lit(False)))
    starts = (
        F.when(F.col("new") | (kind == "caption"), True).when(kind == "heading", F.col("place") % TITLE_LINES == 0).when(kind == "note", F.col("t").rlike(NOTE))
        .when(kind == "list", F.col("broken") | F.col("t").rlike(LIST)).when(kind == "body", F.col("broken")).otherwise(False)
    )
    rows = rows.withColumn("starts", starts).withColumn("block", F.sum(F.col("starts").cast("int")).over(up_to))
    rows = rows.withColumn("trimmed", T.js_trim(F.col("plain"))).withColumn("cell", F.when(kind == "table", F.col("text")))
    part = F.struct("line_idx", "t", "trimmed", "cell", "refs")
    made = rows.groupBy(*PAGE, "seg", "block").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(part)).alias("parts"))
    kind, parts, first = F.col("kind"), F.col("parts"), F.get(F.col("parts"), F.lit(0))["trimmed"]
    made = made.withColumn("mark", F.when(kind == "note", F.regexp_extract(first, NOTE, 0)))
    opening = F.array(T.js_trim(F.substring(first, F.length("mark") + 1, F.length(first))))
    flow = F.when(kind == "note", F.concat(opening, F.transform(F.slice(parts, 2, F.size(parts)), lambda p: p["t"]))).when(kind == "heading", F.transform(parts, lambda p: p["t"])).otherwise(F.transform(parts, lambda p: p["trimmed"]))
    made = made.withColumn("flow", F.filter(flow, lambda p: p != "")).withColumn("is_flow", kind.isin("note", "body", "list"))
    whole = F.when(F.col("is_flow"), wrapped(F.col("flow"))).when(kind != "table", F.array_join("flow", " "))
    # the cleaning has a step in Python, which sees each block once; the cells of a table are cleaned one by one behind it
    made = made.withColumn("normal", T.nfc(F.when(kind == "table", F.array_join(F.transform(parts, lambda p: p["cell"]), CELL)).otherwise(whole)))
    cells = F.array_join(F.transform(F.split("normal", CELL), T.clean_normal), "; ")
    made = made.withColumn("text", F.when(kind == "table", cells).otherwise(T.clean_normal(F.col("normal"))))
    kinds = F.create_map(*[F.lit(x) for pair in {"note": "footnote", "body": "paragraph", "list": "list", "caption": "caption", "heading": "heading", "table": "table"}.items() for x in pair])
    ref = F.when(kind == "note", F.when(F.col("mark") != "", F.regexp_replace(T.js_trim(F.col("mark")), r"[.)\]]\z", ""))).when(kind.isin("body", "list"), F.get(F.flatten(F.transform(parts, lambda p: p["refs"])), F.lit(0)))
    healed = F.size(F.filter(F.transform("flow", lambda p, i: heals(F.col("flow"), i)), lambda x: x))
    book = Window.partitionBy("book_id").orderBy("page", "seg", "block")
    block = F.struct(kinds[kind].alias("type"), "text", ref.alias("note_ref"), F.when(kind == "table", F.size(parts)).otherwise(0).cast("long").alias("n_rows"), F.when(F.col("is_flow"), healed).otherwise(0).cast("long").alias("n_hyphens"))
    # as a filter above an expression would make the text twice
    made = made.select(*PAGE, "seg", "block", F.inline(F.filter(F.array(block), lambda b: b["text"] != "")))
    return made.select("book_id", (F.row_number().over(book) - 1).cast("long").alias("raw_idx"), "type", "text", "page", "note_ref", "n_rows", "n_hyphens")
