"""From positioned text fragments to lines in reading order: columns, baselines, bands.

A page is the unit: one row holds its fragments, and then its lines, as an array, so that no step moves or sorts the fragments of other pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators.arrays import bound, median

PAGE = ["book_id", "page"]

# They must equal the reference's for equal results.
WIDE, CENTRED, OFF_CENTRE = 0.72, 0.08, 0.05
BODY_TOP, BODY_BOTTOM = 0.09, 0.91
LEAST_FRAGMENTS, NOISE, GUTTER, GUTTER_FROM, GUTTER_TO, SAME_GUTTER, LEAST_SHARE = 12, 0.01, 0.018, 0.2, 0.8, 0.05, 0.15
LEAST_TOLERANCE, TOLERANCE, SPACE = 2.0, 0.45, 0.25 * 0.6
BAND = 0.085
LEAST_SIZE, USUAL_SPACING, LARGEST_GAP = 10.0, 12.0, 100
LEAST_CHARS = 100
# End of the fixed values.


def or_else(c: Column, other: Column | float) -> Column:
    """c, unless it is zero or null."""
    return F.coalesce(F.when(c != 0, c), other if isinstance(other, Column) else F.lit(float(other)))


def is_blank(text: Column) -> Column:
    return F.coalesce(T.js_trim(text) == "", F.lit(True))


def fragment_of(item: Callable[[str], Column], page_height: Column) -> list[Column]:
    """An item's fields as a fragment's (S3): the origin is at the top left; a size of zero or none is taken from the height, then 10; a height of zero or none from the size."""
    size = or_else(F.abs(item("scale")), or_else(item("height"), LEAST_SIZE))
    return [
        item("frag_ord").alias("frag_ord"), item("str").alias("str"), item("left").alias("x"), (page_height - item("base")).alias("y"), item("width").alias("w"), or_else(item("height"), size).alias("h"),
        size.alias("size"), item("font").alias("font"),
    ]


def fragments(items: DataFrame) -> DataFrame:
    """Text items (book_id, page, frag_ord, str, scale, left, base, width, height, font, page_width, page_height) with their origin at the top left (S3). Blank ones go."""
    return items.filter(~is_blank(F.col("str"))).select(*PAGE, *fragment_of(F.col, F.col("page_height")), "page_width", "page_height")


def page_fragments(pages: DataFrame) -> DataFrame:
    """fragments() for pages (book_id, page, page_width, page_height, items): book_id, page, page_width, page_height, f."""
    f = F.transform(F.filter("items", lambda i: ~is_blank(i["str"])), lambda i: F.struct(*fragment_of(lambda c: i[c], F.col("page_height"))))
    return pages.select(*PAGE, "page_width", "page_height", f.alias("f"))


def gathered(frags: DataFrame) -> DataFrame:
    """Fragments, one by one, as page_fragments() has them."""
    f = F.struct("frag_ord", "str", "x", "y", "w", "h", "size", "font")
    return frags.groupBy(*PAGE, "page_width", "page_height").agg(F.collect_list(f).alias("f"))


def spans_page(x: Column, right: Column, page_width: Column) -> Column:
    """A box across the page: wide, or centred on the page and not tiny."""
    return (right - x > page_width * WIDE) | ((right - x > page_width * CENTRED) & (F.abs((x + right) / 2 - page_width / 2) < page_width * OFF_CENTRE))


def bounds_of(f: Column) -> Column:
    """The bounds of a page's columns (from 0 to the page's width) if it has two or three, else null (G7). f: its fragments.

    A sweep over the boxes' edges: where hardly a box stands for long enough, in the page's middle, is a gutter.
    """
    width, height = F.col("page_width"), F.col("page_height")
    own = F.filter(f, lambda z: ~spans_page(z["x"], z["x"] + z["w"], width) & (z["y"] > height * BODY_TOP) & (z["y"] < height * BODY_BOTTOM))
    return bound(own, lambda body: F.when(F.size(body) >= LEAST_FRAGMENTS, gutters(body, width)))


def gutters(body: Column, width: Column) -> Column:
    edge = lambda at, minus, z: F.struct(at.alias("at"), F.lit(minus).alias("minus"), z["frag_ord"].alias("frag_ord"))
    events = F.sort_array(F.concat(F.transform(body, lambda z: edge(z["x"], -1, z)), F.transform(body, lambda z: edge(z["x"] + z["w"], 1, z))))
    noise = F.floor(F.size(body) * NOISE).cast("int")
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("depth"), none.alias("since"), F.array().cast("array<double>").alias("mids"))

    def step(a: Column, e: Column, noise: Column) -> Column:
        depth = a["depth"] - e["minus"]
        turn = (depth <= noise) != (a["depth"] <= noise)
        mid = (a["since"] + e["at"]) / 2
        gap = turn & (depth > noise) & a["since"].isNotNull() & (e["at"] - a["since"] >= width * GUTTER) & (mid > width * GUTTER_FROM) & (mid < width * GUTTER_TO)
        return F.struct(depth.alias("depth"), F.when(turn, e["at"]).otherwise(a["since"]).alias("since"), F.when(gap, F.concat(a["mids"], F.array(mid))).otherwise(a["mids"]).alias("mids"))

    mids = bound(noise, lambda noise: F.aggregate(events, start, lambda a, e: step(a, e, noise))["mids"])
    apart = lambda a, m: F.when((F.size(a) == 0) | (m - F.element_at(a, -1) > width * SAME_GUTTER), F.concat(a, F.array(m))).otherwise(a)
    kept = F.aggregate(F.sort_array(mids), F.array().cast("array<double>"), apart)
    inside = lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda low, i: F.size(F.filter(body, lambda z: (z["x"] + z["w"] / 2 >= low) & (z["x"] + z["w"] / 2 < F.get(b, i + 1)))))
    shared = lambda b: F.when(~F.exists(inside(b), lambda n: n < F.size(body) * LEAST_SHARE), b)
    return bound(kept, lambda mids: F.when(F.size(mids).isin(1, 2), bound(F.concat(F.array(F.lit(0.0)), mids, F.array(width.cast("double"))), shared)))


def column_bounds(pages: DataFrame) -> DataFrame:
    """book_id, page, bounds of the pages of two or three columns. pages: of page_fragments()."""
    return pages.select(*PAGE, bounds_of(F.col("f")).alias("bounds")).filter(F.col("bounds").isNotNull())


def in_parts(f: Column, bounds: Column) -> Column:
    """The fragments with their part of the page: the column (from 0), or -1 for boxes across the columns (G8); by part, then from the top."""

    def part(z: Column) -> Column:
        centre = z["x"] + z["w"] / 2
        column = F.when(centre < F.get(bounds, F.lit(1)), 0).when((F.size(bounds) == 4) & (centre < F.get(bounds, F.lit(2))), 1).otherwise(F.size(bounds) - 2)
        return F.when(bounds.isNull(), 0).when(spans_page(z["x"], z["x"] + z["w"], F.col("page_width")), -1).otherwise(column)

    return F.sort_array(F.transform(f, lambda z: F.struct(part(z).alias("part"), *[z[c].alias(c) for c in ("y", "x", "frag_ord", "str", "w", "size", "font")])))


def baselines(parts: Column, n_parts: Column) -> Column:
    """The lines of a page's parts: part, usual (the part's median size) and the fragments f from left to right (G3). parts: of in_parts(), n_parts: how many columns there are.

    A fragment joins the line before it if it stands near the mean baseline of that line's fragments so far; that mean
    depends on the order, so the ordered fragments are folded.
    """
    usual = F.transform(F.sequence(F.lit(-1), n_parts - 1), lambda p: median(F.transform(F.filter(parts, lambda z: z["part"] == p), lambda z: z["size"])))
    start = F.struct(F.lit(-2).alias("part"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, z: Column, tolerance: Column) -> Column:
        near = (a["part"] == z["part"]) & (F.abs(z["y"] - a["mean"]) <= F.get(tolerance, z["part"] + 1))
        return F.struct(
            z["part"].alias("part"), F.when(near, (a["mean"] * a["n"] + z["y"]) / (a["n"] + 1)).otherwise(z["y"]).alias("mean"), F.when(near, a["n"] + 1).otherwise(1).alias("n"),
            (a["i"] + 1).alias("i"), F.when(near, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["i"]))).alias("starts"),
        )

    def cut(starts: Column, usual: Column) -> Column:
        own = lambda at, g: F.slice(parts, at + 1, F.coalesce(F.get(starts, g + 1), F.size(parts)) - at)
        f = lambda z: F.struct(*[z[c].alias(c) for c in ("x", "y", "frag_ord", "str", "w", "size", "font")])
        part = lambda at: F.get(parts, at)["part"]
        return F.transform(starts, lambda at, g: F.struct(part(at).alias("part"), F.get(usual, part(at) + 1).alias("usual"), F.sort_array(F.transform(own(at, g), f)).alias("f")))

    tolerance = lambda usual: F.transform(usual, lambda u: F.greatest(F.lit(LEAST_TOLERANCE), or_else(u, LEAST_SIZE) * TOLERANCE))
    starts = lambda usual: bound(tolerance(usual), lambda t: F.aggregate(parts, start, lambda a, z: step(a, z, t))["starts"])
    return bound(usual, lambda usual: bound(starts(usual), lambda at: cut(at, usual)))


def gap_before(f: Column, i: Column) -> Column:
    """Distance of fragment i from the one before it; null for the first."""
    before = F.get(f, i - 1)
    return F.when(i > 0, F.get(f, i)["x"] - (before["x"] + before["w"]))


def joined(f: Column, size: Column) -> Column:
    """Text of a line's fragments, with a blank where the gap asks for one and neither side has one."""
    blank = lambda z, i: (gap_before(f, i) > size * SPACE) & ~F.get(f, i - 1)["str"].rlike(rf"[{T.WS}]\z") & ~z["str"].rlike(rf"\A[{T.WS}]")
    return F.array_join(F.transform(f, lambda z, i: F.concat(F.when(blank(z, i), " ").otherwise(""), z["str"])), "")


def font_of(f: Column) -> Column:
    """The font of most of a line's characters, of those of as many the first."""
    weight = lambda name: F.aggregate(F.filter(f, lambda z: z["font"].eqNullSafe(name)), F.lit(0), lambda a, z: a + F.length(z["str"]))
    most = lambda fonts: F.array_max(F.transform(fonts, lambda name, i: F.struct(weight(name).alias("n"), (-i).alias("i"), name.alias("font"))))["font"]
    return bound(F.array_distinct(F.transform(f, lambda z: z["font"])), lambda fonts: F.when(F.size(fonts) > 1, most(fonts)).otherwise(F.get(fonts, F.lit(0))))


def page_lines(pages: DataFrame, **fields: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """book_id, page, page_width, page_height, n_columns, lines of pages of fragments; a page without any goes. lines: line_idx (reading order, from 0), text, x, y, right, size, font, col, max_gap (G4, G9) and of each
    of fields what it makes of a line's fragments, size and text.

    A line across the page cuts it into bands; within a band column after column is read.
    """

    def made(z: Column, idx: Column) -> Column:
        f, last = z["f"], F.element_at(z["f"], -1)
        size = or_else(median(F.transform(f, lambda i: i["size"])), z["usual"])
        widest = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(f, lambda i, k: F.coalesce(gap_before(f, k), F.lit(0.0)))))
        return bound(size, lambda size: bound(joined(f, size), lambda text: F.struct(
            (z["part"] == -1).cast("int").alias("banner"), F.greatest(z["part"], F.lit(0)).alias("col"), median(F.transform(f, lambda i: i["y"])).alias("y"), F.get(f, F.lit(0))["x"].alias("x"),
            idx.alias("idx"), text.alias("text"), (last["x"] + last["w"]).alias("right"), size.alias("size"), font_of(f).alias("font"), widest.alias("max_gap"),
            *[field(f, size, text).alias(name) for name, field in fields.items()],
        )))

    def in_order(lines: Column) -> Column:
        height = lambda z: F.struct(z["y"].alias("y"), (-z["banner"]).alias("b"), z["idx"].alias("idx"))
        band = lambda z, banners: F.when(F.size(banners) == 0, 0).otherwise(F.size(F.filter(banners, lambda b: b < height(z))))
        banners = F.transform(F.filter(lines, lambda z: z["banner"] == 1), height)
        return bound(banners, lambda banners: F.sort_array(F.transform(lines, lambda z: F.struct(band(z, banners).alias("band"), z.alias("z")))))

    names = ["text", "x", "y", "right", "size", "font", "col", "max_gap", *fields]
    numbered = lambda z, i: F.struct(i.cast("long").alias("line_idx"), *[z["z"][c].alias(c) for c in names])
    n_columns = lambda bounds: F.coalesce(F.size(bounds) - 1, F.lit(1))
    built = lambda bounds: bound(in_parts(F.col("f"), bounds), lambda parts: baselines(parts, n_columns(bounds)))
    read = lambda bounds: F.transform(bound(F.transform(built(bounds), made), in_order), numbered)
    page = bound(bounds_of(F.col("f")), lambda bounds: F.struct(n_columns(bounds).alias("n_columns"), read(bounds).alias("lines")))
    return pages.select(*PAGE, "page_width", "page_height", F.inline(F.when(F.size("f") > 0, F.array(page))))


def lines(frags: DataFrame) -> DataFrame:
    """The lines of fragments, one by one: book_id, page, the page's measures, n_columns, line_idx, text, x, y, right, size, font, col, max_gap and f, a line's fragments from left to right."""
    return one_by_one(page_lines(gathered(frags), f=lambda f, size, text: f))


def one_by_one(pages: DataFrame) -> DataFrame:
    """The lines of pages, each with the page's other columns."""
    return pages.select(*[c for c in pages.columns if c != "lines"], F.inline("lines"))


def page_chars(pages: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """book_id, page, chars, has_text, n_columns of pages of lines."""
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, z: a + F.length(T.js_trim(z["text"])))
    return pages.select(*PAGE, chars.alias("chars"), F.col("n_columns").cast("long").alias("n_columns")).withColumn("has_text", F.col("chars") >= least)


def in_band(line: Column) -> Column:
    """Whether a line stands at the head or foot of the page (H1)."""
    return (line["y"] <= F.col("page_height") * BAND) | (line["y"] >= F.col("page_height") * (1 - BAND))


def ranked_value(value: str, share: float, seg: WindowSpec) -> Column:
    """The value of a window's rows at a share of their order, without interpolation (G2): the row of that rank is picked, nothing is collected."""
    rank = F.row_number().over(seg.orderBy(value)) - 1
    return F.struct((rank == F.floor((F.count("*").over(seg) - 1) * share + 0.5)).alias("picked"), F.col(value).alias("value"))


def nearest_rank(values: Column, share: float) -> Column:
    """ranked_value of an array; 0 of nulls."""
    return F.coalesce(F.get(F.sort_array(values), F.floor((F.size(values) - 1) * share + 0.5).cast("int")), F.lit(0.0))


def segments(pages: DataFrame) -> DataFrame:
    """The pages' other columns with, for each run of one column in reading order, seg (from 0, B2), spacing (G10), left and edge (its left and right measure, B4) and its lines, with dy (to the next line)."""
    starts = F.filter(F.transform("lines", lambda z, i: F.when((i == 0) | (z["col"] != F.get("lines", i - 1)["col"]), i)), lambda i: i.isNotNull())
    own = lambda at, end: F.slice("lines", at + 1, F.coalesce(end, F.size("lines")) - at)
    below = lambda own: F.filter(F.transform(own, lambda z, i: F.get(own, i + 1)["y"] - z["y"]), lambda dy: (dy > 0) & (dy < LARGEST_GAP))
    cut = lambda seg, own: F.struct(
        seg.cast("long").alias("seg"), or_else(median(below(own)), USUAL_SPACING).alias("spacing"), nearest_rank(F.transform(own, lambda z: z["x"]), 0.1).alias("left"),
        nearest_rank(F.transform(own, lambda z: z["right"]), 0.9).alias("edge"), F.transform(own, lambda z, i: z.withField("dy", F.get(own, i + 1)["y"] - z["y"])).alias("lines"),
    )
    segs = bound(starts, lambda starts: F.transform(starts, lambda at, seg: bound(own(at, F.get(starts, seg + 1)), lambda own: cut(seg, own))))
    return pages.select(*[c for c in pages.columns if c != "lines"], F.inline(segs))
