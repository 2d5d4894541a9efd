"""URL filters as a temporal list join, in DataFrame functions alone.

List entries are dated: an entry adds a pattern to a list or removes it. By pattern and list they
become validity intervals, and every capture is held against the intervals that its own patterns
(host, parent domains, host with first path segment) had at its fetch time: an as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import table
from foliograph.llm.graph import saved

#: Captures of a pattern that one group takes, about: a host may hold a third of all captures, so those of a commoner pattern are dealt over groups, and its intervals are given to each.
SALT_ROWS = 500_000


#: The host of a URL, which may be an address in square brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: A host that is an address has no parent domains.
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+)*)$"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def patterns_of(url: Column) -> Column:
    """What a list can name of a URL: its host, every parent domain of two labels at least (an address has none), and its host with the first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1)
    parents = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(parents)
    known = F.array_union(parents, F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", known).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from entries (list, pattern, action add or remove, at): valid from an add to the next entry of the same list and pattern, until null if there is none.

    Of entries of the same instant a remove stands last; repeated entries change nothing. Entries with a null pattern or date, or another action, are left out.
    """
    known = entries.select("list", "pattern", "action", "at").filter(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    states = known.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    return states.withColumn("until", F.lead("at").over(order)).filter(F.col("action") == "add").select("list", "pattern", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row for each different (page_id, url, fetched) of the captures: n_rows (how often it occurs), host, n_active (list entries in force at its fetch time), lists and rules (those, distinct, sorted, comma-joined) and blocked.

    Null, empty and hostless URLs and null fetch times match nothing. A capture at the instant of an entry sees that entry. Other columns are not read.
    """
    kept = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_rows"))
    keys = kept.select("page_id", "url", "fetched", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    valid = intervals(entries)
    # one row for each salt_rows captures at most; cold patterns stay in one group
    hot = captures.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") > salt_rows).select("pattern", F.ceil(F.col("n") / salt_rows).alias("salts"))
    on = ["pattern"]
    if not hot.isEmpty():
        hot, on = saved(hot), ["pattern", "salt"]
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        keys = keys.join(hot, "pattern", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), salts)).drop("salts")
        valid = valid.join(hot, "pattern", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    hits = (
        keys.join(valid, on).filter((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
        .groupBy("page_id", "url", "fetched")
        .agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("rules"))
    )
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("page_id", "url", "fetched")]
    return kept.alias("c").join(hits.alias("h"), on, "left").select(
        "c.page_id", "c.url", "c.fetched", "c.n_rows", F.coalesce(host_of(F.col("c.url")), F.lit("")).alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("rules", F.lit("")).alias("rules"), (F.coalesce("n_active", F.lit(0)) > 0).alias("blocked"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; each page gets a day of 2024 by its page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, parent domains and host paths that occur in the pages, chosen and dated by crc32 of the pattern: two in five are listed, a third of those are removed later, and some of those come back."""
    keys = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).filter(F.size(F.split("pattern", r"[./]")) > 2).distinct().withColumn("h", F.crc32("pattern")).filter("h % 5 < 2")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 200).cast("int"))
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(day, days).alias("at"))
    events = F.array(event("add", F.lit(0)))
    events = F.when(F.col("h") % 3 == 0, F.concat(events, F.array(event("remove", (F.col("h") % 60 + 10).cast("int"))))).otherwise(events)
    events = F.when(F.col("h") % 6 == 0, F.concat(events, F.array(event("add", (F.col("h") % 60 + 50).cast("int"))))).otherwise(events)
    name = F.when(F.col("h") % 2 == 0, "adult").otherwise("spam")
    return keys.select(name.alias("list"), "pattern", F.explode(events).alias("e")).select("list", "pattern", "e.action", "e.at")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(derived_captures(pages), derived_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


def _crc32_sql(column: str) -> str:
    """crc32 is no function of DuckDB: bit by bit over the bytes, with list_reduce."""
    bits = "x"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda y: xor(y >> 1, 3988292384 * (y & 1)))[1]"
    step = bits.replace("[x]", "[xor(c, b)]", 1)
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {step}))"


_PATTERNS = """(SELECT page_id, url, host, pattern FROM (SELECT page_id, url, host, unnest(list_distinct(list_concat(
  CASE WHEN regexp_matches(host, '^(\\[.*|[0-9]+(\\.[0-9]+)*)$') THEN [host] ELSE list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END,
  CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) <> '' THEN [host || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1)] ELSE [] END))) AS pattern
  FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1)), '[.]$', '') AS host FROM pages) WHERE host <> ''))"""

OP4_SQL = f"""
WITH keys AS (SELECT DISTINCT pattern FROM {_PATTERNS} WHERE len(string_split_regex(pattern, '[./]')) > 2),
crc AS (SELECT pattern, {_crc32_sql('pattern')} AS h FROM keys),
l AS (SELECT pattern, h, CASE WHEN h % 2 = 0 THEN 'adult' ELSE 'spam' END AS list, DATE '2024-01-01' + CAST(h % 200 AS INTEGER) AS day FROM crc WHERE h % 5 < 2),
e AS (SELECT list, pattern, 'add' AS action, day AS at_day FROM l UNION ALL SELECT list, pattern, 'remove', day + CAST(h % 60 + 10 AS INTEGER) FROM l WHERE h % 3 = 0 UNION ALL SELECT list, pattern, 'add', day + CAST(h % 60 + 50 AS INTEGER) FROM l WHERE h % 6 = 0),
v AS (SELECT * FROM (SELECT list, pattern, action, at_day AS since, lead(at_day) OVER (PARTITION BY list, pattern ORDER BY at_day) AS until FROM e) WHERE action = 'add'),
k AS (SELECT page_id, url, host, pattern, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched FROM {_PATTERNS}),
x AS (SELECT k.page_id, k.url, count(*) AS n_active, string_agg(DISTINCT v.list, ',' ORDER BY v.list) AS lists, string_agg(DISTINCT v.pattern, ',' ORDER BY v.pattern) AS rules
  FROM k JOIN v ON k.pattern = v.pattern AND k.fetched >= v.since AND (v.until IS NULL OR k.fetched < v.until) GROUP BY ALL)
SELECT p.page_id, p.url, CAST(CAST(DATE '2024-01-01' + CAST(p.page_id % 365 AS INTEGER) AS DATE) AS VARCHAR) AS fetched, CAST(count(*) AS BIGINT) AS n_rows,
  regexp_replace(lower(regexp_extract(coalesce(p.url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1)), '[.]$', '') AS host,
  CAST(coalesce(any_value(x.n_active), 0) AS BIGINT) AS n_active, coalesce(any_value(x.lists), '') AS lists, coalesce(any_value(x.rules), '') AS rules, coalesce(any_value(x.n_active), 0) > 0 AS blocked
FROM pages p LEFT JOIN x ON p.page_id = x.page_id AND p.url = x.url GROUP BY p.page_id, p.url
"""
