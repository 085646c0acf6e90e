"""URL filters by a temporal list join.

Dated list entries (a key is listed or taken off) become validity intervals, and every
capture is judged by the entries active when it was fetched.  The as-of join is an equi-join on (key, time
bin, salt) with the interval as residual: intervals of one key are disjoint, so a capture
meets an entry at most once per key; bins keep long histories apart and the salt splits a
host that holds much of the table.

Keys of a URL: its host, each parent domain of two labels or more, and host/first path
segment.  The active entry of the longest key decides; at equal length an allowing one wins.

Defined results: a null or malformed URL has no key and verdict ``none``; a null fetch date
meets no entry; entries with a null key or date are ignored; of several events of
one list, key and day, listing wins; repeated captures are judged together under their
(page_id, url, fetched); extra columns are ignored; empty tables give an empty result or no active entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

BIN_DAYS = 32
SALTS = 8
FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def url_keys(url: Column) -> Column:
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    first = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]+(/[^/?#]+)", 1)
    keys = F.when(first != "", F.concat(parents, F.array(F.concat(host, first)))).otherwise(parents)
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def validity(events: DataFrame) -> DataFrame:
    """Events (list, key, allow, day, listed) as intervals (list, key, allow, from_day, to_day): from_day <= t < to_day."""
    known = events.where("key IS NOT NULL AND day IS NOT NULL")
    last = known.groupBy("list", "key", "allow", "day").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("list", "key", "allow").orderBy("day")
    until = F.coalesce(F.lead("day").over(order), F.lit(FAR).cast("date"))
    return last.select("list", "key", "allow", F.col("day").alias("from_day"), until.alias("to_day"), "listed").where("listed").drop("listed")


def judge(captures: DataFrame, intervals: DataFrame, bin_days: int = BIN_DAYS, salts: int = SALTS) -> DataFrame:
    """page_id, url, fetched, host, n_active, verdict and entry (the key that decided) of every capture."""
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / bin_days)
    seen = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched")).distinct()
    keyed = seen.withColumn("key", F.explode_outer(url_keys(F.col("url")))).withColumn("bin", number(F.col("fetched")))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    span = captures.agg(F.min(F.col("fetched").cast("date")).alias("lo"), F.max(F.col("fetched").cast("date")).alias("hi")).first()
    lo, hi = (F.lit(span[x] or "1970-01-01").cast("date") for x in ("lo", "hi"))
    # an open interval spans the bins that have captures, no more
    clipped = intervals.where((F.col("from_day") <= hi) & (F.col("to_day") > lo))
    bins = F.sequence(number(F.greatest("from_day", lo)), number(F.least(F.date_sub("to_day", 1), hi)))
    spread = clipped.withColumn("bin", F.explode(bins)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = ["key", "bin", "salt"]
    active = keyed.join(spread, on, "left").withColumn("hit", (F.col("from_day") <= F.col("fetched")) & (F.col("fetched") < F.col("to_day")))
    best = F.max(F.when(F.col("hit"), F.struct(F.length("key").alias("n"), F.col("allow").alias("allow"), F.col("key").alias("key"))))
    judged = active.groupBy("page_id", "url", "fetched").agg(F.count_if("hit").alias("n_active"), best.alias("best"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow").otherwise("block")
    return judged.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), "n_active", verdict.alias("verdict"), F.coalesce("best.key", F.lit("")).alias("entry"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date, which the test tables lack: spread over 2024 by the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries over the keys that the pages have, which the test tables lack.

    The digest of a key says whether it is listed (one in three), whether the entry allows (one
    in five), when it is added, taken off and added again.
    """
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).distinct()
    digest = keys.withColumn("h", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")).where("h % 3 = 0")
    steps = [F.struct(F.lit(listed).alias("listed"), F.lit(after).alias("after")) for listed, after in ((True, 0), (False, 60), (True, 120))]
    steps = digest.withColumn("e", F.explode(F.array(*steps))).where("e.after < 60 OR h % 2 = 0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("h"), F.lit(300)) + F.col("e.after")).cast("int"))
    return steps.select(F.when(F.col("h") % 7 == 0, "spam").otherwise("general").alias("list"), "key", (F.col("h") % 5 == 0).alias("allow"), day.alias("day"), F.col("e.listed").alias("listed"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = judge(captures_of(pages), validity(entries_of(pages)))
    return found.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host", "n_active", "verdict", "entry")


ORACLE = r"""
WITH p AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]+(/[^/?#]+)', 1) AS seg FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
k AS (SELECT page_id, url, fetched, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS key FROM l WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, host || seg FROM l WHERE host <> '' AND seg <> ''),
h AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT key FROM k)),
e AS (SELECT key, h, after, listed, DATE '2024-01-01' + CAST(h % 300 + after AS INTEGER) AS day FROM h, (VALUES (true, 0), (false, 60), (true, 120)) s(listed, after) WHERE h % 3 = 0 AND (after < 60 OR h % 2 = 0)),
v AS (SELECT key, h % 5 = 0 AS allow, day AS from_day, coalesce(lead(day) OVER (PARTITION BY key ORDER BY day), DATE '9999-12-31') AS to_day, listed FROM e),
a AS (SELECT k.*, v.allow FROM k JOIN v ON k.key = v.key AND v.listed AND v.from_day <= k.fetched AND k.fetched < v.to_day),
b AS (SELECT page_id, url, fetched, count(*) AS n_active, first(key ORDER BY length(key) DESC, allow DESC, key DESC) AS entry, first(allow ORDER BY length(key) DESC, allow DESC, key DESC) AS allow FROM a GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, p.host, coalesce(b.n_active, 0) AS n_active,
  CASE WHEN b.allow IS NULL THEN 'none' WHEN b.allow THEN 'allow' ELSE 'block' END AS verdict, coalesce(b.entry, '') AS entry
FROM p LEFT JOIN b ON p.page_id = b.page_id AND p.url IS NOT DISTINCT FROM b.url AND p.fetched = b.fetched
"""
