"""URL filters whose lists change over time.

List entries (pattern, action, since) say from when on a host pattern is blocked or allowed. Each entry is valid until
the pattern's next one; of entries of the same time `block` holds. A capture is judged by the entries that are valid
at its fetch time for its host and the host's parent domains; the longest pattern decides. The as-of join is an equi-join
on pattern and year: validity intervals are split by the years that they cover, so neither side gathers a pattern's
whole history; intervals are a table, so that Spark can split the captures of a frequent domain. Hosts ask for no shorter
pattern than the list has. Decisions are made once for each host and fetch time.

Only DataFrame functions are used.

Defined cases: a null url, or one without a host, has no host and is not blocked; a null fetch time is before all
entries; entries without pattern, action or time are ignored; repeated captures each have a row; an empty list
blocks nothing; a very long url is read as any other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until (null: still valid) of the entries."""
    known = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL").select("pattern", "action", "since").distinct()
    nxt = F.lead("since").over(Window.partitionBy("pattern").orderBy("since", "action"))
    return known.withColumn("until", nxt).where("until IS NULL OR until > since")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All rows of captures (page_id, url, fetched) with host, pattern, action, since, until of the entry that decides, and blocked."""
    rows = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"))
    last = rows.agg(F.max("fetched").alias("last")).scalar()
    spans = validity(entries).withColumn("last", last).where("since <= last")
    to = F.year(F.least(F.coalesce("until", "last"), "last"))
    spans = stored(spans.withColumn("year", F.explode(F.sequence(F.year("since"), to))).drop("last"), "list-intervals", compact=True)
    labels = lambda c: F.size(F.split(c, r"\."))
    least = F.coalesce(spans.agg(F.min(labels(F.col("pattern"))).alias("least")).scalar(), F.lit(1))
    times = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    times = times.withColumn("parts", F.split("host", r"\.")).withColumn("most", F.size("parts") - least + 1).where("most > 0")
    parents = F.transform(F.sequence(F.lit(1), F.col("most")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    asked = times.select("host", "fetched", F.explode(parents).alias("pattern"), F.year("fetched").alias("year"))
    met = asked.join(spans, ["pattern", "year"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    entry = F.max_by(F.struct("pattern", "action", "since", "until"), F.length("pattern")).alias("e")
    found = met.groupBy("host", "fetched").agg(entry)
    out = rows.join(found, ["host", "fetched"], "left")
    return out.select("page_id", "url", "host", "fetched", "e.pattern", "e.action", "e.since", "e.until", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time: they carry none, so a multiple of page_id counts minutes of one year."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return pages.select("page_id", "url", F.timestamp_seconds(F.unix_timestamp(start) + F.pmod(F.col("page_id") * 7919, F.lit(525_600)) * 60).alias("fetched"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A list that grows with the pages: by its hash every fourth host is blocked from some day on, half of them for 45 days; and a few domains by hand."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")).where("h % 4 = 0")
    day = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("h") % 300) * 86_400
    blocks = hosts.select("pattern", F.lit("block").alias("action"), F.timestamp_seconds(day).alias("since"))
    allows = hosts.where("h % 8 = 0").select("pattern", F.lit("allow").alias("action"), F.timestamp_seconds(day + 45 * 86_400).alias("since"))
    by_hand = [("example.net", "block", "2024-03-01"), ("example.net", "allow", "2024-05-01"), ("example.org", "block", "2024-01-09"), ("example.org", "allow", "2024-01-09"), ("blog.example.com", "block", "2023-06-01")]
    hand = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("action"), F.lit(d).cast("timestamp").alias("since")) for p, a, d in by_hand))
    hand = pages.sparkSession.range(1).select(F.inline(hand))
    return blocks.unionByName(allows).unionByName(hand)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(demo_captures(pages), demo_entries(pages))


ORACLE = r"""
WITH hosts AS (
  SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
    TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919 % 525600)::BIGINT) AS fetched
  FROM pages),
numbered AS (SELECT DISTINCT host AS pattern, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM hosts WHERE host IS NOT NULL),
entries AS (
  SELECT pattern, 'block' AS action, TIMESTAMP '2024-01-01' + to_days((h % 300)::INTEGER) AS since FROM numbered WHERE h % 4 = 0
  UNION SELECT pattern, 'allow', TIMESTAMP '2024-01-01' + to_days((h % 300 + 45)::INTEGER) FROM numbered WHERE h % 8 = 0
  UNION VALUES ('example.net', 'block', TIMESTAMP '2024-03-01'), ('example.net', 'allow', TIMESTAMP '2024-05-01'), ('example.org', 'block', TIMESTAMP '2024-01-09'), ('example.org', 'allow', TIMESTAMP '2024-01-09'), ('blog.example.com', 'block', TIMESTAMP '2023-06-01')),
valid AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since, action) AS until FROM entries),
met AS (
  SELECT h.page_id, v.*, row_number() OVER (PARTITION BY h.page_id ORDER BY length(v.pattern) DESC) AS k
  FROM hosts h JOIN valid v ON (h.host = v.pattern OR ends_with(h.host, '.' || v.pattern)) AND v.since <= h.fetched AND (v.until IS NULL OR h.fetched < v.until))
SELECT h.page_id, h.url, h.host, h.fetched, m.pattern, m.action, m.since, m.until, coalesce(m.action = 'block', false) AS blocked
FROM hosts h LEFT JOIN met m ON h.page_id = m.page_id AND m.k = 1
"""
