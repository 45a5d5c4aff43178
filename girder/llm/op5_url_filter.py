"""URL filter by a temporal list join.

A list is a log of dated entries: a domain is added or removed at an instant. Each domain's entries become
validity intervals [added, next entry), open at the end where none follows. A capture is blocked if at its
fetch time an interval of its host or of any parent domain is active: an as-of join.

The join is an equi-join on (domain, month): intervals are cut at month boundaries up to the last capture,
captures carry their month, so a host with a third of all captures is spread over the months, and a
capture never meets entries of other months. A month of a hot host is left to the adaptive skew join,
whose other side holds the few pieces of one domain and month.

Entries of one domain at one instant: a removal yields to an addition. Repeated entries count once. Nulls:
entries without domain or instant are ignored; a capture without a URL, host or fetch time is never
blocked and stays. Captures that repeat stay. An empty list blocks nothing; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import Scratch, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a final dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains: a.b.c gives a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until) from (domain, at, listed boolean); until is null where no entry follows."""
    known = entries.where("domain is not null and at is not null").groupBy(F.lower("domain").alias("domain"), "at").agg(F.max("listed").alias("listed"))
    until = F.lead("at").over(W.partitionBy("domain").orderBy("at"))
    return known.withColumn("until", until).where("listed").select("domain", F.col("at").alias("since"), "until")


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, host, fetched, blocked, domain) for captures (id, url, fetched): the longest listed domain, if any."""
    scratch = Scratch(captures.sparkSession, "op5")
    rows = captures.select("id", host_of(F.col("url")).alias("host"), "fetched", F.monotonically_increasing_id().alias("__row"))
    rows = scratch.save(rows, "captures")
    last = rows.agg(F.max("fetched")).first()[0]
    spans = intervals(entries).where(F.col("since") <= F.lit(last)) if last is not None else intervals(entries).where("false")
    until = F.coalesce("until", F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day"))
    pieces = spans.withColumn("__m", F.explode(F.sequence(_month(F.col("since")), F.greatest(_month(F.col("since")), _month(until))))).select(F.col("domain").alias("__d"), "__m", "since", "until")
    asked = rows.where("host is not null and fetched is not null").select("__row", "fetched", F.explode(domains_of(F.col("host"))).alias("domain"))
    asked = asked.withColumn("__month", _month(F.col("fetched")))
    met = asked.join(pieces, (F.col("domain") == F.col("__d")) & (F.col("__month") == F.col("__m")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    hits = met.groupBy(F.col("__row").alias("__hit")).agg(F.max_by("domain", F.length("domain")).alias("domain"))
    out = rows.join(hits, F.col("__row") == F.col("__hit"), "left")
    return out.select("id", "host", "fetched", F.col("domain").isNotNull().alias("blocked"), "domain")


#: The dated entries that the query derives from the hosts of the pages, in place of a list feed.
FIRST_DAY, DAYS = "2024-01-01", 366
LISTED_FOR, RELISTED_AFTER = 45, 90


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time that their id fixes, as the table has none."""
    at = F.expr(f"timestamp_ntz'{FIRST_DAY} 00:00:00' + make_dt_interval(int(pmod(page_id * 7919, {DAYS})))")
    return pages.select(F.col("page_id").alias("id"), "url", at.alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """For two hosts of five: listed on a day that the host's checksum fixes, removed later, listed again."""
    crc = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 8), 16, 10).cast("long")
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct().where(crc % 5 < 2)
    day = (crc % 300).cast("int")
    steps = F.array(*[F.struct((day + n).alias("day"), F.lit(on).alias("listed")) for n, on in ((0, True), (LISTED_FOR, False), (RELISTED_AFTER, True))])
    made = hosts.withColumn("x", F.explode(steps))
    return made.select("domain", F.expr(f"timestamp_ntz'{FIRST_DAY} 00:00:00' + make_dt_interval(x.day)").alias("at"), F.col("x.listed").alias("listed"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return blocked(page_captures(pages), page_entries(pages)).select(F.col("id").alias("page_id"), "host", "fetched", "blocked", "domain")


SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host,
         TIMESTAMP '{FIRST_DAY} 00:00:00' + to_days((((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS})::INTEGER) AS fetched
  FROM pages
), h AS (
  SELECT DISTINCT host AS domain, ('0x' || substr(md5(host), 1, 8))::BIGINT AS crc FROM p WHERE host IS NOT NULL
), e AS (
  SELECT domain, TIMESTAMP '{FIRST_DAY} 00:00:00' + to_days((crc % 300 + n)::INTEGER) AS noted, listed
  FROM h, (VALUES (0, true), ({LISTED_FOR}, false), ({RELISTED_AFTER}, true)) x(n, listed) WHERE crc % 5 < 2
), i AS (
  SELECT domain, noted AS since, lead(noted) OVER (PARTITION BY domain ORDER BY noted) AS until, listed FROM e
), m AS (
  SELECT p.page_id, arg_max(i.domain, length(i.domain)) AS domain
  FROM p JOIN i ON i.listed AND p.fetched >= i.since AND (i.until IS NULL OR p.fetched < i.until)
   AND (p.host = i.domain OR ends_with(p.host, '.' || i.domain))
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.fetched, m.domain IS NOT NULL AS blocked, m.domain FROM p LEFT JOIN m USING (page_id)
"""
