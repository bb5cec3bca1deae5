"""Temporal list join for URLs, in DataFrame functions only: dated entries become intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.llm.common import table

FOREVER = 2**31 - 1
SALT = 16
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#\[\]]+)"
_ADDRESS = r"^\[|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; null where there is none."""
    host = F.rtrim(F.regexp_extract(F.lower(url), _HOST, 1), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """Intervals (domain, since, until, action) of dated entries (domain, day, action): each holds until the domain's next entry.

    Of several entries of a domain and day ``block`` wins, then the last action by name. These are brought together first, so that a
    domain has at most a row a day however often it is listed. Entries with a null domain, day or action are no entries.
    """
    strongest = F.max(F.struct((F.col("action") == "block").alias("block"), F.col("action").alias("name")))
    days = entries.where("domain is not null and day is not null and action is not null").groupBy(F.lower("domain").alias("domain"), F.col("day").cast("int").alias("since")).agg(strongest.alias("a"))
    until = F.coalesce(F.lead("since").over(W.partitionBy("domain").orderBy("since")), F.lit(FOREVER))
    return days.select("domain", "since", until.alias("until"), F.col("a.name").alias("action"))


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of the places that the hosts below one name are dealt to."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with host, blocked, listed_domain and since: what the list said of the URL's host on the day it was fetched.

    An entry covers its domain and all below it; an IP address is a domain of its own, with none above it. Of the entries active on the
    day the longest domain decides, as it stood then.

    The as-of join is a window over the domain's intervals and the days that it is asked for: each such day gets the last
    interval that began by then. Hosts, days and domains are made distinct before (summed before the shuffle), so the window of a domain
    holds a row a day and a row an entry, whatever the captures; entries and days don't multiply, and no size of the list is assumed. The hosts
    below one name are dealt to ``SALT`` places, each with that name's intervals, so neither a listed nor an unlisted name is one task's.

    A null URL, one without a host and a null day are not blocked. Equal captures stay as many. Columns of ``captures`` by the new
    names are replaced; any other name is free.
    """
    kept = [c for c in captures.columns if c.lower() not in ("host", "blocked", "listed_domain", "since")]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"), F.col(day).cast("int").alias("day"))
    asked = rows.where("host is not null and day is not null").select("host", "day").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = asked.select("host", "day", F.pmod(F.xxhash64("host"), F.lit(SALT)).cast("int").alias("salt"), F.explode(F.when(F.col("host").rlike(_ADDRESS), F.array("host")).otherwise(suffixes)).alias("domain"))
    listed = intervals(entries).select("domain", F.col("since").alias("day"), F.struct("since", "until", "action").alias("entry"))
    # Names above a host that no entry has, as those that all hosts share, are left out before anything is gathered by name.
    named = named.join(_salted(listed.select("domain").distinct()), ["domain", "salt"], "left_semi")
    points = named.select("domain", "day").distinct()
    # On one day the entry comes before the question.
    as_of = F.last("entry", ignorenulls=True).over(W.partitionBy("domain").orderBy("day", F.col("entry").isNull()).rowsBetween(W.unboundedPreceding, 0))
    active = listed.unionByName(points, allowMissingColumns=True).select("domain", "day", as_of.alias("held"), F.col("entry").isNull().alias("point")).where("point and held is not null and day < held.until")
    found = named.join(_salted(active.select("domain", "day", "held")), ["domain", "day", "salt"])
    verdict = found.groupBy("host", "day").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "held")).alias("v"))
    out = rows.join(verdict, ["host", "day"], "left")
    return out.select("row.*", "host", F.coalesce(F.col("v.held.action") == "block", F.lit(False)).alias("blocked"), F.col("v.domain").alias("listed_domain"), F.col("v.held.since").alias("since"))


#: Entries of whole domains in the registered query.
DOMAIN_ENTRIES = [("example.org", 120, "block"), ("example.org", 150, "allow"), ("example.net", 200, "allow"), ("example.net", 300, "block"), ("example.net", 310, "allow"), ("example.org", 90, "block"), ("example.org", 90, "allow"), ("example.com", 60, "allow"), ("example.com", 60, "block"), ("example.com", 250, "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages. The table has no fetch time and no list, so both are derived: the day of a capture from its page_id, and
    a dated list from the hosts themselves (blocked on a day, allowed again later) beside fixed entries of whole domains."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetch_day", F.pmod("page_id", F.lit(366)).cast("int"))
    mark = F.md5(F.col("domain").cast("binary"))
    first = (F.ascii(F.substring(mark, 1, 1)) * 2).cast("int")
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct().withColumns({"a": first, "b": (first + F.ascii(F.substring(mark, 2, 1))).cast("int")})
    listed = hosts.where("a < 180").select("domain", F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit("block").alias("action")), F.struct(F.col("b").alias("day"), F.lit("allow").alias("action")))).alias("e")).select("domain", "e.*")
    fixed = spark.sql("select * from values " + ", ".join(f"('{d}', {n}, '{a}')" for d, n, a in DOMAIN_ENTRIES) + " as t(domain, day, action)")
    return judge(pages, fixed.unionByName(listed)).select("page_id", "host", "fetch_day", "blocked", "listed_domain", "since")


OP6_SQL = (
    """
WITH p AS (
  SELECT page_id, CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetch_day,
    nullif(rtrim(regexp_extract(lower(url), '"""
    + _HOST
    + """', 1), '.'), '') AS host FROM pages
), h AS (
  SELECT host AS domain, 2 * ascii(substr(md5(host), 1, 1)) AS a, 2 * ascii(substr(md5(host), 1, 1)) + ascii(substr(md5(host), 2, 1)) AS b
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
), e AS (
  SELECT domain, day, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE max(action) END AS action FROM (
    SELECT domain, a AS day, 'block' AS action FROM h WHERE a < 180 UNION ALL SELECT domain, b, 'allow' FROM h WHERE a < 180
    UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"('{d}', {n}, '{a}')" for d, n, a in DOMAIN_ENTRIES)
    + """) v(domain, day, action)
  ) GROUP BY domain, day
), i AS (SELECT domain, day AS since, action, coalesce(lead(day) OVER (PARTITION BY domain ORDER BY day), 2147483647) AS until FROM e),
q AS (SELECT DISTINCT host, fetch_day FROM p WHERE host IS NOT NULL),
m AS (
  SELECT q.host, q.fetch_day, i.domain, i.since, i.action, row_number() OVER (PARTITION BY q.host, q.fetch_day ORDER BY length(i.domain) DESC) AS k
  FROM q JOIN i ON (q.host = i.domain OR q.host LIKE '%.' || i.domain AND NOT regexp_matches(q.host, '"""
    + _ADDRESS
    + """')) AND q.fetch_day >= i.since AND q.fetch_day < i.until
)
SELECT p.page_id, p.host, p.fetch_day, coalesce(m.action = 'block', false) AS blocked, m.domain AS listed_domain, CAST(m.since AS INTEGER) AS since
FROM p LEFT JOIN m ON m.host = p.host AND m.fetch_day = p.fetch_day AND m.k = 1
"""
)
