"""Operator 5: URL filters by a temporal list join.

Block lists come as dated events: a list adds a domain on a day or removes it. The events of a list and domain become validity
intervals that do not overlap, and each capture is joined, as of its time of capture, with the entries active then for its host
or any parent domain of it. So a page that was captured before its site was listed, or after it was taken off, passes.

Cost at scale. The join is an equi-join on the domain; the interval is a residual of which at most one a list and domain can
hold, so a hot domain does not multiply rows, and a shuffled join may be split where it is skewed. A list is broadcast only
where it was counted to be small.

Defined results: among events of one list, domain and day the removal comes last. An event without list, domain, day or action is
ignored. A null or malformed URL has host '' and passes, and so does a capture without a time. Repeated rows each get their
verdict. Further columns of any name are ignored. Empty captures give an empty result, empty lists let everything pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._captures import SQL_HOST, SQL_TIME, captured_at, host
from ._spark import broadcast_if, table

#: (list, domain, day, action): the dated lists of the registered query.
EVENTS = (
    ("spam", "spam-farm.example.org", "2024-02-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-01-10", "add"),
    ("spam", "cheap-pills.example.com", "2024-05-20", "remove"),
    ("spam", "cheap-pills.example.com", "2024-09-01", "add"),
    ("gambling", "casino-win.example.org", "2024-03-15", "add"),
    ("gambling", "free-bets.example.com", "2024-01-01", "add"),
    ("gambling", "free-bets.example.com", "2024-07-01", "remove"),
    ("adult", "adult-x.example.net", "2024-01-01", "add"),
    ("malware", "tiontion.example.com", "2024-06-01", "add"),
    ("malware", "tiontion.example.com", "2024-06-15", "remove"),
    ("malware", "blog.ththan.example.net", "2024-10-01", "add"),
    ("parked", "ththble.example.net", "2024-11-01", "add"),
    ("parked", "free-bets.example.com", "2024-08-01", "add"),
    ("parked", "free-bets.example.com", "2024-08-01", "remove"),
)


def intervals(events: DataFrame) -> DataFrame:
    """list, domain, valid_from, valid_to (exclusive; null: still valid) of dated events (list, domain, day, action)."""
    known = events.where("list IS NOT NULL AND domain IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    rows = known.select("list", F.lower("domain").alias("domain"), F.col("day").cast("timestamp").alias("valid_from"), "action")
    order = Window.partitionBy("list", "domain").orderBy("valid_from", "action")
    spans = rows.withColumn("valid_to", F.lead("valid_from").over(order)).where("action = 'add' AND (valid_to IS NULL OR valid_from < valid_to)")
    return spans.select("list", "domain", "valid_from", "valid_to")


def filtered(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, host, captured_at, lists (names of the lists that hold it, sorted, joined by commas), domain (the most
    specific one listed), blocked: a row for each row of captures (page_id, url, captured_at)."""
    spans = intervals(events)
    rows = captures.select("page_id", "url", host(F.col("url")).alias("host"), "captured_at")
    asked = rows.where("host <> '' AND captured_at IS NOT NULL").select("host", "captured_at").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    near = asked.select("host", "captured_at", F.explode(parents).alias("domain"))
    active = (F.col("captured_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("captured_at") < F.col("valid_to")))
    found = near.join(broadcast_if(spans, events.count()), "domain").where(active)
    longest = F.max_by("domain", F.length("domain")).alias("domain")
    verdict = found.groupBy("host", "captured_at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), longest)
    return rows.join(verdict, ["host", "captured_at"], "left").select("page_id", "url", "host", "captured_at", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("domain", F.lit("")).alias("domain"), F.col("lists").isNotNull().alias("blocked"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the dated lists."""
    pages = table(spark, sf_dir, "pages")
    events = spark.createDataFrame(EVENTS, "list string, domain string, day string, action string")
    return filtered(pages.select("page_id", "url", captured_at(F.col("page_id")).alias("captured_at")), events)


SQL = f"""
WITH events(list, domain, day, action) AS (VALUES {", ".join(f"('{a}', '{b}', TIMESTAMP '{c} 00:00:00', '{d}')" for a, b, c, d in EVENTS)}),
spans AS (SELECT list, domain, day AS f, lead(day) OVER (PARTITION BY list, domain ORDER BY day, action) AS t, action FROM events),
rows AS (SELECT page_id, url, {SQL_HOST} AS host, {SQL_TIME} AS captured_at FROM pages),
hosts AS (SELECT DISTINCT host FROM rows),
parents AS (SELECT host, array_to_string(w[i:], '.') AS domain FROM (SELECT host, string_split(host, '.') AS w, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM hosts)),
found AS (SELECT DISTINCT r.host, captured_at, list, p.domain FROM rows r JOIN parents p USING (host) JOIN spans s ON s.domain = p.domain AND action = 'add' AND captured_at >= f AND (t IS NULL OR captured_at < t)),
verdict AS (SELECT host, captured_at, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max_by(domain, length(domain)) AS domain FROM found GROUP BY ALL)
SELECT page_id, url, host, captured_at, coalesce(lists, '') AS lists, coalesce(domain, '') AS domain, lists IS NOT NULL AS blocked
FROM rows LEFT JOIN verdict USING (host, captured_at)"""
