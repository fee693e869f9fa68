"""Operator 9: capture histories by an external merge of sorted runs.

Every input partition's captures are sorted by URL key, time and page into a run. Runs are cut at range boundaries and shuffled, which
keeps them on disk in order; the task of a range holds segments of all runs, splits them wherever their order breaks, and merges them
with a loser tree: its inner nodes keep the losers of matches, so that replacing the winner replays one path only. The winner gallops:
all its rows below the runner-up leave at once. Ranges are in order, so the concatenation of their outputs is the globally sorted
index. Positions and numbers within a history are made global with one small summary row a range.

Cost at scale. The only shuffle is the range partitioning of the index rows (digests, not pages, each computed once); ranges are cut
by key, time, page, URL and digest, so one URL's captures, however many, spread over ranges. There are as many ranges as keep each
about RANGE rows, whatever the table's size, so a task holds no more than that. Summaries of ranges are added up by windows, not on
the driver.

Defined results: a null URL has key '' (see _captures); nulls come first in the order, which goes on to URL and digest where
captures tie, so positions are sure but for rows equal in all of these. A null page body has a null digest and 0 characters.
Further columns of any name are ignored. An empty table gives an empty result.

records() reads captures from WARC files: 'response' and 'resource' records of plain or gzipped files (a member a record), HTTP headers
taken off; other kinds of records are passed over, and what follows a broken record in its file is lost.
"""

from __future__ import annotations

import bisect
import datetime
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._captures import SQL_KEY, SQL_TIME, captured_at, url_key
from ._spark import broadcast_if, cut, reach, table

#: Rows of a range, about: what a task merges.
RANGE = 200_000
_ORDER = ("url_key", "captured_at", "page_id", "url", "digest")


def merge(runs: list[list]) -> Iterator[tuple[int, int, int]]:
    """(run, start, end) stretches of sorted runs, in merged order; a tie goes to the earlier run."""
    runs_ = [r for r in enumerate(runs) if r[1]]
    k = len(runs_)
    if not k:
        return
    head = [0] * k

    def beats(a: int, b: int) -> bool:  # -1: an exhausted run
        if a < 0 or b < 0:
            return b < 0
        x, y = runs_[a][1][head[a]], runs_[b][1][head[b]]
        return x < y or (x == y and a < b)

    loser = [-1] * k  # node 0 has the winner
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    live = k
    while live:
        keys = runs_[top][1]
        # the runner-up is among the losers on the winner's path
        second, node = -1, (top + k) // 2
        while node:
            if beats(loser[node], second):
                second = loser[node]
            node //= 2
        if second < 0:
            end = len(keys)
        else:
            bound = runs_[second][1][head[second]]
            end = (bisect.bisect_right if top < second else bisect.bisect_left)(keys, bound, head[top])
        yield runs_[top][0], head[top], end
        head[top] = end
        node, now = (top + k) // 2, top
        if end == len(keys):
            now = -1
            live -= 1
        while node:
            if beats(loser[node], now):
                loser[node], now = now, loser[node]
            node //= 2
        top = now


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, list] = {}
    found = list(batches)
    if not found:
        return
    # long strings may exceed what 32-bit offsets reach
    kinds = pa.schema([f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in found[0].schema])
    whole = pa.Table.from_batches(found).cast(kinds).combine_chunks()
    columns = {c: whole[c].to_pylist() for c in ("run", *_ORDER)}
    segments: list[list[int]] = []
    keys: list[list[tuple]] = []
    for at, values in enumerate(zip(columns["run"], *(columns[c] for c in _ORDER))):
        key = tuple(x for v in values[1:] for x in ((v is not None), v if v is not None else 0))
        s = rows.get(values[0])
        if s is None or keys[s[0]][-1] > key:
            rows[values[0]] = s = [len(segments)]
            segments.append([])
            keys.append([])
        segments[s[0]].append(at)
        keys[s[0]].append(key)
    order: list[int] = []
    for run, start, end in merge(keys):
        order += segments[run][start:end]
    out = whole.take(pa.array(order, pa.int64())).drop_columns(["run"])
    last, number, local = object(), 0, []
    for i in order:
        number = number + 1 if columns["url_key"][i] == last else 1
        last = columns["url_key"][i]
        local.append(number)
    part = TaskContext.get().partitionId()
    out = out.append_column("place", pa.array(range(len(order)), pa.int64())).append_column("number", pa.array(local, pa.int64())).append_column("range", pa.array([part] * len(order), pa.int32()))
    for begin in range(0, out.num_rows, 8192):
        yield from pa.Table.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in out.slice(begin, 8192).combine_chunks().columns], names=out.column_names).to_batches()


def histories(captures: DataFrame) -> DataFrame:
    """position, url_key, captured_at, capture_no (within the URL's history), page_id, url, digest, chars: all rows of captures
    (page_id, url, html, captured_at), in the order of their positions."""
    spark = captures.sparkSession
    index = captures.select(url_key(F.col("url")).alias("url_key"), "captured_at", "page_id", "url", F.md5("html").alias("digest"), F.coalesce(F.length("html"), F.lit(0)).alias("chars"))
    index = cut(index)
    runs = index.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*_ORDER)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE))
    kinds = ", ".join(f"{c} {k}" for c, k in index.dtypes)
    merged = cut(runs.repartitionByRange(parts, *_ORDER).mapInArrow(_merged, f"{kinds}, place bigint, number bigint, range int"))
    ends = merged.groupBy("range").agg(F.count("*").alias("n"), F.min_by("url_key", "place").alias("first"), F.max_by("url_key", "place").alias("last"), F.max_by("number", "place").alias("tail"))
    # a row for each range; a history that goes on has all ranges that end in it right before
    along = Window.orderBy("range")
    told = F.sum("tail").over(Window.partitionBy("last").orderBy("range"))
    sums = ends.withColumn("told", told).withColumn("more", F.when(F.lag("last").over(along) == F.col("first"), F.lag("told").over(along)).otherwise(F.lit(0)))
    before = cut(sums.select("range", (F.sum("n").over(along) - F.col("n")).alias("before"), "first", "more"))
    out = merged.join(broadcast_if(before, parts), "range")
    number = F.col("number") + F.when(F.col("url_key") == F.col("first"), F.col("more")).otherwise(0)
    return out.select((F.col("before") + F.col("place") + 1).alias("position"), "url_key", "captured_at", number.alias("capture_no"), "page_id", "url", "digest", F.col("chars").cast("long").alias("chars"))


def _members(data: bytes) -> Iterator[bytes]:
    """The parts of a file that are compressed by themselves; a plain file is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            yield z.decompress(data)
        except zlib.error:
            return
        data = z.unused_data


def parsed(data: bytes) -> Iterator[tuple[str, datetime.datetime | None, str]]:
    """(URL, time, body) of the captures in a WARC file."""
    for member in _members(data):
        at = member.find(b"WARC/")
        while at >= 0:
            end = member.find(b"\r\n\r\n", at)
            if end < 0:
                return
            head = {}
            for line in member[at:end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
            size = head.get(b"content-length", "")
            if not size.isdigit() or end + 4 + int(size) > len(member):
                return
            body = member[end + 4 : end + 4 + int(size)]
            at = member.find(b"WARC/", end + 4 + int(size))
            kind = head.get(b"warc-type", "")
            if kind not in ("response", "resource"):
                continue
            if body.startswith(b"HTTP/"):
                body = body.partition(b"\r\n\r\n")[2]
            try:
                time = datetime.datetime.fromisoformat(head.get(b"warc-date", "")).replace(tzinfo=datetime.UTC)
            except ValueError:
                time = None
            yield head.get(b"warc-target-uri", "").strip("<>"), time, body.decode("utf-8", "replace")


def records(spark: SparkSession, path: str) -> DataFrame:
    """url, html, captured_at of the captures in WARC files, each read by one task; page_id is null."""
    reach(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parsed(content.as_py()))
                urls, times, bodies = (list(c) for c in zip(*rows)) if rows else ([], [], [])
                for at in range(0, len(rows), 512):
                    some = slice(at, at + 512)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(urls[some]), pa.int64()), pa.array(urls[some], pa.string()), pa.array(bodies[some], pa.string()), pa.array(times[some], pa.timestamp("us", "UTC"))], names=["page_id", "url", "html", "captured_at"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id bigint, url string, html string, captured_at timestamp")


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all pages."""
    return histories(table(spark, sf_dir, "pages").select("page_id", "url", "html", captured_at(F.col("page_id")).alias("captured_at")))


SQL = f"""
WITH c AS (SELECT {SQL_KEY} AS url_key, {SQL_TIME} AS captured_at, page_id, url, md5(html) AS digest, coalesce(length(html), 0)::BIGINT AS chars FROM pages)
SELECT row_number() OVER w AS position, url_key, captured_at, row_number() OVER (PARTITION BY url_key ORDER BY captured_at NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST) AS capture_no, page_id, url, digest, chars
FROM c WINDOW w AS (ORDER BY url_key, captured_at NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST)"""
