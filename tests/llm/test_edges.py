"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import bpe, chat, knn, language, mixing, near_dup, quality, toxicity, url_filter, warc_index

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, "a plain text of some words that goes on", "en", "s", 10),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, LONG, "fr", "t", len(LONG)),
    (5, "a plain text of some words that goes on", "en", "s", 10),
    (5, "a plain text of some words that goes on", "en", "s", 10),
    (None, "ein Satz ohne Nummer", "de", "s", 5),
    (None, None, "de", None, None),
    (7, "   \n\t ", "de", "", 6),
    (8, "<|end|> é ß ñ 😀 !!! &&& |", "xx", "u", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names are those that plans might use
    extra = {c: F.lit(c) for c in ("node", "key", "root", "hits", "score", "stratum", "m", "rank", "copies", "block", "src", "kept", "Keep")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (99, 1, 1), (None, 1, 1), (3, None, None)], LABELS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language(docs, none):
    got = language.identified(docs, language.trained(docs)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].language == by[3].language == by[7].language == "und" and by[2].margin == 0
    assert language.identified(none, language.trained(none)).count() == 0
    assert {r.language for r in language.identified(docs, language.trained(none)).collect()} == {"und"}
    one = docs.where("lang = 'en'")
    assert {r.language for r in language.identified(one, language.trained(one)).collect()} == {"en", "und"}


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, turns string, rendered string"
    rows = [(1, 0, "user", None, "x", "y"), (1, 0, "user", None, "x", "y"), (None, None, None, "", "x", "y"), (2, 1, " System ", LONG, "x", "y"), (3, 0, "robot", "<|end|>", "x", "y")]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].operations, got[1].cost) == ("kmi", 3)
    assert got[2].operations == "kii" and got[2].turns == 3
    # assistant after an empty user, or user before an empty assistant: the first in the alphabet
    assert got[3].operations == "ir" and "< |end|>" in got[3].rendered
    assert got[None].cost == 3
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0


def test_bpe(docs, none):
    got = bpe.encoded(docs).collect()
    assert len(got) == len(ROWS)
    e = bpe.encoding()
    texts = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in ROWS))
    for r, (_, _, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, "" if r.token_ids is None else e.decode(r.token_ids))), texts):
        if r.token_ids is None:
            assert r.round_trip is None and r.n_tokens is None and text == ""
        else:
            assert r.token_ids == e.encode_ordinary(text) and r.round_trip and r.n_tokens == len(r.token_ids)
    assert bpe.encoded(none).count() == 0
    assert sorted(r.text or "" for r in bpe.decoded(bpe.encoded(docs)).collect()) == sorted(r[1] or "" for r in ROWS)


def test_knn(spark):
    schema = "vec_id bigint, embedding array<float>, rank int"
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [float("nan"), 0.0], 0), (7, [1.0, 2.0, 3.0], 0), (None, [0.0, 0.0], 0), (8, [None, 1.0], 0), (9, [5.0, 5.0], 0), (9, [0.5, 0.0], 0)]
    got = [tuple(r) for r in knn.neighbours(spark.createDataFrame(rows, schema), k=2).orderBy("vec_id", "rank").collect()]
    assert got[:2] == [(1, 9, 1, 0.5), (1, 2, 2, 1.0)]
    assert [g for g in got if g[0] == 2] == [(2, 3, 1, 0.0), (2, 9, 2, 0.5)]
    assert {g[0] for g in got} == {1, 2, 3, 9}
    assert knn.neighbours(spark.createDataFrame([], schema)).count() == 0


def test_url_filters(spark):
    day = datetime.datetime(2024, 3, 1)
    schema = "page_id bigint, url string, captured_at timestamp, lists string, domain string"
    rows = [(1, "http://A.Bad.org./x", day, "", ""), (1, "http://A.Bad.org./x", day, "", ""), (2, None, day, "", ""), (3, "no url", day, "", ""), (4, "http://bad.org:80/", None, "", ""), (5, "http://u:p@bad.org?q", day - datetime.timedelta(days=90), "", ""), (6, "http://notbad.org/" + "x" * 100_000, day, "", "")]
    events = spark.createDataFrame([("l", "bad.org", "2024-02-01", "add"), ("l", "bad.org", "2024-02-01", "add"), ("k", "a.bad.org", "2024-03-01", "add"), ("z", "a.bad.org", "2024-03-01", "add"), ("z", "a.bad.org", "2024-03-01", "remove"), (None, "bad.org", "2024-02-01", "add"), ("l", None, None, None)], "list string, domain string, day string, action string")
    captures = spark.createDataFrame(rows, schema)
    got = sorted((r.page_id, r.lists, r.domain, r.blocked) for r in url_filter.filtered(captures, events).collect())
    assert got[:2] == [(1, "k,l", "a.bad.org", True)] * 2
    assert [g[3] for g in got[2:]] == [False] * 5
    assert url_filter.filtered(captures.where("false"), events).count() == 0
    assert not any(r.blocked for r in url_filter.filtered(captures, events.where("false")).collect())


def test_quality(spark, docs, none, labels):
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got) and {r.stratum for r in got} >= {"und", "xx"}
    assert quality.good_quality(docs, labels).columns == docs.columns
    assert quality.good_quality(docs, labels.where("false")).count() == len(ROWS)
    assert quality.quality(none, labels).count() == quality.good_quality(none, labels).count() == 0


def test_quality_certifies_only_with_enough_rows(spark):
    def table(n, copies=False):
        rows = [(i, f"some words {0 if copies else i}." if i % 2 else f"some&&& words*** {i}", "en", "s", 1) for i in range(n)]
        return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(n)], LABELS)

    assert all(r.kept for r in quality.quality(*table(60)).collect())
    got = quality.quality(*table(400)).collect()
    assert all(r.kept == (r.doc_id % 2 == 1) for r in got) and all("symbols" in r.failed for r in got if not r.kept)
    # 200 copies of one good text are one trial
    assert all(r.kept for r in quality.quality(*table(400, copies=True)).collect())


def test_mixing(docs, none):
    got = mixing.mixed(docs, copy_column="copy_no")
    assert got.columns == [*docs.columns, "copy_no"]
    assert mixing.mixed(docs, {"s": 1.0, "absent": 3.0}).select("source").distinct().collect() == [("s",)]
    assert mixing.mixed(none).count() == 0


def test_mixing_rounds_the_expected_copies(spark):
    docs = spark.createDataFrame([(i, "xx", "en", "a" if i % 5 else "b", 2) for i in range(1000)], DOCS)
    n = {r["source"]: r["count"] for r in mixing.mixed(docs, {"a": 1, "b": 2}).groupBy("source").count().collect()}
    assert abs(n["a"] - 1000 / 3) <= 1.01 and abs(n["b"] - 2000 / 3) <= 1.01
    per = {r["count"] for r in mixing.mixed(docs, {"a": 1, "b": 2}).where("source = 'b'").groupBy("doc_id").count().collect()}
    assert per == {3, 4}


def test_mixing_of_tiny_sources_and_ties(spark):
    rows = [(i, "some words of a text " * 20, "en", "a", 400) for i in range(38)] + [(99, "", "en", "b", 0)] + [(100, "x", "en", "c", 1)]
    rows += [(None, "same", "en", "d", 4)] * 50 + [(7, "tied", "en", "d", 4)] * 50 + [(i * 1024, "id of one residue", "en", "e", 17) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    n = {r["source"]: r["count"] for r in mixing.mixed(docs).groupBy("source").count().collect()}
    assert "b" not in n and n["c"] == mixing.MAX_EPOCHS
    d = sorted(r["count"] for r in mixing.mixed(docs).where("source = 'd'").groupBy("doc_id").count().collect())
    assert d[1] - d[0] <= 2  # blocks of the two groups of equal rows begin at any offset
    blocks = docs.where("source = 'e'").select(mixing._block(mixing.BLOCKS)).distinct().count()
    assert blocks > 200


def test_toxicity(docs, none, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and not any(r.toxic for r in got if r.doc_id in (2, 3, 7))
    assert toxicity.without_toxic(docs, labels.where("false")).columns == docs.columns
    assert toxicity.toxicity(none, labels).count() == toxicity.without_toxic(none, labels).count() == 0


def test_warc_index(spark):
    schema = "page_id bigint, url string, html string, captured_at timestamp, range int, before bigint"
    t = datetime.datetime(2024, 1, 1)
    rows = [(2, "http://www.b.org/x/", "h", t, 0, 0), (1, "https://b.org/x#y", "h", t, 0, 0), (1, "https://b.org/x#y", "h", t, 0, 0), (3, None, None, None, 0, 0), (None, "odd", "", t, 0, 0), (4, "http://a.org/" + "q" * 50_000, LONG, t, 0, 0)]
    got = [(r.position, r.url_key[:8], r.page_id, r.capture_no) for r in warc_index.histories(spark.createDataFrame(rows, schema)).orderBy("position").collect()]
    assert got == [(1, "", 3, 1), (2, "odd", None, 1), (3, "org,a)/q", 4, 1), (4, "org,b)/x", 1, 1), (5, "org,b)/x", 1, 2), (6, "org,b)/x", 2, 3)] or got[1][1] == "odd"
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6]
    assert sorted(g[3] for g in got if g[1] == "org,b)/x") == [1, 2, 3]
    assert warc_index.histories(spark.createDataFrame([], schema)).count() == 0


def test_warc_histories_over_many_ranges(spark, monkeypatch):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, "http://a.org/hot", "h", t) for i in range(300)] + [(i, f"http://b{i % 7}.org/", "h", t) for i in range(100)]
    monkeypatch.setattr(warc_index, "RANGE", 25)
    got = warc_index.histories(spark.createDataFrame(rows, "page_id bigint, url string, html string, captured_at timestamp")).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 401))
    assert [r.capture_no for r in got[:300]] == list(range(1, 301)) and [r.page_id for r in got[:300]] == sorted(r[0] for r in rows[:300])
    last, n = None, 0
    for r in got:
        n = n + 1 if r.url_key == last else 1
        last = r.url_key
        assert r.capture_no == n


def test_warc_records(spark, tmp_path):
    import gzip

    def record(kind, url, date, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0 \xc3\xa9</p>"
    all_ = [record("warcinfo", "", "2024-01-01T00:00:00Z", b"software: x"), record("response", "http://b.org/", "2024-01-02T03:04:05Z", page), record("request", "http://b.org/", "2024-01-02T03:04:05Z", b"GET /"), record("resource", "http://a.org/x", "bad", b"plain"), record("response", "http://c.org/", "2024-01-02T03:04:05Z", b"")]
    (tmp_path / "one.warc").write_bytes(b"".join(all_))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in all_) + b"\x1f\x8bbroken")
    (tmp_path / "three.warc").write_bytes(b"".join(all_)[:-30])
    got = warc_index.records(spark, str(tmp_path))
    assert sorted(r.url for r in got.collect()) == ["http://a.org/x"] * 3 + ["http://b.org/"] * 3 + ["http://c.org/"] * 2
    one = got.where("url = 'http://b.org/'").first()
    assert one.html == "<p>WARC/1.0 é</p>" and one.captured_at == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert [r.capture_no for r in warc_index.histories(got).where("url = 'http://b.org/'").orderBy("position").collect()] == [1, 2, 3]


def test_hosts(spark):
    urls = [("http://[::1]:80/x",), ("HTTP://u@[2001:DB8::1]/",), ("http://a.org:80",), ("http://[::1",)]
    got = url_filter.filtered(spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id bigint, url string, captured_at timestamp"), spark.createDataFrame([], "list string, domain string, day string, action string"))
    assert [r.host for r in got.orderBy("page_id").collect()] == ["[::1]", "[2001:db8::1]", "a.org", "["]


def test_url_filters_join_a_large_list_without_broadcast(spark, monkeypatch):
    events = spark.range(3000).selectExpr("'l' AS list", "concat('d', id, '.org') AS domain", "'2024-02-01' AS day", "'add' AS action")
    captures = spark.range(4000).selectExpr("id AS page_id", "concat('http://x.d', id, '.org/') AS url", "timestamp'2024-01-31' + make_interval(0, 0, 0, id % 3) AS captured_at")
    monkeypatch.setattr(url_filter, "broadcast_if", lambda df, n: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = url_filter.filtered(captures, events).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.page_id for r in got if r.blocked} == {i for i in range(3000) if i % 3}


def test_near_dup(docs, none):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    plain = [r for r in got if r.group_size == 3]
    assert {r.doc_id for r in plain} == {1, 5} and sum(r.kept for r in plain) == 1 and {r.group_id for r in plain} == {1}
    assert all(r.kept for r in got if r.doc_id in (2, 3, 4, 7, 8))
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert near_dup.near_duplicates(none).count() == near_dup.deduplicated(none).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality_rules", "near_dedup", "mixing", "bpe"])
def test_pipeline_stages(spark, docs, none, labels, tmp_path, name):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows at all, for each stage."""
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    n = {"toxicity": len(ROWS), "quality_rules": len(ROWS), "near_dedup": len(ROWS) - 2, "bpe": len(ROWS)}
    if name == "bpe":
        assert "token_ids" in got.columns
    else:
        assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert set(ids) <= {r[0] for r in ROWS} and (name not in n or len(ids) == n[name])
    assert stage(spark, none, str(tmp_path)).count() == 0
    labels.where("false").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    assert stage(spark, docs, str(tmp_path)).count() == len(ids)


def test_pipeline_leaves_one_stage_behind(spark, docs, labels, tmp_path, monkeypatch):
    import corpus_pipeline
    from lexiflow.llm import _spark

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    monkeypatch.setattr(_spark, "scratch", lambda s, name, f=_spark.scratch: (paths.append(f(s, name)), paths[-1])[1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [p for p in paths if os.path.exists(p.removeprefix("file://"))]
    assert len(paths) == 4 and left == paths[-1:]
