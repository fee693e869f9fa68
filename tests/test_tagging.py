import pytest

from lexiflow import api, seed
from lexiflow.operators import tagging, tokens


@pytest.fixture(scope="module")
def docs(spark):
    api.configure(spark)
    return spark.createDataFrame([(1, "Tēvu un mājas. Es redzu Tēvu 12. zzz"), (2, ""), (3, None)], "doc_id bigint, text string")


def test_tag(spark, docs):
    cat = api.catalog(spark)
    got = {(r.sent_id, r.token): r for r in api.tag(docs, cat, api.Settings()).collect()}
    assert len(got) == 9
    assert got[(0, "un")].tag[0] == "c" and got[(0, "Tēvu")].tag == "ncmpg1"
    assert got[(1, "Tēvu")].tag == "npmpg1" and got[(1, "Tēvu")].lemma == "Tēvs"
    assert got[(1, "zzz")].tag == "-" and got[(1, "zzz")].lemma is None


def test_tag_jointly_and_with_overrides(spark, docs):
    cat = api.catalog(spark)
    # an accusative is far likelier at a beginning
    t = spark.createDataFrame([("<s>", "ncms", 0.0), ("<s>", "ncmp", -900.0)], "prev string, cur string, logp double")
    o = spark.createDataFrame([("zzz", "ncfsn4", "zzza")], "form string, tag string, lemma string")
    got = {(r.sent_id, r.token): r for r in api.tag(docs, cat, api.Settings(), t, o).collect()}
    assert len(got) == 9 and got[(0, "Tēvu")].tag == "ncmsa1"
    assert got[(1, "zzz")].lemma == "zzza" and got[(1, "zzz")].attrs["Dzimte"] == "Sieviešu"


def test_attributes_of_few_sentences_are_shuffled(spark):
    """Tokens are joined by their words; only sentences with a preposition pass a window, and agree there."""
    docs = spark.createDataFrame([(1, "Tēvs rok. Uz mežiem iet tēvs. Mežs zaļo."), (2, "uz­z uz tēviem"), (3, None), (4, "Kruz tēvi.")], "doc_id bigint, text string")
    cat = seed.catalog(spark)
    got = tagging.tag(docs, cat)
    rows = {(r.doc_id, r.pos): r for r in got.collect()}
    assert len(rows) == sum(1 for _ in tokens.tokens(docs).collect())
    assert sorted(k for k, r in rows.items() if r.attrs and r.attrs.get("Rekcija") == "Datīvs") == [(1, 3), (2, 1)]
    plan = tagging.tag(docs.where("doc_id = 4"), cat)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
