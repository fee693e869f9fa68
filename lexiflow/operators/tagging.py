"""Tagging of running text: tokens, sentences, readings of the vocabulary, joint choice, overrides and agreement as one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import first_capital
from ..seed import Catalog, Settings
from ..session import cut
from . import candidates, generation
from . import tokens as tok
from .viterbi import viterbi

#: Characters of a tag that make the state of the sequence model.
STATE = 4


def _get(key: str):
    return F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(""))


def with_proper_nouns(occurrences: DataFrame) -> DataFrame:
    """occurrences (doc_id, sent_id, pos, first, token, cand_idx, attrs ...): a capitalised word within a sentence that has noun readings
    only, none of them a proper noun, gets its best reading as a proper noun, in front of the others."""
    by = Window.partitionBy("doc_id", "sent_id", "pos")
    nouns = F.min(F.when(_get("Vārdšķira") == "Lietvārds", 1).otherwise(0)).over(by) == 1
    named = F.max(F.when(_get("Lietvārda tips") == "Īpašvārds", 1).otherwise(0)).over(by) == 1
    rows = occurrences.withColumn("_ask", nouns & ~named & ~F.col("first") & first_capital(F.col("token")) & F.col("attrs").isNotNull())
    best = F.row_number().over(by.orderBy("rank")) == 1
    more = rows.withColumn("_best", best).where("_ask AND _best").drop("_best")
    extra = F.create_map(F.lit("Lietvārda tips"), F.lit("Īpašvārds"), F.lit("Pamatforma"), F.initcap("lemma"))
    made = more.withColumn("attrs", F.map_concat("attrs", extra)).withColumn("lemma", F.initcap("lemma")).withColumn("cand_idx", F.lit(-1)).withColumn("rank", F.lit(0))
    return rows.unionByName(made).drop("_ask")


def _coded(rows: DataFrame, cat: Catalog) -> DataFrame:
    """rows (attrs and others) with tag; each distinct bag is coded once."""
    kinds = rows.where("attrs IS NOT NULL").select(F.to_json("attrs").alias("id"), "attrs").dropDuplicates(["id"])
    coded = tags.to_tag(cut(kinds), cat.tag_values)
    return rows.withColumn("id", F.to_json("attrs")).join(coded, "id", "left").drop("id")


def best_of_tokens(readings: DataFrame, cat: Catalog) -> DataFrame:
    """token, first, lemma, attrs, tag: the best reading of each token at the beginning of a sentence and elsewhere."""
    places = readings.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = with_proper_nouns(places.select(F.lit(0).alias("doc_id"), F.col("first").cast("int").alias("sent_id"), F.col("token").alias("pos"), "first", "token", "cand_idx", "lemma", "attrs", "rank"))
    best = rows.groupBy("token", "first").agg(F.min_by(F.struct("lemma", "attrs"), "rank").alias("x")).select("token", "first", "x.lemma", "x.attrs")
    return cut(_coded(best, cat))


def promoted(chosen: DataFrame, all_: DataFrame, overrides: DataFrame, cat: Catalog) -> DataFrame:
    """chosen and all_ (doc_id, sent_id, pos, token, lemma, tag, attrs, cand_idx): where overrides (form, tag, lemma) name the token, the
    reading of that tag and lemma is taken, and made from the tag if there is none."""
    want = overrides.select(F.lower("form").alias("_low"), F.col("tag").alias("_tag"), F.col("lemma").alias("_lemma"))
    made = tags.from_tag(overrides.select(F.lower("form").alias("_low"), "tag").distinct(), cat.tag_values, "_low").withColumnRenamed("attrs", "_made")
    found = all_.withColumn("_low", F.lower("token")).join(want, "_low").where("tag = _tag AND lower(lemma) = lower(_lemma)").groupBy("doc_id", "sent_id", "pos").agg(F.min_by("attrs", "cand_idx").alias("_found"))
    rows = chosen.withColumn("_low", F.lower("token")).join(want, "_low", "left").join(made, "_low", "left").join(found, ["doc_id", "sent_id", "pos"], "left")
    new = F.col("_tag").isNotNull()
    return rows.select("doc_id", "sent_id", "pos", "token", F.when(new, F.col("_lemma")).otherwise(F.col("lemma")).alias("lemma"), F.when(new, F.col("_tag")).otherwise(F.col("tag")).alias("tag"), F.when(new, F.coalesce("_found", "_made")).otherwise(F.col("attrs")).alias("attrs"))


def in_sentences(docs: DataFrame, exceptions: Iterable[str] = (), asked: Iterable[str] = ()) -> DataFrame:
    """doc_id, pos, token, sent_id, first (of its sentence), ask (whether the sentence holds one of the tokens asked), found in a document's row."""
    rows = tok.token_arrays(docs, "doc_id", exceptions=exceptions)
    rows = rows.select("doc_id", "tokens", tok.sentence_numbers("tokens").alias("_s"))
    asked = list(asked)
    places = F.array_distinct(F.array_compact(F.transform("tokens", lambda t, i: F.when(t.isin(*asked), F.get("_s", i))))) if asked else F.array().cast("array<int>")
    rows = rows.withColumn("_asks", places)
    first = F.transform("_s", lambda s, i: (i == 0) | (s != F.get("_s", i - 1)))
    each = F.arrays_zip(F.col("tokens").alias("token"), F.col("_s").alias("sent_id"), first.alias("first"), F.transform("_s", lambda s: F.array_contains("_asks", s)).alias("ask"))
    return rows.select("doc_id", F.posexplode(each).alias("pos", "_x")).select("doc_id", "pos", "_x.*")


def best_tagged(docs: DataFrame, cat: Catalog, settings: Settings, exceptions: Iterable[str]) -> DataFrame:
    """tag() by the best-ranked readings: what is best depends on the token and whether it begins its sentence alone, so one row a token and
    place is joined to the text. Only sentences with a preposition need more than that; attributes are shuffled for no others."""
    readings = candidates.analyze(in_sentences(docs, exceptions).select("token").distinct(), cat, settings).select("token", "cand_idx", "lemma", "attrs", "rank")
    words = best_of_tokens(cut(readings), cat)
    # forms of the lexicon's prepositions that occur: few
    asked = sorted(r[0] for r in words.where(_get("Vārdšķira") == "Prievārds").select("token").distinct().collect())
    out = lambda rows: rows.join(words, ["token", "first"], "left").select("doc_id", "sent_id", "pos", "token", "lemma", F.coalesce("tag", F.lit("-")).alias("tag"), "attrs")
    if not asked:
        return out(in_sentences(docs, exceptions))
    # tokens may differ from the text by soft hyphens
    holds = F.lit(False)
    for w in asked:
        holds = holds | F.contains(F.replace("text", F.lit("\u00ad"), F.lit("")), F.lit(w))
    agreed = generation.prepositions_agree(out(in_sentences(docs.where(holds), exceptions, asked).where("ask")))
    return out(in_sentences(docs, exceptions, asked).where("NOT ask")).unionByName(agreed)


def tag(docs: DataFrame, cat: Catalog, settings: Settings = Settings(guessing=True), transitions: DataFrame | None = None, overrides: DataFrame | None = None, exceptions: Iterable[str] = (), keep_all: bool = False) -> DataFrame:
    """doc_id, sent_id, pos, token, lemma, tag, attrs of every token of docs (doc_id, text), null lemma and attrs and tag '-' where nothing is
    known; with keep_all every reading and its rank. Without transitions (prev, cur, logp of tag beginnings) the best-ranked reading is
    taken; with them the sentence is solved jointly. Each distinct token is analysed once."""
    if transitions is None and overrides is None and not keep_all:
        return best_tagged(docs, cat, settings, exceptions)
    sents = cut(in_sentences(docs, exceptions).drop("ask"))
    readings = candidates.analyze(sents.select("token").distinct(), cat, settings).select("token", "cand_idx", "lemma", "attrs", "rank")
    occ = cut(with_proper_nouns(sents.join(cut(readings), "token", "left")))
    occ = cut(_coded(occ.drop("first"), cat))
    columns = ["doc_id", "sent_id", "pos", "token", "lemma", F.coalesce("tag", F.lit("-")).alias("tag"), "attrs"]
    if keep_all:
        return occ.select(*columns, "rank")
    if transitions is None:
        best = occ.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "sent_id", "pos").orderBy("rank"))).where("_n = 1").drop("_n")
    else:
        start = sents.groupBy("doc_id", "sent_id").agg(F.min("pos").alias("_start"))
        known = occ.where("attrs IS NOT NULL").join(start, ["doc_id", "sent_id"])
        lattice = known.select("doc_id", "sent_id", (F.col("pos") - F.col("_start")).alias("pos"), "cand_idx", F.substring("tag", 1, STATE).alias("state"), (-F.log(F.col("rank") + 1.0)).alias("emission"))
        path = viterbi(lattice, transitions).withColumnRenamed("cand_idx", "_cand")
        path = path.join(start, ["doc_id", "sent_id"]).select("doc_id", "sent_id", (F.col("pos") + F.col("_start")).cast("int").alias("pos"), "_cand")
        best = occ.join(path, ["doc_id", "sent_id", "pos"], "left").where("attrs IS NULL OR cand_idx = _cand").drop("_cand")
    best = best.select(*columns, "cand_idx")
    if overrides is not None:
        best = promoted(best, occ, overrides, cat)
    return generation.prepositions_agree(best.select("doc_id", "sent_id", "pos", "token", "lemma", "tag", "attrs"))
