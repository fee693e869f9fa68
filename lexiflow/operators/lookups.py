"""Lookups in the lexical tables and the filters that callers of the analysis apply to its readings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bags
from .tokens import EXCEPTIONS, SIGNS


def lexemes_by_id(lexemes: DataFrame, ids: DataFrame) -> DataFrame:
    """The lexeme of each id (lexeme_id); of several rows of an id the first by entry and human id."""
    first = F.row_number().over(Window.partitionBy("lexeme_id").orderBy("entry_id", "human_id"))
    return lexemes.join(ids.select("lexeme_id").distinct(), "lexeme_id", "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")


def lexemes_by_lemma(lexemes: DataFrame, lemmas: DataFrame) -> DataFrame:
    """All lexemes of each lemma (lemma), case and all."""
    return lexemes.join(lemmas.select("lemma").distinct(), "lemma", "left_semi")


def lexemes_by_paradigm(lexemes: DataFrame, name: str) -> DataFrame:
    return lexemes.where(F.col("paradigm_name") == name)


def endings_with(endings: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Endings whose attributes match all that is wanted strongly."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & bags.strong(F.col("attrs"), k, F.lit(v))
    return endings.where(out)


def prefixes_for(prefixes: DataFrame, language: str, kind: str) -> DataFrame:
    """The prefixes of a kind, in order."""
    return prefixes.where((F.col("language") == language) & (F.col("kind") == kind)).orderBy("ord")


def attributes_for_pos(tag_values: DataFrame, pos: str) -> DataFrame:
    """attr_lv, markup_pos: the attributes that a part of speech has, by their place in the tag."""
    return tag_values.where(F.col("pos") == pos).groupBy("attr_lv").agg(F.min("markup_pos").alias("markup_pos")).orderBy("markup_pos")


def tag_values_of(asked: DataFrame, tag_values: DataFrame) -> DataFrame:
    """asked (attr_lv, value_lv) with tag: the first by part of speech and place."""
    first = tag_values.groupBy("attr_lv", "value_lv").agg(F.min(F.struct(F.coalesce("pos", F.lit("")).alias("pos"), "markup_pos", "tag")).alias("x"))
    return asked.join(first.select("attr_lv", "value_lv", "x.tag"), ["attr_lv", "value_lv"], "left")


def values_of_tags(asked: DataFrame, tag_values: DataFrame) -> DataFrame:
    """asked (attr_lv, tag) with value_lv: the first by part of speech and place."""
    first = tag_values.groupBy("attr_lv", "tag").agg(F.min(F.struct(F.coalesce("pos", F.lit("")).alias("pos"), "markup_pos", "value_lv")).alias("x"))
    return asked.join(first.select("attr_lv", "tag", "x.value_lv"), ["attr_lv", "tag"], "left")


def kept_whole(token: Column, exceptions: Iterable[str] = ()) -> Column:
    """Whether the tokenizer keeps the token whole as one of its exceptions, whatever its case."""
    return F.lower(token).isin(sorted({e.lower() for e in (*exceptions, *EXCEPTIONS, *SIGNS)}))


def without_proper(readings: DataFrame) -> DataFrame:
    """A token all in lower case doesn't ask for proper nouns."""
    proper = F.coalesce(bags.strong(F.col("attrs"), "Lietvārda tips", F.lit("Īpašvārds")), F.lit(False))
    return readings.where((F.col("token") != F.lower("token")) | ~proper)


def of_language(readings: DataFrame, language: str | None) -> DataFrame:
    """Readings of a language; 'lv' is all but Latgalian, and none at all is everything."""
    if not language:
        return readings
    own = F.coalesce("language", F.lit(""))
    return readings.where(own != "ltg" if language == "lv" else own == language)


def by_frequency(paradigms: DataFrame) -> DataFrame:
    """suitable_paradigms() with place: the most frequent lemma ending first, ties by paradigm."""
    return paradigms.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "paradigm_id")))


def tagging_accuracy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of rows (gold_lemma, gold_tag, lemma, tag) whose lemma, whatever its case, whose tag and whose part of speech are right; by
    groups, if named."""
    share = lambda ok: F.round(100 * F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 4)
    pos = lambda c: F.substring(c, 1, 1)
    parts = [F.count("*").alias("n"), share(F.lower("gold_lemma") == F.lower("lemma")).alias("lemma_percent"), share(F.col("gold_tag") == F.col("tag")).alias("tag_percent"), share(pos("gold_tag") == pos("tag")).alias("pos_percent")]
    return rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)


def over_seeds(accuracies: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, standard deviation, least and most of each column over the runs: metric, mean, stddev, low, high."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("x")
    return accuracies.select(each).groupBy("x.metric").agg(F.round(F.avg("x.v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("x.v"), F.lit(0.0)), 6).alias("stddev"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))


def extraction_counts(lexemes: DataFrame) -> DataFrame:
    """Of each source how many lexemes there are, and how many lack a paradigm, a first stem or attributes."""
    return lexemes.groupBy("source").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("paradigm_id").isNull(), 1)).alias("without_paradigm"),
        F.count(F.when(F.col("stem1").isNull(), 1)).alias("without_stem"), F.count(F.when(F.col("attributes_json").isNull(), 1)).alias("without_attributes"),
    )
