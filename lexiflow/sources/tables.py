"""Readers and writers of lexicon tables, catalogs and tagged corpora. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import seed

_PARADIGMS = "prefixes array<struct<language:string,negation:array<string>,debitive:array<string>,superlative:array<string>,verb:array<string>>>, paradigms array<struct<id:int,name:string,language:string,stems:int,lemma_ending_id:int,allowed_guess_endings:string,attributes:map<string,string>,endings:array<struct<id:int,ending:string,stem_change:int,stem_id:int,do_not_generate:boolean,attributes:map<string,string>>>>>"
_TAGSET = "attributes array<struct<lv:string,en:string,part_of_speech:string,markup_pos:int,values:array<struct<lv:string,en:string,tag:string,default_tags:string>>>>"


def lexemes(spark: SparkSession, path: str) -> DataFrame:
    """The lexeme table; row_ord keeps the file's order where order decides."""
    return spark.read.schema(seed.LEXEMES).parquet(path)


def write_lexemes(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def paradigms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paradigms, endings, prefixes) of a JSON catalog."""
    doc = spark.read.schema(_PARADIGMS).option("multiLine", True).json(path)
    p = doc.select(F.explode("paradigms").alias("p")).select("p.*")
    heads = p.select("language", F.col("id").alias("paradigm_id"), "name", "stems", "lemma_ending_id", "allowed_guess_endings", F.col("attributes").alias("attrs"))
    e = p.select("language", F.col("id").alias("paradigm_id"), F.explode("endings").alias("e"))
    ends = e.select("language", "paradigm_id", F.col("e.id").alias("ending_id"), F.coalesce("e.ending", F.lit("")).alias("ending"), F.coalesce("e.stem_change", F.lit(0)).alias("mija"), F.coalesce("e.stem_id", F.lit(1)).alias("stem_type"), F.coalesce("e.do_not_generate", F.lit(False)).alias("do_not_generate"), F.col("e.attributes").alias("attrs"))
    x = doc.select(F.explode("prefixes").alias("x"))
    kinds = [x.select("x.language", F.lit(k).alias("kind"), F.posexplode(f"x.{k}").alias("ord", "prefix")) for k in ("negation", "debitive", "superlative", "verb")]
    pre = reduce(DataFrame.unionByName, kinds).groupBy("language", "kind", "prefix").agg(F.min("ord").alias("ord"))
    return heads, ends, pre


def tagset(spark: SparkSession, path: str) -> DataFrame:
    a = spark.read.schema(_TAGSET).option("multiLine", True).json(path).select(F.explode("attributes").alias("a"))
    v = a.select(F.col("a.lv").alias("attr_lv"), F.col("a.en").alias("attr_en"), F.col("a.part_of_speech").alias("pos"), F.col("a.markup_pos").alias("markup_pos"), F.explode("a.values").alias("v"))
    return v.select("attr_lv", "attr_en", "pos", "markup_pos", F.col("v.lv").alias("value_lv"), F.col("v.en").alias("value_en"), F.col("v.tag").alias("tag"), F.col("v.default_tags").alias("default_tags"))


def statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ending frequencies, lexeme frequencies)."""
    d = spark.read.schema("ending_frequencies map<string,bigint>, lexeme_frequencies map<string,bigint>").option("multiLine", True).json(path)
    return d.select(F.explode("ending_frequencies").alias("ending_id", "n")).select(F.col("ending_id").cast("int"), "n"), d.select(F.explode("lexeme_frequencies").alias("lexeme_id", "n")).select(F.col("lexeme_id").cast("bigint"), "n")


def overrides(spark: SparkSession, path: str | None, schema: str = "key string, value string") -> DataFrame:
    """A JSON object of strings as rows; no path: no rows."""
    if path is None:
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def corpus(spark: SparkSession, path: str, sentences: bool = True) -> DataFrame:
    """doc (file), sent_id, pos, token, tag, lemma of a tab-separated corpus; <s> and </s> delimit sentences, other marks and blank lines
    are skipped. Only what stands in closed sentences counts, unless sentences is False."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), "value")
    order = Window.partitionBy("doc").orderBy("at", "line")
    opens, closes = F.sum((F.col("value") == "<s>").cast("int")).over(order), F.sum((F.col("value") == "</s>").cast("int")).over(order)
    rows = lines.withColumn("sent_id", opens).withColumn("closed", closes).withColumn("ends", F.max("closed").over(Window.partitionBy("doc")))
    parts = F.split("value", "\t")
    rows = rows.where((F.trim("value") != "") & ~F.col("value").rlike("^<[^\t]*$") & (F.size(parts) >= 3))
    if sentences:
        rows = rows.where("sent_id > closed AND sent_id <= ends")
    return rows.select("doc", "sent_id", (F.row_number().over(Window.partitionBy("doc", "sent_id").orderBy("at", "line")) - 1).alias("pos"), parts[0].alias("token"), parts[1].alias("tag"), parts[2].alias("lemma"))


def lexemes_from_jsonl(spark: SparkSession, path: str, source: str) -> DataFrame:
    return spark.read.schema(seed.LEXEMES).json(path).withColumn("source", F.lit(source))


def lexemes_from_xml(spark: SparkSession, path: str, source: str, row_tag: str = "Lexeme", language: str = "lv") -> DataFrame:
    """Lexemes of an XML file: ids and stems as attributes, further ones in an Attributes element."""
    schema = "_ID bigint, _lemma string, _stem1 string, _stem2 string, _stem3 string, _paradigm int, _paradigmName string, Attributes map<string,string>"
    x = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return x.select(F.col("_ID").alias("lexeme_id"), F.lit(None).cast("bigint").alias("entry_id"), F.lit(None).cast("string").alias("human_id"), F.col("_paradigm").alias("paradigm_id"), F.col("_paradigmName").alias("paradigm_name"), F.col("_lemma").alias("lemma"), F.col("_stem1").alias("stem1"), F.col("_stem2").alias("stem2"), F.col("_stem3").alias("stem3"), F.to_json("Attributes").alias("attributes_json"), F.lit(source).alias("source"), F.lit(language).alias("language"))


def united(parts: list[DataFrame], paradigms_: DataFrame) -> DataFrame:
    """Sources one below the other in order of priority (source_ord), paradigm names filled in by language and id."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)])
    names = paradigms_.select("language", "paradigm_id", F.col("name").alias("_name"))
    return rows.join(names, ["language", "paradigm_id"], "left").withColumn("paradigm_name", F.coalesce("paradigm_name", "_name")).drop("_name")


def counts(cat: seed.Catalog) -> DataFrame:
    """table, n of a catalog."""
    parts = [getattr(cat, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in ("lexemes", "paradigms", "endings", "prefixes", "tag_values")]
    return reduce(DataFrame.unionByName, parts)
