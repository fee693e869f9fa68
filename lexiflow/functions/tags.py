"""Positional tags: encoding bags, decoding tags, and translating bags. The tagset enters as rows (tag_values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import seed


def to_tag(bags: DataFrame, tag_values: DataFrame, key: str = "id", bag: str = "attrs") -> DataFrame:
    """key, tag. A position is set by its attribute's value; the rest come from the part of speech's default characters, then from
    the usual fillings; a value beyond the end pads with '_'. A participle has a layout of its own. No known part of speech: '-'."""
    rows = bags.select(key, bag).withColumn("pos", F.try_element_at(bag, F.lit("Vārdšķira")))
    heads = tag_values.where("attr_lv = 'Vārdšķira'").select(F.col("value_lv").alias("pos"), F.coalesce("default_tags", "tag").alias("base"))
    layout = F.when((F.col("pos") == "Darbības vārds") & (F.try_element_at(bag, F.lit("Izteiksme")) == "Divdabis"), "Divdabis").otherwise(F.col("pos"))
    rows = rows.join(heads, "pos", "left").withColumn("layout", layout)
    attr, val = F.col("k"), F.col("v")
    for a, b in seed.ATTR_ALIASES.items():
        attr = F.when(attr == a, b).otherwise(attr)
    for (a, old), new in seed.VALUE_ALIASES.items():
        val = F.when((F.col("k") == a) & (F.col("v") == old), new).otherwise(val)
    flat = rows.where("base IS NOT NULL").select(key, "layout", F.explode(bag).alias("k", "v")).select(key, "layout", attr.alias("attr_lv"), val.alias("value_lv"))
    values = tag_values.where("markup_pos IS NOT NULL AND attr_lv <> 'Vārdšķira' AND tag IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("attr_lv", "pos", "value_lv").orderBy("tag"))).where("_n = 1")
    values = values.select("attr_lv", "value_lv", F.col("pos").alias("scope"), "markup_pos", "tag")
    chars = flat.join(values, ["attr_lv", "value_lv"]).where("scope IS NULL OR scope = layout")
    # a position goes to the attribute of the layout itself before one of all layouts
    chars = chars.groupBy(key, "markup_pos").agg(F.min_by("tag", F.struct(F.col("scope").isNull().alias("all"), "attr_lv")).alias("ch"))
    placed = chars.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("markup_pos", "ch"))).alias("chars"))
    out = rows.join(placed, key, "left").withColumn("chars", F.coalesce("chars", F.create_map().cast("map<int,string>")))
    size = F.greatest(F.length("base"), F.coalesce(F.array_max(F.map_keys("chars")) + 1, F.lit(0)))
    default = F.lit(None).cast("map<int,string>")
    for pos, fill in seed.DEFAULTS.items():
        default = F.when(F.col("pos") == pos, F.create_map(*[F.lit(x) for kv in fill.items() for x in kv])).otherwise(default)
    out = out.withColumn("fill", default).withColumn("size", size)
    at = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("chars", i), F.nullif(F.call_function("substring", F.col("base"), i + 1, F.lit(1)), F.lit("")), F.lit("_")))
    # only positions that the tag has anyway are filled
    filled = F.transform(at, lambda c, i: F.when(c == "_", F.coalesce(F.try_element_at("fill", i), c)).otherwise(c))
    return out.select(key, F.when(F.col("base").isNull(), "-").otherwise(F.array_join(filled, "")).alias("tag"))


def from_tag(tags: DataFrame, tag_values: DataFrame, key: str = "id") -> DataFrame:
    """key, attrs of tags (key, tag): the part of speech by the first character, each of its attributes by position."""
    heads = tag_values.where("attr_lv = 'Vārdšķira'").groupBy(F.col("tag").alias("ch")).agg(F.min("value_lv").alias("pos"))
    rows = tags.select(key, "tag").withColumn("ch", F.substring("tag", 1, 1)).join(heads, "ch", "left")
    values = tag_values.where("attr_lv <> 'Vārdšķira' AND markup_pos IS NOT NULL").groupBy("attr_lv", F.col("pos").alias("scope"), "markup_pos", F.col("tag").alias("vch")).agg(F.min("value_lv").alias("value_lv"))
    at = F.expr("substring(tag, markup_pos + 1, 1)")
    found = rows.join(values, (F.col("scope") == F.col("pos")) & (F.col("vch") == at) & ~at.isin("_", "-"))
    got = found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr_lv", "value_lv")))).alias("more"))
    none = F.create_map().cast("map<string,string>")
    own = F.when(F.col("pos").isNull(), none).otherwise(F.create_map(F.lit("Vārdšķira"), F.col("pos")))
    return rows.join(got, key, "left").select(key, F.map_concat(own, F.when(F.col("pos").isNull(), none).otherwise(F.coalesce("more", none))).alias("attrs"))


def translated(bags: DataFrame, tag_values: DataFrame, key: str = "id", bag: str = "attrs") -> DataFrame:
    """key, attrs with names and values in English where the tagset has them."""
    names = tag_values.groupBy("attr_lv").agg(F.min("attr_en").alias("attr_en"))
    values = tag_values.groupBy("attr_lv", "value_lv").agg(F.min("value_en").alias("value_en"))
    flat = bags.select(key, F.explode_outer(bag).alias("attr_lv", "value_lv")).join(names, "attr_lv", "left").join(values, ["attr_lv", "value_lv"], "left")
    entry = F.when(F.col("attr_lv").isNotNull(), F.struct(F.coalesce("attr_en", "attr_lv").alias("k"), F.coalesce("value_en", "value_lv").alias("v")))
    return flat.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("attrs"))
