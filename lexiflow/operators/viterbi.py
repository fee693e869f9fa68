"""Joint choice of the readings of a sentence: emission tiers, beam and a Viterbi fold over the sentence's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT, BEAM, FLOOR = 0.08, 8, -10.0


def emission(tag: Column, logp: Column, subtag: Column, pos: Column) -> Column:
    """Score of a candidate tag: the model's where it knows the tag, else by the predicted first characters, else by the part of
    speech, else out of the question."""
    return (
        F.when(logp.isNotNull(), logp)
        .when((F.length(subtag) > 0) & F.startswith(tag, subtag), F.lit(-10.0) + 0.1 * F.length(subtag))
        .when(F.substring(tag, 1, 1) == pos, -100.0)
        .otherwise(-1000.0)
    )


def beam(candidates: DataFrame, keys: list[str], most: int = BEAM) -> DataFrame:
    """The best candidates of a token by emission, of several the first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("emission"), "cand_idx")
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def most_frequent(ordered: str, most: int = BEAM) -> Column:
    """beam() of the counts of an ordered array column: array of token and n, the most frequent first, of several the first in order."""
    w = F.col(ordered)
    starts = F.array_compact(F.transform(w, lambda t, i: F.when((i == 0) | (F.get(w, i - 1) != t), i)))
    counted = lambda at: F.transform(
        at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(w))).cast("bigint").alias("less"), F.get(w, i).alias("token"))
    )
    best = F.slice(F.array_sort(F.get(F.transform(F.array(starts), counted), F.lit(0))), 1, most)
    return F.transform(best, lambda x: F.struct(x["token"].alias("token"), (-x["less"]).alias("n")))


def viterbi(candidates: DataFrame, transitions: DataFrame, weight: float = WEIGHT, most: int = BEAM) -> DataFrame:
    """doc_id, sent_id, pos, cand_idx of the best path through candidates (doc_id, sent_id, pos, cand_idx, state, emission).

    A sentence is one row with an array of its tokens' candidates; the fold keeps, for each candidate of the last token, the
    best score and path that end in it. A token without candidates breaks the chain, and each stretch is solved alone; the bonus of
    '<s>' is given at the start of the sentence only. Ties go to the earlier candidate.
    """
    kept = beam(candidates, ["doc_id", "sent_id", "pos"], most)
    # the transitions travel as one map: states are tag beginnings, of which there are few thousands
    table = transitions.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "prev", "cur"), "logp"))).alias("t"))
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    by_token = kept.groupBy("doc_id", "sent_id", "pos").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "state", "emission"))).alias("c"))
    gap = F.coalesce((F.col("pos") - F.lag("pos").over(order)) != 1, F.lit(False))
    runs = by_token.withColumn("run", F.sum(gap.cast("int")).over(order)).groupBy("doc_id", "sent_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("s"))

    def chance(prev: Column, cur: Column) -> Column:
        t = F.col("t")
        return F.coalesce(F.try_element_at(t, F.concat_ws("\t", prev, cur)), F.try_element_at(t, F.concat_ws("\t", F.lit("<DEFAULT>"), cur)), F.lit(FLOOR))

    start = F.transform(
        F.get(F.col("s"), F.lit(0))["c"],
        lambda c: F.struct(
            (c["emission"] + F.when((F.col("run") == 0) & (F.get(F.col("s"), F.lit(0))["pos"] == 0), weight * chance(F.lit("<s>"), c["state"])).otherwise(0.0)).alias("score"),
            c["state"].alias("state"),
            F.array(F.struct(F.get(F.col("s"), F.lit(0))["pos"].alias("pos"), c["cand_idx"].alias("cand_idx"))).alias("path"),
        ),
    )

    def step(acc: Column, token: Column) -> Column:
        def best(c: Column) -> Column:
            tried = F.transform(acc, lambda p, i: F.struct((p["score"] + weight * chance(p["state"], c["state"])).alias("v"), (-i).alias("i")))
            top = F.array_max(tried)
            return F.struct(
                (top["v"] + c["emission"]).alias("score"),
                c["state"].alias("state"),
                F.concat(F.get(acc, -top["i"])["path"], F.array(F.struct(token["pos"].alias("pos"), c["cand_idx"].alias("cand_idx")))).alias("path"),
            )

        return F.transform(token["c"], best)

    fold = F.aggregate(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), start, step)
    end = F.array_max(F.transform(F.col("f"), lambda p, i: F.struct(p["score"].alias("v"), (-i).alias("i"))))
    solved = runs.crossJoin(F.broadcast(table)).withColumn("f", fold).withColumn("path", F.get(F.col("f"), -end["i"])["path"])
    return solved.select("doc_id", "sent_id", F.explode("path").alias("p")).select("doc_id", "sent_id", "p.pos", "p.cand_idx")
