"""Trained disambiguation: multinomial logistic regression over hashed token features, for parts of speech or for the full tags of one.

A model is a table of weights (label, bucket, weight; bucket -1 is the intercept), which is stored as Parquet and never as code. Scoring
is a join with it and a log-softmax, so that SQL engines can do it too. Sequences are decided by the Viterbi fold, with the model's log
probabilities as emissions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import learning
from .viterbi import emission, viterbi

BUCKETS = 1 << 14
#: Rows that fit a model, about.
MAX_TRAIN = 20_000
#: Weights of a model, zeros among them, that travel with the plan: 16 MB.
DENSE = 2_000_000
WEIGHTS = "label string, bucket int, weight double"
_PLAIN = ("lower", "shape", "capital", "has_digit", "has_hyphen", "all_upper", *(f"{x}{n}" for x in ("pre", "suf") for n in range(1, 5)), "prev_lower", "prev_shape", "next_lower", "next_shape", "bos", "eos")


def buckets(features: DataFrame) -> DataFrame:
    """learning.features() with buckets: the distinct hashed features of each token."""
    named = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in _PLAIN])
    return features.withColumn("buckets", F.array_distinct(F.transform(F.array_compact(named), lambda f: F.pmod(F.xxhash64(f), F.lit(BUCKETS)).cast("int"))))


def train(rows: DataFrame, label: str, max_train: int = MAX_TRAIN, iterations: int = 40, ridge: float = 1e-4, least: int = 2) -> DataFrame:
    """The weights of a model of rows (buckets, label) with a label that occurs `least` times; fitted on about max_train of them, by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, StringIndexer

    spark = rows.sparkSession
    # through a generator: the filters below, pushed into the many columns that buckets are made of, would have the optimizer infer for minutes
    kept = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(F.array(F.struct("buckets"))).alias("_x"))
    known = kept.select("_x.buckets", "label", F.xxhash64("_x.buckets", "label").alias("_h"))
    often = known.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = often.agg(F.sum("n"), F.count("*"), F.min("label")).first()
    if not total[0]:
        return spark.createDataFrame([], WEIGHTS)
    if total[1] == 1:
        return spark.createDataFrame([(total[2], -1, 0.0)], WEIGHTS)
    share = int(2**30 * min(1.0, max_train / total[0]))
    # read by every step of the fit, but made once
    sample = cut(known.join(often, "label", "left_semi").where(F.pmod("_h", F.lit(2**30)) < share))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="words", outputCol="features")
    fit = vectors.transform(sample.select(F.col("buckets").cast("array<string>").alias("words"), "label"))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(fit)
    model = LogisticRegression(labelCol="y", family="multinomial", maxIter=iterations, regParam=ridge).fit(index.transform(fit))
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    out = [(name, -1, float(b[i])) for i, name in enumerate(index.labels)]
    out += [(name, int(j), float(w[i, j])) for i, name in enumerate(index.labels) for j in w[i].nonzero()[0]]
    return spark.createDataFrame(out, WEIGHTS)


def train_per_pos(rows: DataFrame, pos: str, tag: str, group_least: int = 200, **how) -> DataFrame:
    """pos and the weights of a model of the full tags of each part of speech that has enough rows, rare tags left out."""
    kept = learning.pruned(rows, pos, tag, group_least=group_least)
    out = rows.sparkSession.createDataFrame([], f"pos string, {WEIGHTS}")
    for r in kept.select(pos).distinct().orderBy(pos).collect():  # a row for each part of speech
        out = out.unionByName(train(kept.where(F.col(pos) == r[0]), tag, **how).withColumn("pos", F.lit(r[0])))
    return out


def log_proba(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, logp: the log probability of every label for each row (keys, buckets). With a column pos on both sides each row is scored by
    the model of its part of speech. A model of up to DENSE weights travels with the plan and rows are scored where they lie; a larger one is
    joined."""
    by = ["pos"] if "pos" in weights.columns and "pos" in rows.columns else []
    scored = _scored(rows, weights, by)
    if scored is None:
        return joined_log_proba(rows, weights, keys)
    return scored.select(*keys, "_names", "_norm", F.posexplode("_s").alias("_i", "_v")).select(*keys, F.get("_names", F.col("_i")).alias("label"), (F.col("_v") - F.col("_norm")).alias("logp"))


def _scored(rows: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame | None:
    """rows with _names (labels in order), _s (their scores) and _norm; none for a model too large to travel."""
    # a bound on what the driver gets; of a larger model one row more says so
    held = weights.select(*(F.col(c) for c in by), "label", "bucket", "weight").limit(DENSE + 1).collect()
    models: dict = {}
    for r in held:
        models.setdefault(r["pos"] if by else "", []).append(r)
    models = {k: rs for k, rs in models.items() if k is not None}
    if len(held) > DENSE or sum(_span(rs) for rs in models.values()) > DENSE:
        return None
    names, scores = F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>")
    for k, rs in models.items():
        own = _scores(rs)
        names, scores = (F.when(F.col("pos") == k, x).otherwise(y) if by else x for x, y in zip(own, (names, scores)))
    # columns of their own, each read twice by the next: so they are computed once
    rows = rows.withColumn("_s", scores).withColumn("_top", F.array_max("_s"))
    return rows.withColumn("_norm", F.col("_top") + F.log(F.aggregate("_s", F.lit(0.0), lambda z, x: z + F.exp(x - F.col("_top"))))).withColumn("_names", names)


def _span(rs: list) -> int:
    return (max([r["bucket"] for r in rs] + [-1]) + 1) * len({r["label"] for r in rs})


def _doubles(values: list[float]) -> Column:
    """A literal array: one constant of the plan, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _scores(rs: list) -> tuple[Column, Column]:
    """Labels in order and a row's scores of them; labels are those with an intercept, as in the join."""
    base = {r["label"]: float(r["weight"]) for r in rs if r["bucket"] < 0}
    most = max([r["bucket"] for r in rs] + [-1]) + 1
    table = {name: [0.0] * most for name in base}
    for r in rs:
        if r["bucket"] >= 0 and r["label"] in base:
            table[r["label"]][r["bucket"]] += r["weight"]

    def score(name: str) -> Column:
        own = F.aggregate("buckets", F.lit(base[name]), lambda s, b: s + F.coalesce(F.get(_doubles(table[name]), b), F.lit(0.0)))
        return F.coalesce(own, F.lit(base[name])) if most else F.lit(base[name])

    order = sorted(base)
    return F.array(*map(F.lit, order)).cast("array<string>"), F.array(*map(score, order)).cast("array<double>")


def joined_log_proba(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """log_proba() by joins, for models too large to travel."""
    by = ["pos"] if "pos" in weights.columns and "pos" in rows.columns else []
    # as one column, in which nulls equal each other
    rows = rows.withColumn("_k", F.struct(*keys))
    keys, asked = ["_k"], keys
    hit = rows.select(*keys, *[c for c in by if c not in keys], F.explode("buckets").alias("bucket"))
    sums = hit.join(weights.where("bucket >= 0"), ["bucket", *by]).groupBy(*keys, "label").agg(F.sum("weight").alias("s"))
    bases = weights.where("bucket < 0").select(*by, "label", F.col("weight").alias("base"))
    # a row for each label; labels without a weight at any of the row's features count by their base
    each = rows.select(*keys, *[c for c in by if c not in keys]).join(bases, by) if by else rows.select(*keys).crossJoin(bases)
    scores = each.join(sums, [*keys, "label"], "left").withColumn("score", F.col("base") + F.coalesce("s", F.lit(0.0)))
    top = scores.groupBy(*keys).agg(F.max("score").alias("top"))
    norm = scores.join(top, keys).groupBy(*keys).agg((F.max("top") + F.log(F.sum(F.exp(F.col("score") - F.col("top"))))).alias("norm"))
    return scores.join(norm, keys).select(*(F.col(f"_k.{c}") for c in asked), "label", (F.col("score") - F.col("norm")).alias("logp"))


def score_tags(asked: DataFrame, rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, tag) with logp, null where the model doesn't know the tag."""
    return asked.join(log_proba(rows, weights, keys).withColumnRenamed("label", "tag"), [*keys, "tag"], "left")


def best_labels(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, logp of the likeliest label of each row alone; of several the first by name."""
    scored = _scored(rows, weights, ["pos"] if "pos" in weights.columns and "pos" in rows.columns else [])
    if scored is not None:
        least = F.array_min(F.transform("_s", lambda v, i: F.struct((F.col("_norm") - v).alias("cost"), i.alias("i"))))
        rows = scored.select(*keys, "_names", F.explode(F.array_compact(F.array(least))).alias("_x"))
        return rows.select(*keys, F.get("_names", F.col("_x.i")).alias("label"), (-F.col("_x.cost")).alias("logp"))
    best = joined_log_proba(rows, weights, keys).groupBy(*keys).agg(F.min(F.struct((-F.col("logp")).alias("cost"), "label")).alias("x"))
    return best.select(*keys, "x.label", (-F.col("x.cost")).alias("logp"))


def label_sequences(rows: DataFrame, weights: DataFrame, transitions: DataFrame, weight: float = 1.0) -> DataFrame:
    """doc_id, sent_id, pos, label: the best sequence of labels of each sentence, by the model and the transitions (prev, cur, logp)."""
    keys = ["doc_id", "sent_id", "pos"]
    names = weights.where("bucket < 0").select("label").distinct()
    number = names.select("label", (F.row_number().over(_by_name()) - 1).cast("int").alias("cand_idx"))
    lattice = log_proba(rows, weights, keys).join(number, "label").select(*keys, "cand_idx", F.col("label").alias("state"), F.col("logp").alias("emission"))
    return viterbi(lattice, transitions, weight).join(number, "cand_idx").select(*keys, "label")


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("label")  # a row for each label


def rescored(candidates: DataFrame, tags: DataFrame, subtags: DataFrame, poses: DataFrame) -> DataFrame:
    """candidates (doc_id, sent_id, pos, cand_idx, tag) with emission: by the full-tag model (tags: ... tag, logp), else the predicted
    beginning (subtags: ... label), else the part of speech (poses: ... label)."""
    keys = ["doc_id", "sent_id", "pos"]
    rows = candidates.join(tags, [*keys, "tag"], "left").join(subtags.withColumnRenamed("label", "_sub"), keys, "left").join(poses.withColumnRenamed("label", "_pos"), keys, "left")
    score: Column = emission(F.col("tag"), F.col("logp"), F.coalesce("_sub", F.lit("")), F.coalesce("_pos", F.lit("")))
    return rows.withColumn("emission", score).drop("_sub", "_pos", "logp")


def saved(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
