"""Tables learned from tagged tokens, token features, and evaluation. Every choice among ties names its order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shape, shapes
from ..session import cut


def affixes(token: Column, most: int = 4) -> list[Column]:
    """pre1.. and suf1..: beginnings and endings, null where the token is shorter."""
    low = F.lower(token)
    pre = [F.when(F.length(token) >= n, F.substring(low, 1, n)).alias(f"pre{n}") for n in range(1, most + 1)]
    suf = [F.when(F.length(token) >= n, F.substring(low, -n, n)).alias(f"suf{n}") for n in range(1, most + 1)]
    return [*pre, *suf]


_NEAR = ("prev_lower", "prev_shape", "next_lower", "next_shape", "bos", "eos")


def features(toks: DataFrame) -> DataFrame:
    """Per token: lower case, shape, flags, affixes, and lower case and shape of its neighbours within the sentence."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    low, form = F.lower("token"), shape(F.col("token"))
    near = (F.lag(low).over(order), F.lag(form).over(order), F.lead(low).over(order), F.lead(form).over(order), F.lag("pos").over(order).isNull(), F.lead("pos").over(order).isNull())
    return _with_own(toks.select("doc_id", "sent_id", "pos", "token", low.alias("lower"), form.alias("shape"), *(x.alias(c) for x, c in zip(near, _NEAR))), "doc_id", "sent_id")


def _with_own(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(
        *keep, "pos", "token", "lower", "shape",
        F.col("token").rlike(r"^\p{Lu}").alias("capital"), F.col("token").rlike(r"\p{N}").alias("has_digit"), F.col("token").contains("-").alias("has_hyphen"),
        (F.upper("token") == F.col("token")).alias("all_upper"), *affixes(F.col("token")), *_NEAR,
    )


def array_features(rows: DataFrame, *keep: str) -> DataFrame:
    """features() of rows with tokens, each row one sentence: keep, pos and the features. Tokens hold no line breaks, so all of a row are
    written in lower case and shaped at once, as lines."""
    lines = rows.where("size(tokens) > 0").select(*keep, "tokens", F.array_join("tokens", "\n").alias("_lines"))
    split = lines.select(*keep, "tokens", F.split(F.lower("_lines"), "\n").alias("_low"), F.split(shapes(F.col("_lines")), "\n").alias("_form"))
    before = lambda c: F.concat(F.array(F.lit(None).cast("string")), F.slice(c, 1, F.size(c) - 1))
    after = lambda c: F.slice(c, 2, F.size(c))  # noqa: E731  one short: filled with null
    each = F.arrays_zip(F.col("tokens").alias("token"), F.col("_low").alias("lower"), F.col("_form").alias("shape"), before(F.col("_low")).alias("prev_lower"), before(F.col("_form")).alias("prev_shape"), after(F.col("_low")).alias("next_lower"), after(F.col("_form")).alias("next_shape"))
    out = split.select(*keep, F.size("tokens").alias("_n"), F.posexplode(each).alias("pos", "_x")).select(*keep, "pos", "_x.*", (F.col("pos") == 0).alias("bos"), (F.col("pos") == F.col("_n") - 1).alias("eos"))
    return _with_own(out, *keep)


def majority(rows: DataFrame, key: str, label: str, least: int = 2, share: float = 0.0) -> DataFrame:
    """key, label, n, total: the most frequent label of each key, of several the first in order, where it has at least `least`
    occurrences and this share of them."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    best = F.row_number().over(by.orderBy(F.desc("n"), label))
    return n.withColumn("total", F.sum("n").over(by)).withColumn("_best", best).where((F.col("_best") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("_best")


def strong_overrides(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Labels that hold for at least five occurrences and 85 %."""
    n = majority(rows, key, label, 1)
    return n.where((F.col("total") >= 5) & (F.col("n") >= 0.85 * F.col("total")))


def lemma_overrides(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Labels that hold for at least 80 % of two occurrences or more."""
    return majority(rows, key, label, 2, 0.8)


def bigrams(states: DataFrame) -> DataFrame:
    """prev, cur, logp of states (doc_id, sent_id, pos, state), smoothed by one; '<s>' begins a sentence, and a row of
    '<DEFAULT>' gives the chance of a state after one that was never seen."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    return bigrams_of(states.select(F.coalesce(F.lag("state").over(order), F.lit("<s>")).alias("prev"), F.col("state").alias("cur")))


def pairs(states: Column) -> Column:
    """Array of prev and cur of an array of states, '<s>' before the first."""
    return F.arrays_zip(F.concat(F.array(F.lit("<s>")), F.slice(states, 1, F.greatest(F.size(states) - 1, F.lit(0)))).alias("prev"), states.alias("cur"))


def bigrams_of(pairs: DataFrame) -> DataFrame:
    """bigrams() of pairs (prev, cur)."""
    # counted once: all that follows reads the counts
    n = cut(pairs.groupBy("prev", "cur").agg(F.count("*").alias("c")))
    v = n.select("cur").distinct().agg(F.count("*").alias("v"))
    seen = n.withColumn("n", F.sum("c").over(Window.partitionBy("prev"))).crossJoin(F.broadcast(v)).select("prev", "cur", F.log((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("logp"))
    alone = n.groupBy("cur").agg(F.sum("c").alias("c"))
    all_ = alone.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    return seen.unionByName(alone.crossJoin(F.broadcast(all_)).select(F.lit("<DEFAULT>").alias("prev"), "cur", F.log((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("logp")))


def transition(pairs: DataFrame, table: DataFrame, floor: float = -10.0) -> DataFrame:
    """pairs (prev, cur) with logp: that of the pair, else the default row's, else the floor."""
    own = table.where("prev <> '<DEFAULT>'").withColumnRenamed("logp", "_own")
    default = table.where("prev = '<DEFAULT>'").select("cur", F.col("logp").alias("_default"))
    return pairs.join(own, ["prev", "cur"], "left").join(default, "cur", "left").select(*pairs.columns, F.coalesce("_own", "_default", F.lit(floor)).alias("logp"))


def pruned(rows: DataFrame, group: str, label: str, least: int = 2, group_least: int = 200) -> DataFrame:
    """Rows of groups of at least group_least, whose label occurs at least `least` times in the group."""
    n = F.count("*").over(Window.partitionBy(group, label))
    total = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("_n", n).withColumn("_total", total).where((F.col("_n") >= least) & (F.col("_total") >= group_least)).drop("_n", "_total")


def census(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def holdout(rows: DataFrame, key: str, part: int = 5) -> DataFrame:
    """rows with split: 'test' for one in `part` keys, else 'train'."""
    return rows.withColumn("split", F.when(F.pmod(F.col(key), F.lit(part)) == 0, "test").otherwise("train"))


def accuracy(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """n, missing (no prediction), correct, percent."""
    same = F.coalesce(F.lower(gold) == F.lower(predicted), F.lit(False))
    return rows.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(predicted).isNull(), 1)).alias("missing"), F.count(F.when(same, 1)).alias("correct"),
        F.round(100 * F.count(F.when(same, 1)) / F.count("*"), 4).alias("percent"),
    )


def confusion(rows: DataFrame, gold: str, predicted: str, top: int = 10) -> DataFrame:
    """The most frequent wrong pairs."""
    return rows.where(F.col(gold) != F.col(predicted)).groupBy(gold, predicted).agg(F.count("*").alias("n")).orderBy(F.desc("n"), gold, predicted).limit(top)


def next_where(tokens: str, wanted: Callable[[Column], Column]) -> Column:
    """Of each token of the array column, the next one that is wanted: each of those stands for all places from the one before it on, so
    that the time is that of reading the array once."""
    w = F.col(tokens)
    at = F.array_compact(F.transform(w, lambda t, i: F.when(wanted(t), i)))
    # the places are asked for twice each: bound by a lambda, they are found once
    filled = lambda at: F.concat(
        F.flatten(F.transform(at, lambda i, k: F.array_repeat(F.get(w, i), i - F.when(k == 0, 0).otherwise(F.get(at, k - 1))))),
        F.array_repeat(F.lit(None).cast("string"), F.size(w) - F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0))),
    )
    return F.get(F.transform(F.array(at), filled), F.lit(0))
