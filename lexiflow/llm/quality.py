"""Operator 6: quality rules with risk-controlled thresholds.

Each rule measures one kind of junk as a share between 0 and 1; a document fails a rule when the share reaches the rule's
cutoff for the document's stratum (its language). Labelled rows, one for each distinct text of a stratum (copies are no independent
trials), are halved by their digest. On the first half each rule picks, of a fixed grid, the cutoff that scores best, PRICE good
rows weighing as much as one bad row against it, and rules are ordered by their scores. The second half, which had no part in that,
certifies: rule by rule in that order the exact binomial test asks whether the share of good rows rejected by any rule so far is
below epsilon, that is P(Bin(n, epsilon) <= k) <= delta / strata, with n good rows of which k are rejected; that is the same as an
exact (Clopper-Pearson) upper bound below epsilon. The first rule that fails, and all after it, are off in the stratum.

Multiple testing: a fixed sequence that ends with its first failure needs no correction within a stratum, and the strata are
Bonferroni-corrected. With probability 1 - delta no stratum loses more than epsilon of its good texts, whatever rules apply together.

Cost at scale. Labelled rows are told before any text is measured (by a bitmap of fixed size), and only their measures and digests are
shuffled. The documents are measured where they lie, once; cutoffs go to the rows.

Defined results: a null or empty text has measures 0 and is kept. A null language is the stratum 'und'. A stratum with no
labelled rows, or too few to certify anything, rejects nothing. Labels that are null or belong to no document are ignored;
of several labels for a doc_id, or for one text of a stratum, the largest counts. Of cutoffs that score alike the highest is picked, of
rules the first by name. Further columns of any name are ignored by quality() and kept by good_quality(). An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import broadcast_if, cut, fresh, may_hold, table

EPSILON, DELTA, PRICE = 0.05, 0.05, 100
RULES = ("symbols", "shouting", "pipes", "repeats", "capitals", "nonletters", "digits", "long_words", "same_lines", "open_lines")
CUTOFFS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)
CLOSERS = ".!?:;…\"”»)"


def measures(text: Column) -> dict[str, Column]:
    """The share of each rule. Among the characters: runs of symbols, '!!', bars, ASCII capitals, what is neither letter nor space,
    digits, words of over 40 characters. Among the words: those equal to the one before. Among the lines that aren't empty: those equal
    to an earlier one, and those that don't end a sentence."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, "[ \n]+")
    # no column is captured by the lambdas: it would be evaluated anew for every word
    pairs = F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("next"))
    again = F.size(F.filter(pairs, lambda x: x["w"] == x["next"]))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    all_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    share = {
        "symbols": less("[&*$%#]{3}") / n,
        "shouting": (F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / n,
        "pipes": 3 * (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) / n,
        "repeats": again / F.size(words).cast("double"),
        "capitals": less("[A-Z]+") / n,
        "nonletters": less(r"[^\p{L} \n\r\t]+") / n,
        "digits": less("[0-9]+") / n,
        "long_words": less(r"[^ \n\r\t]{41,}") / n,
        "same_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / all_lines,
        "open_lines": F.size(F.filter(lines, lambda x: F.instr(F.lit(CLOSERS), F.substring(x, -1, 1)) == 0)) / all_lines,
    }
    return {r: F.coalesce(share[r], F.lit(0.0)) for r in RULES}


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    m = F.struct(*[v.alias(k) for k, v in measures(F.col("text")).items()])
    return docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("stratum"), m.alias("m"), *more).select("doc_id", "stratum", "m.*", *[c for c in ("digest",) if more])


def trials(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, digest, good, and a column for each rule: a row for each labelled text of a stratum."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    measured = _measured(may_hold(rows, good), F.coalesce(F.md5("text"), F.md5(F.lit(""))).alias("digest"))
    return measured.join(good, "doc_id").groupBy("stratum", "digest").agg(F.max("good").alias("good"), *[F.max(r).alias(r) for r in RULES])


def thresholds(held: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, step, n, k: the certified rules, of trials(); n and k: good rows of the second half, and how many of them this
    and the steps before reject."""
    held = cut(held)
    first = F.substring("digest", 1, 1) < "8"
    grid = [(r, i, float(c)) for r in RULES for i, c in enumerate(CUTOFFS)]
    counts = [F.count(F.when((F.col(r) >= c) & (F.col("good") == g), 1)).alias(f"{r}_{i}_{g}") for r, i, c in grid for g in (0, 1)]
    table_ = held.where(first).groupBy("stratum").agg(*counts)
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(f"{r}_{i}_0") - PRICE * F.col(f"{r}_{i}_1")).alias("score")) for r, i, c in grid]))
    tests = table_.select("stratum", cells.alias("x")).select("stratum", "x.*").where("score > 0")
    best = tests.groupBy("stratum", "rule").agg(F.max(F.struct("score", "cutoff")).alias("x")).select("stratum", "rule", "x.score", "x.cutoff")
    picked = cut(best.withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("score"), "rule"))))
    # a row for each stratum and rule
    wide, strata = _wide(picked)
    fails = F.least(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.col(f"step_{r}")) for r in RULES], F.lit(len(RULES) + 1))
    judged = held.where(~first & (F.col("good") == 1)).join(broadcast_if(wide, strata), "stratum").select("stratum", fails.alias("fails"))
    sums = judged.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("fails") <= i, 1)).alias(f"k{i}") for i in range(1, len(RULES) + 1)])
    steps = sums.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(1, len(RULES) + 1)])).alias("x")).select("stratum", "n", "x.*")
    all_ = held.agg(F.count_distinct("stratum").alias("strata"))

    @F.pandas_udf("double")
    def tail(n, k):  # log P(Bin(n, epsilon) <= k), exact; a row for each stratum and step
        import math

        import numpy as np
        import pandas as pd

        def one(n: int, k: int) -> float:
            if k >= n:
                return 0.0
            i = np.arange(k + 1)
            lg = np.cumsum(np.concatenate(([0.0], np.log((n - i[:-1]) / (i[:-1] + 1.0))))) + i * math.log(epsilon) + (n - i) * math.log1p(-epsilon)
            return float(min(np.logaddexp.reduce(lg), 0.0))

        return pd.Series([one(int(a), int(b)) for a, b in zip(n, k)], dtype=float)

    failed = F.when(F.col("tail") > F.log(F.lit(delta) / F.col("strata")), F.col("step"))
    before = Window.partitionBy("stratum").orderBy("step")
    sure = steps.join(picked, ["stratum", "step"]).crossJoin(all_).withColumn("tail", tail("n", "k")).withColumn("end", F.min(failed).over(before)).where("end IS NULL")
    return sure.select("stratum", "rule", "cutoff", "step", "n", "k")


def _wide(limits: DataFrame) -> tuple[DataFrame, int]:
    """stratum, and for each rule its cutoff, infinity where it is off, and step; and how many strata there are."""
    cuts = [F.coalesce(F.min(F.when(F.col("rule") == r, F.col("cutoff"))), F.lit(float("inf"))).alias(f"cut_{r}") for r in RULES]
    steps = [F.min(F.when(F.col("rule") == r, F.col("step"))).alias(f"step_{r}") for r in RULES]
    wide = cut(limits.groupBy("stratum").agg(*cuts, *steps))
    return wide, wide.count()


def quality(docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, failed (the rules failed, joined by commas), kept: one row for each row of docs."""
    wide, n = _wide(thresholds(trials(docs, labels), epsilon, delta))
    failed = F.coalesce(F.concat_ws(",", *[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), F.lit(""))
    return _measured(docs).join(broadcast_if(wide, n), "stratum", "left").select("doc_id", "stratum", failed.alias("failed")).withColumn("kept", F.col("failed") == "")


def good_quality(docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """The rows of docs that fail no rule, with all their columns. Texts are not shuffled: the cutoffs go to the rows."""
    wide, n = _wide(thresholds(trials(docs, labels), epsilon, delta))
    stratum, m, *cuts = fresh(docs.columns, "stratum", "m", *[f"cut_{r}" for r in RULES])
    limits = wide.select(F.col("stratum").alias(stratum), *[F.col(f"cut_{r}").alias(c) for r, c in zip(RULES, cuts)])
    rows = docs.withColumns({stratum: F.coalesce("lang", F.lit("und")), m: F.struct(*[v.alias(k) for k, v in measures(F.col("text")).items()])})
    bad = [F.coalesce(F.col(m)[r] >= F.col(c), F.lit(False)) for r, c in zip(RULES, cuts)]
    ok = ~bad[0]
    for b in bad[1:]:
        ok = ok & ~b
    return rows.join(broadcast_if(limits, n), stratum, "left").where(ok).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by rules certified on the labels."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, {c} AS cutoff" for r in RULES for c in CUTOFFS)
    value = " ".join(f"WHEN '{r}' THEN {r}" for r in RULES)
    cuts = ", ".join(f"min(cutoff) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)
    failed = ", ".join(f"CASE WHEN {r} >= cut_{r} THEN '{r}' END" for r in RULES)
    less = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))) / n"
    share = {
        "symbols": less("[&*$%#]{3}"),
        "shouting": "(length(text) - length(replace(text, '!!', ''))) / n",
        "pipes": "3 * (length(text) - length(replace(text, '|', ''))) / n",
        "repeats": "len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2]))::DOUBLE / len(w)",
        "capitals": less("[A-Z]+"),
        "nonletters": less(r"[^\p{L} \n\r\t]+"),
        "digits": less("[0-9]+"),
        "long_words": less(r"[^ \n\r\t]{41,}"),
        "same_lines": "(len(l) - len(list_distinct(l))) / greatest(len(l), 1)::DOUBLE",
        "open_lines": f"len(list_filter(l, lambda x: instr('{CLOSERS}', right(x, 1)) = 0)) / greatest(len(l), 1)::DOUBLE",
    }
    shares = ", ".join(f"coalesce({share[r]}, 0) AS {r}" for r in RULES)
    return f"""
WITH words AS (SELECT doc_id, text, coalesce(lang, 'und') AS stratum, greatest(length(text), 1)::DOUBLE AS n, regexp_split_to_array(text, '[ \n]+') AS w, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
measured AS MATERIALIZED (SELECT doc_id, stratum, coalesce(md5(text), md5('')) AS digest, {shares} FROM words),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS MATERIALIZED (SELECT stratum, digest, max(good) AS good, {", ".join(f"max({r}) AS {r}" for r in RULES)} FROM measured JOIN good USING (doc_id) GROUP BY stratum, digest),
strata AS (SELECT count(DISTINCT stratum) AS strata FROM held),
grid AS ({grid}),
scores AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good = 0 AND (CASE rule {value} END) >= cutoff) - {PRICE} * count(*) FILTER (WHERE good = 1 AND (CASE rule {value} END) >= cutoff) AS score
  FROM held, grid WHERE digest[1] < '8' GROUP BY ALL),
best AS (SELECT stratum, rule, cutoff, score FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY score DESC, cutoff DESC) = 1),
picked AS MATERIALIZED (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, rule) AS step FROM best),
second AS (SELECT stratum, digest, {", ".join(RULES)} FROM held WHERE digest[1] >= '8' AND good = 1),
fails AS (SELECT s.stratum, s.digest, min(step) FILTER (WHERE (CASE rule {value} END) >= cutoff) AS fails FROM second s JOIN picked p USING (stratum) GROUP BY ALL),
steps AS (SELECT p.stratum, p.step, count(*) AS n, count(*) FILTER (WHERE fails <= p.step) AS k FROM fails f JOIN (SELECT DISTINCT stratum, step FROM picked) p USING (stratum) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({EPSILON!r}) + (n - i) * ln(1 - {EPSILON!r}))) FROM range(0, k + 1) t(i)) END AS tail FROM steps),
ends AS (SELECT stratum, step, min(CASE WHEN tail > {DELTA!r} / strata THEN step END) OVER (PARTITION BY stratum ORDER BY step) AS stop FROM tails, strata),
limits AS (SELECT stratum, {cuts} FROM picked JOIN ends USING (stratum, step) WHERE stop IS NULL GROUP BY stratum),
judged AS (SELECT doc_id, measured.stratum, concat_ws(',', {failed}) AS failed FROM measured LEFT JOIN limits USING (stratum))
SELECT doc_id, stratum, failed, failed = '' AS kept FROM judged"""


SQL = _sql()
