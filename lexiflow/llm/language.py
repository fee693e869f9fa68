"""Operator 1: language identification by hierarchical discrimination.

A document's byte n-grams (1 to 3 bytes of the lower-cased text, hashed) first decide its language family; then one-versus-one linear
support vector machines decide between the languages of that family alone, each pair having a machine of its own. Families, where
there are more than two, are decided by pairs in the same way. Most wins win; ties go to the larger sum of margins, then to the
first name.

The machines are trained, in one task on an executor, on a bounded sample of rows with a language: about max_train of
every language, by hash order of doc_id. Every document is then scored whole.

Cost at scale. A machine is linear in the counts of n-grams, so a document's score is the sum of the weights at its n-grams: one gather a
byte and machine, no feature vectors. The query has no shuffle of texts.

Defined results: a text without letters (in any script), an empty or a null one is 'und', of family 'und', with margin 0. Rows whose
language is null are not trained on, nor are texts without letters, and a language with no other rows is no candidate. Equal rows are
trained on once. A language of no known family makes a family of its own. With one language there are no machines, and it is what every
text with letters gets; with none all are 'und'. Further columns of any name are ignored. Equal texts get equal results: a score is
summed along its own text alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import table

FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"), "slavic"),
    **dict.fromkeys(("lv", "lt", "ltg"), "baltic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}
MAX_TRAIN, BUCKETS, PASSES, RIDGE = 1000, 4096, 30, 1e-4
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def family(lang: str) -> str:
    return FAMILIES.get(lang.lower().split("-")[0].split("_")[0], lang)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the hashed n-grams that end at each byte, three to a byte, and where each text's begin. -1: no n-gram."""
    data, off = B.view(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(data)
    letter = _LETTER[data]
    b = np.where(letter, data, 32).astype(np.uint32)
    spot = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    out = np.full((n, 3), -1, dtype=np.int32)
    h = b * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out[:, 0] = np.where(letter, h >> shift, -1)
    if n > 1:
        h2 = (h[1:] ^ (b[:-1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE3D)
        out[1:, 1] = np.where((spot[1:] > 0) & (letter[1:] | letter[:-1]), h2 >> shift, -1)
    if n > 2:
        h3 = (h2[1:] ^ (b[:-2] * np.uint32(0x27D4EB2F) + np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
        out[2:, 2] = np.where((spot[2:] > 1) & letter[1:-1], h3 >> shift, -1)
    return out.ravel(), off * 3


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False), dtype=bool)


def features(texts: pa.Array) -> np.ndarray:
    """Shares of the n-grams of each text, rows of BUCKETS; texts without letters are zero."""
    rows = []
    for _, part in B.pieces(texts):
        part = pc.if_else(pa.array(lettered(part)), part, pa.scalar("", part.type))
        g, off = grams(part)
        doc = np.repeat(np.arange(len(part)), np.diff(off))
        ok = g >= 0
        x = np.bincount(doc[ok] * BUCKETS + g[ok], minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS).astype(np.float32)
        rows.append(x / np.maximum(x.sum(1, keepdims=True), 1))
    return np.concatenate(rows) if rows else np.zeros((0, BUCKETS), np.float32)


@dataclass
class Machines:
    """Pairs of names, ('f', a, b) for families and ('l', a, b) for languages, and a column of weights and a bias for each."""

    languages: list[str]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray  # BUCKETS x pairs
    bias: np.ndarray


def svm(x: np.ndarray, y: np.ndarray, passes: int = PASSES, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss, averaged stochastic subgradients), y in -1, 1; the classes weigh the same."""
    scale = x.std(0) + 1e-4
    z = x / scale
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    weigh = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    w, mean, b, mean_b, t, n = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 0, 0
    rng = np.random.default_rng(7)
    for epoch in range(passes):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            t += 1
            rate = 1 / (ridge * (t + 1000))
            miss = at[y[at] * (z[at] @ w + b) < 1]
            w *= 1 - rate * ridge
            if len(miss):
                g = (y[miss] * weigh[miss]) / len(at)
                w += rate * (g @ z[miss])
                b += rate * 0.01 * g.sum()
            if epoch >= passes // 2:
                n += 1
                mean += (w - mean) / n
                mean_b += (b - mean_b) / n
    # rows were scaled to unit length, which a sum over n-grams cannot do: the bias is set anew on the shares
    v = mean / scale
    s = x @ v
    order = np.argsort(s)
    good = np.cumsum(np.where(y[order] < 0, weigh[order], 0)) - np.cumsum(np.where(y[order] > 0, weigh[order], 0))
    best = int(np.argmax(good))
    cut = (s[order[best]] + s[order[min(best + 1, len(s) - 1)]]) / 2 if len(s) else 0.0
    unit = max(float(np.std(s)), 1e-9)
    return v / unit, float(-cut / unit)


def train(texts: pa.Array, langs: list[str]) -> Machines:
    """Machines of the languages that have a text with letters: each pair has rows on both sides."""
    x, lang = features(texts), np.array(langs, dtype=object)
    fam = np.array([family(v) for v in langs], dtype=object)
    some = x.sum(1) > 0
    x, lang, fam = x[some], lang[some], fam[some]
    names = sorted(set(lang))
    pairs = [("f", a, b) for a, b in combinations(sorted({family(v) for v in names}), 2)]
    pairs += [("l", a, b) for a, b in combinations(names, 2) if family(a) == family(b)]
    w, bias = [], []
    for kind, a, b in pairs:
        of = fam if kind == "f" else lang
        own = (of == a) | (of == b)
        v, c = svm(x[own], np.where(of[own] == a, 1.0, -1.0))
        w.append(v)
        bias.append(c)
    return Machines(names, pairs, np.array(w).T.reshape(BUCKETS, len(pairs)), np.array(bias))


def _vote(names: list[str], pairs: list[tuple[int, str, str]], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner among names, and its least margin over another."""
    n = len(s)
    wins, margin, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
    for col, a, b in pairs:
        i, j = names.index(a), names.index(b)
        for k, sign in ((i, 1), (j, -1)):
            v = sign * s[:, col]
            wins[:, k] += v > 0 if sign > 0 else v >= 0
            margin[:, k] += v
            least[:, k] = np.minimum(least[:, k], v)
    rank = np.lexsort((margin.ravel(), wins.ravel())).argsort().reshape(wins.shape) if len(names) > 1 else wins
    best = rank.argmax(1) if len(names) > 1 else np.zeros(n, dtype=int)
    low = least[np.arange(n), best]
    return best, np.where(np.isfinite(low), low, 0.0)


def predict(texts: pa.Array, m: Machines) -> tuple[list[str], list[str], np.ndarray]:
    """(families, languages, margins)."""
    fams, langs, margins = [], [], []
    if not m.languages:
        return ["und"] * len(texts), ["und"] * len(texts), np.zeros(len(texts))
    by_family = {f: [v for v in m.languages if family(v) == f] for f in sorted({family(v) for v in m.languages})}
    table_ = np.vstack([m.weights, np.zeros((1, len(m.pairs)))])  # -1 gathers the last row
    for _, part in B.pieces(texts):
        g, off = grams(part)
        count = np.concatenate(([0], np.cumsum(g >= 0)))
        n = count[off[1:]] - count[off[:-1]]
        s = np.zeros((len(part), len(m.pairs)))
        full = np.flatnonzero(np.diff(off) > 0)
        for col in range(len(m.pairs)):
            if len(full):
                s[full, col] = np.add.reduceat(table_[g, col], off[full])
            s[:, col] = s[:, col] / np.maximum(n, 1) + m.bias[col]
        f, low = _vote(list(by_family), [(c, a, b) for c, (k, a, b) in enumerate(m.pairs) if k == "f"], s)
        names = list(by_family)
        lang, margin = np.empty(len(part), dtype=object), np.array(low, dtype=float)
        for i, name in enumerate(names):
            own = np.flatnonzero(f == i)
            best, close = _vote(by_family[name], [(c, a, b) for c, (k, a, b) in enumerate(m.pairs) if k == "l" and family(a) == name], s[own])
            for d, b in zip(own, best):
                lang[d] = by_family[name][b]
            if len(by_family[name]) > 1:
                margin[own] = np.minimum(margin[own], close) if len(names) > 1 else close
        none = ~lettered(part)
        fams += ["und" if x else names[i] for x, i in zip(none, f)]
        langs += ["und" if x else v for x, v in zip(none, lang)]
        margins.append(np.where(none, 0.0, np.round(margin, 6)))
    return fams, langs, np.concatenate(margins) if margins else np.zeros(0)


def trained(docs: DataFrame, max_train: int = MAX_TRAIN) -> Machines:
    """Machines of about max_train rows of every language."""
    known = docs.where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Machines([], [], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(2**30 * min(1.0, max_train / n))).otherwise(share)
    by = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))  # rows without a number go by their text
    rows = known.where(F.pmod(F.xxhash64(by, F.lit("train")), F.lit(2**30)) < share).select("text", F.col("lang").cast("string")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("lang", pa.string())]))
        if t.num_rows:
            t = t.sort_by([("lang", "ascending"), ("text", "ascending")])
            m = train(t["text"].combine_chunks(), t["lang"].to_pylist())
            # a row for each machine, and one of kind '' for each candidate language
            kinds, a, b = (list(x) for x in zip(*m.pairs, *(("", v, "") for v in m.languages))) if m.languages else ([], [], [])
            w = [np.append(m.weights[:, i], m.bias[i]) for i in range(len(m.pairs))] + [None] * len(m.languages)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(w, pa.list_(pa.float64()))], names=["kind", "a", "b", "w"])

    all_ = sorted(rows.repartition(1).mapInArrow(run, "kind string, a string, b string, w array<double>").collect(), key=lambda r: (r["kind"], r["a"], r["b"]))
    got = [r for r in all_ if r["kind"]]
    w = np.array([r["w"] for r in got]).reshape(len(got), BUCKETS + 1).T
    return Machines([r["a"] for r in all_ if not r["kind"]], [(r["kind"], r["a"], r["b"]) for r in got], w[:-1], w[-1])


def identified(docs: DataFrame, machines: Machines) -> DataFrame:
    """doc_id, family, language, margin: a row for each row of docs."""

    @F.arrow_udf("struct<family:string,language:string,margin:double>")
    def run(texts: pa.Array) -> pa.Array:
        f, v, m = predict(texts, machines)
        return pa.StructArray.from_arrays([pa.array(f, pa.string()), pa.array(v, pa.string()), pa.array(m, pa.float64())], names=["family", "language", "margin"])

    return docs.select("doc_id", run("text").alias("x")).select("doc_id", "x.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs, trained(docs))
