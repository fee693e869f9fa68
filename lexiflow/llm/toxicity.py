"""Operator 8: toxicity by weak supervision.

Voters. Built-in lists of common insults make a lexicon voter for each of several languages (two for English). Two pattern voters
look for threats (a verb of violence right before its object) and for insults in disguise (digits for letters). Further lexicons are
mined, for whatever languages the table holds, from all labelled rows: words, and word beginnings of 4 to 8 bytes, whose presence is
far likelier in toxic rows than chance allows. Mined words make four voters, beginnings two pattern voters;
two more vote on how many different hits a text has and on their density, and one votes clean where nothing was hit.
Labels propose lexicons only: neither the label model nor the classifier sees one.

Label model. Over the vote patterns of *all* documents a generative model P(y) prod P(vote | y, its parent's vote) is
fitted by expectation maximisation, without any labels: independent voters first, then, from the conditional mutual
information of each pair given y, a maximum spanning tree of correlations, whose edges enter the model. Only the counts of
distinct vote patterns (at most 2 ** voters) reach the driver.

Classifier. Logistic regression on the voters' counts and hashed hit words is trained on posterior labels of a bounded
sample and scores every document.

Bound: about max_train rows for the classifier, by a share of the hash range. Everything else covers all rows.

Copies of one toxic text would make its common words look telling, so a labelled text counts once, and not at all if more than half of
its min-hashes are those of an earlier text of the same label. A text is compared with at most BANDS others, so texts that only share
passages, or look like texts of the other label, stay however many there are.

Cost at scale. Of the labelled rows, found by a bitmap of fixed size before any shuffle, the texts are shuffled once, to their labels.
Words are counted within each partition and then by word; beginnings are summed from the counts of the words that begin so. Only
telling words and beginnings reach the driver.

Defined results: null and empty texts have no hits and are not toxic. Labels that are null or belong to no document are
ignored; of several labels for a doc_id the largest counts; a null doc_id has no label. Equal texts get equal scores.
Without labels only the built-in voters fire. Further columns of any name are ignored by toxicity() and kept by
without_toxic(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import cut, may_hold, table

INSULTS = {
    "en": ("idiot", "idiots", "moron", "morons", "stupid", "trash", "scum", "loser", "losers", "worthless", "disgusting", "pathetic", "clown", "dumb", "imbecile", "filthy", "vermin", "subhuman", "retard", "bastard"),
    "de": ("arschloch", "vollidiot", "dummkopf", "schwachkopf", "drecksau", "abschaum", "missgeburt", "hurensohn", "wichser", "miststück"),
    "fr": ("connard", "connasse", "salaud", "salope", "imbécile", "crétin", "abruti", "ordure", "pourriture", "dégueulasse"),
    "es": ("imbécil", "estúpido", "estúpida", "gilipollas", "cabrón", "escoria", "asqueroso", "asquerosa", "patético", "hijoputa"),
    "other": ("coglione", "stronzo", "pezzente", "idioot", "klootzak", "otário", "desgraçado", "kretyn", "debils", "stulbenis"),
}
#: Verbs of violence and their objects, the second word right after the first.
THREATS = (
    (("kill", "hurt", "stab", "shoot", "strangle", "murder"), ("you", "them", "yourself", "him", "her")),
    (("töte", "ermorde", "erschieße"), ("dich", "euch")),
    (("mataré", "mataros", "matarte"), ("a", "todos")),
    (("tuer", "frapper", "égorger"), ("toi", "vous")),
)
#: Digits that stand for letters.
DISGUISE = dict(zip(b"0134578", b"oieastb"))
#: Bound: rows that train the classifier, about.
MAX_TRAIN, SIZES, HASHED = 20_000, range(4, 9), 64
#: Bands of three min-hashes of a labelled text; words that a partition counts before it sends them on.
BANDS, HELD = 8, 2**20
VOTERS = ("insults_a", "insults_b", "insults_de", "insults_fr", "insults_es", "insults_other", "threats", "disguised", "mined_0", "mined_1", "mined_2", "mined_3", "beginning", "two_beginnings", "two_hits", "density", "clean")


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(B.Words(pa.array(words)).hash)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return B.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


_THREATS = np.sort(np.concatenate([_pair(_hashes(v)[:, None], _hashes(o)[None, :]).ravel() for v, o in THREATS]))
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(DISGUISE)] = list(DISGUISE.values())
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _undisguised(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """(indices of words of letters and digits, their hashes with letters for digits)."""
    digits = np.concatenate(([0], np.cumsum(_DIGIT[w.data])))
    n = digits[w.end] - digits[w.start]
    at = np.flatnonzero((n > 0) & (n < w.end - w.start))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    size = w.end[at] - w.start[at]
    ends = np.cumsum(size)
    data = _PLAIN[w.data[np.arange(ends[-1]) + np.repeat(w.start[at] - (ends - size), size)]]
    return at, B.span_hash(B.prefix_hash(data), ends - size, ends)


@dataclass
class Lexicon:
    """Sorted hashes of the built-in insults of all languages, of the mined words and of the mined beginnings by size."""

    insults: np.ndarray = field(default_factory=lambda: _hashes(tuple(w for words in INSULTS.values() for w in words)))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    beginnings: dict[int, np.ndarray] = field(default_factory=dict)


_BY_LIST = [_hashes(words) for words in INSULTS.values()]


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def hits(texts: pa.Array, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """For each text: pattern (a bit for each voter), the counts insults, mined, beginnings, different, words, and
    hashed, a bit set of the hit words' hashes."""
    parts: list[dict[str, np.ndarray]] = []
    for _, part in B.pieces(texts):
        w = B.Words(part)
        n = w.n
        insult, mined, begun = _within(w.hash, lexicon.insults), _within(w.hash, lexicon.words), np.zeros(len(w.hash), dtype=bool)
        by_list = [insult & _within(w.hash, known) for known in _BY_LIST]
        at, h = _undisguised(w)
        disguised = np.zeros(len(w.hash), dtype=bool)
        disguised[at] = _within(h, lexicon.insults) & ~insult[at]
        threat = np.zeros(len(w.hash), dtype=bool)
        threat[:-1] = _within(_pair(w.hash[:-1], w.hash[1:]), _THREATS) & (w.doc[:-1] == w.doc[1:])
        insult = insult | disguised | threat
        for size, known in lexicon.beginnings.items():
            if len(known):
                at, h = w.prefixes(size)
                begun[at] |= _within(h, known)
        any_ = np.flatnonzero(insult | mined | begun)
        order = np.lexsort((w.hash[any_], w.doc[any_]))
        d, h = w.doc[any_][order], w.hash[any_][order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        count = lambda mask: np.bincount(w.doc[mask], minlength=n)
        got = {"insults": count(insult), "mined": count(mined), "beginnings": count(begun), "different": np.bincount(d[new], minlength=n), "words": np.bincount(w.doc, minlength=n), "hashed": np.zeros(n, dtype=np.uint64)}
        np.bitwise_or.at(got["hashed"], d[new], np.uint64(1) << (h[new] % np.uint64(HASHED)))
        odd = (w.hash & np.uint64(1)) == 1
        english = by_list[0]
        group = (w.hash >> np.uint64(1)) % np.uint64(4)
        fire = [count(english & odd) > 0, count(english & ~odd) > 0, *(count(x) > 0 for x in (*by_list[1:], threat, disguised)), *(count(mined & (group == g)) > 0 for g in range(4))]
        total = count(insult | mined | begun)
        fire += [got["beginnings"] > 0, got["beginnings"] > 1, got["different"] > 1, (total > 0) & (total * 200 >= got["words"]), total == 0]
        got["pattern"] = sum(f.astype(np.int64) << i for i, f in enumerate(fire))
        parts.append(got)
    names = ("pattern", "insults", "mined", "beginnings", "different", "words", "hashed")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _telling(keys: int, toxic: float, clean: float, cost: float) -> Column:
    """Whether a hash (yes toxic and no clean texts) is far likelier in toxic texts: the log likelihood ratio of a share of 0.99
    against the base rate has to pay for as many tries as there are hashes, and 95 % of the texts (or all but one) be toxic."""
    base = min(max(toxic / max(toxic + clean, 1e-9), 1e-3), 0.5)
    gain = F.col("yes") * float(np.log(0.99 / base)) + F.col("no") * float(np.log(0.01 / (1 - base)))
    return (gain >= float(np.log(max(keys, 1)) + cost)) & (F.col("yes") >= 3) & (F.col("no") <= F.greatest(F.lit(1.0), 0.05 * F.col("yes")))


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text, hash (of the text) of the rows that may have a label: those whose bit is set in a bitmap of the labelled ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    return may_hold(rows, known).select("doc_id", "text", F.xxhash64("text").alias("hash"))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, hash and min-hashes of the rows that have words."""
    for b in batches:
        for at, part in B.pieces(b.column("text")):
            doc, g, _ = B.shingles(B.Words(part))
            if len(doc):
                starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                low = np.stack([np.minimum.reduceat(B.mix(g ^ np.uint64(0x9E37 * (j + 1))), starts) for j in range(3 * BANDS)], axis=1)
                rows = pa.array(doc[starts] + at)
                flat = pa.array((low.ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32())
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3 * BANDS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("hash").take(rows), sketch], names=["doc_id", "hash", "sketch"])


def _without_copies(near: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, hash, y, n (equal rows) of the labelled texts of which no earlier one of the same label is a near copy."""
    sketched = near.mapInArrow(_sketches, "doc_id bigint, hash bigint, sketch array<int>").join(known, "doc_id")
    same = sketched.groupBy("doc_id", "hash", "y").agg(F.count("*").alias("n"), F.min("sketch").alias("sketch"))
    rows = cut(same.groupBy("hash", "y").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x")).select("x.doc_id", "hash", "y", "x.n", "x.sketch"))
    bands = F.explode(F.array(*[F.xxhash64(F.lit(i), F.slice("sketch", 3 * i + 1, 3)) for i in range(BANDS)]))
    keys = rows.select("doc_id", "hash", "y", bands.alias("key"))
    first = keys.groupBy("y", "key").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    pairs = keys.join(first, ["y", "key"]).select("hash", "y", F.col("first.hash").alias("earlier")).where("hash <> earlier").distinct()
    sketches = rows.select(F.col("hash").alias("earlier"), "y", F.col("sketch").alias("theirs"))
    agree = F.size(F.filter(F.zip_with("sketch", "theirs", lambda a, b: a == b), lambda x: x))
    copies = pairs.join(rows.select("hash", "y", "sketch"), ["hash", "y"]).join(sketches, ["earlier", "y"]).where(2 * agree > 3 * BANDS).select("hash", "y").distinct()
    return rows.join(copies, ["hash", "y"], "left_anti").select("doc_id", "hash", "y", "n")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of toxic and clean texts of each word, from (text, y, n); a row that is there n times counts as 1 / n."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("yes", "sum"), ("no", "sum")]).rename_columns(["word", "yes", "no"])

    for b in batches:
        y, share = b.column("y").to_numpy() > 0, 1 / b.column("n").to_numpy()
        for at, part in B.pieces(b.column("text")):
            w = B.Words(part)
            if not len(w.hash):
                continue
            order = np.lexsort((w.doc, w.hash))
            d, h = w.doc[order], w.hash[order]
            word = np.concatenate(([True], h[1:] != h[:-1]))
            new = word.copy()
            new[1:] |= d[1:] != d[:-1]
            of, rows = (np.cumsum(word) - 1)[new], d[new] + at
            i = order[word]
            size = w.end[i] - w.start[i]
            ends = np.concatenate(([0], np.cumsum(size)))
            spelt = w.data[np.arange(ends[-1]) + np.repeat(w.start[i] - ends[:-1], size)]
            words = pa.StringArray.from_buffers(len(i), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spelt))
            yes, no = (np.bincount(of, share[rows] * x[rows], len(i)) for x in (y, ~y))
            held.append(pa.table({"word": words, "yes": yes, "no": no}))
            if sum(map(len, held)) >= HELD:
                held = [merged()]
                if len(held[0]) >= HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, hash, yes, no of each word (size 0) and of its beginnings."""
    for b in batches:
        yes, no = b.column("yes").to_numpy(), b.column("no").to_numpy()
        for at, part in B.pieces(b.column("word")):
            w = B.Words(part)
            for size in (0, *SIZES):
                i, h = w.prefixes(size) if size else (np.arange(len(w.hash)), w.hash)
                rows = w.doc[i] + at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(h.view(np.int64), pa.int64()), pa.array(yes[rows]), pa.array(no[rows])], names=["size", "hash", "yes", "no"])


def _share(hashed: Column, most: int, of: int) -> Column:
    """A condition that about `most` of `of` rows fulfil, by their hashes. Unlike an ordered limit it sends nothing but what it keeps
    to the driver, however many tasks there are."""
    return F.pmod(hashed, F.lit(2**30)) < int(2**30 * min(1.0, most / max(of, 1)))


def mined_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicons mined from all labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    near = _labelled(docs, known)
    rows = near.join(_without_copies(near, known), ["doc_id", "hash"]).select("text", "y", "n")
    words = rows.mapInArrow(_counts, "word string, yes double, no double").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # a beginning counts once for each text and each different word; a full stop of a UTF-8 letter is not asked for
    by = words.mapInArrow(_spread, "size int, hash bigint, yes double, no double").groupBy("size", "hash")
    sums = cut(by.agg(F.count("*").alias("words"), *[F.round(F.sum(c), 3).alias(c) for c in ("yes", "no")]))
    found = Lexicon()
    for r in sums.groupBy("size").agg(F.count("*").alias("keys"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).orderBy("size").collect():
        good = sums.where((F.col("size") == r["size"]) & _telling(r["keys"], r["yes"], r["no"], np.log(10)))
        if r["size"]:
            # several different words have to begin so, else the word itself is what tells
            good = good.where("words >= 3")
        h = np.sort(np.array([x["hash"] for x in good.select("hash").collect()], dtype=np.int64).view(np.uint64))
        if r["size"]:
            found.beginnings[r["size"]] = h
        else:
            found.words = np.setdiff1d(h, found.insults)
    return found


@dataclass
class LabelModel:
    """P(y) and, for each voter, P(it fires | y, its parent's vote); parent -1: none."""

    prior: float
    parent: list[int]
    fire: np.ndarray  # voters x 2 (y) x 2 (parent's vote)
    patterns: np.ndarray
    posterior: np.ndarray

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each voter, how often it fires on toxic and on clean rows."""
        out = {}
        p = self.posterior
        for i, v in enumerate(VOTERS):
            f = ((self.patterns >> i) & 1)[:, None]
            out[v] = (float((f[:, 0] * p * self.weight).sum() / max((p * self.weight).sum(), 1e-9)), float((f[:, 0] * (1 - p) * self.weight).sum() / max(((1 - p) * self.weight).sum(), 1e-9)))
        return out


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 60, least: float = 0.005) -> LabelModel:
    """patterns: distinct vote patterns, counts: rows of each. least: conditional mutual information (nats) an edge needs."""
    m = len(VOTERS)
    x = ((patterns[:, None] >> np.arange(m)) & 1).astype(np.int64)
    c = counts.astype(float)
    says = x[:, :-1].sum(1)
    p = np.where(x[:, -1] == 1, 0.02, np.where(says >= 3, 0.95, 0.4))
    parent = [-1] * m

    def maximise() -> tuple[float, np.ndarray]:
        fire = np.zeros((m, 2, 2))
        for i in range(m):
            above = x[:, parent[i]] if parent[i] >= 0 else np.zeros(len(x), dtype=int)
            for y, q in ((0, 1 - p), (1, p)):
                for a in (0, 1):
                    w = c * q * (above == a)
                    all_ = (c * q).sum()
                    own = ((c * q * x[:, i]).sum() + 0.5) / (all_ + 1)
                    fire[i, y, a] = ((w * x[:, i]).sum() + own) / (w.sum() + 1)
        return float(((c * p).sum() + 1) / (c.sum() + 2)), np.clip(fire, 1e-6, 1 - 1e-6)

    def expect(prior: float, fire: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - prior, prior]), (len(x), 1))
        for i in range(m):
            above = x[:, parent[i]] if parent[i] >= 0 else np.zeros(len(x), dtype=int)
            for y in (0, 1):
                f = fire[i, y][above]
                logs[:, y] += np.where(x[:, i] == 1, np.log(f), np.log1p(-f))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    for round_ in range(2):
        if round_ and len(x) > 1:
            cmi = np.zeros((m, m))
            for i in range(m):
                for j in range(i):
                    for q in (1 - p, p):
                        w = c * q
                        t = np.array([[(w * (x[:, i] == a) * (x[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)]) + 1e-9
                        joint, rows, cols = t / c.sum(), t.sum(1, keepdims=True) / c.sum(), t.sum(0, keepdims=True) / c.sum()
                        cmi[i, j] += (joint * np.log(joint * joint.sum() / (rows * cols))).sum()
            cmi = np.maximum(cmi, cmi.T)
            inside, open_ = [0], set(range(1, m))
            while open_:
                gain, j, i = max((cmi[i, j], -j, i) for i in inside for j in open_)
                parent[-j] = i if gain >= least else -1
                inside.append(-j)
                open_.discard(-j)
        for _ in range(steps):
            prior, fire = maximise()
            p = expect(prior, fire)
    # class 1 is the one whose voters say toxic
    if len(x) > 1 and (c * p * says).sum() / max((c * p).sum(), 1e-9) < (c * (1 - p) * says).sum() / max((c * (1 - p)).sum(), 1e-9):
        p = 1 - p
    model = LabelModel(prior, parent, fire, patterns, p)
    model.weight = c
    return model


def _design(got: dict[str, np.ndarray]) -> np.ndarray:
    bits = ((got["hashed"].astype(np.uint64)[:, None] >> np.arange(HASHED, dtype=np.uint64)) & np.uint64(1)).astype(float)
    num = [np.log1p(got[k].astype(float)) for k in ("insults", "mined", "beginnings", "different")]
    dense = (got["insults"] + got["mined"] + got["beginnings"]) / np.maximum(got["words"], 1)
    return np.column_stack([np.ones(len(bits)), *num, got["different"] > 1, np.minimum(dense * 50, 1), bits])


def fit_classifier(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), ridge)
    pen[0] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - p) + pen * w
        hess = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


_STRUCT = "pattern bigint, insults bigint, mined bigint, beginnings bigint, different bigint, words bigint, hashed bigint"


def _extract(lexicon: Lexicon):
    @F.arrow_udf(f"struct<{_STRUCT.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        got = hits(texts, lexicon)
        return pa.StructArray.from_arrays([pa.array(v.astype(np.uint64).view(np.int64) if k == "hashed" else v.astype(np.int64), pa.int64()) for k, v in got.items()], names=list(got))

    return run


def _score(got: dict[str, np.ndarray], weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(got) @ weights, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, hits) of all rows."""
    lexicon = mined_lexicon(docs, labels)
    seen = cut(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), _extract(lexicon)("text").alias("hits")))
    votes = seen.groupBy("hits.pattern").count().orderBy("pattern").collect()
    patterns, counts = np.array([r[0] for r in votes] or [1 << (len(VOTERS) - 1)], dtype=np.int64), np.array([r[1] for r in votes] or [1])
    model = fit_label_model(patterns, counts)
    rows = seen.where(_share(F.col("hash"), max_train, int(counts.sum()))).orderBy("hash", "hits").select("hits.*").collect()
    got = {k: np.array([r[k] for r in rows], dtype=np.int64) for k in (x.split()[0] for x in _STRUCT.split(", "))}
    got["hashed"] = got["hashed"].view(np.uint64)
    known = dict(zip(patterns.tolist(), model.posterior.tolist()))
    p = np.array([known[v] for v in got["pattern"].tolist()])
    return Model(lexicon, model, fit_classifier(_design(got), p) if len(p) else np.zeros(7 + HASHED)), seen


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (the classifier's probability), toxic (score >= threshold), for each row of docs."""
    model, seen = fit(docs, labels, max_train)
    weights = model.weights

    @F.arrow_udf("double")
    def score(h: pa.Array) -> pa.Array:
        got = {k: h.field(k).to_numpy() for k in (h.type.field(i).name for i in range(h.type.num_fields))}
        return pa.array(np.round(_score(got | {"hashed": got["hashed"].view(np.uint64)}, weights), 6))

    return seen.select("doc_id", score("hits").alias("score")).withColumn("toxic", F.col("score") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns. Nothing is shuffled: the model goes to the rows."""
    model, _ = fit(docs, labels, max_train)
    lexicon, weights = model.lexicon, model.weights

    @F.arrow_udf("boolean")
    def fine(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(_score(hits(texts, lexicon), weights), 6) < threshold)

    return docs.where(fine("text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
