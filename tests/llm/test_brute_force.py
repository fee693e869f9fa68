"""Operators that SQL cannot express against brute-force versions, and the others against their SQL."""

import hashlib
import math
import re
import unicodedata
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from lexiflow.llm import _bytes, bpe, chat, language, mixing, near_dup, quality, queries, toxicity, warc_index
from lexiflow.llm._spark import cut, table
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf001, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf001) > 0


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())


def weighted(text, k=3):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def j_p(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_shingles_and_j_p():
    texts = ["a b c d a b c", "x", "", "A b-c, D!", "é ß é ß é", None]
    doc, g, w = _bytes.shingles(_bytes.Words(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(w[doc == i]) == sorted(weighted(t or "").values())
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = Counter(rng.integers(0, 12, 20).tolist())
        b = Counter(rng.integers(4, 16, 15).tolist())
        x, y = (np.array(sorted(c), dtype=np.uint64) for c in (a, b))
        assert near_dup.j_p(x, np.array([a[int(i)] for i in x]), y, np.array([b[int(i)] for i in y])) == pytest.approx(j_p(a, b))


def test_sketch_estimates_j_p():
    g = _bytes.mix(np.arange(300, dtype=np.uint64))
    w = np.where(np.arange(300) % 3 == 0, 4, 1)
    own = [g[:200], g[100:]]
    doc = np.repeat([0, 1], 200)
    sig = near_dup.sketch(doc, np.concatenate(own), np.concatenate((w[:200], w[100:])), 2, 2000)
    true = near_dup.j_p(np.sort(own[0]), w[:200][np.argsort(own[0])], np.sort(own[1]), w[100:][np.argsort(own[1])])
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.04)


def test_near_duplicate_groups(spark, sf01):
    """Groups of the operator against those of all pairs: recall of at least 0.9 of the pairs within groups, and no pair of
    different true groups."""
    docs = {r.doc_id: r.text for r in table(spark, sf01, "documents").collect()}
    sets = {i: weighted(t) for i, t in docs.items()}
    true_ = brute_groups(sets)
    root = true_.get
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(table(spark, sf01, "documents")).collect()}
    true, found = Counter(root(i) for i in docs), Counter()
    for i in docs:
        found[(root(i), got[i])] += 1
    pairs = lambda c: sum(n * (n - 1) // 2 for n in c.values())
    assert pairs(found) >= 0.9 * pairs(true)
    assert pairs(Counter(got.values())) == pairs(found)


def test_templates_make_few_pairs(spark, monkeypatch):
    """Texts that share a template, but too little to be near copies, are neither grouped nor compared with one another; near copies among
    them are found."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x:x}" for x in rng.integers(0, 10**9, n)]
    template = word(240)
    for n in (60, 240):
        texts = [" ".join(template + word(160)) for _ in range(n)]
        close = [t.split() for t in texts[:10]]
        for c in close:
            c[300:330] = word(30)
        docs = spark.createDataFrame(list(enumerate(texts + [" ".join(c) for c in close])), "doc_id bigint, text string")
        asked = []
        with monkeypatch.context() as m:
            m.setattr(near_dup, "cut", lambda df: (asked.append(df), cut(df))[1])
            got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(docs).collect()}
        assert got == {i: i if i < n else i - n for i in range(n + 10)}
        rows = [df.count() for df in asked if df.columns == ["a", "b"]]
        assert sum(rows) <= 2 * 10


def test_fronts_miss_no_near_pair():
    """Any two texts of J_P at the threshold share a shingle in the front of both, and in the short front of one."""
    rng = np.random.default_rng(7)
    for threshold in (0.3, 0.5, 0.8):
        rarity = rng.integers(0, 5, near_dup.SLOTS).astype(np.uint8)
        near = 0
        for _ in range(300):
            base = [f"w{x}" for x in rng.integers(0, 30, rng.integers(4, 60))]
            texts = []
            for _ in range(2):
                c = list(base) + [f"v{x}" for x in rng.integers(0, 30, rng.integers(0, 40) * rng.integers(0, 2))]
                for _ in range(rng.integers(0, 6)):
                    c[rng.integers(0, len(c))] = f"u{rng.integers(0, 9)}"
                texts.append(" ".join(c))
            if j_p(weighted(texts[0]), weighted(texts[1])) >= threshold:
                near += 1
                batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([b"a", b"b"]), pa.array([b"a", b"b"])], names=["text", "node", "root"])
                rows = pa.Table.from_batches(near_dup._fronts(3, threshold, rarity)(iter([batch]))).to_pylist()
                a, b = ({r["shingle"]: r["short"] for r in rows if r["node"] == n} for n in (b"a", b"b"))
                assert any(a[x] or b[x] for x in a.keys() & b.keys())
        assert near > 3


def brute_repair(roles):
    best = None
    for labels in product(chat.ROLES, repeat=len(roles)):
        base = sum(chat.RELABEL if a in chat.ROLES else chat.UNKNOWN for a, b in zip(roles, labels) if a != b)
        # each turn is appended after 0 to 2 empty turns, or merged
        for joins in product((0, 1, 2, "m"), repeat=len(roles)):
            states, cost, ok = [None], base, True
            for label, j in zip(labels, joins):
                if j == "m":
                    ok = states[-1] == label
                    cost += chat.MERGE
                else:
                    for _ in range(j):
                        states.append("assistant" if states[-1] == "user" else "user")
                    cost += chat.INSERT * j
                    ok = label in chat.NEXT[states[-1]]
                    states.append(label)
                if not ok:
                    break
            if ok:
                cost += chat.INSERT * {"user": 1, "system": 2}.get(states[-1], 0)
                best = cost if best is None else min(best, cost)
    return best


def test_chat_repair_takes_the_first_of_equal_repairs():
    def all_of(roles):  # every repair: (cost, operations, roles given)
        states = [((0, "", ()), None)]
        for role in roles:
            new = []
            for (cost, ops, given), state in states:
                for label in chat.ROLES:
                    price = ((chat.RELABEL if role in chat.ROLES else chat.UNKNOWN) if label != role else 0) + cost
                    letters = "kr"[label != role], "ms"[label != role]
                    if label == state:
                        new.append(((price + chat.MERGE, ops + letters[1], (*given, label)), label))
                    now = state
                    for gap in range(3):
                        if label in chat.NEXT[now]:
                            new.append(((price + chat.INSERT * gap, ops + "i" * gap + letters[0], (*given, label)), label))
                            break
                        now = "assistant" if now == "user" else "user"
                        if label == "system":
                            break
            states = new
        ends = {"user": 1, "system": 2}
        return [(c + chat.INSERT * ends.get(s, 0), o + "i" * ends.get(s, 0), g) for (c, o, g), s in states]

    for n in (1, 2, 3, 4):
        for roles in product(("system", "user", "assistant", "robot"), repeat=n):
            assert chat.repair(roles) == min(all_of(roles)), roles


def test_chat_repairs_long_conversations_in_linear_time():
    roles = ("user", "user", "assistant", "robot") * 10_000
    cost, ops, given = chat.repair(roles)
    assert len(given) == len(roles) and cost == chat.repair(roles[:40])[0] * 1000
    text, turns = chat.render(given, ops, ["t"] * len(roles))
    assert text.count("<|end|>") == turns


def test_chat_repair_is_cheapest():
    for n in (1, 2, 3):
        for roles in product(("system", "user", "assistant", None), repeat=n):
            cost, ops, given = chat.repair(roles)
            assert cost == brute_repair(roles), roles
            text, turns = chat.render(given, ops, ["t"] * n)
            shown = re.findall(r"<\|(\w+)\|>", text.replace("<|end|>", ""))
            state = None
            for r in shown:
                assert r in chat.NEXT[state]
                state = r
            assert state == "assistant" and turns == len(shown)


def test_chat_query(spark, sf001):
    got = chat.op2_chat_formatting(spark, sf001).collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in table(spark, sf001, "conversations").select("conv_id").distinct().collect()}


def test_bpe_is_exact(spark, sf01):
    e = bpe.encoding()
    texts = {r.doc_id: r.text for r in table(spark, sf01, "documents").collect()}
    got = bpe.op3_bpe(spark, sf01).collect()
    assert len(got) == len(texts)
    assert all(r.token_ids == e.encode_ordinary(texts[r.doc_id]) and r.round_trip for r in got)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_bpe_of_texts_whose_rolling_hashes_agree(spark):
    a = thue_morse(2048)
    texts = [a, a.translate(str.maketrans("ab", "ba")), a + " x", "y " + a]
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    e = bpe.encoding()
    assert all(got[i].token_ids == e.encode_ordinary(t) and got[i].round_trip for i, t in enumerate(texts))


def test_bpe_survives_equal_digests(spark, monkeypatch):
    """Tokens of another chunk, of the same or another length, are never kept."""
    e = bpe.Encoder(bpe.VOCABULARY)
    data = b"some words that make a text of several chunks " * 8
    ends = np.array([100, 250, len(data)])
    for other in (b"x" * 150, b"x" * 7):
        tokens = e.encode(data, ends, {1: e.plain(other)})
        assert e.encoding.decode_bytes(tokens.tolist()) != data or tokens.tolist() == e.plain(data).tolist()
    monkeypatch.setattr(bpe, "digest", lambda chunk: bytes(16))  # in this process only
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"n"]), pa.array([bpe.zstandard.ZstdCompressor().compress(data)]), pa.array([[{"digest": bytes(16), "tokens": bpe._packed(e.plain(b"x" * 100))}]])], names=["doc_id", "node", "packed", "held"])
    out = pa.Table.from_batches(bpe._assemble(bpe.VOCABULARY)(iter([batch]))).to_pylist()[0]
    assert out["token_ids"] == e.plain(data).tolist() and out["round_trip"]


def test_bpe_repairs_any_seams():
    e = bpe.Encoder(bpe.VOCABULARY)
    rng = np.random.default_rng(3)
    alphabet = list("ab  \n'sé😀1!") + ["the ", " ing"]
    for _ in range(300):
        data = "".join(rng.choice(alphabet, rng.integers(5, 120))).encode()
        ok = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
        ends = np.array(sorted(set(rng.choice(ok, min(len(ok), 4)).tolist())) + [len(data)])
        shared = {i: e.plain(data[(ends[i - 1] if i else 0) : ends[i]]) for i in range(len(ends)) if rng.random() < 0.6}
        assert e.encode(data, ends, shared).tolist() == e.encoding.encode_ordinary(data.decode())


def test_language_on_held_out_rows(spark, sf01):
    docs = table(spark, sf01, "documents")
    machines = language.trained(docs.where("doc_id % 2 = 0"), max_train=200)
    got = language.identified(docs.where("doc_id % 2 = 1"), machines).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() >= 0.97 * got.count()
    assert {p[0] for p in machines.pairs} == {"f", "l"}


def test_language_of_every_row_by_a_loop_over_bytes(spark, sf001):
    """The query's family, language and margin of every document from its machines, n-gram by n-gram in Python."""
    docs = table(spark, sf001, "documents")
    m = language.trained(docs)
    got = {r.doc_id: r for r in language.op1_language_id(spark, sf001).collect()}
    mask, shift = 2**32 - 1, 32 - language.BUCKETS.bit_length() + 1

    def scores(text):
        raw = text.lower().encode()
        letter = [97 <= x < 123 or x >= 128 for x in raw]
        b = [x if ok else 32 for x, ok in zip(raw, letter)]
        found = []
        for i in range(len(b)):
            h = b[i] * 0x9E3779B1 & mask
            if letter[i]:
                found.append(h >> shift)
            if i > 0:
                h2 = (h ^ (b[i - 1] * 0x85EBCA77 + 0x165667B1 & mask)) * 0xC2B2AE3D & mask
                if letter[i] or letter[i - 1]:
                    found.append(h2 >> shift)
                if i > 1 and letter[i - 1]:
                    found.append((h2 ^ (b[i - 2] * 0x27D4EB2F + 0x9E3779B1 & mask)) * 0x85EBCA6B % 2**32 >> shift)
        return np.bincount(found, minlength=language.BUCKETS) @ m.weights / max(len(found), 1) + m.bias

    def winner(names, kind, s):
        wins, total, least = ({n: z for n in names} for z in (0, 0.0, np.inf))
        for (k, a, b), v in zip(m.pairs, s):
            if k == kind and a in wins and b in wins:
                for n, x, won in ((a, v, v > 0), (b, -v, v <= 0)):
                    wins[n] += won
                    total[n] += x
                    least[n] = min(least[n], x)
        best = max(names, key=lambda n: (wins[n], total[n]))
        return best, least[best]

    families = sorted({language.family(v) for v in m.languages})
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].language == "und"
            continue
        s = scores(r.text)
        fam, low = winner(families, "f", s)
        own = [v for v in m.languages if language.family(v) == fam]
        lang, close = winner(own, "l", s)
        assert (got[r.doc_id].family, got[r.doc_id].language) == (fam, lang)
        assert got[r.doc_id].margin == pytest.approx(min(low, close), abs=2e-6)


def test_languages_without_lettered_texts(spark):
    rows = [(1, "der Hund und die Katze", "en"), (2, None, "de"), (3, "123", "nl"), (4, "le chat", "fr"), (None, "— … “”", "fr"), (None, "le chien", "fr"), (5, "。", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = language.trained(docs)
    assert m.languages == ["en", "fr"] and m.pairs == [("f", "germanic", "romance")]
    got = [(r.doc_id, r.language) for r in language.identified(docs, m).collect()]
    assert {v for i, v in got if i in (2, 3, 5)} == {"und"} and ("und" in {v for i, v in got if i is None})
    only = docs.where("lang IN ('de', 'nl')")
    assert {r.language for r in language.identified(only, language.trained(only)).collect()} == {"und"}


def test_equal_texts_have_equal_scores_wherever_they_lie():
    rng = np.random.default_rng(8)
    text = "the cat sat on the mat and der Hund lief " * 5
    others = ["".join(rng.choice(list("abcdefgh "), rng.integers(0, 400))) for _ in range(50)]
    m = language.train(pa.array(["the cat sat", "der Hund lief", "le chat dort"]), ["en", "de", "fr"])
    at = language.predict(pa.array([x for o in others for x in (o, text)]), m)
    assert len({(f, v, s) for f, v, s in zip(*(x[1::2] for x in at))}) == 1


def test_language_scores_are_those_of_feature_vectors():
    rows = ["the cat sat", "der Hund lief über", "le chat dort là", "el niño está", "the dog", "die Katze"] * 4
    langs = ["en", "de", "fr", "es", "en", "de"] * 4
    m = language.train(pa.array(rows), langs)
    s = language.features(pa.array(rows)) @ m.weights + m.bias
    fam = ["germanic" if x > 0 else "romance" for x in s[:, 0]]
    assert language.predict(pa.array(rows), m)[0] == fam


@pytest.fixture(scope="module")
def toxic(spark):
    """The model, scores and labels of the largest table: labels enough for the lexicons of every language."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model, _ = toxicity.fit(docs, labels)
    return docs, labels, model, {r.doc_id: (r.score, r.toxic) for r in toxicity.toxicity(docs, labels).collect()}


def test_toxicity_on_labels(spark, toxic):
    docs, labels, _, score = toxic
    truth = {r.doc_id: (r.toxic, r.lang) for r in labels.join(docs.select("doc_id", "lang"), "doc_id").collect()}
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([score[i][1] for i, (t, v) in truth.items() if t and v == lang]) >= 0.75, lang
    assert np.mean([score[i][1] for i, (t, _) in truth.items() if not t]) <= 0.01


def test_toxicity_scores_are_those_of_a_loop_over_words(spark, toxic):
    """Every document's hits and score, taken word by word in Python from the model's lexicons and weights."""
    docs, _, model, score = toxic
    lexicon = model.lexicon
    known = {w: (frozenset(int(x) for x in a)) for w, a in (("insults", lexicon.insults), ("words", lexicon.words), *lexicon.beginnings.items())}
    kept: dict[bytes, int] = {}

    def hashed(word):
        if word not in kept:
            kept[word] = int(_bytes.span_hash(_bytes.prefix_hash(np.frombuffer(word, dtype=np.uint8)), np.array([0]), np.array([len(word)]))[0])
        return kept[word]

    threats = {(a.encode(), b.encode()) for v, o in toxicity.THREATS for a in v for b in o}
    for r in docs.where("doc_id % 4 = 0").select("doc_id", "text").collect():
        w = words(r.text or "")
        n = dict.fromkeys(("insults", "mined", "beginnings"), 0)
        different = set()
        for i, word in enumerate(w):
            h = hashed(word)
            plain = bytes(toxicity.DISGUISE.get(x, x) for x in word)
            mixed = any(48 <= x < 58 for x in word) and not word.isdigit()
            insult = h in known["insults"] or (mixed and hashed(plain) in known["insults"]) or tuple(w[i : i + 2]) in threats
            mined = h in known["words"]
            begun = any(size <= len(word) and hashed(word[:size]) in known[size] for size in lexicon.beginnings)
            n["insults"] += insult
            n["mined"] += mined
            n["beginnings"] += begun
            if insult or mined or begun:
                different.add(h)
        x = [1.0, *np.log1p([n["insults"], n["mined"], n["beginnings"], len(different)]), float(len(different) > 1), min(50 * sum(n.values()) / max(len(w), 1), 1)]
        bits = {h % toxicity.HASHED for h in different}
        total = float(np.dot([*x, *(float(i in bits) for i in range(toxicity.HASHED))], model.weights))
        assert score[r.doc_id][0] == pytest.approx(1 / (1 + np.exp(-max(min(total, 30), -30))), abs=2e-6), r.doc_id


def test_label_model_posterior_by_enumeration(toxic):
    """P(y | votes) from the model's parameters, with all voters multiplied out one by one."""
    m = toxic[2].labels
    for pattern, p in zip(m.patterns.tolist(), m.posterior):
        joint = [1 - m.prior, m.prior]
        for i, parent in enumerate(m.parent):
            above = (pattern >> parent) & 1 if parent >= 0 else 0
            for y in (0, 1):
                f = m.fire[i, y, above]
                joint[y] *= f if (pattern >> i) & 1 else 1 - f
        want = joint[1] / sum(joint)
        assert min(p, 1 - p) == pytest.approx(min(want, 1 - want), abs=1e-9)


def test_disguises_and_threats():
    texts = ["an 1d10t said", "I will kill you", "you kill them all", "kill. The you", "4 5 1d", None, "du Dummkopf"]
    got = toxicity.hits(pa.array(texts), toxicity.Lexicon())
    bit = lambda v: ((got["pattern"] >> toxicity.VOTERS.index(v)) & 1).tolist()
    assert bit("disguised") == [1, 0, 0, 0, 0, 0, 0] and bit("threats") == [0, 1, 1, 0, 0, 0, 0]
    assert bit("insults_de") == [0, 0, 0, 0, 0, 0, 1] and bit("clean") == [0, 0, 0, 1, 1, 1, 0]


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    m = len(toxicity.VOTERS)
    fire = np.where(y[:, None], rng.random((len(y), m)) < 0.7, rng.random((len(y), m)) < 0.03)
    fire[:, 1] = np.where(rng.random(len(y)) < 0.9, fire[:, 0], fire[:, 1])  # a correlated pair
    fire[:, -1] = ~fire[:, :-1].any(1)
    pattern = (fire << np.arange(m)).sum(1)
    patterns, counts = np.unique(pattern, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert model.accuracies()["mined_0"][0] == pytest.approx(0.7, abs=0.05)
    assert model.parent[1] == 0 or model.parent[0] == 1


def test_loser_tree_merges_like_sorting():
    rng = np.random.default_rng(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        for _ in range(20):
            runs = [sorted(rng.integers(0, 30, rng.integers(0, 25)).tolist()) for _ in range(k)]
            out = [(v, r) for r, s, e in warc_index.merge(runs) for v in runs[r][s:e]]
            assert out == sorted((v, r) for r, run in enumerate(runs) for v in run)


def brute_quality(docs, labels):
    """The doc_ids kept: measures, halves, scores, sequence and exact tails in plain Python."""
    share = lambda pattern, s: sum(len(x) for x in re.findall(pattern, s)) / max(len(s), 1)
    values = {}
    for i, r in docs.items():
        s = r.text or ""
        w, lines = re.split("[ \n]+", s), [x for x in s.split("\n") if x]
        letters = sum(not (c.isalpha() and unicodedata.category(c).startswith("L")) and c not in " \n\r\t" for c in s)
        values[i] = {
            "symbols": share(r"[&*$%#]{3}", s), "shouting": share("!!", s), "pipes": 3 * s.count("|") / max(len(s), 1), "repeats": sum(a == b for a, b in zip(w, w[1:])) / len(w),
            "capitals": share("[A-Z]", s), "nonletters": letters / max(len(s), 1), "digits": share("[0-9]", s), "long_words": share(r"[^ \n\r\t]{41,}", s),
            "same_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "open_lines": sum(x[-1] not in quality.CLOSERS for x in lines) / max(len(lines), 1),
        }
    held = {}
    for i, good in labels:
        if i in docs and good is not None:
            r = docs[i]
            key = (r.lang or "und", hashlib.md5((r.text or "").encode()).hexdigest())
            held[key] = (max(good, held[key][0] if key in held else 0), values[i])
    strata = {k[0] for k in held}
    on = {}
    for stratum in strata:
        halves = [[v for k, v in held.items() if k[0] == stratum and (k[1][0] < "8") == h] for h in (True, False)]
        best = []
        for rule in quality.RULES:
            scored = [(sum((1 if not g else -quality.PRICE) for g, v in halves[0] if v[rule] >= c), c) for c in quality.CUTOFFS]
            if max(scored)[0] > 0:
                best.append((-max(scored)[0], rule, max(scored)[1]))
        good = [v for g, v in halves[1] if g == 1]
        on[stratum] = []
        for step in range(len(best)):
            rules = sorted(best)[: step + 1]
            k, n, e = sum(any(v[r] >= c for _, r, c in rules) for v in good), len(good), Fraction(quality.EPSILON)
            tail = sum(math.comb(n, i) * e**i * (1 - e) ** (n - i) for i in range(k + 1))
            if not n or tail > quality.DELTA / len(strata):
                break
            on[stratum] = rules
    return {i for i, r in docs.items() if not any(values[i][rule] >= c for _, rule, c in on.get(r.lang or "und", []))}, on


def brute_groups(sets):
    """The least doc_id of each document's group, by all pairs that share a shingle."""
    by, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for d in s:
            by.setdefault(d, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for those in by.values():
        for n, a in enumerate(those):
            for b in those[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a], sets[b]
                    if sum(min(x[d], y[d]) for d in x.keys() & y.keys()) * 4 >= max(sum(x.values()), sum(y.values())) and find(a) != find(b) and j_p(x, y) >= near_dup.THRESHOLD:
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {i: find(i) for i in sets}


def brute_copies(docs):
    """How often each document is drawn."""
    cells = {}
    for i, r in docs.items():
        cells.setdefault(r.source or "", []).append((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % mixing.BLOCKS, i))
    size = {s: sum(len(docs[i].text or "") for _, i in those) for s, those in cells.items()}
    weights, out = sum(math.sqrt(v) for v in size.values()), Counter()
    for s, those in cells.items():
        rate = math.floor(min(math.sqrt(size[s]) / weights * sum(size.values()) / size[s], mixing.MAX_EPOCHS) * mixing.ONE)
        at = int(hashlib.md5(f"{s}|{mixing.SEED}".encode()).hexdigest()[:5], 16)
        for _, i in sorted(those):
            out[i] = (at + rate) // mixing.ONE - at // mixing.ONE
            at += rate
    return +out


def test_pipeline_against_brute_force(spark, sf01):
    """The pipeline's rows, copies and tokens against the decisions of all five stages taken one by one in Python (of toxicity the model is
    the operator's, held against a loop over words above; here every document's verdict is asked for by its own text alone)."""
    import corpus_pipeline

    docs = {r.doc_id: r for r in table(spark, sf01, "documents").collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, sf01, "labels").collect()]
    model, _ = toxicity.fit(table(spark, sf01, "documents"), table(spark, sf01, "labels"))
    clean = {i: r for i, r in docs.items() if toxicity._score(toxicity.hits(pa.array([r.text]), model.lexicon), model.weights)[0] < 0.5}
    kept, rules = brute_quality(clean, labels)
    assert rules["en"] and 0 < len(clean) - len(kept) < len(clean) / 5 and 0 < len(docs) - len(clean) < len(docs) / 5
    good = {i: clean[i] for i in kept}
    groups = brute_groups({i: weighted(r.text or "") for i, r in good.items()})
    want = brute_copies({i: good[i] for i in good if groups[i] == i})
    rows = corpus_pipeline.run(spark, sf01).collect()
    assert Counter(r.doc_id for r in rows) == want
    e = bpe.encoding()
    assert all(r.token_ids == e.encode_ordinary(docs[r.doc_id].text) and r.round_trip for r in rows)
