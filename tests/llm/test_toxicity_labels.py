"""The toxicity lexicons against all labelled rows."""

import numpy as np
import pyarrow as pa

from lexiflow.llm import _bytes, toxicity


def found(lexicon, words):
    return {w for w in words if _bytes.Words(pa.array([w])).hash[0] in lexicon.words}


def frames(spark, rows):
    docs = [(i, text) for i, (text, _) in enumerate(rows)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")


def prose(rng, n):
    return [" ".join(f"w{x:x}q" for x in row) for row in rng.integers(0, 3000, (n, 14))]


def test_rare_toxic_words_among_many_labels(spark):
    rare = [f"{c}lobivec" for c in "abcdefgh"]
    rows = [(t, 0) for t in prose(np.random.default_rng(1), 30_000)]
    for k, word in enumerate(rare):
        for i in range(4):
            at = 3571 * (k + 1) + 17 * i
            rows[at] = (rows[at][0] + " " + word, 1)
    assert found(toxicity.mined_lexicon(*frames(spark, rows)), rare) == set(rare)


def test_clean_look_alikes_do_not_remove_toxic_texts(spark):
    rng = np.random.default_rng(2)
    rare = [f"{c}lobivec" for c in "abcd"]
    clean = [" ".join(prose(rng, 5)) for _ in range(400)]
    passage = " ".join(prose(rng, 3))  # in every toxic text, and in some clean ones
    rows = [(t if i % 8 else f"{t} {passage}", 0) for i, t in enumerate(clean)]
    rows += [(f"{clean[7 * i + 1]} {rare[i % 4]} {passage}", 1) for i in range(32)]
    assert found(toxicity.mined_lexicon(*frames(spark, rows)), rare) == set(rare)


def test_copies_of_a_toxic_text_count_once(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(prose(rng, 5)), 0) for _ in range(400)]
    text = " ".join(f"common{i}" for i in range(80)).split()
    copies = [(" ".join(text[:i] + [f"other{i}"] + text[i + 1 :]), 1) for i in range(0, 80, 2)] + [(" ".join(text), 1)] * 5
    toxic = [(" ".join(prose(rng, 5)) + " zlobivec", 1) for _ in range(4)]
    assert found(toxicity.mined_lexicon(*frames(spark, rows + copies + toxic)), [*text, "zlobivec"]) == {"zlobivec"}
