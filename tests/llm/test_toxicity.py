import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from semblance.llm import toxicity as T

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "se", "ra", "lo", "ni") for b in ("den", "lam", "rot", "sil", "ver", "pon")]
BAD = ("idiot", "moron", "stupid", "pathetic")


def corpus(n, seed, spell=lambda w, rng: w):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = spell(rng.choice(BAD), rng)
        rows.append((i, " ".join(words), toxic))
    return rows


def doubled(w, rng):
    k = rng.randrange(1, len(w))
    return w[:k] + w[k - 1] + w[k:]


def test_held_out_accuracy_with_unseen_spellings():
    train = corpus(600, 1)
    model = T.train([t for _, t, _ in train], [y for _, _, y in train])
    for spell, least in ((lambda w, r: w, 0.99), (doubled, 0.9)):
        test = corpus(400, 2, spell)
        got = T.scores(model, pa.array([t for _, t, _ in test])) >= T.THRESHOLD
        assert sum(g == bool(y) for g, (_, _, y) in zip(got, test, strict=True)) / len(test) >= least


def test_scores_of_a_table(spark, docs, odd):
    rows = corpus(500, 3)
    df = docs(*((i + 10, t) for i, t, _ in rows)).unionByName(odd)
    labels = spark.createDataFrame([(i + 10, y) for i, _, y in rows] + [(1, None), (2, 0)], "doc_id long, toxic int")
    model = T.fit(df, labels)
    got = T.score(df, model).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"] for r in T.keep(df, labels).collect()}
    held = [(i + 10, y) for i, _, y in rows if zlib.crc32(str(i + 10).encode()) % 3 == 1]
    assert sum((i in kept) == (y == 0) for i, y in held) >= 0.97 * len(held)
    assert T.keep(df, labels).columns == df.columns
    # one class of labels: nothing is toxic; a column named score stays
    none = T.fit(df, labels.where("toxic = 0"))
    assert {r["score"] for r in T.score(df, none).collect()} == {T.score(df, none).first()["score"]}
    assert T.keep(df.withColumnRenamed("lang", "score"), labels).columns[2] == "score"
    assert T.score(df.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark, docs):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1][:40]
    df = docs(*((i, "idiot" if k % 2 else "kind") for k, i in enumerate(ids)))
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    assert not T.fit(df, labels).logit.any()


def test_scores_are_the_softmax_of_the_weighted_average():
    rng = np.random.default_rng(5)
    model = T.Model(rng.normal(0, 3, T.BUCKETS).astype(np.float32), rng.normal(0, 1, T.BUCKETS).astype(np.float32), 0.3)
    texts = ["One two two THREE, na\u00efve", None, "", "idiot", " a\u2003b\n", "x" * 5000]

    def one(text):
        words = sorted(set((text or "").lower().split()))
        if not words:
            return 1 / (1 + math.exp(-0.3))
        bags = [T.subwords([w])[0] for w in words]
        pull = [math.exp(np.mean([float(model.attention[b]) for b in bag])) for bag in bags]
        z = sum(a * np.mean([float(model.logit[b]) for b in bag]) for a, bag in zip(pull, bags)) / sum(pull)
        return 1 / (1 + math.exp(-z - 0.3))

    got = T.scores(model, pa.array(texts, pa.string()))
    assert got.tolist() == pytest.approx([one(t) for t in texts], rel=1e-6)
    assert len(T.scores(model, pa.array([], pa.string()))) == 0
