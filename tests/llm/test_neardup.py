import random

import numpy as np
import pytest

from semblance.llm import neardup as N


def slow_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_classes_equal_brute_force(spark, docs):
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randint(3, 200))
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]
    hub = words(rng, 150)  # a large group: copies resemble the first text more than each other
    rows += [" ".join(edited(rng, hub, rng.randint(1, 4))) for _ in range(70)] + [" ".join(hub)]
    shared = words(rng, 60)  # a passage that many texts share
    rows += [" ".join(words(rng, 120) + shared) for _ in range(30)]
    rows += [rows[0], rows[0], "", None, " "]
    order = list(range(len(rows)))
    rng.shuffle(order)
    table = [(k, rows[i]) for k, i in enumerate(order)]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(docs(*table)).collect()}
    assert got == slow_classes(table)


def test_odd_rows(spark, docs, odd):
    got = [(r["doc_id"], r["class_id"]) for r in N.classes(odd.selectExpr("*", "1 AS class_id", "2 AS sig")).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert N.classes(odd.limit(0)).count() == 0
    kept = N.first_of_each(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8] and kept.columns == odd.columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 400), rng.uniform(0.1, 5, 400)
    s = N.dart_signatures(np.concatenate([e, e]), np.repeat([0, 1], 400), 2, 4000, np.concatenate([a, b]))
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    # equal sets have equal signatures, in any order and company
    one = N.dart_signatures(e[::-1], np.zeros(400, dtype=int), 1)
    two = N.dart_signatures(np.concatenate([e[:5], e]), np.repeat([0, 1], [5, 400]), 2)
    assert (one[0] == two[1]).all()


def test_blocks_find_all_pairs(monkeypatch, spark, docs):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(2)
    base = words(rng, 200)
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(docs(*rows)).collect()}
    assert got == slow_classes(rows)


def test_rows_without_an_id_or_with_a_repeated_one(spark, docs):
    rng = random.Random(8)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    big = 2**60 + 1  # more than a float holds
    rows = [(None, " ".join(a)), (None, " ".join(b)), (big, " ".join(edited(rng, b, 1))), (7, " ".join(c)), (7, " ".join(d)), (7, " ".join(d)), (None, " ".join(e)), (None, " ".join(edited(rng, e, 1)))]
    rows += [(None, None), (None, ""), (9, " "), (9, " ")]
    got = [(r["doc_id"], r["class_id"]) for r in N.classes(docs(*rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, None), (None, big), (big, big), *[(7, 7)] * 3, *[(None, None)] * 4, *[(9, 9)] * 2], key=repr)
    kept = [(r["doc_id"], r["text"]) for r in N.first_of_each(docs(*rows)).collect()]
    one_of_e = [k for k in kept if k in rows[6:8]]
    assert len(one_of_e) == 1
    want = [rows[0], rows[2], rows[3], rows[4], *one_of_e, (None, None), (None, ""), (9, " ")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
