import math
import zlib
from collections import Counter, defaultdict

import pytest

from semblance.llm import katz as L


def slow(rows):
    D, c1, c2, ch = [], Counter(), Counter(), Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "</>"]
        out = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        D.append((i, w, out))
        if not out:
            c1.update(w)
            pairs = list(zip(["<>", *w], w, strict=False))
            c2.update(pairs)
            ch.update(v for v, _ in pairs)
    n, v = sum(c1.values()), len(c1)
    coc = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, L.K + 2)]
    d1, d2 = L.discounts(coc(c1)), L.discounts(coc(c2))
    cut = lambda d, c: c * (d[c] if c <= L.K else 1)
    lost = sum(c - cut(d1, c) for c in c1.values())
    unknown = (lost if lost > 0 else 0.5) / n if n else 1.0
    p1 = lambda w: cut(d1, c1[w]) / n if w in c1 else unknown
    den = lambda c: c + (c > L.K)
    taken, lower, seen = defaultdict(float), defaultdict(float), defaultdict(set)
    for (a, b), c in c2.items():
        taken[a] += cut(d2, c)
        lower[a] += p1(b)
        seen[a].add(b)
    alpha = {a: (1 - taken[a] / den(ch[a])) / (1 - lower[a]) for a in ch}
    p2 = lambda a, b: cut(d2, c2[a, b]) / den(ch[a]) if (a, b) in c2 else alpha.get(a, 1) * p1(b)
    for a in ch:  # each distribution sums to 1 over the known tokens and the unknown one
        assert sum(p2(a, b) for b in c1) + alpha[a] * unknown == pytest.approx(1)
    out = []
    for i, w, o in D:
        out.append((i, o, len(w), sum(x in c1 for x in w), n, sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p2(a, b)) for a, b in zip(["<>", *w], w, strict=False))))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-12) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9), (g, w)


def test_scores_equal_brute_force(spark, docs, odd, monkeypatch):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "The", "a", f"w{rng.randrange(60)}", f"r{rng.randrange(3000)}"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = docs(*enumerate(texts, 50)).unionByName(odd).unionByName(docs((None, "the a the")))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    monkeypatch.setattr(L, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(L, "SAMPLE", 1)
    same(L.score(df.selectExpr("*", "1 AS score")).collect(), slow(rows))


def test_edges(spark, docs):
    assert L.score(docs((1, "x")).limit(0)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = L.score(docs(*((i, "a b") for i in held))).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(0, 0, 0.0)] * 2


def test_discounts_without_counts():
    d = L.discounts([0] * (L.K + 2))
    assert d[1] == 0.5 and all(0 < x < 1 for x in d[1:])
