import zlib
from collections import Counter, defaultdict

import numpy as np

from semblance.llm import sharding as S


def check(rows, docs):
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_sizes_near_equal_and_groups_together(spark, docs):
    rng = np.random.default_rng(0)
    texts = ["hot " * 10] * 900 + [f"t{i // 3} " * int(rng.integers(5, 30)) if i % 3 else f"t{i} x" for i in range(2400)]
    rows = list(enumerate(texts))
    got = S.shard(docs(*rows)).collect()
    sizes = check(got, rows)
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * sum(sizes.values()) / 16
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
    shards = defaultdict(set)
    for r in got:
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert {t for t, s in shards.items() if len(s) > 1} == {"hot " * 10} and len(shards["hot " * 10]) < 6
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["key"] for r in order] == sorted(r["key"] for r in got)


def test_odd_rows(spark, odd):
    check(S.shard(odd).collect(), odd.collect())
    assert S.shard(odd.limit(0)).count() == 0
    assert Counter(r["doc_id"] for r in S.shard(odd, 3).collect())[4] == 2


def test_only_groups_over_a_shard_are_cut(spark, docs):
    """Groups of about a twentieth to nine tenths of a shard stay whole, and splitters stand at the nearest edges."""
    rng = np.random.default_rng(1)
    groups = [(f"group {g} ", int(rng.integers(1, 90))) for g in range(260)]
    rows = [(i, t) for i, t in enumerate(t for t, n in groups for _ in range(n))]
    df = docs(*rows)
    got = S.shard(df).collect()
    sizes = check(got, rows)
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    total = sum(sizes.values())
    assert max(n * (len(t) + 1) for t, n in groups) < total / 16 and all(len(s) == 1 for s in shards.values())
    # brute force: the bytes below every edge of a group, and for each target the nearest of them
    weight = Counter()
    for r in got:
        weight[r["key"] >> S.SPLIT_BITS] += r["size"]
    below = np.cumsum([0, *(weight[k] for k in sorted(weight))])
    for i in range(1, 16):
        goal, cut = total * i / 16, sum(n for s, n in sizes.items() if s < i)
        assert abs(cut - goal) <= max(np.abs(below - goal).min(), S.TOLERANCE * total / 16) + 1e-6
