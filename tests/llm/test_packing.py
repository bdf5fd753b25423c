import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semblance.llm import packing as P


def test_pieces_have_the_tokenizers_ids(spark, docs, odd):
    from tokenizers import Tokenizer

    path = P.tokenizer_path()
    tok = Tokenizer.from_file(path)
    df = odd.unionByName(docs((20, "It's d\u00e9j\u00e0-vu... O'Neill's 42nd \u0130stanbul \u03a3\u03a3 <|endoftext|> a.b,c !! \u00a0x"), (21, "abc" * 4000)))
    got = P.pack(df, path, 512).collect()
    want = Counter()
    for r in df.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            p = ids[at : at + 512]
            want[r["doc_id"], k, at, len(p), zlib.crc32(p.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 512
    assert P.pack(df.limit(0), path).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=80, deadline=None)
def test_packing_keeps_all_lengths(lengths):
    bins = P.pack_lengths(lengths, 64)
    held = Counter()
    for p, count in bins.items():
        assert count > 0 and sum(n * k for n, k in p) <= 64
        for n, k in p:
            held[n] += k * count
    assert held == Counter(lengths)
    first = P.best_fit(lengths, 64)
    assert sum(bins.values()) <= sum(first.values())
    fill = lambda b: sum(c * sum(n * k for n, k in p) ** 2 for p, c in b.items())
    assert fill(bins) >= fill(first)


def test_search_empties_a_bin():
    # best fit leaves three bins of 10 here; two are enough
    start = Counter({((6, 1),): 1, ((4, 1), (5, 1)): 1, ((5, 1),): 1})
    assert sum(P.improve(start, 10).values()) == 2


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=2, max_size=12), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_search_ends_where_no_pair_gains(lengths, seed):
    rng = np.random.default_rng(seed)
    pieces = [n for n, k in lengths.items() for _ in range(k)]
    bins, own = Counter(), []
    for n in rng.permutation(pieces).tolist():  # a poor start: the next piece that does not fit opens a bin
        if sum(own) + n > 64:
            bins[tuple(sorted(Counter(own).items()))] += 1
            own = []
        own.append(n)
    bins[tuple(sorted(Counter(own).items()))] += 1
    got = P.improve(bins, 64)
    held = Counter()
    for p, c in got.items():
        assert sum(n * k for n, k in p) <= 64
        held.update({n: k * c for n, k in p})
    assert held == Counter(pieces)
    if sum(got.values()) > -(-sum(pieces) // 64):
        total = lambda p: sum(n * k for n, k in p)
        for a, c in got.items():
            for b in got:
                if total(b) <= total(a) < 64 and (a != b or c > 1):
                    assert P._step(a, b, 64) is None


def test_large_histograms_end_soon():
    rng = np.random.default_rng(3)
    lengths = Counter(rng.integers(1, 2049, 60_000).tolist())
    began = time.time()
    bins = P.pack_lengths(lengths)
    assert time.time() - began < 60 and sum(bins.values()) <= 1.02 * sum(n * k for n, k in lengths.items()) / 2048


def test_a_tokenizer_that_is_missing_is_an_error():
    with pytest.raises(Exception):
        P.Encoder("/no/such/file")
