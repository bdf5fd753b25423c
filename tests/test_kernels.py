"""Kernels against slow forms written from their definitions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semblance.operators import kernels as K


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def slow_clusters(v, groups, threshold, cost):
    """Merges the closest allowed pair of clusters until none is within the threshold."""
    clusters = [[i] for i in range(len(v))]
    while True:
        best = None
        for a, b in itertools.combinations(clusters, 2):
            if groups and {groups[i] for i in a} & {groups[i] for i in b}:
                continue
            d = cost([np.linalg.norm(v[i] - v[j]) for i in a for j in b])
            if d <= threshold * (1 + 1e-12) and (best is None or d < best[0] - 1e-12):
                best = d, a, b
        if best is None:
            break
        clusters.remove(best[2])
        best[1].extend(best[2])
        clusters.sort(key=min)
    out = np.zeros(len(v), dtype=int)
    for k, c in enumerate(clusters):
        out[c] = k
    return out


@given(st.integers(0, 10_000), st.integers(0, 14), st.floats(0.6, 1.5), st.booleans())
@settings(max_examples=60, deadline=None)
def test_average_linkage(seed, n, threshold, grouped):
    rng = np.random.default_rng(seed)
    v, groups = unit(rng, n, 4), [int(g) for g in rng.integers(0, max(1, n // 2), n)] if grouped else None
    assert K.cluster(v, threshold, groups).tolist() == slow_clusters(v, groups, threshold, np.mean).tolist()


@given(st.integers(0, 10_000), st.floats(0.8, 1.6))
@settings(max_examples=40, deadline=None)
def test_merging_clusters_by_rms(seed, threshold):
    rng = np.random.default_rng(seed)
    v, owner = unit(rng, 18, 4), np.sort(rng.integers(0, 6, 18))
    photos = rng.integers(0, 12, 18)
    first = [np.flatnonzero(owner == k) for k in np.unique(owner)]
    got = K.merge_clusters(np.array([v[m].mean(0) for m in first]), np.array([len(m) for m in first]), [set(photos[m].tolist()) for m in first], threshold)
    clusters = [list(m) for m in first]
    label = list(range(len(first)))
    while True:
        best = None
        for i, j in itertools.combinations(sorted(set(label)), 2):
            a, b = ([m for k, c in enumerate(clusters) if label[k] == x for m in c] for x in (i, j))
            if set(photos[a]) & set(photos[b]):
                continue
            d = np.sqrt(np.mean([np.linalg.norm(v[x] - v[y]) ** 2 for x in a for y in b]))
            if d <= threshold and (best is None or d < best[0] - 1e-12):
                best = d, i, j
        if best is None:
            break
        label = [best[1] if x == best[2] else x for x in label]
    assert got.tolist() == np.unique(label, return_inverse=True)[1].tolist()


def test_small_cases():
    v = np.array([[1.0, 0], [1.0, 0]])
    assert K.cluster(v, 1.0, ["p", "p"]).tolist() == [0, 1]  # one photo: two people
    assert K.cluster(v, 0.0, ["p", "q"]).tolist() == [0, 0]  # the threshold is inclusive
    assert K.cluster(np.zeros((0, 2)), 1.0).tolist() == [] and K.cluster(v[:1], 1.0).tolist() == [0]
    with pytest.raises(MemoryError):
        K.cluster(np.zeros((5, 2)), 1.0, None, limit=4)
    assert K.mean_pairwise(v[:1]) == 0.0
    square = np.array([[0.0, 0], [1, 0], [0, 5], [1, 5]])
    assert K.cluster(square, 1.0).tolist() == [0, 0, 1, 1]  # ties go to the lowest pair


def test_quorum_of_small_banks():
    bank = np.array([[1.0, 0]])
    assert K.quorum_distances(np.array([[0.0, 0]]), bank, 3).tolist() == [1.0]


def test_batches():
    assert K.plan_batches(["a", "b", "c"], [900, 10, 10], 100, 9) == [0, 1, 1]  # an oversize file stands alone
    assert K.plan_batches(["a", "a"], [1, 1], 100, 9) == [0, 1]  # a name repeats
    assert K.plan_batches(["a", "b"], [50, 50], 100, 9) == [0, 0]  # the limit is inclusive
    assert K.plan_batches(["a", "b", "c"], [1, 1, 1], 100, 2) == [0, 0, 1]


def decide(g, key, v, found=True, barred=frozenset(), coherence=9.0):
    return g.decide(key, np.asarray(v, dtype=float), 1.0, 1.2, coherence, found, set(barred))


def test_decisions():
    g = K.Graph()
    assert decide(g, "a:0", [1, 0], found=False) == K.Decision("a:0", None, None, "uncertain")
    assert decide(g, "a:0", [1, 0]) == K.Decision("a:0", "person_001", 0.0, "assigned")
    assert decide(g, "b:0", [0.9, 0]).person == "person_001"
    assert decide(g, "b:1", [0.9, 0], barred={"person_001"}).person == "person_002"
    assert decide(g, "c:0", [2.15, 0]).status == "uncertain"  # between match and new
    assert decide(g, "d:0", [9, 0], found=False).status == "uncertain"


def test_incoherent_best_match_has_no_second_choice():
    g = K.Graph()
    g.people = {"person_001": K.Person.of(["a:0", "b:0"], [np.array([0.0, 0]), np.array([0.2, 0])]), "person_002": K.Person.of(["c:0"], [np.array([1.7, 0])])}
    d = g.decide("d:0", np.array([0.8, 0]), 1.0, 1.2, 0.4, True, set())
    assert (d.person, d.status) == (None, "uncertain")


def test_split_and_reconcile():
    g = K.Graph(sequence=1)
    near, far = [np.array([0.0, 0]), np.array([0.1, 0])], [np.array([5.0, 0])]
    g.people["person_001"] = K.Person.of(["a:0", "b:0", "c:0"], near + far)
    assert g.split(1.0, 1.0) == {"c:0": "person_002"}
    g.people["person_003"] = K.Person.of(["a:1"], [np.array([0.05, 0])])
    assert K.Graph.reconcile(g, 0.5, 1.0, exclusion=True) == {}  # they share photo a
    assert g.reconcile(0.5, 1.0) == {"person_003": "person_001"}


def test_rediscovered_people_are_pairs_at_least():
    g = K.Graph()
    v = [np.array([0.0, 0]), np.array([0.1, 0]), np.array([9.0, 0])]
    assert g.rediscover(["a:0", "b:0", "c:0"], ["a", "b", "c"], v, 1.0, 1.0) == {"a:0": "person_001", "b:0": "person_001"}


def test_loose_items_of_one_photo():
    rows = [(0, "x", [("p", 0.1), ("q", 0.2)]), (1, "y", [("p", 0.05), ("q", 0.9)])]
    assert K.resolve_quorum(rows, {}, 0.5) == [("x", "p", 0.1)]  # y's only free one is too far
    assert K.resolve_quorum(rows, {"p": 1}, 0.5) == [("x", "q", 0.2)]
