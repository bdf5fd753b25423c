"""Linkage without a matrix equals linkage with one."""

import numpy as np
import pytest

from semblance.operators import kernels, nearest


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    if seed % 3 == 0:
        return rng.integers(0, 5, size=(n, 2)).astype(float), 1.2
    centres = rng.normal(size=(20, 6))
    v = rng.normal(size=(n, 8)) if seed % 3 == 1 else centres[rng.integers(20, size=n)] + 0.3 * rng.normal(size=(n, 6))
    return v / np.linalg.norm(v, axis=1)[:, None], 0.9


@pytest.mark.parametrize("seed", range(6))
def test_nearest_neighbours_merge_as_the_matrix(monkeypatch, seed):
    monkeypatch.setattr(nearest, "ROWS", 37)
    monkeypatch.setattr(nearest, "COLUMNS", 53)
    monkeypatch.setattr(nearest, "PAIRS", 40)
    rng, (v, threshold) = np.random.default_rng(seed), vectors(seed, 260)
    photos = [f"p{x}" for x in rng.integers(0, 120, len(v))]
    for groups in (None, photos):
        assert (kernels.linked(v, threshold, groups, many=1) == kernels.cluster(v, threshold, groups)).all()
    if seed % 3:
        sizes = rng.integers(1, 5, len(v))
        held = [{f"p{x}" for x in rng.integers(0, 400, k)} for k in sizes]
        centroids = v * rng.uniform(0.8, 1, len(v))[:, None]
        assert (kernels.merge_clusters(centroids, sizes, held, threshold, many=1) == kernels.merge_clusters(centroids, sizes, held, threshold)).all()


def test_many_items_need_no_matrix():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12_500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    # over the limit of the kernel with a matrix, which refuses it
    labels = kernels.linked(v, 0.4, None)
    with pytest.raises(MemoryError):
        kernels.cluster(v, 0.4, None)
    assert len(labels) == 12_500 and 1 < labels.max() < 12_499


@pytest.mark.parametrize("seed", range(3))
def test_forests_connect_what_is_near(monkeypatch, seed):
    monkeypatch.setattr(nearest, "ROWS", 11)
    monkeypatch.setattr(nearest, "COLUMNS", 17)
    v, threshold = vectors(seed, 120)
    threshold /= 3
    for x, y in ((v, None), (v[:70], v[70:])):
        i, j = nearest.near_forest(x, y, threshold)
        base, other = (0, x) if y is None else (len(x), y)
        near = np.array([(a, base + b) for a in range(len(x)) for b in range(len(other)) if a != base + b and np.linalg.norm(x[a] - other[b]) <= threshold]).reshape(-1, 2)

        def parts(pairs, n=base + len(other)):
            of = np.arange(n)
            for p, q in pairs:
                of[of == max(of[p], of[q])] = min(of[p], of[q])
            return of.tolist()

        assert parts(near) == parts(np.column_stack([i, base + j])) and len(i) < base + len(other)


@pytest.mark.parametrize("seed", range(4))
def test_the_nearest_person_is_found_among_few(seed):
    rng = np.random.default_rng(seed)
    v, _ = vectors(1 + seed % 2, 300)
    g = kernels.Graph(3)
    for k, own in enumerate(np.split(np.arange(200), np.sort(rng.choice(np.arange(1, 200), 40, replace=False)))):
        g.people[f"p{k:02d}"] = kernels.Person.of([f"x{i}:0" for i in own], list(v[own]))

    def slow(x, barred):
        scores = [(float(np.sort(p.distances(x))[:3].mean()), k, n) for k, (n, p) in enumerate(g.people.items()) if n not in barred]
        return (min(scores)[2], min(scores)[0]) if scores else (None, None)

    for at in range(200, 300, 10):
        g.ahead(v[at : at + 10])
        for i in range(at, at + 10):
            barred = set(rng.choice(list(g.people), 5).tolist())
            assert g.nearest(v[i], barred) == slow(v[i], barred) and g.nearest(v[i], set(g.people)) == (None, None)
            g.decide(f"x{i}:0", v[i], 0.8, 0.9, 2.0, True, barred)


def test_a_run_with_many_uncertain_faces_finds_people_among_them():
    n = 12_400
    v = np.random.default_rng(5).normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    # more than the kernel with a matrix takes
    found = kernels.Graph().rediscover([f"ph{i}:0" for i in range(n)], [f"ph{i}" for i in range(n)], list(v), 0.4, 0.5)
    assert 2 < len(found) < n
