"""Clustering kernels on plain arrays; no Spark here, so each can be tested alone.

Clusters keep sums of distances, not means: the sum between two merged clusters is the sum of the sums, and a mean is
read off by the sizes. Pairs that may not merge are a boolean matrix that is OR-ed on a merge.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from semblance.operators.nearest import Nearest

#: Means from sums carry rounding of this relative size, so thresholds are inclusive up to it.
SLACK = 1e-12
#: Steps of 1 of a distance in linkage; sums are exact up to 5e8.
GRID = float(1 << 24)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by expansion of the square, clamped at 0."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def gridded(d: np.ndarray) -> np.ndarray:
    """Distances as multiples of 1 / GRID: their sums are exact, so they do not depend on the order of adding."""
    return np.round(d * GRID) / GRID


def mean_pairwise(v: np.ndarray) -> float:
    n = len(v)
    return float(np.triu(pair_distances(v, v), 1).sum() / (n * (n - 1) / 2)) if n > 1 else 0.0


def spanning_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of true cells that connect whatever the true cells connect; at most one for each row and column."""
    new_row, new_column = near.any(axis=1), near.any(axis=0)
    rows, columns = [], []
    while new_row.any():
        front = np.array([np.argmax(new_row)])
        new_row[front] = False
        while len(front):
            reach = np.flatnonzero(near[front].any(axis=0) & new_column)
            new_column[reach] = False
            rows.append(front[near[np.ix_(front, reach)].argmax(axis=0)] if len(reach) else reach)
            columns.append(reach)
            front = np.flatnonzero(near[:, reach].any(axis=1) & new_row) if len(reach) else reach
            new_row[front] = False
            rows.append(front)
            columns.append(reach[near[np.ix_(front, reach)].argmax(axis=1)] if len(front) else front)
    join = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, dtype=np.int64)
    return join(rows), join(columns)


def shares_group(groups: list) -> np.ndarray:
    code = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    ids = np.array([code[g] for g in groups])
    out = ids[:, None] == ids[None, :]
    np.fill_diagonal(out, False)
    return out


class _Agglomeration:
    """Repeated merging of the closest allowed pair. `cost` gives costs of one cluster to all from the state."""

    def __init__(self, n: int, barred: np.ndarray):
        self.size = np.ones(n)
        self.barred = barred.copy()
        self.alive = np.ones(n, dtype=bool)
        self.owner = np.arange(n)
        self.best_at = np.zeros(n, dtype=int)
        self.best = np.full(n, np.inf)

    def row(self, i: int) -> np.ndarray:
        raise NotImplementedError

    def absorb(self, i: int, j: int) -> None:
        raise NotImplementedError

    def _refresh(self, rows) -> None:
        for i in rows:
            later = np.arange(i + 1, len(self.size))
            cost = np.where(self.alive[later] & ~self.barred[i, later], self.row(i)[later], np.inf)
            k = int(np.argmin(cost)) if len(cost) else -1
            self.best_at[i], self.best[i] = (later[k], cost[k]) if k >= 0 else (i, np.inf)

    def run(self, threshold: float) -> np.ndarray:
        self._refresh(range(len(self.size)))
        while len(self.size):
            i = int(np.argmin(np.where(self.alive, self.best, np.inf)))
            if not self.best[i] <= threshold * (1 + SLACK):
                break
            j = int(self.best_at[i])
            self.absorb(i, j)
            self.size[i] += self.size[j]
            self.alive[j] = False
            self.barred[i] |= self.barred[j]
            self.barred[:, i] = self.barred[i]
            self.barred[i, i] = False
            self.owner[self.owner == j] = i
            # rows whose nearest partner was touched, or that may now be nearest to i
            touched = self.alive & ((self.best_at == i) | (self.best_at == j))
            touched[i] = True
            self._refresh(np.flatnonzero(touched))
            earlier = np.flatnonzero(self.alive[:i] & ~self.barred[i, :i])
            cost = self.row(i)[earlier]
            nearer = (cost < self.best[earlier]) | ((cost == self.best[earlier]) & (i < self.best_at[earlier]))
            self.best[earlier[nearer]], self.best_at[earlier[nearer]] = cost[nearer], i
        return np.unique(self.owner, return_inverse=True)[1]


class _Average(_Agglomeration):
    """Items, or the clusters that they are in to begin with, in order of their first items."""

    def __init__(self, vectors: np.ndarray, groups: list | None, start: np.ndarray | None = None):
        n = len(vectors)
        barred = shares_group(groups) if groups is not None else np.zeros((n, n), dtype=bool)
        sums = gridded(pair_distances(vectors, vectors))
        self.within = np.arange(n)
        if start is not None and n:
            self.within = np.unique(start, return_inverse=True)[1]
            order = np.argsort(self.within, kind="stable")
            first = np.flatnonzero(np.diff(self.within[order], prepend=-1))
            sums = np.add.reduceat(np.add.reduceat(sums[np.ix_(order, order)], first, axis=0), first, axis=1)
            barred = np.logical_or.reduceat(np.logical_or.reduceat(barred[np.ix_(order, order)], first, axis=0), first, axis=1)
            np.fill_diagonal(barred, False)
        super().__init__(len(sums), barred)
        self.sums = sums
        self.size = np.bincount(self.within, minlength=len(sums)).astype(float)

    def row(self, i):
        return self.sums[i] / (self.size[i] * self.size)

    def absorb(self, i, j):
        self.sums[i] += self.sums[j]
        self.sums[:, i] = self.sums[i]


class _Rms(_Agglomeration):
    """Clusters of unit vectors by the root mean square of cross distances, read off their plain centroids."""

    def __init__(self, centroids: np.ndarray, sizes: np.ndarray, barred: np.ndarray):
        super().__init__(len(centroids), barred)
        self.size = sizes.astype(float).copy()
        self.total = centroids * self.size[:, None]

    def row(self, i):
        dots = (self.total @ self.total[i]) / (self.size * self.size[i])
        return np.sqrt(np.maximum(2 - 2 * dots, 0))

    def absorb(self, i, j):
        self.total[i] += self.total[j]


def cluster(vectors: np.ndarray, threshold: float, groups: list | None = None, limit: int = 12_000, start: np.ndarray | None = None) -> np.ndarray:
    """Average-linkage labels; two items of one group never meet. Labels count representatives (least members) up. start: the
    clusters that items are in already."""
    if len(vectors) > limit:
        raise MemoryError(f"{len(vectors)} items, over the limit of {limit} of one kernel: use blocks or components")
    linkage = _Average(np.asarray(vectors, dtype=float), groups, start)
    return linkage.run(threshold)[linkage.within]


#: Items and clusters from which linkage looks for nearest neighbours instead of holding a matrix.
MANY = 2000


def linked(vectors: np.ndarray, threshold: float, groups: list | None = None, many: int = MANY) -> np.ndarray:
    """As cluster, for any number of items: over `many`, without a matrix of all pairs."""
    if len(vectors) <= many:
        return cluster(vectors, threshold, groups, many)
    v = np.asarray(vectors, dtype=float)
    return Nearest(v, np.ones(len(v)), [(g,) for g in groups] if groups is not None else [()] * len(v), True).run(threshold)


def merge_clusters(centroids: np.ndarray, sizes: np.ndarray, photos: list[set], threshold: float, many: int = MANY) -> np.ndarray:
    """Labels of clusters merged by RMS; clusters that share a photo never meet, nor what they have merged with."""
    if len(photos) > many:
        return Nearest(np.asarray(centroids, dtype=float), np.asarray(sizes), photos, False).run(threshold)
    barred = np.zeros((len(photos), len(photos)), dtype=bool)
    holders: dict = {}
    for i, own in enumerate(photos):
        for p in own:
            holders.setdefault(p, []).append(i)
    for own in holders.values():
        barred[np.ix_(own, own)] = True
    np.fill_diagonal(barred, False)
    return _Rms(np.asarray(centroids, dtype=float), np.asarray(sizes), barred).run(threshold)


def quorum_distances(items: np.ndarray, bank: np.ndarray, quorum: int) -> np.ndarray:
    """Mean of the quorum nearest distances of each item to one bank."""
    d = pair_distances(items, bank)
    k = min(quorum, d.shape[1])
    return np.partition(d, k - 1, axis=1)[:, :k].mean(axis=1)


class BatchFold:
    """The batch of each entry in order: a new one when a name repeats, bytes pass the limit, or it is full. Entries may come
    in several calls."""

    def __init__(self, max_bytes: float, max_items: int):
        self.max_bytes, self.max_items = max_bytes, max_items
        self.batch, self.used, self.seen = 0, 0, set()

    def take(self, names, sizes) -> list[int]:
        out = []
        for name, size in zip(names, sizes, strict=True):
            if self.seen and (name in self.seen or self.used + size > self.max_bytes or len(self.seen) >= self.max_items):
                self.batch, self.used, self.seen = self.batch + 1, 0, set()
            out.append(self.batch)
            self.used += size
            self.seen.add(name)
        return out


def batch_ends(names, sizes, max_bytes: float, max_items: int) -> np.ndarray:
    """For each entry, the first entry after it that a batch beginning with it cannot take; the number of entries where none is."""
    n = len(names)
    code = pd.factorize(pd.Series(names, dtype=object), use_na_sentinel=False)[0]
    order = np.lexsort((np.arange(n), code))
    again = np.full(n, n)  # the next entry of that name
    same = code[order][1:] == code[order][:-1]
    again[order[:-1][same]] = order[1:][same]
    repeats = np.minimum.accumulate(again[::-1])[::-1] if n else again
    total = np.cumsum(np.asarray(sizes))
    full = np.maximum(np.searchsorted(total, total - np.asarray(sizes) + max_bytes, side="right"), np.arange(n) + 1)
    return np.minimum(np.minimum(repeats, full), np.minimum(np.arange(n) + max(1, max_items), n))


def plan_batches(names: list, sizes: list, max_bytes: float, max_items: int) -> list[int]:
    return BatchFold(max_bytes, max_items).take(names, sizes)


@dataclass
class Person:
    keys: list = field(default_factory=list)
    vectors: list = field(default_factory=list)
    pair_sum: float = 0.0

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.linalg.norm(np.asarray(self.vectors) - v, axis=1)

    def add(self, key: str, v: np.ndarray) -> None:
        if self.vectors:
            self.pair_sum += float(self.distances(v).sum())
        self.keys.append(key)
        self.vectors.append(v)

    def coherence(self) -> float:
        n = len(self.vectors)
        return self.pair_sum / (n * (n - 1) / 2) if n > 1 else 0.0

    def stays_coherent(self, v: np.ndarray, limit: float) -> bool:
        n = len(self.vectors)
        return n < 2 or (self.pair_sum + float(self.distances(v).sum())) / (n * (n + 1) / 2) <= limit

    @classmethod
    def of(cls, keys: list, vectors: list) -> Person:
        p = cls()
        for k, v in zip(keys, vectors, strict=True):
            p.add(k, v)
        return p


@dataclass
class Decision:
    key: str
    person: str | None
    confidence: float | None
    status: str


class _Bank:
    """The vectors of all people in single precision, to find the few people who can be the nearest one."""

    def __init__(self, people: dict[str, Person]):
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.n, self.v, self.square, self.who = 0, np.zeros((0, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, int)
        self.seen, self.products, self.at = 0, None, {}
        for name, p in people.items():
            self.add(name, p.vectors)

    def add(self, name: str, vectors: list) -> None:
        k = self.number.setdefault(name, len(self.names))
        if k == len(self.names):
            self.names.append(name)
        if not len(vectors):
            return
        new = np.asarray(vectors, dtype=float)
        if self.n + len(new) > len(self.v):
            size = max(64, 2 * (self.n + len(new)))
            held = self.v, self.square, self.who
            self.v, self.square, self.who = np.zeros((size, new.shape[1]), np.float32), np.zeros(size, np.float32), np.zeros(size, int)
            for to, old in zip((self.v, self.square, self.who), held, strict=True):
                to[: self.n] = old[: self.n] if len(old) else to[: self.n]
        end = self.n + len(new)
        self.v[self.n : end], self.square[self.n : end], self.who[self.n : end] = new, (new**2).sum(1), k
        self.n = end

    def ahead(self, vectors: np.ndarray) -> None:
        self.seen = self.n
        self.products = np.asarray(vectors, np.float32) @ self.v[: self.n].T
        self.at = {np.asarray(v, dtype=float).tobytes(): i for i, v in enumerate(vectors)}

    def candidates(self, v: np.ndarray, barred: set, quorum: int) -> list[str]:
        """People in their order; the nearest by the mean of quorum distances is among them."""
        i, single = self.at.get(np.asarray(v, dtype=float).tobytes()), np.asarray(v, np.float32)
        dots = self.v[: self.n] @ single if i is None else np.concatenate([self.products[i], self.v[self.seen : self.n] @ single])
        own, square = float((single**2).sum()), self.square[: self.n]
        d, who = np.sqrt(np.maximum(own + square - 2 * dots, 0)), self.who[: self.n]
        # what single precision can hide in a distance
        slack = 2 * float(np.sqrt(3e-5 * max(own, float(square.max(initial=0)))))
        out = np.array([self.number[b] for b in barred if b in self.number], dtype=int)
        if len(out):
            d[np.isin(who, out)] = np.inf
        first = np.argpartition(d, 7)[:8] if len(d) > 8 else np.arange(len(d))
        people, means = self._means(np.unique(who[first]), d, quorum)
        bound = means.min(initial=np.inf) + slack
        people, means = self._means(np.unique(who[d <= bound]), d, quorum)
        return [self.names[k] for k in people[(means <= means.min(initial=np.inf) + slack) & np.isfinite(means)].tolist()]

    def _means(self, people: np.ndarray, d: np.ndarray, quorum: int) -> tuple[np.ndarray, np.ndarray]:
        wanted = np.zeros(len(self.names), dtype=bool)
        wanted[people] = True
        rows = np.flatnonzero(wanted[self.who[: self.n]])
        rows = rows[np.lexsort((d[rows], self.who[rows]))]
        start = np.flatnonzero(np.diff(self.who[rows], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        near = place < quorum
        of = np.cumsum(place[near] == 0) - 1
        return people, np.bincount(of, d[rows[near]], len(people)) / np.maximum(np.bincount(of, minlength=len(people)), 1)


class Graph:
    """Identities in memory: what the decisions of one run read and change. A name counts up and is never reused.

    splits: each person that a split made, with the person that was split first."""

    def __init__(self, quorum: int = 3, sequence: int = 0, prefix: str = "person_"):
        self.people: dict[str, Person] = {}
        self.quorum, self.sequence, self.prefix = quorum, sequence, prefix
        self.splits: list[tuple[str, str]] = []
        self._bank: _Bank | None = None

    def new(self, keys: list, vectors: list) -> str:
        self.sequence += 1
        name = f"{self.prefix}{self.sequence:03d}"
        self.people[name] = Person.of(keys, vectors)
        if self._bank:
            self._bank.add(name, vectors)
        return name

    def ahead(self, vectors: np.ndarray) -> None:
        """The next vectors to be decided on: their distances to everyone are one product."""
        if self._bank is None and self.people:
            self._bank = _Bank(self.people)
        if self._bank:
            self._bank.ahead(vectors)

    def nearest(self, v: np.ndarray, barred: set) -> tuple[str | None, float | None]:
        """The first of the people with the least mean of quorum distances."""
        if self._bank is None:
            if not self.people:
                return None, None
            self._bank = _Bank(self.people)
        best, at = None, None
        for name in self._bank.candidates(v, barred, self.quorum):
            d = np.sort(self.people[name].distances(v))[: self.quorum].mean()
            if at is None or d < at:
                best, at = name, float(d)
        return best, at

    def decide(self, key: str, v: np.ndarray, match: float, uncertain: float, coherence: float, may_found: bool, barred: set) -> Decision:
        """One candidate and no second choice: a match that would break coherence stays uncertain."""
        name, d = self.nearest(v, barred)
        if name is not None and d <= match:
            if self.people[name].stays_coherent(v, coherence):
                self.people[name].add(key, v)
                self._bank.add(name, [v])
                return Decision(key, name, d, "assigned")
            return Decision(key, None, d, "uncertain")
        if name is not None and d <= uncertain or not may_found:
            return Decision(key, None, d, "uncertain")
        return Decision(key, self.new([key], [v]), 0.0, "assigned")

    def rediscover(self, keys: list, groups: list, vectors: list, match: float, coherence: float) -> dict[str, str]:
        """New people among uncertain items alone: clusters of two or more that are coherent."""
        if len(keys) < 2:
            return {}
        labels = linked(np.asarray(vectors), match, groups)
        out = {}
        for label in dict.fromkeys(labels.tolist()):
            own = np.flatnonzero(labels == label)
            members = [vectors[i] for i in own]
            if len(own) >= 2 and mean_pairwise(np.asarray(members)) <= coherence:
                name = self.new([keys[i] for i in own], members)
                out |= {keys[i]: name for i in own}
        return out

    def split(self, coherence: float, threshold: float) -> dict[str, str]:
        """Incoherent people are clustered apart until all are stable; the largest part keeps the name. key: new person."""
        moved: dict[str, str] = {}
        self._bank = None  # people change in other ways from here on
        todo = [(n, n) for n, p in self.people.items() if p.coherence() > coherence]
        while todo:
            name, root = todo.pop()
            p = self.people[name]
            labels = linked(np.asarray(p.vectors), threshold, [k.rpartition(":")[0] for k in p.keys]) if len(p.keys) > 1 else np.zeros(1, int)
            parts = [np.flatnonzero(labels == x) for x in dict.fromkeys(labels.tolist())]
            if len(parts) < 2:
                continue
            parts.sort(key=len, reverse=True)
            take = lambda at, p=p: ([p.keys[i] for i in at], [p.vectors[i] for i in at])
            made = [name]
            self.people[name] = Person.of(*take(parts[0]))
            for part in parts[1:]:
                keys, vectors = take(part)
                made.append(self.new(keys, vectors))
                self.splits.append((made[-1], root))
                moved |= dict.fromkeys(keys, made[-1])
            todo += [(n, root) for n in made if self.people[n].coherence() > coherence]
        return moved

    def reconcile(self, threshold: float, coherence: float, exclusion: bool = False) -> dict[str, str]:
        """Merges the closest people within the threshold while their union stays coherent. old: new person.

        Sums of distances between people who are near are computed once; a merge adds them up. Pairs wait in a heap with the versions of
        their people, and an entry whose people have changed since is passed over, so a pair refused is looked at again once one of
        the two has changed. With exclusion, people that share a group are not merged."""
        names = sorted(self.people)
        people = [self.people[n] for n in names]
        self._bank = None
        vectors = [np.asarray(p.vectors, dtype=float) for p in people]
        sizes = np.array([len(p.keys) for p in people], dtype=float)
        near, inside = _sums_between(people, threshold)
        groups = [{k.rpartition(":")[0] for k in p.keys} for p in people]
        version, alive = [0] * len(names), np.ones(len(names), dtype=bool)
        heap = [(d / (sizes[a] * sizes[b]), a, b, 0, 0) for a, own in enumerate(near) for b, d in own.items() if a < b]
        heapq.heapify(heap)
        merged: dict[str, str] = {}
        while heap:
            _, a, b, va, vb = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or (va, vb) != (version[a], version[b]):
                continue
            n, total = sizes[a] + sizes[b], inside[a] + inside[b] + near[a][b]
            if total > coherence * (n * (n - 1) / 2) * (1 + SLACK) or exclusion and groups[a] & groups[b]:
                continue
            sizes[a], inside[a], alive[b] = n, total, False
            groups[a] |= groups[b]
            version[a] += 1
            pa, pb = self.people[names[a]], self.people.pop(names[b])
            self.people[names[a]] = Person(pa.keys + pb.keys, pa.vectors + pb.vectors, float(total))
            merged[names[b]] = names[a]
            # the union is near only to people who were near to one of the two
            for c in (near[a].keys() | near[b].keys()) - {a, b}:
                d = sum(near[x][c] if c in near[x] else float(pair_distances(vectors[x], vectors[c]).sum()) for x in (a, b))
                near[c].pop(b, None)
                if d / (sizes[a] * sizes[c]) <= threshold:
                    near[a][c] = near[c][a] = d
                    low, high = min(a, c), max(a, c)
                    heapq.heappush(heap, (d / (sizes[a] * sizes[c]), low, high, version[low], version[high]))
                else:
                    near[a].pop(c, None)
                    near[c].pop(a, None)
            near[a].pop(b, None)
            near[b] = {}
            vectors[a], vectors[b] = np.concatenate([vectors[a], vectors[b]]), vectors[b][:0]
        return merged


def _sums_between(people: list[Person], threshold: float, at_once: int = 2_000_000) -> tuple[list[dict[int, float]], np.ndarray]:
    """Of each of the people the sums of distances to others whose mean is within the threshold, and the sums inside of each. A strip of
    about `at_once` distances is held."""
    near: list[dict[int, float]] = [{} for _ in people]
    inside = np.zeros(len(people))
    if not people:
        return near, inside
    v = np.asarray([x for p in people for x in p.vectors], dtype=float)
    sizes = np.array([len(p.vectors) for p in people])
    first = np.cumsum(sizes) - sizes
    rows, begin = max(16, at_once // len(v)), 0
    while begin < len(people):
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + rows, side="right")) - 1)
        of = np.repeat(np.arange(end - begin), sizes[begin:end])
        sums = np.zeros((end - begin, len(people)))
        for at in range(0, len(of), rows):
            here = np.arange(first[begin] + at, min(first[begin] + at + rows, first[begin] + len(of)))
            d = pair_distances(v[here], v)
            # an item has no distance to itself, whatever rounding makes of it
            d[np.arange(len(here)), here] = 0
            own = of[at : at + rows]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[starts]] += np.add.reduceat(np.add.reduceat(d, first, axis=1), starts, axis=0)
        inside[begin:end] = sums[np.arange(end - begin), np.arange(begin, end)] / 2
        i, j = np.nonzero(sums <= threshold * (sizes[begin:end, None] * sizes[None, :]) * (1 + SLACK))
        mean = sums[i, j] / (sizes[begin + i] * sizes[j])
        for a, b, d in zip((begin + i).tolist(), j.tolist(), np.where(mean <= threshold, sums[i, j], np.nan).tolist(), strict=True):
            if a < b and d == d:
                near[a][b] = near[b][a] = d
        begin = end
    return near, inside


def resolve_quorum(rows: list[tuple], photos_of: dict, limit: float) -> list[tuple]:
    """Loose items of one photo in order: each takes its nearest identity that has not the photo, if within the limit.

    rows: (position, item, [(identity, score), ...]); photos_of: identities that already have the photo."""
    taken, out = set(photos_of), []
    for _, item, candidates in sorted(rows, key=lambda r: r[0]):
        free = [(s, i) for i, s in candidates if i not in taken]
        if free and (best := min(free))[0] <= limit:
            taken.add(best[1])
            out.append((item, best[1], best[0]))
    return out
