"""Average linkage of components that no kernel can hold, by rounds of reciprocal nearest neighbours over tiles.

A merge never brings a cluster nearer to a third one than the nearer of its parts was (the mean of two means; a barred pair stays barred),
also where costs tie and the lower pair goes first. So two clusters that are each other's nearest are merged by the global order
sooner or later, whatever is merged before, and all such pairs can be merged at once. For the same reason a cluster whose nearest
is over the threshold is done, and takes no part in later rounds. The globally nearest pair is always such a pair, so every round
makes progress; what is left of a component goes to the kernel as soon as it fits.

In a round the items of a cluster stand in one tile (those of a cluster over half a tile are dealt over all, and its sums are
added up); a worker sees two tiles, sums the distances between clusters, and sends on the nearest of each cluster. Distances are
multiples of 2^-24, so sums are exact in any order up to 5e8 of them, and ties are ties in both ways of working.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.operators import kernels
from semblance.operators.metric import matrix, nothing
from semblance.sources.tables import written

TILE = 4096
#: Rows of a tile whose distances are held at once.
AT_ONCE = 512
_MET = ("a", "b", "cost", "na", "nb", "barred", "whole")


class _Side:
    """The clusters of one tile: rows in their order, first row, name, full size and groups of each."""

    def __init__(self, p: pd.DataFrame):
        p = p.sort_values("cluster", kind="stable")
        own = p["cluster"].to_numpy()
        self.first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        self.v, self.names, self.size, self.whole = matrix(p["v"]), own[self.first], p["n"].to_numpy()[self.first], ~p["large"].to_numpy(dtype=bool)[self.first]
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(own))))
        grouped = pd.DataFrame({"g": p["g"].to_numpy(), "c": self.of}).dropna().drop_duplicates()
        self.groups = {g: c.to_numpy() for g, c in grouped.groupby("g")["c"]}


def _met(x: _Side, y: _Side, same: bool) -> pd.DataFrame:
    """The nearest cluster of each whole one, and the part sums of those dealt over several tiles."""
    sums = np.zeros((len(x.names), len(y.names)))
    for at in range(0, len(x.v), AT_ONCE):
        d = np.add.reduceat(kernels.gridded(kernels.pair_distances(x.v[at : at + AT_ONCE], y.v)), y.first, axis=1)
        own = x.of[at : at + AT_ONCE]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += np.add.reduceat(d, starts, axis=0)
    barred = np.zeros(sums.shape, dtype=bool)
    for g in x.groups.keys() & y.groups.keys():
        barred[np.ix_(x.groups[g], y.groups[g])] = True
    other = x.names[:, None] < y.names[None, :] if same else x.names[:, None] != y.names[None, :]
    whole = x.whole[:, None] & y.whole[None, :]
    out = []
    i, j = np.nonzero(other & ~whole)
    low = x.names[i] < y.names[j]
    pick = lambda a, b: np.where(low, a, b)
    out.append(pd.DataFrame({"a": pick(x.names[i], y.names[j]), "b": pick(y.names[j], x.names[i]), "cost": sums[i, j], "na": pick(x.size[i], y.size[j]), "nb": pick(y.size[j], x.size[i]), "barred": barred[i, j], "whole": False}))
    cost = np.where(other & whole & ~barred, sums / (x.size[:, None] * y.size[None, :]), np.inf)
    if same:
        cost = np.minimum(cost, cost.T)
    for c, mine, theirs in ((cost, x, y),) if same else ((cost, x, y), (cost.T, y, x)):
        # names go up along a row, so the first of equal costs is the lowest pair
        k = c.argmin(axis=1)
        some = np.flatnonzero(np.isfinite(c[np.arange(len(c)), k]))
        out.append(pd.DataFrame({"a": mine.names[some], "b": theirs.names[k[some]], "cost": c[some, k[some]], "na": 0, "nb": 0, "barred": False, "whole": True}))
    return pd.concat(out, ignore_index=True)


def nearest(active: DataFrame, tile: int) -> DataFrame:
    """cluster, cost, low, high: the nearest cluster that each may join; of equal ones the lowest pair.

    active: component, item, cluster, n (items of the cluster), v, g."""
    kind = dict(active.dtypes)["item"]
    pieces = active.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).alias("pieces"))
    large = F.col("n") > tile // 2
    rows = active.join(pieces, "component").withColumn("large", large).withColumn("b", F.pmod(F.when(large, F.xxhash64("item")).otherwise(F.xxhash64("cluster")), F.col("pieces")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda o: F.least("b", o) * F.col("pieces") + F.greatest("b", o))
    celled = rows.select("component", F.explode(cells).alias("cell"), "b", "pieces", "cluster", "n", "large", "g", "v")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        i, j = divmod(int(p["cell"].iloc[0]), int(p["pieces"].iloc[0]))
        x, y = p[p["b"] == i], p[p["b"] == j]
        if x.empty or y.empty:
            return nothing(*_MET)
        left = _Side(x)
        found = _met(left, left if i == j else _Side(y), i == j)
        return found if len(found) else nothing(*_MET)

    schema = f"a {kind}, b {kind}, cost double, na long, nb long, barred boolean, whole boolean"
    found = written(celled.groupBy("component", "cell").applyInPandas(meet, schema), "met")
    parts = found.where("NOT whole").groupBy("a", "b").agg((F.sum("cost") / (F.first("na") * F.first("nb"))).alias("cost"), F.max("barred").alias("barred")).where("NOT barred")
    pairs = parts.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cost").select("p.a", "p.b", "cost")
    every = found.where("whole").select("a", "b", "cost").unionByName(pairs)
    best = F.min(F.struct("cost", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))).alias("m")
    return every.groupBy(F.col("a").alias("cluster")).agg(best).select("cluster", "m.cost", "m.low", "m.high")


def merged(rows: DataFrame, threshold: float, limit: int, tile: int = TILE) -> DataFrame:
    """item, representative (the least item of its cluster).

    rows: component, item, v, g (null: in no group). Components of up to `limit` items are the kernel's."""
    kind = dict(rows.dtypes)["item"]
    active = rows.select("component", "item", F.col("item").alias("cluster"), F.lit(1).cast("long").alias("n"), "v", "g")
    done = []

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("item")
        labels = kernels.cluster(matrix(p["v"]), threshold, [f"{g}" if g is not None and g == g else f"\0{i}" for i, g in enumerate(p["g"])], limit, p["cluster"].to_numpy())
        return pd.DataFrame({"item": p["item"], "representative": p["cluster"].groupby(labels).transform("min").to_numpy()})

    while True:
        sizes = written(active.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), "sizes")
        small = active.join(sizes.where(F.col("_n") <= limit), "component", "left_semi")
        done.append(written(small.groupBy("component").applyInPandas(kernel, f"item {kind}, representative {kind}"), "finished"))
        if sizes.where(F.col("_n") > limit).isEmpty():
            break
        active = active.join(sizes.where(F.col("_n") > limit), "component", "left_semi")
        near = written(nearest(active, tile).where(F.col("cost") <= threshold * (1 + kernels.SLACK)), "nearest")
        both = near.groupBy("low", "high").agg(F.count(F.lit(1)).alias("_k")).where("_k = 2").select(F.col("high").alias("cluster"), F.col("low").alias("_to"))
        done.append(written(active.join(near, "cluster", "left_anti").select("item", F.col("cluster").alias("representative")), "done"))
        moved = active.join(near.select("cluster"), "cluster", "left_semi").join(both, "cluster", "left").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to", "n")
        moved = written(moved, "moved")
        counts = moved.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        active = written(moved.join(counts, "cluster").select("component", "item", "cluster", "n", "v", "g"), "active")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
