"""Aggregates of the vectors of each person as states that add up: over tasks, over tables, and batch by batch.

A state is the number of vectors, their sum, the sum of their squared norms, and the sum of their pairwise distances. The first three
add up by themselves and give the centroid and the mean squared distance of pairs, hence bounds of the mean distance. The
last one grows, when vectors are added, by the distances of the new ones to those that are there and to each other; distances
between vectors that were there before are never computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions import vectors as V
from semblance.operators import cluster, kernels
from semblance.operators.metric import matrix
from semblance.sources.tables import written


def moments(items: DataFrame, person: str, vector: str, dim: int) -> DataFrame:
    """person, n, total, squares in one native pass, combined before the shuffle. Rows without a person are left out."""
    rows = items.where(F.col(person).isNotNull()).select(F.col(person).alias("person"), V.doubles(vector).alias("v"))
    total = F.array(*(F.sum(F.get("v", i)) for i in range(dim)))
    return rows.groupBy("person").agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.sum(V.dot("v", "v")).alias("squares"))


def added(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("n", "squares")) -> DataFrame:
    """States of the vectors of both; columns: the plain numbers to add, besides the sum of the vectors."""
    x, y = (d.select("person", F.struct("total", *columns).alias(side)) for d, side in ((a, "x"), (b, "y")))
    both = x.join(y, "person", "full")
    number = lambda c: (F.coalesce(F.col(f"x.{c}"), F.lit(0)) + F.coalesce(F.col(f"y.{c}"), F.lit(0))).alias(c)
    total = F.when(F.col("x").isNull(), F.col("y.total")).when(F.col("y").isNull(), F.col("x.total")).otherwise(F.zip_with("x.total", "y.total", lambda p, q: p + q))
    return both.select("person", total.alias("total"), *(number(c) for c in columns))


def centroid() -> Column:
    return F.transform("total", lambda t: t / F.col("n"))


def mean_square() -> Column:
    """Mean squared distance of two vectors of a person; 0 below two."""
    n = F.col("n")
    pairs = F.greatest(n * F.col("squares") - V.dot("total", "total"), F.lit(0.0))
    return F.when(n < 2, F.lit(0.0)).otherwise(2 * pairs / (n * (n - 1)))


def bounds() -> tuple[Column, Column]:
    """What the mean distance of unit vectors is at least (they are at most 2 apart, so a distance is half its square or more) and at
    most (the root of the mean square)."""
    return mean_square() / 2, F.sqrt(mean_square())


def _cross_sums(new: DataFrame, old: DataFrame, at_once: int) -> DataFrame:
    """person, cross: the sum of distances between new and old vectors of each person. New rows are broadcast, so many at a time."""
    spark, kind = new.sparkSession, dict(new.dtypes)["person"]
    pieces = max(1, -(-new.count() // at_once))
    piece = F.pmod(F.xxhash64("item"), F.lit(pieces))
    found = spark.createDataFrame([], f"person {kind}, cross double")
    for k in range(pieces):
        part = new.where(piece == k).toPandas()
        if part.empty:
            continue
        sent = spark.sparkContext.broadcast({p: matrix(g["v"]) for p, g in part.groupby("person")})

        def sums(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(p, sum(float(kernels.pair_distances(sent.value[p], matrix(g["v"].iloc[i : i + 1024])).sum()) for i in range(0, len(g), 1024))) for p, g in b.groupby("person") if p in sent.value]
                if out:
                    yield pd.DataFrame(out, columns=["person", "cross"])

        found = found.unionByName(old.select("person", "v").mapInPandas(sums, f"person {kind}, cross double"))
    return found.groupBy("person").agg(F.sum("cross").alias("cross"))


def with_pairs(states: DataFrame, old: DataFrame, new: DataFrame, dim: int, at_once: int = 8192) -> DataFrame:
    """States (person, n, total, squares, pair_sum) after new items (item, person, v) join the old ones that the states are of, written."""
    fresh = written(new.where("person IS NOT NULL").select("item", "person", V.doubles("v").alias("v")), "fresh")
    inner = cluster.coherence(fresh, "person", "item", "v").select("person", (F.col("coherence") * F.col("n") * (F.col("n") - 1) / 2).alias("pair_sum"))
    own = moments(fresh, "person", "v", dim).join(inner, "person")
    full = added(states, own, ("n", "squares", "pair_sum"))
    cross = _cross_sums(fresh, old.where("person IS NOT NULL").select("person", V.doubles("v").alias("v")), at_once)
    joined = full.join(cross, "person", "left").withColumn("pair_sum", F.col("pair_sum") + F.coalesce("cross", F.lit(0.0)))
    return written(joined.select("person", F.col("n").cast("long").alias("n"), "total", "squares", "pair_sum"), "states")


def no_states(items: DataFrame, person: str) -> DataFrame:
    return items.sparkSession.createDataFrame([], f"person {dict(items.dtypes)[person]}, n long, total array<double>, squares double, pair_sum double")


def diffuse(items: DataFrame, person: str, item: str, vector: str, dim: int, limit: float) -> DataFrame:
    """The people whose unit vectors have a mean distance over the limit. Bounds from one pass decide most; distances are computed only
    for the others."""
    low, high = bounds()
    states = written(moments(items, person, vector, dim).withColumn("low", low).withColumn("high", high), "moments")
    open_ = states.where((F.col("low") <= limit + 1e-9) & (F.col("high") > limit - 1e-9)).select(F.col("person").alias(person))
    rows = items.join(open_, person, "left_semi")
    exact = cluster.coherence(rows, person, item, vector).where(F.col("coherence") > limit).select(F.col(person).alias("person"))
    return states.where(F.col("low") > limit + 1e-9).select("person").unionByName(exact)
