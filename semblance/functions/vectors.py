"""Vector arithmetic on array columns. Everything is computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(_total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def unit_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of unit vectors from their dot product, clamped at 0."""
    return F.sqrt(F.greatest(2 - 2 * dot(a, b), F.lit(0.0)))


def rms_of_centroids(a: Column | str, b: Column | str) -> Column:
    """Root mean square of all cross distances of two sets of unit vectors, from their plain centroids."""
    return unit_distance(a, b)


def normalised(v: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def centroid(v: Column | str, dim: int) -> Column:
    """Aggregate: element-wise mean, not normalised again. One partial sum for each element, so it combines map-side."""
    return F.array(*(F.avg(F.get(doubles(v), i)) for i in range(dim)))


def coherence_from_sums(pair_sum: Column, n: Column) -> Column:
    """Mean pairwise distance from the sum over pairs; 0 below two members."""
    return F.when(n < 2, F.lit(0.0)).otherwise(pair_sum / (n * (n - 1) / 2))


def coherence_with_one_more(pair_sum: Column, n: Column, to_members: Column) -> Column:
    """Mean pairwise distance after adding an item whose distances to the members sum to to_members."""
    return (pair_sum + to_members) / (n * (n + 1) / 2)
