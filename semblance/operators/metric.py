"""An exact index for joins within a distance: rows are dealt into tiles so that only rows that can be near each other meet.

Some rows, chosen by hash, are pivots. Every row belongs to the ball of its nearest pivot, and a ball has the radius of its farthest
row. By the triangle inequality a row has partners within the limit only in balls whose pivot is no farther from it than their radius
plus the limit. Balls are put into tiles of about `block` rows, neighbours together (a larger ball has several tiles); a pair of
tiles is a cell, and a row is sent to the cells of its own tile with each tile that it has a ball to reach in. Two rows that are near
reach each other's tile, so they meet, and in one cell only. A row goes to as many cells as there are tiles at most, as without
an index; where vectors are clustered most pairs of tiles hold nothing and no row is sent to them.

The index is at most PIVOTS vectors, with four numbers each, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.operators import kernels

#: Pivots at most, and rows for each.
PIVOTS, ROWS = 2048, 64
#: Tiles that a table is dealt into as long as their rows are between these two numbers: a row goes to each of them at most, so
#: what is sent grows with the table only, until tiles are full.
TILES, SMALLEST, LARGEST = 16, 1024, 32_768
#: Rows whose distances to all pivots are held at once.
AT_ONCE = 2048


def matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 0))


def nothing(*columns: str) -> pd.DataFrame:
    """No rows, in columns that take any declared type."""
    return pd.DataFrame({c: [] for c in columns}, dtype=object)


def tile_rows(n: int) -> int:
    return max(SMALLEST, min(LARGEST, -(-n // TILES)))


@dataclass(frozen=True)
class Index:
    """Balls and the tiles they are in: first tile and number of tiles of each ball."""

    pivots: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    pieces: np.ndarray
    tiles: int
    #: What rounding can hide.
    slack: float
    #: Whether all rows are of single precision, and can be sent so.
    single: bool = False

    def own(self, ball: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return self.first[ball] + hashes % self.pieces[ball]

    def reached(self, d: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tiles that they reach, from distances to the pivots."""
        row, ball = np.nonzero(d <= self.radii + (limit + self.slack))
        times = self.pieces[ball]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.divmod(np.unique(np.repeat(row, times) * self.tiles + np.repeat(self.first[ball], times) + step), self.tiles)


def _near_order(d: np.ndarray) -> list[int]:
    """All balls, each followed by the nearest one left."""
    left, order = np.ones(len(d), dtype=bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.argmin(np.where(left, d[order[-1]], np.inf))))
        left[order[-1]] = False
    return order


def tiled(pivots: np.ndarray, radii: np.ndarray, counts: np.ndarray, block: int) -> Index:
    first, pieces = np.zeros(len(pivots), dtype=np.int64), np.maximum(1, -(-counts // block))
    tile = used = 0
    for ball in _near_order(kernels.pair_distances(pivots, pivots)):
        if used and used + counts[ball] > block:
            tile, used = tile + 1, 0
        first[ball] = tile
        if pieces[ball] > 1:
            tile, used = tile + int(pieces[ball]), 0
        else:
            used += int(counts[ball])
    size = float(np.sqrt((pivots**2).sum(1)).max() + max(0.0, radii.max()))
    return Index(pivots, radii, first, pieces, max(1, tile + bool(used)), 1e-6 * (1 + size))


def built(rows: DataFrame, n: int, block: int, most: int = PIVOTS) -> Index:
    """The index of n rows (item, v)."""
    chosen = rows.orderBy(F.xxhash64("item"), "item").limit(max(1, min(most, n // ROWS))).select("v").collect()
    pivots = np.unique(np.array([r["v"] for r in chosen], dtype=float), axis=0)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                v = matrix(b["v"].iloc[at : at + AT_ONCE])
                d = kernels.pair_distances(v, sent.value)
                single = (v == v.astype(np.float32)).all()
                found = pd.DataFrame({"ball": d.argmin(axis=1), "far": d.min(axis=1)}).groupby("ball")["far"]
                yield pd.DataFrame({"ball": found.max().index, "far": found.max().to_numpy(), "n": found.size().to_numpy(), "single": single})

    found = rows.select("v").mapInPandas(balls, "ball long, far double, n long, single boolean").groupBy("ball").agg(F.max("far").alias("far"), F.sum("n").alias("n"), F.min("single").alias("single")).collect()
    radii, counts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in found:
        radii[r["ball"]], counts[r["ball"]] = r["far"], r["n"]
    return replace(tiled(pivots, radii, counts, block), single=all(r["single"] for r in found))


def dealt(rows: DataFrame, limit: float, block: int | None = None, most: int = PIVOTS) -> tuple[DataFrame, int]:
    """Rows (item, v) with `cell`, a pair of tiles, and their own tile `b`; and the number of tiles. A cell is tile * tiles + tile.

    block: rows of a tile; without it they follow from the number of rows. Vectors are sent in single precision if that loses nothing."""
    n = rows.count()
    block = block or tile_rows(n)
    if n <= block:
        return rows.select(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("b"), "item", "v"), 1
    index = built(rows, n, block, most)
    sent = rows.sparkSession.sparkContext.broadcast(index)
    kind = dict(rows.dtypes)["item"]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                part = b.iloc[at : at + AT_ONCE]
                d = kernels.pair_distances(matrix(part["v"]), index.pivots)
                own = index.own(d.argmin(axis=1), part["h"].to_numpy())
                row, tile = index.reached(d, limit)
                cells = np.minimum(own[row], tile) * index.tiles + np.maximum(own[row], tile)
                v = [x.astype(np.float32) for x in part["v"]] if index.single else part["v"].to_numpy()
                yield pd.DataFrame({"cells": np.split(cells, np.searchsorted(row, np.arange(1, len(part)))), "b": own, "item": part["item"].to_numpy(), "v": v})

    hashed = rows.select("item", "v", F.pmod(F.xxhash64(F.lit("piece"), "item"), F.lit(1 << 30)).alias("h"))
    found = hashed.mapInPandas(send, f"cells array<long>, b long, item {kind}, v array<{'float' if index.single else 'double'}>")
    return found.select(F.explode("cells").alias("cell"), "b", "item", "v"), index.tiles


def skipped(celled: DataFrame, tiles: int) -> float:
    """The share of all pairs of tiles whose rows never meet."""
    sides = celled.groupBy("cell").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    own = F.floor(F.col("cell") / tiles) == F.col("cell") % tiles
    met = sides.where(own | (F.col("low") < F.col("high"))).count()
    return 1 - met / (tiles * (tiles + 1) / 2)
