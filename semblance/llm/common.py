"""Helpers shared by the training-data operators: tables, shared scratch space, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.sources.tables import shared_dir, written

__all__ = ["SPACES", "blanks", "runs", "shared_dir", "table", "word_chars", "words", "written"]

#: ASCII white space that separates words (0x20 and 0x09-0x0D).
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blanks(text: Column) -> Column:
    """The text with every word separator turned into a space."""
    return F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(blanks(F.coalesce(text, F.lit(""))), " "), "")


def word_chars(text: Column) -> Column:
    """Code points that stand in words."""
    return F.length(F.translate(text, SPACES, ""))


def runs(texts: pa.Array, size: int) -> Iterator[slice]:
    """Runs of texts of about `size` bytes; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield slice(at, end)
        at = end
