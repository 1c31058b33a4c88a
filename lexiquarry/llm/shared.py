"""Written intermediate tables and small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.sources.scratch import fresh, scratch, unwritten, written

__all__ = ["blocks", "dealt_join", "fold_ascii", "fresh", "give_back", "scratch", "split_hot", "table", "unwritten", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def blocks(rows: int, size: int) -> int:
    """How many blocks of about ``size`` rows; at least one."""
    return max(1, -(-rows // size))


def give_back() -> None:
    """Return freed memory to the system; workers are used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: A key that more than one in ``HOT`` rows have is hot, and at size one that has more than ``ROWS`` rows, as many as a task
#: may get, but at most ``KEYS`` keys are.
HOT, ROWS, KEYS = 1000, 2_000_000, 200_000


def hot_limit(total: int) -> float:
    """Rows beyond which a key of a table of ``total`` rows is hot."""
    return min(total / HOT, max(ROWS, total / KEYS))


def split_hot(side: DataFrame, weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``side``, one a key, whose key has more than :func:`hot_limit` rows elsewhere, and the others.

    ``weight`` is the column of how many rows have the key, ``total`` the sum of that. The first are fewer
    than ``KEYS`` whatever the data, so they may be broadcast.
    """
    hot = F.coalesce(F.col(weight) > F.lit(hot_limit(total)), F.lit(False))
    return side.where(hot), side.where(~hot)


def dealt_join(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, how: str = "inner", shuffled: bool = False) -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has a row a key and the ``weight`` of the key.

    Rows with a hot key meet a broadcast of the few hot keys where they are; only the others are shuffled, so
    that no task gets the rows of a hot key. ``shuffled`` keeps the others from a broadcast at any size, for rows
    with texts.
    """
    hot, rest = (x.drop(weight) for x in split_hot(side, weight, total))
    met = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge") if shuffled else rest, key, how)
    return met.unionByName(others.select(met.columns))
