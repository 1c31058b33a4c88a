"""Rebuilding only what changed: by anti-join in batches, or as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def changed(current: DataFrame, known: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows that are new or have another signature."""
    return current.join(known.select(key, signature), [key, signature], "left_anti")


def refreshed(current: DataFrame, known: DataFrame, key: str, signature: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``known`` for unchanged rows and of ``build`` for the others; rows that are gone go."""
    kept = known.join(current.select(key, signature), [key, signature], "left_semi")
    return kept.unionByName(build(changed(current, known, key, signature)))


def isolated(results: DataFrame, key: str, ok: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, and an ERROR row for each failed key; a failure does not touch the others."""
    good = results.where(F.col(ok).isNull())
    bad = results.where(F.col(ok).isNotNull()).select(key, F.lit("ERROR").alias("status"), F.col(ok).alias("warnings"))
    return good, bad


def landed(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each JSON file that lands is built once into ``target``; a restart goes on where it stopped."""
    stream = build(spark.readStream.schema(schema).json(folder))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
