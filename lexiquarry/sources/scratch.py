"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders that :func:`written` made inside a :func:`scratch` of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local session, as in
    tests) is a new folder made and set.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of the shared ones that is not there yet."""
    return f"{shared_root(spark)}/lexiquarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: evaluated once, lineage cut."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unwritten(df: DataFrame) -> None:
    """Delete the files behind a :func:`written` table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexiquarry/" in folder:
            _delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was :func:`written` inside; what is still to be read then must be stored before."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for folder in made:
            _delete(spark, folder)
