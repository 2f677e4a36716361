"""Tables that a plan writes on its way: where they go, how lineage is cut, and when they go away."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call of one operator."""
    _MADE.append(f"{shared_root(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: lineage ends there, and lost executors cost nothing before it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the workspaces made inside: for what has been read or written elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            delete_path(spark, _MADE.pop())


def clean(spark: SparkSession) -> None:
    """Deletes all workspaces of this process; results that still depend on them can't be read any more."""
    while _MADE:
        delete_path(spark, _MADE.pop())
