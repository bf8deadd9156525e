"""Tables in the shared folder: what cuts a lineage at a place that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, one of
    our own in local mode; on a cluster executors wouldn't see it, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_strata_shared_dir", None)
        if path is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = spark._strata_shared_dir = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
    return path.rstrip("/")


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those given to the function
    that this yields. For work whose result is written before the end."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        for df in made:
            if not any(df is k for k in kept):
                drop_table(df)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    if _open:
        _open[-1].append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_strata_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
