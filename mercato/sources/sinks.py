"""Sinks: table snapshots and partitioned appends.

UPDATE / DELETE / MERGE INTO are not available on plain parquet tables, so
a bulk change produces a new table that is written to a *new* folder and
current from the moment its ``_SUCCESS`` file exists; the folder being read
is never overwritten, so readers of the old snapshot are unaffected and a
failed job leaves the current snapshot as it is.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new snapshot under ``root``. It becomes the current
    one at the moment its ``_SUCCESS`` file appears, which the writer creates
    last; nothing old is touched."""
    folder = f"{root.rstrip('/')}/snapshot-{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(folder)
    return folder


def current_snapshot(spark: SparkSession, root: str) -> str:
    """The newest finished snapshot (names sort by time)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/snapshot-*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    names = sorted(f.getPath().getParent().getName() for f in found or [])
    if not names:
        raise FileNotFoundError(f"no finished snapshot under {root}")
    return f"{root.rstrip('/')}/{names[-1]}"


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(current_snapshot(spark, root))


def append_partitioned(df: DataFrame, path: str, column: str) -> None:
    """Append-only sink partitioned by one low-cardinality column (e.g. the
    audit log by ``action``)."""
    df.write.mode("append").partitionBy(column).parquet(path)
