"""Change files: JSON lines read with a declared schema; malformed lines are
kept aside (PERMISSIVE mode with a corrupt-record column) instead of
failing the job. An empty object ``{}`` is a row of nulls, as an empty
request body is ``{}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the raw line in ``_corrupt_record``).

    Lines are read as text and parsed with ``from_json`` (PERMISSIVE, with a
    corrupt-record column), so the reject path is an ordinary column that
    any query, counts included, can use. A blank line is an empty body, so a
    row of nulls like ``{}``."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    line = F.when(F.col("value").rlike(r"^\s*$"), F.lit("{}")).otherwise(F.col("value"))
    df = spark.read.text(path).select(F.from_json(line, full, opts).alias("_r")).select("_r.*")
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good, bad


def write_changes(df: DataFrame, path: str, corrupt_when=None) -> str:
    """Write rows as JSON lines; ``corrupt_when`` (a Column) marks rows to
    write damaged (first character dropped), for tests of the reject path."""
    line = F.to_json(F.struct(*df.columns))
    if corrupt_when is not None:
        line = F.when(corrupt_when, F.substring(line, 2, 1 << 30)).otherwise(line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path
