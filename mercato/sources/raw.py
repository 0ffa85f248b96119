"""Typed scans of the source parquet tables (declared schema, no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
                    ("c_mktsegment", _S)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                ("p_retailprice", _D)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                  ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                    ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                    ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _st(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D),
                  ("props", _S)),
    "conversations": _st(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "pages": _st(("page_id", _L), ("url", _S), ("html", _S)),
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Register every bound source table as a temp view under its own name."""
    out = {}
    for name in RAW_SCHEMAS:
        df = read_raw(spark, sf_dir, name)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
