"""Column-pruned readers for the driver's parquet tables.

Each reader names the columns it needs, so the parquet scan's ReadSchema
carries only those; filters written on top push into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cols = columns if columns is not None else COLUMNS.get(name)
    return df.select(*cols) if cols else df
