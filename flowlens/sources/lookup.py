"""Stored events for point look-ups (SRC1, F13).

The reference has database indexes on the business reference, the interchange and the control number.  Here the
look-up copy of the events is clustered by ``business_ref`` (range-partitioned and sorted, so row-group statistics
tell where a reference can be) and its row groups carry Bloom filters of all three columns; a look-up by any of
them reads only the row groups that may hold it.  A row group of ``ROW_GROUP`` bytes bounds what one look-up reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources import contracts as C

COLUMNS = ("business_ref", "interchange_id", "control_number")
ROW_GROUP = 16 * 1024 * 1024


def write_lookup(ev: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    writer = (ev.repartitionByRange("business_ref", "event_time").sortWithinPartitions("business_ref", "event_time")
                .write.mode("overwrite").option("parquet.block.size", row_group))
    for c in COLUMNS:
        # The filter's size follows the row group's distinct values.
        writer = (writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true"))
    writer.parquet(path)


def find(spark: SparkSession, path: str, **values: str) -> DataFrame:
    """Events whose columns (of COLUMNS) have these values; the equalities reach the Parquet reader."""
    unknown = set(values) - set(COLUMNS)
    if unknown or not values:
        raise ValueError(f"look up by {', '.join(COLUMNS)}")
    df = spark.read.schema(C.events_schema()).parquet(path)
    for c, v in values.items():
        df = df.filter(F.col(c) == v)
    return df
