"""Contract sources and sinks (SRC1-SRC8, SNK1-SNK4).

Layout decisions for scale:

* events are written partitioned by ``event_date`` and sorted by
  ``event_time`` inside each file, so a time-range predicate prunes
  partitions and parquet row groups (min/max statistics);
* the rollup is partitioned by ``bucket_date`` and refreshed with dynamic
  partition overwrite: only the days an incremental run touched are
  rewritten, always as complete days;
* the event log by ingest batch and the rollup that follows it, late events
  included, are in ``incremental.py``;
* upserted tables (files, current state, stream rollup) are a base with deltas
  (``keyed.py``): a batch writes its own keys' rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col, trunc_ntz
from flowlens.operators import files as fi
from flowlens.operators import rollup as ro
from flowlens.sources import contracts as C
from flowlens.sources.keyed import KeyedTable


def _with(schema, name: str, dtype):
    """A copy of ``schema`` plus one column (StructType.add mutates in place)."""
    return C.T.StructType(list(schema.fields) + [C.T.StructField(name, dtype, True)])


# ------------------------------------------------------------------ sources
def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """SRC1: events with partition pruning on ``event_date`` for a time range.

    A predicate on ``event_time`` alone does not prune the derived date
    partition, so the date predicate is added next to it.
    """
    schema = _with(C.events_schema(), "event_date", C.D)
    df = spark.read.schema(schema).parquet(path)
    if start is not None:
        s = as_of_col(start)
        df = df.filter((F.col("event_date") >= F.to_date(s)) & (F.col("event_time") >= s))
    if end is not None:
        e = as_of_col(end)
        df = df.filter((F.col("event_date") <= F.to_date(e)) & (F.col("event_time") < e))
    return df.drop("event_date")


def write_events(ev: DataFrame, path: str, mode: str = "overwrite") -> None:
    # By range: a task holds few days, and a hot day is split by its hours.
    (ev.withColumn("event_date", F.to_date("event_time")).repartitionByRange("event_date", "event_time")
       .sortWithinPartitions("event_date", "event_time")
       .write.mode(mode).partitionBy("event_date").parquet(path))


def file_table(spark: SparkSession, path: str) -> KeyedTable:
    """The upserted file / interchange table (SRC2, SNK3)."""
    return KeyedTable(spark, path, C.FILES, ["interchange_id"], lambda batch, old: fi.upsert_files(batch, old))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: file / interchange table."""
    return file_table(spark, path).read()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: hourly rollup (partition column ``part`` = the bucket's day or month)."""
    return spark.read.schema(_with(C.ROLLUP, "part", C.D)).parquet(path).drop("part")


def read_monitors(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """SRC5: the four monitor tables."""
    return {n: spark.read.schema(s).parquet(f"{base}/{n}") for n, s in C.MONITORS.items()}


def read_refs(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """SRC6: reference tables (penalty, profile)."""
    return {n: spark.read.schema(s).parquet(f"{base}/{n}") for n, s in C.REFS.items()}


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC7 / SRC8: shipment-360 sources and API calls (explicit schema when given)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


# -------------------------------------------------------------------- sinks
def _rollup_layout(ru: DataFrame, grain: str) -> DataFrame:
    """Partition by the bucket's ``grain`` (day / month); inside a partition, files
    hold partner ranges sorted by (partner, bucket), so a partner filter skips
    files and row groups through parquet min/max statistics.  A hot partner is
    split by bucket.

    Choose the grain so one partition is a sizeable file set: ``day`` for
    production volumes, ``month`` for sparse histories (a few hundred rows a
    day) where day partitions would be thousands of tiny files.
    """
    part = F.to_date(trunc_ntz(grain, F.col("bucket")))
    return (ru.withColumn("part", part).repartitionByRange("part", "partner", "bucket")
              .sortWithinPartitions("partner", "bucket"))


def rebuild_rollup(ev: DataFrame, path: str, as_of=None, grain: str = "day") -> None:
    """SNK2: truncate-and-rebuild of the whole rollup."""
    _rollup_layout(ro.hourly_rollup(ev, as_of), grain).write.mode("overwrite").partitionBy("part").parquet(path)


def write_rollup(ru: DataFrame, path: str, grain: str = "day") -> None:
    """SNK1: replace only the ``part`` partitions present in ``ru`` (dynamic overwrite)."""
    (_rollup_layout(ru, grain).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("part").parquet(path))


def refresh_rollup_days(ev: DataFrame, path: str, as_of=None, hours: int = 2, grain: str = "day") -> None:
    """A2 + SNK1: recompute the whole partitions touched by the last ``hours`` and overwrite them.

    Dynamic overwrite replaces partitions, so the unit of work is the
    partition (day / month) that holds the refresh cutoff, not two hours.
    """
    cut = ro.refresh_cutoff(as_of, hours)
    start = trunc_ntz(grain, cut)
    fresh = ro.hourly_rollup(ev.filter(F.col("event_time") >= start), as_of)
    write_rollup(fresh, path, grain)


def upsert_files(batch: DataFrame, path: str, batch_id: int | None = None, writer: str | None = None) -> bool:
    """SNK3: merge a batch of receipt / parse rows into the file table; what is written follows the batch.

    A batch id that ``writer`` committed before is not merged again (False).
    """
    return file_table(batch.sparkSession, path).upsert(batch.select(*fi.FILE_COLUMNS), writer, batch_id)


def export_csv(df: DataFrame, path: str) -> None:
    """SNK4: CSV export with a header (e.g. the monthly usage table)."""
    df.write.mode("overwrite").option("header", True).csv(path)
