"""Event log by ingest batch and the rollup that follows it (SNK1, A2).

Events are stored by the batch that brought them (``ingest_batch=<n>/event_date=<day>``).  A refresh reads the batches
that came since the last one, whatever their event times, and recomputes the partitions (day or month) that they touch; a
late event enters the rollup like any other.  Messages that fell due between the two instants touch their partition too,
because ``breached_count`` depends on the instant.  Untouched partitions keep their files.

What a refresh has done stands in ``_refreshes`` beside the rollup's partitions (Spark's readers skip names that begin
with an underscore), written after the partitions: a refresh that dies in between is done again and rewrites the same
partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.timeutil import as_of_col, breached, trunc_ntz
from flowlens.operators import rollup as ro
from flowlens.sources import contracts as C
from flowlens.sources import io
from flowlens.sources.tables import append_row, read_if_there

REFRESHES = T.StructType([T.StructField("ingest_batch", T.LongType()), T.StructField("as_of", T.TimestampNTZType()),
                          T.StructField("partitions", T.LongType())])


def append_events(ev: DataFrame, path: str, batch: int, grain: str = "day") -> None:
    """Adds the events of an ingest batch; the same batch written again replaces itself.

    ``event_date`` is the event's day, or the first of its month (``grain``) for histories whose days are too small for
    files of their own; the rollup's grain must not be finer.
    """
    day = F.to_date("event_time")
    (ev.withColumns({"ingest_batch": F.lit(batch).cast("long"), "event_date": F.trunc(day, "month") if grain == "month" else day})
       .repartitionByRange("event_date", "event_time").sortWithinPartitions("event_date", "event_time")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("ingest_batch", "event_date").parquet(path))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """All events with ``ingest_batch`` and ``event_date``, both partition columns."""
    schema = T.StructType([*C.events_schema().fields, T.StructField("ingest_batch", T.LongType()), T.StructField("event_date", C.D)])
    return spark.read.schema(schema).parquet(path)


def last_refresh(spark: SparkSession, rollup_path: str) -> tuple[int, dt.datetime | None]:
    """The newest ingest batch that the rollup holds, and the instant it was refreshed for; -1 and None before the first."""
    log = read_if_there(spark, f"{rollup_path}/_refreshes", REFRESHES)
    last = None if log is None else log.agg(F.max(F.struct("ingest_batch", "as_of"))).first()[0]
    return (-1, None) if last is None else (last.ingest_batch, last.as_of)


def _part(grain: str):
    """The rollup partition of an event, from its partition column, so that it prunes."""
    return F.trunc("event_date", "month") if grain == "month" else F.col("event_date")


def refresh_rollup(spark: SparkSession, events_path: str, rollup_path: str, as_of=None, grain: str = "day") -> int:
    """Brings the rollup up to the stored events and to ``as_of``; returns how many partitions were rewritten."""
    done, before = last_refresh(spark, rollup_path)
    ev = read_event_log(spark, events_path)
    now = spark.range(1).select(as_of_col(as_of)).first()[0]
    new = ev.filter(F.col("ingest_batch") > done)
    newest = new.agg(F.max("ingest_batch")).first()[0]
    newest = done if newest is None else newest
    part = _part(grain).alias("part")
    touched = new.filter(F.col("ingest_batch") <= newest).select(part)
    if before is not None and before != now:
        earlier, later = (as_of_col(t) for t in sorted((before, now)))
        # The due dates' statistics keep most row groups unread.
        fell_due = ev.filter((F.col("ingest_batch") <= done) & breached(later) & (F.col("sla_due_at") >= earlier))
        touched = touched.unionByName(fell_due.select(part))
    # At most one value for each partition of the rollup.
    parts = sorted(r.part for r in touched.distinct().collect() if r.part is not None)
    if parts:
        # The values prune the date partitions that are read.
        rows = ev.filter((F.col("ingest_batch") <= newest) & _part(grain).isin(parts))
        io.write_rollup(ro.hourly_rollup(rows, now), rollup_path, grain)
    if parts or newest != done or before != now:
        append_row(spark, f"{rollup_path}/_refreshes", REFRESHES, (newest, now, len(parts)))
    return len(parts)
