"""Join helper: a skew-safe forward as-of match.

``first_at_or_after`` answers "for each left row, the earliest right time at or after the left time with the same
keys" without making left x right pairs, in one shuffle:

1. Left and right rows are range-partitioned and sorted by (keys, time descending); a hot key spans as many
   partitions as its rows need.
2. Each partition is scanned once, latest rows first: the last right time met under the row's key is its match.
   Arrow batches, a few array passes each.
3. Rows at the beginning of a partition may have their match at the end of one before it.  Each partition reports
   its first key, its last key and that key's earliest right time; carried over the partitions, in order, these
   give the beginning rows of each partition their match.  The reports are two rows a partition.

The scan's result is written to the checkpoint folder once, so that rows and reports come from the same partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import checkpoint_path

FIRST, LAST, ROW = 0, 1, 2


def _scan(keys: list[str]):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def same(a, b):
        """Whether keys are equal, null and null too."""
        out = None
        for k in keys:
            x, y = a.column(k), b.column(k)
            equal = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
            out = equal if out is None else pc.and_(out, equal)
        return np.asarray(out).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, seen, in_first = None, None, True

        def report(row: pa.RecordBatch, kind: int, found, is_open: bool) -> pa.RecordBatch:
            columns = [row.column(n) if n in keys else pa.nulls(1, row.schema.field(n).type) for n in row.schema.names
                       if n not in ("_t", "_side", "_spread")]
            names = [n for n in row.schema.names if n not in ("_t", "_side", "_spread")]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([found], pa.int64()), pa.array([is_open]), pa.array([part], pa.int32()), pa.array([kind], pa.int32())],
                [*names, "_found", "_open", "_part", "_kind"])

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            change = np.ones(n, bool)
            change[1:] = ~same(batch.slice(1), batch.slice(0, n - 1))
            if before is None:
                yield report(batch.slice(0, 1), FIRST, None, True)
            else:
                change[0] = not same(batch.slice(0, 1), before)[0]
            # Rows of the partition's first key.
            firsts = in_first & (np.cumsum(change) - (before is None) == 0)
            in_first = bool(firsts[-1])
            is_right = np.asarray(batch.column("_side")) == 0
            t = batch.column("_t").cast(pa.int64())
            timed = ~np.asarray(t.is_null())
            at = np.asarray(t.fill_null(0))
            # The last right row up to each row, and where the row's key began.
            place = np.arange(n)
            right = np.maximum.accumulate(np.where(is_right, place, -1))
            began = np.maximum.accumulate(np.where(change, place, -1))
            here = right >= np.maximum(began, 0)
            found = np.where(here, at[np.maximum(right, 0)], seen if seen is not None else 0)
            has = here | ((began < 0) & (seen is not None))
            opens = firsts & ~has
            left = np.flatnonzero(~is_right)
            names = [c for c in batch.schema.names if c not in ("_t", "_side", "_spread")]
            rows = batch.select(names).take(pa.array(left))
            has &= timed
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(found[left], pa.int64(), mask=~has[left]), pa.array((opens & timed)[left]),
                 pa.array(np.full(len(left), part, np.int32)), pa.array(np.full(len(left), ROW, np.int32))],
                [*names, "_found", "_open", "_part", "_kind"])
            # What the next batch goes on from.
            seen = int(at[right[-1]]) if here[-1] else seen if began[-1] < 0 else None
            before = batch.slice(n - 1, 1)
        if before is not None:
            yield report(before, LAST, seen, in_first)
    return run


def _carried(reports: list, keys: list[str]) -> list[tuple[int, int]]:
    """Per partition the time that its first key carries from the partitions before."""
    firsts = {r["_part"]: tuple(r[k] for k in keys) for r in reports if r["_kind"] == FIRST}
    out, key, time = [], None, None
    for r in sorted((r for r in reports if r["_kind"] == LAST), key=lambda r: r["_part"]):
        if key is not None and firsts[r["_part"]] == key and time is not None:
            out.append((r["_part"], time))
        last = tuple(r[k] for k in keys)
        # A partition of one key without a right row hands on what it was given.
        time = r["_found"] if r["_found"] is not None else time if r["_open"] and last == key else None
        key = last
    return out


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str,
                      right_ts: str, out: str = "match_ts") -> DataFrame:
    """Add ``out`` = min(right_ts) over right rows with equal ``keys`` and right_ts >= left_ts.

    NULL keys never match (SQL equality).  ``right`` must contain ``keys``
    and ``right_ts``; all ``left`` columns are kept.
    """
    nonnull = F.lit(True)
    for k in keys:
        nonnull = nonnull & F.col(k).isNotNull()
    # Right rows with equal keys and time are one.
    r = (right.filter(nonnull & F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_t"))
              .withColumns({"_side": F.lit(0), "_spread": F.lit(0).cast("long")}))
    plain = [c for c, t in left.dtypes if not t.startswith("map")]
    lx = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*plain).alias("_spread"))
    # Left rows of one instant may be split as well.
    order = [*keys, F.col("_t").desc(), "_side", "_spread"]
    u = lx.unionByName(r, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*left.schema.fields, T.StructField("_found", T.LongType()), T.StructField("_open", T.BooleanType()),
                           T.StructField("_part", T.IntegerType()), T.StructField("_kind", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    spark = left.sparkSession
    path = checkpoint_path(spark, f"as-of/{uuid.uuid4().hex}")
    u.mapInArrow(_scan(keys), schema).write.parquet(path)
    scanned = spark.read.schema(schema).parquet(path)
    reports = scanned.filter(F.col("_kind") < ROW).select(*keys, "_found", "_open", "_part", "_kind").collect()
    carry = spark.createDataFrame(_carried(reports, keys), "_part int, _carry long")
    # At most one row for each partition of the scan.
    rows = scanned.filter(F.col("_kind") == ROW).join(F.broadcast(carry), "_part", "left")
    micros = F.coalesce("_found", F.when(F.col("_open"), F.col("_carry")))
    zoned = isinstance(right.schema[right_ts].dataType, T.TimestampType)
    at = F.timestamp_micros(micros) if zoned else F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return rows.withColumn(out, at).select(*left.columns, out)
