"""Stored tables bucketed by a join key, for joins and aggregations without a shuffle.

Tables that are joined on a stable key again and again are stored once in hash buckets of that key: as many for all
of them as make the largest one's about ``TARGET_BYTES`` each.  A
bucket is one task: where a key holds so many rows that its bucket would be ``MOST_SKEW`` times the mean, the
table is not bucketed and the join shuffles, with AQE splitting the hot partition.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.sources.tables import folder_bytes

#: One task sorts a bucket, whose rows take some 25 times its bytes in memory.
TARGET_BYTES = 16 * 1024 * 1024
MOST_SKEW = 4


def buckets_for(n_bytes: int, target: int = TARGET_BYTES) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n_bytes) / target)))


def store_together(path: str, *tables: tuple[DataFrame, list[str]], n_buckets: int | None = None,
                   target: int = TARGET_BYTES) -> list[DataFrame]:
    """The tables, each with its keys, written below ``path`` in one number of buckets, set by the largest if not given."""
    written = []
    for i, (df, keys) in enumerate(tables):
        df.write.mode("overwrite").parquet(f"{path}/{i}/rows")
        written.append((df.sparkSession.read.schema(df.schema).parquet(f"{path}/{i}/rows"), keys, f"{path}/{i}"))
    n = n_buckets or buckets_for(max(folder_bytes(rows.sparkSession, f"{p}/rows") for rows, _, p in written), target)
    return [_bucketed(rows, keys, p, n) for rows, keys, p in written]


def _bucketed(rows: DataFrame, keys: list[str], path: str, n: int) -> DataFrame:
    # Counted by bucket: a row per task and bucket is shuffled, not one per key.  Only a bucket that is too large is counted by
    # key.  NULL keys join with nothing, but stand in one bucket like a key.
    bucket = F.pmod(F.hash(*keys), F.lit(n))
    sizes = rows.groupBy(bucket.alias("b")).count().agg(F.max("count"), F.sum("count"), F.max_by("b", "count")).first()
    largest, total, at = sizes
    if n > 1 and largest and largest > MOST_SKEW * total / n:
        hottest = rows.filter(bucket == at).groupBy(*keys).count().agg(F.max("count")).first()[0]
        if hottest > MOST_SKEW * total / n:
            return rows
    name = "flowlens_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    # One task a bucket writes one file of it.
    (rows.repartition(n, *keys).write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys)
         .option("path", f"{path}/buckets").saveAsTable(name))
    return rows.sparkSession.table(name)
