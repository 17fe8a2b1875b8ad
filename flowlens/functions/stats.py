"""Scalable exact statistics.

``percentile_cont_by`` gives PostgreSQL's ``percentile_cont(q) WITHIN GROUP``
per group without holding a group's values in one task: the values are first
counted per (group, value) -- a partial aggregation, so a hot group is
pre-reduced on every mapper -- and the cumulative counts are taken over the
distinct values only.  For discrete measures (latencies in whole
milliseconds, counts) the distinct-value table is small and bounded by the
value domain, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile_cont_by(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy(*keys)
    h = (hist.withColumn("_cum", F.sum("_c").over(w))
             .withColumn("_n", F.sum("_c").over(wt)))
    # 0-based rank positions of the two neighbours around q * (n - 1).
    pos = F.lit(q) * (F.col("_n") - 1)
    h = h.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)).withColumn("_frac", pos - F.floor(pos))
    # The value at 0-based rank r is the smallest value whose cumulative count exceeds r.
    g = h.groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") > F.col("_lo"), F.col("_v"))).alias("_vlo"),
        F.min(F.when(F.col("_cum") > F.col("_hi"), F.col("_v"))).alias("_vhi"),
        F.first("_frac").alias("_frac"))
    vlo, vhi = F.col("_vlo").cast("double"), F.col("_vhi").cast("double")
    return g.select(*keys, (vlo + F.col("_frac") * (vhi - vlo)).alias(out))
