"""Dashboard query shapes over any DataFrame.

Each shape is the DataFrame a chart would request: filters, grouping,
metric expressions, ordering and the row limit the chart sets.  Limits are
the feature here (a worklist or top-N), and every ordered limit gets a full
tie-break on the remaining output columns so the kept rows are
deterministic.  Window post-processing (share of total, percent rank, funnel
share, period lag) is expressed in the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col, trunc_ntz

Metric = tuple[str, Column]  # (label, aggregate expression)


def _order_cols(order: Sequence[tuple[str, bool]], tie: Sequence[str]) -> list[Column]:
    cols = [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    used = {c for c, _ in order}
    return cols + [F.col(c).asc_nulls_first() for c in tie if c not in used]


# ------------------------------------------------------------------- filters
def scope(df: DataFrame, filters: Mapping[str, Sequence] | None = None, time_col: str | None = None,
          time_range: tuple | None = None) -> DataFrame:
    """dashboard scope; multi-select filters applied only where the column exists."""
    for col, values in (filters or {}).items():
        if col in df.columns and values:
            df = df.filter(F.col(col).isin(list(values)))
    if time_col and time_range and time_col in df.columns:
        lo, hi = time_range
        if lo is not None:
            df = df.filter(F.col(time_col) >= lo)
        if hi is not None:
            df = df.filter(F.col(time_col) < hi)
    return df


def drill(df: DataFrame, key: str, value=None) -> DataFrame:
    """a required drill filter -- empty until a key value is chosen."""
    return df.filter(F.lit(False)) if value is None else df.filter(F.col(key) == value)


def cross_filter(df: DataFrame, col: str, value) -> DataFrame:
    """a value selected in one chart scopes the targets that name ``col``."""
    return df.filter(F.col(col) == value) if col in df.columns else df


def within(df: DataFrame, ts: str, days: int = 0, hours: int = 0, as_of=None) -> DataFrame:
    """relative window ending at ``as_of`` (last N days / hours)."""
    now = as_of_col(as_of)
    start = F.timestamp_add("HOUR", F.lit(-(days * 24 + hours)), now)
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= now))


def where(df: DataFrame, *preds) -> DataFrame:
    """row filters -- Column predicates or SQL text."""
    for p in preds:
        df = df.filter(F.expr(p) if isinstance(p, str) else p)
    return df


def flag_below(df: DataFrame, col: str, threshold: float, name: str | None = None) -> DataFrame:
    """boolean threshold flag (days_left < 7, pct_met < 95, health < 70)."""
    return df.withColumn(name or f"{col}_below_{threshold:g}", F.col(col) < F.lit(threshold))


# -------------------------------------------------------------------- shapes
def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or the first ``limit`` where a caller asks for a report of that length."""
    return df if limit is None else df.limit(limit)


def worklist(df: DataFrame, cols: Sequence[str], order: Sequence[tuple[str, bool]] = (),
             limit: int | None = None) -> DataFrame:
    """Q1/L1: raw table -- selected columns (order columns included), ordered, limited."""
    keep = list(cols) + [c for c, _ in order if c not in cols]
    return _limited(df.select(*keep).orderBy(*_order_cols(order, keep)), limit)


def agg_table(df: DataFrame, by: Sequence[str], metrics: Sequence[Metric], limit: int | None = None) -> DataFrame:
    """Q2: aggregate table ordered by the first metric (desc), limited."""
    g = df.groupBy(*by).agg(*[m.alias(n) for n, m in metrics])
    return _limited(g.orderBy(*_order_cols([(metrics[0][0], False)], list(by) + [n for n, _ in metrics[1:]])), limit)


def big_number(df: DataFrame, metric: Metric, trend_col: str | None = None, grain: str = "day") -> DataFrame:
    """Q3: one value; with ``trend_col`` the per-``grain`` trend instead."""
    name, m = metric
    if trend_col is None:
        return df.agg(m.alias(name))
    return df.groupBy(trunc_ntz(grain, F.col(trend_col)).alias(trend_col)).agg(m.alias(name))


def time_series(df: DataFrame, ts: str, grain: str, metric: Metric, series: str | None = None,
                limit: int | None = None) -> DataFrame:
    """Q4: metric per time grain (and series), sorted by time, limited."""
    name, m = metric
    keys = [trunc_ntz(grain, F.col(ts)).alias(ts)] + ([F.col(series)] if series else [])
    g = df.groupBy(*keys).agg(m.alias(name))
    return _limited(g.orderBy(*_order_cols([(ts, True)], ([series] if series else []) + [name])), limit)


def share(df: DataFrame, dims: Sequence[str], metric: Metric) -> DataFrame:
    """Q5 + W3: category value and its share of the total.

    The total is a scalar subquery over the grouped result, not a window over
    one partition.
    """
    name, m = metric
    g = df.groupBy(*dims).agg(m.alias(name))
    total = g.select(F.sum(name)).scalar()
    return g.withColumn("contribution", F.col(name).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))


def hierarchy(df: DataFrame, dims: Sequence[str], metric: Metric) -> DataFrame:
    """Q5 (treemap / sunburst): values with parent totals via ``rollup``."""
    name, m = metric
    return df.rollup(*dims).agg(m.alias(name), F.grouping_id().alias("level"))


def pivot_long(df: DataFrame, rows: Sequence[str], cols: Sequence[str], metric: Metric) -> DataFrame:
    """Q6 (long form): every (row, col) cell plus row, column and grand totals via ``cube``."""
    name, m = metric
    return df.cube(*rows, *cols).agg(m.alias(name), F.grouping_id().alias("level"))


def pivot_wide(df: DataFrame, rows: Sequence[str], col: str, values: Sequence, metric: Metric) -> DataFrame:
    """Q6 (wide form): ``values`` must be given -- they become column names."""
    name, m = metric
    return df.groupBy(*rows).pivot(col, list(values)).agg(m)


def gauge(df: DataFrame, metric: Metric, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Q7: one metric with its bounds."""
    name, m = metric
    return df.agg(m.alias(name)).select(name, F.lit(lo).alias("min_val"), F.lit(hi).alias("max_val"))


def heatmap(df: DataFrame, x: str, y: str, metric: Metric) -> DataFrame:
    """Q8 + W4: (x, y) cells with the percent rank of each cell's value."""
    name, m = metric
    return percent_rank(df.groupBy(x, y).agg(m.alias(name)), name)


RANK_RANGES = 64


def percent_rank(df: DataFrame, value: str, out: str = "rank_pct", ranges: int = RANK_RANGES) -> DataFrame:
    """(rank - 1) / (rows - 1) of each row's ``value``, smallest first, nulls last, ties sharing a rank.

    No window spans all rows: rows are counted per value, values fall into ``ranges`` ranges between approximate
    percentiles, a running sum within each range counts the smaller values, and each range starts at the total of
    the ranges before it (an array of ``ranges`` sums, one scalar value).  The counts join back by value.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.select(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000)).scalar()
    # Where no value is known there is no cut: all rows are of one range.
    in_range = F.when(F.col(value).isNull(), ranges).otherwise(
        F.coalesce(F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value))), F.lit(0))).cast("int")
    counts = counts.withColumn("_cuts", cuts).withColumn("_range", in_range).drop("_cuts")
    totals = counts.groupBy("_range").agg(F.sum("_n").alias("_n")).agg(F.collect_list(F.struct("_range", "_n"))).scalar()
    before = F.aggregate(F.filter(F.col("_totals"), lambda t: t["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda s, t: s + t["_n"])
    smaller = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(F.col(value).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    rows = F.aggregate(F.col("_totals"), F.lit(0).cast("long"), lambda s, t: s + t["_n"])
    ranks = counts.withColumn("_totals", totals).select(F.col(value).alias("_v"), F.when(rows > 1, (before + smaller) / (rows - 1)).otherwise(
        F.lit(0.0)).cast("double").alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"])).drop("_v")


def funnel(df: DataFrame, stage: str, order: str, metric: Metric) -> DataFrame:
    """Q9 + W5: value per stage and its share of the first stage (scalar subquery)."""
    name, m = metric
    g = df.groupBy(stage, order).agg(m.alias(name))
    first = g.filter(F.col(order) == g.select(F.min(order)).scalar()).select(F.max(name)).scalar()
    return g.withColumn("share_of_first", F.col(name).cast("double") / F.nullif(first.cast("double"), F.lit(0.0)))


def top_n(df: DataFrame, dim: str, metric: Metric, n: int = 10, series: str | None = None) -> DataFrame:
    """L2/Q10: top ``n`` (dim[, series]) rows by metric (limit applies to dim x series rows)."""
    name, m = metric
    keys = [dim] + ([series] if series else [])
    g = df.groupBy(*keys).agg(m.alias(name))
    return g.orderBy(*_order_cols([(name, False)], keys)).limit(n)


def distinct_grid(df: DataFrame, cols: Sequence[str], order: Sequence[tuple[str, bool]] = (),
                  limit: int | None = None) -> DataFrame:
    """Q11: aggregate mode with dimensions and no metric -> distinct rows."""
    d = df.select(*cols).distinct()
    return _limited(d.orderBy(*_order_cols(order, list(cols))), limit)


def histogram(df: DataFrame, value: str, width: float, by: str | None = None) -> DataFrame:
    """Q12: counts per ``width`` bin of ``value`` (per ``by``)."""
    b = (F.floor(F.col(value) / F.lit(width)) * F.lit(width)).alias("bin_start")
    keys = ([F.col(by)] if by else []) + [b]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], tie: str = "event_id") -> DataFrame:
    """L3: first row per key by ``order``, then ``tie`` -- ``min_by`` in one partial aggregation."""
    s = F.min_by(F.struct(*cols), F.struct(order, tie)).alias("_f")
    return df.groupBy(*keys).agg(s).select(*keys, "_f.*")


def compare_lag(df: DataFrame, ts: str, metric: Metric, periods: int = 7, grain: str = "day") -> DataFrame:
    """Metric per period next to the value ``periods`` periods earlier.

    The earlier value comes from an equi-join on the shifted period, so the
    series is never gathered into a single window partition.
    """
    name, m = metric
    unit = grain.upper()
    g = df.groupBy(trunc_ntz(grain, F.col(ts)).alias("period")).agg(m.alias(name))
    prev = g.select(F.timestamp_add(unit, F.lit(periods), F.col("period")).alias("period"),
                    F.col(name).alias(f"{name}_prev"))
    j = g.join(prev, "period", "left")
    return j.withColumn("change_pct", F.round(F.lit(100.0) * (F.col(name) - F.col(f"{name}_prev")).cast("double")
                                              / F.nullif(F.col(f"{name}_prev").cast("double"), F.lit(0.0)), 2))
