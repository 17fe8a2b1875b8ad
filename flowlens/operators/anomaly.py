"""Feed volume anomalies.

``feed_anomaly`` computes the 21-day baseline, the 7-day current window and
the all-history last-active day in ONE ``groupBy`` of conditional
aggregates over the daily feed table -- the reference's three CTEs and two
joins collapse into a single scan and shuffle.  The as-of anchor (last
complete day) is a scalar subquery, not a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.timeutil import trunc_ntz
FEED_KEYS = ["environment", "partner", "doc_type"]
BASE_DAYS = 21
CUR_DAYS = 7
GAP_DAYS = 7


def feed_daily(ru: DataFrame) -> DataFrame:
    """Per feed and day -> txns, errors, breached."""
    return (ru.groupBy(*FEED_KEYS, F.to_date("bucket").alias("day"))
              .agg(F.sum("txn_count").cast("bigint").alias("txns"),
                   F.sum(F.col("failed_count") + F.col("rejected_count")).cast("bigint").alias("errors"),
                   F.sum("breached_count").cast("bigint").alias("breached")))


def asof_day(ru: DataFrame) -> Column:
    """The last complete day of the rollup, as a scalar-subquery Column."""
    last_bucket = ru.select(F.max("bucket")).scalar()
    complete = ru.filter(F.col("bucket") < trunc_ntz("day", last_bucket))
    return complete.select(F.max(F.to_date("bucket"))).scalar()


def asof_day_frame(ru: DataFrame) -> DataFrame:
    return ru.sparkSession.range(1).select(asof_day(ru).alias("asof_day"))


def _status(base_mean: Column, cur_mean: Column, z: Column, drop: Column) -> Column:
    return (F.when((base_mean >= 5) & (cur_mean == 0), "Silent")
             .when((z <= -2) | (drop >= 50), "Severe drop")
             .when(z <= -1, "Watch").otherwise("Normal"))


def feed_anomaly(daily: DataFrame, asof: Column, min_base_mean: float = 3.0) -> DataFrame:
    """A10: baseline mean / sigma, current mean, z-score, drop %, days silent, status.

    base_mean and cur_mean divide by the fixed window length (absent days
    count as zero) while base_sd is over present days only (M9); sd = 0 gives
    a NULL z-score and falls through to the drop test (M10).
    """
    day = F.col("day")
    in_base = day.between(F.date_sub(asof, BASE_DAYS + GAP_DAYS - 1), F.date_sub(asof, GAP_DAYS))
    in_cur = day.between(F.date_sub(asof, CUR_DAYS - 1), asof)
    g = daily.groupBy(*FEED_KEYS).agg(
        F.count(F.when(in_base, 1)).alias("base_days"),
        F.sum(F.when(in_base, F.col("txns"))).alias("base_sum"),
        F.stddev_pop(F.when(in_base, F.col("txns").cast("double"))).alias("sd"),
        F.sum(F.when(in_cur, F.col("txns"))).alias("cur_sum"),
        F.max(F.when(F.col("txns") > 0, day)).alias("last_active_day"))
    base_mean = F.col("base_sum").cast("double") / F.lit(float(BASE_DAYS))
    cur_mean = F.coalesce(F.col("cur_sum").cast("double") / F.lit(float(CUR_DAYS)), F.lit(0.0))
    base_sd = F.coalesce(F.col("sd"), F.lit(0.0))
    g = (g.filter(F.col("base_days") > 0)
          .select(*FEED_KEYS, base_mean.alias("bm"), base_sd.alias("bsd"), cur_mean.alias("cm"), "last_active_day"))
    bm, bsd, cm = F.col("bm"), F.col("bsd"), F.col("cm")
    z = (cm - bm) / F.nullif(bsd, F.lit(0.0))
    drop = F.lit(100.0) * (bm - cm) / F.nullif(bm, F.lit(0.0))
    silent_days = F.greatest(F.datediff(asof, F.col("last_active_day")), F.lit(0))
    return (g.filter(bm >= min_base_mean).select(
        *FEED_KEYS,
        F.round(bm, 1).alias("base_mean"), F.round(bsd, 1).alias("base_sd"), F.round(cm, 1).alias("cur_mean"),
        F.nullif(silent_days, F.lit(0)).alias("days_silent"), "last_active_day",
        F.round(z, 2).alias("zscore"), F.round(drop, 0).alias("drop_pct"),
        _status(bm, cm, z, drop).alias("status")))


def partner_anomaly(fa: DataFrame) -> DataFrame:
    """Worst-of feed status per (environment, partner)."""
    st = F.col("status")
    silent = F.count_if(st == "Silent")
    severe = F.count_if(st == "Severe drop")
    watch = F.count_if(st == "Watch")
    return fa.groupBy("environment", "partner").agg(
        F.count(F.lit(1)).alias("feeds"), silent.alias("silent_feeds"), severe.alias("severe_drop_feeds"),
        F.count_if(st.isin("Silent", "Severe drop", "Watch")).alias("abnormal_feeds"),
        F.round(F.min("zscore"), 2).alias("worst_z"), F.round(F.max("drop_pct"), 0).alias("worst_drop_pct"),
        F.round(F.sum("base_mean"), 0).alias("base_mean_total"), F.round(F.sum("cur_mean"), 0).alias("cur_mean_total"),
        F.when(silent > 0, "Silent").when(severe > 0, "Severe drop").when(watch > 0, "Watch")
         .otherwise("Normal").alias("status"))


def every_day(daily: DataFrame) -> DataFrame:
    """Each feed's days from its first to the newest of any feed; ``txns`` is NULL on days without a message.

    The calendar and the known days meet in one aggregation on (feed, day), which pre-reduces both on the mappers.
    """
    last = daily.select(F.max("day")).scalar()
    calendar = daily.groupBy(*FEED_KEYS).agg(F.min("day").alias("first")).select(
        *FEED_KEYS, F.explode(F.sequence("first", last)).alias("day"), F.lit(None).cast("bigint").alias("txns"))
    return calendar.unionByName(daily.select(*FEED_KEYS, "day", "txns")).groupBy(*FEED_KEYS, "day").agg(F.max("txns").alias("txns"))


def trailing_baseline(daily: DataFrame, min_base_mean: float = 3.0) -> DataFrame:
    """The A10 statistics for every day of every feed, from its first day to the newest day of any feed.

    Silent days have rows too (``every_day``), so a feed that stopped shows as ``Silent`` from its seventh silent day on.
    Range frames over the day number (``rangeBetween``) give the 21-day
    baseline ending 7 days back and the trailing 7-day window; absent days
    count as zero in the means and not at all in the deviation, as in A10.
    """
    daily = every_day(daily)
    dn = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*FEED_KEYS).orderBy("_dn")
    base_w = w.rangeBetween(-(BASE_DAYS + GAP_DAYS - 1), -GAP_DAYS)
    cur_w = w.rangeBetween(-(CUR_DAYS - 1), 0)
    d = daily.withColumn("_dn", dn)
    t = d.select(*FEED_KEYS, "day", F.coalesce("txns", F.lit(0)).cast("bigint").alias("txns"),
                 F.count("txns").over(base_w).alias("base_days"),
                 (F.coalesce(F.sum("txns").over(base_w), F.lit(0)).cast("double") / BASE_DAYS).alias("bm"),
                 F.coalesce(F.stddev_pop(F.col("txns").cast("double")).over(base_w), F.lit(0.0)).alias("bsd"),
                 (F.coalesce(F.sum("txns").over(cur_w), F.lit(0)).cast("double") / CUR_DAYS).alias("cm"))
    bm, bsd, cm = F.col("bm"), F.col("bsd"), F.col("cm")
    z = (cm - bm) / F.nullif(bsd, F.lit(0.0))
    drop = F.lit(100.0) * (bm - cm) / F.nullif(bm, F.lit(0.0))
    return (t.filter((F.col("base_days") > 0) & (bm >= min_base_mean))
             .select(*FEED_KEYS, "day", "txns", F.round(bm, 1).alias("base_mean"), F.round(bsd, 1).alias("base_sd"),
                     F.round(cm, 1).alias("cur_mean"), F.round(z, 2).alias("zscore"),
                     F.round(drop, 0).alias("drop_pct"), _status(bm, cm, z, drop).alias("status")))
