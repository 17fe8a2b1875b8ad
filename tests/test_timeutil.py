"""NTZ helpers must not depend on the session time zone (DST gaps included)."""

import datetime as dt

from pyspark.sql import functions as F

from flowlens.functions.timeutil import format_ntz, micros_between, trunc_ntz

GAP = dt.datetime(2001, 4, 1, 2, 30, 15, 123000)   # inside the US DST gap
LATER = dt.datetime(2001, 4, 2, 1, 0, 0)


def _eval(spark):
    df = spark.createDataFrame([(GAP, LATER)], "a timestamp_ntz, b timestamp_ntz")
    return df.select(trunc_ntz("hour", F.col("a")).alias("h"), trunc_ntz("day", F.col("a")).alias("d"),
                     trunc_ntz("month", F.col("a")).alias("m"), micros_between(F.col("a"), F.col("b")).alias("us"),
                     format_ntz(F.col("a"), "yyyyMMddHHmmssSSS").alias("f"),
                     format_ntz(F.col("a"), "yyyy-MM-dd'T'HH:mm:ss").alias("g")).first()


def test_ntz_helpers_ignore_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = _eval(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = _eval(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert ny == utc
    assert utc.h == dt.datetime(2001, 4, 1, 2, 0) and utc.d == dt.datetime(2001, 4, 1) and utc.m == dt.datetime(2001, 4, 1)
    assert utc.us == int((LATER - GAP).total_seconds() * 1_000_000)
    assert utc.f == "20010401023015123" and utc.g == "2001-04-01T02:30:15"
