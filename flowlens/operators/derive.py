"""Derivation jobs: reason imputation (D3), protocol default (D4), duplicate
marking (D5) and reconciliation checks (D6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.timeutil import hash_bucket

UNRESOLVED = ("failed", "rejected")


def reason_spread(ev: DataFrame) -> DataFrame:
    """Per status the known reasons with their share as an interval [lo, hi) of ``total`` messages.

    One row per (status, reason): as many as the vocabulary of reasons, however large ``ev`` is.
    """
    known = (ev.filter(F.col("status").isin(*UNRESOLVED) & F.col("reason_category").isNotNull())
               .groupBy("status", F.col("reason_category").alias("reason")).agg(F.count(F.lit(1)).alias("n")))
    by_status = Window.partitionBy("status")
    hi = F.sum("n").over(by_status.orderBy("reason"))
    return known.select("status", "reason", (hi - F.col("n")).alias("lo"), hi.alias("hi"),
                        F.sum("n").over(by_status).alias("total"))


def impute_reasons(ev: DataFrame) -> DataFrame:
    """D3: fill NULL reasons of failed/rejected messages as the known reasons of their status are spread.

    The draw is an md5 bucket of ``event_id``, so the same row always gets the
    same reason and a retried task writes the same data.  The spread comes in as
    one scalar value: no join, and no shuffle of the messages.  A status without
    any known reason keeps its NULLs.
    """
    spread = reason_spread(ev).agg(F.collect_list(F.struct("status", "reason", "lo", "hi", "total"))).scalar()
    draw = hash_bucket(F.col("event_id"), 2**31 - 1).cast("bigint")
    mine = F.filter("_spread", lambda s: (s["status"] == F.col("status")) & (draw % s["total"] >= s["lo"])
                    & (draw % s["total"] < s["hi"]))
    return (ev.withColumn("_spread", spread)
              .withColumn("reason_category", F.coalesce(F.col("reason_category"), F.get(mine, F.lit(0))["reason"]))
              .drop("_spread"))


def default_protocol(ev: DataFrame) -> DataFrame:
    """Protocol defaults to api on the api channel, else edi."""
    return ev.withColumn("protocol", F.coalesce(F.col("protocol"),
                                                F.when(F.col("channel") == "api", "api").otherwise("edi")))


def mark_duplicates(ev: DataFrame, keys=("partner", "doc_type", "control_number")) -> DataFrame:
    """Every repeat of a (partner, doc type, control number) after the first is a duplicate.

    The first occurrence per key comes from one partial aggregation, so a
    control number repeated millions of times is pre-reduced per task
    instead of sorted inside one window partition.  Only keys seen twice are joined back: few rows, which AQE
    broadcasts if their measured size allows.  A null partner or type is a value like others; a null control number is
    no duplicate.
    """
    k = list(keys)
    numbered = ev.filter(F.col("control_number").isNotNull())
    twice = (numbered.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)])
             .agg(F.min(F.struct("event_time", "event_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    same = reduce(Column.__and__, [ev[c].eqNullSafe(twice[f"_k{i}"]) for i, c in enumerate(k)])
    j = ev.join(twice, same, "left")
    later = F.struct("event_time", "event_id") != F.col("_first")
    return j.withColumn("is_duplicate", F.coalesce(later, F.lit(False))).select(*ev.columns, "is_duplicate")


def reconcile(ev: DataFrame, ru: DataFrame, ship: DataFrame) -> DataFrame:
    """Reconciliation checks as rows (check_name, lhs, rhs, ok).

    One aggregate over the events; the rollup and order totals join it as
    scalar subqueries (no join), and ``stack`` unpivots the checks.
    """
    d = F.col("doc_type")
    rollup_txns = ru.select(F.sum("txn_count").cast("bigint")).scalar()
    orders = ship.select(F.count(F.lit(1))).scalar()
    invoiced = ship.select(F.count_if(F.col("has_invoice"))).scalar()
    one = ev.agg(F.count(F.lit(1)).alias("events"),
                 *[F.count_if(d == t).alias(f"n{t}") for t in ("204", "990", "214", "210")]).select(
        "*", rollup_txns.alias("rollup_txns"), orders.alias("orders"), invoiced.alias("invoiced"))
    checks = [
        ("rollup txn_count = event rows", "rollup_txns", "events"),
        ("204 count = orders", "n204", "orders"),
        ("990 count = orders", "n990", "orders"),
        ("events = 204 + 990 + 214 + 210", "events", "(n204 + n990 + n214 + n210)"),
        ("210 count = invoiced orders", "n210", "invoiced"),
    ]
    stack = "stack({n}, {rows}) AS (check_name, lhs, rhs)".format(
        n=len(checks), rows=", ".join(f"'{c}', CAST({a} AS BIGINT), CAST({b} AS BIGINT)" for c, a, b in checks))
    return one.selectExpr(stack).withColumn("ok", F.col("lhs") == F.col("rhs"))
