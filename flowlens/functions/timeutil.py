"""Time, ratio and hashing helpers shared by every operator.

All of them return Column expressions (JVM-side, whole-stage codegen);
none of them is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000


def ts_lit(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the contract's batch timestamps are NTZ)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def as_of_col(as_of: str | _dt.datetime | Column | None) -> Column:
    """``now()`` of the reference, made explicit and repeatable.

    ``None`` means the wall clock (``localtimestamp()``, NTZ like the data).
    """
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    return ts_lit(as_of)


def trunc_ntz(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ and ignores the session time zone.

    Spark's ``date_trunc`` returns a zoned TIMESTAMP, so an NTZ value would go
    through the session zone (and its DST gaps); building the truncated value
    from its own fields keeps wall-clock semantics everywhere.
    """
    unit = unit.lower()
    y, mo = F.year(ts), F.month(ts)
    d = F.lit(1) if unit in ("month", "year") else F.dayofmonth(ts)
    if unit == "year":
        mo = F.lit(1)
    h = F.hour(ts) if unit == "hour" else F.lit(0)
    mi = F.minute(ts) if unit == "minute" else F.lit(0)
    if unit not in ("minute", "hour", "day", "month", "year"):
        raise ValueError(f"unsupported unit {unit}")
    return F.make_timestamp_ntz(y, mo, d, h, mi, F.lit(0))


def format_ntz(ts: Column, pattern: str) -> Column:
    """``date_format`` for TIMESTAMP_NTZ built from the value's own fields.

    Supports yyyy, yy, MM, dd, HH, mm, ss, SSS and quoted or plain literal
    characters; never consults the session time zone.
    """
    fields = {
        "yyyy": lambda: F.lpad(F.year(ts).cast("string"), 4, "0"),
        "yy": lambda: F.lpad((F.year(ts) % 100).cast("string"), 2, "0"),
        "MM": lambda: F.lpad(F.month(ts).cast("string"), 2, "0"),
        "dd": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"),
        "HH": lambda: F.lpad(F.hour(ts).cast("string"), 2, "0"),
        "mm": lambda: F.lpad(F.minute(ts).cast("string"), 2, "0"),
        "ss": lambda: F.lpad(F.second(ts).cast("string"), 2, "0"),
        "SSS": lambda: F.lpad((F.floor(F.extract(F.lit("SECOND"), ts) * 1000) % 1000).cast("bigint").cast("string"),
                              3, "0"),
    }
    parts, i = [], 0
    while i < len(pattern):
        if pattern[i] == "'":
            j = pattern.index("'", i + 1)
            parts.append(F.lit(pattern[i + 1:j]))
            i = j + 1
            continue
        for tok in ("yyyy", "SSS", "yy", "MM", "dd", "HH", "mm", "ss"):
            if pattern.startswith(tok, i):
                parts.append(fields[tok]())
                i += len(tok)
                break
        else:
            parts.append(F.lit(pattern[i]))
            i += 1
    return F.concat(*parts)


def _micros_of_day(ts: Column) -> Column:
    whole = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    return whole + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def micros_between(start: Column, end: Column) -> Column:
    """``extract(epoch from end - start) * 1e6`` as BIGINT for TIMESTAMP_NTZ.

    Built from calendar days and time-of-day fields, so it never passes
    through the session time zone (``timestamp_diff`` does, and shifts
    wall-clock times that fall in a DST gap).
    """
    days = F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")
    return days * F.lit(86_400_000_000) + _micros_of_day(end) - _micros_of_day(start)


def minutes_between(start: Column, end: Column) -> Column:
    """Fractional minutes from ``start`` to ``end`` (DOUBLE)."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_MINUTE))


def round_minutes(start: Column, end: Column) -> Column:
    """``round(extract(epoch from end-start)/60)`` as BIGINT."""
    return F.round(minutes_between(start, end)).cast("bigint")


def add_minutes(ts: Column, minutes) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes), ts)


def add_hours(ts: Column, hours) -> Column:
    return F.timestamp_add("HOUR", _c(hours), ts)


def add_days(ts: Column, days) -> Column:
    return F.timestamp_add("DAY", _c(days), ts)


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """``round(100.0 * num / nullif(den, 0), scale)`` as DOUBLE; NULL on 0."""
    return F.round(F.lit(100.0) * num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), scale)


def div_half_up(num: Column, den: Column) -> Column:
    """round(num / den) half-up for non-negative integers, in exact integer arithmetic.

    Used where a ratio is reported at a fixed scale and ties (x.xx5) must round
    the same way in every engine; floating-point rounding does not guarantee it.
    """
    return F.call_function("div", num.cast("bigint") * 2 + den.cast("bigint"), den.cast("bigint") * 2)


def safe_ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def hash_bucket(key: Column, n: int) -> Column:
    """Deterministic bucket in [0, n) from the first 32 bits of md5(key).

    Replaces the engine-internal ``abs(hashtext(x)) % n``; md5 gives the
    same bucket in any engine, so splits are stable across retries.
    """
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def breached(as_of: Column, sla_col: str = "sla_due_at", terminal_col: str = "terminal") -> Column:
    """M2: ``sla_due_at < now() AND NOT terminal`` (NULL due date -> NULL)."""
    return (F.col(sla_col) < as_of) & ~F.col(terminal_col)


def pick(index: Column, values: list) -> Column:
    """``values[index]`` for a small fixed list, as a CASE expression."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
