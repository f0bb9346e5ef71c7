"""Instants, days and windows as columns. Whoever needs the present passes it in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Days of one request to an area feed.
CHUNK_DAYS = 10


def parsed(text: Column) -> Column:
    """An ISO instant; one without a zone is UTC; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}) (\d)", "$1T$2"))


def written(ts: Column) -> Column:
    """UTC with a Z; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.unix_micros(ts) % MICROS != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit("")), F.lit("Z"))


def within_days(ts: Column, start, end) -> Column:
    """From the first instant of start to the last of end: bounds, not a function of ts, so that scans can skip."""
    return (ts >= F.lit(start).cast("date").cast("timestamp_ntz")) & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def within_seconds(a: Column, b: Column, seconds: int = 60) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= seconds * MICROS


def days(start: Column, end: Column) -> Column:
    """Every day from start to end; none if end lies before it."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def chunks_backward(start: Column, end: Column, n: int = CHUNK_DAYS) -> Column:
    """(first, last) of spans of up to n days that cover start to end, the newest first."""
    count = F.ceil((F.datediff(end, start) + 1) / n).cast("int")
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda k: F.struct(
            F.greatest(start, F.date_sub(end, (k * n + n - 1).cast("int"))).alias("first"), F.date_sub(end, (k * n).cast("int")).alias("last")
        ),
    )
    return F.when(start <= end, spans).otherwise(F.array().cast("array<struct<first:date,last:date>>"))


def overlap(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Whether spans meet; an open end (null) reaches on without bound."""
    return (first.isNull() | (first <= end)) & (last.isNull() | (last >= start))


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * MICROS)).cast("bigint")


def finished(ts: Column, now: Column, unit: str = "hour") -> Column:
    """Whether the hour (or other unit) that an instant lies in was over by now."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz") + F.expr(f"interval 1 {unit}") <= now


def settled(ts: Column, now: Column, hours: int) -> Column:
    """Whether an instant lies so many hours back, so that all that belongs to it has come."""
    return ts <= now - F.expr(f"interval {hours} hours")
