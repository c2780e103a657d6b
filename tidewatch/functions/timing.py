"""Timestamps and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import strip

_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$"


def epoch_index(seconds: Column, epoch_seconds: int) -> Column:
    return F.floor(seconds / F.lit(float(epoch_seconds))).cast("long")


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def number_seconds(text: Column) -> Column:
    raw = strip(text)
    value = raw.try_cast("double")
    # Java also reads '1d' and '0x1p3' as numbers; a plain number ends in a digit or a point
    plain = F.ascii(F.substring(raw, -1, 1)).between(46, 57) & (F.instr(F.lower(raw), "x") == 0)
    return F.when(plain & finite(value), value)


def timestamp_seconds(text: Column) -> Column:
    """Numeric seconds, else ISO-8601 that carries an offset; text without offset is no instant."""
    raw = strip(text)
    instant = F.when(raw.rlike(_OFFSET), F.unix_micros(F.try_to_timestamp(raw)) / F.lit(1e6))
    return F.coalesce(number_seconds(text), instant)


def naive_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
