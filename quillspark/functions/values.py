"""Ids, dates and numbers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once, however often body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def record_id(version: str, *parts: Column | str) -> Column:
    """SHA-256 of the parts; a null part is an empty one."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(version), *texts), 256)


def in_range(day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive; a missing bound is open."""
    ok = F.lit(True)
    if start is not None:
        ok &= day >= F.lit(start).cast("date")
    if end is not None:
        ok &= day <= F.lit(end).cast("date")
    return ok


def utc_time(text: Column) -> Column:
    """Compact or ISO times, without an offset UTC; anything else fails."""
    found = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), text.try_cast("timestamp")
    )
    return F.when(text.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no such time: "), text)))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is null or zero."""
    return F.try_divide(top, bottom)


def share_of_percent(text: Column) -> Column:
    """0..100 as a share; null for anything else."""
    value = text.try_cast("double")
    return F.when(value.between(0, 100), value / 100)


def whole_number(text: Column) -> Column:
    """A whole number of at least 0; null for anything else."""
    value = text.try_cast("double")
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


def political_share(political: Column, matched: Column) -> Column:
    """0.0 when nothing matched, null when signals are off."""
    return F.when(political.isNull(), None).when(matched == 0, 0.0).otherwise(political / matched)


def relative_day(day: Column, origin: Column) -> Column:
    return F.datediff(day, origin)


def period(day: Column, start: Column, end: Column) -> Column:
    """before, during or after the event, whose days are both included."""
    return F.when(day < start, "before").when(day > end, "after").otherwise("during")


def alert_rank(level: Column) -> Column:
    return F.when(level == "Red", 3).when(level == "Orange", 2).when(level == "Green", 1)


def resolution(median_gap: Column, days: Column) -> Column:
    """Name of the spacing of a series."""
    return (
        F.when(days == 0, "empty").when(days == 1, "single_point").when(median_gap == 1, "daily")
        .when(median_gap.between(6, 8), "weekly").when(median_gap.between(27, 32), "monthly").otherwise("irregular")
    )
