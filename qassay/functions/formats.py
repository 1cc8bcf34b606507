"""Display formats for durations, sizes, percentages and speed ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(seconds: Column) -> Column:
    s = F.bround(seconds.cast("double")).cast("bigint")
    return F.when(
        seconds.isNotNull(),
        F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60),
    )


def duration(seconds: Column) -> Column:
    s = F.bround(seconds.cast("double")).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(seconds.isNull(), "—")
        .when(h > 0, F.format_string("%dh %02dm", h, m))
        .when(m > 0, F.format_string("%dm %02ds", m, s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def size(n_bytes: Column) -> Column:
    return (
        F.when(n_bytes.isNull(), "—")
        .when(n_bytes >= 1e9, F.format_string("%.2f GB", n_bytes / F.lit(1e9)))
        .otherwise(F.format_string("%.0f MB", n_bytes / F.lit(1e6)))
    )


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.1f%%", value.cast("double")))


def speedup(baseline: Column, candidate: Column) -> Column:
    usable = baseline.isNotNull() & (candidate > 0)
    return F.when(usable, F.format_string("%.1f×", baseline.cast("double") / candidate)).otherwise("—")
