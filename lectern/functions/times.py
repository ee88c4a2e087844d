"""Media times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(s: Column) -> Column:
    """h:mm:ss.ff from an hour on, else mm:ss.ff; seconds are rounded after the split, so 59.999 gives 00:60.00."""
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    rest = s - F.floor(s / 60) * 60
    return F.when(h > 0, F.format_string("%d:%02d:%05.2f", h, m, rest)).otherwise(F.format_string("%02d:%05.2f", m, rest))


def hhmmss(s: Column, wrap: bool = False) -> Column:
    """hh:mm:ss, truncated; wrap starts again at 24 hours."""
    t = F.floor(s).cast("long")
    h = F.floor(t / 3600).cast("long")
    return F.format_string("%02d:%02d:%02d", h % 24 if wrap else h, F.floor(t / 60).cast("long") % 60, t % 60)


def hhmmss_rounded(s: Column) -> Column:
    """As hhmmss, rounded half to even first."""
    return hhmmss(F.bround(s))


def srt(s: Column, wrap: bool = False) -> Column:
    """hh:mm:ss,mmm; hours may exceed 24 unless wrapped."""
    ms = F.bround(s * 1000).cast("long")
    h = F.floor(ms / 3_600_000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", h % 24 if wrap else h, F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def span(a: Column, b: Column) -> Column:
    return F.format_string("%.3fs - %.3fs", a, b)


def stamp(c: Column) -> Column:
    """A wall-clock stamp, or null where it isn't one."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))
