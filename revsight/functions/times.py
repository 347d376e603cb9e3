"""Time expressions over timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a background review reports at the start of each stage, in percent.
STAGES = {"starting": 0, "cloning": 10, "listing": 20, "scoring": 80, "saving": 90, "finished": 100}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end``, with fractions."""
    return (_col(end) - _col(start)).cast("interval second").cast("decimal(20,6)").cast("double")


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Full days of 24 hours, rounded down."""
    return F.floor(seconds_between(start, end) / 86400.0)


def days_before(as_of: str, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {days} DAYS")


def month_start(as_of: str) -> Column:
    """First day of the month, at midnight."""
    return F.date_trunc("month", moment(as_of)).cast("timestamp_ntz")


def week_key(ts: Column | str) -> Column:
    """Year and number of the week that starts on Sunday, days before the first Sunday in week 00."""
    ts = _col(ts)
    week = F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) - 1)) / 7)
    return F.format_string("%04d-W%02d", F.year(ts), week)


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def eta_seconds(elapsed: Column | str, progress: Column | str) -> Column:
    """Seconds left at the pace so far, cut to an integer; null unless 0 < progress < 1."""
    p = _col(progress)
    return F.when((p > 0) & (p < 1), (_col(elapsed) / p - _col(elapsed)).cast("long"))


def relative(seconds: Column | str) -> Column:
    """How long ago, in words."""
    s = _col(seconds)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def progress_percent(progress: Column | str) -> Column:
    """A share as a whole number of percent, halves up."""
    return F.floor(_col(progress) * 100 + 0.5).cast("long")


def whole_minutes(seconds: Column | str) -> Column:
    """Minutes, begun ones counted in full."""
    return F.ceil(_col(seconds) / 60)


def task_progress(stage: Column | str, done: Column | str, total: Column | str) -> Column:
    """Percent that a background review reports: its stage's fixed value, and 20 to 80 over the files while they are analysed."""
    s, n = _col(stage), F.greatest(_col(total), F.lit(1))
    out = F.when(s == "analysing", 20 + F.floor(_col(done) * 60 / n))
    for name, value in STAGES.items():
        out = out.when(s == name, value)
    return out.cast("long")
