"""Score expressions: guarded averages, trends, severities and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_rank(severity: Column | str) -> Column:
    """critical 4 down to low 1; anything else counts as low."""
    s = _col(severity)
    out = F.lit(1)
    for name, rank in reversed(SEVERITY_RANK.items()):
        out = F.when(s == name, rank).otherwise(out)
    return out


def round2(value: Column, digits: int = 2) -> Column:
    """Round half away from zero, after noise beyond eight digits is taken off."""
    return F.round(F.round(value, 8), digits)


def truthy(value: Column | str) -> Column:
    """Neither null nor zero."""
    v = _col(value)
    return v.isNotNull() & (v != 0)


def mean_or_zero(value: Column, digits: int = 2) -> Column:
    return F.coalesce(round2(F.avg(value), digits), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole; 0 where whole is 0."""
    return F.when(whole > 0, round2(part / whole * 100.0, digits)).otherwise(F.lit(0.0))


def trend(change: Column, band: float) -> Column:
    return F.when(change > band, "improving").when(change < -band, "declining").otherwise("stable")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def clamp(value: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(value)))


def band(score: Column | str) -> Column:
    """Colour of a score from 0 to 10; nothing measured is muted."""
    s = _col(score)
    return F.when(s.isNull() | (s == 0), "muted").when(s >= 8, "green").when(s >= 6, "yellow").otherwise("red")


def quality_metrics(critical: Column, high: Column, medium: Column, low: Column, security: Column, maintainability: Column, performance: Column, files: Column) -> dict[str, Column]:
    """The four scores of a review from its issue counts; ``files``: analysed files, at least 1 is assumed."""
    f = F.greatest(files, F.lit(1)).cast("double")
    score = lambda weight: round2(F.greatest(F.lit(0.0), F.lit(10.0) - weight / f))
    return {
        "code_quality_score": score(critical * 3.0 + high * 2.0 + medium * 1.0 + low * 0.5),
        "security_score": score(security * 2.0),
        "maintainability_score": score(maintainability * 1.5 + critical * 2.0),
        "performance_score": score(performance * 1.5),
    }
