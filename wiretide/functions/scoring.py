"""Score, severity and confidence scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity and confidence scales and the score bands.
SEVERITIES = ("INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")  # codes 1..5
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")  # codes 1..3
SCORE_BANDS = ((76, 5), (51, 4), (26, 3), (1, 2))  # lowest score, severity code
RISK_LABELS = ("Informational", "Low", "Medium", "High", "Critical")
THREAT_BANDS = ((0.76, "critical"), (0.51, "high"), (0.26, "medium"))
SEVERITY_RANKS = ("critical", "high", "medium", "low", "informational")  # ranks 1..5

INFORMATIONAL, LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4, 5


def risk_score(raw: Column) -> Column:
    """Raw 0..1 score as a whole 0..100 score, truncated."""
    clamped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return F.floor(clamped * 100).cast("int")


def severity_code(score: Column) -> Column:
    """Severity 1..5 of a 0..100 score."""
    code = F.lit(INFORMATIONAL)
    for lowest, level in reversed(SCORE_BANDS):
        code = F.when(score >= lowest, F.lit(level)).otherwise(code)
    return code


def _pick(code: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code - 1)


def severity_name(code: Column) -> Column:
    return _pick(code, SEVERITIES)


def confidence_name(code: Column) -> Column:
    return _pick(code, CONFIDENCES)


def confidence_code(fired: Column, total: int) -> Column:
    """3 from 80 % of the indicators, 2 from 40 %, else 1."""
    share = fired / F.lit(total)
    return F.when(share >= 0.8, F.lit(3)).when(share >= 0.4, F.lit(2)).otherwise(F.lit(1))


def risk_label(score: Column) -> Column:
    """Display label of a 0..100 score."""
    return _pick(severity_code(score), RISK_LABELS)


def threat_level(average: Column) -> Column:
    """Level of a 0..1 average risk."""
    level = F.lit("low")
    for lowest, name in reversed(THREAT_BANDS):
        level = F.when(average >= lowest, F.lit(name)).otherwise(level)
    return level


def severity_rank(severity: Column) -> Column:
    """1 for critical down to 5 for informational; 6 for anything else."""
    rank = F.lit(6)
    for position, name in enumerate(SEVERITY_RANKS, start=1):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank


def severity_from_rank(rank: Column) -> Column:
    names = F.array(*[F.lit(n) for n in SEVERITY_RANKS])
    return F.coalesce(F.get(names, rank - 1), F.lit("informational"))
