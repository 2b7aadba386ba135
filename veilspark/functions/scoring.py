"""Scores, grades and constraints as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade thresholds, weights, penalties, banned licences.
GRADES = ((9.0, "A"), (7.0, "B"), (5.0, "C"), (3.0, "D"))
DESCRIPTION_WEIGHTS = {"intent_clarity": 0.20, "permission_scope": 0.25, "side_effects": 0.20, "capability_disclosure": 0.20, "operational_boundaries": 0.15}
METADATA_WEIGHTS = {"provenance": 0.40, "maintenance": 0.35, "popularity": 0.25}
LAYER_WEIGHTS = {"description": 0.35, "security": 0.35, "metadata": 0.30}
PENALTIES = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.25}
BANNED_LICENSES = ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "SSPL-1.0", "BSL-1.1")


def clamp(v: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def half_even(v: Column, digits: int) -> Column:
    """Python's round()."""
    return F.bround(v, digits)


def grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= t, F.lit(g)) for t, g in GRADES], F.lit("F"))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Missing parts count 0."""
    return clamp(reduce(Column.__add__, [F.coalesce(parts[k], F.lit(0.0)) * w for k, w in weights.items() if k in parts]))


def security_score(critical: Column, high: Column, medium: Column, low: Column, bonus: Column | float = 0.0) -> Column:
    counts = {"critical": critical, "high": high, "medium": medium, "low": low}
    loss = reduce(Column.__add__, [counts[k] * w for k, w in PENALTIES.items()])
    return clamp(F.lit(10.0) - loss + F.least(F.lit(bonus) if isinstance(bonus, float) else bonus, F.lit(2.0)))


def architecture_bonus(score: Column) -> Column:
    return clamp(score / 5, 0.0, 2.0)


def overall(description: Column, security: Column, metadata: Column, weights: dict[str, float] | None = None) -> Column:
    return half_even(weighted({"description": description, "security": security, "metadata": metadata}, weights or LAYER_WEIGHTS), 2)


def hard_constraint(critical: Column, tools: Column, license: Column) -> Column:
    """The first that holds: a critical issue, no tools, a banned licence."""
    return F.when(critical > 0, F.lit("critical_vulnerability")).when(tools == 0, F.lit("no_tools")).when(license.isin(*BANNED_LICENSES), F.lit("license_banned"))


def constrained_grade(score: Column, constraint: Column) -> Column:
    return F.when(constraint.isNull(), grade(score)).when(constraint == "license_banned", F.when(score >= 4.0, "D").otherwise("F")).otherwise("F")


def step(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """The result of the first step whose bound the value reaches."""
    return F.coalesce(*[F.when(value >= bound, F.lit(result)) for bound, result in steps], F.lit(otherwise))
