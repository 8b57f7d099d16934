"""Scalar scoring: clamps, ratios, ladders and grades."""

from __future__ import annotations


def clamp(value: str, low: float = 0.0, high: float = 1.0) -> str:
    """Restrict to a range; NULL stays NULL (``greatest`` and ``least`` would skip it)."""
    return f"CASE WHEN {value} IS NOT NULL THEN greatest({low}D, least({high}D, {value})) END"


def ratio(numerator: str, denominator: str, default: float = 0.0) -> str:
    quotient = clamp(f"(double({numerator}) / double({denominator}))")
    return f"CASE WHEN {denominator} <= 0 THEN {default}D ELSE {quotient} END"


def inverse(value: str, scale: float) -> str:
    """1 for nothing, falling to 0 at ``scale``."""
    return f"CASE WHEN {value} <= 0 THEN 1.0D ELSE {clamp(f'(1.0D - {value} / {float(scale)}D)')} END"


def share(part: str, whole: str, digits: int = 3) -> str:
    """Rounded part of a whole; 0.0 of nothing."""
    return f"coalesce(round(try_divide(double({part}), double({whole})), {digits}), 0.0D)"


def activity_trend(commits_per_day: str, low: float = 0.01, high: float = 0.1) -> str:
    return (
        f"CASE WHEN {commits_per_day} >= {high}D THEN 'high' "
        f"WHEN {commits_per_day} >= {low}D THEN 'moderate' ELSE 'low' END"
    )


def churn_stability(churn: str, stable: float = 200.0, volatile: float = 600.0) -> str:
    return (
        f"CASE WHEN {churn} <= {stable}D THEN 'stable' "
        f"WHEN {churn} <= {volatile}D THEN 'moderate' ELSE 'volatile' END"
    )


def bus_factor_risk(bus_factor: str) -> str:
    return f"CASE WHEN {bus_factor} >= 4 THEN 'low' WHEN {bus_factor} >= 2 THEN 'medium' ELSE 'high' END"


def grade(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 0.85D THEN 'A' WHEN {score} >= 0.7D THEN 'B' "
        f"WHEN {score} >= 0.55D THEN 'C' ELSE 'D' END"
    )


def explain_component(name: str, score: str) -> str:
    return f"'{name.capitalize()} score ' || {score} || ' (grade ' || {grade(score)} || ')'"
