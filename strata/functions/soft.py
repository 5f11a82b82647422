"""Soft thresholds, bands, rounding and the two label pickers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"
#: How much more confident a later rule must be to take over.
MARGIN = 0.15
LEAST_CONFIDENCE = 0.10


def _steps(c: Column, descending: bool, at: tuple[float, float, float]) -> Column:
    a, b, z = at
    if descending:  # small values score high
        return F.when(c < a, 1.0).when(c < b, 0.5 + (b - c) / 40).when(c < z, (z - c) / 40 * 0.3).otherwise(0.0)
    return F.when(c >= a, 1.0).when(c >= b, 0.5 + (c - b) / 40).when(c >= z, (c - z) / 40 * 0.3).otherwise(0.0)


def highness(c: Column) -> Column:
    return _steps(c, False, (80, 60, 40))


def lowness(c: Column) -> Column:
    return _steps(c, True, (10, 30, 50))


def not_low(c: Column) -> Column:
    return _steps(c, False, (50, 30, 10))


def presence(c: Column) -> Column:
    return F.when(c >= 0.3, 1.0).when(c > 0, 0.3 + (c / 0.3) * 0.7).otherwise(0.0)


def health_high(c: Column) -> Column:
    return _steps(c, False, (70, 50, 30))


def axis_high(c: Column) -> Column:
    return _steps(c, False, (60, 40, 20))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def round_conf(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def _fold(rules: list[tuple[str, Column]], start: float, margin: float, least: float) -> Column:
    """Left fold over (name, confidence): a rule replaces the current one if it beats it by more than the margin."""
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("conf")) for n, c in rules))
    usable = F.filter(cells, lambda x: x["conf"] >= least) if least else cells
    first = F.struct(F.lit(NONE).alias("name"), F.lit(start).alias("conf"))
    best = F.aggregate(usable, first, lambda a, x: F.when(x["conf"] - a["conf"] > margin, x).otherwise(a))
    return F.transform(
        F.array(best), lambda b: F.struct(b["name"].alias("name"), F.when(b["name"] == NONE, 0.0).otherwise(round_conf(b["conf"])).alias("conf"))
    )[0]


def pick_best(rules: list[tuple[str, Column]]) -> Column:
    """struct(name, conf) of the rule that wins in priority order: a later one must be more than MARGIN better."""
    return _fold(rules, -1.0, MARGIN, LEAST_CONFIDENCE)


def pick_best_label(rules: list[tuple[str, Column]]) -> Column:
    """struct(name, conf) of the first strict maximum above 0."""
    return _fold(rules, 0.0, 0.0, 0.0)


def norm_role(c: Column) -> Column:
    return F.when(c.isin("Architect", "Anchor", "Cleaner", "Producer", "Specialist"), c).otherwise("Other")


def impact_band(c: Column) -> Column:
    """Bands with inclusive ends, so that 79.5 lies in none (null)."""
    out = None
    for low, high in ((80, 100), (60, 79), (40, 59), (30, 39), (20, 29), (0, 19)):
        hit, name = (c >= low) & (c <= high), F.lit(f"{low}-{high}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def gravity_band(gravity: Column, quality: Column, robust: Column, survival: Column, has_pressure: Column) -> Column:
    health = quality * 0.6 + F.when(has_pressure, robust).otherwise(survival) * 0.4
    return F.when(gravity < 20, "negligible").when(health >= 60, "healthy").when(health >= 40, "moderate").otherwise("fragile")


def cross_repo_pattern(roles: Column) -> Column:
    """How one author's role carries over repositories."""
    first = F.try_element_at(roles, F.lit(1))
    return (
        F.when(F.size(roles) == 0, NONE)
        .when(F.size(roles) == 1, "Single Repo")
        .when(F.size(F.array_distinct(roles)) > 1, F.when(F.array_contains(roles, "Architect"), "Context-dependent").otherwise("Variable"))
        .when(first == "Architect", "Reproducible")
        .when(first.isin("", NONE), "Emerging")
        .otherwise(F.concat(F.lit("Consistently "), first))
    )
