"""Report tables: CSV projections and nested JSON documents, built as columns and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.teams import AVERAGES

AXES = ("production", "quality", "survival", "robust_survival", "dormant_survival", "design", "breadth", "debt_cleanup", "indispensability", "gravity", "impact")
HEALTH = ("complementarity", "growth_potential", "sustainability", "debt_balance", "productivity_density", "quality_consistency", "risk_ratio", "aar", "anchor_density", "architecture_coverage")


def fixed(c: str | Column, digits: int) -> Column:
    """A number as text with so many decimals."""
    return F.format_string(f"%.{digits}f", F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)))


def rankings_csv(scores: DataFrame) -> DataFrame:
    """scores(domain, rank, author, ..) -> the 24 text columns of the ranking."""
    labels = [x for a in ("role", "style", "state") for x in (F.col(f"{a}.name").alias(a), fixed(F.col(f"{a}.conf"), 2).alias(f"{a}_conf"))]
    return scores.select(
        "domain", F.col("rank").cast("string").alias("rank"), F.col("author").alias("member"), F.col("recently_active").cast("string").alias("active"),
        F.col("total_commits").cast("string").alias("commits"), F.coalesce("lines_added", F.lit(0)).cast("string").alias("lines_added"),
        F.coalesce("lines_deleted", F.lit(0)).cast("string").alias("lines_deleted"), *(fixed(a, 1).alias(a) for a in AXES), *labels,
    )


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Range-sorted CSV parts, each with a header; no single task writes it all."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def _list(*columns, order: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))


def domain_report(scores: DataFrame, risks: DataFrame, coverage: DataFrame, pairs: DataFrame, owned: DataFrame, modules: DataFrame) -> DataFrame:
    """A row a domain with its report as JSON. Every input has a domain column; lists are ordered by their first field."""
    labels = [F.col(f"{a}.name").alias(a) for a in ("role", "style", "state")]
    m = scores.select("domain", "rank", F.col("author").alias("member"), "total_commits", *(F.round(a, 1).alias(a) for a in AXES), *labels)
    parts = {
        "members": m.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct(*[c for c in m.columns if c != "domain"]))).alias("members")),
        "bus_factor": risks.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("module", "author", F.round(F.col("share") * 100, 1).alias("share"), "level"))).alias("bus_factor")),
        "test_coverage": coverage.where("module is null").select("domain", F.struct("files", "tests", F.round("ratio", 4).alias("ratio")).alias("test_coverage")),
        "cochange": pairs.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("module_a", "module_b", "together", F.round("coupling", 4).alias("coupling")))).alias("cochange")),
        "ownership": owned.groupBy("domain").agg(_list("repo", "authors", "top_author", "level", order="module").alias("ownership")),
        "modules": modules.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("module", F.col("coupling.name").alias("coupling"), F.col("vitality.name").alias("vitality"), F.col("ownership.name").alias("ownership")))).alias("modules")),
    }
    out = parts["members"]
    for k in list(parts)[1:]:
        out = out.join(parts[k], "domain", "left")
    return out.select("domain", F.to_json(F.struct("domain", *parts)).alias("report"))


def team_csv(teams: DataFrame) -> DataFrame:
    """The team row as text: counts, five labels, averages and health."""
    whole = [F.col(c).cast("string").alias(c) for c in ("core_members", "effective_members", "total_members", "repos")]
    names = [F.col(f"{c}.name").alias(c) for c in ("character", "structure", "culture", "phase", "risk")]
    digits = {"aar": 2, "anchor_density": 2, "architecture_coverage": 2}
    return teams.select("team", "domain", *whole, *names, *(fixed(f"avg_{a}", 1).alias(f"avg_{a}") for a in AVERAGES), *(fixed(h, digits.get(h, 1)).alias(h) for h in HEALTH))


def team_json(teams: DataFrame, members: DataFrame) -> DataFrame:
    """(team, report): labels with confidences, health, warnings, distributions and members of each team."""
    m = members.groupBy("team").agg(
        F.array_sort(F.collect_list(F.struct("author", "tier", F.round("impact", 1).alias("impact"), F.col("role.name").alias("role"), F.col("style.name").alias("style"), F.col("state.name").alias("state")))).alias("members")
    )
    labels = F.struct(*(F.col(c) for c in ("character", "structure", "culture", "phase", "risk")))
    health = F.struct(*(F.round(h, 4).alias(h) for h in HEALTH))
    body = F.struct("team", "domain", "core_members", "effective_members", "total_members", labels.alias("classification"), health.alias("health"), "warnings", "members")
    return teams.join(m, "team").select("team", F.to_json(body).alias("report"))


def timeline_csv(timeline: DataFrame, key: str = "author") -> DataFrame:
    """Long (key, period) rows as text."""
    numbers = [c for c in ("impact", "gravity", "production", "quality", "survival", "design") if c in timeline.columns]
    labels = [c for c in ("role", "style", "state", "character", "structure", "culture", "phase", "risk") if c in timeline.columns]
    return timeline.select(key, "period", *(fixed(c, 1).alias(c) for c in numbers), *labels)


TEAM_PERIOD = ("avg_production", "avg_quality", "avg_survival", "avg_design", "avg_debt_cleanup", "avg_impact", *HEALTH[:7])


def team_timeline_csv(teams: DataFrame, period: str = "period") -> DataFrame:
    """Long (team, period) rows as text: counts, five labels, averages and health."""
    counts = [F.col(c).cast("string").alias(c) for c in ("core_members", "effective_members", "total_members")]
    names = [F.col(f"{c}.name").alias(c) for c in ("character", "structure", "culture", "phase", "risk")]
    return teams.select("team", "domain", F.col(period).alias("period"), *counts, *names, *(fixed(c, 1).alias(c) for c in TEAM_PERIOD))


def timeline_json(timeline: DataFrame, changes: DataFrame, key: str = "author", order: str = "period_start") -> DataFrame:
    """(key, report): an author's or team's periods in order, and its transitions."""
    fields = [c for c in timeline.columns if c not in (key, order)]
    p = timeline.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("periods"))
    t = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("period", "axis", "before", "after"))).alias("transitions"))
    return p.join(t, key, "left").select(key, F.to_json(F.struct(key, "periods", "transitions")).alias("report"))


def validation_report(entries: DataFrame, repos: DataFrame, top: int = 100) -> DataFrame:
    """One row: the `top` largest adjusted gravities and the repositories' figures, as JSON."""
    best = entries.orderBy(F.desc("adjusted_gravity"), "repo", "author").limit(top)
    order = F.struct((-F.col("adjusted_gravity")).alias("k"), "repo", "author", F.round("adjusted_gravity", 4).alias("adjusted_gravity"), "size")
    a = best.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.dropFields("k")).alias("global"))
    b = repos.agg(F.array_sort(F.collect_list(F.struct(*repos.columns))).alias("repos"))  # a row a repository
    return a.join(b).select(F.to_json(F.struct("global", "repos")).alias("report"))
