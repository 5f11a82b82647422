"""Author scores: normalisation, impact, gravity and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Config
from strata.functions.soft import NONE, cross_repo_pattern, highness, lowness, not_low, pick_best
from strata.operators.axes import as_of_column, days_between, production_rate
from strata.operators.ranks import placed

AXES = ("production", "quality", "survival", "design", "breadth", "debt_cleanup", "indispensability")
RELATIVE = ("survival", "robust_survival", "dormant_survival", "design", "breadth", "indispensability")


def _group(by) -> Window:
    return Window.partitionBy(*(by or [F.lit(0)]))


def normalize_max(c: Column, by=(), top: Column | None = None) -> Column:
    """100 * c / the group's largest value (top, where it is known), at most 100; a group without a positive value is
    all 0."""
    top = F.greatest(F.max(c).over(_group(by)) if top is None else top, F.lit(0.0))
    return F.when(top > 0, F.least(c / top * 100, F.lit(100.0))).otherwise(0.0)


def author_keys(axes: list[DataFrame], by=()) -> DataFrame:
    """All authors that some axis names."""
    return reduce(lambda a, b: a.union(b), [x.select(*by, "author") for x in axes]).distinct()


def raw_scores(axes: list[DataFrame], by=()) -> DataFrame:
    """One wide row an author; an axis without the author is null there, which differs from 0.

    The axes' rows meet in one aggregate instead of a join each: every axis has a row an author at most."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), axes).where(F.col("author").isNotNull())
    values = [c for c in rows.columns if c not in (*by, "author")]
    return rows.groupBy(*by, "author").agg(*(F.max(c).alias(c) for c in values))


def score_authors(raw: DataFrame, cfg: Config, as_of, by=()) -> DataFrame:
    """raw_scores -> scored authors, those without a commit of their own dropped.

    raw columns: lines_added, lines_deleted, production (lines), commits, first_at, last_at, quality, survival,
    robust_survival, dormant_survival, tested_survival, untested_survival, raw_survival, design, breadth, debt_cleanup,
    indispensability. The groups' largest values are windows over by; with by=() (one group) they are single values of
    an aggregate over raw, in the same lazy plan, so that no task takes all authors in."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rate = production_rate(zero("production"), F.col("first_at"), F.col("last_at"))
    scaled = (*RELATIVE, "raw_survival")
    split = F.max((F.col("robust_survival").isNotNull() | F.col("dormant_survival").isNotNull()).cast("int"))
    if by:
        top = lambda c: None
        has = split.over(_group(by)) == 1
    else:
        tops = raw.agg(F.struct(split.alias("split"), *(F.max(zero(c)).alias(c) for c in scaled))).scalar()
        raw = raw.withColumn("_tops", tops)
        top = lambda c: F.col(f"_tops.{c}")
        has = F.col("_tops.split") == 1
    rows = raw.withColumns(
        {
            "raw_lines_survival": zero("raw_survival"),
            "raw_robust": F.col("robust_survival"),
            "raw_dormant": F.col("dormant_survival"),
            "total_commits": F.coalesce("commits", F.lit(0)),
            "has_pressure": has,
            "production": F.least(F.coalesce(rate, F.lit(0.0)) / cfg.production_daily_ref * 100, F.lit(100.0)),
            "quality": zero("quality"),
            "debt_cleanup": F.coalesce(F.col("debt_cleanup"), F.lit(50.0)),
            "days_inactive": days_between(as_of_column(as_of), F.col("last_at")),
            **{f"n_{c}": normalize_max(zero(c), by, top(c)) for c in RELATIVE},
            "raw_survival": normalize_max(zero("raw_survival"), by, top("raw_survival")),
        }
    )
    rows = rows.withColumns({c: F.col(f"n_{c}") for c in RELATIVE}).drop(*(f"n_{c}" for c in RELATIVE), "_tops").where("total_commits > 0")
    rows = rows.withColumn("recently_active", F.coalesce(F.col("days_inactive") <= cfg.active_days, F.lit(False)))
    return with_labels(rows.withColumns({"impact": impact(cfg.weights), "gravity": gravity()}))


def impact(weights: dict[str, float]) -> Column:
    """The weighted sum; where the group has pressure data survival counts 80 : 20 robust : dormant, design counts as
    far as code survives or is produced, and authors without robust code lose a fifth."""
    c = F.col
    w = {k: F.lit(float(weights[k])) for k in AXES}
    rest = sum((c(a) * w[a] for a in ("production", "quality", "breadth", "debt_cleanup", "indispensability")), F.lit(0.0))
    plain = rest + c("survival") * w["survival"] + c("design") * w["design"]
    proof = F.greatest(c("robust_survival") / 100 * 0.8 + 0.2, c("production") / 100 * 0.8 + 0.2)
    split = rest + (c("robust_survival") * 0.8 + c("dormant_survival") * 0.2) * w["survival"] + c("design") * proof * w["design"]
    return F.when(~c("has_pressure"), plain).when(c("robust_survival") == 0, split * 0.8).otherwise(split)


def gravity() -> Column:
    return F.col("indispensability") * 0.4 + F.col("breadth") * 0.3 + F.col("design") * 0.3


def role_rules() -> list[tuple[str, Column]]:
    c = F.col
    total = ((c("robust_survival") == 0) & (c("dormant_survival") == 0)) | (highness(c("production")) > 0)
    lasting = F.when(total, c("survival")).otherwise(c("robust_survival"))
    return [
        ("Architect", F.least(highness(c("design")), highness(lasting), not_low(c("breadth")))),
        ("Anchor", F.least(highness(c("quality")), not_low(c("production")))),
        ("Cleaner", F.least(highness(c("quality")), highness(c("survival")), highness(c("debt_cleanup")))),
        ("Producer", not_low(c("production"))),
        ("Specialist", F.least(highness(c("survival")), lowness(c("breadth")))),
    ]


def style_rules() -> list[tuple[str, Column]]:
    c = F.col
    prod, surv, robust = c("production"), c("survival"), c("robust_survival")
    return [
        ("Builder", F.least(highness(prod), highness(c("design")), not_low(c("debt_cleanup")))),
        ("Resilient", F.when(robust == 0, 0.0).otherwise(F.least(highness(prod), lowness(surv), not_low(robust)))),
        ("Rescue", F.least(highness(prod), lowness(surv), highness(c("debt_cleanup")))),
        ("Churn", F.when(prod - surv < 30, 0.0).otherwise(F.least(not_low(prod), lowness(c("quality")), lowness(surv)))),
        ("Mass", F.least(highness(prod), lowness(surv))),
        (
            "Emergent",
            F.when((c("gravity") < 50) | (prod < 30), 0.0).otherwise(
                F.when(lowness(robust) == 0, 0.0).otherwise(F.least(highness(c("gravity")), not_low(prod), lowness(robust)))
            ),
        ),
        ("Balanced", F.when(c("impact") >= 30, 0.30).otherwise(0.0)),
        ("Spread", F.least(highness(c("breadth")), lowness(prod), lowness(surv), lowness(c("design")))),
    ]


def dormant_ratio() -> Column:
    """Percent of raw robust and dormant survival that is dormant; null without data."""
    return F.col("raw_dormant") * 100 / F.nullif(F.col("raw_robust") + F.col("raw_dormant"), F.lit(0.0))


def untested_ratio() -> Column:
    return F.col("untested_survival") * 100 / F.nullif(F.col("tested_survival") + F.col("untested_survival"), F.lit(0.0))


def state_rules() -> list[tuple[str, Column]]:
    c = F.col
    prod, surv, d, u = c("production"), c("survival"), dormant_ratio(), untested_ratio()
    held = (c("indispensability") >= 60) & (prod < 40)
    fragile = (
        F.when(held & (d >= 80) & (u >= 50), 0.90 + F.least((d - 80) / 200, (u - 50) / 500, F.lit(0.07)))
        .when(held & (d >= 80), 0.85 + (d - 80) / 200)
        .when(held & d.isNull() & (u >= 70) & (surv >= 50), 0.80 + (u - 70) / 300)
        .when(c("quality") >= 70, 0.0)
        .otherwise(F.least(highness(surv), lowness(prod)))
    )
    return [
        ("Former", F.least(highness(c("raw_survival")), lowness(surv), F.greatest(highness(c("design")), highness(c("indispensability"))))),
        ("Silent", F.when(c("total_commits") < 100, 0.0).otherwise(F.least(lowness(prod), lowness(surv), lowness(c("debt_cleanup"))))),
        ("Fragile", fragile),
        ("Growing", F.least(lowness(prod), highness(c("quality")))),
        ("Active", F.when(c("recently_active"), 0.80).otherwise(0.0)),
    ]


def with_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({"role": pick_best(role_rules()), "style": pick_best(style_rules()), "state": pick_best(state_rules())})


def author_repo_matrix(per_repo: DataFrame, overall: DataFrame) -> DataFrame:
    """per_repo(author, repo, impact, role), overall(author, impact) -> (author, place, cells, pattern), an author a row.

    place: the author's rank by overall impact; cells: (repo, cell) in repo order, the cell being role and impact, or the
    impact alone without a role; a repository without the author has no cell. pattern: how the role carries over."""
    shown = F.bround("impact", 0).cast("long").cast("string")
    none = F.coalesce("role", F.lit("")).isin("", NONE)
    cell = F.struct("repo", F.when(none, shown).otherwise(F.concat("role", F.lit(" "), shown)).alias("cell"), F.coalesce("role", F.lit("")).alias("role"))
    rows = per_repo.groupBy("author").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    cells = F.transform("x", lambda x: F.struct(x["repo"].alias("repo"), x["cell"].alias("cell")))
    pattern = cross_repo_pattern(F.transform("x", lambda x: x["role"]))
    placed = rank_by_impact(overall.select("author", "impact")).select("author", F.col("rank").alias("place"))
    return placed.join(rows, "author", "left").select("author", "place", F.coalesce(cells, F.array()).alias("cells"), F.coalesce(pattern, F.lit(NONE)).alias("pattern"))


def drop_ghosts(scores: DataFrame) -> DataFrame:
    return scores.where(~((F.col("total_commits") == 0) & (F.col("impact") == 0)))


def rank_by_impact(scores: DataFrame, by=()) -> DataFrame:
    """rank from 1 by impact, ties by author, within each group or over all."""
    if by:
        return scores.withColumn("rank", F.row_number().over(_group(by).orderBy(F.desc("impact"), "author")))
    return placed(scores, [-F.col("impact"), F.col("author")]).withColumn("rank", F.col("rank").cast("int")).drop("_total")
