"""Hand fixtures and properties of the relational operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.config import Config
from strata.operators import axes, clean, sampling, scoring, teams, timelines

NOW = datetime(2024, 1, 1)


def test_survival_weighs_untested_lines(spark):
    blame = spark.createDataFrame([("r", p, "A", NOW) for p in ("covered/tested.go", "covered/tested.go", "legacy/orphan.go", "legacy/orphan.go")], "repo string, path string, author string, committed_at timestamp")
    files = spark.createDataFrame([("r", p) for p in ("covered/tested.go", "covered/tested_test.go", "legacy/orphan.go")], "repo string, path string")
    pressure = spark.createDataFrame([("r", "covered", 10.0), ("r", "legacy", 0.1)], "repo string, module string, pressure double")
    lines = axes.enrich_blame(blame, pressure, axes.file_tested(files)).withColumn("threshold", F.lit(1.0))
    r = axes.survival(lines, NOW, Config()).first()
    assert (r.survival, r.tested_survival, r.untested_survival) == (3.0, 2.0, 2.0)
    assert (r.robust_survival, r.dormant_survival) == (2.0, 1.0)
    assert axes.survival(lines, NOW, Config(), alpha=1.0, split=False).first().survival == 4.0


def test_absent_is_not_zero(spark):
    raw = spark.createDataFrame(
        [("alice", 10, NOW - timedelta(days=5), NOW, 100, 90.0), ("merger", 0, NOW, NOW, 0, 43.75)],
        "author string, commits long, first_at timestamp, last_at timestamp, production long, quality double",
    )
    none = ("lines_added", "lines_deleted", "survival", "robust_survival", "dormant_survival", "tested_survival", "untested_survival", "raw_survival", "design", "breadth", "debt_cleanup", "indispensability")
    rows = scoring.score_authors(raw.withColumns({c: F.lit(None).cast("double") for c in none}), Config(), NOW).collect()
    assert [r.author for r in rows] == ["alice"]
    assert rows[0].debt_cleanup == 50.0 and not rows[0].has_pressure


def test_reverts(spark):
    df = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("r", "e", "d"), ("r", "x", "y"), ("r", "y", "x")], "repo string, revert_id string, reverted_id string")
    assert {x.commit_id for x in clean.effectively_reverted(df).collect()} == {"b", "d"}


def test_merge_expansion(spark):
    # 1 <- 2 <- 3 <- 6 (main), 2 <- 4 <- 5 (branch), 6 merges 5 into 3
    edges = [(2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 1, 4), (6, 1, 3), (6, 2, 5)]
    parents = spark.createDataFrame([("r", c, p, q, q) for c, p, q in edges], "repo string, commit_id long, pos int, parent_id long, parent_order long")
    merges = spark.createDataFrame([("r", 6)], "repo string, commit_id long")
    assert {x.commit_id for x in clean.expand_merge(merges, parents).collect()} == {4, 5, 6}


def test_breadth_and_debt(spark):
    units = spark.createDataFrame([("a", "r1", 3), ("a", "r2", 2), ("b", "r1", 1)], "author string, repo string, commits long")
    assert [tuple(r) for r in axes.breadth(units, 3).collect()] == [("a", 1)]
    events = spark.createDataFrame([("r", "a", "b", 30), ("r", "b", "a", 10), ("r", "c", "a", 2)], "repo string, fixer string, original string, lines long")
    got = {r.author: r.debt_cleanup for r in axes.debt_score(events, 10).collect()}
    assert got == {"a": 50 + 50 * 18 / 42, "b": 25.0, "c": 50.0}


def test_quality_counts_merges_as_fixes_only(spark):
    df = spark.createDataFrame([("a", "fix: x", False), ("a", "feat", False), ("a", "Revert \"y\"", True)], "author string, subject string, is_merge boolean")
    assert axes.quality(df).first().quality == 0.0


def test_transitions(spark):
    df = spark.createDataFrame([("a", f"Q{i}", i, r, s) for i, (r, s) in enumerate([("Producer", "Mass"), ("Producer", "Builder"), ("Anchor", "Builder"), ("—", "Builder")])], "author string, period string, period_start int, role string, style string")
    got = {(r.period, r.axis, r.before, r.after) for r in timelines.transitions(df, "author", ("role", "style")).collect()}
    assert got == {("Q1", "style", "Mass", "Builder"), ("Q2", "role", "Producer", "Anchor")}


def test_team_health(spark):
    roles, states = ("Architect", "Anchor", "Cleaner", "Producer", "Specialist"), ("Active", "Active", "Active", "Active", "Growing")
    rows = [(f"m{i}", r, "Builder" if i == 0 else "Balanced", s) for i, (r, s) in enumerate(zip(roles, states, strict=True))]
    df = spark.createDataFrame(rows, "author string, r string, s string, t string")
    label = lambda c: F.struct(F.col(c).alias("name"), F.lit(1.0).alias("conf"))
    df = df.withColumns({"role": label("r"), "style": label("s"), "state": label("t"), "team": F.lit("x"), "domain": F.lit("BE"), "repos": F.lit(1), "recently_active": F.lit(True)})
    df = df.withColumns({a: F.lit(v) for a, v in zip(teams.AVERAGES, (60.0, 80.0, 50.0, 50.0, 0.0, 50.0, 50.0, 55.0, 10.0, 50.0), strict=True)}).withColumn("gravity", F.lit(30.0))
    t = teams.team_labels(teams.team_health(teams.aggregate(df))).first()
    assert (t.complementarity, t.growth_potential, t.sustainability, t.debt_balance, t.risk_ratio) == (100.0, 52.0, 100.0, 55.0, 0.0)
    assert t.core_members == 5 and t.productivity_density == pytest.approx(66.0)


def test_quota(spark):
    strata = spark.createDataFrame([("a", 10), ("b", 1), ("c", 5)], "stratum string, size long")
    got = {r.stratum: r.quota for r in sampling.stratum_quotas(strata, 10).collect()}
    assert sum(got.values()) == 10 and got["b"] == 1 and got["a"] > got["c"]


def test_stage_reuse(spark, tmp_path):
    at = str(tmp_path / "stage")
    one = spark.createDataFrame([("r1", "h1", 1)], "repo string, head string, x int")
    two = spark.createDataFrame([("r1", "h1", 9), ("r2", "h2", 2)], "repo string, head string, x int")
    sampling.materialize_stage(one, at)
    assert {(r.repo, r.x) for r in sampling.materialize_stage(two, at).collect()} == {("r1", 1), ("r2", 2)}
