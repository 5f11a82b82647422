"""Queries over periods and over rankings against a ground truth."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strata.fixtures import AS_OF, DAILY_REF, MIN_LINES, fixture_config
from strata.functions import paths
from strata.functions.periods import build_periods, period_range
from strata.operators import axes, scoring, teams, timelines, validation
from strata.operators.clean import materialize
from strata.operators.scoring import raw_scores, score_authors
from strata.plans import score_queries
from strata.plans.blame_queries import BF, OW
from strata.plans.log_queries import FC, SQL_ARCH, changes
from strata.plans.rankings import fix_files
from strata.plans.registry import SQL_AS_OF, SQL_IS_FIX, query, rounded, sql_days, sql_module, sql_pick

SPAN, NOW, SINCE = "6m", datetime(2001, 12, 1), datetime(1999, 1, 1)
PD = (
    "pd AS (SELECT CONCAT(year(s), '-H', CASE WHEN month(s) <= 6 THEN '1' ELSE '2' END) AS label, s AS \"start\", least(s + INTERVAL 6 MONTH, TIMESTAMP '2001-12-01') AS \"end\" "
    "FROM (SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2001-11-30', INTERVAL 6 MONTH)) AS s))"
)


def periods(s):
    return build_periods(s, SPAN, NOW, since=SINCE)


day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
query("build_periods", lambda v, s, d: period_range(v("c"), SPAN).select("label", day("start"), day("end")),
      "SELECT CONCAT(year(s), '-H', CASE WHEN month(s) <= 6 THEN '1' ELSE '2' END) AS label, strftime(s, '%Y-%m-%d') AS \"start\", strftime(s + INTERVAL 6 MONTH, '%Y-%m-%d') AS \"end\" FROM (SELECT unnest(generate_series(date_trunc('year', MIN(committed_at))::TIMESTAMP, MAX(committed_at), INTERVAL 6 MONTH)) AS s FROM c)", "c")
query("period_assign", lambda v, s, d: timelines.assign_periods(v("c"), periods(s)).groupBy("repo", "period").agg(F.count("*").alias("n")),
      'SELECT repo, label AS period, COUNT(*) AS n FROM c JOIN pd ON committed_at >= "start" AND committed_at < "end" GROUP BY 1, 2', "c", PD)
query("boundary_commit", lambda v, s, d: timelines.boundary_commits(v("c"), periods(s)),
      'SELECT repo, label AS period, arg_max(commit_id, (committed_at, commit_id)) AS commit_id FROM c JOIN pd ON committed_at <= "end" GROUP BY 1, 2', "c", PD)
query("blame_snapshot", lambda v, s, d: timelines.snapshot_sums(v("line_lives"), periods(s), {"repo": F.col("repo"), "author": F.col("author")}, 720.0).select("period", "repo", "author", "lines"),
      'SELECT label AS period, repo, author, COUNT(*) AS lines FROM line_lives JOIN pd ON born_at <= "end" AND (died_at IS NULL OR died_at > "end") GROUP BY 1, 2, 3', "line_lives", PD)


def scored_periods(v, s, d):
    """All axes for every (period, author): period is one more group key."""
    cfg, p, by = fixture_config(s, d), periods(s), ("period",)
    commits = timelines.assign_periods(v("c"), p)
    own = commits.where("not is_merge")
    touched = v("fc").join(own.select("repo", "commit_id", "author", "period"), ["repo", "commit_id"])
    lives = v("line_lives")
    keys = {"repo": F.col("repo"), "module": axes.module_of(F.col("path")), "risk": axes.risk_module_of(F.col("path")), "author": F.col("author")}
    lines = materialize(timelines.snapshot_sums(lives, p, keys, cfg.tau))
    module_lines = axes.owners(lines, F.col("risk"), ("period", "repo")).where("rank = 1")
    risk = F.when(F.col("share") >= cfg.critical, "CRITICAL").when(F.col("share") >= cfg.high, "HIGH")
    risks = module_lines.select("period", "repo", "author", risk.alias("level")).where("level is not null")
    modules = touched.select("period", "repo", "commit_id", axes.module_of(F.col("path")).alias("module")).distinct()
    pressure = materialize(axes.change_pressure(modules, lines, by))
    limits = axes.pressure_threshold(lines, pressure, cfg.min_substantial_lines, by=by)
    weighed = lines.join(pressure, ["period", "repo", "module"], "left").join(limits.select("period", "repo", "threshold"), ["period", "repo"], "left")
    weighed = weighed.withColumns({"pressure": F.coalesce("pressure", F.lit(0.0)), "is_tested": F.lit(True)})
    fixes = fix_files(commits, v("fc"), by)
    debt = axes.debt_score(axes.debt_events(fixes, lives.withColumnRenamed("born_at", "committed_at"), by, keep=materialize), cfg.debt_threshold, ("period", "repo"))
    parts = [
        axes.lines_changed(touched, cfg.exclude_files, by),
        axes.author_activity(commits, by, merges_in_dates=False),
        axes.mean_over(axes.quality(commits, ("period", "repo")), "quality", by),
        axes.survival(weighed, None, cfg, by),
        axes.design(touched, cfg.architecture, by),
        axes.breadth(own.groupBy("period", "repo", "author").agg(F.count("*").alias("commits")), cfg.breadth_min_commits, by),
        axes.mean_over(debt, "debt_cleanup", by),
        axes.indispensability(risks, by),
    ]
    # Each step by itself: the disk is that of the largest and not of all.
    raw = materialize(raw_scores([materialize(part) for part in parts], by))
    ends = F.broadcast(p.select(F.col("label").alias("period"), F.col("start").alias("period_start"), "end"))  # some periods
    return score_authors(raw.join(ends, "period"), cfg, F.col("end"), by)


def timeline(v, s, d):
    scored = scored_periods(v, s, d).select("author", "period", "production", "quality", "survival", "design", "impact", "gravity", "total_commits", *(F.col(f"{a}.name").alias(a) for a in ("role", "style", "state")))
    return timelines.densify(scored, periods(s), ("production", "quality", "survival", "design", "impact", "gravity", "total_commits"))


def _n(c: str) -> str:
    return f"coalesce(CASE WHEN MAX({c}) OVER (PARTITION BY label) > 0 THEN least({c} / CAST(MAX({c}) OVER (PARTITION BY label) AS DOUBLE) * 100, 100e0) END, 0e0)"


_TOUCHED = "fc JOIN cp ON cp.repo = fc.repo AND cp.commit_id = fc.commit_id WHERE NOT cp.is_merge"
SP = (
    'cp AS (SELECT c.*, label FROM c JOIN pd ON committed_at >= "start" AND committed_at < "end"), '
    'ln AS (SELECT label, "end" AS pe, repo, path, author, born_at FROM line_lives JOIN pd ON born_at <= "end" AND (died_at IS NULL OR died_at > "end")), '
    f"y1 AS (SELECT label, cp.author, SUM(insertions + deletions) AS lines FROM {_TOUCHED} AND NOT regexp_matches(path, 'generated|(^|/)mock_|[.]gen[.]|^docs/') GROUP BY ALL), "
    "y2 AS (SELECT label, author, COUNT(*) FILTER (NOT is_merge) AS commits, MIN(committed_at) FILTER (NOT is_merge) AS f, MAX(committed_at) FILTER (NOT is_merge) AS l FROM cp GROUP BY ALL), "
    f"y3 AS (SELECT label, author, AVG(CASE WHEN t = 0 THEN 100e0 ELSE 100 - f / t * 100e0 END) AS quality FROM (SELECT label, repo, author, COUNT(*) FILTER ({SQL_IS_FIX}) AS f, COUNT(*) FILTER (NOT is_merge) AS t FROM cp GROUP BY ALL) GROUP BY ALL), "
    f"pmc AS (SELECT label, repo, module, COUNT(*) AS commits FROM (SELECT DISTINCT label, fc.repo, fc.commit_id, {sql_module()} AS module FROM {_TOUCHED}) GROUP BY ALL), "
    f"pml AS (SELECT label, repo, {sql_module()} AS module, COUNT(*) AS lines FROM ln GROUP BY ALL), "
    "ppr AS (SELECT label, repo, module, coalesce(commits, 0) / CASE WHEN coalesce(lines, 0) > 0 THEN CAST(lines AS DOUBLE) ELSE 1e0 END AS pressure FROM pmc FULL JOIN pml USING (label, repo, module)), "
    "pal AS (SELECT label, repo, author, COUNT(*) AS lines, SUM(COUNT(*)) OVER (PARTITION BY label, repo) AS total FROM ln GROUP BY label, repo, author), "
    f"pth AS (SELECT label, repo, CASE WHEN substantial >= 2 THEN median ELSE CAST('Infinity' AS DOUBLE) END AS threshold FROM (SELECT label, repo, COUNT(*) FILTER (lines >= {MIN_LINES} AND lines / CAST(total AS DOUBLE) >= 0.1e0) AS substantial FROM pal GROUP BY ALL) JOIN (SELECT label, repo, quantile_cont(pressure, 0.5) AS median FROM ppr GROUP BY ALL) USING (label, repo)), "
    f"lw AS (SELECT ln.label, author, exp(-{sql_days('pe', 'born_at')} / 720e0) AS w, coalesce(pressure, 0e0) >= threshold AS high FROM ln LEFT JOIN ppr ON ppr.label = ln.label AND ppr.repo = ln.repo AND ppr.module = {sql_module('ln.path')} JOIN pth ON pth.label = ln.label AND pth.repo = ln.repo), "
    "y4 AS (SELECT label, author, SUM(w) AS survival, COUNT(*) AS raw, SUM(CASE WHEN high THEN w ELSE 0 END) AS robust, SUM(CASE WHEN high THEN 0 ELSE w END) AS dormant FROM lw GROUP BY ALL), "
    f"fx AS (SELECT DISTINCT label, fc.repo, fc.commit_id, path, cp.author AS fixer, committed_at AS fix_at FROM {_TOUCHED} AND {SQL_IS_FIX}), "
    "ev AS (SELECT label, fx.repo, fixer, author AS original, COUNT(*) AS lines FROM fx JOIN line_lives l ON l.repo = fx.repo AND l.path = fx.path AND born_at < fix_at AND (died_at IS NULL OR died_at >= fix_at) AND author <> fixer GROUP BY ALL), "
    "y8 AS (SELECT label, author, AVG(CASE WHEN cl + ge < 10 THEN 50e0 ELSE greatest(least(50 + 50 * (cl - ge) / CAST(cl + ge AS DOUBLE), 100e0), 0e0) END) AS debt FROM (SELECT label, repo, author, SUM(cl) AS cl, SUM(ge) AS ge FROM (SELECT label, repo, fixer AS author, lines AS cl, 0 AS ge FROM ev UNION ALL SELECT label, repo, original, 0, lines FROM ev) GROUP BY ALL) GROUP BY label, author), "
    f"y5 AS (SELECT label, cp.author, SUM(insertions + deletions) AS design FROM {_TOUCHED} AND {SQL_ARCH} GROUP BY ALL), "
    "y6 AS (SELECT label, author, COUNT(*) AS breadth FROM (SELECT label, repo, author FROM cp WHERE NOT is_merge GROUP BY ALL HAVING COUNT(*) >= 3) GROUP BY ALL), "
    f"mo AS (SELECT label, author, n / CAST(SUM(n) OVER (PARTITION BY label, repo, module) AS DOUBLE) AS share, row_number() OVER (PARTITION BY label, repo, module ORDER BY n DESC, author) AS r FROM (SELECT label, repo, {sql_module()} AS module, author, COUNT(*) AS n FROM ln GROUP BY ALL)), "
    "y7 AS (SELECT label, author, SUM(CASE WHEN share >= 0.8e0 THEN 1e0 ELSE 0.5e0 END) AS ind FROM mo WHERE r = 1 AND share >= 0.6e0 GROUP BY ALL), "
    f"pk AS (SELECT label, author, coalesce(commits, 0) AS total_commits, least(coalesce(lines, 0) / greatest({sql_days('l', 'f')}, 1e0) / {DAILY_REF} * 100, 100e0) AS production, coalesce(quality, 0e0) AS quality, {_n('y4.survival')} AS survival, {_n('robust')} AS robust_survival, {_n('dormant')} AS dormant_survival, bool_or(robust IS NOT NULL) OVER (PARTITION BY label) AS has_pressure, {_n('y5.design')} AS design, {_n('y6.breadth')} AS breadth, "
    f"coalesce(debt, 50e0) AS debt_cleanup, {_n('ind')} AS indispensability, {_n('raw')} AS raw_survival, robust AS raw_robust, dormant AS raw_dormant, y4.survival AS tested_survival, 0e0 AS untested_survival, coalesce({sql_days('\"end\"', 'l')} <= 150e0, FALSE) AS recently_active "
    "FROM y2 " + " ".join(f"FULL JOIN y{i} USING (label, author)" for i in (1, 3, 4, 5, 6, 7, 8)) + " JOIN pd USING (label)), "
    "pj AS (SELECT *, CASE WHEN NOT has_pressure THEN pp + survival * 0.25e0 + design * 0.20e0 WHEN robust_survival = 0 THEN px * 0.8e0 ELSE px END AS impact, indispensability * 0.4e0 + breadth * 0.3e0 + design * 0.3e0 AS gravity FROM "
    f"(SELECT *, {score_queries.W} AS pp, {score_queries.W} + (robust_survival * 0.8e0 + dormant_survival * 0.2e0) * 0.25e0 + design * greatest(robust_survival / 100e0 * 0.8e0 + 0.2e0, production / 100e0 * 0.8e0 + 0.2e0) * 0.20e0 AS px FROM pk WHERE total_commits > 0)), "
    f"pr_ AS (SELECT *, {sql_pick(score_queries.ROLE)} AS rl, {sql_pick(score_queries.STYLE)} AS sy, {sql_pick(score_queries.STATE)} AS se FROM pj)"
)
MEASURES = ("production", "quality", "survival", "robust_survival", "dormant_survival", "design", "breadth", "debt_cleanup", "indispensability", "impact", "gravity")
query("score_periods",
      lambda v, s, d: rounded(scored_periods(v, s, d).select("period", "author", "total_commits", *MEASURES, *(F.col(f"{a}.name").alias(f"{a}_name") for a in ("role", "style", "state"))), 3),
      "SELECT label AS period, author, total_commits, " + ", ".join(f"ROUND({c}, 3) AS {c}" for c in MEASURES) + ", rl.n AS role_name, sy.n AS style_name, se.n AS state_name FROM pr_", "c fc line_lives", PD, SP)
query("author_timeline", lambda v, s, d: timeline(v, s, d).select("author", "period", "total_commits"),
      'SELECT author, label AS period, coalesce(n, 0) AS total_commits FROM (SELECT DISTINCT author FROM c WHERE NOT is_merge AND committed_at >= TIMESTAMP \'1999-01-01\' AND committed_at < TIMESTAMP \'2001-12-01\') CROSS JOIN pd LEFT JOIN (SELECT author, label, COUNT(*) AS n FROM c JOIN pd ON committed_at >= "start" AND committed_at < "end" WHERE NOT is_merge GROUP BY 1, 2) USING (author, label)', "c", PD)

# A timeline of labels that changes: the label grid, its rows dealt over periods.
TLG = "tg AS (SELECT CONCAT('a', CAST(n % 100 AS STRING)) AS author, CAST(FLOOR(n / 100) AS BIGINT) AS idx, CONCAT('P', CAST(CAST(FLOOR(n / 100) AS BIGINT) + 100 AS STRING)) AS period, CASE production % 4 WHEN 0 THEN 'Producer' WHEN 1 THEN 'Anchor' WHEN 2 THEN '—' ELSE NULL END AS role, CASE quality % 3 WHEN 0 THEN 'Builder' WHEN 1 THEN 'Mass' ELSE 'Balanced' END AS style, design * 1e0 AS gravity, CASE WHEN n % 5 = 0 THEN 0e0 ELSE survival * 1e0 END AS impact, production * 1e0 AS production, quality * 1e0 AS quality, survival * 1e0 AS survival, design * 1e0 AS design FROM score_grid)"


def label_timeline(s, d):
    from strata.fixtures import spark_sql, with_views

    return spark_sql(s, d, with_views("score_grid", TLG) + "SELECT * FROM tg").withColumn("at", F.timestamp_seconds("idx"))


TR = "SELECT {k}, period, axis, before, after FROM (SELECT {k}, period, axis, label AS after, lag(label) OVER (PARTITION BY {k}, axis ORDER BY idx) AS before FROM (SELECT {k}, period, idx, 'role' AS axis, role AS label FROM tg UNION ALL SELECT {k}, period, idx, 'style', style FROM tg)) WHERE before <> after AND before <> '—' AND after <> '—'"
query("label_transitions", lambda v, s, d: timelines.transitions(label_timeline(s, d), "author", ("role", "style"), "idx"), TR.format(k="author"), "score_grid", TLG)
query("notable_transitions", lambda v, s, d: timelines.transitions(label_timeline(s, d), "author", ("role", "style"), "idx").groupBy("axis", "before", "after").agg(F.count("*").alias("n")),
      f"SELECT axis, before, after, COUNT(*) AS n FROM ({TR.format(k='author')}) GROUP BY 1, 2, 3", "score_grid", TLG)
query("latest_impact_order", lambda v, s, d: timelines.latest_impact_order(label_timeline(s, d), "idx"),
      "SELECT author, coalesce(arg_max(impact, idx) FILTER (impact > 0), 0e0) AS latest FROM tg GROUP BY author ORDER BY latest DESC, author", "score_grid", TLG)
query("period_topk", lambda v, s, d: timelines.period_top(label_timeline(s, d)).select("period", "author", "gravity", "rank"),
      "SELECT period, author, gravity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY gravity DESC, author) AS r FROM tg WHERE gravity > 0) WHERE r <= 5", "score_grid", TLG)
query("key_figures", lambda v, s, d: timelines.key_figures(label_timeline(s, d), 10, "at").select("author", "peak", "peak_period", F.size("course").cast("long").alias("periods")),
      "SELECT author, MAX(gravity) AS peak, arg_max(period, (gravity, -idx)) AS peak_period, COUNT(*) AS periods FROM tg WHERE author IN (SELECT author FROM (SELECT author, row_number() OVER (PARTITION BY period ORDER BY gravity DESC, author) AS r FROM tg WHERE gravity > 0) WHERE r <= 10) GROUP BY author", "score_grid", TLG)
query("sink_chart_series", lambda v, s, d: timelines.chart_series(label_timeline(s, d)),
      "SELECT author, period, series, value FROM tg UNPIVOT (value FOR series IN (impact, production, quality, survival, design))", "score_grid", TLG)
query("dense_periods", lambda v, s, d: timelines.densify(label_timeline(s, d).where("idx % 2 = 0 or production > 50").select("author", "period", "impact"), label_timeline(s, d).select(F.col("period").alias("label"), F.col("at").alias("start")).distinct(), ("impact",)).select("author", "period", "impact"),
      "SELECT a.author, p.period, coalesce(t.impact, 0e0) AS impact FROM (SELECT DISTINCT author FROM tg WHERE idx % 2 = 0 OR production > 50) a CROSS JOIN (SELECT DISTINCT period FROM tg) p LEFT JOIN (SELECT * FROM tg WHERE idx % 2 = 0 OR production > 50) t ON t.author = a.author AND t.period = p.period", "score_grid", TLG)

# --- validation: the grid's teams are repositories, their order by commits the ground truth ------------------------------

ENG = "eg AS (SELECT team AS repo, author, production * 1e0 AS production, debt_cleanup * 1e0 AS debt_cleanup, survival * 1e0 AS survival, robust_survival * 1e0 AS robust_survival, indispensability * 0.4e0 + breadth * 0.3e0 + design * 0.3e0 AS gravity, (production + quality + survival + design) / 4e0 AS impact, total_commits FROM score_grid)"
RKD = "g AS (SELECT repo, author AS name, row_number() OVER (PARTITION BY repo ORDER BY gravity DESC, author) AS rank FROM eg), t AS (SELECT repo, author AS name, row_number() OVER (PARTITION BY repo ORDER BY total_commits DESC, author) AS rank FROM eg), k AS (SELECT repo, name FROM t WHERE rank <= 7)"


def engineers(s, d):
    from strata.fixtures import spark_sql, with_views

    return spark_sql(s, d, with_views("score_grid", ENG) + "SELECT * FROM eg")


def lists(s, d):
    e = engineers(s, d)
    truth = validation.ranked(e, "total_commits")
    return validation.ranked(e, "gravity"), truth, truth.where("rank <= 7").select("repo", "name")


V = ("score_grid", ENG, RKD)
OV = "SELECT repo, COUNT(*) FILTER (hit) / CAST(COUNT(*) AS DOUBLE) AS {0} FROM (SELECT {1}.repo, {1}.name IN (SELECT name FROM g WHERE g.repo = {1}.repo AND g.rank <= {2}) AS hit FROM {1} {3}) GROUP BY repo"
query("topk_overlap", lambda v, s, d: validation.topk_overlap(*lists(s, d)[:2]), OV.format("overlap", "t", 10, "WHERE t.rank <= 10"), *V)
query("architect_recall", lambda v, s, d: (lambda g, t, k: validation.recall_at_k(g, k))(*lists(s, d)), OV.format("recall", "k", 20, ""), *V)
RHO = "CASE WHEN COUNT(*) >= 3 THEN 1 - 6 * SUM((a - b) * (a - b)) / CAST(COUNT(*) * (COUNT(*) * COUNT(*) - 1) AS DOUBLE) ELSE 0e0 END"
BOTH = "SELECT g.repo, g.rank AS a, t.rank AS b FROM g JOIN t ON g.repo = t.repo AND g.name = t.name WHERE g.rank <= 30 AND t.rank <= 30"
query("spearman", lambda v, s, d: rounded(validation.spearman(*lists(s, d)[:2]), 6), f"SELECT repo, COUNT(*) AS common, ROUND({RHO}, 6) AS rho FROM ({BOTH}) GROUP BY repo", *V)
query("spearman_reranked", lambda v, s, d: rounded(validation.spearman(*lists(s, d)[:2], rerank=True), 6),
      f"SELECT repo, COUNT(*) AS common, ROUND({RHO}, 6) AS rho FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY a) AS a, row_number() OVER (PARTITION BY repo ORDER BY b) AS b FROM ({BOTH})) GROUP BY repo", *V)
CONC = "cn AS (SELECT e.repo, coalesce(SUM(e.gravity) FILTER (g.rank <= 3) / nullif(SUM(e.gravity), 0), 0e0) AS concentration FROM eg e JOIN g ON g.repo = e.repo AND g.name = e.author GROUP BY e.repo)"
query("gravity_concentration", lambda v, s, d: rounded(validation.gravity_concentration(engineers(s, d)), 6), "SELECT repo, ROUND(concentration, 6) AS concentration FROM cn", *V, CONC)
ADJUSTED = "SELECT eg.repo, author, size, gravity * ln(size) / ln(MAX(size) OVER ()) AS g FROM eg JOIN (SELECT repo, COUNT(*) AS size FROM eg GROUP BY repo) USING (repo) QUALIFY impact >= 20"
query("adjusted_gravity", lambda v, s, d: rounded(validation.global_gravity(engineers(s, d)).select("repo", "author", "size", "adjusted_gravity")),
      f"SELECT repo, author, size, ROUND(g, 4) AS adjusted_gravity FROM ({ADJUSTED})", *V)
HID = "SELECT g.repo, g.name FROM g WHERE g.rank <= 20 AND NOT EXISTS (SELECT 1 FROM k WHERE k.repo = g.repo AND k.name = g.name)"
query("hidden_architects", lambda v, s, d: (lambda g, t, k: validation.hidden_architects(g, k))(*lists(s, d)).select("repo", "name"), HID, *V)
query("hidden_except", lambda v, s, d: (lambda g, t, k: validation.ranking_except(g, k))(*lists(s, d)), "SELECT repo, name FROM g WHERE rank <= 20 EXCEPT SELECT repo, name FROM k", *V)
query("ranking_intersect", lambda v, s, d: validation.ranking_intersect(*lists(s, d)[:2]), "SELECT repo, name FROM g WHERE rank <= 10 INTERSECT SELECT repo, name FROM t WHERE rank <= 10", *V)
FIGHT = "debt_cleanup >= 50 AND CASE WHEN robust_survival > 0 THEN robust_survival ELSE survival END >= 30"
query("entropy_fighters", lambda v, s, d: validation.entropy_fighters(engineers(s, d)).select("repo", "author", "fight"), f"SELECT repo, author, debt_cleanup + greatest(robust_survival, survival) AS fight FROM eg WHERE {FIGHT}", *V)
query("champions", lambda v, s, d: validation.champions(engineers(s, d)).select("repo", "author", "size", "rank"), "SELECT eg.repo, author, COUNT(*) OVER (PARTITION BY eg.repo) AS size, CAST(g.rank AS INTEGER) AS rank FROM eg JOIN g ON g.repo = eg.repo AND g.name = eg.author QUALIFY g.rank <= 5", *V)
query("author_set_union", lambda v, s, d: scoring.author_keys([lists(s, d)[0].where("rank <= 3").withColumnRenamed("name", "author"), lists(s, d)[1].where("rank <= 3").withColumnRenamed("name", "author")], ("repo",)),
      "SELECT repo, name AS author FROM g WHERE rank <= 3 UNION SELECT repo, name FROM t WHERE rank <= 3", *V)
query("login_resolve", lambda v, s, d: validation.resolve_logins(lists(s, d)[1].where("rank <= 3").select("repo", "rank", F.upper("name").alias("login")), lists(s, d)[1].where("rank = 1").select("repo", F.col("name").alias("alias"), F.lit(" Top Name").alias("canonical"))).select("repo", "rank", "login", "name"),
      "SELECT repo, CAST(rank AS INTEGER) AS rank, upper(name) AS login, CASE WHEN rank = 1 THEN 'top name' ELSE name END AS name FROM t WHERE rank <= 3", *V)
query("known_flags", lambda v, s, d: validation.ranked(engineers(s, d), "gravity").join(lists(s, d)[2].withColumn("known", F.lit(True)), ["repo", "name"], "left").select("repo", "name", "rank", F.coalesce("known", F.lit(False)).alias("is_known")),
      "SELECT g.repo, g.name, CAST(g.rank AS INTEGER) AS rank, k.name IS NOT NULL AS is_known FROM g LEFT JOIN k ON k.repo = g.repo AND k.name = g.name", *V)


def validated(s, d):
    g, t, k = lists(s, d)
    return validation.validate_repos(engineers(s, d), t, k)


RV = (
    f"rv AS (SELECT s.repo, s.size, o.overlap, coalesce(p.common, 0) AS common, coalesce(p.rho, 0e0) AS rho, r.recall, coalesce(h.hidden, 0) AS hidden, coalesce(f.fighters, 0) AS fighters, cn.concentration FROM (SELECT repo, COUNT(*) AS size FROM eg GROUP BY repo) s "
    f"JOIN ({OV.format('overlap', 't', 10, 'WHERE t.rank <= 10')}) o USING (repo) JOIN ({OV.format('recall', 'k', 20, '')}) r USING (repo) LEFT JOIN (SELECT repo, COUNT(*) AS common, {RHO} AS rho FROM ({BOTH}) GROUP BY repo) p USING (repo) "
    f"LEFT JOIN (SELECT repo, COUNT(*) AS hidden FROM ({HID}) GROUP BY repo) h USING (repo) LEFT JOIN (SELECT repo, COUNT(*) AS fighters FROM eg WHERE {FIGHT} GROUP BY repo) f USING (repo) JOIN cn USING (repo))"
)
#: The columns of a repository beside its name: n(umber as it is) or d(ouble).
VALIDATED = {"size": "n", "overlap": "d", "common": "n", "rho": "d", "recall": "d", "hidden": "n", "fighters": "n", "concentration": "d"}
query("repo_validation", lambda v, s, d: rounded(validated(s, d), 6), "SELECT repo, size, ROUND(overlap, 6) AS overlap, common, ROUND(rho, 6) AS rho, ROUND(recall, 6) AS recall, hidden, fighters, ROUND(concentration, 6) AS concentration FROM rv", *V, CONC, RV)
query("validation_summary", lambda v, s, d: rounded(validation.validation_summary(validated(s, d))),
      "SELECT COUNT(*) AS repos, ROUND(AVG(overlap), 4) AS mean_overlap, ROUND(AVG(recall) FILTER (recall > 0), 4) AS mean_recall, ROUND(AVG(rho), 4) AS mean_rho, ROUND(AVG(concentration), 4) AS mean_concentration, CAST(SUM(hidden) AS BIGINT) AS hidden, CAST(SUM(fighters) AS BIGINT) AS fighters, MAX(size) AS largest, MIN(size) AS smallest FROM rv", *V, CONC, RV)

# --- single steps of the plans above ----------------------------------------------------------------------------------

query("gravity", lambda v, s, d: rounded(score_queries.grid(s, d).select("author", scoring.gravity().alias("gravity"))), "SELECT author, ROUND(gravity, 4) AS gravity FROM sg", "score_grid", score_queries.GRID)
query("recently_active", lambda v, s, d: axes.author_activity(v("c")).select("author", (axes.days_between(axes.as_of_column(AS_OF), F.col("last_at")) <= 150).alias("active")),
      f"SELECT author, {sql_days(SQL_AS_OF, 'MAX(committed_at)')} <= 150 AS active FROM c GROUP BY author", "c")
query("raw_scores",
      lambda v, s, d: raw_scores([axes.lines_changed(changes(v), by=("repo",)).select("repo", "author", "production"), axes.indispensability(axes.bus_factor(v("b"), fixture_config(s, d)), ("repo",)).where("indispensability > 12")], ("repo",)),
      "SELECT repo, author, x.production, y.indispensability FROM (SELECT repo, author, CAST(SUM(insertions + deletions) AS BIGINT) AS production FROM fca GROUP BY 1, 2) x FULL JOIN (SELECT repo, author, SUM(CASE level WHEN 'CRITICAL' THEN 1e0 ELSE 0.5e0 END) AS indispensability FROM bf GROUP BY 1, 2 HAVING SUM(CASE level WHEN 'CRITICAL' THEN 1e0 ELSE 0.5e0 END) > 12) y USING (repo, author)",
      "c fc b", FC, OW, BF)
query("author_filter", lambda v, s, d: timelines.filter_authors(label_timeline(s, d), ["A1", "a7", "nobody"]).groupBy("author").agg(F.count("*").alias("n")), "SELECT author, COUNT(*) AS n FROM tg WHERE author IN ('a1', 'a7') GROUP BY author", "score_grid", TLG)
query("rename_path", lambda v, s, d: v("p").select("path", paths.resolve_rename(F.concat(F.lit("old/{a => b}/"), "path")).alias("braces"), paths.resolve_rename(F.concat(F.lit("old.go => "), "path")).alias("arrow")), "SELECT path, CONCAT('old/b/', path) AS braces, path AS arrow FROM p", "p")
query("domain_name", lambda v, s, d: v("p").select(paths.normalize_domain(F.element_at(F.array(*map(F.lit, ("", "backend", "FE", "infrastructure", "fw", "data"))), (F.col("p_size") % 6 + 1).cast("int"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n")),
      "SELECT CASE p_size % 6 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'BE' WHEN 2 THEN 'FE' WHEN 3 THEN 'Infra' WHEN 4 THEN 'FW' ELSE 'Data' END AS domain, COUNT(*) AS n FROM p GROUP BY 1", "p")
query("glob_match", lambda v, s, d: v("p").where(F.col("path").rlike("^" + paths.glob_to_regex("*/b[1-3]?/f*.go") + "$")).select("path"), "SELECT path FROM p WHERE regexp_matches(path, '^[^/]*/b[1-3][^/]/f[^/]*[.]go$')", "p")
LABEL_AXES = ("character", "structure", "culture", "phase", "risk")
#: The grid's teams once for each period, for the oracles: the period is part of the team's name there.
PGRID = score_queries.GRID.replace("SELECT *,", "SELECT * REPLACE (CONCAT(team, '~P', CAST(n % 3 AS VARCHAR)) AS team),", 1)
TEAM_CH = f"tch AS (SELECT *, {score_queries.PK(score_queries.CHARACTER)} AS ch FROM tl)"
TEAM_PERIODS = (PGRID, score_queries.SL, score_queries.TM, score_queries.TA, score_queries.TH, score_queries.TL, TEAM_CH)


def team_periods(s, d):
    """Every team in every period with its counts, health and labels."""
    rows = score_queries.members(s, d).withColumns({"period": F.concat(F.lit("P"), (F.col("n") % 3).cast("string"))})
    labelled = teams.team_labels(teams.team_health(teams.aggregate(rows.withColumn("domain", F.col("period")))))
    return labelled.withColumns({"period": F.col("domain"), "domain": F.lit("BE")})


def team_changes(s, d):
    names = team_periods(s, d).select("team", "period", *(F.col(f"{a}.name").alias(a) for a in LABEL_AXES))
    return timelines.transitions(names, "team", LABEL_AXES, "period")


TEAM_TR = (
    "SELECT team, period, axis, before, after FROM (SELECT *, lag(after) OVER (PARTITION BY team, axis ORDER BY period) AS before FROM (SELECT split_part(team, '~', 1) AS team, split_part(team, '~', 2) AS period, unnest(['character', 'structure', 'culture', 'phase', 'risk']) AS axis, "
    "unnest([ch.n, structure_name, culture_name, phase_name, risk_name]) AS after FROM tch)) WHERE before <> after AND before <> '—' AND after <> '—'"
)
query("team_transitions", lambda v, s, d: team_changes(s, d), TEAM_TR, "score_grid", *TEAM_PERIODS)
query("team_timeline", lambda v, s, d: rounded(teams.team_health(teams.aggregate(score_queries.members(s, d).withColumn("domain", F.concat(F.lit("P"), (F.col("n") % 3).cast("string"))))).select("team", F.col("domain").alias("period"), "core_members", "effective_members", "total_members", "avg_impact", "risk_ratio")),
      "SELECT team, CONCAT('P', CAST(n % 3 AS VARCHAR)) AS period, COUNT(*) FILTER (tier = 'core') AS core_members, COUNT(*) FILTER (tier <> 'peripheral') AS effective_members, COUNT(*) AS total_members, ROUND(coalesce(AVG(impact) FILTER (tier = 'core'), 0e0), 4) AS avg_impact, "
      "ROUND(COUNT(*) FILTER (tier = 'risk') / CAST(COUNT(*) FILTER (tier <> 'peripheral') AS DOUBLE) * 100, 4) AS risk_ratio FROM tm GROUP BY 1, 2 HAVING COUNT(*) FILTER (tier <> 'peripheral') > 0", "score_grid", score_queries.GRID, score_queries.SL, score_queries.TM)
