"""Queries over scores, labels, teams, periods and ranking validation."""

from __future__ import annotations


from pyspark.sql import functions as F

from strata.fixtures import AS_OF, DAILY_REF, fixture_config, spark_sql, with_views
from strata.functions import soft
from strata.operators import scoring, teams
from strata.operators.clean import materialize
from strata.plans.blame_queries import ALL, BF, OW, WD
from strata.plans.log_queries import FC, QUALITY, QUALITY_VALUE, SQL_ARCH
from strata.plans.rankings import Relations, author_scores
from strata.plans.registry import SQL_AS_OF, SQL_IS_FIX, H, L, N, query, rounded, sql_conf, sql_days, sql_module, sql_pick

# --- soft functions and the rule engines on the label grid ----------------------------------------------------------

GRID = (
    "sg AS (SELECT *, CASE WHEN has_pressure THEN 100 - dormant_pct ELSE NULL END AS raw_robust, CASE WHEN has_pressure THEN dormant_pct ELSE NULL END AS raw_dormant, CASE WHEN has_pressure THEN dormant_pct ELSE 0 END AS dormant_survival, "
    "100 - untested_pct AS tested_survival, untested_pct AS untested_survival, indispensability * 0.4e0 + breadth * 0.3e0 + design * 0.3e0 AS gravity, (production + quality + survival + design) / 4e0 AS impact FROM score_grid)"
)


def grid(s, d):
    df = spark_sql(s, d, with_views("score_grid", GRID) + "SELECT * FROM sg")
    return scoring.with_labels(df)


S = "survival"
ROLE = [("Architect", f"least({H('design')}, CASE WHEN (robust_survival = 0 AND dormant_survival = 0) OR {H('production')} > 0 THEN {H(S)} ELSE {H('robust_survival')} END, {N('breadth')})"),
        ("Anchor", f"least({H('quality')}, {N('production')})"), ("Cleaner", f"least({H('quality')}, {H(S)}, {H('debt_cleanup')})"), ("Producer", N("production")), ("Specialist", f"least({H(S)}, {L('breadth')})")]
STYLE = [("Builder", f"least({H('production')}, {H('design')}, {N('debt_cleanup')})"), ("Resilient", f"CASE WHEN robust_survival = 0 THEN 0e0 ELSE least({H('production')}, {L(S)}, {N('robust_survival')}) END"),
         ("Rescue", f"least({H('production')}, {L(S)}, {H('debt_cleanup')})"), ("Churn", f"CASE WHEN production - survival < 30 THEN 0e0 ELSE least({N('production')}, {L('quality')}, {L(S)}) END"), ("Mass", f"least({H('production')}, {L(S)})"),
         ("Emergent", f"CASE WHEN gravity < 50 OR production < 30 OR {L('robust_survival')} = 0 THEN 0e0 ELSE least({H('gravity')}, {N('production')}, {L('robust_survival')}) END"), ("Balanced", "CASE WHEN impact >= 30 THEN 0.30e0 ELSE 0e0 END"),
         ("Spread", f"least({H('breadth')}, {L('production')}, {L(S)}, {L('design')})")]
DR, UR = "(raw_dormant * 100 / CAST(nullif(raw_robust + raw_dormant, 0) AS DOUBLE))", "(untested_survival * 100 / CAST(nullif(tested_survival + untested_survival, 0) AS DOUBLE))"
HELD = "indispensability >= 60 AND production < 40"
STATE = [("Former", f"least({H('raw_survival')}, {L(S)}, greatest({H('design')}, {H('indispensability')}))"), ("Silent", f"CASE WHEN total_commits < 100 THEN 0e0 ELSE least({L('production')}, {L(S)}, {L('debt_cleanup')}) END"),
         ("Fragile", f"CASE WHEN {HELD} AND {DR} >= 80 AND {UR} >= 50 THEN 0.90e0 + least(({DR} - 80) / 200e0, ({UR} - 50) / 500e0, 0.07e0) WHEN {HELD} AND {DR} >= 80 THEN 0.85e0 + ({DR} - 80) / 200e0 "
                     f"WHEN {HELD} AND {DR} IS NULL AND {UR} >= 70 AND survival >= 50 THEN 0.80e0 + ({UR} - 70) / 300e0 WHEN quality >= 70 THEN 0e0 ELSE least({H(S)}, {L('production')}) END"),
         ("Growing", f"least({L('production')}, {H('quality')})"), ("Active", "CASE WHEN recently_active THEN 0.80e0 ELSE 0e0 END")]
SL = f"sl AS (SELECT *, {sql_pick(ROLE)} AS rl, {sql_pick(STYLE)} AS sy, {sql_pick(STATE)} AS se FROM sg)"
for axis, short in (("role", "rl"), ("style", "sy"), ("state", "se")):
    query(f"author_{axis}", lambda v, s, d, a=axis: grid(s, d).select("author", F.col(f"{a}.name").alias("name"), F.col(f"{a}.conf").alias("conf")),
          f"SELECT author, {short}.n AS name, {sql_conf(short)} AS conf FROM sl", "score_grid", GRID, SL)
query("pick_best", lambda v, s, d: grid(s, d).groupBy("role.name").agg(F.count("*").alias("n"), F.round(F.sum("role.conf"), 2).alias("conf")), f"SELECT rl.n AS name, COUNT(*) AS n, ROUND(SUM({sql_conf('rl')}), 2) AS conf FROM sl GROUP BY 1", "score_grid", GRID, SL)
query("soft_match_author", lambda v, s, d: v("score_grid").select("author", soft.highness(F.col("quality")).alias("high"), soft.lowness(F.col("quality")).alias("low"), soft.not_low(F.col("quality")).alias("not_low")),
      f"SELECT author, {H('quality')} AS high, {L('quality')} AS low, {N('quality')} AS not_low FROM score_grid", "score_grid")
SQL_PRESENCE = "(CASE WHEN {0} >= 0.3e0 THEN 1e0 WHEN {0} > 0 THEN 0.3e0 + ({0} / 0.3e0) * 0.7e0 ELSE 0e0 END)"
HH = lambda x: f"(CASE WHEN {x} >= 70 THEN 1e0 WHEN {x} >= 50 THEN 0.5e0 + ({x} - 50) / 40e0 WHEN {x} >= 30 THEN ({x} - 30) / 40e0 * 0.3e0 ELSE 0e0 END)"
AH = lambda x: f"(CASE WHEN {x} >= 60 THEN 1e0 WHEN {x} >= 40 THEN 0.5e0 + ({x} - 40) / 40e0 WHEN {x} >= 20 THEN ({x} - 20) / 40e0 * 0.3e0 ELSE 0e0 END)"
query("soft_match_team", lambda v, s, d: rounded(v("score_grid").select("author", soft.presence(F.col("quality") / 100).alias("presence"), soft.health_high(F.col("quality")).alias("health"), soft.axis_high(F.col("quality")).alias("axis")), 6),
      f"SELECT author, ROUND({SQL_PRESENCE.format('(quality / 100e0)')}, 6) AS presence, ROUND({HH('quality')}, 6) AS health, ROUND({AH('quality')}, 6) AS axis FROM score_grid", "score_grid")
query("scalar_math", lambda v, s, d: v("score_grid").select("author", F.least("quality", "design").alias("low"), F.greatest("quality", "design").alias("high"), soft.clamp(F.col("quality") * 1.0, 20, 80).alias("clamped"), soft.round_conf(F.col("quality") / 777).alias("conf")),
      "SELECT author, least(quality, design) AS low, greatest(quality, design) AS high, greatest(least(quality * 1e0, 80e0), 20e0) AS clamped, floor(quality / 777e0 * 100 + 0.5e0) / 100 AS conf FROM score_grid", "score_grid")
query("impact_band", lambda v, s, d: grid(s, d).select("author", soft.impact_band(F.col("impact")).alias("band")).where("band is not null"),
      "SELECT author, CASE WHEN impact BETWEEN 80 AND 100 THEN '80-100' WHEN impact BETWEEN 60 AND 79 THEN '60-79' WHEN impact BETWEEN 40 AND 59 THEN '40-59' WHEN impact BETWEEN 30 AND 39 THEN '30-39' WHEN impact BETWEEN 20 AND 29 THEN '20-29' WHEN impact BETWEEN 0 AND 19 THEN '0-19' END AS band FROM sg "
      "WHERE impact BETWEEN 80 AND 100 OR impact BETWEEN 60 AND 79 OR impact BETWEEN 40 AND 59 OR impact BETWEEN 30 AND 39 OR impact BETWEEN 20 AND 29 OR impact BETWEEN 0 AND 19", "score_grid", GRID)
query("impact_histogram", lambda v, s, d: grid(s, d).groupBy(soft.impact_band(F.floor("impact")).alias("band")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN floor(impact) >= 80 THEN '80-100' WHEN floor(impact) >= 60 THEN '60-79' WHEN floor(impact) >= 40 THEN '40-59' WHEN floor(impact) >= 30 THEN '30-39' WHEN floor(impact) >= 20 THEN '20-29' ELSE '0-19' END AS band, COUNT(*) AS n FROM sg GROUP BY 1", "score_grid", GRID)
query("gravity_health", lambda v, s, d: grid(s, d).select("author", soft.gravity_band(*map(F.col, ("gravity", "quality", "robust_survival", "survival", "has_pressure"))).alias("band")),
      "SELECT author, CASE WHEN gravity < 20 THEN 'negligible' WHEN h >= 60 THEN 'healthy' WHEN h >= 40 THEN 'moderate' ELSE 'fragile' END AS band FROM (SELECT *, quality * 0.6e0 + CASE WHEN has_pressure THEN robust_survival ELSE survival END * 0.4e0 AS h FROM sg)", "score_grid", GRID)
query("role_normalize", lambda v, s, d: grid(s, d).groupBy(soft.norm_role(F.col("role.name")).alias("role")).agg(F.count("*").alias("n")), "SELECT CASE WHEN rl.n = '—' THEN 'Other' ELSE rl.n END AS role, COUNT(*) AS n FROM sl GROUP BY 1", "score_grid", GRID, SL)
DEV = "CONCAT('dev', CAST(CAST(FLOOR(n / 5) AS BIGINT) AS VARCHAR))"
PATTERN_ROWS = f"(SELECT {DEV} AS dev, COUNT(*) AS k, COUNT(DISTINCT rl.n) AS dn, MIN(rl.n) AS one, bool_or(rl.n = 'Architect') AS arch FROM sl GROUP BY 1)"


def in_repos(rows):
    """The grid as authors in up to five repositories each."""
    return rows.withColumns({"dev": F.concat(F.lit("dev"), F.floor(F.col("n") / 5).cast("string")), "repo": F.concat(F.lit("repo"), (F.col("n") % 5).cast("string"))})


def author_repo_matrix(v, s, d):
    rows = in_repos(grid(s, d)).select(F.col("dev").alias("author"), "repo", "impact", F.col("role.name").alias("role"))
    found = scoring.author_repo_matrix(rows, rows.groupBy("author").agg(F.avg("impact").alias("impact")))
    cells = F.array_join(F.transform("cells", lambda x: F.concat(x["repo"], F.lit("="), x["cell"])), " | ")
    return found.select(F.col("author").alias("dev"), "place", cells.alias("cells"), "pattern")


query("cross_repo_pattern", lambda v, s, d: in_repos(grid(s, d)).groupBy("dev").agg(F.collect_list("role.name").alias("roles")).select("dev", soft.cross_repo_pattern(F.col("roles")).alias("pattern")),
      "SELECT dev, CASE WHEN k = 0 THEN '—' WHEN k = 1 THEN 'Single Repo' WHEN dn > 1 THEN CASE WHEN arch THEN 'Context-dependent' ELSE 'Variable' END WHEN one = 'Architect' THEN 'Reproducible' WHEN one = '—' THEN 'Emerging' ELSE CONCAT('Consistently ', one) END AS pattern "
      f"FROM {PATTERN_ROWS}", "score_grid", GRID, SL)
query("author_repo_matrix", author_repo_matrix,
      "SELECT dev, CAST(row_number() OVER (ORDER BY mean DESC, dev) AS INTEGER) AS place, cells, CASE WHEN k = 1 THEN 'Single Repo' WHEN dn > 1 THEN CASE WHEN arch THEN 'Context-dependent' ELSE 'Variable' END WHEN one = 'Architect' THEN 'Reproducible' WHEN one = '—' THEN 'Emerging' ELSE CONCAT('Consistently ', one) END AS pattern "
      f"FROM {PATTERN_ROWS} JOIN (SELECT {DEV} AS dev, AVG(impact) AS mean, string_agg(CONCAT('repo', n % 5, '=', CASE WHEN rl.n = '—' THEN '' ELSE CONCAT(rl.n, ' ') END, CAST(round_even(impact, 0) AS BIGINT)), ' | ' ORDER BY n % 5) AS cells FROM sl GROUP BY 1) USING (dev)", "score_grid", GRID, SL)
query("dormant_untested_ratio", lambda v, s, d: rounded(grid(s, d).select("author", scoring.dormant_ratio().alias("dormant"), scoring.untested_ratio().alias("untested"))), f"SELECT author, ROUND({DR}, 4) AS dormant, ROUND({UR}, 4) AS untested FROM sg", "score_grid", GRID)

# --- scoring --------------------------------------------------------------------------------------------------------

query("normalize_max", lambda v, s, d: rounded(v("score_grid").select("author", "team", scoring.normalize_max(F.col("quality"), ("team",)).alias("quality"))),
      "SELECT author, team, ROUND(CASE WHEN m > 0 THEN least(quality / m * 100e0, 100e0) ELSE 0e0 END, 4) AS quality FROM (SELECT *, CAST(MAX(quality) OVER (PARTITION BY team) AS DOUBLE) AS m FROM score_grid)", "score_grid")
W = "production * 0.15e0 + quality * 0.10e0 + breadth * 0.10e0 + debt_cleanup * 0.15e0 + indispensability * 0.05e0"
query("impact", lambda v, s, d: rounded(grid(s, d).select("author", scoring.impact(fixture_config(s, d).weights).alias("impact"), scoring.gravity().alias("gravity"))),
      f"SELECT author, ROUND(CASE WHEN NOT has_pressure THEN p + survival * 0.25e0 + design * 0.20e0 WHEN robust_survival = 0 THEN x * 0.8e0 ELSE x END, 4) AS impact, ROUND(gravity, 4) AS gravity FROM "
      f"(SELECT *, {W} AS p, {W} + (robust_survival * 0.8e0 + dormant_survival * 0.2e0) * 0.25e0 + design * greatest(robust_survival / 100e0 * 0.8e0 + 0.2e0, production / 100e0 * 0.8e0 + 0.2e0) * 0.20e0 AS x FROM sg)", "score_grid", GRID)
query("rank_members", lambda v, s, d: scoring.rank_by_impact(grid(s, d), ("team",)).select("team", "author", "rank"), "SELECT team, author, CAST(row_number() OVER (PARTITION BY team ORDER BY impact DESC, author) AS INTEGER) AS rank FROM sg", "score_grid", GRID)
query("drop_ghosts", lambda v, s, d: scoring.drop_ghosts(grid(s, d).withColumn("impact", F.when(F.col("n") % 2 == 0, F.lit(0.0)).otherwise(F.col("impact")))).groupBy("team").agg(F.count("*").alias("n")),
      "SELECT team, COUNT(*) AS n FROM (SELECT team, total_commits, CASE WHEN n % 2 = 0 THEN 0e0 ELSE impact END AS impact FROM sg) WHERE NOT (total_commits = 0 AND impact = 0) GROUP BY team", "score_grid", GRID)


def relations(v):
    domain = F.when(F.col("repo").isin("repo0", "repo1"), "BE").otherwise("FE")
    return Relations(v("c"), v("fc"), v("b"), v("files"), v("c").select("repo").distinct().withColumn("domain", domain))


RANK_COLUMNS = ("author", "total_commits", "production", "quality", "survival", "robust_survival", "dormant_survival", "design", "breadth", "debt_cleanup", "indispensability", "impact", "gravity", "recently_active", "has_pressure")


def rankings(v, s, d, by=()):
    cfg = fixture_config(s, d)
    scores = scoring.rank_by_impact(author_scores(relations(v).cleaned(cfg).staged(), cfg, AS_OF, by, materialize), by)
    labels = [F.col(f"{a}.{p}").alias(f"{a}_{p}") for a in ("role", "style", "state") for p in ("name", "conf")]
    return rounded(scores.select(*by, "rank", *RANK_COLUMNS, *labels), 3)


def _N(c: str, over: str) -> str:
    return f"coalesce(CASE WHEN MAX({c}) OVER ({over}) > 0 THEN least({c} / CAST(MAX({c}) OVER ({over}) AS DOUBLE) * 100, 100e0) END, 0e0)"


UNITS_REPOS = "SELECT author, repo FROM c WHERE NOT is_merge GROUP BY author, repo HAVING COUNT(*) >= 3"
UNITS_MODULES = f"SELECT repo, author, {sql_module()} AS module FROM fca GROUP BY ALL HAVING COUNT(DISTINCT commit_id) >= 3"


def rk(key: str = "", of: str = "", over: str = "", units: str = UNITS_REPOS) -> str:
    """The ranking's CTEs; for groups their column (`key`), its expression over repo (`of`) and the window of a group;
    breadth counts `units`."""
    return (
    f"x1 AS (SELECT {of}author, SUM(insertions + deletions) AS lines FROM fca WHERE NOT regexp_matches(path, 'generated|(^|/)mock_|[.]gen[.]|^docs/') GROUP BY ALL), "
    f"x2 AS (SELECT {of}author, COUNT(*) FILTER (NOT is_merge) AS commits, MIN(committed_at) AS f, MAX(committed_at) AS l FROM c GROUP BY ALL), "
    f"x3 AS (SELECT {of}author, AVG({QUALITY_VALUE}) AS quality FROM q GROUP BY ALL), "
    f"x4 AS (SELECT {of}author, SUM({WD}) AS survival, SUM(CASE WHEN pressure >= threshold THEN {WD} ELSE 0 END) AS robust, SUM(CASE WHEN pressure >= threshold THEN 0 ELSE {WD} END) AS dormant, COUNT(*) AS raw, SUM(CASE WHEN is_tested THEN w ELSE 0 END) AS tw, SUM(CASE WHEN is_tested THEN 0 ELSE w END) AS uw FROM en GROUP BY ALL), "
    f"x5 AS (SELECT {of}author, SUM(insertions + deletions) AS design FROM fca WHERE {SQL_ARCH} GROUP BY ALL), "
    f"x6 AS (SELECT {of}author, COUNT(*) AS breadth FROM ({units}) GROUP BY ALL), "
    f"fx AS (SELECT DISTINCT fc.repo, fc.commit_id, fc.path, c.author AS fixer, c.committed_at AS fix_at FROM fc JOIN c ON c.repo = fc.repo AND c.commit_id = fc.commit_id WHERE {SQL_IS_FIX} AND NOT c.is_merge), "
    "dv AS (SELECT x.repo, x.fixer, b.author AS original, COUNT(*) AS lines FROM fx x JOIN b ON b.repo = x.repo AND b.path = x.path AND b.committed_at < x.fix_at AND b.author <> x.fixer GROUP BY 1, 2, 3), "
    "ds AS (SELECT repo, author, CASE WHEN SUM(a) + SUM(z) < 10 THEN 50e0 ELSE 50 + 50 * (SUM(a) - SUM(z)) / CAST(SUM(a) + SUM(z) AS DOUBLE) END AS debt FROM (SELECT repo, fixer AS author, lines AS a, 0 AS z FROM dv UNION ALL SELECT repo, original, 0, lines FROM dv) GROUP BY repo, author), "
    f"x7 AS (SELECT {of}author, AVG(debt) AS debt FROM ds GROUP BY ALL), x8 AS (SELECT {of}author, SUM(CASE level WHEN 'CRITICAL' THEN 1e0 ELSE 0.5e0 END) AS ind FROM bf GROUP BY ALL), "
    f"rk AS (SELECT {key}author, x2.commits AS total_commits, least(coalesce(lines, 0) / greatest({sql_days('x2.l', 'x2.f')}, 1e0) / {DAILY_REF} * 100, 100e0) AS production, coalesce(quality, 0e0) AS quality, {_N('x4.survival', over)} AS survival, {_N('robust', over)} AS robust_survival, {_N('dormant', over)} AS dormant_survival, "
    f"{_N('x5.design', over)} AS design, {_N('x6.breadth', over)} AS breadth, coalesce(debt, 50e0) AS debt_cleanup, {_N('ind', over)} AS indispensability, {sql_days(SQL_AS_OF, 'x2.l')} <= 150e0 AS recently_active, robust AS raw_robust, dormant AS raw_dormant, tw AS tested_survival, uw AS untested_survival, {_N('raw', over)} AS raw_survival, TRUE AS has_pressure "
    "FROM x2 " + " ".join(f"FULL JOIN x{i} USING ({key}author)" for i in (1, 3, 4, 5, 6, 7, 8)) + "), "
    f"rj AS (SELECT *, CASE WHEN robust_survival = 0 THEN ix * 0.8e0 ELSE ix END AS impact, indispensability * 0.4e0 + breadth * 0.3e0 + design * 0.3e0 AS gravity FROM (SELECT *, {W} + (robust_survival * 0.8e0 + dormant_survival * 0.2e0) * 0.25e0 + design * greatest(robust_survival / 100e0 * 0.8e0 + 0.2e0, production / 100e0 * 0.8e0 + 0.2e0) * 0.20e0 AS ix FROM rk WHERE total_commits > 0)), "
    f"rr AS (SELECT *, {sql_pick(ROLE)} AS rl, {sql_pick(STYLE)} AS sy, {sql_pick(STATE)} AS se FROM rj)"
)


def rk_sql(key: str = "", over: str = "") -> str:
    return (
        f"SELECT {key}CAST(row_number() OVER ({over} ORDER BY impact DESC, author) AS INTEGER) AS rank, author, total_commits, " + ", ".join(f"ROUND({c}, 3) AS {c}" for c in RANK_COLUMNS[2:13])
        + f", recently_active, has_pressure, rl.n AS role_name, ROUND({sql_conf('rl')}, 3) AS role_conf, sy.n AS style_name, ROUND({sql_conf('sy')}, 3) AS style_conf, se.n AS state_name, ROUND({sql_conf('se')}, 3) AS state_conf FROM rr"
    )


query("rankings", rankings, rk_sql(), "c fc b files", FC, QUALITY, *ALL, OW, BF, rk())
# Two domains of two repositories each.
DOMAIN = "CASE WHEN repo IN ('repo0', 'repo1') THEN 'BE' ELSE 'FE' END"
query("rollup_domain", lambda v, s, d: rankings(v, s, d, ("domain",)), rk_sql("domain, ", "PARTITION BY domain"), "c fc b files", FC, QUALITY, *ALL, OW, BF, rk("domain, ", DOMAIN + " AS domain, ", "PARTITION BY domain"))
query("rollup_repo_domain", lambda v, s, d: rankings(v, s, d, ("repo",)).select("repo", "rank", "author", "impact", "gravity", "role_name", "style_name", "state_name"),
      f"SELECT repo, rank, author, impact, gravity, role_name, style_name, state_name FROM ({rk_sql('repo, ', 'PARTITION BY repo')})", "c fc b files", FC, QUALITY, *ALL, OW, BF, rk("repo, ", "repo, ", "PARTITION BY repo", UNITS_MODULES))


# --- teams ----------------------------------------------------------------------------------------------------------

def members(s, d):
    return teams.team_tiers(grid(s, d).withColumns({"domain": F.lit("BE"), "repos": (F.col("n") * 0 + 5).cast("int")}))


TM = (
    "tm AS (SELECT *, CASE WHEN se.n IN ('Former', 'Silent', 'Fragile') THEN 'risk' WHEN recently_active AND impact >= 20 THEN 'core' ELSE 'peripheral' END AS tier, greatest(impact / 100e0, 0.1e0) AS wt FROM sl)"
)
_CNT = lambda x, names: ", ".join(f"COUNT(*) FILTER (e AND {x}.n = '{r}') AS n_{r}" for r in names)
_WGT = lambda x, names: ", ".join(f"coalesce(SUM(wt) FILTER (e AND {x}.n = '{r}') / SUM(wt) FILTER (e), 0e0) AS w_{r}" for r in names)
TA = (
    "ta AS (SELECT team, COUNT(*) FILTER (tier = 'core') AS core_members, COUNT(*) FILTER (e) AS effective_members, COUNT(*) AS total_members, "
    + ", ".join(f"coalesce(AVG({a}) FILTER (tier = 'core'), 0e0) AS avg_{a}" for a in teams.AVERAGES)
    + ", coalesce(stddev_pop(quality) FILTER (tier = 'core'), 0e0) AS quality_stdev, "
    + ", ".join((_CNT("rl", teams.ROLES), _CNT("sy", teams.STYLES), _CNT("se", teams.STATES), _WGT("rl", teams.ROLES), _WGT("sy", teams.STYLES), _WGT("se", ("Active",))))
    + ", COUNT(*) FILTER (e AND rl.n = '—') AS n_none, COUNT(*) FILTER (e AND rl.n = 'Architect' AND sy.n = 'Builder') AS nba FROM (SELECT *, tier <> 'peripheral' AS e FROM tm) GROUP BY team HAVING COUNT(*) FILTER (e) > 0)"
)
_G = lambda x: f"n_{x} > 0"
CL = lambda x, a="0e0", z="100e0": f"greatest(least({x}, {z}), {a})"
TH = (
    "th2 AS (SELECT *, n_Former + n_Silent + n_Fragile AS nr, effective_members AS n FROM ta), "
    f"thh AS (SELECT *, {CL('(CAST(n_Architect > 0 AS INT) + CAST(n_Anchor > 0 AS INT) + CAST(n_Cleaner > 0 AS INT) + CAST(n_Producer > 0 AS INT) + CAST(n_Specialist > 0 AS INT)) / 5e0 * 80 + CASE WHEN n_Architect > 0 THEN 10e0 ELSE 0 END + CASE WHEN n_Anchor > 0 THEN 5e0 ELSE 0 END + CASE WHEN n_Cleaner > 0 THEN 5e0 ELSE 0 END')} AS complementarity, "
    f"{CL('n_Growing / CAST(n AS DOUBLE) * 60 + CASE WHEN n_Builder > 0 THEN 20e0 ELSE 0 END + CASE WHEN n_Cleaner > 0 THEN 20e0 ELSE 0 END')} AS growth_potential, {CL('(1 - nr / CAST(n AS DOUBLE)) * 80 + CASE WHEN n_Architect > 0 THEN 20e0 ELSE 0 END')} AS sustainability, {CL('avg_debt_cleanup')} AS debt_balance, "
    f"{CL('CASE WHEN core_members = 0 THEN 0e0 WHEN core_members <= 3 AND avg_production >= 50 THEN avg_production * 1.2e0 WHEN core_members <= 5 AND avg_production >= 50 THEN avg_production * 1.1e0 ELSE avg_production END')} AS productivity_density, "
    f"{CL('CASE WHEN core_members < 2 THEN avg_quality ELSE avg_quality * 0.6e0 + ' + CL('100 - quality_stdev * 2') + ' * 0.4e0 END')} AS quality_consistency, {CL('nr / CAST(n AS DOUBLE) * 100')} AS risk_ratio, "
    "CASE WHEN n_Architect = 0 THEN 0e0 WHEN n_Anchor = 0 THEN -1e0 ELSE n_Architect / CAST(n_Anchor AS DOUBLE) END AS aar, n_Anchor / CAST(n AS DOUBLE) AS anchor_density, (n_Architect + n_Anchor) / CAST(n AS DOUBLE) AS architecture_coverage FROM th2)"
)
HEALTH = ("complementarity", "growth_potential", "sustainability", "debt_balance", "productivity_density", "quality_consistency", "risk_ratio", "aar", "anchor_density", "architecture_coverage")
query("team_tiers", lambda v, s, d: members(s, d).groupBy("team", "tier").agg(F.count("*").alias("n")), "SELECT team, tier, COUNT(*) AS n FROM tm GROUP BY team, tier", "score_grid", GRID, SL, TM)
query("team_averages", lambda v, s, d: rounded(teams.aggregate(members(s, d)).select("team", "core_members", "effective_members", "total_members", *(f"avg_{a}" for a in teams.AVERAGES))),
      "SELECT team, core_members, effective_members, total_members, " + ", ".join(f"ROUND(avg_{a}, 4) AS avg_{a}" for a in teams.AVERAGES) + " FROM ta", "score_grid", GRID, SL, TM, TA)
query("weighted_ratio", lambda v, s, d: rounded(members(s, d).groupBy("team").agg(teams.weighted_ratio(F.col("role.name") == "Producer").alias("producers"))), "SELECT team, ROUND(coalesce(SUM(wt) FILTER (rl.n = 'Producer'), 0) / SUM(wt), 4) AS producers FROM tm GROUP BY team", "score_grid", GRID, SL, TM)
query("label_distribution", lambda v, s, d: teams.label_distribution(members(s, d)),
      "SELECT team, axis, label, COUNT(*) AS n FROM (SELECT team, 'role' AS axis, rl.n AS label FROM tm WHERE tier <> 'peripheral' UNION ALL SELECT team, 'style', sy.n FROM tm WHERE tier <> 'peripheral' UNION ALL SELECT team, 'state', se.n FROM tm WHERE tier <> 'peripheral') GROUP BY 1, 2, 3", "score_grid", GRID, SL, TM)
query("team_health", lambda v, s, d: rounded(teams.team_health(teams.aggregate(members(s, d))).select("team", *HEALTH)), "SELECT team, " + ", ".join(f"ROUND({h}, 4) AS {h}" for h in HEALTH) + " FROM thh", "score_grid", GRID, SL, TM, TA, TH)
query("quality_stdev", lambda v, s, d: rounded(teams.aggregate(members(s, d)).select("team", "quality_stdev")), "SELECT team, ROUND(quality_stdev, 4) AS quality_stdev FROM ta", "score_grid", GRID, SL, TM, TA)
query("top_contributor_share", lambda v, s, d: rounded(teams.top_share(members(s, d))),
      "SELECT team, COUNT(*) AS core, ROUND(MAX(production) / CAST(nullif(SUM(production), 0) AS DOUBLE) * 100, 4) AS share, ROUND((SUM(production) - MAX(production)) / CAST(nullif(COUNT(*) - 1, 0) AS DOUBLE), 4) AS rest FROM tm WHERE tier = 'core' GROUP BY team", "score_grid", GRID, SL, TM)
query("gravity_gap", lambda v, s, d: rounded(teams.gravity_gap(members(s, d))),
      "SELECT team, author, ROUND(gravity - coalesce(nx, 0), 4) AS gap FROM (SELECT team, author, gravity, lead(gravity) OVER w AS nx, row_number() OVER w AS r FROM tm WINDOW w AS (PARTITION BY team ORDER BY gravity DESC, author)) WHERE r = 1", "score_grid", GRID, SL, TM)
R_ = lambda ok, x: f"CASE WHEN {ok} THEN {x} ELSE 0e0 END"
NONE = "(n_none / CAST(n AS DOUBLE))"
STRUCTURE = [("Architectural Engine", R_(f"n_Architect >= 1 AND n_Anchor >= 2 AND aar BETWEEN 0.3e0 AND 0.8e0 AND {NONE} <= 0.4e0", CL("least(w_Architect * 3, w_Anchor * 2)", z="1e0"))),
             ("Architectural Team", R_(f"n_Architect >= 1 AND n_Anchor >= 1 AND {NONE} <= 0.4e0", CL("least(w_Architect * 2.5e0, w_Anchor * 2)", z="0.9e0"))),
             ("Architecture-Heavy", R_("n_Architect >= 1 AND aar > 2 AND nba < n_Architect", CL("w_Architect * 2", z="0.85e0"))), ("Emerging Architecture", R_(f"n_Architect >= 1 AND {NONE} > 0.4e0", CL("w_Architect * 2", z="0.85e0"))),
             ("Delivery Team", R_("n_Producer / CAST(n AS DOUBLE) >= 0.5e0", "w_Producer")), ("Maintenance Team", R_("n_Architect = 0 AND n_Anchor / CAST(n AS DOUBLE) >= 0.4e0", "w_Anchor")), ("Unstructured", R_(f"{NONE} > 0.5e0", NONE)), ("Balanced", "0.30e0")]
CULTURE = [("Builder", R_("w_Builder >= 0.15e0", CL("w_Builder * 1.2e0", z="1e0"))), ("Stability", R_("w_Balanced + w_Resilient >= 0.5e0", "(w_Balanced + w_Resilient) * 0.9e0")), ("Mass Production", R_("w_Mass >= 0.3e0", "w_Mass")),
           ("Firefighting", R_("w_Rescue + w_Churn >= 0.2e0", "(w_Rescue + w_Churn)")), ("Evolving", R_("w_Builder >= 0.1e0 AND w_Emergent >= 0.1e0", CL("(w_Builder + w_Emergent) * 1.2e0", z="1e0"))), ("Exploration", R_("w_Spread >= 0.2e0", "w_Spread")), ("Mixed", "0.25e0")]
GR, AC, RI = "(n_Growing / CAST(n AS DOUBLE))", "(n_Active / CAST(n AS DOUBLE))", "(nr / CAST(n AS DOUBLE))"
PS = SQL_PRESENCE.format
PHASE = [("Emerging", R_(f"{GR} >= 0.4e0", PS(GR))), ("Scaling", R_(f"{GR} >= 0.2e0 AND {GR} < 0.4e0", f"least({PS(GR)}, {HH('growth_potential')})")), ("Mature", R_(f"{AC} >= 0.8e0", f"least({PS('w_Active')}, {HH('sustainability')})")), ("Stable", R_(f"{AC} >= 0.6e0", "w_Active * 0.3e0 + 0.5e0")),
         ("Legacy-Heavy", R_(f"{RI} >= 0.3e0 AND avg_impact >= 40 AND n_Architect > 0", f"least({PS(RI)}, {AH('avg_impact')})")), ("Mature with Attrition", R_(f"{RI} >= 0.2e0 AND {RI} < 0.4e0 AND {AC} >= 0.4e0", f"least({PS(RI)} * 0.8e0, w_Active * 0.3e0 + 0.5e0)")),
         ("Declining", R_(f"{RI} >= 0.3e0", f"{PS(RI)} * CASE WHEN avg_impact >= 40 AND n_Architect > 0 THEN 0.5e0 ELSE 1e0 END")), ("Rebuilding", R_(f"{GR} >= 0.1e0 AND {RI} >= 0.1e0", f"least({PS(GR)}, {PS(RI)})"))]
RISK = [("Bus Factor", R_("n <= 5", f"least({AH('avg_indispensability')}, 1 - n / 10e0)")), ("Design Vacuum", R_("n_Architect = 0", "1 - complementarity / 100e0")), ("Quality Drift", R_("quality_consistency <= 60", "1 - quality_consistency / 100e0")),
        ("Debt Spiral", R_("debt_balance <= 45", "1 - debt_balance / 100e0")), ("Talent Drain", R_("risk_ratio >= 25", "risk_ratio / 100e0")), ("Healthy", "0.30e0")]
PK = lambda rules: sql_pick(rules, "0e0", "0e0", "0e0")
TL = (
    f"tl0 AS (SELECT *, {PK(STRUCTURE)} AS st, {PK(CULTURE)} AS cu, {PK(PHASE)} AS ph, {PK(RISK)} AS ri FROM thh), tl AS (SELECT *, st.n AS structure_name, {sql_conf('st')} AS structure_conf, cu.n AS culture_name, {sql_conf('cu')} AS culture_conf, ph.n AS phase_name, {sql_conf('ph')} AS phase_conf, ri.n AS risk_name, {sql_conf('ri')} AS risk_conf FROM tl0)"
)
ENGINE, BOTH = "structure_name IN ('Architectural Engine', 'Architectural Team')", "least(structure_conf, culture_conf)"
CHARACTER = [("Spiral", R_("architecture_coverage > 0.4e0 AND productivity_density > 35 AND aar >= 0.3e0 AND (aar <= 0.8e0 OR (n_Architect > 0 AND nba = n_Architect))", CL("architecture_coverage + productivity_density / 100e0", z="1e0"))),
             ("Elliptical", R_(f"{ENGINE} AND culture_name = 'Stability'", BOTH)), ("Starburst", R_(f"({ENGINE} OR structure_name = 'Emerging Architecture') AND culture_name = 'Builder'", BOTH)),
             ("Nebula", R_("culture_name = 'Builder'", "CASE WHEN phase_name IN ('Scaling', 'Emerging') THEN least(culture_conf, phase_conf) ELSE culture_conf * 0.5e0 END")), ("Irregular", R_("productivity_density > 40 AND architecture_coverage < 0.2e0", CL("productivity_density / 100e0 + 0.3e0", z="0.85e0"))),
             ("Cluster", R_("structure_name = 'Delivery Team'", f"CASE WHEN culture_name = 'Mass Production' THEN {BOTH} ELSE structure_conf * 0.6e0 END")), ("Collision", R_("culture_name = 'Firefighting'", "culture_conf")),
             ("Dwarf", "CASE WHEN structure_name = 'Maintenance Team' AND culture_name IN ('Stability', 'Mixed') THEN least(structure_conf, 0.70e0) WHEN architecture_coverage > 0.5e0 AND productivity_density < 20 THEN 0.65e0 ELSE 0e0 END"),
             ("Filament", R_("culture_name = 'Exploration'", "culture_conf * 0.8e0")), ("Lenticular", "0.25e0")]


def labelled_teams(s, d, keep="n < 100000000"):
    return teams.team_labels(teams.team_health(teams.aggregate(members(s, d).where(keep))))


TEAM_CTES = (GRID, SL, TM, TA, TH, TL)
for axis in ("structure", "culture", "phase", "risk"):
    query(f"team_{axis}", lambda v, s, d, a=axis: labelled_teams(s, d).select("team", F.col(f"{a}.name").alias("name"), F.col(f"{a}.conf").alias("conf")), f"SELECT team, {axis}_name AS name, {axis}_conf AS conf FROM tl", "score_grid", *TEAM_CTES)
query("team_character", lambda v, s, d: labelled_teams(s, d).select("team", F.col("character.name").alias("name"), F.col("character.conf").alias("conf")),
      f"SELECT team, ch.n AS name, {sql_conf('ch')} AS conf FROM (SELECT team, {PK(CHARACTER)} AS ch FROM tl)", "score_grid", *TEAM_CTES)
query("pick_best_label", lambda v, s, d: labelled_teams(s, d).groupBy(F.col("structure.name").alias("structure"), F.col("culture.name").alias("culture")).agg(F.count("*").alias("n")), "SELECT structure_name AS structure, culture_name AS culture, COUNT(*) AS n FROM tl GROUP BY 1, 2", "score_grid", *TEAM_CTES)
_PCT = lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"
WARN = (
    "wm AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY gravity DESC, author) AS r FROM tm WHERE tier <> 'peripheral'), "
    "wt AS (SELECT tl.*, a.author AS a1, a.gravity AS g1, a.robust_survival AS r1, coalesce(a.gravity - b.gravity, a.gravity) AS gap, t.top, avg_production * core_members AS total FROM tl JOIN wm a ON a.team = tl.team AND a.r = 1 LEFT JOIN wm b ON b.team = tl.team AND b.r = 2 "
    "LEFT JOIN (SELECT team, arg_max({'production': production, 'author': author}, production) AS top FROM tm WHERE tier = 'core' GROUP BY team) t ON t.team = tl.team), "
    "wk AS (SELECT * FROM wt WHERE core_members > 0), "
    "ww AS (SELECT team, 1 AS o, 0 AS o2, CONCAT(core_members, ' core members carrying 5 repos — high bus factor risk') AS warning FROM wk WHERE core_members <= 3 "
    f"UNION ALL SELECT team, 2, 0, CASE WHEN risk_ratio >= 40 THEN CONCAT({_PCT('risk_ratio')}, '% risk ratio — ', n - core_members, ' of ', n, ' effective members are Former/Silent/Fragile') ELSE CONCAT({_PCT('risk_ratio')}, '% risk ratio — approaching danger zone') END FROM wk WHERE risk_ratio >= 25 "
    f"UNION ALL SELECT team, 3, 0, CONCAT('Top contributor (', top.author, ') accounts for ', {_PCT('top.production / nullif(total, 0e0) * 100')}, '% of core production — ProdDensity drops to ', {_PCT('(total - top.production) / (core_members - 1)')}, ' without them') FROM wk WHERE core_members >= 2 AND top.production / nullif(total, 0e0) * 100 >= 45 "
    "UNION ALL SELECT team, 4, 0, CONCAT(n_Silent, ' Silent members — headcount says ', total_members, ' but effective contributors are ', core_members) FROM wk WHERE n_Silent >= 2 "
    "UNION ALL SELECT team, 5, 0, 'No Architect across 5 repos — design decisions are implicit and unguarded' FROM wk WHERE n_Architect = 0 "
    f"UNION ALL SELECT team, 6, 0, CONCAT('Fragile gravity center — ', a1, ' (Grav ', {_PCT('g1')}, ', RobustSurv ', {_PCT('r1')}, ') concentrates structural influence without durability') FROM wk WHERE g1 >= 80 AND r1 < 50 AND gap >= 30 "
    f"UNION ALL SELECT wm.team, 7, wm.r, CONCAT('Fragile gravity — ', wm.author, ' (Grav ', {_PCT('wm.gravity')}, ') has high influence but low robust survival (', {_PCT('wm.robust_survival')}, ')') FROM wm JOIN wk ON wk.team = wm.team WHERE wm.gravity >= 50 AND wm.robust_survival < 20 "
    f"UNION ALL SELECT team, 8, 0, CONCAT('Architect gravity exists but structural coverage remains low (', {_PCT('architecture_coverage * 100')}, '%)') FROM wk WHERE n_Architect > 0 AND architecture_coverage < 0.25e0 "
    "UNION ALL SELECT team, 0, 0, 'No core contributors — team has no active members above contribution threshold' FROM wt WHERE core_members = 0)"
)
query("team_warnings", lambda v, s, d: teams.team_warnings(labelled_teams(s, d)).select("team", F.posexplode("warnings").alias("pos", "warning")),
      "SELECT team, CAST(row_number() OVER (PARTITION BY team ORDER BY o, o2) - 1 AS INTEGER) AS pos, warning FROM ww", "score_grid", *TEAM_CTES, WARN)
query("team_members", lambda v, s, d: teams.team_members(grid(s, d).select("author", F.lit("BE").alias("domain")), s.createDataFrame([("core", "BE", "m1"), ("core", "BE", "m5"), ("all", "BE", None), ("none", "FE", "m1")], "team string, domain string, member string")).groupBy("team").agg(F.count("*").alias("n")),
      "SELECT 'all' AS team, COUNT(*) AS n FROM score_grid UNION ALL SELECT 'core', COUNT(*) FROM score_grid WHERE author IN ('m1', 'm5')", "score_grid")
