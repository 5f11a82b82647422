"""Queries over line attribution, files, modules and debt."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.fixtures import AS_OF, MIN_LINES, fixture_config
from strata.operators import axes, modules, sampling
from strata.plans.registry import SQL_AS_OF, SQL_BASE, SQL_IS_FIX, SQL_IS_TEST, H, L, query, rounded, sql_conf, sql_days, sql_dir, sql_module, sql_pick

CM = f"cm AS (SELECT DISTINCT repo, commit_id, {sql_module()} AS module FROM fc)"
PR = (
    f"mc AS (SELECT repo, module, COUNT(*) AS commits FROM cm GROUP BY repo, module), ml AS (SELECT repo, {sql_module()} AS module, COUNT(*) AS lines FROM b GROUP BY 1, 2), "
    "pr AS (SELECT repo, module, CASE WHEN coalesce(lines, 0) > 0 THEN coalesce(commits, 0) / CAST(lines AS DOUBLE) ELSE CAST(coalesce(commits, 0) AS DOUBLE) END AS pressure FROM mc FULL JOIN ml USING (repo, module))"
)
AL = "al AS (SELECT repo, author, COUNT(*) AS lines, SUM(COUNT(*)) OVER (PARTITION BY repo) AS total FROM b GROUP BY repo, author)"
TH = (
    "th AS (SELECT repo, substantial, CASE WHEN substantial >= 2 THEN median ELSE CAST('Infinity' AS DOUBLE) END AS threshold FROM "
    f"(SELECT repo, COUNT(*) FILTER (lines >= {MIN_LINES} AND lines / CAST(total AS DOUBLE) >= 0.1e0) AS substantial FROM al GROUP BY repo) JOIN (SELECT repo, quantile_cont(pressure, 0.5) AS median FROM pr GROUP BY repo) USING (repo))"
)
STEM = f"regexp_replace({SQL_BASE}, '[.][^.]*$', '')"
EXT = f"regexp_extract({SQL_BASE}, '([.][^.]*)$', 1)"
SIBLINGS = f"[{', '.join(f"CONCAT({sql_dir()}, '/', '{a}', {STEM}, '{z}', {EXT})" for a, z in (('', '_test'), ('', '.test'), ('', '.spec'), ('test_', ''), ('', '_spec'), ('', 'Test'), ('', 'Tests'), ('', 'Spec'), ('Test', '')))}]"
FT = (
    f"ff AS (SELECT repo, path, {sql_dir()} AS dir, {sql_module()} AS module, {SQL_IS_TEST} AS is_test FROM files), "
    f"sb AS (SELECT DISTINCT s.repo, s.path FROM (SELECT repo, path, unnest({SIBLINGS}) AS candidate FROM files WHERE NOT {SQL_IS_TEST}) s JOIN ff t ON t.repo = s.repo AND t.path = s.candidate AND t.is_test), "
    "ft AS (SELECT ff.repo, ff.path, ff.module, ff.is_test, ff.is_test OR sb.path IS NOT NULL OR bool_or(ff.is_test) OVER (PARTITION BY ff.repo, ff.dir) AS is_tested FROM ff LEFT JOIN sb ON sb.repo = ff.repo AND sb.path = ff.path)"
)
EN = (
    f"en AS (SELECT b.repo, b.path, b.author, {sql_module('b.path')} AS module, exp(-{sql_days(SQL_AS_OF, 'b.committed_at')} / 720e0) AS w, coalesce(pr.pressure, 0e0) AS pressure, coalesce(ft.is_tested, FALSE) AS is_tested, th.threshold "
    f"FROM b LEFT JOIN pr ON pr.repo = b.repo AND pr.module = {sql_module('b.path')} LEFT JOIN ft ON ft.repo = b.repo AND ft.path = b.path LEFT JOIN th ON th.repo = b.repo)"
)
ALL = (CM, PR, AL, TH, FT, EN)


def pressure(v):
    return axes.change_pressure(axes.commit_modules(v("fc")), v("b"))


def enriched(v, s, d):
    p = pressure(v)
    limits = axes.pressure_threshold(v("b"), p, fixture_config(s, d).min_substantial_lines)
    return axes.enrich_blame(v("b"), p, axes.file_tested(v("files"))).join(limits.select("repo", "threshold"), "repo", "left")


query("change_pressure", lambda v, s, d: rounded(pressure(v), 6), "SELECT repo, module, ROUND(pressure, 6) AS pressure FROM pr", "fc b", CM, PR)
query("median_pressure", lambda v, s, d: rounded(axes.median_pressure(pressure(v)), 6), "SELECT repo, ROUND(quantile_cont(pressure, 0.5), 6) AS median FROM pr GROUP BY repo", "fc b", CM, PR)
query("pressure_across_repos", lambda v, s, d: rounded(pressure(v).groupBy("module").agg(F.avg("pressure").alias("pressure")), 6), "SELECT module, ROUND(AVG(pressure), 6) AS pressure FROM pr GROUP BY module", "fc b", CM, PR)
query("substantial_authors", lambda v, s, d: rounded(axes.pressure_threshold(v("b"), pressure(v), fixture_config(s, d).min_substantial_lines), 6),
      "SELECT repo, substantial, ROUND(threshold, 6) AS threshold FROM th", "fc b", CM, PR, AL, TH)
query("tested_sibling", lambda v, s, d: axes.sibling_tested(v("files")), "SELECT repo, path FROM sb", "files", FT)
query("tested_files", lambda v, s, d: axes.file_tested(v("files")), "SELECT repo, path, module, is_test, is_tested FROM ft", "files", FT)
query("test_coverage", lambda v, s, d: rounded(axes.test_coverage(axes.file_tested(v("files")), "BE"), 6),
      "SELECT 'BE' AS domain, module, COUNT(*) AS files, COUNT(*) FILTER (is_test) AS tests, ROUND(COUNT(*) FILTER (is_test) / CAST(COUNT(*) AS DOUBLE), 6) AS ratio FROM ft GROUP BY GROUPING SETS ((), (module))", "files", FT)
query("blame_enrich", lambda v, s, d: rounded(enriched(v, s, d).groupBy("repo", "is_tested").agg(F.count("*").alias("lines"), F.sum("pressure").alias("pressure"))),
      "SELECT repo, is_tested, COUNT(*) AS lines, ROUND(SUM(pressure), 4) AS pressure FROM en GROUP BY repo, is_tested", "fc b files", *ALL)
WD = "w * CASE WHEN is_tested THEN 1e0 ELSE 0.5e0 END"
query("survival", lambda v, s, d: rounded(axes.survival(enriched(v, s, d), AS_OF, fixture_config(s, d), ("repo",)), 3),
      f"SELECT repo, author, COUNT(*) AS raw_survival, ROUND(SUM({WD}), 3) AS survival, ROUND(SUM(CASE WHEN is_tested THEN w ELSE 0 END), 3) AS tested_survival, ROUND(SUM(CASE WHEN is_tested THEN 0 ELSE w END), 3) AS untested_survival, "
      f"ROUND(SUM(CASE WHEN pressure >= threshold THEN {WD} ELSE 0 END), 3) AS robust_survival, ROUND(SUM(CASE WHEN pressure >= threshold THEN 0 ELSE {WD} END), 3) AS dormant_survival FROM en GROUP BY repo, author", "fc b files", *ALL)
query("survival_classic", lambda v, s, d: rounded(axes.survival(enriched(v, s, d), AS_OF, fixture_config(s, d), alpha=1.0, split=False), 3),
      "SELECT author, COUNT(*) AS raw_survival, ROUND(SUM(w), 3) AS survival, ROUND(SUM(CASE WHEN is_tested THEN w ELSE 0 END), 3) AS tested_survival, ROUND(SUM(CASE WHEN is_tested THEN 0 ELSE w END), 3) AS untested_survival FROM en GROUP BY author", "fc b files", *ALL)
MS = f"ms AS (SELECT repo, {sql_module()} AS module, AVG(exp(-{sql_days(SQL_AS_OF, 'committed_at')} / 720e0)) AS survival FROM b GROUP BY 1, 2)"
query("module_survival", lambda v, s, d: rounded(axes.module_survival(v("b"), AS_OF, 720.0), 6), "SELECT repo, module, ROUND(survival, 6) AS survival FROM ms", "b", MS)
query("module_survival_merge", lambda v, s, d: rounded(axes.merge_module_survival(axes.module_survival(v("b"), AS_OF, 720.0)), 6),
      "SELECT module, ROUND(list_reduce(list(survival ORDER BY repo), lambda a, x: (a + x) / 2), 6) AS survival FROM ms GROUP BY module", "b", MS)

OW = f"ow AS (SELECT repo, {sql_module()} AS module, author, COUNT(*) AS n FROM b GROUP BY 1, 2, 3), os AS (SELECT *, n / CAST(SUM(n) OVER (PARTITION BY repo, module) AS DOUBLE) AS share, row_number() OVER (PARTITION BY repo, module ORDER BY n DESC, author) AS r FROM ow)"
BF = "bf AS (SELECT repo, module, author, share, CASE WHEN share >= 0.8e0 THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM os WHERE r = 1 AND share >= 0.6e0)"
query("bus_factor", lambda v, s, d: rounded(axes.bus_factor(v("b"), fixture_config(s, d)), 6), "SELECT repo, module, author, ROUND(share, 6) AS share, level FROM bf", "b", OW, BF)
query("indispensability", lambda v, s, d: axes.indispensability(axes.bus_factor(v("b"), fixture_config(s, d))), "SELECT author, SUM(CASE level WHEN 'CRITICAL' THEN 1e0 ELSE 0.5e0 END) AS indispensability FROM bf GROUP BY author", "b", OW, BF)
OWN = (
    "own AS (SELECT repo, module, CAST(SUM(n) AS BIGINT) AS lines, COUNT(*) AS authors, MAX(author) FILTER (r = 1) AS top_author, MAX(share) FILTER (r = 1) AS top_share, greatest(-SUM(share * log2(share)), 0e0) AS entropy FROM os GROUP BY repo, module), "
    "owl AS (SELECT *, CASE WHEN authors = 1 THEN 'SOLE_OWNER' WHEN top_share >= 0.8e0 THEN 'CONCENTRATED' WHEN top_share >= 0.4e0 THEN 'HEALTHY' ELSE 'FRAGMENTED' END AS level FROM own)"
)
query("ownership", lambda v, s, d: rounded(axes.ownership(v("b"))), "SELECT repo, module, lines, authors, top_author, ROUND(top_share, 4) AS top_share, ROUND(entropy, 4) AS entropy, level FROM owl", "b", OW, OWN)
query("risky_ownership", lambda v, s, d: modules.risky_ownership(axes.ownership(v("b"))).select("repo", "module", "top_author", "level", F.round("top_share", 4).alias("top_share")),
      "SELECT repo, module, top_author, level, ROUND(top_share, 4) AS top_share FROM owl WHERE level <> 'HEALTHY' ORDER BY owl.top_share DESC, repo, module LIMIT 15", "b", OW, OWN)
query("top_author", lambda v, s, d: rounded(axes.owners(v("b"), axes.module_of(F.col("path"))).where("rank <= 2").select("repo", "module", "author", "n", "share", "rank"), 6),
      "SELECT repo, module, author, n, ROUND(share, 6) AS share, CAST(r AS INTEGER) AS rank FROM os WHERE r <= 2", "b", OW)

# --- co-change and module scores -----------------------------------------------------------------------------------

MCC = "mcc AS (SELECT repo, module, COUNT(*) AS commits FROM cm GROUP BY repo, module)"
CC = (
    "cp AS (SELECT a.repo, a.module AS module_a, b.module AS module_b, COUNT(*) AS together FROM cm a JOIN cm b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.module < b.module GROUP BY 1, 2, 3), "
    "cc AS (SELECT cp.*, together / CAST(x.commits + y.commits - together AS DOUBLE) AS coupling FROM cp JOIN mcc x ON x.repo = cp.repo AND x.module = module_a JOIN mcc y ON y.repo = cp.repo AND y.module = module_b)"
)
pairs = lambda v: modules.cochange(axes.commit_modules(v("fc")))
query("module_commit_counts", lambda v, s, d: modules.module_commit_counts(axes.commit_modules(v("fc"))), "SELECT repo, module, commits FROM mcc", "fc", CM, MCC)
query("cochange", lambda v, s, d: rounded(pairs(v), 6), "SELECT repo, module_a, module_b, together, ROUND(coupling, 6) AS coupling FROM cc", "fc", CM, MCC, CC)
query("cochange_selfjoin", lambda v, s, d: pairs(v).groupBy("repo").agg(F.count("*").alias("pairs"), F.sum("together").alias("together")), "SELECT repo, COUNT(*) AS pairs, CAST(SUM(together) AS BIGINT) AS together FROM cp GROUP BY repo", "fc", CM, MCC, CC)
query("significant_pairs", lambda v, s, d: rounded(modules.significant_pairs(modules.coupled_pairs(axes.commit_modules(v("fc")), 2, 0.01), 2, 0.01, 100), 6),
      "SELECT repo, module_a, module_b, together, ROUND(coupling, 6) AS coupling FROM cc WHERE together >= 2 AND coupling >= 0.01e0 ORDER BY cc.coupling DESC, together DESC, repo, module_a, module_b LIMIT 100", "fc", CM, MCC, CC)
MCP = "mcp AS (SELECT module, AVG(coupling) AS avg_coupling, MAX(coupling) AS max_coupling, COUNT(*) AS pairs FROM (SELECT module_a AS module, coupling FROM cc UNION ALL SELECT module_b, coupling FROM cc) GROUP BY module)"
query("module_coupling", lambda v, s, d: rounded(modules.module_coupling(pairs(v)), 6), "SELECT module, ROUND(avg_coupling, 6) AS avg_coupling, ROUND(max_coupling, 6) AS max_coupling, pairs FROM mcp", "fc", CM, MCC, CC, MCP)
query("pair_endpoints", lambda v, s, d: modules.module_coupling(pairs(v), ("repo",)).select("repo", "module", "pairs"),
      "SELECT repo, module, COUNT(*) AS pairs FROM (SELECT repo, module_a AS module FROM cc UNION ALL SELECT repo, module_b FROM cc) GROUP BY repo, module", "fc", CM, MCC, CC)
PRK = "mp AS (SELECT module, AVG(pressure) AS pressure FROM pr GROUP BY module), prk AS (SELECT module, pressure, CASE WHEN COUNT(*) OVER () = 1 THEN 0.5e0 ELSE (row_number() OVER (ORDER BY pressure, module) - 1) / CAST(COUNT(*) OVER () - 1 AS DOUBLE) END AS pressure_rank FROM mp)"
query("percentile_rank", lambda v, s, d: rounded(modules.percentile_rank(pressure(v), ("repo",)), 6),
      "SELECT repo, module, ROUND(pressure, 6) AS pressure, ROUND((row_number() OVER (PARTITION BY repo ORDER BY pressure, module) - 1) / CAST(COUNT(*) OVER (PARTITION BY repo) - 1 AS DOUBLE), 6) AS pressure_rank FROM pr", "fc b", CM, PR)


def indicators(v):
    blame, cm = v("b"), axes.commit_modules(v("fc"))
    surv = axes.module_survival(blame, AS_OF, 720.0, ())
    return modules.module_indicators(axes.change_pressure(cm, blame), surv, axes.ownership(blame), modules.module_commit_counts(cm), modules.module_coupling(modules.cochange(cm)))


IND = (
    f"sv AS (SELECT {sql_module()} AS module, AVG(exp(-{sql_days(SQL_AS_OF, 'committed_at')} / 720e0)) AS survival FROM b GROUP BY 1), lo AS (SELECT * FROM owl QUALIFY row_number() OVER (PARTITION BY module ORDER BY repo DESC) = 1), "
    "tc AS (SELECT module, CAST(SUM(commits) AS BIGINT) AS commits FROM mcc GROUP BY module), sp AS (SELECT module FROM pr UNION SELECT module FROM sv UNION SELECT module FROM owl UNION SELECT module FROM mcc), "
    "ind AS (SELECT sp.module, prk.pressure, coalesce(tc.commits, 0) AS commits, coalesce(mcp.avg_coupling, 0e0) AS avg_coupling, coalesce(mcp.pairs, 0) AS pairs, lo.top_author, lo.top_share, lo.entropy, lo.level, sv.survival IS NOT NULL AS has_blame, "
    "(1 - coalesce(mcp.avg_coupling, 0e0)) * 100 AS boundary, coalesce(sv.survival, 0e0) * 100 AS absorption, coalesce((1 - prk.pressure_rank) * 100, 100e0) AS stability, "
    "coalesce(CASE lo.level WHEN 'SOLE_OWNER' THEN 80e0 WHEN 'CONCENTRATED' THEN 50e0 WHEN 'HEALTHY' THEN 25e0 WHEN 'FRAGMENTED' THEN 10e0 END + greatest(least((lo.entropy - 1.5e0) * 2.5e0, 5e0), -5e0), 0e0) AS knowledge "
    "FROM sp LEFT JOIN prk USING (module) LEFT JOIN sv USING (module) LEFT JOIN lo USING (module) LEFT JOIN tc USING (module) LEFT JOIN mcp USING (module))"
)
INDS = (CM, PR, MCC, CC, MCP, PRK, OW, OWN, IND)
IND_COLUMNS = "module, ROUND(pressure, 4) AS pressure, commits, ROUND(avg_coupling, 4) AS avg_coupling, pairs, top_author, ROUND(top_share, 4) AS top_share, ROUND(entropy, 4) AS entropy, level, has_blame, ROUND(boundary, 4) AS boundary, ROUND(absorption, 4) AS absorption, ROUND(stability, 4) AS stability, ROUND(knowledge, 4) AS knowledge"
query("module_indicators", lambda v, s, d: rounded(indicators(v)), f"SELECT {IND_COLUMNS} FROM ind", "fc b", *INDS)
query("module_spine", lambda v, s, d: modules.module_spine(pressure(v), axes.module_survival(v("b"), AS_OF, 720.0), axes.ownership(v("b"))), "SELECT module FROM pr UNION SELECT module FROM owl", "fc b", CM, PR, OW, OWN)


def owned_modules(v):
    return modules.owner_active(indicators(v), axes.author_activity(v("c")), axes.as_of_column(AS_OF), 150.0)


ACT = f"la AS (SELECT author, MAX(committed_at) AS last_at FROM c GROUP BY author), oa AS (SELECT ind.*, la.author IS NOT NULL AS owner_known, coalesce({sql_days(SQL_AS_OF, 'la.last_at')} <= 150e0, FALSE) AS owner_active FROM ind LEFT JOIN la ON la.author = ind.top_author)"
query("owner_activity", lambda v, s, d: owned_modules(v).select("module", "top_author", "owner_known", "owner_active"), "SELECT module, top_author, owner_known, owner_active FROM oa", "c fc b", *INDS, ACT)

A100, PRESS = "(avg_coupling * 100)", "(100 - stability)"
SQL_FRAGILE = f"(CASE WHEN has_blame AND test_ratio IS NOT NULL AND commits > 0 AND absorption >= 30 AND {PRESS} < 30 AND test_ratio < 0.10e0 THEN least(0.70e0 + 0.15e0 * (1 - test_ratio / 0.10e0) + 0.10e0 * (1 - {PRESS} / 30e0), 0.95e0) ELSE 0e0 END)"
SQL_COUPLING = [("Isolated", "CASE WHEN pairs = 0 THEN 0.95e0 ELSE 0e0 END"), ("Hub", f"CASE WHEN pairs > 0 THEN {H(A100)} ELSE 0e0 END"),
                ("Linked", f"CASE WHEN pairs > 0 AND {A100} >= 15 AND {A100} < 60 THEN 0.50e0 + ({A100} - 15) / 90e0 ELSE 0e0 END"), ("Independent", f"CASE WHEN pairs > 0 THEN {H('boundary')} ELSE 0e0 END")]
SQL_VITALITY = [("Dead", "CASE WHEN commits = 0 AND NOT owner_active THEN 0.95e0 ELSE 0e0 END"),
                ("Critical", f"CASE WHEN has_blame AND {PRESS} >= 80 AND absorption < 20 THEN least(1e0, 0.85e0 + ({PRESS} - 80) / 400e0 + (20 - absorption) / 400e0) ELSE 0e0 END"),
                ("Turbulent", f"CASE WHEN has_blame THEN least({H(PRESS)}, {L('absorption')}) ELSE 0e0 END"),
                ("Warming", f"CASE WHEN has_blame AND {PRESS} >= 30 AND {PRESS} < 70 AND absorption < 50 THEN 0.40e0 + ({PRESS} - 30) / 100e0 ELSE 0e0 END"),
                ("Fragile", SQL_FRAGILE), ("Stable", f"CASE WHEN {SQL_FRAGILE} > 0.10e0 THEN 0e0 ELSE {H('stability')} END")]
SQL_OWNERSHIP = [("Orphaned", "CASE WHEN owner_known AND NOT owner_active AND top_share >= 0.5e0 THEN 0.70e0 + top_share * 0.25e0 ELSE 0e0 END"),
                 ("Concentrated", "CASE WHEN level = 'SOLE_OWNER' THEN 0.95e0 WHEN level = 'CONCENTRATED' THEN 0.70e0 + top_share * 0.25e0 ELSE 0e0 END"),
                 ("Distributed", "CASE WHEN level = 'HEALTHY' THEN 0.80e0 WHEN level = 'FRAGMENTED' THEN 0.60e0 ELSE 0e0 END")]


def module_scores(v):
    tested = axes.file_tested(v("files")).groupBy("module").agg((F.count_if("is_test") / F.count("*")).alias("test_ratio"))
    return modules.module_labels(owned_modules(v).join(tested, "module", "left"))


def flat(df, *keep):
    out = [F.col(f"{a}.{p}").alias(f"{a}_{p}") for a in ("coupling", "vitality", "ownership") for p in ("name", "conf")]
    return df.select("module", *keep, *out)


LBL = (
    f"tr AS (SELECT module, COUNT(*) FILTER (is_test) / CAST(COUNT(*) AS DOUBLE) AS test_ratio FROM ft GROUP BY module), lb AS (SELECT oa.*, {sql_pick(SQL_COUPLING)} AS k, {sql_pick(SQL_VITALITY)} AS vt, {sql_pick(SQL_OWNERSHIP)} AS o "
    f"FROM (SELECT oa.*, tr.test_ratio FROM oa LEFT JOIN tr USING (module)) oa)"
)
LBL_COLUMNS = f"k.n AS coupling_name, {sql_conf('k')} AS coupling_conf, vt.n AS vitality_name, {sql_conf('vt')} AS vitality_conf, o.n AS ownership_name, {sql_conf('o')} AS ownership_conf"
query("module_scores", lambda v, s, d: flat(module_scores(v)), f"SELECT module, {LBL_COLUMNS} FROM lb", "c fc b files", *INDS, ACT, FT, LBL)
query("module_anomalies", lambda v, s, d: rounded(flat(modules.module_anomalies(module_scores(v)), "stability")),
      f"SELECT module, ROUND(stability, 4) AS stability, {LBL_COLUMNS} FROM lb WHERE k.n = 'Hub' OR vt.n IN ('Fragile', 'Turbulent', 'Critical', 'Dead') OR o.n = 'Orphaned' ORDER BY lb.stability, module LIMIT 30", "c fc b files", *INDS, ACT, FT, LBL)
query("module_axis_counts", lambda v, s, d: modules.label_counts(module_scores(v)),
      "SELECT axis, label, COUNT(*) AS modules FROM (SELECT 'coupling' AS axis, k.n AS label FROM lb UNION ALL SELECT 'vitality', vt.n FROM lb UNION ALL SELECT 'ownership', o.n FROM lb) GROUP BY axis, label", "c fc b files", *INDS, ACT, FT, LBL)

# --- grid of module rows, for the labels the derived relations don't reach -------------------------------------------

GRID = "mg AS (SELECT CONCAT('g', CAST(n AS STRING)) AS module, production / 100e0 AS avg_coupling, n % 7 AS pairs, 100 - quality AS stability, survival AS absorption, design / 100e0 AS top_share, n % 5 AS commits, (debt_cleanup / 400e0) AS test_ratio, n % 3 <> 0 AS has_blame, n % 2 = 0 AS owner_active, n % 11 <> 0 AS owner_known, (100 - production) * 1e0 AS boundary, CASE n % 4 WHEN 0 THEN 'SOLE_OWNER' WHEN 1 THEN 'CONCENTRATED' WHEN 2 THEN 'HEALTHY' ELSE 'FRAGMENTED' END AS level FROM g1)"


def module_grid(v, s, d):
    from strata.fixtures import spark_sql, with_views

    return flat(modules.module_labels(spark_sql(s, d, with_views("g1", GRID) + "SELECT * FROM mg")))


query("module_labels_grid", module_grid, f"SELECT module, {LBL_COLUMNS} FROM (SELECT *, {sql_pick(SQL_COUPLING)} AS k, {sql_pick(SQL_VITALITY)} AS vt, {sql_pick(SQL_OWNERSHIP)} AS o FROM mg)", "g1", GRID)

# --- debt, domains, sampling ----------------------------------------------------------------------------------------

DE = "de AS (SELECT x.repo, x.fixer, b.author AS original, COUNT(*) AS lines FROM fix_files x JOIN b ON b.repo = x.repo AND b.path = x.path AND b.committed_at < x.fix_at AND b.author <> x.fixer GROUP BY 1, 2, 3)"
query("debt_attribution", lambda v, s, d: axes.debt_events(v("fix_files"), v("b")), "SELECT repo, fixer, original, lines FROM de", "fix_files b", DE)
query("debt_score", lambda v, s, d: rounded(axes.debt_score(axes.debt_events(v("fix_files"), v("b")), 10)),
      "SELECT repo, author, CAST(SUM(cln) AS BIGINT) AS cleaned, CAST(SUM(gen) AS BIGINT) AS generated, ROUND(CASE WHEN SUM(cln) + SUM(gen) < 10 THEN 50e0 ELSE greatest(least(50 + 50 * (SUM(cln) - SUM(gen)) / CAST(SUM(cln) + SUM(gen) AS DOUBLE), 100e0), 0e0) END, 4) AS debt_cleanup "
      "FROM (SELECT repo, fixer AS author, lines AS cln, 0 AS gen FROM de UNION ALL SELECT repo, original, 0, lines FROM de) GROUP BY repo, author", "fix_files b", DE)
query("fix_sample", lambda v, s, d: axes.fix_sample(v("c")).select("repo", "commit_id"),
      f"SELECT repo, commit_id FROM c WHERE {SQL_IS_FIX} AND NOT is_merge QUALIFY row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_id DESC) <= 50", "c")
query("repo_domain",
      lambda v, s, d: axes.repo_domain(v("files"), s.createDataFrame([(".go", "BE", 0), (".py", "BE", 0), (".java", "BE", 0), (".rb", "BE", 0), (".ts", "FE", 1)], "extension string, domain string, priority int")),
      "SELECT repo, CASE WHEN COUNT(*) FILTER (path LIKE '%.ts') > COUNT(*) FILTER (path NOT LIKE '%.ts') THEN 'FE' ELSE 'BE' END AS domain FROM files GROUP BY repo", "files")
query("domain_order", lambda v, s, d: v("c").select(F.when(F.col("repo") == "repo0", "FE").when(F.col("repo") == "repo1", "Unknown").when(F.col("repo") == "repo2", "Apps").otherwise("BE").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
          .withColumn("place", F.coalesce(F.array_position(F.array(*map(F.lit, ("BE", "FE", "Infra", "FW"))), F.col("domain")), F.lit(0)))
          .select("domain", "n", F.when(F.col("place") > 0, F.col("place")).when(F.col("domain") == "Unknown", 99).otherwise(50).cast("long").alias("place")).orderBy("place", "domain"),
      "SELECT domain, COUNT(*) AS n, CAST(CASE domain WHEN 'BE' THEN 1 WHEN 'FE' THEN 2 WHEN 'Unknown' THEN 99 ELSE 50 END AS BIGINT) AS place FROM (SELECT CASE repo WHEN 'repo0' THEN 'FE' WHEN 'repo1' THEN 'Unknown' WHEN 'repo2' THEN 'Apps' ELSE 'BE' END AS domain FROM c) GROUP BY domain ORDER BY place, domain", "c")
ST = f"st AS (SELECT array_to_string(list_slice(string_split({sql_dir()}, '/'), 1, 3), '/') AS stratum, COUNT(*) AS size FROM p GROUP BY 1)"
QT = (
    "q1 AS (SELECT *, CASE WHEN COUNT(*) OVER () * 2 > 900 THEN 1 ELSE 2 END AS m FROM st), q2 AS (SELECT *, CASE WHEN SUM(least(m, size)) OVER (ORDER BY stratum) <= 900 THEN least(m, size) ELSE 0 END AS base FROM q1), "
    "q3 AS (SELECT *, size - base AS lft, (900 - SUM(base) OVER ()) * (size - base) / CAST(nullif(SUM(size - base) OVER (), 0) AS DOUBLE) AS share, 900 - SUM(base) OVER () AS rest FROM q2), q4 AS (SELECT *, least(floor(share), lft) AS fl FROM q3), "
    "q5 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN lft > fl THEN 0 ELSE 1 END, share - fl DESC, stratum) AS place, rest - SUM(fl) OVER () AS more FROM q4)"
)
query("stratified_sample", lambda v, s, d: sampling.stratified_sample(v("p").select("path"), 900).groupBy("stratum").agg(F.count("*").alias("n")),
      "SELECT stratum, n FROM (SELECT stratum, CAST(base + fl + CASE WHEN lft > fl AND place <= more THEN 1 ELSE 0 END AS BIGINT) AS n FROM q5) WHERE n > 0", "p", ST, QT)
