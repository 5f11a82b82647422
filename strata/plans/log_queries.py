"""Queries over commits and file changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.config import ARCHITECTURE, EXCLUDE_FILES
from strata.fixtures import fixture_config
from strata.functions import paths
from strata.functions.periods import period_label
from strata.operators import axes, clean
from strata.plans.registry import SQL_BASE, SQL_IS_FIX, SQL_IS_TEST, query, rounded, sql_days, sql_dir, sql_module

FC = "fca AS (SELECT fc.*, c.author FROM fc JOIN c ON fc.repo = c.repo AND fc.commit_id = c.commit_id)"


def changes(v):
    own = v("c").where(~F.col("is_merge")).select("repo", "commit_id", "author")
    return v("fc").join(own, ["repo", "commit_id"])


query("production", lambda v, s, d: axes.lines_changed(changes(v), EXCLUDE_FILES).select("author", "production"),
      "SELECT author, CAST(SUM(insertions + deletions) AS BIGINT) AS production FROM fca GROUP BY author", "c fc", FC)
query("lines_changed", lambda v, s, d: axes.lines_changed(changes(v), by=("repo",)).select("repo", "author", "lines_added", "lines_deleted"),
      "SELECT repo, author, CAST(SUM(insertions) AS BIGINT) AS lines_added, CAST(SUM(deletions) AS BIGINT) AS lines_deleted FROM fca GROUP BY repo, author", "c fc", FC)

ACTIVITY = "act AS (SELECT author, COUNT(*) FILTER (NOT is_merge) AS commits, MIN(committed_at) AS first_at, MAX(committed_at) AS last_at FROM c GROUP BY author)"


def activity(v, s, d):
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x[:-3] + "_day")
    return axes.author_activity(v("c")).select("author", "commits", day("first_at"), day("last_at"))


query("author_activity", activity, "SELECT author, commits, strftime(first_at, '%Y-%m-%d') AS first_day, strftime(last_at, '%Y-%m-%d') AS last_day FROM act", "c", ACTIVITY)
query("production_rate",
      lambda v, s, d: rounded(axes.lines_changed(changes(v)).join(axes.author_activity(v("c")), "author").select("author", axes.production_rate(F.col("production"), F.col("first_at"), F.col("last_at")).alias("rate"))),
      f"SELECT author, ROUND(SUM(insertions + deletions) / greatest({sql_days('ANY_VALUE(last_at)', 'ANY_VALUE(first_at)')}, 1e0), 4) AS rate FROM fca JOIN act USING (author) GROUP BY author", "c fc", FC, ACTIVITY)

QUALITY = f"q AS (SELECT repo, author, COUNT(*) FILTER ({SQL_IS_FIX}) AS fixes, COUNT(*) FILTER (NOT is_merge) AS total FROM c GROUP BY repo, author)"
QUALITY_VALUE = "CASE WHEN total = 0 THEN 100e0 ELSE 100 - fixes / total * 100e0 END"
query("quality", lambda v, s, d: rounded(axes.quality(v("c"), ("repo",))),
      f"SELECT repo, author, fixes, total, ROUND({QUALITY_VALUE}, 4) AS quality FROM q", "c", QUALITY)
query("mean_over_repos", lambda v, s, d: rounded(axes.mean_over(axes.quality(v("c"), ("repo",)), "quality")),
      f"SELECT author, ROUND(AVG({QUALITY_VALUE}), 4) AS quality FROM q GROUP BY author", "c", QUALITY)
query("sum_over_repos", lambda v, s, d: axes.lines_changed(changes(v), by=("repo",)).groupBy("author").agg(F.sum("production").alias("production"), F.count("*").alias("repos")),
      "SELECT author, CAST(SUM(p) AS BIGINT) AS production, COUNT(*) AS repos FROM (SELECT repo, author, SUM(insertions + deletions) AS p FROM fca GROUP BY repo, author) GROUP BY author", "c fc", FC)
query("commits_union_merges", lambda v, s, d: v("c").where("not is_merge").unionByName(v("c").where("is_merge")).groupBy("repo", "is_merge").agg(F.count("*").alias("n")),
      "SELECT repo, is_merge, COUNT(*) AS n FROM (SELECT * FROM c WHERE NOT is_merge UNION ALL SELECT * FROM c WHERE is_merge) GROUP BY repo, is_merge", "c")
query("author_summary", lambda v, s, d: v("c").groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author"),
      "SELECT author, COUNT(*) AS n FROM c GROUP BY author ORDER BY n DESC, author", "c")
query("fix_commit", lambda v, s, d: v("c").select("author", paths.is_fix(F.col("subject")).alias("is_fix"), "subject").groupBy("author", "is_fix").agg(F.count("*").alias("n"), F.min("subject").alias("example")),
      f"SELECT author, {SQL_IS_FIX} AS is_fix, COUNT(*) AS n, MIN(subject) AS example FROM c GROUP BY 1, 2", "c")

# Architecture: directory patterns anywhere, globs on a path suffix or a component, written out for the default list.
SQL_ARCH = "(regexp_matches(path, '(^|/)(domainservice|middleware|core|stores|hooks|types)/') OR regexp_matches(path, '(^|/)repository/[^/]*interface[^/]*$') OR regexp_matches(path, '(^|/)di/[^/]*[.]go$') OR contains(path, 'router.go'))"
query("design", lambda v, s, d: axes.design(changes(v), ARCHITECTURE),
      f"SELECT author, CAST(SUM(insertions + deletions) AS BIGINT) AS design FROM fca WHERE {SQL_ARCH} GROUP BY author HAVING SUM(insertions + deletions) > 0", "c fc", FC)
query("arch_match", lambda v, s, d: v("p").select("path", paths.is_architecture(F.col("path"), ARCHITECTURE).alias("is_architecture")),
      f"SELECT path, {SQL_ARCH} AS is_architecture FROM p", "p")

UNITS = "ar AS (SELECT author, repo, COUNT(*) AS commits FROM c WHERE NOT is_merge GROUP BY author, repo)"
MODULES = f"am AS (SELECT author, {sql_module()} AS module, COUNT(DISTINCT commit_id) AS commits FROM fca GROUP BY 1, 2)"
query("author_repo_commits", lambda v, s, d: v("c").where("not is_merge").groupBy("author", "repo").agg(F.count("*").alias("commits")), "SELECT author, repo, commits FROM ar", "c", UNITS)
query("author_module_commits", lambda v, s, d: axes.author_unit_commits(changes(v)), "SELECT author, module, commits FROM am", "c fc", FC, MODULES)
query("breadth", lambda v, s, d: axes.breadth(axes.author_unit_commits(changes(v)), 3).withColumn("unit", F.lit("module")).union(
          axes.breadth(v("c").where("not is_merge").groupBy("author", "repo").agg(F.count("*").alias("commits")), 3).withColumn("unit", F.lit("repo"))),
      "SELECT author, COUNT(*) AS breadth, 'module' AS unit FROM am WHERE commits >= 3 GROUP BY author UNION ALL SELECT author, COUNT(*), 'repo' FROM ar WHERE commits >= 3 GROUP BY author", "c fc", FC, MODULES, UNITS)

# --- scalar functions ----------------------------------------------------------------------------------------------

query("module_of", lambda v, s, d: v("p").select("path", paths.module_of(F.col("path")).alias("module")), f"SELECT path, {sql_module()} AS module FROM p", "p")
query("risk_module_of", lambda v, s, d: v("p").select(paths.base_of(F.col("path")).alias("base"), "path").select("path", "base", paths.risk_module_of(F.col("base")).alias("at_root"), paths.risk_module_of(F.col("path")).alias("module")),
      f"SELECT path, {SQL_BASE} AS base, CAST(NULL AS VARCHAR) AS at_root, array_to_string(list_slice(string_split({sql_dir()}, '/'), 1, 2), '/') AS module FROM p", "p")
query("sample_stratum", lambda v, s, d: v("p").groupBy(paths.sample_stratum(F.col("path")).alias("stratum")).agg(F.count("*").alias("n")),
      f"SELECT array_to_string(list_slice(string_split({sql_dir()}, '/'), 1, 3), '/') AS stratum, COUNT(*) AS n FROM p GROUP BY 1", "p")
query("detect_lang", lambda v, s, d: v("p").select("path", paths.detect_lang(F.col("path")).alias("lang")),
      "SELECT path, CASE regexp_extract(path, '[.]([^./]*)$', 1) WHEN 'go' THEN 'c' WHEN 'ts' THEN 'c' WHEN 'java' THEN 'c' WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' ELSE 'unknown' END AS lang FROM p", "p")
query("is_test_file", lambda v, s, d: v("p").select("path", paths.is_test_file(F.col("path")).alias("is_test")), f"SELECT path, {SQL_IS_TEST} AS is_test FROM p", "p")
query("exclude_files", lambda v, s, d: clean.exclude_files(v("p").select("path"), ["*1_test*", "services/b1*/core/*", "f2?.py"]),
      "SELECT path FROM p WHERE NOT (regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^[^/]*1_test[^/]*$') OR regexp_matches(path, '^services/b1[^/]*/core/[^/]*$') OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^f2[^/][.]py$'))", "p")
query("blame_ext_filter", lambda v, s, d: v("p").where(paths.has_extension(F.col("path"), ["*.go", "*.py", "/hooks/"])).select("path"),
      "SELECT path FROM p WHERE path LIKE '%.go' OR path LIKE '%.py' OR path LIKE '%/hooks/%'", "p")
query("size_filter", lambda v, s, d: v("files").where(F.col("size_bytes").isNull() | (F.col("size_bytes") <= fixture_config(s, d).max_file_bytes)),
      "SELECT repo, path, size_bytes FROM files WHERE size_bytes IS NULL OR size_bytes <= 5242880", "files")
query("period_label",
      lambda v, s, d: v("c").select("commit_id", *(period_label(F.col("committed_at"), x).alias(f"p_{x}") for x in ("1w", "1m", "3m", "6m", "1y"))),
      "SELECT commit_id, CONCAT(year(committed_at), '-W', lpad(CAST(weekofyear(committed_at) AS VARCHAR), 2, '0')) AS p_1w, strftime(committed_at, '%Y-%m') AS p_1m, "
      "CONCAT(year(committed_at), '-Q', quarter(committed_at), ' (', strftime(committed_at, '%b'), ')') AS p_3m, CONCAT(year(committed_at), '-H', CASE WHEN month(committed_at) <= 6 THEN '1' ELSE '2' END) AS p_6m, CAST(year(committed_at) AS VARCHAR) AS p_1y FROM c", "c")
query("name_normalize", lambda v, s, d: v("c").select(paths.norm_name(F.concat(F.lit("  "), F.upper("author"), F.lit(" "))).alias("name")).groupBy("name").agg(F.count("*").alias("n")),
      "SELECT lower(trim(CONCAT('  ', upper(author), ' '))) AS name, COUNT(*) AS n FROM c GROUP BY 1", "c")

# --- cleaning ------------------------------------------------------------------------------------------------------

query("alias_resolve", lambda v, s, d: clean.resolve_authors(v("c"), s.createDataFrame([("dev6", "dev4"), ("dev4", "dev0")], "alias string, canonical string")).groupBy("author").agg(F.count("*").alias("n")),
      "SELECT CASE author WHEN 'dev6' THEN 'dev4' WHEN 'dev4' THEN 'dev0' ELSE author END AS author, COUNT(*) AS n FROM c GROUP BY 1", "c")
query("exclude_authors", lambda v, s, d: clean.exclude_authors(v("c"), s.createDataFrame([("dev7",)], "author string")).groupBy("author").agg(F.count("*").alias("n")),
      "SELECT author, COUNT(*) AS n FROM c WHERE author <> 'dev7' GROUP BY author", "c")
query("exclude_repos", lambda v, s, d: clean.exclude_repos(v("c"), s.createDataFrame([("repo3",)], "repo string")).groupBy("repo").agg(F.count("*").alias("n")),
      "SELECT repo, COUNT(*) AS n FROM c WHERE repo <> 'repo3' GROUP BY repo", "c")
query("dedupe_repos",
      lambda v, s, d: clean.dedupe_repos(v("c").select("repo", F.concat(F.lit("/src/"), F.when(F.col("repo") == "repo3", "repo1").otherwise(F.col("repo"))).alias("real_path"), F.col("commit_id").alias("ordinal"))),
      "SELECT repo, real_path, ordinal FROM (SELECT repo, CONCAT('/src/', CASE WHEN repo = 'repo3' THEN 'repo1' ELSE repo END) AS real_path, commit_id AS ordinal FROM c) QUALIFY row_number() OVER (PARTITION BY real_path ORDER BY ordinal, repo) = 1", "c")
query("touch_modules", lambda v, s, d: axes.commit_modules(v("fc")), f"SELECT DISTINCT repo, commit_id, {sql_module()} AS module FROM fc", "fc")

FALLEN = "fallen AS (SELECT DISTINCT r.repo, r.reverted_id AS commit_id FROM reverts r WHERE NOT EXISTS (SELECT 1 FROM reverts x WHERE x.repo = r.repo AND x.reverted_id = r.revert_id AND NOT EXISTS (SELECT 1 FROM reverts y WHERE y.repo = x.repo AND y.reverted_id = x.revert_id)))"
query("effectively_reverted", lambda v, s, d: clean.effectively_reverted(v("reverts")), "SELECT repo, commit_id FROM fallen", "reverts", FALLEN)
# Every merge as if it were reverted. In the fixture a commit is at most 12 ids above its parents, and the one before it in
# its repository is always a parent: from 400 ids below a merge on, both of its sides reach all.
query("revert_branch_expand", lambda v, s, d: clean.merge_branches(v("c").where("is_merge"), v("commit_parents").withColumn("parent_order", F.col("parent_id"))).groupBy("repo", "root").agg(F.count("*").alias("commits"), F.min("commit_id").alias("oldest"), F.sum("commit_id").alias("ids")),
      "SELECT repo, root, COUNT(*) AS commits, MIN(commit_id) AS oldest, CAST(SUM(commit_id) AS BIGINT) AS ids FROM (WITH RECURSIVE walk AS (SELECT repo, commit_id AS root, commit_id AS x, FALSE AS main FROM c WHERE is_merge UNION SELECT repo, commit_id, parent_id, TRUE FROM commit_parents WHERE pos = 1 AND EXISTS (SELECT 1 FROM c WHERE c.is_merge AND c.repo = commit_parents.repo AND c.commit_id = commit_parents.commit_id) "
      "UNION SELECT w.repo, w.root, p.parent_id, w.main FROM walk w JOIN commit_parents p ON p.repo = w.repo AND p.commit_id = w.x WHERE p.parent_id >= w.root - 400) SELECT repo, root, x AS commit_id FROM walk GROUP BY ALL HAVING NOT bool_or(main)) GROUP BY repo, root", "c commit_parents")
query("revert_exclude", lambda v, s, d: clean.exclude_reverted(v("c"), clean.effectively_reverted(v("reverts"))).groupBy("repo", "is_merge").agg(F.count("*").alias("n"), F.sum("commit_id").alias("ids")),
      "SELECT repo, is_merge, COUNT(*) AS n, CAST(SUM(commit_id) AS BIGINT) AS ids FROM c WHERE NOT EXISTS (SELECT 1 FROM fallen f WHERE f.repo = c.repo AND f.commit_id = c.commit_id) GROUP BY repo, is_merge", "c reverts", FALLEN)


query("domain_by_pattern", lambda v, s, d: clean.configured_domain(v("c"), s.createDataFrame([("Web", "repo[12]"), ("Core", "repo?"), ("Data", "other*"), ("Apps", "repo2")], "domain string, repo_pattern string")),
      "SELECT DISTINCT repo, CASE WHEN repo = 'repo2' THEN 'Apps' ELSE 'Core' END AS domain FROM c", "c")
query("domain_filter", lambda v, s, d: v("c").withColumn("domain", paths.normalize_domain(F.when(F.col("repo") == "repo0", "backend").when(F.col("repo") == "repo1", "").otherwise("mobile"))).where("domain = 'BE'").groupBy("domain", "repo").agg(F.count("*").alias("n")),
      "SELECT 'BE' AS domain, repo, COUNT(*) AS n FROM c WHERE repo = 'repo0' GROUP BY repo", "c")
query("alias_merge",
      lambda v, s, d: clean.merge_aliases(
          v("c").select(F.upper("author").alias("alias"), F.concat(F.lit("Own "), "author").alias("canonical")).distinct(),
          v("c").where("author < 'dev4'").select("author", F.concat(F.lit("Ext "), "repo")).distinct().toDF("alias", "canonical")),
      "SELECT alias, canonical FROM (SELECT alias, canonical, row_number() OVER (PARTITION BY alias ORDER BY p, canonical) AS n FROM (SELECT DISTINCT author AS alias, CONCAT('Own ', author) AS canonical, 0 AS p FROM c "
      "UNION ALL SELECT DISTINCT author, CONCAT('Ext ', repo), 1 FROM c WHERE author < 'dev4' UNION ALL SELECT DISTINCT CONCAT('own ', author), CONCAT('Own ', author), 2 FROM c UNION ALL SELECT DISTINCT CONCAT('ext ', repo), CONCAT('Ext ', repo), 2 FROM c WHERE author < 'dev4')) WHERE n = 1", "c")
query("alias_fuzzy",
      lambda v, s, d: clean.fuzzy_aliases(
          v("c").select(F.concat(F.initcap("author"), F.lit(" Of "), F.initcap("repo")).alias("name")).distinct(),
          v("c").select("author", "repo").distinct().select(F.when(F.col("repo") == "repo0", F.concat("author", F.lit(" of "), "repo")).when(F.col("repo") == "repo1", F.concat("repo", F.lit(" "), "author")).otherwise(F.col("author")).alias("member"), F.xxhash64("author").alias("ordinal")).distinct()),
      "SELECT DISTINCT CONCAT(upper(author[1]), author[2:], ' Of ', upper(repo[1]), repo[2:]) AS name, CASE WHEN repo = 'repo0' THEN CONCAT(author, ' of ', repo) WHEN repo = 'repo1' THEN CONCAT(repo, ' ', author) ELSE CONCAT(upper(author[1]), author[2:], ' Of ', upper(repo[1]), repo[2:]) END AS canonical, "
      "CASE WHEN repo = 'repo0' THEN 'exact' WHEN repo = 'repo1' THEN 'words' ELSE 'none' END AS how FROM c", "c")
