"""Per-author axes from commits, file changes, line attribution and files.

Group keys come as `by` (columns besides author), so one plan serves repositories, domains and periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Config
from strata.functions.paths import dir_of, is_architecture, is_fix, is_test_file, matches_any, module_of, risk_module_of, test_siblings


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, at least 0."""
    return F.greatest((F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6, F.lit(0.0))


def as_of_column(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of if isinstance(as_of, datetime) else str(as_of)).cast("timestamp")


def line_groups(blame: DataFrame) -> DataFrame:
    """Equal lines (of one file, author and time) as one row with their number in `lines`; the operators below take
    blame in either form."""
    return blame.groupBy("repo", "path", "author", "committed_at").agg(F.count("*").alias("lines"))


def lines_of(blame: DataFrame) -> Column:
    """How many lines a row of blame stands for."""
    return F.col("lines") if "lines" in blame.columns else F.lit(1).cast("long")


# --- from the log ------------------------------------------------------------------------------------------------


def lines_changed(changes: DataFrame, patterns=(), by=()) -> DataFrame:
    """changes(.., author, path, insertions, deletions) -> sums over files that no pattern excludes."""
    kept = changes.where(~matches_any(F.col("path"), patterns)) if patterns else changes
    return kept.groupBy(*by, "author").agg(
        F.sum("insertions").alias("lines_added"),
        F.sum("deletions").alias("lines_deleted"),
        F.sum(F.col("insertions") + F.col("deletions")).alias("production"),
    )


def author_activity(commits: DataFrame, by=(), merges_in_dates: bool = True) -> DataFrame:
    """Non-merge commits, first and last date (of merges too, by default)."""
    own = ~F.col("is_merge")
    at = F.col("committed_at") if merges_in_dates else F.when(own, F.col("committed_at"))
    return commits.groupBy(*by, "author").agg(F.count_if(own).alias("commits"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def production_rate(total: Column, first: Column, last: Column) -> Column:
    """Lines a day over the span from the first to the last commit (a day at least)."""
    return total / F.greatest(days_between(last, first), F.lit(1.0))


def quality(commits: DataFrame, by=()) -> DataFrame:
    """100 - 100 * fixes / commits; merges count as fixes but not as commits; without commits 100."""
    fix = is_fix(F.col("subject"))
    out = commits.groupBy(*by, "author").agg(F.count_if(fix).alias("fixes"), F.count_if(~F.col("is_merge")).alias("total"))
    return out.withColumn("quality", F.when(F.col("total") == 0, 100.0).otherwise(100 - F.col("fixes") / F.col("total") * 100))


def mean_over(df: DataFrame, value: str, by=()) -> DataFrame:
    """A plain mean over the repositories in which an author appears."""
    return df.groupBy(*by, "author").agg(F.avg(value).alias(value))


def design(changes: DataFrame, patterns, by=()) -> DataFrame:
    """Lines changed in architecture files; authors without any are left out."""
    own = changes.where(is_architecture(F.col("path"), patterns))
    out = own.groupBy(*by, "author").agg(F.sum(F.col("insertions") + F.col("deletions")).alias("design"))
    return out.where("design > 0")


def author_unit_commits(changes: DataFrame, by=()) -> DataFrame:
    """Distinct commits for each author and module."""
    return changes.groupBy(*by, "author", module_of(F.col("path")).alias("module")).agg(F.countDistinct("repo", "commit_id").alias("commits"))


def breadth(units: DataFrame, min_commits: int, by=()) -> DataFrame:
    """units(.., author, commits): units with at least min_commits; authors without one are left out."""
    out = units.groupBy(*by, "author").agg(F.count_if(F.col("commits") >= min_commits).alias("breadth"))
    return out.where("breadth > 0")


# --- from line attribution ---------------------------------------------------------------------------------------


def commit_modules(changes: DataFrame) -> DataFrame:
    return changes.select("repo", "commit_id", module_of(F.col("path")).alias("module")).distinct()


def change_pressure(modules: DataFrame, blame: DataFrame, by=()) -> DataFrame:
    """Commits that touch a module over its surviving lines; without lines the commits, without commits 0. blame holds
    rows of files, or of modules already."""
    touched = modules.groupBy(*by, "repo", "module").agg(F.count("*").alias("commits"))
    if "module" in blame.columns:
        lines = blame.groupBy(*by, "repo", "module").agg(F.sum(lines_of(blame)).alias("lines"))
    else:
        files = blame.groupBy(*by, "repo", "path").agg(F.sum(lines_of(blame)).alias("lines"))
        lines = files.groupBy(*by, "repo", module_of(F.col("path")).alias("module")).agg(F.sum("lines").alias("lines"))
    both = touched.join(lines, [*by, "repo", "module"], "full")
    commits, n = F.coalesce("commits", F.lit(0)), F.coalesce("lines", F.lit(0))
    return both.select(*by, "repo", "module", F.when(n > 0, commits / n).otherwise(commits.cast("double")).alias("pressure"))


def median_pressure(pressure: DataFrame, by=("repo",)) -> DataFrame:
    return pressure.groupBy(*by).agg(F.percentile("pressure", F.lit(0.5)).alias("median"))


def pressure_threshold(blame: DataFrame, pressure: DataFrame, min_lines: int, min_share: float = 0.10, by=()) -> DataFrame:
    """The median pressure of a repository, or infinity where fewer than two authors own min_share and min_lines."""
    unit = [*by, "repo"]
    lines = blame.groupBy(*unit, "author").agg(F.sum(lines_of(blame)).alias("lines"))
    share = F.col("lines") / F.sum("lines").over(Window.partitionBy(*unit))
    large = lines.withColumn("large", (F.col("lines") >= min_lines) & (share >= min_share))
    authors = large.groupBy(*unit).agg(F.count_if("large").alias("substantial"))
    joined = authors.join(median_pressure(pressure, unit), unit, "left")
    return joined.select(
        *unit, "substantial", F.when(F.col("substantial") >= 2, F.coalesce("median", F.lit(0.0))).otherwise(float("inf")).alias("threshold")
    )


def file_tested(files: DataFrame) -> DataFrame:
    """files(repo, path) -> (repo, path, module, is_test, is_tested): a test, a file with a sibling test, or one whose
    directory holds a test."""
    rows = files.select("repo", "path", module_of(F.col("path")).alias("module"), dir_of(F.col("path")).alias("dir"), is_test_file(F.col("path")).alias("is_test"))
    tests = rows.where("is_test").select("repo", F.col("path").alias("candidate"))
    siblings = rows.where("not is_test").select("repo", "path", F.explode(test_siblings(F.col("path"))).alias("candidate"))
    found = siblings.join(tests, ["repo", "candidate"], "left_semi").select("repo", "path").distinct().withColumn("sibling", F.lit(True))
    # Directories with a test are few and join as a set: a window would gather the largest directory in one task.
    dirs = rows.where("is_test").select("repo", "dir").distinct().withColumn("beside", F.lit(True))
    out = rows.join(found, ["repo", "path"], "left").join(dirs, ["repo", "dir"], "left")
    return out.select(
        "repo", "path", "module", "is_test", (F.col("is_test") | F.coalesce("sibling", F.lit(False)) | F.coalesce("beside", F.lit(False))).alias("is_tested")
    )


def sibling_tested(files: DataFrame) -> DataFrame:
    tests = files.where(is_test_file(F.col("path"))).select("repo", F.col("path").alias("candidate"))
    own = files.where(~is_test_file(F.col("path"))).select("repo", "path", F.explode(test_siblings(F.col("path"))).alias("candidate"))
    return own.join(tests, ["repo", "candidate"], "left_semi").select("repo", "path").distinct()


def test_coverage(tested: DataFrame, domain: str) -> DataFrame:
    """Files and tests for the domain (module null) and each module."""
    rows = tested.withColumn("domain", F.lit(domain))
    out = rows.groupingSets([["domain"], ["domain", "module"]], "domain", "module").agg(F.count("*").alias("files"), F.count_if("is_test").alias("tests"))
    return out.withColumn("ratio", F.col("tests") / F.col("files"))


def enrich_blame(blame: DataFrame, pressure: DataFrame, tested: DataFrame) -> DataFrame:
    """Lines with their module's pressure (0 if unknown) and whether their file is tested (no if unknown).

    Both are looked up once a file; the lines then meet their file's values in one join."""
    files = blame.select("repo", "path").distinct().withColumn("module", module_of(F.col("path")))
    files = files.join(pressure.select("repo", "module", "pressure"), ["repo", "module"], "left")
    files = files.join(tested.select("repo", "path", "is_tested"), ["repo", "path"], "left")
    files = files.withColumns({"pressure": F.coalesce("pressure", F.lit(0.0)), "is_tested": F.coalesce("is_tested", F.lit(False))})
    return blame.join(files.select("repo", "path", "module", "pressure", "is_tested"), ["repo", "path"])


def survival(lines: DataFrame, as_of, cfg: Config, by=(), alpha: float | None = None, split: bool = True) -> DataFrame:
    """lines(.., author, committed_at, is_tested, pressure, threshold) -> decayed survival and its parts, in one pass.

    Without split pressure is ignored (robust and dormant null); alpha weighs untested lines (1: all equal). Rows of
    snapshot_sums carry their weight as `decayed` instead of committed_at."""
    alpha = cfg.untested_weight if alpha is None else alpha
    if "decayed" in lines.columns:
        w = F.col("decayed")
    else:
        w = F.exp(-days_between(as_of_column(as_of), F.col("committed_at")) / cfg.tau) * lines_of(lines)
    tested = F.col("is_tested")
    weighed = w * F.when(tested, 1.0).otherwise(float(alpha))
    parts = [
        F.sum(lines_of(lines)).alias("raw_survival"),
        F.sum(weighed).alias("survival"),
        F.sum(F.when(tested, w).otherwise(0.0)).alias("tested_survival"),
        F.sum(F.when(tested, 0.0).otherwise(w)).alias("untested_survival"),
    ]
    if split:
        high = F.col("pressure") >= F.col("threshold")
        parts += [F.sum(F.when(high, weighed).otherwise(0.0)).alias("robust_survival"), F.sum(F.when(high, 0.0).otherwise(weighed)).alias("dormant_survival")]
    return lines.groupBy(*by, "author").agg(*parts)


def module_survival(blame: DataFrame, as_of, tau: float, by=("repo",)) -> DataFrame:
    w = F.exp(-days_between(as_of_column(as_of), F.col("committed_at")) / tau)
    return blame.groupBy(*by, module_of(F.col("path")).alias("module")).agg(F.avg(w).alias("survival"))


def merge_module_survival(per_repo: DataFrame) -> DataFrame:
    """The order-dependent merge over repositories: from the second on, the mean of what there was and the new value."""
    ordered = per_repo.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("repo", "survival"))).alias("s"))
    fold = F.aggregate(
        F.slice("s", F.lit(2), F.size("s")), F.col("s")[0]["survival"], lambda a, x: (a + x["survival"]) / 2
    )
    return ordered.select("module", fold.alias("survival"))


def owners(blame: DataFrame, module: Column, by=("repo",)) -> DataFrame:
    """(.., module, author, n, total, share, rank): authors' lines in a module, most first, ties by name."""
    rows = blame.select(*by, module.alias("module"), "author", lines_of(blame).alias("n")).where(F.col("module").isNotNull())
    n = rows.groupBy(*by, "module", "author").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "module")
    return (
        n.withColumn("total", F.sum("n").over(w))
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "author")))
    )


def bus_factor(blame: DataFrame, cfg: Config) -> DataFrame:
    """Modules whose largest author owns a critical or high share; files at the root belong to no module."""
    top = owners(blame, risk_module_of(F.col("path"))).where("rank = 1")
    level = F.when(F.col("share") >= cfg.critical, "CRITICAL").when(F.col("share") >= cfg.high, "HIGH")
    return top.select("repo", "module", "author", "share", level.alias("level")).where("level is not null")


def indispensability(risks: DataFrame, by=()) -> DataFrame:
    return risks.groupBy(*by, "author").agg(F.sum(F.when(F.col("level") == "CRITICAL", 1.0).otherwise(0.5)).alias("indispensability"))


def ownership(blame: DataFrame, by=("repo",)) -> DataFrame:
    """Lines, authors, top author and share, Shannon entropy in bits, and a level, for each module."""
    out = owners(blame, module_of(F.col("path")), by).groupBy(*by, "module").agg(
        F.sum("n").alias("lines"),
        F.count("*").alias("authors"),
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("top_author"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top_share"),
        F.greatest(-F.sum(F.col("share") * F.log2("share")), F.lit(0.0)).alias("entropy"),
    )
    level = (
        F.when(F.col("authors") == 1, "SOLE_OWNER")
        .when(F.col("top_share") >= 0.8, "CONCENTRATED")
        .when(F.col("top_share") >= 0.4, "HEALTHY")
        .otherwise("FRAGMENTED")
    )
    return out.withColumn("level", level)


def repo_domain(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """files(repo, path), extensions(extension, domain, priority) -> (repo, domain): the most frequent domain of its
    extensions; ties by priority and name; Infra only where a .tf or .hcl exists; Unknown without a hit."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.select("repo", ext.alias("extension")).groupBy("repo", "extension").agg(F.count("*").alias("n"))
    repos = rows.groupBy("repo").agg(F.max(F.col("extension").isin(".tf", ".hcl")).alias("terraform"))
    n = rows.join(extensions, "extension").groupBy("repo", "domain").agg(F.sum("n").alias("n"), F.min("priority").alias("priority"))
    n = n.join(repos, "repo").where((F.col("domain") != "Infra") | F.col("terraform"))
    best = n.groupBy("repo").agg(F.min_by("domain", F.struct((-F.col("n")).alias("n"), "priority", "domain")).alias("domain"))
    return repos.select("repo").join(best, "repo", "left").select("repo", F.coalesce("domain", F.lit("Unknown")).alias("domain"))


# --- debt ---------------------------------------------------------------------------------------------------------


def fix_sample(commits: DataFrame, n: int = 50, by=("repo",)) -> DataFrame:
    """The n newest fix commits of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("committed_at"), F.desc("commit_id"))
    return commits.where(is_fix(F.col("subject")) & ~F.col("is_merge")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


_ENDLESS = "9999-12-31 00:00:00"
#: Fixes of a file that each of its lines may meet one by one; beyond, fixes are counted.
FEW_FIXES = 64


def debt_events(fix_files: DataFrame, blame: DataFrame, by=(), few: int = FEW_FIXES, keep=None) -> DataFrame:
    """fix_files(.., repo, path, commit_id, fixer, fix_at), blame -> (.., repo, fixer, original, lines): lines of others
    that stood in a fixed file before the fix, born before it and, where blame has died_at, not dead before it.

    Lines of files with up to `few` fixes meet those; of a file with more they meet counts of fixes, see _counted_debt.
    keep: how to stage the fixes, so that where no file has more the lines are not dealt out for that."""
    file = ["repo", "path"]
    end = F.coalesce("died_at", F.lit(_ENDLESS).cast("timestamp")) if "died_at" in blame.columns else F.lit(_ENDLESS).cast("timestamp")
    keys = [*file, F.col("author").alias("original"), F.col("committed_at").alias("born"), end.alias("died")]
    lines = blame.where(F.col("author") != "")
    if "lines" in blame.columns and "died_at" not in blame.columns:
        lines = lines.select(*keys, F.col("lines").alias("n"))  # grouped already
    else:
        lines = lines.groupBy(*keys).agg(F.sum(lines_of(blame)).alias("n"))
    fixes = fix_files.select(*file, *by, "fixer", F.col("fix_at").alias("at"))
    fixes = (keep or (lambda df: df))(fixes.join(fixes.groupBy(*file).agg(F.count("*").alias("of_file")), file))
    met = fixes.where(F.col("of_file") <= few).join(lines, file).where((F.col("born") < F.col("at")) & (F.col("at") <= F.col("died")) & (F.col("original") != F.col("fixer")))
    met = met.groupBy(*by, "repo", "fixer", "original").agg(F.sum("n").alias("lines"))
    if keep and fixes.where(F.col("of_file") > few).isEmpty():
        return met
    counted = _counted_debt(fixes.where(F.col("of_file") > few), lines, by)
    return met.unionByName(counted).groupBy(*by, "repo", "fixer", "original").agg(F.sum("lines").alias("lines"))


def _counted_debt(fixes: DataFrame, lines: DataFrame, by=()) -> DataFrame:
    """debt_events() of files with very many fixes: a line counts once for each fix between its birth and its death, so
    it needs two counts of fixes, as of both times. A file's lines meet its fixers and never its fixes; the counts run
    over time within a day, from what the days before add up to, so that such a file is no single group."""
    file, key = ["repo", "path"], ["repo", "path", *by, "fixer"]
    times = F.array(F.struct(F.col("born").alias("at"), (-F.col("n")).alias("n")), F.struct(F.col("died").alias("at"), F.col("n").alias("n")))
    ends = lines.select(*file, "original", F.explode(times).alias("e")).select(*file, "original", "e.at", "e.n")
    fixes = fixes.groupBy(*key, "at").agg(F.count("*").alias("fixes"))
    marks = ends.join(fixes.select(*key).distinct(), file).where(F.col("original") != F.col("fixer"))
    marks = marks.groupBy(*key, "original", "at").agg(F.sum("n").alias("n")).withColumn("fixes", F.lit(0).cast("long"))
    rows = marks.unionByName(fixes.withColumns({"original": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})).withColumn("day", F.to_date("at"))
    days = rows.groupBy(*key, "day").agg(F.sum("fixes").alias("fixes"))
    earlier = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*key, "day", F.coalesce(F.sum("fixes").over(earlier), F.lit(0)).alias("before"))
    so_far = F.sum("fixes").over(Window.partitionBy(*key, "day").orderBy("at"))  # with those at the same time
    counted = rows.withColumn("so_far", so_far).where("n <> 0").join(days, [*key, "day"])
    out = counted.groupBy(*by, "repo", "fixer", "original").agg(F.sum(F.col("n") * (F.col("before") + F.col("so_far"))).alias("lines"))
    return out.where("lines > 0")


def debt_score(events: DataFrame, threshold: int, by=("repo",)) -> DataFrame:
    """Cleaned against generated lines: 50 below the threshold, else 50 + 50 * (c - g) / (c + g)."""
    cleaned = events.select(*by, F.col("fixer").alias("author"), F.col("lines").alias("cleaned"), F.lit(0).alias("generated"))
    made = events.select(*by, F.col("original").alias("author"), F.lit(0).alias("cleaned"), F.col("lines").alias("generated"))
    out = cleaned.union(made).groupBy(*by, "author").agg(F.sum("cleaned").alias("cleaned"), F.sum("generated").alias("generated"))
    c, g = F.col("cleaned"), F.col("generated")
    score = F.when(c + g < threshold, 50.0).otherwise(F.greatest(F.least(50 + 50 * (c - g) / (c + g), F.lit(100.0)), F.lit(0.0)))
    return out.withColumn("debt_cleanup", score)
