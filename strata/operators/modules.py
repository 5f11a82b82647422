"""Co-change coupling and module scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.soft import clamp, highness, lowness, pick_best
from strata.operators.axes import days_between
from strata.operators.clean import materialize
from strata.operators.ranks import placed


def module_commit_counts(modules: DataFrame, by=("repo",)) -> DataFrame:
    return modules.groupBy(*by, "module").agg(F.countDistinct("repo", "commit_id").alias("commits"))


def cochange(modules: DataFrame, max_modules: int | None = None) -> DataFrame:
    """Pairs of modules that change together, with their Jaccard coupling. Pairs arise from the commit's own row;
    max_modules (off by default) leaves out larger commits."""
    sets = modules.groupBy("repo", "commit_id").agg(F.array_sort(F.collect_set("module")).alias("m"))
    if max_modules:
        sets = sets.where(F.size("m") <= max_modules)
    # First a row a module with its place, then a row a later module: no cell holds more than a commit's modules.
    firsts = sets.select("repo", "m", F.posexplode("m").alias("i", "module_a"))
    pairs = firsts.select("repo", "module_a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("module_b"))
    both = pairs.groupBy("repo", "module_a", "module_b").agg(F.count("*").alias("together"))
    n = module_commit_counts(modules)
    out = both.join(n.select("repo", F.col("module").alias("module_a"), F.col("commits").alias("na")), ["repo", "module_a"])
    out = out.join(n.select("repo", F.col("module").alias("module_b"), F.col("commits").alias("nb")), ["repo", "module_b"])
    return out.select("repo", "module_a", "module_b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("coupling"))


#: Pairs for each module of a commit that coupled_pairs() makes outright; commits too wide for that are narrowed first.
_PAIRS_A_ROW = 16


def _pair_counts(sets: DataFrame) -> DataFrame:
    """sets(repo, commit_id, m: sorted modules) -> the commits of each pair, summed up within tasks first."""
    firsts = sets.select("repo", "m", F.posexplode("m").alias("i", "module_a"))
    pairs = firsts.select("repo", "module_a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("module_b"))
    return pairs.groupBy("repo", "module_a", "module_b").agg(F.count("*").alias("together"))


def coupled_pairs(modules: DataFrame, min_together: int = 5, min_coupling: float = 0.10) -> DataFrame:
    """The rows of cochange() with min_together commits and min_coupling, without making all the others.

    Pairs of narrow commits are counted outright, as far as they are at most _PAIRS_A_ROW times the commits' modules; so
    what is shuffled is a row a pair and task. What wide commits add is counted by _wide_counts()."""
    sets = materialize(modules.groupBy("repo", "commit_id").agg(F.array_sort(F.collect_set("module")).alias("m")))
    n = materialize(sets.select("repo", F.explode("m").alias("module")).groupBy("repo", "module").agg(F.count("*").alias("commits")).where(F.col("commits") >= min_together))
    widths = sorted((r.width, r.n) for r in sets.groupBy(F.size("m").alias("width")).agg(F.count("*").alias("n")).collect())  # at most sqrt(2 * rows)
    left, narrow = _PAIRS_A_ROW * sum(w * k for w, k in widths), 0
    for w, k in widths:
        left -= k * w * (w - 1) // 2
        if left < 0:
            break
        narrow = w
    both = _pair_counts(sets.where(F.size("m") <= narrow))
    if widths and widths[-1][0] > narrow:
        both = materialize(both)
        wide = _wide_counts(sets.where(F.size("m") > narrow), n, both, min_together, min_coupling)
        both = both.union(wide).groupBy("repo", "module_a", "module_b").agg(F.sum("together").alias("together"))
    out = _with_commits(both, n)
    out = out.select("repo", "module_a", "module_b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("coupling"))
    return out.where((F.col("together") >= min_together) & (F.col("coupling") >= min_coupling))


def _with_commits(pairs: DataFrame, n: DataFrame, a: str = "na", b: str = "nb") -> DataFrame:
    """pairs with the commits of both modules; those without a row in n go."""
    pairs = pairs.join(n.select("repo", F.col("module").alias("module_a"), F.col("commits").alias(a)), ["repo", "module_a"])
    return pairs.join(n.select("repo", F.col("module").alias("module_b"), F.col("commits").alias(b)), ["repo", "module_b"])


def _wide_counts(sets: DataFrame, n: DataFrame, narrow: DataFrame, min_together: int, min_coupling: float) -> DataFrame:
    """Commits of wide sets for all pairs that may be coupled, given the counts of the narrow ones.

    A coupled pair shares at least o = max(min_together, min_coupling * n) commits of a module with n. If it shares no
    narrow one, the two still meet when each leaves out its o - 1 widest commits: these, which make most pairs, are left
    out first, whole widths at a time. Modules of too few commits go before that, pairs of too unlike sizes when they
    arise. The pairs found are looked up in the smaller module's commits, or, where that takes more rows than all pairs
    of these commits, those are counted outright."""
    rows = materialize(sets.select("repo", "commit_id", F.explode("m").alias("module")).join(n, ["repo", "module"]))
    widths = rows.groupBy("repo", "commit_id").agg(F.count("*").alias("width"))
    of_width = rows.join(widths, ["repo", "commit_id"])
    least = lambda commits: F.greatest(F.lit(min_together), F.ceil(F.lit(min_coupling) * commits - 1e-9))
    steps = of_width.groupBy("repo", "module", "width").agg(F.count("*").alias("k"), F.first("commits").alias("commits"))
    wider = F.sum("k").over(Window.partitionBy("repo", "module").orderBy(F.desc("width")))  # a row a width, not a commit
    kept = steps.withColumn("wider", wider).where(F.col("wider") > least(F.col("commits")) - 1).select("repo", "module", "width")
    short = of_width.join(kept, ["repo", "module", "width"])
    found = _pair_counts(short.groupBy("repo", "commit_id").agg(F.array_sort(F.collect_list("module")).alias("m"))).withColumn("together", F.lit(0).cast("long"))
    found = found.union(narrow).groupBy("repo", "module_a", "module_b").agg(F.max("together").alias("narrow"))
    found = _with_commits(found, n)
    found = _with_commits(found, rows.groupBy("repo", "module").agg(F.count("*").alias("commits")), "wide_a", "wide_b")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    found = found.where((small >= F.lit(min_coupling) * large - 1e-9) & (F.col("narrow") + F.least("wide_a", "wide_b") >= least(large)))
    found = materialize(found.select("repo", "module_a", "module_b", "wide_a", "wide_b"))
    all_pairs = widths.agg(F.sum(F.expr("width * (width - 1) div 2"))).first()[0] or 0
    if (found.agg(F.sum(F.least("wide_a", "wide_b"))).first()[0] or 0) >= all_pairs:
        return _pair_counts(rows.groupBy("repo", "commit_id").agg(F.array_sort(F.collect_list("module")).alias("m")))
    a_smaller = F.col("wide_a") <= F.col("wide_b")
    found = found.withColumns({"module": F.when(a_smaller, F.col("module_a")).otherwise(F.col("module_b")), "other": F.when(a_smaller, F.col("module_b")).otherwise(F.col("module_a"))})
    met = found.join(rows.select("repo", "module", "commit_id"), ["repo", "module"])
    met = met.join(rows.select("repo", "commit_id", F.col("module").alias("other")), ["repo", "commit_id", "other"], "left_semi")
    return met.groupBy("repo", "module_a", "module_b").agg(F.count("*").alias("together"))


def significant_pairs(pairs: DataFrame, min_together: int = 5, min_coupling: float = 0.10, k: int | None = None) -> DataFrame:
    out = pairs.where((F.col("together") >= min_together) & (F.col("coupling") >= min_coupling))
    out = out.orderBy(F.desc("coupling"), F.desc("together"), "repo", "module_a", "module_b")
    return out.limit(k) if k else out


def module_coupling(pairs: DataFrame, by=()) -> DataFrame:
    """Mean, largest and number of the couplings in which a module takes part."""
    ends = pairs.select(*by, F.explode(F.array("module_a", "module_b")).alias("module"), "coupling")
    return ends.groupBy(*by, "module").agg(F.avg("coupling").alias("avg_coupling"), F.max("coupling").alias("max_coupling"), F.count("*").alias("pairs"))


def percentile_rank(pressure: DataFrame, by=()) -> DataFrame:
    """i / (n - 1) by ascending pressure, ties by name; alone 0.5. Over modules, never over lines."""
    if by:
        w = Window.partitionBy(*by)
        rows = pressure.withColumns({"_total": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("pressure", "module"))})
    else:
        rows = placed(pressure, [F.col("pressure"), F.col("module")], "_i")
    rank = F.when(F.col("_total") == 1, 0.5).otherwise((F.col("_i") - 1) / (F.col("_total") - 1))
    return rows.withColumn("pressure_rank", rank).drop("_i", "_total")


def module_spine(*relations: DataFrame) -> DataFrame:
    """All modules that some relation names."""
    out = relations[0].select("module")
    for r in relations[1:]:
        out = out.union(r.select("module"))
    return out.distinct()


def module_indicators(pressure: DataFrame, survival: DataFrame, owned: DataFrame, commits: DataFrame, coupling: DataFrame) -> DataFrame:
    """One row a module: boundary, absorption, stability and knowledge indicators and their raw parts.

    owned holds a row for each repository; of a module in several, the last repository's counts."""
    last = Window.partitionBy("module").orderBy(F.desc("repo"))
    own = owned.withColumn("n", F.row_number().over(last)).where("n = 1").select("module", "top_author", "top_share", "entropy", "level")
    mean = percentile_rank(pressure.groupBy("module").agg(F.avg("pressure").alias("pressure")))
    total = commits.groupBy("module").agg(F.sum("commits").alias("commits"))
    out = module_spine(pressure, survival, owned, commits)
    for r in (mean, survival.select("module", "survival"), own, total, coupling):
        out = out.join(r, "module", "left")
    base = F.when(F.col("level") == "SOLE_OWNER", 80).when(F.col("level") == "CONCENTRATED", 50).when(F.col("level") == "HEALTHY", 25)
    base = base.when(F.col("level") == "FRAGMENTED", 10)
    return out.select(
        "module",
        "pressure",
        F.coalesce("commits", F.lit(0)).alias("commits"),
        F.coalesce("avg_coupling", F.lit(0.0)).alias("avg_coupling"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
        "top_author",
        "top_share",
        "entropy",
        "level",
        F.col("survival").isNotNull().alias("has_blame"),
        ((1 - F.coalesce("avg_coupling", F.lit(0.0))) * 100).alias("boundary"),
        (F.coalesce("survival", F.lit(0.0)) * 100).alias("absorption"),
        F.coalesce((1 - F.col("pressure_rank")) * 100, F.lit(100.0)).alias("stability"),
        F.coalesce(base + clamp((F.col("entropy") - 1.5) * 2.5, -5, 5), F.lit(0.0)).alias("knowledge"),
    )


def owner_active(modules: DataFrame, activity: DataFrame, as_of, active_days: float) -> DataFrame:
    """modules(.., top_author) with owner_known and owner_active by the owner's last commit."""
    last = activity.groupBy("author").agg(F.max("last_at").alias("owner_last"))
    out = modules.join(last, F.col("top_author") == F.col("author"), "left").drop("author")
    active = F.coalesce(days_between(as_of, F.col("owner_last")) <= active_days, F.lit(False))
    return out.withColumn("owner_known", F.col("owner_last").isNotNull()).withColumn("owner_active", active).drop("owner_last")


def fragile(c) -> object:
    """Confidence that a module merely looks stable: old lines, little change, hardly a test."""
    ok = c("has_blame") & c("test_ratio").isNotNull() & (c("commits") > 0)
    press, ratio = 100 - c("stability"), c("test_ratio")
    value = F.least(0.70 + 0.15 * (1 - ratio / 0.10) + 0.10 * (1 - press / 30), F.lit(0.95))
    return F.when(ok & (c("absorption") >= 30) & (press < 30) & (ratio < 0.10), value).otherwise(0.0)


def module_labels(m: DataFrame) -> DataFrame:
    """m(module_indicators columns, test_ratio, owner_known, owner_active) with coupling, vitality and ownership labels."""
    c = F.col
    a, press, absorb = c("avg_coupling") * 100, 100 - c("stability"), c("absorption")
    coupling = [
        ("Isolated", F.when(c("pairs") == 0, 0.95).otherwise(0.0)),
        ("Hub", F.when(c("pairs") > 0, highness(a)).otherwise(0.0)),
        ("Linked", F.when((c("pairs") > 0) & (a >= 15) & (a < 60), 0.50 + (a - 15) / 90).otherwise(0.0)),
        ("Independent", F.when(c("pairs") > 0, highness(c("boundary"))).otherwise(0.0)),
    ]
    f = fragile(c)
    vitality = [
        ("Dead", F.when((c("commits") == 0) & ~c("owner_active"), 0.95).otherwise(0.0)),
        ("Critical", F.when(c("has_blame") & (press >= 80) & (absorb < 20), F.least(F.lit(1.0), 0.85 + (press - 80) / 400 + (20 - absorb) / 400)).otherwise(0.0)),
        ("Turbulent", F.when(c("has_blame"), F.least(highness(press), lowness(absorb))).otherwise(0.0)),
        ("Warming", F.when(c("has_blame") & (press >= 30) & (press < 70) & (absorb < 50), 0.40 + (press - 30) / 100).otherwise(0.0)),
        ("Fragile", f),
        ("Stable", F.when(f > 0.10, 0.0).otherwise(highness(c("stability")))),
    ]
    held = 0.70 + c("top_share") * 0.25
    owned = [
        ("Orphaned", F.when(c("owner_known") & ~c("owner_active") & (c("top_share") >= 0.5), held).otherwise(0.0)),
        ("Concentrated", F.when(c("level") == "SOLE_OWNER", 0.95).when(c("level") == "CONCENTRATED", held).otherwise(0.0)),
        ("Distributed", F.when(c("level") == "HEALTHY", 0.80).when(c("level") == "FRAGMENTED", 0.60).otherwise(0.0)),
    ]
    return m.withColumns({"coupling": pick_best(coupling), "vitality": pick_best(vitality), "ownership": pick_best(owned)})


def module_anomalies(m: DataFrame, k: int = 30) -> DataFrame:
    odd = F.col("vitality.name").isin("Fragile", "Turbulent", "Critical", "Dead")
    return m.where((F.col("coupling.name") == "Hub") | odd | (F.col("ownership.name") == "Orphaned")).orderBy("stability", "module").limit(k)


def risky_ownership(owned: DataFrame, k: int = 15) -> DataFrame:
    return owned.where("level <> 'HEALTHY'").orderBy(F.desc("top_share"), "repo", "module").limit(k)


def label_counts(m: DataFrame) -> DataFrame:
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}.name").alias("label")) for a in ("coupling", "vitality", "ownership")))
    return m.select(F.explode(axes).alias("x")).groupBy("x.axis", "x.label").agg(F.count("*").alias("modules"))
