"""Periods as a column: windows, snapshots, dense author series and label transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.soft import NONE


def _with_windows(df: DataFrame, periods: DataFrame) -> DataFrame:
    """df with the windows of periods, in order, as the constant column _w. A table of periods comes from a span and an
    end, so it is as small as a settings table and is read like one."""
    rows = sorted(periods.select("end", "start", "label").collect())
    window = lambda r: F.struct(F.lit(r["end"]).alias("end"), F.lit(r["start"]).alias("start"), F.lit(r["label"]).alias("label"))
    kind = "array<struct<end: timestamp, start: timestamp, label: string>>"
    return df.withColumn("_w", F.array(*map(window, rows)).cast(kind))


def assign_periods(df: DataFrame, periods: DataFrame, at: str = "committed_at") -> DataFrame:
    """Rows in the half-open windows [start, end) of periods(label, start, end), with period and period_end."""
    inside = F.filter("_w", lambda w: (w["start"] <= F.col(at)) & (F.col(at) < w["end"]))
    rows = _with_windows(df, periods).withColumn("_w", F.explode(inside))
    return rows.withColumns({"period": F.col("_w.label"), "period_end": F.col("_w.end")}).drop("_w")


def boundary_commits(commits: DataFrame, periods: DataFrame) -> DataFrame:
    """(repo, period, commit_id): the latest commit at or before each window's end, ties by commit."""
    # Only a repository's last commit of each window can be a boundary; then carry the latest one forward.
    ends = F.transform("_w", lambda w: w["end"])
    due = _with_windows(commits, periods).withColumn("end", F.array_min(F.filter(ends, lambda e: F.col("committed_at") <= e)))
    best = due.where("end is not null").groupBy("repo", "end").agg(F.max(F.struct("committed_at", "commit_id")).alias("last"))
    p = _with_windows(commits.select("repo").distinct(), periods).withColumn("w", F.explode("_w"))
    rows = p.select("repo", F.col("w.label").alias("period"), F.col("w.end").alias("end")).join(best, ["repo", "end"], "left")
    carry = Window.partitionBy("repo").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("last", F.max("last").over(carry)).where("last is not null")
    return out.select("repo", "period", F.col("last.commit_id").alias("commit_id"))


def snapshot_sums(lives: DataFrame, periods: DataFrame, keys: dict[str, Column], tau: float) -> DataFrame:
    """lives(.., born_at, died_at) -> (period, period_end, *keys, lines, decayed): for each window's end the lines alive
    then (born at or before it, not dead by then) and the sum of exp(-age in days / tau) over them; no row for none.

    A sweep: a line adds to the first end after its birth and takes away at the first end after its death, and a key's
    values are running sums over the ends. The decay of a line is a factor of its birth times one of the end, so it sums
    up alike. No line meets the windows that it lives through; a key has at most a row for each of them."""
    same = lives.where(F.col("born_at").isNotNull()).groupBy(*(c.alias(k) for k, c in keys.items()), "born_at", "died_at").agg(F.count("*").alias("n"))
    rows = _with_windows(same, periods).withColumn("ends", F.transform("_w", lambda w: w["end"]))
    place = lambda t: F.size(F.filter("ends", lambda e: e < F.col(t)))  # noqa: E731 - the first end at or after t
    rows = rows.withColumns({"i": place("born_at"), "j": place("died_at"), "count": F.size("ends"), "last": F.element_at("ends", -1)})
    factor = F.exp((F.unix_micros("born_at") - F.unix_micros("last")) / F.lit(86400e6 * tau))
    # A line dead by the end that first sees it was never there: both steps fall on that end and cancel out.
    dies = F.when(F.col("died_at").isNotNull() & (F.col("j") < F.col("count")), F.greatest("i", "j"))
    steps = F.array(F.struct("i", "n", (factor * F.col("n")).alias("w")), F.struct(dies.alias("i"), (-F.col("n")).alias("n"), (-factor * F.col("n")).alias("w")))
    rows = rows.where(F.col("i") < F.col("count")).select(*keys, F.explode(steps).alias("s")).where("s.i is not null")
    steps = rows.groupBy(*keys, "s.i").agg(F.sum("s.n").alias("n"), F.sum("s.w").alias("w"))
    course = Window.partitionBy(*keys).orderBy("i")
    sums = steps.select(*keys, "i", F.sum("n").over(course).alias("lines"), F.sum("w").over(course).alias("w"), F.lead("i").over(course).alias("next"))
    rows = _with_windows(sums.where("lines > 0"), periods).withColumn("last", F.element_at("_w", -1)["end"])
    rows = rows.select(*keys, "lines", "w", "last", F.posexplode("_w").alias("k", "window"), "i", "next").where("k >= i and (next is null or k < next)")
    decayed = F.col("w") * F.exp((F.unix_micros("last") - F.unix_micros("window.end")) / F.lit(86400e6 * tau))
    return rows.select(F.col("window.label").alias("period"), F.col("window.end").alias("period_end"), *keys, "lines", decayed.alias("decayed"))


def densify(scored: DataFrame, periods: DataFrame, zero: tuple[str, ...]) -> DataFrame:
    """Every author in every period; absent ones get 0 in the columns named and null elsewhere."""
    p = periods.select(F.col("label").alias("period"), F.col("start").alias("period_start"))  # can come from the data
    rows = scored.select("author").distinct().crossJoin(p).join(scored, ["author", "period"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def transitions(timeline: DataFrame, key: str, axes: tuple[str, ...], order: str = "period_start") -> DataFrame:
    """timeline(key, period, order, <axis> label strings) -> (key, period, axis, before, after) of label changes between
    adjacent periods, where both labels are there and neither is the empty one."""
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("label")) for a in axes))
    rows = timeline.select(key, "period", order, F.explode(cells).alias("x")).select(key, "period", order, "x.axis", "x.label")
    rows = rows.withColumn("before", F.lag("label").over(Window.partitionBy(key, "axis").orderBy(order)))
    real = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", NONE)
    return rows.where(real("before") & real("label") & (F.col("before") != F.col("label"))).select(key, "period", "axis", "before", F.col("label").alias("after"))


def latest_impact_order(timeline: DataFrame, order: str = "period_start") -> DataFrame:
    """Authors by their last impact above 0."""
    last = timeline.groupBy("author").agg(F.max_by(F.when(F.col("impact") > 0, F.col("impact")), F.when(F.col("impact") > 0, F.col(order))).alias("latest"))
    return last.withColumn("latest", F.coalesce("latest", F.lit(0.0))).orderBy(F.desc("latest"), "author")


def period_top(timeline: DataFrame, k: int = 5, value: str = "gravity") -> DataFrame:
    order = Window.partitionBy("period").orderBy(F.desc(value), "author")
    return timeline.where(F.col(value) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def key_figures(timeline: DataFrame, k: int = 10, order: str = "period_start") -> DataFrame:
    """Authors that ever were among a period's k largest gravities: their peak and their course."""
    top = period_top(timeline, k).select("author").distinct()
    rows = timeline.join(top, "author", "left_semi")
    return rows.groupBy("author").agg(
        F.max("gravity").alias("peak"),
        F.max_by("period", F.struct("gravity", (-F.unix_seconds(F.col(order))).alias("t"))).alias("peak_period"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col("gravity").alias("g")))), lambda x: x["g"]).alias("course"),
    )


def chart_series(timeline: DataFrame, key: str = "author", series: tuple[str, ...] = ("impact", "production", "quality", "survival", "design")) -> DataFrame:
    """Long rows (key, period, series, value) behind the charts."""
    return timeline.select(key, "period", *(F.col(s).cast("double").alias(s) for s in series)).unpivot([key, "period"], list(series), "series", "value")


def filter_authors(timeline: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the listed authors, case aside; an empty list keeps all."""
    return timeline.where(F.lower("author").isin([n.lower() for n in names])) if names else timeline
