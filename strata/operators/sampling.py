"""Stratified file sampling and reuse of finished stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.paths import sample_stratum
from strata.sources.ledger import KeyLedger


def stratum_quotas(strata: DataFrame, n: int, min_per: int = 2) -> DataFrame:
    """strata(stratum, size) -> with quota: min_per each (1 if they don't all fit) in name order while it fits, then
    shares of the rest in proportion to what is left, rounded down, and one more each by largest fraction."""
    alone = Window.partitionBy(F.lit(0))  # a row a directory, not a file
    rows = strata.withColumn("m", F.when(F.count("*").over(alone) * min_per > n, 1).otherwise(min_per))
    rows = rows.withColumn("base", F.least("m", "size"))
    running = F.sum("base").over(alone.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("base", F.when(running <= n, F.col("base")).otherwise(0))
    rows = rows.withColumn("left", F.col("size") - F.col("base"))
    rest = F.lit(n) - F.sum("base").over(alone)
    share = rest * F.col("left") / F.nullif(F.sum("left").over(alone), F.lit(0))
    rows = rows.withColumn("share", F.coalesce(share, F.lit(0.0)))
    rows = rows.withColumn("floor", F.least(F.floor("share"), F.col("left"))).withColumn("rest", rest)
    open_ = F.col("left") > F.col("floor")
    more = F.col("rest") - F.sum("floor").over(alone)
    place = F.row_number().over(alone.orderBy(F.when(open_, 0).otherwise(1), F.desc(F.col("share") - F.col("floor")), "stratum"))
    extra = F.when(open_ & (place <= more), 1).otherwise(0)
    return rows.withColumn("extra", extra).select("stratum", "size", (F.col("base") + F.col("floor") + F.col("extra")).cast("long").alias("quota"))


#: Ranges of the hash that a directory's files are counted in.
_RANGE_BITS = 12


def stratified_sample(files: DataFrame, n: int, seed: int = 42, by=()) -> DataFrame:
    """Up to n files, spread over directories by stratum_quotas: those with the smallest hashes of path and seed.

    The choice is a mergeable sketch: counts of a directory's files by range of the hash give the range in which its
    quota ends. Ranges below stay whole, and only the rows of that one range are put in order, so no task sorts a
    directory."""
    rows = files.withColumns({"stratum": sample_stratum(F.col("path")), "_h": F.xxhash64("path", F.lit(seed))})
    rows = rows.withColumn("_range", F.shiftright("_h", 64 - _RANGE_BITS))
    counts = rows.groupBy("stratum", "_range").agg(F.count("*").alias("_n"))
    quotas = stratum_quotas(counts.groupBy("stratum").agg(F.sum("_n").alias("size")), n)
    upto = F.sum("_n").over(Window.partitionBy("stratum").orderBy("_range"))  # a row a range
    cut = counts.withColumn("_upto", upto).join(quotas.select("stratum", "quota"), "stratum")
    cut = cut.where(F.col("_upto") - F.col("_n") < F.col("quota")).withColumn("_more", F.col("quota") - F.col("_upto") + F.col("_n"))
    chosen = rows.join(cut.select("stratum", "_range", "_n", "_more"), ["stratum", "_range"])
    whole, part = chosen.where("_n <= _more"), chosen.where("_n > _more")
    order = Window.partitionBy("stratum").orderBy("_h", "path", *by)
    part = part.withColumn("_place", F.row_number().over(order)).where("_place <= _more").drop("_place")
    return whole.unionByName(part).drop("_h", "_range", "_n", "_more")


def missing_keys(wanted: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("repo", "head")) -> DataFrame:
    """Keys whose stage output isn't there yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def materialize_stage(df: DataFrame, path: str, keys: tuple[str, ...] = ("repo", "head")) -> DataFrame:
    """Adds the rows of the keys that the stage at path lacks, and reads it whole. Runs side by side leave each key once:
    a key's rows count from the atomic creation of its ledger entry."""
    ledger = KeyLedger(df.sparkSession, path, keys)
    ledger.add(df)
    return ledger.read(df.schema)
