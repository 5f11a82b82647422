"""Rankings against an external ground truth.

engineers: one row a (repo, author) with gravity, impact, debt_cleanup, survival, robust_survival;
ground_truth: (repo, rank, login). Names are compared lower-cased and trimmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.paths import norm_name


def ranked(df: DataFrame, value: str, name: str = "author", by=("repo",)) -> DataFrame:
    """(.., name, rank) by value descending, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), name)
    return df.select(*by, norm_name(F.col(name)).alias("name"), F.row_number().over(order).alias("rank"))


def resolve_logins(truth: DataFrame, aliases: DataFrame) -> DataFrame:
    """truth(repo, rank, login), aliases(repo, alias, canonical) -> with name: the author behind the login."""
    a = aliases.select("repo", norm_name(F.col("alias")).alias("_login"), "canonical").dropDuplicates(["repo", "_login"])
    joined = truth.withColumn("_login", norm_name(F.col("login"))).join(a, ["repo", "_login"], "left")
    return joined.withColumn("name", norm_name(F.coalesce("canonical", "login"))).drop("_login", "canonical")


def topk_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per repository the share of b's first k that are among a's first k."""
    first = a.where(F.col("rank") <= k).select("repo", "name").distinct().withColumn("hit", F.lit(1))
    own = b.where(F.col("rank") <= k).select("repo", "name").distinct()
    return own.join(first, ["repo", "name"], "left").groupBy("repo").agg((F.count("hit") / F.count("*")).alias("overlap"))


def recall_at_k(a: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """Per repository the share of known(repo, name) among a's first k."""
    first = a.where(F.col("rank") <= k).select("repo", "name").distinct().withColumn("hit", F.lit(1))
    return known.select("repo", "name").distinct().join(first, ["repo", "name"], "left").groupBy("repo").agg((F.count("hit") / F.count("*")).alias("recall"))


def spearman(a: DataFrame, b: DataFrame, limit: int = 30, rerank: bool = False) -> DataFrame:
    """1 - 6 * sum(d^2) / (n * (n^2 - 1)) over names in both lists' first `limit`; below three of them 0.

    By default d takes positions in the full lists, so the value can leave -1..1; rerank counts among common names."""
    both = a.where(F.col("rank") <= limit).select("repo", "name", F.col("rank").alias("ra")).join(
        b.where(F.col("rank") <= limit).select("repo", "name", F.col("rank").alias("rb")), ["repo", "name"]
    )
    if rerank:
        w = Window.partitionBy("repo")
        both = both.withColumns({r: F.row_number().over(w.orderBy(r)) for r in ("ra", "rb")})
    n = F.count("*")
    rho = 1 - 6 * F.sum(F.pow(F.col("ra") - F.col("rb"), 2)) / (n * (n * n - 1))
    return both.groupBy("repo").agg(n.alias("common"), F.when(n >= 3, rho).otherwise(0.0).alias("rho"))


def gravity_concentration(eng: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc("gravity"), "author")
    rows = eng.withColumn("rank", F.row_number().over(order))
    total = F.sum("gravity")
    share = F.sum(F.when(F.col("rank") <= n, F.col("gravity"))) / F.nullif(total, F.lit(0.0))
    return rows.groupBy("repo").agg(F.coalesce(share, F.lit(0.0)).alias("concentration"))


def global_gravity(eng: DataFrame, min_score: float = 20.0) -> DataFrame:
    """gravity * ln N / ln N_max over repositories of N authors, of authors with an impact of min_score or more."""
    sizes = eng.groupBy("repo").agg(F.count("*").alias("size"))
    top = sizes.agg(F.max("size").alias("largest"))
    rows = eng.join(sizes, "repo").join(F.broadcast(top)).where(F.col("impact") >= min_score)
    factor = F.when(F.col("largest") > 1, F.log("size") / F.log("largest")).otherwise(1.0)
    return rows.withColumn("adjusted_gravity", F.col("gravity") * factor)


def hidden_architects(a: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """Names among the first k by gravity that nobody knows."""
    return a.where(F.col("rank") <= k).join(known.select("repo", "name"), ["repo", "name"], "left_anti")


def entropy_fighters(eng: DataFrame) -> DataFrame:
    lasting = F.when(F.col("robust_survival") > 0, F.col("robust_survival")).otherwise(F.col("survival"))
    rows = eng.where((F.col("debt_cleanup") >= 50) & (lasting >= 30))
    return rows.withColumn("fight", F.col("debt_cleanup") + F.greatest("robust_survival", "survival")).orderBy(F.desc("fight"), "repo", "author")


def champions(eng: DataFrame, k: int = 5) -> DataFrame:
    """The k largest gravities of each repository, the larger repositories first."""
    w = Window.partitionBy("repo")
    rows = eng.withColumn("size", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("gravity"), "author")))
    return rows.where(F.col("rank") <= k).orderBy(F.desc("size"), "repo", "rank")


def ranking_intersect(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    first = lambda x: x.where(F.col("rank") <= k).select("repo", "name")
    return first(a).intersect(first(b))


def ranking_except(a: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    return a.where(F.col("rank") <= k).select("repo", "name").subtract(known.select("repo", "name"))


def validate_repos(eng: DataFrame, truth: DataFrame, known: DataFrame) -> DataFrame:
    """Per repository: size, overlap, rho, recall, hidden, fighters, concentration. truth: (repo, name, rank)."""
    g = ranked(eng, "gravity")
    out = eng.groupBy("repo").agg(F.count("*").alias("size"))
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    for part in (
        topk_overlap(g, truth),
        spearman(g, truth),
        recall_at_k(g, known),
        count(hidden_architects(g, known), "hidden"),
        count(entropy_fighters(eng), "fighters"),
        gravity_concentration(eng),
    ):
        out = out.join(part, "repo", "left")
    return out.na.fill(0)


def validation_summary(rv: DataFrame) -> DataFrame:
    return rv.agg(
        F.count("*").alias("repos"),
        F.avg("overlap").alias("mean_overlap"),
        F.avg(F.when(F.col("recall") > 0, F.col("recall"))).alias("mean_recall"),
        F.avg("rho").alias("mean_rho"),
        F.avg("concentration").alias("mean_concentration"),
        F.sum("hidden").alias("hidden"),
        F.sum("fighters").alias("fighters"),
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
    )
