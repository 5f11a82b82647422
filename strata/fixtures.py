"""Version-control relations derived from the star-schema test tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strata.config import Config

AS_OF = "2001-12-01 00:00:00"
TABLES = ("part", "orders", "lineitem", "events", "documents", "pages", "nation", "region", "customer", "supplier")

#: name -> (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "p": ((), """SELECT p_partkey, CAST(regexp_extract(p_brand,'([0-9]+)',1) AS INT) AS bn, p_size,
  CONCAT(CASE p_type WHEN 'ECONOMY' THEN 'services' WHEN 'PROMO' THEN 'packages' WHEN 'MEDIUM' THEN 'app'
                     WHEN 'STANDARD' THEN 'internal' WHEN 'SMALL' THEN 'libs' ELSE 'web' END,
   '/b', regexp_extract(p_brand,'([0-9]+)',1), '/',
   CASE p_size % 4 WHEN 0 THEN 'core/' WHEN 1 THEN 'hooks/' WHEN 2 THEN 'util/' ELSE '' END,
   'f', CAST(p_partkey AS STRING), CASE WHEN p_size % 10 = 0 THEN '_test' ELSE '' END,
   CASE WHEN p_size % 10 = 0 THEN '.go' ELSE CASE p_partkey % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.py'
        WHEN 2 THEN '.ts' WHEN 3 THEN '.rb' ELSE '.java' END END) AS path FROM part"""),
    "c0": ((), """SELECT *, CASE WHEN o_custkey % 20 < 7 THEN 0 WHEN o_custkey % 20 < 11 THEN 1 WHEN o_custkey % 20 < 14 THEN 2
  WHEN o_custkey % 20 < 16 THEN 3 ELSE o_custkey % 20 - 12 END AS d0 FROM orders"""),
    "c1": (("c0",), """SELECT *, CASE WHEN d0 IN (5,7) AND o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' THEN 2 ELSE d0 END AS d FROM c0"""),
    "c": (("c1",), """SELECT CONCAT('repo', CAST(o_orderkey % 4 AS STRING)) AS repo, o_orderkey AS commit_id,
  CONCAT('dev', CAST(d AS STRING)) AS author, o_orderdate AS committed_at,
  CASE WHEN o_orderkey % 50 = 0 THEN CONCAT('Revert "o', CAST(o_orderkey-4 AS STRING), '"')
       WHEN o_orderpriority='1-URGENT' THEN CONCAT('fix: order ', CAST(o_orderkey AS STRING))
       WHEN o_orderpriority='2-HIGH' AND d IN (1,4,6) THEN CONCAT('[hotfix] o', CAST(o_orderkey AS STRING))
       ELSE CONCAT('feat: fixture ', CAST(o_orderkey AS STRING)) END AS subject,
  o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS is_merge FROM c1"""),
    "fc": (("c", "p"), """SELECT c.repo, c.commit_id, p.path, CAST(l_quantity AS BIGINT) AS insertions,
  CAST(ROUND(l_discount*100) AS BIGINT) AS deletions
  FROM lineitem l JOIN c ON l_orderkey=commit_id JOIN p ON l_partkey=p_partkey WHERE NOT is_merge"""),
    "b": (("c", "p"), """SELECT c.repo, p.path, CASE WHEN l.l_quantity <= 2*p.bn THEN CONCAT('dev', CAST(p.bn % 8 AS STRING))
  ELSE c.author END AS author, l.l_shipdate AS committed_at
  FROM lineitem l JOIN c ON l.l_orderkey=c.commit_id JOIN p ON l.l_partkey=p.p_partkey"""),
    "reverts": (("c",), """SELECT repo, commit_id AS revert_id, commit_id-4 AS reverted_id FROM c
  WHERE (commit_id % 50 = 0 AND commit_id >= 4) OR (commit_id % 200 = 4 AND commit_id > 4)"""),
    "commit_parents": (("c",), """SELECT repo, commit_id, 1 AS pos, CASE WHEN is_merge THEN commit_id-12 ELSE commit_id-4 END AS parent_id
  FROM c WHERE commit_id >= 12 UNION ALL SELECT repo, commit_id, 2, commit_id-4 FROM c WHERE is_merge AND commit_id >= 12"""),
    "files": (("p", "c"), """SELECT r.repo, p.path, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size*150000 AS BIGINT) END AS size_bytes
  FROM p CROSS JOIN (SELECT DISTINCT repo FROM c) r
  UNION ALL SELECT 'repo0', CONCAT(regexp_replace(path, '[.]go$', ''), '_test.go'), CAST(100 AS BIGINT) FROM p
  WHERE p_partkey % 15 = 5 AND p_size % 10 <> 0"""),
    "line_lives": (("c", "p"), """SELECT c.repo, p.path, CASE WHEN l.l_quantity <= 2*p.bn THEN CONCAT('dev', CAST(p.bn % 8 AS STRING))
  ELSE c.author END AS author, l.l_shipdate AS born_at,
  CASE WHEN l.l_returnflag='R' THEN l.l_shipdate + l.l_linenumber * INTERVAL '200' DAY END AS died_at
  FROM lineitem l JOIN c ON l.l_orderkey=c.commit_id JOIN p ON l.l_partkey=p.p_partkey"""),
    "fix_files": (("fc", "c"), """SELECT DISTINCT fc.repo, fc.commit_id, fc.path, c.author AS fixer, c.committed_at AS fix_at
  FROM fc JOIN c ON fc.repo=c.repo AND fc.commit_id=c.commit_id
  WHERE c.subject LIKE 'fix:%' OR c.subject LIKE '[hotfix]%'"""),
    "g1": ((), """SELECT n, CONCAT('m', CAST(n AS STRING)) AS author, CONCAT('t', CAST((n*n) % 97 AS STRING)) AS team,
  (n*7 + CAST(FLOOR(n/3) AS BIGINT)*37 + CAST(FLOOR(n/9) AS BIGINT)*17) % 101 AS production,
  (n*11 + CAST(FLOOR(n/5) AS BIGINT)*41 + CAST(FLOOR(n/15) AS BIGINT)*17) % 101 AS quality,
  (n*13 + CAST(FLOOR(n/7) AS BIGINT)*43 + CAST(FLOOR(n/21) AS BIGINT)*17) % 101 AS survival,
  (n*17 + CAST(FLOOR(n/11) AS BIGINT)*47 + CAST(FLOOR(n/33) AS BIGINT)*17) % 101 AS robust0,
  (n*19 + CAST(FLOOR(n/13) AS BIGINT)*49 + CAST(FLOOR(n/39) AS BIGINT)*17) % 101 AS design,
  (n*23 + CAST(FLOOR(n/17) AS BIGINT)*53 + CAST(FLOOR(n/51) AS BIGINT)*17) % 101 AS breadth,
  (n*29 + CAST(FLOOR(n/19) AS BIGINT)*59 + CAST(FLOOR(n/57) AS BIGINT)*17) % 101 AS debt_cleanup,
  (n*31 + CAST(FLOOR(n/23) AS BIGINT)*61 + CAST(FLOOR(n/69) AS BIGINT)*17) % 101 AS indispensability,
  (n*37 + CAST(FLOOR(n/29) AS BIGINT)*67 + CAST(FLOOR(n/87) AS BIGINT)*17) % 101 AS raw_survival,
  (n*41 + CAST(FLOOR(n/31) AS BIGINT)*71 + CAST(FLOOR(n/93) AS BIGINT)*17) % 101 AS dormant_pct,
  (n*43 + CAST(FLOOR(n/37) AS BIGINT)*73 + CAST(FLOOR(n/111) AS BIGINT)*17) % 101 AS untested_pct,
  (n*7) % 300 AS total_commits, n % 3 <> 0 AS recently_active, n % 4 <> 0 AS has_pressure
  FROM (SELECT p_partkey AS n FROM part)"""),
    "score_grid": (("g1",), """SELECT *, CASE WHEN has_pressure THEN robust0 ELSE 0 END AS robust_survival FROM g1"""),
}


def with_views(names: str, *more: str) -> str:
    """A WITH clause of the named views, what they read, and further `x AS (...)` entries."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        for n in VIEWS[name][0]:
            need(n)
        done.setdefault(name, VIEWS[name][1])

    for n in names.split():
        need(n)
    return "WITH " + ",\n".join([*(f"{k} AS ({v})" for k, v in done.items()), *more]) + "\n"


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs text with the test tables read from sf_dir."""
    return spark.sql(re.sub(r"\b(FROM|JOIN) (%s)\b" % "|".join(TABLES), rf"\1 parquet.`{sf_dir}/\2.parquet`", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark_sql(spark, sf_dir, with_views(name) + f"SELECT * FROM {name}")
    # The files hold zoneless times; the operators work on instants (session time zone UTC).
    return df.withColumns({f.name: df[f.name].cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


#: The two settings that follow the amount of data, as SQL.
DAILY_REF = "((SELECT COUNT(*) FROM orders) / 75e0)"
MIN_LINES = "greatest(1, (SELECT COUNT(*) FROM orders) // 15)"


def fixture_config(spark: SparkSession, sf_dir: str) -> Config:
    """Settings that suit the derived relations; two of them follow the number of orders."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return Config(tau=720.0, active_days=150.0, production_daily_ref=max(n, 1) / 75, min_substantial_lines=max(1, n // 15))
