"""name -> query, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, build: Callable, oracle: str | None = None, views: str = "", *ctes: str) -> None:
    """Registers build(V, spark, sf_dir), where V(name) reads a derived view, with its oracle over the same views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held: dict[str, DataFrame] = {}

        def named(n: str) -> DataFrame:
            if n not in held:
                held[n] = view(spark, sf_dir, n)
            return held[n]

        return build(named, spark, sf_dir)

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = (with_views(views, *ctes) if views or ctes else "") + oracle


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as both engines sum in different orders."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"})


# --- pieces of oracle SQL ------------------------------------------------------------------------------------------


def sql_dir(p: str = "path") -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def sql_module(p: str = "path") -> str:
    d = sql_dir(p)
    return f"CASE WHEN {d} = '' THEN '.' ELSE array_to_string(list_slice(string_split({d}, '/'), 1, 2), '/') END"


def sql_days(later: str, earlier: str) -> str:
    return f"greatest((epoch_us({later}) - epoch_us({earlier})) / 86400e6, 0e0)"


SQL_BASE = "regexp_extract(path, '([^/]*)$', 1)"
SQL_IS_TEST = (
    f"(regexp_matches({SQL_BASE}, '_test[.]go$') OR (regexp_matches({SQL_BASE}, '[.](test|spec)[.]') AND regexp_matches({SQL_BASE}, '[.](ts|tsx|js|jsx|mjs|cjs)$'))"
    f" OR regexp_matches({SQL_BASE}, '^test_.*[.]py$') OR regexp_matches({SQL_BASE}, '_test[.]py$') OR regexp_matches({SQL_BASE}, '_(spec|test)[.]rb$')"
    f" OR regexp_matches({SQL_BASE}, '^Test.*[.](java|kt|scala)$') OR regexp_matches({SQL_BASE}, '(Test|Tests|Spec|IT)[.](java|kt|scala)$')"
    " OR regexp_matches(path, '(^|/)(tests|test|__tests__|spec)/'))"
)
SQL_IS_FIX = r"(regexp_matches(subject, '(?i)^[^\w]*(\[?\s*(fix|revert|hotfix)\s*\]?[:/\s])') OR contains(subject, '修正'))"
SQL_AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"


def H(v: str) -> str:
    return f"(CASE WHEN {v} >= 80 THEN 1e0 WHEN {v} >= 60 THEN 0.5e0 + ({v} - 60) / 40e0 WHEN {v} >= 40 THEN ({v} - 40) / 40e0 * 0.3e0 ELSE 0e0 END)"


def L(v: str) -> str:
    return f"(CASE WHEN {v} < 10 THEN 1e0 WHEN {v} < 30 THEN 0.5e0 + (30 - {v}) / 40e0 WHEN {v} < 50 THEN (50 - {v}) / 40e0 * 0.3e0 ELSE 0e0 END)"


def N(v: str) -> str:
    return f"(CASE WHEN {v} >= 50 THEN 1e0 WHEN {v} >= 30 THEN 0.5e0 + ({v} - 30) / 40e0 WHEN {v} >= 10 THEN ({v} - 10) / 40e0 * 0.3e0 ELSE 0e0 END)"


def sql_pick(rules: list[tuple[str, str]], margin: str = "0.15e0", least: str = "0.10e0", start: str = "-1e0") -> str:
    """The label fold as a DuckDB list_reduce over structs (n, c)."""
    cells = ", ".join(f"{{'n': '{n}', 'c': CAST(coalesce({c}, 0e0) AS DOUBLE)}}" for n, c in rules)
    first = f"[{{'n': '—', 'c': {start}}}]"
    return f"list_reduce(list_concat({first}, list_filter([{cells}], lambda x: x.c >= {least})), lambda a, x: CASE WHEN x.c - a.c > {margin} THEN x ELSE a END)"


def sql_conf(s: str) -> str:
    return f"CASE WHEN {s}.n = '—' THEN 0e0 ELSE floor({s}.c * 100 + 0.5e0) / 100 END"
