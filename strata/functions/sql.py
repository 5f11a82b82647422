"""The scalar functions under SQL names, and a table function for ad-hoc parsing."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.functions.paths import HASH_NAMES, LANGUAGES

_STEPS = "CASE WHEN v >= {0} THEN 1D WHEN v >= {1} THEN 0.5D + (v - {1}) / 40 WHEN v >= {2} THEN (v - {2}) / 40 * 0.3D ELSE 0D END"
_BASE = "regexp_extract(p, '([^/]*)$', 1)"
_DIR = "regexp_extract(p, '^(.*)/[^/]*$', 1)"



def _language() -> str:
    """detect_lang over the extension (lower-cased, from the last dot of the file name) and the file name."""
    ext, words = f"lower(regexp_extract({_BASE}, '([.][^.]*)$', 1))", lambda names: ", ".join(f"'{n}'" for n in names)
    cases = " ".join(f"WHEN {ext} IN ({words(names)}) THEN '{family}'" for family, names in LANGUAGES.items())
    return f"CASE {cases} WHEN lower({_BASE}) IN ({words(HASH_NAMES)}) THEN 'hash' ELSE 'unknown' END"


#: name -> (parameters, result type, expression); Catalyst inlines them, so they cost what the expression costs.
FUNCTIONS = {
    "highness": ("v DOUBLE", "DOUBLE", _STEPS.format(80, 60, 40)),
    "not_low": ("v DOUBLE", "DOUBLE", _STEPS.format(50, 30, 10)),
    "lowness": ("v DOUBLE", "DOUBLE", "CASE WHEN v < 10 THEN 1D WHEN v < 30 THEN 0.5D + (30 - v) / 40 WHEN v < 50 THEN (50 - v) / 40 * 0.3D ELSE 0D END"),
    "module_of": ("p STRING", "STRING", f"CASE WHEN {_DIR} = '' THEN '.' ELSE array_join(slice(split({_DIR}, '/'), 1, 2), '/') END"),
    "is_test_file": (
        "p STRING",
        "BOOLEAN",
        f"{_BASE} RLIKE r'_test\\.go$|^test_.*\\.py$|_test\\.py$|_(spec|test)\\.rb$|^Test.*\\.(java|kt|scala)$|(Test|Tests|Spec|IT)\\.(java|kt|scala)$' "
        f"OR ({_BASE} RLIKE r'\\.(test|spec)\\.' AND {_BASE} RLIKE r'\\.(ts|tsx|js|jsx|mjs|cjs)$') OR p RLIKE r'(^|/)(tests?|__tests__|spec)/'",
    ),
    "detect_lang": ("p STRING", "STRING", _language()),
    "period_label": (
        "t TIMESTAMP, span STRING",
        "STRING",
        "CASE span WHEN '1w' THEN concat(year(t), '-W', lpad(CAST(weekofyear(t) AS STRING), 2, '0')) WHEN '1m' THEN date_format(t, 'yyyy-MM') "
        "WHEN '3m' THEN concat(year(t), '-Q', quarter(t), ' (', date_format(t, 'MMM'), ')') WHEN '6m' THEN concat(year(t), '-H', CASE WHEN month(t) <= 6 THEN '1' ELSE '2' END) "
        "WHEN '1y' THEN CAST(year(t) AS STRING) END",
    ),
    "is_fix": ("s STRING", "BOOLEAN", r"s RLIKE r'(?i)^[^\w]*(?:\[?\s*(?:fix|revert|hotfix)\s*\]?[:/\s])' OR contains(s, '修正')"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions of this session and returns their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("parse_porcelain", F.udtf(ParsePorcelain, returnType="path string, author string, committer_time bigint, text string"))
    return [*FUNCTIONS, "parse_porcelain"]


class ParsePorcelain:
    """LATERAL parse_porcelain(text): the source lines of one line-porcelain dump. For ad-hoc use; tables go through
    sources.readers.read_blame, which runs no Python."""

    def eval(self, text: str):
        author = path = ""
        at = None
        for line in (text or "").split("\n"):
            if line.startswith("author "):
                author = line[7:]
            elif line.startswith("committer-time "):
                at = int(line[15:])
            elif line.startswith("filename "):
                path = line[9:]
            elif line.startswith("\t"):
                yield path, author, at, line[1:]
