"""Cases past what once was a limit, and readers, settings and functions that no query covers."""

import json
import textwrap

import pytest
from pyspark.sql import functions as F

from strata.config import load_config
from strata.functions import lines, paths, sql
from strata.operators import axes, clean, scoring
from strata.sources import readers
from strata.streaming import activity as live
from test_sources import events


def test_revert_chain_of_any_depth(spark):
    """c0 <- c1 <- ... <- c70, each reverting the one before: the last stands, so every second one has fallen."""
    df = spark.createDataFrame([("r", f"c{i + 1}", f"c{i}") for i in range(70)], "repo string, revert_id string, reverted_id string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {x.commit_id for x in clean.effectively_reverted(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {f"c{i}" for i in range(69, -1, -2)}


def test_long_files_keep_their_comment_state(spark):
    text = ["x", "/* open", *["inside"] * 1000, "*/", *["y"] * 300, "// z"]
    df = spark.createDataFrame([("a.go", text), ("b.go", [])], "path string, lines array<string>")
    got = {r.path: r.f for r in df.select("path", lines.skip_flags(paths.detect_lang(F.col("path")), F.col("lines")).alias("f")).collect()}
    assert got["a.go"] == [False, *[True] * 1002, *[False] * 300, True] and got["b.go"] == []


def test_merge_of_repositories(spark):
    df = spark.createDataFrame([("m", f"r{i}", float(i)) for i in range(4)], "module string, repo string, survival double")
    assert axes.merge_module_survival(df).first().survival == ((0.5 + 2) / 2 + 3) / 2


def test_line_groups_count_like_lines(spark):
    from strata.config import Config

    blame = spark.sql("SELECT 'r' AS repo, concat('a/b/f', id % 3) AS path, concat('dev', id % 2) AS author, timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 5)) AS committed_at FROM range(100)")
    groups = axes.line_groups(blame)
    assert groups.count() < 100
    pressure = spark.createDataFrame([("r", "a/b", 1.0)], "repo string, module string, pressure double")
    for f in (lambda b: axes.ownership(b), lambda b: axes.bus_factor(b, Config(critical=0.5, high=0.4)), lambda b: axes.pressure_threshold(b, pressure, 1)):
        assert sorted(map(str, f(blame).collect())) == sorted(map(str, f(groups).collect()))
    at = lambda b: b.withColumns({"is_tested": F.lit(True), "pressure": F.lit(1.0), "threshold": F.lit(2.0)})
    one, two = (axes.survival(at(b), "2024-02-01", Config()).orderBy("author").collect() for b in (blame, groups))
    assert [r.raw_survival for r in one] == [r.raw_survival for r in two] and [r.survival for r in one] == pytest.approx([r.survival for r in two])


def test_settings_of_other_names(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({
        "exclude_file_patterns": ["x"], "architecture_patterns": ["y/"], "bus_factor": {"critical": 0.9, "high": 0.5}, "breadth": {"unit": "repo", "min_commits": 2},
        "max_blame_file_bytes": 7, "untested_survival_weight": 0.25, "default_domains": False, "blame_timeout": 9, "module_convention_dirs": ["libs"], "domains": None, "aliases": None,
    }))
    c = load_config(str(p))
    assert (c.exclude_files, c.architecture, c.critical, c.high, c.breadth_unit, c.breadth_min_commits) == (("x",), ("y/",), 0.9, 0.5, "repo", 2)
    assert (c.max_file_bytes, c.untested_weight, c.default_domains, c.blame_timeout, c.convention_dirs) == (7, 0.25, False, 9, ("libs",))
    yaml = pytest.importorskip("yaml")
    assert yaml
    p = tmp_path / "c.yaml"
    p.write_text(textwrap.dedent("""
        aliases:
          # none
        domains:
          backend: [api, worker]
          mobile:
            extensions: [.swift]
        bus_factor:
          critical: 0.85
        tau: 90
    """))
    c = load_config(str(p))
    assert (c.tau, c.critical, c.high, c.aliases) == (90, 0.85, 0.6, {}) and c.domains["backend"] == {"repos": ["api", "worker"]}


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    names = ["a/x_test.go", "x.test.ts", "src/test/A.java", "a/x.go", "latest/a.c", "TestFoo.java", "Makefile", "a.PY", "b.md", "c", "x.vue"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for r in df.select("path", F.expr("is_test_file(path)").alias("a"), paths.is_test_file(F.col("path")).alias("b"), F.expr("detect_lang(path)").alias("c"), paths.detect_lang(F.col("path")).alias("d")).collect():
        assert r.a == r.b and r.c == r.d, r
    got = spark.sql("SELECT period_label(timestamp'2001-08-02', '1w'), period_label(timestamp'2001-08-02', '1m'), period_label(timestamp'2001-08-02', '3m'), period_label(timestamp'2001-08-02', '6m'), period_label(timestamp'2001-08-02', '1y')").first()
    assert tuple(got) == ("2001-W31", "2001-08", "2001-Q3 (Aug)", "2001-H2", "2001")


CELL = "{sha} 1 1 1\nauthor {author}\ncommitter-time {at}\nfilename {file}\n\t{text}\n"


def test_blame_of_several_dumps(spark, tmp_path):
    """Files whose lines interleave, a dump without an author, and comments that go on over lines of other files."""
    cell = lambda author, at, file, text: CELL.format(sha="a" * 40, author=author, at=at, file=file, text=text)
    (tmp_path / "r.txt").write_text(cell("Ann", 1, "a.go", "/* x") + cell("Ann", 2, "b.go", "y") + cell("Bob", 3, "a.go", "z */") + cell("Bob", 4, "a.go", "w"))
    (tmp_path / "s.txt").write_text("author \nfilename q.go\n\tno author\n\tnor this\n" + cell("Cy", 5, "q.go", "v"))
    got = sorted((r.repo, r.path, r.author, int(r.committed_at.timestamp())) for r in readers.read_blame(spark, str(tmp_path)).collect())
    assert got == [("r", "a.go", "Bob", 4), ("r", "b.go", "Ann", 2), ("s", "q.go", "Cy", 5)]
    text = spark.createDataFrame([("r", (tmp_path / "r.txt").read_text())], "repo string, value string")
    assert sorted((r.path, r.author) for r in readers.parse_blame(text).collect()) == [("a.go", "Bob"), ("b.go", "Ann")]
    fixes = readers.read_fix_blame(spark, str(tmp_path / "s.txt")).collect()
    assert [tuple(r) for r in fixes] == [("s", "q.go", "Cy")]


def test_porcelain_function(spark):
    sql.register(spark)
    spark.createDataFrame([(CELL.format(sha="b" * 40, author="Ann", at=7, file="m.go", text="x"),), (None,)], "value string").createOrReplaceTempView("porcelain")
    rows = spark.sql("SELECT p.* FROM porcelain, LATERAL parse_porcelain(value) p").collect()
    assert [tuple(r) for r in rows] == [("m.go", "Ann", 7, "x")]


def test_merge_log(spark, tmp_path):
    (tmp_path / "r.txt").write_text("COMMIT:m1|Ann|2024-01-02 10:00:00 +0000|Merge x\nCOMMIT:bad\nCOMMIT:m2|Bob|2024-01-03 10:00:00 +0000|Merge y\n")
    rows = readers.read_merge_log(spark, str(tmp_path)).collect()
    assert sorted((r.commit_id, r.author, r.is_merge) for r in rows) == [("m1", "Ann", True), ("m2", "Bob", True)]


def test_last_seen(spark, tmp_path):
    """An update for each author, and an inactive row once the watermark has passed the last activity by the timeout."""
    sf, store = events(spark, tmp_path, [0, 1, 8, 9]), "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = live.last_seen(live.stream_activity(spark, sf), active_days=30)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).format("memory").queryName("last_seen").start()
        query.awaitTermination()
    finally:
        spark.conf.unset(store)
    got = {r.author: (r.last_ms, r.active) for r in spark.table("last_seen").collect()}
    day = 86_400_000
    start = 1704067200000
    assert got == {"dev0": (start + 8 * day, True), "dev1": (start + 9 * day, True)}


def test_matrix_of_authors_and_repositories(spark):
    rows = spark.createDataFrame([("a", "r1", 40.4, "Anchor"), ("a", "r2", 60.0, "—"), ("b", "r1", 90.0, "Architect"), ("b", "r3", 10.0, "Architect")], "author string, repo string, impact double, role string")
    overall = spark.createDataFrame([("a", 50.0), ("b", 60.0), ("c", 1.0)], "author string, impact double")
    got = {r.author: (r.place, [tuple(c) for c in r.cells], r.pattern) for r in scoring.author_repo_matrix(rows, overall).collect()}
    assert got == {"a": (2, [("r1", "Anchor 40"), ("r2", "60")], "Variable"), "b": (1, [("r1", "Architect 90"), ("r3", "Architect 10")], "Reproducible"), "c": (3, [], "—")}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}})()
        conf = {}

    with pytest.raises(RuntimeError):
        clean.shared_folder(Elsewhere)
