"""Hot files, commits, words and directories; ranks, sweeps and ledgers against plain versions."""

import collections
import itertools
import math
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.functions.periods import build_periods
from strata.operators import axes, clean, modules, ranks, sampling, scoring, timelines
from strata.functions import lines, paths
from strata.sources import readers
from strata.sources.ledger import KeyLedger
from strata.streaming import activity as live
from test_sources import events

T0 = datetime(2024, 1, 1)
FIXES = "repo string, path string, commit_id long, fixer string, fix_at timestamp"
LINES = "repo string, path string, author string, committed_at timestamp, died_at timestamp"


def debt_rows(seed=2, n=400):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(hours=r.randint(0, 24 * 12))  # noqa: E731 - many ties
    paths = ["hot"] * 6 + ["a", "b"]
    fixes = [("r", r.choice(paths), i, r.choice("xyz"), at()) for i in range(n)]
    lines = [("r", r.choice(paths), r.choice(["x", "y", "u", ""]), at(), None if r.random() < 0.5 else at()) for _ in range(n)]
    return fixes, [(*x[:4], x[4] and max(x[3], x[4])) for x in lines]


def test_debt_counts_as_of_each_fix(spark):
    fixes, lines = debt_rows()
    f, b = spark.createDataFrame(fixes, FIXES), spark.createDataFrame(lines, LINES)
    for mortal in (True, False):
        want = collections.Counter()
        for (_, p, _, fixer, at), (_, q, author, born, died) in itertools.product(fixes, lines):
            if p == q and author not in ("", fixer) and born < at and (not mortal or died is None or at <= died):
                want["r", fixer, author] += 1
        for few in (0, 20, 10**6):  # all files by counts, some, none
            got = axes.debt_events(f, b if mortal else b.drop("died_at"), few=few).collect()
            assert {(x.repo, x.fixer, x.original): x.lines for x in got} == dict(want)


def test_one_file_of_very_many_fixes(spark):
    """100,000 fixes of one file by two authors meet its 20,000 lines as counts: 2e9 pairs would not end."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    f = spark.range(100_000).select(F.lit("r").alias("repo"), F.lit("p").alias("path"), F.col("id").alias("commit_id"), F.concat(F.lit("f"), F.col("id") % 2).alias("fixer"), at.alias("fix_at"))
    b = spark.range(20_000).select(F.lit("r").alias("repo"), F.lit("p").alias("path"), F.lit("u").alias("author"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("committed_at"))
    got = {x.fixer: x.lines for x in axes.debt_events(f, b).collect()}
    want = {f"f{k}": sum(len(range(5 * i + 1 + (5 * i + 1 + k) % 2, 100_000, 2)) for i in range(20_000)) for k in (0, 1)}
    assert got == want


def test_snapshots_by_sweep(spark):
    r = random.Random(4)
    day = lambda k: T0 + timedelta(days=k)
    lives = [(r.choice("ab"), r.choice("uv"), day(b := r.randint(-400, 700)), None if r.random() < 0.4 else day(b + r.choice([0, 1, 50, 400]))) for _ in range(300)] + [("a", "u", None, None), ("a", "u", day(5), day(1))]
    df = spark.createDataFrame(lives, "repo string, author string, born_at timestamp, died_at timestamp")
    periods = build_periods(spark, "3m", day(600), since=day(-300))
    want = {}
    for p in periods.collect():
        for repo, author, born, died in lives:
            if born and born <= p.end and (died is None or died > p.end):
                n, w = want.get((p.label, repo, author), (0, 0.0))
                want[p.label, repo, author] = n + 1, w + math.exp(-(p.end - born).total_seconds() / 86400 / 90)
    found = timelines.snapshot_sums(df, periods, {"repo": F.col("repo"), "author": F.col("author")}, 90.0)
    got = {(x.period, x.repo, x.author): (x.lines, x.decayed) for x in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert timelines.snapshot_sums(df.limit(0), periods, {"repo": F.col("repo")}, 90.0).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 7, 5000])
def test_places_over_all_rows(spark, rows):
    r = random.Random(rows)
    values = [(f"n{i:05}", r.choice([None, 0.0, 0.0, 0.0, r.random()])) for i in range(rows)]
    got = ranks.placed(spark.createDataFrame(values, "name string, v double"), [F.col("v"), F.col("name")]).collect()
    order = sorted(values, key=lambda x: (x[1] is not None, x[1] or 0.0, x[0]))
    assert {x.name: x["rank"] for x in got} == {x[0]: k + 1 for k, x in enumerate(order)} and all(x._total == rows for x in got)


def test_ranks_need_no_single_task(spark):
    scores = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("author"), (F.col("id") % 7).cast("double").alias("impact"))
    df = scoring.rank_by_impact(scores)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Window [row_number() windowspecdefinition(impact" not in plan
    got = {x.author: x["rank"] for x in df.collect()}
    order = sorted(got, key=lambda a: (-(int(a[1:]) % 7), a))
    assert [got[a] for a in order] == list(range(1, 3001))


def test_coupled_pairs_are_those_of_all_pairs(spark):
    r = random.Random(9)
    rows = {("r", c, f"m{min(39, int(r.expovariate(0.1)))}") for c in range(300) for _ in range(r.randint(1, 4))}
    rows |= {("r", 1000 + k, f"m{i}") for k in range(3) for i in range(40)}  # commits over all modules
    df = spark.createDataFrame(sorted(rows), "repo string, commit_id long, module string")
    for together, coupling in ((1, 0.0), (2, 0.01), (5, 0.1), (3, 0.3), (4, 1.0)):
        every = modules.cochange(df).where((F.col("together") >= together) & (F.col("coupling") >= coupling))
        assert sorted(map(tuple, modules.coupled_pairs(df, together, coupling).collect())) == sorted(map(tuple, every.collect()))
    assert modules.coupled_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("a_row", [0, 2, 16])
def test_coupled_pairs_of_narrow_and_wide_commits(spark, monkeypatch, a_row):
    """However many pairs are made outright: none, so that all commits count as wide, those of some, or all."""
    monkeypatch.setattr(modules, "_PAIRS_A_ROW", a_row)
    r = random.Random(4)
    rows = {(repo, c, f"m{r.randrange(25)}") for repo in "rs" for c in range(120) for _ in range(r.choice((1, 2, 3, 3, 12)))}
    rows |= {("r", 500 + k, f"x{i}") for k in range(6) for i in range(30) if (i + k) % 3}
    df = spark.createDataFrame(sorted(rows), "repo string, commit_id long, module string")
    for together, coupling in ((2, 0.01), (4, 0.3)):
        every = modules.cochange(df).where((F.col("together") >= together) & (F.col("coupling") >= coupling))
        assert sorted(map(tuple, modules.coupled_pairs(df, together, coupling).collect())) == sorted(map(tuple, every.collect()))


def test_coupled_pairs_make_no_row_a_pair_and_commit(spark):
    """Few modules with very many commits: what is shuffled grows with the pairs, not with pairs times commits."""
    df = spark.range(40000).select(F.lit("r").alias("repo"), F.col("id").alias("commit_id"), F.explode(F.array(*(F.format_string("m%d", (F.col("id") * k + k) % 40) for k in (1, 3, 7)))).alias("module")).distinct()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    cheap = modules.cochange(df)
    want = sorted(map(tuple, cheap.where("together >= 2 and coupling >= 0.01").collect()))
    between = written()
    assert sorted(map(tuple, modules.coupled_pairs(df, 2, 0.01).collect())) == want
    assert written() - between < 2 * (between - before)


def test_sample_is_the_smallest_hashes(spark):
    files = spark.range(3000).select(F.concat(F.when(F.col("id") % 3 == 0, "a/b/").otherwise("hot/dir/"), "id").alias("path"))
    for n in (0, 5, 700, 5000):
        got = {x.path for x in sampling.stratified_sample(files, n).collect()}
        hashed = files.withColumn("h", F.xxhash64("path", F.lit(42))).collect()
        quota = {x.stratum: x.quota for x in sampling.stratum_quotas(files.groupBy(sampling.sample_stratum(F.col("path")).alias("stratum")).agg(F.count("*").alias("size")), n).collect()}
        want = set()
        for s, q in quota.items():
            want |= {x.path for x in sorted((x for x in hashed if x.path.startswith(s)), key=lambda x: (x.h, x.path))[:q]}
        assert got == want


def test_aliases_by_the_rarest_word(spark):
    r = random.Random(3)
    words = ["lee", *"abcdefgh"]
    draw = lambda: " ".join(["lee", *r.sample(words[1:], r.randint(0, 3))])  # noqa: E731 - one word in every name
    names, members = sorted({draw() for _ in range(60)}), sorted({draw() for _ in range(25)})
    n = spark.createDataFrame([(x,) for x in names], "name string")
    m = spark.createDataFrame([(x, i) for i, x in enumerate(members)], "member string, ordinal int")
    want = {}
    for x in names:
        a = set(x.split())
        loose = [y for y in members if len(a) > 1 and len(set(y.split())) > 1 and (a <= set(y.split()) or set(y.split()) <= a)]
        want[x] = (x, "exact") if x in members else (loose[0], "words") if loose else (x, "none")
    assert {x.name: (x.canonical, x.how) for x in clean.fuzzy_aliases(n, m).collect()} == want


def test_axes_meet_in_one_row(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "author string, p int")
    b = spark.createDataFrame([("y", 0.5), ("z", 1.5)], "author string, q double")
    assert sorted(map(tuple, scoring.raw_scores([a, b]).collect())) == [("x", 1, None), ("y", 2, 0.5), ("z", None, 1.5)]


# --- streams -------------------------------------------------------------------------------------------------------


def test_a_fresh_checkpoint_writes_nothing_twice(spark, tmp_path):
    sf, out = events(spark, tmp_path, [0, 1, 8, 40]), str(tmp_path / "out")
    rows = live.period_axes(live.stream_activity(spark, sf))
    for k in range(3):
        live.write_complete_periods(rows, out, str(tmp_path / f"ckpt{k}")).awaitTermination()
    found = KeyLedger(spark, out).read(rows.schema).collect()
    assert len(found) == len({(x.period_start, x.author) for x in found}) == 3


def test_two_runs_enter_a_period_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-0{m}-01", d, a) for m in (1, 2, 3) for d in ("x", None) for a in "uv"], "period_start string, domain string, author string")
    ledgers = [KeyLedger(spark, str(tmp_path), ("period_start", "domain")) for _ in range(3)]
    runs = [threading.Thread(target=x.add, args=(rows,)) for x in ledgers]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    assert sorted(map(str, ledgers[0].read(rows.schema).collect())) == sorted(map(str, rows.collect()))
    assert ledgers[0].add(rows) == 0
    assert KeyLedger(spark, str(tmp_path / "none")).read(rows.schema).count() == 0


def test_files_dealt_by_event_time_lose_nothing(spark, tmp_path):
    days = [30, 0, 12, 5, 29, 1, 1, 17]
    sf = events(spark, tmp_path, days)
    stream = live.timed_activity(spark, sf, batches=4)
    assert live.drain(live.deduplicated(stream, delay="1 hour"), "append", "timed").count() == len(days)


def test_two_runs_of_a_stage_leave_each_key_once(spark, tmp_path):
    make = lambda heads: spark.createDataFrame([("r", h, i) for h in heads for i in range(3)], "repo string, head string, x int")
    runs = [threading.Thread(target=sampling.materialize_stage, args=(make(h), str(tmp_path / "s"))) for h in ("abc", "bcd", "abcd")]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    assert sorted(map(tuple, sampling.materialize_stage(make("ae"), str(tmp_path / "s")).collect())) == [("r", h, i) for h in "abcde" for i in range(3)]


# --- reverts and comments ------------------------------------------------------------------------------------------


def test_reverts_of_reverts(spark):
    """Chains, several reverters, shared reverters and cycles against a plain fixed point."""
    r = random.Random(6)
    edges = {("a", x, x - r.randint(1, 3)) for x in range(4, 40) if r.random() < 0.8} | {("a", 200 + k, 200 + (k + 1) % 4) for k in range(4)} | {("a", 300, 200), ("a", 301, 300)} | {("b", k + 1, k) for k in range(30)}
    stands, nodes = {}, {(g, n) for g, x, y in edges for n in (x, y)}
    while True:
        new = {}
        for g, n in nodes - stands.keys():
            by = [stands.get((g, x)) for h, x, y in edges if (h, y) == (g, n)]
            if any(by) or None not in by:
                new[g, n] = not any(by)
        if not new:
            break
        stands |= new
    df = spark.createDataFrame(sorted(edges), "repo string, revert_id long, reverted_id long")
    assert {(x.repo, x.commit_id) for x in clean.effectively_reverted(df).collect()} == {k for k, v in stands.items() if not v}


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], clean._cut
    monkeypatch.setattr(clean, "_cut", lambda df: rounds.append(1) or cut(df))
    df = spark.createDataFrame([("r", k + 1, k) for k in range(300)], "repo string, revert_id long, reverted_id long")
    assert {x.commit_id for x in clean.effectively_reverted(df).collect()} == set(range(299, -1, -2))
    assert len(rounds) < 40


def test_lines_as_rows_keep_their_state_across_chunks(spark):
    r = random.Random(1)
    pool = {"a.go": ["x", "// c", "/* o", "*/ y", "*/", "", "/* a */ b"], "b.py": ["x", "# c", '"""', "'''", '""" a """ b', " "], "c.rb": ["=begin", "=end", "y", "#"], "d.lua": ["--[[", "]] z", "-- q", "w"], "e.md": ["", "t"]}
    files = [(p, [r.choice(v) for _ in range(n)]) for p, v in pool.items() for n in (23,)] + [("f.go", [])]
    df = spark.createDataFrame(files, "path string, lines array<string>").withColumn("lang", paths.detect_lang(F.col("path")))
    want = {x.path: (x.f, x.n) for x in df.select("path", lines.skip_flags(F.col("lang"), F.col("lines")).alias("f"), lines.count_code_lines(F.col("lang"), F.col("lines")).alias("n")).collect()}
    assert all(n == f.count(False) for f, n in want.values())
    rows = df.select("path", "lang", F.posexplode("lines").alias("line_no", "line"))
    got = collections.defaultdict(dict)
    for x in lines.skipped_rows(rows, chunk=4).collect():
        got[x.path][x.line_no] = x.skipped
    assert {p: [v[k] for k in sorted(v)] for p, v in got.items()} == {p: f for p, (f, _) in want.items() if f}


def porcelain(seed, n):
    """A dump whose source lines miss some headers, and its (path, author, time, text) in order as a plain reader has them."""
    rng = random.Random(seed)
    out, rows, author, at, path = [], [], None, None, ""
    for i in range(n):
        if rng.random() < 0.8:
            author = rng.choice(["Ann", "Bob", "Cy", ""])
            out.append(f"author {author}")
        if rng.random() < 0.5:
            value = rng.choice([str(i), str(i), "x"])
            at = int(value) if value != "x" else at
            out.append(f"committer-time {value}")
        if rng.random() < 0.3:
            path = rng.choice(["a.go", "b.py", "c/d.go"])
            out.append(f"filename {path}")
        out.extend(["summary author Eve", "boundary"][: rng.randrange(3)])
        text = rng.choice(["x = 1", "y", "/* o", "*/ z", "// c", "# c", "", "\tfilename q.go"])
        out.append("\t" + text)
        if author:
            rows.append((path, author, at, text))
        author = None
    return "\n".join(out) + "\n", rows


def test_a_dump_is_read_by_many_tasks(spark, tmp_path):
    dump, rows = porcelain(3, 1200)
    files = collections.defaultdict(list)
    for r in rows:
        files[r[0]].append(r)
    df = spark.createDataFrame([(p, [r[3] for r in f]) for p, f in files.items()], "path string, lines array<string>")
    flags = {r.path: r.f for r in df.select("path", lines.skip_flags(paths.detect_lang(F.col("path")), F.col("lines")).alias("f")).collect()}
    want = sorted(((p, r[1], r[2]) for p, f in files.items() for r, s in zip(f, flags[p], strict=True) if not s), key=str)
    seconds = lambda df: sorted((tuple(r) for r in df.select("path", "author", F.unix_timestamp("committed_at")).collect()), key=str)
    (tmp_path / "r.txt").write_text(dump)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = readers.read_blame(spark, str(tmp_path))
        assert seconds(got) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "chunk" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    text = spark.createDataFrame([("r", dump)], "repo string, value string")
    for chunk in (1, 1 << 20):
        assert seconds(readers.parse_blame(text, chunk)) == want
    assert readers.parse_blame(text.limit(0)).count() == 0


def commit_graph(seed, n):
    """[(commit, its parents)], newest last, with forks, merges of two and three, and merges of merges."""
    rng, graph, tips = random.Random(seed), [(0, [])], [0]
    for i in range(1, n):
        main = rng.choice(tips[-4:])
        others = rng.sample([t for t in tips if t != main], min(len(tips) - 1, rng.choice([0, 0, 0, 1, 2])))
        graph.append((i, [main, *others]))
        tips = [t for t in tips if t not in others and (t != main or rng.random() < 0.3)] + [i]
    return graph


@pytest.mark.parametrize("seed", [1])
def test_what_merges_bring_in(spark, seed):
    want, merges, rows = set(), [], []
    for repo, graph in (("r", commit_graph(seed, 70)), ("s", commit_graph(seed + 10, 40))):
        reach = {}
        for c, up in graph:
            reach[c] = {c}.union(*(reach[u] for u in up))
            # The order may tie, as dates do.
            rows += [(repo, c, i + 1, u, u // 3) for i, u in enumerate(up)]
            if len(up) > 1:
                merges.append((repo, c))
                want |= {(repo, c, x) for x in reach[c] - reach[up[0]]}
    parents = spark.createDataFrame(rows, "repo string, commit_id long, pos int, parent_id long, parent_order long")
    got = clean.merge_branches(spark.createDataFrame(merges, "repo string, commit_id long"), parents).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want


def test_a_long_branch_takes_few_rounds(spark, monkeypatch):
    """A main line and a branch of 600 commits each: rounds grow with the logarithm, and blocks of a line meet."""
    n, rounds = 600, []
    for name in ("_cut", "materialize"):
        monkeypatch.setattr(clean, name, lambda df, cut=getattr(clean, name): rounds.append(1) or cut(df))
    monkeypatch.setattr(clean, "_BLOCK", 7)
    rows = [(2 * i + k, 1, max(2 * i + k - 2, 0), max(2 * i + k - 2, 0)) for i in range(1, n) for k in (0, 1)]
    rows += [(2 * n, 1, 2 * n - 2, 2 * n - 2), (2 * n, 2, 2 * n - 1, 2 * n - 1)]
    rows = [(c, pos, 0 if u == 1 else u, 0 if u == 1 else u) for c, pos, u, _ in rows]
    parents = spark.createDataFrame([("r", *x) for x in rows], "repo string, commit_id long, pos int, parent_id long, parent_order long")
    got = clean.expand_merge(spark.createDataFrame([("r", 2 * n)], "repo string, commit_id long"), parents)
    assert {x.commit_id for x in got.collect()} == {2 * n, *range(3, 2 * n, 2)}
    assert len(rounds) < 50


def test_the_walk_of_a_merge_covers_its_branch_only(spark, monkeypatch):
    """Branches of one commit merged into a long side line that is merged all along: no merge meets the earlier ones."""
    n, sizes = 90, []

    def counted(df, keep=clean.materialize):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clean, "materialize", counted)
    # 3i branches off the side line's 3i - 2, 3i + 1 merges it there, 3i + 2 merges that into the main line.
    ups = {c: ((c - 2,), (c - 3, c - 1), (c - 3, c - 1))[c % 3] for c in range(3, 3 * n)}
    rows = [("r", c, pos, u, u) for c, of in ups.items() for pos, u in enumerate(of, 1)]
    parents = spark.createDataFrame(rows, "repo string, commit_id long, pos int, parent_id long, parent_order long")
    merges = spark.createDataFrame([("r", 3 * i + 2) for i in range(1, n)], "repo string, commit_id long")
    got = {tuple(x) for x in clean.merge_branches(merges, parents).collect()}
    reach = {}
    for c in range(3 * n):
        reach[c] = {c}.union(*(reach[u] for u in ups.get(c, ())))
    assert got == {("r", c, x) for c in range(5, 3 * n, 3) for x in reach[c] - reach[c - 3]}
    assert max(sizes) < 12 * n


def shuffle_files(spark):
    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in at.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}


def test_a_step_leaves_no_shuffle_files(spark):
    """What is staged needs the disk of its table only, as soon as it is written; the session's setting stays."""
    before = shuffle_files(spark)
    kept = clean.materialize(spark.range(50000).groupBy((F.col("id") % 9973).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert kept.count() == 9973
    assert spark.conf.get(clean._CLEANUP, "false") == "false"
