"""Readers on small dumps, and the streams that SQL can't check."""

import json

import pandas as pd

from strata.sources import readers
from strata.streaming import activity as live

LOG = """COMMIT:aaa|Ann|2024-01-02 10:00:00 +0100|fix: a | b

3\t1\tmain.go
-\t-\timg.png
2\t0\tnotes.md

diff --git a/main.go b/main.go
index 1..2 100644
--- a/main.go
+++ b/main.go
@@ -1,2 +1,3 @@
+// only a comment
+x := 1
-/* gone
-still gone */
 context
diff --git a/notes.md b/notes.md
--- a/notes.md
+++ b/notes.md
@@ -0,0 +1,2 @@
+# a
+
COMMIT:bad|x
COMMIT:bbb|Bob|2024-01-03 10:00:00 +0000|feat

1\t0\tsrc/{old => new}/f.py
"""


def test_commit_log(spark, tmp_path):
    (tmp_path / "repo1.txt").write_text(LOG)
    commits, changes = readers.read_commit_log(spark, str(tmp_path))
    got = {r.commit_id: (r.repo, r.author, str(r.committed_at), r.subject) for r in commits.collect()}
    assert got == {"aaa": ("repo1", "Ann", "2024-01-02 09:00:00", "fix: a | b"), "bbb": ("repo1", "Bob", "2024-01-03 10:00:00", "feat")}
    got = {(r.commit_id, r.path): (r.insertions, r.deletions) for r in changes.collect()}
    assert got == {("aaa", "main.go"): (1, 0), ("aaa", "img.png"): (0, 0), ("aaa", "notes.md"): (2, 0), ("bbb", "src/new/f.py"): (1, 0)}


def test_reverts(spark, tmp_path):
    (tmp_path / "r.txt").write_text("REVERT_RECORD:f1\nRevert x\n\nThis reverts commit abcdef1.\nThis reverts commit 1234567.\n---END_REVERT_RECORD---\nREVERT_RECORD:f2\nnothing\n---END_REVERT_RECORD---\n")
    rows = readers.read_reverts(spark, str(tmp_path))
    assert [(r.revert_id, r.reverted) for r in rows.collect()] == [("f1", "abcdef1")]
    commits = spark.createDataFrame([("r", "abcdef1234567"), ("r", "abcdef0")], "repo string, commit_id string")
    assert readers.resolve_hashes(rows, commits).first().reverted_id == "abcdef1234567"


def test_blame(spark, tmp_path):
    cell = lambda author, at, text: f"{'a' * 40} 1 1 1\nauthor {author}\ncommitter-time {at}\nfilename m.go\n\t{text}\n"
    (tmp_path / "r.txt").write_text(cell("Ann", 100, "x := 1") + cell("Bob", 200, "// no") + cell("Bob", 300, "y := 2"))
    rows = readers.read_blame(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.author, r.committed_at.timestamp()) for r in rows) == [("m.go", "Ann", 100), ("m.go", "Bob", 300)]


def test_manifest_and_changed_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "r.txt").write_text("100644 blob abc     120\ta.go\n160000 commit def       -\tsub\n\nb.go\n")
    assert sorted((r.path, r.size_bytes) for r in readers.read_manifest(spark, str(tmp_path / "m")).collect()) == [("a.go", 120), ("b.go", None), ("sub", None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "r.txt").write_text(":100644 100644 a b M\tx.go\n:160000 160000 a b M\tsub\n")
    assert [r.path for r in readers.read_changed_files(spark, str(tmp_path / "c")).collect()] == ["x.go"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "k8s.json").write_text(json.dumps({"domains": [{"domain": "BE", "members": [{"member": "Ann", "impact": 50.5, "commits": 3, "gravity": 9}]}]}))
    (tmp_path / "k8s-timeline.json").write_text("{}")
    assert [(r.repo, r.author, r.impact) for r in readers.read_scores(spark, str(tmp_path)).collect()] == [("k8s", "Ann", 50.5)]
    gt = tmp_path / "gt"
    gt.mkdir()
    (gt / "k8s.json").write_text(json.dumps({"top_contributors": [{"login": "bot", "type": "Bot"}, {"login": "ann", "contributions": 4, "type": "User"}], "release_authors": ["ann"], "architect_candidates": []}, indent=2))
    assert [(r["rank"], r.login, r.release_authors) for r in readers.read_ground_truth(spark, str(gt)).collect()] == [(1, "ann", ["ann"])]
    tl = tmp_path / "tl.json"
    tl.write_text(json.dumps({"periods": [{"label": "P1"}], "authors": [{"author": "Ann", "periods": [{"label": "P1", "impact": 2.0, "role": "Anchor"}]}]}))
    assert [(r.author, r.period, r.role) for r in readers.read_timeline(spark, str(tl)).collect()] == [("Ann", "P1", "Anchor")]


def events(spark, tmp_path, days):
    at = tmp_path / "events.parquet"
    at.mkdir()
    base = pd.Timestamp("2024-01-01")
    df = pd.DataFrame({"event_id": range(len(days)), "ts": [base + pd.Timedelta(days=d) for d in days], "user_id": [i % 2 for i in range(len(days))], "event_type": "x", "value": 1.0})
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(at / "a.parquet")
    return str(tmp_path)


def test_stream_equals_batch(spark, tmp_path):
    sf = events(spark, tmp_path, [0, 1, 8, 9, 40, 41])
    stream = live.drain(live.period_axes(live.stream_activity(spark, sf)), "append", "t")
    batch = live.period_axes(live.activity(spark.read.parquet(f"{sf}/events.parquet")))
    closed = batch.where("period_end <= timestamp'2024-02-10'")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, closed.collect()))


def test_complete_periods_are_written_once(spark, tmp_path):
    sf, out = events(spark, tmp_path, [0, 1, 8, 40]), str(tmp_path / "out")
    for _ in range(2):
        live.write_complete_periods(live.period_axes(live.stream_activity(spark, sf)), out, str(tmp_path / "ckpt")).awaitTermination()
    rows = live.KeyLedger(spark, out).read(live.period_axes(live.stream_activity(spark, sf)).schema).collect()
    assert len(rows) == len({(r.period_start, r.author) for r in rows}) > 0
