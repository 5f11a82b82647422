"""Rows and pairs that a short cut once left out of the training-data operators' results."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from strata.llm import decontam, minhash, preference, suffix, toxicity


def test_pair_with_equal_low_bytes_is_looked_at():
    """Low bytes that agree in an earlier tree make no common region there: the pair counts where it shares one."""
    sig = np.random.default_rng(3).integers(0, 1 << 16, (1, minhash.TREES, minhash.DEPTH), np.uint16).repeat(2, axis=0)
    sig[1, 0, 0] ^= 0x0100
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc", "f1", "sig"])
    (trees,) = minhash._tree_rows(iter([rows]))
    region = trees.column("region").to_numpy().reshape(2, -1)
    assert (region[0] == region[1]).tolist() == [False] + [True] * (minhash.TREES - 1)
    looked = []
    for tree in range(minhash.TREES):
        t = trees.take(pa.array([tree, minhash.TREES + tree]))
        for name, value in (("block", t.column("region")), ("comp", t.column("doc")), ("probe", pa.array([True, True]))):
            t = t.append_column(name, value)
        found = [d for b in minhash._cross(0.8, None)(iter([t])) for d in b.column(0).to_pylist()]
        looked.append(found == [1, 2])
    assert looked == [False, True] + [False] * (minhash.TREES - 2)


def test_cut_class_keeps_its_share_of_the_votes(spark):
    """A word of 70 % of the toxic and 20 % of ten times as many clean texts tells for clean, whatever the bound on examples."""
    r = random.Random(5)
    rows = []
    for i in range(3300):
        label = int(i % 11 == 0)
        said = ["hint"] if r.random() < (0.7 if label else 0.2) else []
        rows.append((i, " ".join([*r.choices("abcdefgh", k=5), *said]), label))
    r.shuffle(rows)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = toxicity.build_index(docs, labels, examples=300)
    index = model.index
    assert (index.labels == 1).sum() == 300 and 200 < (index.labels == 0).sum() < 400
    assert len(index.vocabulary) == 9 and abs(index.rate - 1 / 11) < 0.01
    one = toxicity.score(spark.createDataFrame([(1, "hint"), (2, "a b")], docs.schema), model).collect()
    assert all(x.score < 0.5 for x in one)
    whole = toxicity.build_index(docs, labels).index
    assert set(whole.share) == {1.0} and np.allclose(index.factor, whole.factor, rtol=0.5, atol=1.5)


def test_pairs_of_large_ids(spark):
    """Ids that doubles can't tell apart, and negative ones."""
    ids = [(1 << 53) + k for k in range(4)] + [-2, -1, (1 << 63) - 2, (1 << 63) - 1]
    turns = spark.createDataFrame([(i, 0, "user", "a") for i in ids], "conv_id long, turn int, role string, text string")
    got = preference.format_preferences(turns).select("pair_id", "chosen_id", "rejected_id").collect()
    assert sorted(map(tuple, got)) == sorted((i >> 1, i, i + 1) for i in ids[::2])


def test_columns_of_internal_names_pass_through(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))
    names = ("_row", "_uid", "_spans", "_text", "_c0", "uid", "_group", "k0")
    rows = [(i, f"alpha{i} beta {i} gamma{i}. " + passage * (i in (1, 2)), "en", "s", 5, *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    whole = sorted((r.doc_id, *[r[n] for n in names]) for r in docs.collect())
    as_rows = lambda df: sorted((r.doc_id, *[r[n] for n in names]) for r in df.collect())
    spark.createDataFrame([("x", "nothing of these words is in any text")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns and set(as_rows(near)) <= set(whole)
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and as_rows(cut) == whole and sum(passage in r.text for r in cut.collect()) == 0
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and as_rows(clean) == whole
    bench = spark.createDataFrame([("x", passage), ("y", "gamma3")], "item_id string, text string")
    for size in (1 << 20, 10):
        found = decontam.contamination(docs, bench, pass_bytes=size, keep=("doc_id", *names))
        assert as_rows(found) == whole and {r.doc_id for r in found.collect() if r.n_hit} == {1, 2, 3}
