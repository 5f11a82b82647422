"""Operators that SQL can't express against plain versions of their mathematics, and the pipeline's stages on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import decontam, langid, quality, topk
from strata.llm.decontam import _MERGED
from test_llm import DOCS, odd_texts, table


def test_folded_network_is_a_convolution():
    """The look-up tables give what embedding, convolution, max pooling and softmax give position by position."""
    r = np.random.default_rng(5)
    net = langid.Network(3)
    for k in net.p:
        net.p[k] = r.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    x = r.integers(0, 256, (300, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w in langid.WIDTHS:
        out = np.full((len(x), langid.FILTERS), -np.inf)
        for at in range(langid.WINDOW - w + 1):
            patch = net.p["e"][x[:, at : at + w]].reshape(len(x), -1)
            out = np.maximum(out, patch.astype(float) @ net.p[f"w{w}"] + net.p[f"b{w}"])
        pooled.append(np.maximum(out, 0))
    z = np.concatenate(pooled, axis=1) @ net.p["v"] + net.p["c"]
    direct = np.exp(z - z.max(axis=1, keepdims=True))
    direct /= direct.sum(axis=1, keepdims=True)
    assert np.allclose(langid.classify(net.tables(), x), direct, atol=1e-4)


def test_gradients():
    """Backpropagation against differences of the loss."""
    net, r = langid.Network(2), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(97, 105, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1])

    def loss():
        p = langid.classify(net.tables(), x).astype(float)
        return -np.log(p[np.arange(4), y]).mean()

    g = net.step(x, y)
    for k in ("v", "c", "w2", "w4", "b3"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        down = loss()
        net.p[k][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=0.05, abs=1e-3)


def test_language_of_every_window(spark, monkeypatch):
    """A text's probability is the mean over all its windows, however many; repeats agree, other columns don't matter."""
    net, r = langid.Network(2), random.Random(3)
    for k in net.p:
        net.p[k] = np.random.default_rng(8).normal(0, 0.4, net.p[k].shape).astype(np.float32)
    texts = ["a", "b" * 128, "c" * 129, "".join(r.choices("abcé ", k=300_000)), "é" * 200, "", None, "12"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = langid.identify(table(spark, rows), ["en", "fr"], net.tables()).collect()
    assert len(got) == len(rows)
    for x in got:
        raw = (texts[x.doc_id] or "").encode()
        if x.doc_id in (5, 6, 7):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        padded = np.frombuffer(raw + bytes(-len(raw) % langid.WINDOW), np.uint8).reshape(-1, langid.WINDOW)
        p = langid.classify(net.tables(), padded).astype(float).mean(axis=0)
        assert x.lang_pred == ["en", "fr"][int(p.argmax())] and x.score == pytest.approx(float(p.max()), abs=1e-6)
    assert langid.identify(table(spark, rows).limit(0), ["en", "fr"], net.tables()).count() == 0


def test_discriminant_is_the_log_density(spark):
    """Scores against densities from the covariances themselves, without Cholesky factors."""
    r = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    mix = r.normal(0, 1, (d, d))
    x = np.concatenate([r.normal(0, 1, (60, d)) @ mix, r.normal(0.4, 1.5, (90, d))])
    y = np.repeat([0, 1], [60, 90])
    model = quality.Discriminant(x, y)
    t = np.sign(x) * np.sqrt(np.abs(x))
    center, scale = t.mean(axis=0), t.std(axis=0) + 1e-6
    t = (t - center) / scale
    groups = [t[y == k] for k in (0, 1)]
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / len(t)
    density = []
    asked = np.concatenate([x, r.normal(0, 3, (50, d))])
    q = (np.sign(asked) * np.sqrt(np.abs(asked)) - center) / scale
    for g in groups:
        c = (1 - quality.POOLED) * np.cov(g.T, bias=True) + quality.POOLED * pooled
        c = (1 - quality.IDENTITY) * c + quality.IDENTITY * np.trace(c) / d * np.eye(d)
        m = q - g.mean(axis=0)
        density.append(-0.5 * (m * np.linalg.solve(c, m.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(c)[1])
    difference = density[1] - density[0]
    root = np.sign(difference) * np.sqrt(np.abs(difference))
    assert np.allclose(model.score(asked), 1 / (1 + np.exp(-np.clip(model.slope * root + model.shift, -30, 30))), atol=1e-9)


def test_quality_statistics_by_hand(spark):
    text = "Go go, GO!\nline two x1\nline two x1\né"
    (x,) = quality.statistics(pa.array([text]))
    s = dict(zip(quality.STATISTICS, x[0], strict=True))
    raw, words = text.encode(), [w.lower() for w in text.split()]
    assert s["bytes"] == pytest.approx(np.log1p(len(raw)))
    for name, member in (("upper", str.isupper), ("digit", str.isdigit), ("line", lambda c: c == "\n"), ("space", lambda c: c == " "), ("bang", lambda c: c == "!")):
        assert s[name] == pytest.approx(sum(map(member, text if name != "upper" else text.replace("é", ""))) / len(raw))
    assert s["words"] == pytest.approx(np.log1p(len(words))) and s["distinct"] == pytest.approx(len(set(words)) / len(words))
    assert s["line_repeat"] == pytest.approx(1 - 3 / 4) and s["word_repeat"] == 0 and s["capital_word"] == pytest.approx(2 / 10)
    assert s["short"] == pytest.approx(sum(len(w.encode()) <= 3 for w in words) / len(words))


def test_quality_on_odd_rows(spark):
    """Null, empty and long texts have scores; repeats agree; ties and extra columns don't matter; empty tables are empty."""
    docs = table(spark, [*odd_texts(), (50, "word " * 200_000)])
    labels = spark.createDataFrame([*((i, i % 2, 9.0) for i in range(17)), (None, 1, 0.0), (3, None, 0.0), (3, 1, 0.0)], "doc_id long, label int, score double")
    stats = quality.document_statistics(docs)
    rows = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1 and len({r.score for r in rows if r.doc_id == 6}) == 1
    assert quality.score(quality.document_statistics(docs.limit(0)), quality.fit(stats, labels)).count() == 0


def test_hits_of_several_passes_are_maximal(spark):
    text = " ".join(f"w{i}" for i in range(60))
    w = text.split()
    bench = spark.createDataFrame([("a", " ".join(w[0:14])), ("b", " ".join(w[8:22])), ("c", " ".join(w[40:50]))], "item_id string, text string")
    for size in (1 << 20, 20):
        r = decontam.contamination(table(spark, [(1, text)]), bench, pass_bytes=size).first()
        assert [(h.first, h.after) for h in r.hits] == [(0, 22), (40, 50)] and r.n_hit == 32
    one = spark.sql("SELECT array(named_struct('first', 5L, 'after', 9L), named_struct('first', 0L, 'after', 5L), named_struct('first', 20L, 'after', 21L)) AS hits").select(F.expr(_MERGED).alias("m")).first().m
    assert [tuple(x) for x in one] == [(0, 9), (20, 21)]


@pytest.mark.parametrize("size", [1e13, 1e30, 1e300])
def test_components_of_any_size(spark, size):
    vectors = [(0, [size, 0.0]), (1, [0.001, 1.0]), (2, [-0.002, 0.5]), (3, [0.0, 2.0]), (4, [0.5, 0.25])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = df.where("vec_id = 3")
    got = [tuple(r) for r in topk.top_k(df, asked, k=5).orderBy("rank").collect()]
    whole = {i: [int(np.floor(x * 1024)) if abs(x) < 2**50 else int(x) * 1024 for x in v] for i, v in vectors}
    best = sorted((-sum(a * b for a, b in zip(whole[3], whole[i], strict=True)), i) for i in whole if i != 3)
    assert got == [(3, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, spark.createDataFrame([(10, [size, 0.0])], df.schema), k=5).collect()


def test_own_rows_take_no_places(spark, monkeypatch):
    """A query's own vec_id occurs many times in a block; its best others are found all the same."""
    vectors = [(0, [1.0])] * 40 + [(i, [0.5 - i / 100]) for i in range(1, 20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0").limit(1), k=3).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def pipeline_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 0.5, "x") for i, t, lang in rows], DOCS)


def prose(r, words, n):
    return " ".join(r.choices(words, k=n))


EN, DE = "the of and to in that was for with his river house".split(), "der die und das nicht ein ist mit auf haus wasser über".split()


def test_pipeline_stages_decide_on_rows(spark, tmp_path):
    """Null and repeated doc_ids are rows of their own; a row goes for its own text only; other columns stay."""
    import corpus_pipeline as p

    r = random.Random(1)
    item = prose(r, EN, 14)
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b, c = (prose(r, EN, 80) for _ in range(3))
    rows = [(None, a + " " + item, "en"), (1, a + " " + item, "en"), (1, b, "en"), (None, c, "en"), (2, b, "en"), (2, b, "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, prose(r, DE, 60), "de"), (7, prose(r, EN, 60_000), "en")]
    docs = pipeline_table(spark, rows)
    clean = p.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(str(x) for x in docs.collect() if item not in (x.text or ""))
    kept = p.near_dedup(spark, docs, "").collect()
    texts = [x.text for x in kept]
    assert texts.count(b) == 1 and texts.count(a + " " + item) == 1 and len(kept) == len(rows) - 3
    assert next(x.doc_id for x in kept if x.text == a + " " + item) == 1 and next(x.doc_id for x in kept if x.text == b) == 1
    named = p.language_id(spark, docs, "")
    gone = [x for x in docs.collect() if not any(ch.isalpha() for ch in x.text or "")]
    assert named.columns == docs.columns and named.count() == len(rows) - len(gone) == 8
    cut = p.suffix_dedup(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == len(rows) and cut.where("text is null").count() == 1
    assert all(x.n_chars == len(x.text) for x in cut.collect() if x.text is not None)
    packed = p.pack(spark, docs, "")
    assert packed.where("start = 0").count() == len(rows)


def test_pipeline_without_labels_or_rows(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(2)
    docs = pipeline_table(spark, [(i, prose(r, EN, 30), None) for i in range(5)])
    assert p.language_id(spark, docs, "").count() == 5
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, step in p.STAGES:
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert p.decontaminate(spark, docs, str(tmp_path)).count() == 5


def test_pipeline_equals_its_operators(spark, tmp_path):
    """The whole run against a plain version of each decision: sets of words, byte strings, windows, and the tokenizer."""
    import collections
    import zlib

    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from strata.llm import queries

    r = random.Random(4)
    item = prose(r, EN, 12)
    passage = prose(r, EN, 70)
    base = [prose(r, EN, 100) for _ in range(6)]
    texts = [*base, base[0], base[1] + " extra", base[2] + " " + item, "123 456", passage + " " + prose(r, EN, 40), prose(r, EN, 50) + " " + passage, *(prose(r, DE, 90) for _ in range(4))]
    rows = [(i, t, "de" if "über" in t else "en") for i, t in enumerate(texts)]
    at = tmp_path / "sf"
    pipeline_table(spark, rows).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(at / "benchmark.parquet"))
    left = {i: t for i, t, _ in rows if any(c.isalpha() for c in t)}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in left.items()}
    group = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    left = {i: t.encode() for i, t in left.items() if group[i] == i}
    count = collections.Counter(t[k : k + 200] for t in left.values() for k in range(len(t) - 199))
    for i, t in left.items():
        hit = {x for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for x in range(k, k + 200)}
        left[i] = bytes(c for x, c in enumerate(t) if x not in hit).decode("utf-8", "ignore")
    left = {i: t for i, t in left.items() if f" {item} " not in f" {' '.join(t.split())} " and not any(" ".join(item.split()[k : k + 10]) in t for k in range(3))}
    tokenizer = Tokenizer.from_file(queries.tokenizer())
    want = {(i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in left.items()}
    assert {(x.doc_id, x.ids_crc32) for x in p.run(spark, str(at)).collect()} == want
