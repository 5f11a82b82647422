"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing column names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import components, decontam, langid, minhash, packing, preference, quality, queries, suffix, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, kept string"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))


def table(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, 0.5, "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    base = prose(120)
    near = [" ".join(w if r.random() > 0.01 else "zz" for w in base.split()) for _ in range(8)]
    texts = [None, "", " \n\t", "one", "One", "two words", base, base.upper(), *near, prose(60), prose(3000), base + " " + prose(200)]
    return list(enumerate(texts)) + [(6, base), (30, "one")]


def test_near_duplicates(spark):
    docs = odd_texts()
    sets, parent = collections.defaultdict(list), {i: i for i, _ in docs}
    for i, t in docs:
        w = words(t)
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, v in sets.items() for s in v], 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(table(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == find(r.doc_id) and r.kept == (r.component_id == r.doc_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert minhash.near_duplicates(table(spark, docs).limit(0)).count() == 0


def test_null_ids_stand_alone(spark):
    got = minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (1, 1, True)]


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    """The driver's plans of the residual blocks read each table a few times, and stars take no round to be seen as such."""
    plans, rounds, blocks, star = [], [], minhash._blocks, components._star

    def seen(*args):
        out = blocks(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return out

    monkeypatch.setattr(minhash, "_blocks", seen)
    minhash.near_duplicates(table(spark, odd_texts())).count()
    assert plans and max(plans) <= 8
    monkeypatch.setattr(components, "_star", lambda *args: rounds.append(1) or star(*args))
    got = components.components(spark.createDataFrame([(1, 2), (3, 1), (9, 8), (2, 1)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert not rounds
    assert components.components(spark.createDataFrame([(1, 2), (3, 2), (9, 8), (9, 3)], "a long, b long").where("a > 0")).where("component_id = 1").count() == 5
    assert rounds


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60) if i % 7] + [(r.randint(100, 140), r.randint(100, 140)) for _ in range(40)] + [(5, 5), (1, 0)]
    parent = {x: x for e in links for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component_id for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links for x in (a, b) if a != b}


def test_decontamination(spark):
    texts = odd_texts()
    base = texts[6][1]
    bench = spark.createDataFrame([("b", " ".join(base.split()[10:40])), ("a", "One"), ("c", None), ("d", " .. "), ("b", base[:60])], "item_id string, text string")
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    find = lambda t: pattern.findall((t or "").encode().translate(LOW))
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = find(r.text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(r.item_id)
    expected = []
    for i, t in texts:
        w, hit, items = find(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    items |= found
        expected.append((i, len(w), len(hit), sorted(items)))
    for size in (1 << 20, 50):  # one pass, and one for each item or so
        got = decontam.contamination(table(spark, texts), bench, pass_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(expected)
    assert decontam.contamination(table(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_multikey_sort():
    r = random.Random(6)
    for alphabet in (b"ab", bytes(range(4)), b"abcdefgh"):
        data = bytes(r.choices(alphabet, k=3000))
        start = np.array([r.randint(0, 2700) for _ in range(400)] + [5, 5, 5])
        size = np.array([r.choice([0, 1, 7, 8, 9, 60, 200, 300]) for _ in range(400)] + [40, 40, 30])
        order, lcp = suffix.multikey_sort(np.frombuffer(data + bytes(8), np.uint8), start, size)
        own = [data[start[i] : start[i] + size[i]] for i in order]
        assert [x.ljust(300, b"\0") for x in own] == sorted(x.ljust(300, b"\0") for x in own)
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: E731, B905
        assert lcp.tolist() == [0] + [common(x, y) for x, y in itertools.pairwise(own)]
        for length in (1, 8, 9, 50):
            of = collections.defaultdict(set)
            for i, k in enumerate(suffix._classes(order, lcp, length)):
                if size[i] >= length:
                    of[data[start[i] : start[i] + length]].add(int(k))
            assert all(len(k) == 1 for k in of.values()) and len(set.union(*of.values())) == len(of)


@pytest.mark.parametrize("bucket", [3, 40, 8192])
def test_repeated_substrings(spark, monkeypatch, bucket):
    """Small buckets cut common grams: their strings are compared across boundaries."""
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    r = random.Random(2)
    passage = "".join(r.choices("abc dé", k=260))
    texts = [None, "", "short", passage, "x" + passage[:-1] + "y", "q" * 450, passage[:100] + "".join(r.choices("abc", k=300)), "".join(r.choices("xyz", k=500)) + passage + passage]
    line = "".join(r.choices("lmnop ", k=70))
    texts += ["".join(r.choices("abcdef", k=r.randint(80, 200))) + line + "".join(r.choices("abcdef", k=r.randint(80, 200))) for _ in range(60)]
    texts += [x[r.randint(0, 60) :] + "".join(r.choices("xyz", k=50)) for x in texts[10:30]] + ["\0" * 600, "ab\0" * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, passage)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    expected = []
    for i, b in raw:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit[k : k + 200] = True
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        expected.append((i, len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    docs = table(spark, rows)
    got = suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and out.where("text is null").count() == 1


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 200
    pages = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (1, "u", None), (3, "u", ""), (4, "u", "small"), (6, "u", "small"), (2, "again", big), (7, "u", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write_archives(df, roll_bytes=300)
    assert manifest.count() > 1
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.read_archives(spark, folder, manifest).collect())
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h, i)
    expected = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h] != i
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else -1))
    assert got == sorted(expected)
    assert warc.read_archives(spark, *warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.3, (40, 5)))]
    vectors += [(50, vectors[0][1]), (51, vectors[0][1]), (51, vectors[0][1]), (52, None), (53, [1.0, None, 0.0, 0.0, 0.0]), (54, [float("nan")] * 5), (None, [0.0] * 5), (55, [0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = [(i, np.floor(np.array(v + [0.0] * (5 - len(v))) * 1024).astype(int)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for q, x in usable:
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for i, y in usable if i != q)[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 10 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = odd_texts() + [(40, "İi. It's, don't.. 漢字,<|endoftext|>. Ünï\r\nx"), (41, "word. " * 9000)]
    got = packing.pack(table(spark, texts), queries.tokenizer()).collect()
    tokenizer, expected = Tokenizer.from_file(queries.tokenizer()), []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected += [(i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(expected)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(table(spark, texts).limit(0), queries.tokenizer()).count() == 0


def test_word_ids_are_the_tokenizers(monkeypatch):
    """Texts of awkward parts (added tokens in any case, marks, contractions, wide letters) get the tokenizer's own ids."""
    from tokenizers import Tokenizer

    r, path = random.Random(7), queries.tokenizer()
    tokenizer, ids = Tokenizer.from_file(path), packing.WordIds(path)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", " ", "\n", "\r", "\t", "'s", "'S", "'ll", "'", "’s", ".", ",", "?", "...", "***",
             "a", "B", "é", "É", "ß", "ẞ", "İ", "ı", "ﬁ", "漢", "1", "23", "½", "ª", "µ", "×", "\xa0", "\x85", "\u0301", "Ǆ", "word", "Word", "don't", "\x00", "\x1c", "\xad", "\u200b", "😀", "\u2126"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(4000)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 500)  # the cache turns over several times
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 50) for x in ids.of(texts[i : i + 50])] == want
    monkeypatch.setattr(packing, "TEXT_PART", 100)
    long = " ".join(texts[:200])
    assert ids.of_long(long) == np.array(tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_histogram_packing():
    r = random.Random(5)
    counts = collections.Counter(min(4096, int(r.expovariate(1 / 400)) + 1) for _ in range(20000))
    patterns = packing.pack_histogram(counts, 4096)
    used = collections.Counter()
    for n, sizes in patterns:
        assert sum(sizes) <= 4096
        for s in sizes:
            used[s] += n
    assert used == counts
    assert sum(s * n for s, n in counts.items()) / (4096 * sum(n for n, _ in patterns)) > 0.97


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "b"), (1, 3, "assistant", None),
            (2, 0, None, None), (3, 0, None, None), (4, 0, "user", "alone"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {0, 1}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[0].prompt == turn("user", "hi") + turn("assistant", "yo") and got[0].n_prompt_turns == 2
    assert got[0].chosen == turn("user", "a") and got[0].rejected == turn("user", "b") + turn("assistant", "")
    assert got[0].chosen_mask == [] and [got[0].rejected[m.start : m.end] for m in got[0].rejected_mask] == ["<|im_end|>\n"]
    assert got[1].chosen == got[1].rejected == "" and got[1].prompt == turn("unknown", "")
    pairs = spark.createDataFrame([(7, 1, 0), (8, 1, 99)], "pair_id long, chosen_id long, rejected_id long")
    swapped = preference.format_preferences(df, pairs).collect()
    assert [(r.pair_id, r.chosen == got[0].rejected) for r in swapped] == [(7, True)]
    assert preference.format_preferences(df.limit(0)).count() == 0


def test_classifiers_learn(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = queries.op2_language_id(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    for query, label, floor in ((queries.op6_quality, "quality", 0.97), (queries.op7_toxicity, "toxic", 0.95)):
        rows = query(spark, "/root/testdata/sf0.1").where("held_out").join(labels.select("doc_id", F.col(label).alias("y")), "doc_id")
        assert rows.agg(F.avg((F.col("y") == F.col("predicted")).cast("int"))).first()[0] > floor


def test_classifiers_on_odd_rows(spark):
    docs = table(spark, odd_texts())
    langs, model = langid.train(docs.limit(0))
    assert (langs, model) == ([], None)
    rows = langid.identify(docs, *langid.train(docs)).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score(quality.document_statistics(docs), quality.fit(quality.document_statistics(docs), none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.build_index(docs, none)).collect()} == {0.5}


def toxicity_by_hand(examples, text, weights=(1.0, 1.0), by_relevance=True, k=toxicity.NEIGHBOURS):
    """(sorted cosines of the k nearest, vote) from whole TF-IDF vectors of the texts, without an index."""
    count = lambda t: collections.Counter(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW)))
    rows = [(count(t), y) for t, y in examples]
    share = [weights[y] for _, y in rows]
    n, n1 = sum(share), sum(w for w, (_, y) in zip(share, rows, strict=True) if y)
    n0 = n - n1

    def factor(t):
        a = sum(w for w, (c, y) in zip(share, rows, strict=True) if y and t in c)
        b = sum(w for w, (c, y) in zip(share, rows, strict=True) if not y and t in c)
        idf = np.log((n + 1) / (a + b + 1)) + 1
        a, b = a + n1 / n, b + n0 / n
        return idf * abs(np.log(a / n1) - np.log(b / n0)) / np.sqrt(1 / a + 1 / b) if by_relevance else idf

    known = {t: factor(t) for t in set().union(*(c for c, _ in rows), count(text))}

    def vector(c):
        v = {t: (1 + np.log(m)) * known[t] for t, m in c.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    q = vector(count(text))
    cosine = [round(sum(x * v.get(t, 0) for t, x in q.items()), 6) for v in (vector(c) for c, _ in rows)]
    best = sorted((-c, i) for i, c in enumerate(cosine) if c > 0)[:k]
    w = [(-c * share[i], rows[i][1]) for c, i in best]
    rate = (n1 + 0.5) / (n + 1)
    return [-c for c, _ in best], (sum(x * y for x, y in w) + toxicity.PRIOR * rate) / (sum(x for x, _ in w) + toxicity.PRIOR)


@pytest.mark.parametrize("by_relevance", [True, False])
def test_toxicity_is_exact(spark, monkeypatch, by_relevance):
    """Cosines, votes and scores against whole vectors made by hand, over several blocks, full rows and short ones."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "STEP", 300)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(vocabulary[min(59, int(r.expovariate(0.08)))] for _ in range(n))
    texts = [pick(r.randint(1, 12)) + (" bad" * r.randint(1, 3) if i % 4 == 0 and r.random() < 0.8 else "") for i in range(120)]
    labels = [int(i % 4 == 0) for i in range(120)]
    asked = [*texts[:10], None, "", " .. ", "new words only", "Bad BAD bad", "é ünï w1", *(pick(r.randint(1, 80)) + " unseen" for _ in range(30)), pick(30000)]
    docs = table(spark, [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(asked)), (1000, asked[0]), (None, "w1")])
    known = spark.createDataFrame([*((i, y, 5) for i, y in enumerate(labels)), (None, 1, 5), (3, None, 5), (99999, 1, 5)], "doc_id long, label int, score int")
    model = toxicity.build_index(docs, known, by_relevance=by_relevance)
    index = model.index
    assert sorted(index.ids.tolist()) == list(range(120)) and index.blocks == 15 and 0 < index._often[-1] < len(index.vocabulary)
    got = [x for x in toxicity.score(docs, model).collect() if x.doc_id is not None and x.doc_id >= 1000]
    assert len(got) == len(asked) + 1
    for x in got:
        cosines, vote = toxicity_by_hand(list(zip(texts, labels, strict=True)), asked[x.doc_id - 1000], by_relevance=by_relevance)
        assert np.allclose([e.cosine for e in x.evidence], cosines, atol=2e-6)
        assert all(e.label == labels[e.doc_id] for e in x.evidence)
        assert abs(x.score - float(toxicity.probability(np.array([vote]), model.calibration)[0])) < 0.02 or len(cosines) == toxicity.NEIGHBOURS and cosines[-1] in (cosines[-2], x.evidence[-1].cosine)
    none = {x.score for x in got if not x.evidence}
    assert len(none) == 1 and {x.doc_id for x in got if not x.evidence} >= {1010, 1011, 1012, 1013}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_bounds_its_examples(spark):
    texts = [(i, f"w{i} common " * 50) for i in range(400)] + [(400, "long " * 300_000)]
    docs, known = table(spark, texts), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, label int")
    by_rows, by_bytes = toxicity.build_index(docs, known, examples=50), toxicity.build_index(docs, known, class_bytes=30_000)
    assert all(60 < len(m.index.ids) < 140 and 400 not in m.index.ids for m in (by_rows, by_bytes))
    one = toxicity.build_index(docs, known.where("label = 1"))
    assert all(x.score > 0.9 for x in toxicity.score(docs, one).collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == columns, name
    assert 0 < docs.count() <= texts
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
