"""Spelling variants, line dedup and collocations against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing column names."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import bloom, lines, phrases, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, score double, key string, row long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, 7, "x", 0.5, "y", 3) for r in rows], DOCS)


# --- spelling variants ---------------------------------------------------------------------------------------------


def brute_words(rows, every=97, least=5, count=3):
    n = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: c for w, c in n.items() if c >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, **options):
    n = brute_words(rows, **options)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], -1)) for w in n)


def variants(spark, rows, **options):
    got = spelling.spelling_variants(table(spark, rows), **options).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got)


def spelled(seed=3):
    r = random.Random(seed)
    letters = "abcdeéÉ×ñ"
    base = ["".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(60)]
    vocabulary = list(base)
    for w in base:
        for _ in range(3):
            i = r.randrange(len(w))
            vocabulary.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[i:] + w[:i]]))
    rows = [(i, " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=r.randint(0, 80)))) for i in range(60)]
    long = "ab" * 100
    rows += [(200, None), (201, ""), (202, " 1 ... "), (None, "abcde ABCDE"), (203, "abcde-abcdé_Abcde"), (203, "abcde-abcdé_Abcde"), (204, "z" * 5), (205, "Zzzzz zzzzz")]
    return rows + [(206, f"{long} {long} {long}"), (207, f"{long}a {long}a {long}a {long}a {long}a {long}a"), (208, "chaina " * 4 + "chainb " * 10 + "chaicb " * 25 + "chadcb " * 60)]


def test_spelling_variants(spark):
    rows = spelled()
    assert variants(spark, rows) == brute_variants(rows)
    assert variants(spark, rows, delete_every=2) == brute_variants(rows, every=2)
    assert variants(spark, rows, delete_every=None) == brute_variants(rows, every=None)
    assert any(r[1] and r[2] != r[1] for r in brute_variants(rows)), "a chain of forms"
    assert spelling.spelling_variants(table(spark, rows).limit(0)).count() == 0


def test_split_blocks_give_the_same(spark, monkeypatch):
    """Many tiles a block, empty ones among them, and tiles of one word."""
    rows = spelled(8)
    for size, letters in ((3, 4 << 20), (2048, 8)):
        monkeypatch.setattr(spelling, "TILE", size)
        monkeypatch.setattr(spelling, "TILE_LETTERS", letters)
        assert variants(spark, rows) == brute_variants(rows)


def test_gram_blocks():
    r = random.Random(2)
    for size in (1, 5, 60, 3000):  # beyond 2048 letters squares pass 24 bits
        base = "".join(r.choices("abç", k=size))
        put = lambda w, i, c: w[:i] + c + w[i:]
        a = sorted({base, *(put(base[:i] + base[i + 1 :], r.randrange(size), r.choice("abç")) for i in r.choices(range(size), k=40))})
        b = sorted({put(w, r.randrange(size + 1), r.choice("abç")) for w in a for _ in range(3)})
        i, j = spelling.near_pairs(a, b)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if one_edit(a[x], b[y])]
        i, j = spelling.near_pairs(a, None)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x, y in itertools.combinations(range(len(a)), 2) if one_edit(a[x], a[y])]


def test_joined_crc():
    r = random.Random(5)
    crc = spelling._Crc()
    pairs = [(r.randbytes(r.randint(0, 9)), r.randbytes(r.randint(0, crc.LONGEST))) for _ in range(300)]
    got = crc.joined(*(np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)), np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# --- line dedup ----------------------------------------------------------------------------------------------------


def brute_lines(rows, chars=40, docs=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    less = lambda i: (i is not None, i or 0)
    holders = collections.defaultdict(list)
    for doc, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc)
    keeper = {k: max(v, key=less) for k, v in holders.items() if len(k) >= chars and len(v) >= docs}
    out = []
    for doc, text, *_ in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((str(doc), len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def lined():
    r = random.Random(7)
    common = ["".join(r.choices("abcdé XYZ", k=n)) + "e" for n in (38, 39, 40, 60, 60, 200)]
    rows = []
    for i in range(40):
        part = [r.choice([x, x.upper() if r.random() < 0.1 else x, " \t" + x + "\r", x[:-1] + str(r.randint(0, 40))]) for x in r.choices(common, k=r.randint(0, 4))]
        own = ["".join(r.choices("pqrs t", k=r.randint(0, 90))) for _ in range(r.randint(0, 5))]
        text = part + own
        r.shuffle(text)
        rows.append((i, "\n".join(text)))
    only = common[4] + "!" * 20
    rows += [(100 + i, only) for i in range(6)] + [(100, only + "\n" + only), (None, only), (120, None), (121, ""), (122, "\n\n"), (123, ("x" * 50 + "\n") * 3000)]
    return rows + [(None, "y" * 41), (None, "y" * 41), (None, "y" * 41), (None, "y" * 41), (None, "y" * 41)]


@pytest.mark.parametrize("held", [lines.HELD_BYTES, 0])
def test_line_dedup(spark, held):
    """Repeated lines broadcast, and joined with their rows."""
    rows = lined()
    want = brute_lines(rows)
    assert sum(x[2] for x in want) > 20
    got = lines.drop_repeated_lines(table(spark, rows), held_bytes=held).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in got) == want
    assert lines.drop_repeated_lines(table(spark, rows).limit(0), held_bytes=held).count() == 0
    kept = lines.drop_repeated_lines(table(spark, rows), keep=("doc_id", "row", "key"), held_bytes=held)
    assert kept.columns == ["doc_id", "row", "key", "text", "n_lines", "n_dropped"] and kept.select("row", "key").distinct().collect() == [(3, "y")]


def test_full_filter_only_suspects_more(spark, monkeypatch):
    monkeypatch.setattr(bloom.Bits, "has", lambda self, h: np.ones(len(h), bool))
    rows = lined()
    got = lines.drop_repeated_lines(table(spark, rows).coalesce(1)).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in got) == brute_lines(rows)


def test_bloom_filters(spark):
    r = np.random.default_rng(1)
    values = r.integers(-(1 << 63), 1 << 63, 4000)
    rows = spark.createDataFrame([(int(h), 1) for h in values] + [(int(h), 1) for h in values[:500]] + [(int(h), 2) for h in values[500:600]], "h long, n long")
    for bits in (1 << 20, 1 << 22):
        once, twice = bloom.build(rows, bits), bloom.build(rows, bits, times=2)
        h = values.view(np.uint64)
        assert once.has(h).all() and twice.has(h[:600]).all() and twice.has(h[600:]).mean() < 0.01
        assert once.has(r.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.01
    assert not bloom.build(rows.limit(0), 1 << 20).has(values.view(np.uint64)).any()


# --- collocations --------------------------------------------------------------------------------------------------


def brute_phrases(rows, least=30, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for _, text, *rest in rows:
        lang = (rest[0] if rest else "en") or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    some = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longer = collections.Counter()
    for (lang, p), a in some.items():
        for q in {p[i:j] for i, j in itertools.combinations(range(len(p) + 1), 2) if j - i < len(p)}:
            longer[lang, q] = max(longer[lang, q], a)
    found = collections.defaultdict(list)
    for (lang, p), a in some.items():
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * longer[lang, p] < 80 * a:
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in found.items() for k, x in enumerate(sorted(v)[:top]))


def said(seed=11):
    r = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "new", "york", "New", "en", "de", " ", "x" * 300]
    sets = [["new", "york", "city", "hall"], ["a", "b"], ["b", "a", "b"], ["é", "É"], ["en", "de"]]
    rows = []
    for i in range(150):
        out = []
        for _ in range(r.randint(0, 60)):
            out += r.choice(sets) if r.random() < 0.3 else [r.choice(vocabulary)]
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "!? "]) for w in out)
        rows.append((i, text, r.choice(["en", "de", None, "und"])))
    return rows + [(1, None, "en"), (1, "", "fr"), (2, " ,. \n", "de"), (3, "a a a a a a a a " * 200, "es"), (3, "a a a a a a a a " * 200, "es"), (None, "ties b " * 40, "es")]


def test_collocations(spark):
    rows = said()
    want = brute_phrases(rows)
    assert len({x[0] for x in want}) == 4
    for options in ({}, {"held": 7}, {"top": None}, {"top": 5}):
        got = phrases.collocations(table(spark, rows).repartition(3), **options)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == (brute_phrases(rows, top=5) if options.get("top") else want)
    assert phrases.collocations(table(spark, rows).limit(0)).count() == 0
    assert phrases.collocations(table(spark, rows[:3])).count() == 0


def test_words_of_one_code_get_other_codes(spark, monkeypatch):
    """Where the first codes don't tell words apart the next ones are taken."""
    count, seeds = phrases._count_words, []

    def alike(seed):
        seeds.append(seed)
        inner = count(seed)

        def run(batches):
            for b in inner(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([9] * b.num_rows, pa.int64()), b.column(3)], b.schema.names)

        return inner if seed else run

    rows = said(5)
    monkeypatch.setattr(phrases, "_count_words", alike)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows)).collect())) == brute_phrases(rows)
    assert seeds == [0, 1]


def test_trie_places_every_phrase():
    r = random.Random(1)
    codes = np.array([r.getrandbits(63) + 1 for _ in range(400)], np.uint64)
    text = [0 if r.random() < 0.1 else int(codes[min(399, int(r.expovariate(0.02)))]) for _ in range(8000)]
    seen = collections.Counter(tuple(text[i : i + k]) for k in (2, 3, 4) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
    some = [p for p in seen if r.random() < 0.4]
    trie = phrases.Trie(np.array([[*p, *[0] * (4 - len(p))] for p in some], np.uint64))
    assert {some[i]: n for i, n in zip(trie.rows().tolist(), trie.counts(np.array(text, np.uint64)).tolist(), strict=True)} == {p: seen[p] for p in some}


def test_buckets_go_out_packed(spark, monkeypatch):
    """Whatever a task holds at once, buckets come to their whole sums, and on their way take half of twelve bytes each."""
    r = np.random.default_rng(3)
    codes = np.concatenate([r.integers(1, 12, 60_000), r.integers(1, 1 << 40, 200_000)]).astype(np.uint64)
    rows = [(x.tobytes(),) for x in np.split(codes, 52)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([x for (x,) in rows], pa.binary())], ["codes"])])
    places = [h for w in phrases._steps(batches()) for k, _, h in phrases._grams(w, [], 2)]
    seen = collections.Counter(np.concatenate(places).tolist())
    monkeypatch.setattr(phrases, "_STEP", 5000)
    for held in (1 << 21, 9000):
        monkeypatch.setattr(phrases, "_HELD", held)
        for least, parts in ((3, 5), (300, 1), (2, 900)):
            sent = list(phrases._buckets([], 2, least, parts)(batches()))
            if held > len(codes) and parts < 9:
                assert sum(b.nbytes for b in sent) < (6 if least < 256 else 7) * len(seen)
            part = pa.Table.from_batches(sent).sort_by("part").to_batches(max_chunksize=7)
            got = [(h, n) for b in phrases._full_buckets(least)(iter(part)) for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            full = np.array([h for h, n in seen.items() if n >= least], np.uint64)
            assert sorted(got) == sorted((h, least) for h in phrases.mix(full).view(np.int64).tolist())


def test_tasks_of_collocations_hold_little():
    """What a task of each pass holds at once, beside its input, is a small part of what the coded words take."""
    r = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" + "." * (i % 16 == 0) for i in range(3000)])
    texts = [" ".join(vocabulary[r.zipf(1.3, 4000) % 2900 + r.integers(0, 100, 4000)]) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    every = bloom.Bits(1 << 20, np.full(1 << 17, 255, np.uint8))
    rows = pa.Table.from_batches(phrases._encode(0, every)(iter([batch])))
    assert max(map(len, rows.column(0).to_pylist())) < 4096  # Spark reads thousands of rows at once
    rows = rows.combine_chunks().to_batches(max_chunksize=1000)
    codes = np.concatenate(list(phrases._steps(iter(rows))))
    pairs = np.unique(np.stack([codes[:-1], codes[1:]], 1)[(codes[:-1] > 0) & (codes[1:] > 0)], axis=0)
    trie = phrases._count_phrases(np.hstack([pairs, np.zeros_like(pairs)])[:20_000])
    steps = ((phrases._count_words(0), [batch], 26), (phrases._encode(0, every), [batch], 26), (phrases._candidates([every] * 3), rows, 50), (trie, rows, 21))
    for run, data, most in steps:
        for _ in range(2):  # the second time with tables that stay
            tracemalloc.start()
            collections.deque(run(iter(data)), 0)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        assert peak < most << 20, run
