"""Phrase collocations, counted with broadcast tries.

Words become 64-bit codes once (checked to be distinct for distinct words), infrequent words and piece ends zero. Level
by level, phrases both of whose parts can be frequent are hashed into buckets; only buckets that reach the least count
give candidates. The candidates' double-array trie goes to all tasks, where all positions' states advance together; the
counts of the accepting states are summed over the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import bloom
from strata.llm.common import U64, byte_codes, chunks, discard, join_hot, mix, partitions, prefix_hash, separated, ship, span_hash, stage, whole_runs, words

LONGEST = 4
#: Candidates that one trie holds; more take further passes over the coded words.
TRIE_PHRASES = 1 << 19
#: Bytes of text that one numpy step takes, codes of a row of coded words (a piece without a break can be longer), and codes
#: that one step takes. An executor keeps up to four workers and Spark reads 4096 rows at once, so all three are small.
_TEXT, _ROW, _STEP = 1 << 19, 1 << 8, 1 << 17
#: Leading bits of a phrase's hash that name its bucket.
BUCKET_BITS = 40
#: Words for each part of the buckets, and buckets that a task of the first side holds at once, about.
_PART, _HELD = 1 << 20, 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = np.ones(256, np.int8)
_WORD[[0x20, 0x09]] = 0
_WORD[_BREAK] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PLACE = mix(np.arange(301, 301 + LONGEST, dtype=U64)) | U64(1)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Folded bytes, word starts and ends, document of each word, and whether a word begins a piece."""
    buf, at = separated(data, offsets, 0x0A)
    buf = _FOLD[buf]
    start, end = words(buf, _WORD)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[buf])])
    piece = breaks[start]
    return buf, start, end, np.searchsorted(at, start, "right") - 1, np.concatenate([[True], piece[1:] != piece[:-1]])[: len(start)]


def _codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    """Nonzero codes of words by language (a language's hash is mixed again, as its name can be a word too)."""
    h = mix(span_hash(prefix_hash(buf, byte_codes(False)), start, end) + mix(lang + U64(1 + seed)))
    return np.where(h == 0, U64(1), h)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for x in set(langs):
        raw = np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8)
        known[x] = int(span_hash(prefix_hash(raw, byte_codes(False)), np.array([0]), np.array([len(raw)]))[0])
    return np.array([known[x] for x in langs], U64)


def _count_words(seed: int):
    """(lang, text) -> (lang, word, code, n) of each chunk."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            hashes = _lang_hashes(langs)
            for first, _, data, offsets in chunks(batch.column(1), _TEXT):
                buf, start, end, doc, _ = _tokens(data, offsets)
                code = _codes(buf, start, end, hashes[first + doc], seed)
                size = end - start
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                mark = np.zeros(len(buf) + 1, np.int8)
                mark[start] += 1
                mark[end] -= 1
                kept = buf[np.cumsum(mark[:-1]).astype(bool)]
                column = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
                coded = column.dictionary_encode()
                key = coded.indices.to_numpy().astype(np.int64)
                names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                of = np.array([names[x] for x in langs], np.int64)[first + doc]
                pair, at, n = np.unique(key * len(names) + of, return_index=True, return_counts=True)
                text = coded.dictionary.take(pa.array(pair // max(1, len(names))))
                lang = pa.array(list(names), pa.string()).take(pa.array(pair % max(1, len(names))))
                yield pa.RecordBatch.from_arrays([lang, text, pa.array(code[at].view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "code", "n"])

    return run


def _encode(seed: int, frequent: bloom.Bits):
    """(lang, text) -> (codes): rows of codes, zero for an infrequent word and between pieces."""

    def run(batches):
        for batch in batches:
            hashes = _lang_hashes(batch.column(0).to_pylist())
            for first, _, data, offsets in chunks(batch.column(1), _TEXT):
                buf, start, end, doc, begins = _tokens(data, offsets)
                code = _codes(buf, start, end, hashes[first + doc], seed)
                code = np.where(frequent.has(code), code, U64(0))
                out = np.zeros(len(code) + int(begins.sum()), U64)
                out[np.arange(len(code)) + np.cumsum(begins)] = code
                gap = out == 0
                out = out[~(gap & np.concatenate([[True], gap[:-1]]))]  # one zero is as good as many
                zero = np.flatnonzero(out == 0)
                cuts = np.unique(zero[np.searchsorted(zero, np.arange(_ROW, len(out), _ROW)).clip(max=max(0, len(zero) - 1))]) if len(zero) else zero
                rows = [x.tobytes() for x in np.split(out, cuts) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["codes"])

    return run


def _steps(batches):
    """Codes of about _STEP at a time, zeros between rows."""
    held, size = [], 0
    for batch in batches:
        for _, n, data, offsets in chunks(batch.column(0), 8 * _STEP):
            out = np.zeros(len(data) // 8 + n, U64)
            out[np.arange(len(data) // 8) + np.repeat(np.arange(1, n + 1), np.diff(offsets) // 8)] = data.view(U64)
            held.append(out)
            size += len(out)
            if size >= _STEP:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _grams(w: np.ndarray, filters: list[bloom.Bits], longest: int):
    """Yields for 2, 3, .. the positions of the phrases that may be frequent and their buckets: both parts of one word
    less may be, and so may the phrase itself where a filter for its length is given."""
    at = np.flatnonzero(w[:-1].astype(bool) & w[1:].astype(bool))
    for k in range(2, longest + 1):
        h = mix(sum((w[at + j] * _PLACE[j] for j in range(k)), np.zeros(len(at), U64)) + U64(k)) >> U64(64 - BUCKET_BITS)
        if len(filters) > k - 2:
            some = filters[k - 2].has(mix(h))
            at, h = at[some], h[some]
        yield k, at, h
        # the next length begins where this one begins here and one word on
        at = at[:-1][np.diff(at) == 1] if len(at) else at


def _summed(held: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of some lists, which it empties, sorted, with their sums; a sum says no more than `least`."""
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.minimum(np.add.reduceat(n, first, dtype=np.int64), least).astype(np.min_scalar_type(least))


def _packed(h: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted buckets as a row for each part: the first, the steps from each to the next in as few bytes as the widest
    needs, and the counts. Many buckets lie close together, so three bytes do where Spark's rows take eleven."""
    part = h * U64(parts) >> U64(BUCKET_BITS)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    step = np.diff(h, prepend=h[:1])
    step[first] = 0
    width = max(1, -(-int(step.max()).bit_length() // 8))
    ends = np.append(first, len(h))
    binary = lambda x, size: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(x.tobytes())])
    steps = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), width, np.int32)), pa.array(h[first].view(np.int64)), binary(steps, width), binary(n, n.itemsize)],
        ["part", "width", "first", "steps", "counts"],
    )


def _unpacked(t: pa.Table, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of _packed -> lists of (buckets, counts)."""
    out, kind = [], np.dtype(np.min_scalar_type(least))
    width = t.column("width").to_numpy()
    for w in np.unique(width).tolist():
        own = t.filter(pa.array(width == w))
        counts = own.column("counts").to_pylist()
        size = np.array([len(x) // kind.itemsize for x in counts])
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :w] = np.frombuffer(b"".join(own.column("steps").to_pylist()), np.uint8).reshape(-1, w)
        h = np.cumsum(wide.view("<u8").ravel(), dtype=U64)
        h += np.repeat(own.column("first").to_numpy().view(U64) - h[np.cumsum(size) - size], size)
        out.append((h, np.frombuffer(b"".join(counts), kind)))
    return out


def _buckets(filters: list[bloom.Bits], k: int, least: int, parts: int):
    """codes -> the buckets of the phrases of k words, summed as far as a task holds them, as rows of _packed."""

    def run(batches):
        held, size = [], 0
        for w in _steps(batches):
            for length, _, h in _grams(w, filters, k):
                if length == k and len(h):
                    held.append(_summed([(h, np.ones(len(h), np.uint8))], least))
                    size += len(held[-1][0])
            if size >= _HELD:
                held = [_summed(held, least)]
                size = len(held[0][0])
                if size >= _HELD // 2:
                    yield _packed(*held[0], parts)
                    held, size = [], 0
        if held:
            yield _packed(*_summed(held, least), parts)

    return run


def _full_buckets(least: int):
    """Rows of _packed sorted by part -> (h, n): the buckets that reach `least`, a part at a time."""

    def run(batches):
        for t in whole_runs(batches, "part", 1):
            part = t.column("part").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                h, n = _summed(_unpacked(t.slice(a, b - a), least), least)
                full = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(mix(h[full]).view(np.int64)), pa.array(n[full].astype(np.int64))], ["h", "n"])

    return run


def _candidates(filters: list[bloom.Bits]):
    """codes -> (w0.., ) of each phrase of 2 to LONGEST words that may be frequent, zeros after its end."""

    def run(batches):
        for w in _steps(batches):
            for k, at, h in _grams(w, filters, len(filters) + 1):
                _, one, of = np.unique(h, return_index=True, return_inverse=True)
                rest = np.flatnonzero(np.any([w[at + j] != w[at[one][of] + j] for j in range(k)], axis=0))  # other words, same hash
                at = at[np.concatenate([one, rest])]
                columns = [w[at + j] if j < k else np.zeros(len(at), U64) for j in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], _W)

    return run


_W = [f"w{j}" for j in range(LONGEST)]


class Trie:
    """A double array over distinct phrases (rows of nonzero codes, zeros after the end): from state s symbol c leads to
    base[s] + c where owner[base[s] + c] is s. State 0 is the root; accept[state] is a phrase's row or -1."""

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases[phrases != 0])
        n = self.size = len(phrases)
        symbol = np.where(phrases == 0, 0, np.searchsorted(self.words, phrases) + 1).astype(np.int64)
        self.owner, self.accept, self.base = (np.full(len(self.words) + 64, x, np.int32) for x in (-1, -1, 0))
        self.owner[0] = -2  # the root's own cell
        self._random = np.random.default_rng(0)
        state, row = np.zeros(n, np.int64), np.arange(n)
        for j in range(phrases.shape[1]):
            row = row[symbol[row, j] > 0]
            if not len(row):
                break
            edge, back = np.unique(state[row] * (len(self.words) + 1) + symbol[row, j], return_inverse=True)
            target = self._place(edge // (len(self.words) + 1), edge % (len(self.words) + 1))
            state[row] = target[back]
            ends = row[symbol[row, j + 1] == 0] if j + 1 < phrases.shape[1] else row
            self.accept[state[ends]] = ends
        self._resize(int(np.flatnonzero(self.owner != -1).max()) + len(self.words) + 2)  # base + symbol stays inside

    def _resize(self, size: int) -> None:
        more = max(0, size - len(self.owner))
        self.owner, self.accept, self.base = (
            np.concatenate([x[:size], np.full(more, fill, np.int32)]) for x, fill in ((self.owner, -1), (self.accept, -1), (self.base, 0))
        )

    def _take(self, parent, base, cells) -> None:
        self.owner[cells], self.base[parent] = parent, base

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Cells of the edges, sorted by parent and symbol: states with many edges take the first fit, states with a few
        random places until all of their cells are free, states with one edge the free cells that are left."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        count = np.diff(np.append(first, len(parent)))
        target = np.zeros(len(parent), np.int64)
        free = int(np.argmax(self.owner == -1)) if (self.owner == -1).any() else len(self.owner)
        for g in np.argsort(-count, kind="stable")[: int((count > 4).sum())].tolist():
            c = symbol[first[g] : first[g] + count[g]]
            base, tried = max(0, free - int(c[0])), 0
            while True:
                if base + 64 + int(c[-1]) >= len(self.owner):
                    self._resize(len(self.owner) * 5 // 4 + 64 + int(c[-1]))
                tries = base + np.arange(64)
                fits = tries[(self.owner[tries[:, None] + c[None, :256]] == -1).all(1)]
                fit = next((b for b in fits.tolist() if len(c) <= 256 or (self.owner[b + c] == -1).all()), None)
                if fit is not None:
                    break
                base, tried = base + 64, tried + 1
                if tried > 8:  # full here: begin later, for good
                    free = base + int(c[0])
            target[first[g] : first[g] + count[g]] = fit + c
            self._take(parent[first[g]], fit, fit + c)
        few = np.flatnonzero((count > 1) & (count <= 4))
        room = len(self.words) + int((self.owner != -1).sum()) + 3 * int(count[few].sum()) + 64
        if len(few) and room > len(self.owner):
            self._resize(room)
        while len(few):
            base = self._random.integers(0, len(self.owner) - len(self.words), len(few))
            of = np.repeat(np.arange(len(few)), count[few])
            edge = np.arange(len(of)) - np.repeat(np.cumsum(count[few]) - count[few], count[few]) + first[few][of]
            cells = base[of] + symbol[edge]
            _, one = np.unique(cells, return_index=True)
            good = np.zeros(len(cells), bool)
            good[one] = self.owner[cells[one]] == -1
            fits = np.bincount(of, weights=~good, minlength=len(few)) == 0
            some = fits[of]
            target[edge[some]] = cells[some]
            self.owner[cells[some]] = parent[edge[some]]
            self.base[parent[first[few[fits]]]] = base[fits]
            few = few[~fits]
        single = first[count == 1]
        if len(single):
            least = int(symbol[single].max())
            cells = np.flatnonzero(self.owner[least:] == -1) + least
            if len(cells) < len(single):
                self._resize(len(self.owner) + len(single) - len(cells))
                cells = np.flatnonzero(self.owner[least:] == -1) + least
            cells = cells[: len(single)]
            self._take(parent[single], cells - symbol[single], cells)
            target[single] = cells
        return target

    def counts(self, w: np.ndarray) -> np.ndarray:
        """How often each phrase, by its row, occurs in the codes: the states of all positions advance together."""
        at = np.searchsorted(self.words, w).clip(max=max(0, len(self.words) - 1))
        symbol = np.where(self.words[at] == w, at + 1, 0) if len(self.words) else np.zeros(len(w), np.int64)
        symbol = np.concatenate([symbol, np.zeros(LONGEST, np.int64)])
        at = np.flatnonzero(symbol)
        state, found = np.zeros(len(at), np.int64), []
        for j in range(LONGEST):
            c = symbol[at + j]
            to = self.base[state] + c
            goes = (c > 0) & (self.owner[to] == state)
            at, state = at[goes], to[goes]
            found.append(self.accept[state])
        found = np.concatenate(found)
        return np.bincount(found[found >= 0], minlength=self.size)

    def rows(self) -> np.ndarray:
        """The phrase of each number of counts()."""
        return np.arange(self.size)


def _count_phrases(phrases: np.ndarray):
    """codes -> (phrase, n): sums of a task for the phrases' numbers."""
    trie = Trie(phrases)

    def run(batches):
        total = np.zeros(trie.size, np.int64)
        for w in _steps(batches):
            total += trie.counts(w)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["phrase", "n"])

    return run


def _counted_at_once(codes: DataFrame, candidates: DataFrame, least: int) -> DataFrame | None:
    """_counted with one trie. The driver holds nothing of it afterwards."""
    columns = candidates.toArrow()
    phrases = np.stack([columns.column(c).to_numpy().view(U64) for c in _W], 1) if columns.num_rows else np.zeros((0, LONGEST), U64)
    del columns
    if not len(phrases):
        return None
    n = codes.mapInArrow(_count_phrases(phrases), "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    names = pa.table([pa.array(np.arange(len(phrases))), *[pa.array(phrases[:, j].view(np.int64)) for j in range(LONGEST)]], names=["phrase", *_W])
    return stage(n.join(codes.sparkSession.createDataFrame(names), "phrase").select(*_W, "f"), "phrases")


def _counted(codes: DataFrame, candidates: DataFrame, least: int, held: int) -> DataFrame:
    """candidates(w0..) -> (w0.., f) with f >= least: a trie, and a pass over the codes, for each `held` of them."""
    total = candidates.count()
    passes = max(1, -(-total * 5 // (held * 4))) if total > held else 1
    out = None
    for p in range(passes):
        found = _counted_at_once(codes, candidates if passes == 1 else candidates.where(F.pmod(F.xxhash64(*_W), F.lit(passes)) == p), least)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else candidates.withColumn("f", F.lit(0).cast("long")).limit(0)


def _first_ranks(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each lang: parts of a lang are cut to `top` rows each before they meet, in two steps."""
    wide = max(1, partitions(found.sparkSession))
    narrow = max(1, int(wide**0.5))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(wide)))
    for keys in (["lang", "part"], ["lang", F.col("part") % narrow], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.drop("part")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int | None = 2000, held: int = TRIE_PHRASES) -> DataFrame:
    """docs(lang, text) -> (lang, rank, phrase, a, l, r, n, score): each lang's phrases of 2 to 4 words.

    Texts are lower-cased (A-Z) and split at .,;:!? and \\n-\\r into pieces, and those at blanks and tabs into words; null
    texts have none, a null lang is `und`. n: all words of the lang; a: the phrase's occurrences within pieces, `least`
    or more; l, r: those of the two parts of the cut with the smallest score floor(2000000 * a / (l + r)), of several the
    first. A phrase inside a longer one of at least `covered` percent of its occurrences goes. rank: by score and a
    descending, then phrase (as UTF-8 bytes); `top` None gives all. Repeated rows count each time, other columns are
    left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    seed = 0
    while True:
        counts = source.mapInArrow(_count_words(seed), "lang string, word string, code long, n long")
        vocabulary = stage(counts.groupBy("lang", "word", "code").agg(F.sum("n").alias("f")), "vocabulary")
        twice = vocabulary.groupBy("code").agg(F.count("*").alias("n"), F.max("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least))
        if not twice.take(1):
            break
        discard(vocabulary)
        seed += 1  # a frequent word has another's code: other codes
    frequent = vocabulary.where(F.col("f") >= least)
    kinds_of, running = frequent.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    held_words = bloom.build(frequent.select(F.col("code").alias("h"), F.lit(1).alias("n")), bloom.size_for(kinds_of))
    codes = stage(source.mapInArrow(_encode(seed, held_words), "codes binary"), "codes")
    filters: list[bloom.Bits] = []
    n = partitions(spark)
    parts = max(2 * n, -(-running // _PART))
    for k in range(2, LONGEST + 1):
        packed = codes.mapInArrow(_buckets(list(filters), k, least, parts), "part int, width int, first long, steps binary, counts binary")
        packed = packed.repartition(n, "part").sortWithinPartitions("part")
        buckets = stage(packed.mapInArrow(_full_buckets(least), "h long, n long"), "buckets")
        filters.append(bloom.build(buckets, bloom.size_for(buckets.count())))
        discard(buckets)
    kinds = ", ".join(f"{c} long" for c in _W)
    candidates = stage(codes.mapInArrow(_candidates(filters), kinds).distinct(), "candidates")
    found = _counted(codes, candidates, least, held)
    single = frequent.select(F.col("code").alias("w0"), *[F.lit(0).cast("long").alias(c) for c in _W[1:]], "f", "lang", "word")
    known = single.unionByName(found.withColumns({"lang": F.lit(None).cast("string"), "word": F.lit(None).cast("string")}))

    # the parts of each phrase: where they begin, their length, and of the phrase all words
    size = F.lit(2) + F.when(F.col("w2") != 0, 1).otherwise(0) + F.when(F.col("w3") != 0, 1).otherwise(0)
    whole = F.array(*_W)
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.transform(F.sequence(F.lit(1), F.col("k") - b), lambda n: F.struct(b.alias("b"), n.alias("m")))))
    parts = found.withColumn("k", size).select(whole.alias("p"), "k", F.col("f").alias("a"), F.explode(spans).alias("s")).where("s.m < k")
    word = lambda j: F.when(F.col("s.m") > j, F.element_at("p", F.col("s.b") + j + 1)).otherwise(0)
    parts = stage(parts.select("p", "k", "a", "s.b", "s.m", *[word(j).alias(c) for j, c in enumerate(_W)]), "parts")
    total = parts.count()
    met = parts.groupBy(*_W).agg(F.count("*").alias("_n"), F.max("a").alias("longer"))
    parts = join_hot(parts, known.join(met.select(*_W, "_n"), _W), _W, total)
    of = F.struct("b", "m", "f", "word", "lang")
    joined = parts.groupBy("p").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.collect_list(of).alias("parts"))  # 9 at most
    count = lambda b, m: F.filter("parts", lambda x: (x["b"] == b) & (x["m"] == m))[0]["f"]
    exact = lambda x: x.cast("decimal(38,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("c"), count(F.lit(0), c).alias("l"), count(c, F.col("k") - c).alias("r")))
    joined = joined.withColumn("cut", F.explode(cuts)).select("*", "cut.*")
    joined = joined.withColumn("whole", exact(F.col("a")) * F.lit(2000000)).withColumn("part", exact(F.col("l")) + exact(F.col("r")))
    joined = joined.withColumn("score", F.expr("cast(cast(whole as decimal(30,0)) div cast(part as decimal(30,0)) as long)"))
    texts = F.transform(F.array_sort(F.filter("parts", lambda x: x["m"] == 1)), lambda x: x["word"])
    lang = F.filter("parts", lambda x: x["m"] == 1)[0]["lang"]
    best = joined.groupBy("p").agg(F.min(F.struct("score", "c", "l", "r", "a")).alias("x"), F.first(texts).alias("words"), F.first(lang).alias("lang"))
    best = best.join(met.select(whole.alias("p"), "longer"), "p", "left")
    best = best.where(F.col("longer").isNull() | (exact(F.lit(100)) * F.col("longer") < exact(F.lit(covered)) * F.col("x.a")))
    sums = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    rows = best.select("lang", F.array_join("words", " ").alias("phrase"), "x.a", "x.l", "x.r", "x.score")
    if top is None:
        order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).join(sums, "lang")
    else:
        rows = _first_ranks(stage(rows, "collocations"), top).join(sums, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
