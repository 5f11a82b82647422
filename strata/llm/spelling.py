"""Spelling variants: words that are one edit apart, by Gram matrices of blocks of letter counts.

A block holds the words with the same numbers of letters in four classes, so its words have one length. One edit leads
to the same block or to one whose counts differ by one letter more, or by one letter moved. Each pair of such blocks is
dealt in tiles; in a tile the products of the letter counts give all squared distances at once, and the pairs at most
two apart are verified letter by letter.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import chunks, discard, join_hot, partitions, separated, ship, stage, whole_runs

CLASSES = 4
#: Words of a tile, and the letters that its words have together at most (more only where one word has more).
TILE, TILE_LETTERS = 2048, 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LEAD = 0xC3  # of the two bytes of U+00C0..U+00FF
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


class _Crc:
    """crc32 of prefix + word from those of both: the crc of a concatenation is the xor of the word's crc with a linear
    map, fixed by the word's length, of the prefix's."""

    LONGEST = 128

    def __init__(self):
        table = _crc_table()
        step = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
        self.maps = np.zeros((self.LONGEST + 1, 4, 256), np.uint32)
        self.maps[0] = step
        for n in range(1, self.LONGEST + 1):
            step = table[step & 0xFF] ^ (step >> 8)
            self.maps[n] = step

    def joined(self, prefix: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = word.copy()
        for k in range(4):
            out ^= self.maps[size, k, (prefix >> np.uint32(8 * k)) & np.uint32(0xFF)]
        return out


def _runs(data: np.ndarray, offsets: np.ndarray, least: int):
    """Of the runs of letters with `least` code points or more the document and the text, A-Z folded."""
    buf, at = separated(data, offsets)
    buf = _FOLD[buf]
    lead = buf == _LEAD
    flag = np.zeros(len(buf) + 2, np.int8)
    flag[1:-1] = _LETTER[buf] | lead
    flag[2:-1] |= lead[:-1]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    leads = np.concatenate([[0], np.cumsum(lead)])
    long = end - start - (leads[end] - leads[start]) >= least
    start, end = start[long], end[long]
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    kept = buf[np.cumsum(mark[:-1]).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return np.searchsorted(at, start, "right") - 1, text


def _count(min_chars: int, every: int | None):
    """(id as string, text) -> (word, n) of each batch."""
    crc = _Crc() if every else None

    def run(batches):
        for batch in batches:
            docs, texts = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
            for first, _, data, offsets in chunks(batch.column(1)):
                doc, text = _runs(data, offsets, min_chars)
                docs.append(first + doc)
                texts.append(text)
            coded = pa.concat_arrays(texts).dictionary_encode()
            words, index, doc = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate(docs)
            n = np.bincount(index, minlength=len(words))
            found: dict[str, int] = {}
            if every and len(words):
                raw = [w.encode() for w in words]
                size = np.array([len(w) for w in raw])
                own = np.array([zlib.crc32(w) for w in raw], np.uint32)
                prefix = [f"{i or ''}:".encode() for i in batch.column(0).to_pylist()]
                of_doc = np.array([zlib.crc32(p) for p in prefix], np.uint32)
                short = size[index] <= _Crc.LONGEST
                h = np.ones(len(index), np.uint32)
                h[short] = crc.joined(of_doc[doc[short]], own[index[short]], size[index[short]])
                for k in np.flatnonzero(~short).tolist():
                    h[k] = zlib.crc32(raw[index[k]], int(of_doc[doc[k]]))
                hit = np.flatnonzero(h % np.uint32(every) == 0)
                np.subtract.at(n, index[hit], 1)
                for i, x in zip(index[hit].tolist(), h[hit].tolist(), strict=True):
                    w, at = words[i], x % len(words[i])
                    if len(w) > min_chars:
                        w = w[:at] + w[at + 1 :]
                        found[w] = found.get(w, 0) + 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([coded.dictionary.take(pa.array(some)), pa.array(list(found), pa.string())]),
                    pa.concat_arrays([pa.array(n[some], pa.int64()), pa.array(list(found.values()), pa.int64())]),
                ],
                ["word", "n"],
            )

    return run


def word_counts(docs: DataFrame, min_chars: int = 5, delete_every: int | None = 97) -> DataFrame:
    """docs(doc_id, text) -> (word, n): words of min_chars code points and their occurrences; see spelling_variants."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    return rows.mapInArrow(_count(min_chars, delete_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(batches):
    """(word, n) -> (word, n, c0.., length): numbers of letters by class."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        row = np.repeat(np.arange(len(words)), size)
        counts = np.bincount(row * CLASSES + codes % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)
        columns = [pa.array(counts[:, k], pa.int32()) for k in range(CLASSES)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(size)], ["word", "n", *_C, "length"])


_C = [f"c{k}" for k in range(CLASSES)]


def _steps() -> list[tuple[int, ...]]:
    """From a block to each that one edit can lead to, every unordered pair of blocks once: the same, one letter more,
    one letter of another class."""
    unit = np.eye(CLASSES, dtype=int)
    moved = [tuple(unit[j] - unit[i]) for i, j in itertools.combinations(range(CLASSES), 2)]
    return [tuple(int(x) for x in s) for s in [(0,) * CLASSES, *map(tuple, unit), *moved]]


def _tiles(words: DataFrame, total: int) -> DataFrame:
    """words(word, n, c0.., length) -> (pair, ta, tb, side, word, n): each word in the tiles of its block's pairs. side: 0
    and 1, or 2 in a tile whose words are to be compared with each other."""
    size = F.greatest(F.lit(1), F.least(F.lit(TILE), F.lit(TILE_LETTERS) / F.greatest(F.col("length"), F.lit(1)))).cast("int")
    blocks = words.groupBy(*_C).agg(F.count("*").alias("_n"), F.first("length").alias("length"))
    blocks = stage(blocks.withColumn("k", F.ceil(F.col("_n") / size).cast("int")), "blocks")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(f"d{k}") for k, x in enumerate(s)]) for i, s in enumerate(_steps())])
    reached = blocks.select(*_C, F.col("k").alias("ka"), F.explode(steps).alias("s"))
    reached = reached.select(*[F.col(c).alias(f"a{c}") for c in _C], *[(F.col(c) + F.col(f"s.d{k}")).alias(c) for k, c in enumerate(_C)], "ka", "s.i")
    pairs = reached.join(blocks.select(*_C, F.col("k").alias("kb")), _C).withColumn("pair", F.monotonically_increasing_id())
    pairs = stage(pairs, "block-pairs")
    own = F.col("i") == 0
    left = pairs.select(*[F.col(f"a{c}").alias(c) for c in _C], F.struct("pair", F.lit(0).alias("side"), F.col("kb").alias("k"), own.alias("own")).alias("role"))
    right = pairs.select(*_C, F.struct("pair", F.lit(1).alias("side"), F.col("ka").alias("k"), own.alias("own")).alias("role"))
    roles = left.unionByName(right).groupBy(*_C).agg(F.collect_list("role").alias("roles"))  # at most two a step
    roles = roles.join(blocks.select(*_C, "_n", "k"), _C)
    placed = join_hot(words, roles, _C, total)
    placed = placed.withColumn("t", F.pmod(F.xxhash64("word"), F.col("k")).cast("int")).select("word", "n", "t", F.explode("roles").alias("r"))
    # a block with itself: tile ta meets the tiles tb >= ta, and where they are one it is sent once
    low: Column = F.when(~F.col("r.own"), 0).when(F.col("r.side") == 0, F.col("t")).otherwise(0)
    high: Column = F.when(~F.col("r.own") | (F.col("r.side") == 0), F.col("r.k") - 1).otherwise(F.col("t") - 1)
    placed = placed.where(low <= high).withColumn("other", F.explode(F.sequence(low, high)))
    first = F.col("r.side") == 0
    ta, tb = F.when(first, F.col("t")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("t"))
    alone = F.col("r.own") & (F.col("t") == F.col("other"))
    return placed.select("r.pair", ta.alias("ta"), tb.alias("tb"), F.when(alone, 2).otherwise(F.col("r.side")).alias("side"), "word", "n")


class _Words:
    """Words of one length: letters from the left and from the right, padded by a column."""

    def __init__(self, words: list[str], width: int):
        self.n, self.length = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(self.n, self.length)
        self.letters = letters
        self.left, self.right = np.zeros((self.n, width), np.uint8), np.zeros((self.n, width), np.uint8)
        self.left[:, : self.length] = letters
        self.right[:, : self.length] = letters[:, ::-1]

    def counts(self, columns: np.ndarray, kind) -> np.ndarray:
        place = columns[self.letters].astype(np.int64) + (np.arange(self.n) * int(columns.max() + 1))[:, None]
        return np.bincount(place.ravel(), minlength=self.n * int(columns.max() + 1)).reshape(self.n, -1).astype(kind)


def near_pairs(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Which words of left are one edit from which of right (None: of left, each pair once). All words of a side are
    distinct, have code points below 256 and one length; the lengths of the sides differ by one at most."""
    width = max(len(left[0]), len((right or left)[0]))
    a = _Words(left, width)
    b = a if right is None else _Words(right, width)
    used = np.unique(np.concatenate([np.unique(a.letters), np.unique(b.letters)]))
    columns = np.zeros(256, np.int64)
    columns[used] = np.arange(len(used))
    kind = np.float32 if width < 2048 else np.float64  # squares below 2**24 or 2**53: exact
    ca, cb = a.counts(columns, kind), b.counts(columns, kind)
    squared = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None, :] - 2 * (ca @ cb.T)
    i, j = np.nonzero(squared <= 2)
    if right is None:
        i, j = i[i < j], j[i < j]
    near = np.zeros(len(i), bool)
    part = max(1, TILE_LETTERS // width)
    for k in range(0, len(i), part):
        x, y = i[k : k + part], j[k : k + part]
        prefix = _common(a.left[x], b.left[y])
        suffix = _common(a.right[x], b.right[y])
        near[k : k + part] = prefix + suffix >= width - 1
    return i[near], j[near]


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal letters at the start of each row; rows differ somewhere."""
    return np.argmax(x != y, axis=1)


def _compare(batches):
    """Tiles in order -> (word, other, other_n) for each near pair, both ways."""
    for table in whole_runs(batches, "group", 1 << 14):
        keys = np.stack([table.column(c).to_numpy() for c in ("pair", "ta", "tb")])
        edge = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
        words = table.column("word").to_pylist()
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(side)], strict=True):
            m = a if side[a] == 2 else a + int(np.searchsorted(side[a:z], 1))
            if side[a] == 2 or a < m < z:
                i, j = near_pairs(words[a:z] if side[a] == 2 else words[a:m], None if side[a] == 2 else words[m:z])
                xs.append(a + i)
                ys.append(m + j)
        x, y = np.concatenate(xs), np.concatenate(ys)
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        word = table.column("word").combine_chunks() if isinstance(table.column("word"), pa.ChunkedArray) else table.column("word")
        yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), pa.array(n[y])], ["word", "other", "other_n"])


def _roots(links: DataFrame) -> DataFrame:
    """links(word, form), forms occurring more often than words -> (word, root): forms followed to the last by doubling."""
    at = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        into = at.groupBy("root").agg(F.count("*").alias("_n"))
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further")).join(into, "root")
        if not further.take(1):
            return at
        moved = join_hot(at, further, ["root"], max(1, at.count()), "left")
        before, at = at, stage(moved.select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(before)


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, delete_every: int | None = 97) -> DataFrame:
    """docs(doc_id, text) -> (word, form, root, n, n_near, form_n), a row for each distinct word.

    Words are maximal runs of A-Z, a-z and U+00C0..U+00FF, only A-Z folded; null texts have none. Where delete_every
    divides the crc32 h of `<doc_id>:<run>` (a null doc_id is empty there), the run loses code point h % length; None
    deletes nothing. Words have min_chars code points and min_count occurrences (n) over all rows. Two words are near if
    one insertion, deletion or replacement of a code point leads from one to the other; n_near counts a word's near
    words. form: the near word of largest n (ties: smallest), if that n is at least `ratio` (2 or more) times the
    word's; root: the last word that forms lead to, the word itself where it has no form. Repeated rows count each time;
    an empty table gives no words.
    """
    words = word_counts(docs, min_chars, delete_every).where(F.col("n") >= min_count)
    kinds = ", ".join(f"{c} int" for c in _C)
    words = stage(words.mapInArrow(_blocks, f"word string, n long, {kinds}, length long"), "words")
    total = words.count()
    tiles = _tiles(words, total).withColumn("group", F.xxhash64("pair", "ta", "tb"))
    tiles = tiles.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", "pair", "ta", "tb", "side")
    near = tiles.mapInArrow(_compare, "word string, other string, other_n long")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.select("word", "n").join(near, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")
    )
    found = stage(found, "forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    found = found.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
