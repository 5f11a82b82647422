"""Exact repeated substrings by a distributed, sparse suffix array.

A byte string of SPAN bytes is found through one suffix: the one that starts at the string's minimizer (the least hash
among its GRAM-byte grams), so equal strings meet at equal suffixes and only about one suffix in (SPAN - GRAM) / 2
bytes is sorted. Suffixes whose leading gram is unique can't repeat and go no further. The others carry the bytes that
the strings at their minimizer cover, before it and after it; Spark's sampled splitters range-partition them by their
leading bytes, and a partition is read in buckets of bounded size. A bucket sorts its suffixes by multikey quicksort,
eight bytes at a time, and the bytes before them, backwards, in the same way. Of the two arrays with their longest
common prefixes, strings are equal where both their parts after and before the minimizer are, byte by byte. Suffixes
whose leading gram can go on in another bucket are compared across the boundary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, byte_codes, chunks, discard, partitions, prefix_hash, ship, span_hash, stage

SPAN, GRAM = 200, 40
#: Suffixes of a bucket, about.
BUCKET = 8192
#: Strings at a boundary that go out at once.
EDGE_ROWS = 50_000
#: One suffix in so many is looked at to find the grams that are spread over tasks ahead of the join.
SAMPLE = 16
_CODES = byte_codes(False)
_PLACE_BITS = U64((1 << 21) - 1)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (van Herk)."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, U64(0xFFFFFFFFFFFFFFFF))
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """Yields (gram hash, document, place, first and last start) of the suffixes at minimizers: each string of span
    bytes that starts between first and last has its minimizer at place. All places are within data."""
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    w, step = span - gram + 1, 1 << 20
    for at in range(0, len(data) - span + 1, step):
        part = data[at : at + step + span - 1]
        h = prefix_hash(part, _CODES)
        i = np.arange(len(part) - gram + 1)
        key = span_hash(h, i, i + gram)
        place = _least((key & ~_PLACE_BITS) | i.astype(U64), w) & _PLACE_BITS
        start = np.flatnonzero(room[at : at + len(place)] >= span)
        if not len(start):
            continue
        place = place[start].astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(cut[1:], len(start)) - 1
        yield key[place[cut]], doc[at + start[cut]], at + place[cut], at + start[cut], at + start[last]


def _keys(span: int, gram: int):
    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for i, _, data, offsets in chunks(batch.column(1)):
                for key, doc, place, _, _ in _anchors(data, offsets, span, gram):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(uid[i + doc]), pa.array((place - offsets[doc]).astype(np.int32))], ["key", "uid", "place"]
                    )

    return run


def _ragged(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _suffixes(span: int, gram: int):
    """(uid, text, places) -> the suffixes at these places: (right, left, uid, first)."""

    def run(batches):
        for batch in batches:
            uid, places = batch.column(0).to_numpy(), batch.column(2)
            for i, n, data, offsets in chunks(batch.column(1)):
                own = places.slice(i, n)
                base = np.repeat(offsets[:-1], pc.list_value_length(own).to_numpy())
                wanted = np.unique(own.flatten().to_numpy() + base)
                for _, doc, place, first, last in _anchors(data, offsets, span, gram):
                    # A place can stand for several runs of starts (equal grams further on).
                    keep = np.isin(place, wanted)
                    doc, place, first, last = doc[keep], place[keep], first[keep], last[keep]
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [_ragged(data, place, last + span), _ragged(data, first, place), pa.array(uid[doc + i]), pa.array(first - offsets[doc])],
                            ["right", "left", "uid", "first"],
                        )

    return run


_MASKS = np.array([0] + [((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9)], U64)
_STEPS = np.array([1 << (64 - 8 * k) for k in range(1, 8)], U64)


def multikey_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the byte strings data[start : start + size], all groups at once: (order, lcp).

    A pass orders the strings of each group that is still tied by its next eight bytes and cuts the group where they
    differ. lcp[i] is the longest common prefix of strings i - 1 and i of the order; data ends with eight spare bytes."""
    token = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))
    n, depth = len(start), 0
    order, group, lcp = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n if n > 1 else 0)
    while len(live):
        own = order[live]
        rest = np.clip(size[own] - depth, 0, 8)
        key = token[np.minimum(start[own] + depth, len(token) - 1)].astype(U64) & _MASKS[rest]
        by = np.lexsort((size[own], key, group[live]))  # of equal bytes the shorter string first
        own, key, in_group = own[by], key[by], group[live]
        order[live] = own
        inside = in_group[1:] == in_group[:-1]
        differs = key[1:] != key[:-1]
        at = np.flatnonzero(inside & differs) + 1
        lcp[live[at]] = depth + (key[at] ^ key[at - 1] < _STEPS[:, None]).sum(axis=0)
        first = np.concatenate([[True], ~inside | differs])
        cut = np.append(np.flatnonzero(first), len(live))
        group[live] = np.repeat(live[cut[:-1]], np.diff(cut))
        depth += 8
        longest = np.maximum.reduceat(size[own], cut[:-1])
        open_ = np.repeat((np.diff(cut) > 1) & (longest > depth), np.diff(cut))
        done = np.flatnonzero(~open_ & ~first)  # equal to the end of the shorter one
        lcp[live[done]] = size[own[done - 1]]
        live = live[open_]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, lcp


def _classes(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """For each string the class of its first `length` bytes; strings at least so long are equal there if it is."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(lcp < length, np.arange(len(order)), 0))
    return out


class Suffixes:
    """Suffixes of a bucket: (right, left) bytes from and before the minimizer, document and first start of each."""

    def __init__(self, batches: list[pa.RecordBatch], span: int):
        t = pa.Table.from_batches(batches).combine_chunks()
        self.span, self.n = span, t.num_rows
        self.uid, self.first = t.column("uid").to_numpy(), t.column("first").to_numpy()
        right, left = t.column("right").to_pylist(), t.column("left").to_pylist()
        self.right, self.left = np.array([len(x) for x in right], np.int64), np.array([len(x) for x in left], np.int64)
        self.data = np.frombuffer(b"".join(x for pair in zip(left, right, strict=True) for x in pair) + bytes(8), np.uint8)
        self.at = np.cumsum(self.left + self.right) - self.right  # where each minimizer stands

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Two tables [suffix, bytes before the minimizer] of the strings: which repeat here, and which of them is one
        of its equals, chosen to speak for all."""
        low, high = self.span - self.right, self.left
        after = multikey_sort(self.data, self.at, self.right)
        back = np.concatenate([self.data[:-8][::-1], np.zeros(8, np.uint8)])
        before = multikey_sort(back, len(self.data) - 8 - self.at, self.left)
        again, speaks = np.zeros((2, self.n, int(high.max()) + 1), bool)
        for d in range(int(low.min()), int(high.max()) + 1):
            row = np.flatnonzero((low <= d) & (d <= high))
            key = _classes(*after, self.span - d)[row] * self.n + _classes(*before, d)[row]
            by = np.argsort(key, kind="stable")
            same = np.concatenate([[False], key[by[1:]] == key[by[:-1]], [False]])
            again[row[by], d] = same[1:] | same[:-1]
            speaks[row[by], d] = same[1:] & ~same[:-1]
        return again, speaks


_FOUND = {"uid": pa.int64(), "start": pa.int64(), "after": pa.int64(), "digest": pa.binary(), "weight": pa.int32()}


def _found(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FOUND.items()], list(_FOUND))


def _solve(batches: list[pa.RecordBatch], span: int, gram: int, edges: set[bytes]):
    """The repeats of a bucket as runs of bytes, and the strings of its suffixes whose gram is one of edges."""
    s = Suffixes(batches, span)
    again, speaks = s.repeats()
    # Strings of a suffix by start: the more bytes before the minimizer, the earlier.
    width = again.shape[1]
    padded = np.zeros((s.n, width + 2), np.int8)
    padded[:, 1:-1] = again[:, ::-1]
    step = np.diff(padded, axis=1)
    (row, a), (_, z) = np.nonzero(step == 1), np.nonzero(step == -1)
    start_of = s.first + s.left - (width - 1)
    if len(row):
        yield _found(uid=s.uid[row], start=start_of[row] + a, after=start_of[row] + z - 1 + span)
    edge = np.array([s.data[i : i + gram].tobytes() in edges for i in s.at.tolist()], bool)
    if not edge.any():
        return
    d, raw = np.arange(width), s.data.tobytes()
    inside = (span - s.right[:, None] <= d) & (d <= s.left[:, None]) & edge[:, None]
    for hit, weight in ((inside & ~again, 1), (inside & speaks, 2)):
        rows, befores = np.nonzero(hit)
        for i in range(0, len(rows), EDGE_ROWS):
            row, before = rows[i : i + EDGE_ROWS], befores[i : i + EDGE_ROWS]
            digests = [hashlib.blake2b(raw[x : x + span], digest_size=16).digest() for x in (s.at[row] - before).tolist()]
            start = s.first[row] + s.left[row] - before if weight == 1 else np.full(len(row), -1)
            yield _found(uid=s.uid[row], start=start, digest=digests, weight=np.full(len(row), weight, np.int32))


def _buckets(span: int, gram: int, size: int):
    """One range partition, sorted by leading gram, in buckets of about `size` suffixes.

    A bucket ends where the gram changes, so its repeats are all its own, unless one gram has more suffixes than two
    buckets hold; that gram and those at the ends of the partition are edges, which other buckets can share. Rows out:
    (uid, start, after) for runs that repeat here, (uid, start, digest, weight) for strings at edges."""

    def run(batches):
        held, count, edges, last = [], 0, set(), None
        for batch in batches:
            a, heads = 0, [x.as_py()[:gram] for x in batch.column(0)]
            for i, head in enumerate(heads):
                fresh = head != last
                if last is None:
                    edges.add(head)
                if (fresh and count >= size) or count >= 2 * size:
                    if not fresh:
                        edges.add(head)
                    yield from _solve([*held, batch.slice(a, i - a)], span, gram, edges)
                    held, count, a, edges = [], 0, i, set() if fresh else {head}
                last, count = head, count + 1
            held.append(batch.slice(a))
        if count:
            yield from _solve(held, span, gram, edges | {last})

    return run


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["after"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("after", pa.int64())]))
    for batch in batches:
        spans, kept = [], []
        for text, found in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            raw, own = bytes(raw), _union(found or [])
            spans.append([{"start": a, "after": z} for a, z in own])
            at, parts = 0, []
            for a, z in own:
                parts.append(raw[at:a])
                at = z
            kept.append(b"".join([*parts, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], ["uid", "doc_id", "spans", "kept"])


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs(uid long, text) -> (uid, spans array<struct<start, after>>) of the documents in which some byte is covered
    by a `span`-byte string (of the text in UTF-8) that also starts elsewhere, in this document or another. The spans
    can touch or overlap. uid must be unique and stable. Null and shorter texts have none."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    keys = stage(docs.select("uid", "text").mapInArrow(_keys(span, gram), "key long, uid long, place int"), "keys")
    found = stage(_repeated_keys(keys, n).groupBy("uid").agg(F.collect_set("place").alias("places")), "places")
    discard(keys)
    suffixes = docs.join(found, "uid").select("uid", "text", "places").mapInArrow(
        _suffixes(span, gram), "right binary, left binary, uid long, first long"
    )
    # Splitters are sampled on short keys: the leading gram, then what spreads a common one over several partitions.
    lead = F.substring("right", 1, gram)
    ranges = suffixes.repartitionByRange(n, lead, F.xxhash64("right", "left"), "uid", "first").sortWithinPartitions(lead)
    out = stage(ranges.mapInArrow(_buckets(span, gram, BUCKET), "uid long, start long, after long, digest binary, weight int"), "repeats")
    edges = out.where("digest is not null")
    more = edges.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1")
    across = edges.where("start >= 0").join(more, "digest", "left_semi").select("uid", "start", (F.col("start") + span).alias("after"))
    marks = out.where("digest is null").select("uid", "start", "after").union(across)
    return marks.groupBy("uid").agg(F.collect_list(F.struct("start", "after")).alias("spans"))


def _repeated_keys(keys: DataFrame, n: int) -> DataFrame:
    """keys(key, uid, place) -> (uid, place) of the keys with several rows.

    Keys that a sample shows to hold more rows than a task's share don't go through the join: there are at most a few
    for each of the n partitions, so they are broadcast, and their rows stay where they are."""
    some = keys.where(F.pmod(F.xxhash64("uid", "place"), F.lit(SAMPLE)) == 0)
    common = some.groupBy("key").agg(F.count("*").alias("n"))
    total = keys.count() // SAMPLE
    hot = F.broadcast(common.where(F.col("n") >= max(8, total // (4 * n))).select("key"))  # about 4 * n rows at most
    rest = keys.join(hot, "key", "left_anti")
    twice = rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(hot, "key", "left_semi").select("uid", "place").union(rest.join(twice, "key", "left_semi").select("uid", "place"))


def _rewrite(at: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not found:
                    out.append(text.as_py())
                    continue
                raw, end, parts = bytes(text.as_buffer()), 0, []
                for a, z in _union(found):
                    parts.append(raw[end:a])
                    end = z
                out.append(b"".join([*parts, raw[end:]]).decode("utf-8", "ignore"))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with its own columns and rows, each text rid of its repeated strings; a character that is cut in part goes
    whole. Null and unaffected texts stay as they are. Same rules as remove_repeats."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # docs can have columns of any name
    at = docs.columns.index("text")
    rows = docs.toDF(*names).withColumn("_uid", F.monotonically_increasing_id())
    spans = stage(repeated_spans(rows.select(F.col("_uid").alias("uid"), F.col(names[at]).alias("text")), span), "spans")
    both = rows.join(spans.select(F.col("uid").alias("_uid"), F.col("spans").alias("_spans")), "_uid", "left")
    kind = rows.select(*names).schema
    return both.select(*names, "_spans").mapInArrow(_rewrite(at), kind).toDF(*docs.columns)


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, spans, kept binary), a row for each input row.

    Every byte of the text's UTF-8 that a repeated string of `span` bytes covers is removed; strings are judged on the
    input, so all copies of a passage go. spans: the maximal removed runs [start, after); kept: the remaining bytes,
    null where nothing was removed (then it is the text itself). A null text counts as empty; rows that repeat a doc_id are documents
    of their own; an empty table gives no rows; other columns are ignored. docs must give the same rows when it is
    read again, as tables do.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    spans = stage(repeated_spans(rows.select("uid", "text"), span), "spans")
    doc = docs.schema["doc_id"].dataType.simpleString()
    kind = "array<struct<start: long, after: long>>"
    cut = rows.join(spans, "uid").select("uid", "doc_id", "text", "spans").mapInArrow(_cut, f"uid long, doc_id {doc}, spans {kind}, kept binary")
    cut = cut.select("uid", F.col("spans").alias("cuts"), "kept")
    whole = rows.select("uid", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    out = whole.join(cut, "uid", "left").withColumn("spans", F.coalesce("cuts", F.expr(f"cast(array() as {kind})")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "spans",
        "kept",
        F.when(F.col("kept").isNull(), F.col("text_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )
