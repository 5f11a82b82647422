"""Benchmark decontamination by Wu-Manber search over words.

A benchmark window (WINDOW consecutive words, or a whole shorter item) is a pattern of m words. Blocks of two words
index a shift table: a block of no pattern rules out every window around it, one that stands s words before a pattern's
end rules out the next s window ends. Where the shift is 0 the block's hash picks a bucket of patterns; those whose
words have the hashes of the text's are compared with it byte by byte.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, byte_codes, chunks, mix, prefix_hash, separated, ship, span_hash, stage, words

WINDOW = 10
#: Benchmark text that one pass over the documents holds in memory (its tables take about four times as much); a larger
#: benchmark takes more passes.
PASS_BYTES = 32 << 20
_TABLE_BITS = 20

_ASCII = np.arange(256)
IS_WORD = ((_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x41) & (_ASCII <= 0x5A)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))).astype(np.int8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLACE = mix(np.arange(101, 103, dtype=U64)) | U64(1)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, word starts and ends, word hashes, first word of each document (and the end)."""
    buf, at = separated(data, offsets)
    buf = _LOWER[buf]
    start, end = words(buf, IS_WORD)
    return buf, start, end, span_hash(prefix_hash(buf, byte_codes(False)), start, end), np.searchsorted(start, at)


def _blocks(w: np.ndarray, size: int) -> np.ndarray:
    """At i the hash of the `size` words that end at i + size - 1."""
    h = np.zeros(max(0, len(w) - size + 1), U64)
    for k in range(size):
        h += w[k : k + len(h)] * _PLACE[k]
    return mix(h)


class Patterns:
    """The windows of some items, by length: shift table, suffix buckets and the items' words."""

    def __init__(self, items: list[tuple[str, str]]):
        texts = [(text or "").encode("utf-8", "surrogatepass") for _, text in items]
        offsets = np.cumsum([0, *map(len, texts)])
        self.names = [item for item, _ in items]
        self.buf, self.start, self.end, self.hash, first = _tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
        count = np.diff(first)
        self.groups = []
        for m in sorted(set(np.minimum(count[count > 0], WINDOW).tolist())):
            item = np.flatnonzero(np.minimum(count, WINDOW) == m)
            size = count[item] - m + 1
            item = np.repeat(item, size)
            begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
            width = min(2, m)
            reach, block = m - width + 1, _blocks(self.hash, width)
            shift = np.full(1 << _TABLE_BITS, reach, np.uint8)
            for k in range(reach):  # the block k words into a window ends reach - 1 - k words before it does
                np.minimum.at(shift, (block[begin + k] & U64((1 << _TABLE_BITS) - 1)).astype(np.int64), np.uint8(reach - 1 - k))
            suffix = block[begin + m - width]
            order = np.argsort(suffix, kind="stable")
            self.groups.append((m, width, reach, shift, suffix[order], begin[order], item[order]))

    def find(self, buf, start, end, w, first):
        """(start word, length, item) of every occurrence within one document."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for m, size, reach, shift, suffix, begins, items in self.groups:
            if len(w) < m:
                continue
            b = _blocks(w, size)  # b[i] ends at word i + size - 1
            code = (b & U64((1 << _TABLE_BITS) - 1)).astype(np.int64)
            probe = np.arange(0, len(b), reach)
            s = shift[code[probe]].astype(np.int64)
            probe, s = probe[s < reach], s[s < reach]
            count = reach - s
            ends = np.repeat(probe + s, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ends = ends[ends < len(b)]
            ends = ends[shift[code[ends]] == 0]
            begin = ends + size - m
            ends, begin = ends[begin >= 0], begin[begin >= 0]
            same = doc[begin] == doc[begin + m - 1]
            ends, begin = ends[same], begin[same]
            lo = np.searchsorted(suffix, b[ends], "left")
            found = np.searchsorted(suffix, b[ends], "right") - lo
            pattern = np.repeat(lo, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
            begin = np.repeat(begin, found)
            for k in range(m):
                alike = w[begin + k] == self.hash[begins[pattern] + k]
                begin, pattern = begin[alike], pattern[alike]
            checked: dict[tuple[int, int], bool] = {}
            for i, p in zip(begin.tolist(), pattern.tolist(), strict=True):
                at = int(begins[p])
                for x, y in zip(range(i, i + m), range(at, at + m), strict=True):
                    if (x, y) not in checked:
                        checked[x, y] = bool(np.array_equal(buf[start[x] : end[x]], self.buf[self.start[y] : self.end[y]]))
                    if not checked[x, y]:
                        break
                else:
                    yield i, m, self.names[items[p]]


def _scan(patterns: Patterns, at: int, first: int):
    """columns -> (those from `first` on, n_words, hits, items); the text is column `at`."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches):
        for batch in batches:
            n_words, hits, items = [], [], []
            for _, n, data, offsets in chunks(batch.column(at)):
                buf, start, end, w, begin = _tokens(data, offsets)
                mark, names = np.zeros(len(w) + 1, np.int64), defaultdict(set)
                for i, m, item in patterns.find(buf, start, end, w, begin):
                    mark[i] += 1
                    mark[i + m] -= 1
                    names[int(np.searchsorted(begin, i, "right")) - 1].add(item)
                hit = np.cumsum(mark[:-1]) > 0
                for k in range(n):
                    a, z = int(begin[k]), int(begin[k + 1])
                    n_words.append(z - a)
                    runs = []
                    if k in names:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].astype(np.int8), [0]])))
                        runs = [{"first": int(x), "after": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    hits.append(runs)
                    items.append(sorted(names.get(k, ())))
            found = [pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *found], [*batch.schema.names[first:], "n_words", "hits", "items"])

    return run


#: Maximal runs of hits, which can overlap or touch.
_MERGED = """aggregate(array_sort(hits), cast(array() as array<struct<first: long, after: long>>), (s, x) ->
    if(size(s) > 0 and x.first <= element_at(s, -1).after,
       concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'after', greatest(element_at(s, -1).after, x.after)))),
       concat(s, array(named_struct('first', x.first, 'after', x.after)))))"""


def contamination(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, n_words, hits, n_hit, items), a row for each input row.

    Words are runs of a-z (A-Z folded), 0-9 and any character beyond ASCII. hits: the maximal runs of word positions
    [first, after) inside occurrences of benchmark windows; n_hit: their words; items: the ids (as strings, sorted) of
    the items that occur. Null and wordless texts have no words and no hits; null or wordless items never occur;
    repeated items and rows count as they stand; an empty benchmark hits nothing. Columns of docs that keep does not
    name are left out; text names the column that holds the texts. The benchmark is held in memory pass_bytes of text at a time (one longer item whole); beyond
    that, further passes read the documents again, and each pass keeps in the shared folder only the documents it hits.
    """
    spark = docs.sparkSession
    ship(spark)
    own, keep = keep, tuple(f"_c{i}" for i in range(len(keep)))  # docs can have columns of any name
    alone = [] if text in own else [F.col(text).alias("_text")]
    docs = docs.select(*alone, *[F.col(c).alias(k) for c, k in zip(own, keep, strict=True)])
    text = "_text" if alone else keep[own.index(text)]
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = "n_words long, hits array<struct<first: long, after: long>>, items array<string>"

    def scan(rows: DataFrame, part: DataFrame, names: tuple[str, ...], schema: str) -> DataFrame:
        patterns = Patterns([(r.item, r.text) for r in part.collect()])
        sent = names if text in names else (text, *names)
        return rows.select(*sent).mapInArrow(_scan(patterns, sent.index(text), len(sent) - len(names)), f"{schema}, {added}")

    if passes == 1:
        found = scan(docs, items, keep, kind)
    else:
        rows = docs.withColumn("_row", F.monotonically_increasing_id())
        hit = None
        for k in range(passes):
            one = scan(rows, items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k), ("_row",), "_row long")
            one = stage(one.where(F.size("items") > 0).drop("n_words"), "hits")
            hit = one if hit is None else hit.unionByName(one)
        hit = hit.groupBy("_row").agg(
            F.flatten(F.collect_list("hits")).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
        )
        found = scan(rows, items.limit(0), ("_row", *keep), f"_row long, {kind}").join(hit, "_row", "left")
        found = found.withColumns({"hits": F.coalesce("_hits", "hits"), "items": F.coalesce("_items", "items")})
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    found = found.withColumn("hits", F.expr(_MERGED)) if passes > 1 else found
    found = found.select(*keep, "n_words", "hits", n_hit.alias("n_hit"), "items")
    return found.toDF(*own, "n_words", "hits", "n_hit", "items")
