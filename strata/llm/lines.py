"""Removal of lines that many documents share.

A first scan hashes each line once a document into two Bloom filters, of the places seen once and those seen twice. Only
lines whose places are all seen twice are suspected repeats: their texts alone are shuffled, to count the documents that
hold each and to choose the one that keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bloom
from strata.llm.common import byte_codes, chunks, join_hot, prefix_hash, separated, ship, span_hash, stage

#: Text of repeated lines that is broadcast; beyond it their rows are joined.
HELD_BYTES = 32 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _lines(data: np.ndarray, offsets: np.ndarray, least: int):
    """Bytes with a newline after each document; start, end and document of each line; then of the lines whose key has
    `least` code points the line's number, the key's start and end, and its hash."""
    buf, at = separated(data, offsets, 0x0A)
    end = np.flatnonzero(buf == 0x0A)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    doc = np.searchsorted(at, start, "right") - 1
    solid = np.flatnonzero(~_SPACE[buf])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    number = np.flatnonzero(j > i)
    a, z = solid[i[number]], solid[j[number] - 1] + 1
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = points[z] - points[a] >= least
    number, a, z = number[long], a[long], z[long]
    return buf, start, end, doc, number, a, z, span_hash(prefix_hash(buf, byte_codes(True)), a, z)


def _hashes(least: int):
    """text -> (h, n): the hash of each key of a chunk and in how many of its documents it is, 2 for more."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                _, _, _, doc, number, _, _, h = _lines(data, offsets, least)
                order = np.lexsort((doc[number], h))
                h, d = h[order], doc[number][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2))], ["h", "n"])

    return run


def _suspects(least: int, twice: bloom.Bits):
    """(text, id) -> (key, docs, lines, last): of each chunk the suspected keys, the documents and lines that have it
    and the largest id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            found: dict[bytes, list] = {}
            for first, _, data, offsets in chunks(batch.column(0)):
                buf, _, _, doc, number, a, z, h = _lines(data, offsets, least)
                raw = buf.tobytes()
                for k in np.flatnonzero(twice.has(h)).tolist():
                    row = first + int(doc[number[k]])
                    of = found.setdefault(raw[a[k] : z[k]].translate(_LOWER), [0, 0, None, -1])
                    of[1] += 1
                    if of[3] != row:  # the rows of a batch come in order
                        of[0], of[3], it = of[0] + 1, row, ids[row].as_py()
                        of[2] = it if of[2] is None or (it is not None and it > of[2]) else of[2]
            docs, lines, last = ([v[k] for v in found.values()] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.decode("utf-8", "replace") for k in found], pa.string()), pa.array(docs, pa.int64()), pa.array(lines, pa.int64()), pa.array(last, ids.type)],
                ["key", "docs", "lines", "last"],
            )

    return run


def _occurrences(least: int, twice: bloom.Bits):
    """(text, id, row) -> (row, line, id, key) for each suspected line."""

    def run(batches):
        for batch in batches:
            for first, _, data, offsets in chunks(batch.column(0)):
                buf, _, _, doc, number, a, z, h = _lines(data, offsets, least)
                hit = np.flatnonzero(twice.has(h))
                raw, row = buf.tobytes(), first + doc[number[hit]]
                line = number[hit] - np.searchsorted(doc, doc[number[hit]])
                keys = pa.array([raw[a[k] : z[k]].translate(_LOWER).decode("utf-8", "replace") for k in hit.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(pa.array(row)), pa.array(line, pa.int64()), batch.column(1).take(pa.array(row)), keys], ["row", "line", "id", "key"]
                )

    return run


def _without(batch: pa.RecordBatch, dropped, first: int):
    """The batch's columns from `first` on, and of its texts (column 0) what stays, the lines and the dropped ones.
    dropped(first row of a chunk, its lines) -> numbers of the chunk's lines to drop."""
    texts, n_lines, n_dropped = [], [], []
    for at, n, data, offsets in chunks(batch.column(0)):
        lines = _lines(data, offsets, 1)
        buf, start, end, doc = lines[:4]
        stays = np.ones(len(start), bool)
        stays[dropped(at, lines)] = False
        raw, all_lines = buf.tobytes(), np.bincount(doc, minlength=n)
        kept = np.bincount(doc[stays], minlength=n)
        begin = np.searchsorted(doc, np.arange(n))
        for k in range(n):
            i, j = int(begin[k]), int(begin[k]) + int(all_lines[k])
            if kept[k] == all_lines[k]:
                texts.append(raw[start[i] : end[j - 1]])
            else:
                texts.append(b"\n".join(raw[start[x] : end[x]] for x in range(i, j) if stays[x]))
        n_lines += all_lines.tolist()
        n_dropped += (all_lines - kept).tolist()
    found = [pa.array(texts, pa.binary()).view(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    names = [f"k{i}" for i in range(batch.num_columns - first)]
    return pa.RecordBatch.from_arrays([*batch.columns[first:], *found], [*names, "text", "n_lines", "n_dropped"])


def _drop_known(least: int, keys: list[str], keepers: list):
    """(text, id, ..) -> _without the lines whose key is known and whose keeper has another id."""
    of = dict(zip((k.encode() for k in keys), keepers, strict=True))
    hashes = np.zeros(0, np.uint64)
    for _, _, data, offsets in chunks(pa.array(keys, pa.string())):
        hashes = np.union1d(hashes, span_hash(prefix_hash(data, byte_codes(True)), offsets[:-1], offsets[1:]))

    def run(batches):
        for batch in batches:
            ids = batch.column(1)

            def dropped(first, lines, ids=ids):
                buf, _, _, doc, number, a, z, h = lines
                out = []
                for k in np.flatnonzero(np.isin(h, hashes)).tolist():
                    key = buf[a[k] : z[k]].tobytes().translate(_LOWER)
                    if key in of and of[key] != ids[first + int(doc[number[k]])].as_py():
                        out.append(int(number[k]))
                return out

            yield _without(batch, dropped, 2)

    return run


def _drop_listed(batches):
    """(text, numbers of lines to drop, ..) -> _without them."""
    for batch in batches:
        listed = batch.column(1)

        def dropped(first, lines, listed=listed):
            doc, out = lines[3], []
            n = int(doc[-1]) + 1 if len(doc) else 0
            begin = np.searchsorted(doc, np.arange(n))
            for k in range(n):
                out += [int(begin[k]) + x for x in listed[first + k].as_py() or ()]
            return out

        yield _without(batch, dropped, 2)


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ("doc_id",), text: str = "text", held_bytes: int = HELD_BYTES
) -> DataFrame:
    """docs(doc_id, text) -> (keep.., text, n_lines, n_dropped), a row for each input row.

    Lines are split at \\n; a line's key is the line without blanks and \\x09-\\x0D at its ends, A-Z folded. A key of
    min_chars code points found in min_docs rows loses all its lines but those of the rows with the largest doc_id that
    hold it. Rows count as documents of their own even where doc_ids repeat; a null doc_id is smaller than any other.
    Null texts are empty: one empty line, kept. With all lines dropped the text is empty. An empty table stays empty;
    columns of docs that keep does not name are left out.
    The filters hold 16 bits for each min_chars bytes of text, up to 64 MiB; a fuller filter makes more lines suspected
    and loses none. Repeated lines of up to held_bytes are broadcast, else they are joined with their rows.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(F.col(text).alias("text"), F.col("doc_id").alias("id"), *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)])
    id_type = source.schema["id"].dataType.simpleString()
    kinds = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in names)
    out = f"{kinds}text string, n_lines long, n_dropped long"

    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    hashes = source.select("text").mapInArrow(_hashes(min_chars), "h long, n long")
    twice = bloom.build(hashes, bloom.size_for(total // max(1, min_chars)), times=2)
    suspects = source.select("text", "id").mapInArrow(_suspects(min_chars, twice), f"key string, docs long, lines long, last {id_type}")
    repeats = suspects.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("lines").alias("_n"), F.max("last").alias("last"))
    repeats = stage(repeats.where(F.col("docs") >= min_docs).select("key", "_n", "last"), "repeats")
    held, lines = repeats.agg(F.sum(F.octet_length("key").cast("long") + 64), F.sum("_n")).first()
    if (held or 0) <= held_bytes:
        known = repeats.select("key", "last").collect()
        found = source.mapInArrow(_drop_known(min_chars, [r.key for r in known], [r["last"] for r in known]), out)
    else:
        rows = stage(source.withColumn("row", F.monotonically_increasing_id()), "lines")
        suspected = rows.select("text", "id", "row").mapInArrow(_occurrences(min_chars, twice), f"row long, line long, id {id_type}, key string")
        suspected = stage(suspected, "suspected")
        gone = join_hot(suspected, repeats, ["key"], lines).where(~F.col("id").eqNullSafe(F.col("last")))
        gone = gone.groupBy("row").agg(F.collect_list("line").alias("gone"))
        found = rows.join(gone, "row", "left").select("text", "gone", *names).mapInArrow(_drop_listed, out)
    return found.toDF(*keep, "text", "n_lines", "n_dropped")
