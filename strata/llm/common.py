"""Shared pieces of the training-data operators: staging tables, Arrow text buffers, word and shingle hashes.

Everything here runs inside Spark tasks on bounded chunks of one Arrow batch; the shuffles and joins are Spark's.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.clean import shared_root

#: Bytes of text that one numpy step handles at once (a longer single document is handled alone).
CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/strata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._strata_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of stage() once nothing is to read it any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._strata_at)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, and bounds the rows of an Arrow batch (texts can be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    at = os.path.join(tempfile.mkdtemp(prefix="strata-"), "strata.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, chosen by the hash of key, or all if there are no more: the count is one number on the
    driver and the choice is made where the rows are, so nothing grows with the number of partitions. Runs a job."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * rows / total))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key of `on` and, as _n, how many rows of left have it.

    A key that holds more than a task's share of left's `rows` rows does not go through the shuffle: there are at most a
    few such keys for each partition, so their rows of right are broadcast and left's stay where they are. `how` is
    inner or left; left is read twice, so it should be a table or little work."""
    most = max(64, rows // (4 * partitions(left.sparkSession)))
    hot = F.broadcast(right.where(F.col("_n") > most).drop("_n"))  # fewer than 4 rows for each partition
    cold = left.join(hot.select(*on), on, "left_anti").join(right.where(F.col("_n") <= most).drop("_n"), on, how)
    return left.join(hot, on).unionByName(cold)


def whole_runs(batches, column: str, rows: int):
    """Tables of at least `rows` rows, cut from sorted batches only where the column's value changes."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        if count >= rows:
            edge = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
            if len(edge):
                a = int(edge[0])
                if a:
                    held.append(batch.slice(0, a))
                yield pa.Table.from_batches(held).combine_chunks()
                held, count, batch = [], 0, batch.slice(a)
        held.append(batch)
        count, last = count + batch.num_rows, key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 on an array of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(2 * n, 1 << 16)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]).cumprod(dtype=U64) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; with fold_case A-Z share the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold_case:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


def prefix_hash(buf: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] (mod 2**64) a polynomial of bytes i..j-1; see span_hash."""
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum(codes[buf] * powers(len(buf))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


def chunks(column: pa.Array, most: int | None = None):
    """Yields (first row, row count, bytes, offsets) over runs of rows of about `most` bytes (CHUNK_BYTES); nulls are empty."""
    most = CHUNK_BYTES if most is None else most
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def separated(data: np.ndarray, offsets: np.ndarray, separator: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """The documents with one separator byte after each, and where each starts (and the end)."""
    lens = np.diff(offsets)
    out = np.full(len(data) + len(lens), separator, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(lens)), lens)] = data
    return out, offsets + np.arange(len(offsets))


def words(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; buf ends with a separator."""
    flag = np.zeros(len(buf) + 1, np.int8)
    flag[1:] = is_word[buf]
    edge = np.diff(flag)
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    return start, end


#: Word bytes of the shingle operators: everything but the blank and the bytes 0x09-0x0D.
SHINGLE_WORD = np.ones(256, np.int8)
SHINGLE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_PLACE = mix(np.arange(11, 27, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yields for each row the sorted distinct 64-bit hashes of its word shingles (A-Z folded; few words: one shingle)."""
    codes = byte_codes(True)
    for _, n, data, offsets in chunks(column):
        buf, at = separated(data, offsets)
        start, end = words(buf, SHINGLE_WORD)
        w = span_hash(prefix_hash(buf, codes), start, end)
        first = np.searchsorted(start, at)
        if len(w) >= width:
            s = np.zeros(len(w) - width + 1, U64)
            for k in range(width):
                s += w[k : k + len(s)] * _PLACE[k]
            s = mix(s)
        for k in range(n):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                yield mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, U64)
