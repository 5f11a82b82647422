"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers and dealt into groups of blocks. A block stores, for each attribute, bitmaps (slices)
of the top SLICES bits of its values. A query's score bound is the sum of the slices weighted with its components, added
as bitmaps with carry-save adders; the k-th bound is found from the most significant slice of the sum downward, rows
that the dropped low bits could still lift over it form the boundary, and only those are scored exactly. A task slices
the blocks of a group once and streams all queries past them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import U64, partitions, ship

SLICES = 7
#: Vectors of a block, blocks of a group, and queries that meet a block at once.
BLOCK, GROUP, QUERIES = 2048, 32, 128
#: Scores that can reach this need wider integers than the slices' arithmetic has.
WIDE = 1 << 62
ALL = U64(0xFFFFFFFFFFFFFFFF)


def _pack(rows: np.ndarray) -> np.ndarray:
    """Booleans [..., n] to bitmaps [..., words]; n is a multiple of 64."""
    return np.packbits(rows, axis=-1, bitorder="little").view(U64)


class SlicedBlock:
    """The slices of some integer vectors [n, dims]."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.low = values.min(axis=0)
        up = values - self.low
        self.bits = max(1, int(up.max()).bit_length()) if dims else 1
        self.dropped = max(0, self.bits - SLICES)
        padded = np.zeros((-(-n // 64) * 64, dims), np.int64)
        padded[:n] = up >> self.dropped
        kept = self.bits - self.dropped
        self.slices = _pack(((padded.T[:, None, :] >> np.arange(kept)[None, :, None]) & 1).astype(bool))
        valid = np.zeros(len(padded), bool)
        valid[:n] = True
        self.valid = _pack(valid)

    def weighted_sum(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the sum over dims of |q| times the value's top bits (complemented where q < 0)."""
        size, negative = np.abs(q), np.where(q < 0, ALL, U64(0))[:, :, None]
        held: list[list[np.ndarray]] = []

        def add(at: int, plane: np.ndarray) -> None:
            while True:
                while len(held) <= at:
                    held.append([])
                own = held[at]
                if len(own) < 2:
                    own.append(plane)
                    return
                x, y = own.pop(), own.pop()
                half = x ^ y
                own.append(half ^ plane)
                plane = (x & y) | (half & plane)  # the carry goes one slice up
                at += 1

        width = int(size.max()).bit_length() if size.size else 0
        for d in range(q.shape[1]):
            planes = [s[None, :] ^ negative[:, d] for s in self.slices[d]]
            for j in range(width):
                mask = np.where((size[:, d] >> j) & 1, ALL, U64(0))[:, None]
                if mask.any():
                    for i, plane in enumerate(planes):
                        add(i + j, plane & mask)
        out, carry, at = [], None, 0
        zero = np.zeros((len(q), len(self.valid)), U64)
        while at < len(held) or carry is not None:
            own = list(held[at]) if at < len(held) else []
            x, y, c = [*own, *[zero] * (2 - len(own)), carry if carry is not None else zero]
            half = x ^ y
            out.append(half ^ c)
            carry = (x & y) | (half & c)
            at += 1
            if at >= len(held) and not carry.any():
                carry = None
        return out or [zero]

    def top(self, q: np.ndarray, own: np.ndarray, k: int):
        """For each query row: ids and scores of its k best rows (rows of its own id not counted)."""
        total = self.weighted_sum(q)
        others = np.zeros((len(q), 64 * len(self.valid)), bool)
        others[:, : len(self.ids)] = self.ids != own[:, None]
        valid = _pack(others)
        inside = valid
        above, level = np.zeros_like(total[0]), np.zeros(len(q), np.int64)
        for i in range(len(total) - 1, -1, -1):
            hit = inside & total[i]
            enough = (np.bitwise_count(above | hit).sum(axis=1, dtype=np.int64) >= k)[:, None]
            above = np.where(enough, above, above | hit)
            inside = np.where(enough, hit, inside & ~total[i])
            level += np.where(enough[:, 0], 1 << i, 0)
        slack = (((1 << self.dropped) - 1) * np.abs(q).sum(axis=1) >> self.dropped) + 1
        level = np.maximum(level - slack, 0)
        more, same = np.zeros_like(total[0]), valid
        for i in range(len(total) - 1, -1, -1):
            bit = (((level >> i) & 1) == 1)[:, None]
            more = np.where(bit, more, more | (same & total[i]))
            same = same & np.where(bit, total[i], ~total[i])
        chosen = np.unpackbits((more | same).view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)].astype(bool)
        for r in range(len(q)):
            rows = np.flatnonzero(chosen[r])
            score = self.values[rows] @ q[r]
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield self.ids[rows[best]], score[best]


def _wide(x: np.ndarray, scale: int) -> list[list[int]]:
    """floor(scale * x) as Python integers; from 2**53 on a float is whole."""
    return [[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()]


def _plain_top(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, scale: int):
    """The same as SlicedBlock.top with integers of any size, for components so large that scores may leave 64 bits."""
    values = _wide(x, scale)
    for mine, query in zip(own.tolist(), _wide(q, scale), strict=True):
        score = [(-sum(a * b for a, b in zip(query, v, strict=True)), i) for v, i in zip(values, ids.tolist(), strict=True) if i != mine]
        best = sorted(score)[:k]
        if any(abs(s) >= 1 << 63 for s, _ in best):
            raise OverflowError(f"a score among the {k} highest of query {mine} does not fit a long")
        yield np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


class _Group:
    """The blocks of one group, sliced when the first query comes."""

    def __init__(self, k: int, scale: int):
        self.k, self.scale, self.rows, self.blocks = k, scale, [], None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows.append((ids, x))

    def ask(self, key: np.ndarray, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        """The k best rows of the group for each query, as (query, query_id, vec_id, score)."""
        if self.blocks is None:
            ids, x = (np.concatenate(part) for part in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64), np.zeros((0, q.shape[1])))
            self.blocks, self.rows = [], []
            for i in range(0, len(ids), BLOCK):
                large = float(np.abs(x[i : i + BLOCK]).max(initial=0)) * self.scale
                sliced = SlicedBlock(ids[i : i + BLOCK], np.floor(x[i : i + BLOCK] * self.scale).astype(np.int64)) if large < WIDE else None
                self.blocks.append((ids[i : i + BLOCK], x[i : i + BLOCK], large, sliced))
        found: list[list] = [[] for _ in own]
        most = float(np.abs(q).max(initial=0)) * self.scale
        for ids, x, large, sliced in self.blocks:
            if sliced is not None and q.shape[1] * (large + 1) * (most + 1) < WIDE:
                best = sliced.top(np.floor(q * self.scale).astype(np.int64), own, self.k)
            else:
                best = _plain_top(ids, x, q, own, self.k, self.scale)
            for r, pair in enumerate(best):
                found[r].append(pair)
        out = []
        for r, parts in enumerate(found):
            ids, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
            best = np.lexsort((ids, -score))[: self.k]
            out.append((np.full(len(best), key[r]), np.full(len(best), own[r]), ids[best], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "query_id", "vec_id", "score"])


def _search(k: int, scale: int, dims: int):
    """Rows (group, query, id, x) sorted by group, vectors (query null) first."""

    def run(batches):
        group, at, key, own, asked = None, None, [], [], []

        def answer(all_: bool):
            nonlocal key, own, asked
            if key and (all_ or sum(map(len, key)) >= QUERIES):
                keys, owns, q = np.concatenate(key), np.concatenate(own), np.concatenate(asked)
                key, own, asked = [], [], []
                for i in range(0, len(keys), QUERIES):
                    yield group.ask(keys[i : i + QUERIES], owns[i : i + QUERIES], q[i : i + QUERIES])

        for batch in batches:
            of, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            is_query = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keys = pc.fill_null(batch.column(1), 0).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(-1, dims)
            cut = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]) | (is_query[1:] != is_query[:-1])) + 1, [len(of)]])
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a == z:
                    continue
                if of[a] != at:
                    yield from answer(True)
                    group, at = _Group(k, scale), of[a]
                if is_query[a]:
                    key.append(keys[a:z])
                    own.append(ids[a:z])
                    asked.append(x[a:z])
                    yield from answer(False)
                else:
                    group.add(ids[a:z], x[a:z])
        yield from answer(True)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> (query_id, rank, vec_id, score): each query's k best rows of vectors.

    Components become floor(scale * x); the score is the integer inner product; ties go to the smaller vec_id, and a
    row with the query's own vec_id is no candidate. Rows with a null vec_id, a null embedding or a null or non-finite
    component take no part; a shorter vector counts as filled up with zeros; no vectors or no queries give no rows;
    fewer than k candidates are all returned; repeated rows count as they stand, and a repeated query row is a query of
    its own; other columns are ignored. Components of any finite size are exact; a result whose score no long holds is
    an error. Every group of GROUP * BLOCK vectors meets every query once, so what the queries send grows with their
    number times the groups; a task holds one group.
    """
    spark = vectors.sparkSession
    ship(spark)

    def usable(df):
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        values = F.transform("embedding", lambda x: x.cast("double"))
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("id"), values.alias("x"))

    sizes = usable(vectors).agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    asked = usable(queries).agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    dims, n = max(sizes.dims, asked.dims, 1), partitions(spark)
    groups = max(1, -(-sizes.n // (GROUP * BLOCK)))
    # A table that fills less than a group for each partition is dealt to all partitions, so that all have work.
    groups = max(groups, min(n, -(-sizes.n // BLOCK)))
    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x"))).alias("x")
    # The row's place is hashed too: one vec_id can hold many rows.
    group = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group")
    left = usable(vectors).select(group, F.lit(None).cast("long").alias("query"), "id", filled)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    right = usable(queries).select(F.monotonically_increasing_id().alias("query"), "id", filled).select(every, "query", "id", "x")
    rows = left.unionByName(right).repartition(max(n, groups), "group").sortWithinPartitions("group", F.col("query").asc_nulls_first())
    best = rows.mapInArrow(_search(k, scale, dims), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
