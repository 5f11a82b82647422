"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found on a block-max inverted index.

Terms are words; every word of the labelled examples is in the vocabulary, and norms are over all of it. A term weighs
(1 + ln tf) * idf, times its relevance: how many standard errors its log odds between the classes lie from zero, so that
words say as much as they tell of the label and a word that no example has says nothing. Examples stand in blocks, those
with the same heaviest term together; for each term the index knows its largest weight in a block, so the sum of those
bounds every cosine in the block, and blocks that cannot reach the k-th best neighbour are never opened. Terms that many
examples have are kept as full rows, whose sums are exact and make the bounds close. The neighbours'
votes, weighted by cosine, are turned into probabilities by a logistic fitted on held-in folds.

Where the bound on examples cuts one class more than the other, each example counts for its class's share of the
labelled rows, so scores mean the same at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, byte_codes, chunks, mix, partitions, prefix_hash, separated, ship, span_hash, stage, words
from strata.llm.decontam import IS_WORD

#: Labelled examples of each class that the index holds at most (about), chosen by hash, and bytes of their texts; a
#: text longer than EXAMPLE_BYTES is no example (it is scored like any other).
EXAMPLES, CLASS_BYTES, EXAMPLE_BYTES = 4000, 64 << 20, 1 << 20
BLOCK, NEIGHBOURS = 64, 15
#: Weight of the examples' rate of label 1 among the votes.
PRIOR = 0.02
#: Parts into which the examples are split to calibrate the votes.
FOLDS = 3
#: Share of the examples from which a term's weights are kept as a full row.
FREQUENT = 1 / 40
#: Documents, and (document, term, block) entries that one step of the search holds.
ROWS, STEP = 256, 500_000
#: Cosines are rounded to so many places, so that equal texts tie.
PLACES = 6
_SLOTS = 1_000_003


def _terms(column: pa.Array):
    """Yields for runs of rows (first row, row offsets, term hashes, counts): each row's distinct words, sorted."""
    codes = byte_codes(True)
    for i, n, data, offsets in chunks(column):
        buf, at = separated(data, offsets)
        start, end = words(buf, IS_WORD)
        h, first = span_hash(prefix_hash(buf, codes), start, end), np.searchsorted(start, at)
        own = [np.unique(h[a:z], return_counts=True) for a, z in zip(first[:-1], first[1:], strict=True)]
        yield i, np.cumsum([0, *(len(t) for t, _ in own)]), np.concatenate([t for t, _ in own]), np.concatenate([c for _, c in own])


def _example_rows(batches):
    for batch in batches:
        terms, counts = [], []
        for _, cut, term, count in _terms(batch.column(1)):
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                terms.append(term[a:z].tobytes())
                counts.append(count[a:z].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "terms", "counts"]
        )


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end), and the range of each."""
    starts, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - starts, size), owner


def relevance(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Standard errors between a term's log odds in the classes; a and b are its documents of label 1 and 0 of n1 and n0.

    One document, split between the classes like all others, is added, so a term that no document has gets 0."""
    n1, n0 = max(n1, 1e-9), max(n0, 1e-9)
    a, b = a + n1 / (n1 + n0), b + n0 / (n1 + n0)
    return np.abs(np.log(a / n1) - np.log(b / n0)) / np.sqrt(1 / a + 1 / b)


class BlockMaxIndex:
    """examples: (id, label, sorted term hashes, counts); weights: for how many examples one of class 0 and one of class
    1 counts; by_relevance False leaves the plain TF-IDF weights."""

    def __init__(self, examples, weights=(1.0, 1.0), by_relevance: bool = True):
        n, self.block = len(examples), BLOCK
        labels = np.array([e[1] for e in examples], float)
        share = np.where(labels == 1, weights[1], weights[0])
        owner = np.repeat(np.arange(n), [len(e[2]) for e in examples]).astype(np.int64)
        none = [np.zeros(0, np.uint64)]
        self.vocabulary, term = np.unique(np.concatenate([*none, *(e[2] for e in examples)]), return_inverse=True)
        self.n, v = float(share.sum()), len(self.vocabulary)
        one = np.bincount(term, (share * labels)[owner], v)
        df = np.bincount(term, share[owner], v)
        factor = np.log((self.n + 1) / (df + 1)) + 1
        n1 = float((share * labels).sum())
        if by_relevance:
            factor = factor * relevance(one, np.maximum(df - one, 0), n1, self.n - n1)
        self.factor = factor.astype(np.float32)
        #: Weight of a term that no example has.
        self.unseen = 0.0 if by_relevance else float(np.log(self.n + 1) + 1)
        self.rate = (n1 + 0.5) / (self.n + 1) if n else 0.5
        weight = (1 + np.log(np.concatenate([*none, *(e[3] for e in examples)]).astype(float))) * factor[term]
        norm = np.sqrt(np.bincount(owner, weight**2, n))
        weight = np.divide(weight, norm[owner], out=np.zeros_like(weight), where=norm[owner] > 0)
        live = weight > 0
        owner, term, weight = owner[live], term[live], weight[live]
        # Examples with the same heaviest term stand together, so that blocks differ in what they hold.
        heaviest, order = np.full(n, -1), np.lexsort((term, weight))
        heaviest[owner[order]] = term[order]
        placed = np.lexsort((np.arange(n), heaviest))
        place = np.empty(n, np.int64)
        place[placed] = np.arange(n)
        self.ids, self.labels, self.share = (np.array([e[0] for e in examples], np.int64)[placed], labels[placed], share[placed])
        self.fold = folds(self.ids)
        owner = place[owner]
        order = np.lexsort((owner, term))
        owner, term, weight = owner[order], term[order], weight[order]
        self.blocks = max(1, -(-n // self.block))
        often = np.bincount(term, minlength=v) > max(n * FREQUENT, 1)
        self.row_of = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        own = often[term]
        self._often = self.row_of[term[own]], owner[own].astype(np.int32), weight[own].astype(np.float32), int(often.sum())  # by row, then owner
        self._full: np.ndarray | None = None
        rare = ~often[term]
        owner, term, weight = owner[rare], term[rare], weight[rare]
        cell = term * self.blocks + owner // self.block
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.owner, self.weight = owner.astype(np.int32), weight.astype(np.float32)
        #: Postings of each (term, block), cells of each term, and the block and largest weight of a cell.
        self.cell_at = np.append(first, len(owner)).astype(np.int32)
        self.term_at = np.searchsorted(term[first], np.arange(v + 1)).astype(np.int32)
        self.cell_block = (owner[first] // self.block).astype(np.uint16)
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)

    def __getstate__(self):
        """What tells the index, in as few bytes as it takes: it goes to every executor."""
        kept = {k: x for k, x in self.__dict__.items() if k not in ("_full", "cell_at", "term_at", "cell_most", "row_of", "owner", "_often")}
        row, owner, weight, count = self._often
        often = np.flatnonzero(self.row_of >= 0), np.bincount(row, minlength=count).astype(np.int32), owner, weight
        return kept | {"often": often, "owner": (self.owner % self.block).astype(np.uint16), "cells": np.diff(self.cell_at).astype(np.uint16), "terms": np.diff(self.term_at).astype(np.uint16)}

    def __setstate__(self, state):
        term, counts, owner, weight = state.pop("often")
        cells, terms = state.pop("cells"), state.pop("terms")
        self.__dict__.update(state, _full=None)
        self.cell_at = np.concatenate([[0], np.cumsum(cells)]).astype(np.int32)
        self.term_at = np.concatenate([[0], np.cumsum(terms)]).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.weight, self.cell_at[:-1]) if len(cells) else np.zeros(0, np.float32)
        self.row_of = np.full(len(self.vocabulary), -1, np.int32)
        self.row_of[term] = np.arange(len(term))
        self._often = np.repeat(np.arange(len(counts)), counts), owner, weight, len(counts)

    @property
    def full(self) -> np.ndarray:
        """The rows of frequent terms, made where they are used rather than sent there."""
        if self._full is None:
            row, owner, weight, count = self._often
            self._full = np.zeros((count, self.blocks * self.block), np.float32)
            self._full[row, owner] = weight
        return self._full

    def queries(self, cut: np.ndarray, term: np.ndarray, count: np.ndarray):
        """Row offsets, places in the vocabulary and weights (of unit length) of rows of term hashes and counts."""
        n, at = len(cut) - 1, np.searchsorted(self.vocabulary, term)
        row = np.repeat(np.arange(n), np.diff(cut))
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == term if len(self.vocabulary) else np.zeros(len(term), bool)
        weight = (1 + np.log(count)) * np.where(known, self.factor[at] if len(self.vocabulary) else 0.0, self.unseen)
        norm = np.sqrt(np.bincount(row, weight**2, n))
        keep = known & (weight > 0)
        row, at, weight = row[keep], at[keep], weight[keep]
        return np.searchsorted(row, np.arange(n + 1)), at, weight / norm[row]

    def nearest(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, fold: np.ndarray | None = None):
        """For rows of queries() the k best examples and their cosines [rows, k], best first; ties go to the example that
        stands earlier in the index; where fewer have a positive cosine, the rest is -1 and 0. With fold, a number for each row, no example of that
        fold is a neighbour."""
        n = len(cut) - 1
        found, cosine = np.full((n, k), -1, np.int64), np.zeros((n, k))
        held = np.concatenate([[0], np.cumsum(self.term_at[term + 1] - self.term_at[term])])[cut]
        a = 0
        while a < n:
            z = min(max(a + 1, int(np.searchsorted(held, held[a] + STEP, "right")) - 1), a + ROWS)
            self._search(cut[a : z + 1] - cut[a], term[cut[a] : cut[z]], weight[cut[a] : cut[z]], found[a:z], cosine[a:z], None if fold is None else fold[a:z])
            a = z
        return found, cosine

    def _search(self, cut, term, weight, found, cosine, fold) -> None:
        n, k = found.shape
        row, full = np.repeat(np.arange(n), np.diff(cut)), self.row_of[term]
        dense = np.zeros((n, self._often[-1]), np.float32)
        dense[row[full >= 0], full[full >= 0]] = weight[full >= 0]
        partial = (dense @ self.full).reshape(n, self.blocks, self.block)
        cell, pair = _expand(self.term_at[term], self.term_at[term + 1])
        row, weight = row[pair], weight[pair]
        spot = row * self.blocks + self.cell_block[cell]
        bound = np.bincount(spot, weight * self.cell_most[cell], n * self.blocks).reshape(n, self.blocks) + partial.max(axis=2)
        bound += (bound > 0) * 2 * 10.0**-PLACES
        order = np.argsort(-bound, axis=1, kind="stable")
        done, width = 0, 4
        rows = np.arange(n)  # those with blocks left that can reach their k-th best
        while done < self.blocks and len(rows):
            blocks = order[rows, done : done + width]
            ahead = bound[rows[:, None], blocks]
            open_ = (ahead > 0) & (ahead >= cosine[rows, -1][:, None])
            slot = np.full(n * self.blocks, -1)
            slot[(rows[:, None] * self.blocks + blocks)[open_]] = np.flatnonzero(open_)
            own = np.flatnonzero(slot[spot] >= 0)
            post, part = _expand(self.cell_at[cell[own]], self.cell_at[cell[own] + 1])
            part = own[part]
            total = np.bincount(slot[spot[part]] * self.block + self.owner[post] % self.block, weight[part] * self.weight[post], open_.size * self.block)
            total = np.round(total.reshape(*open_.shape, self.block) + partial[rows[:, None], blocks], PLACES) * open_[:, :, None]
            ids = (blocks[:, :, None] * self.block + np.arange(self.block)).reshape(len(rows), -1)
            if fold is not None:
                total *= (self.fold[np.minimum(ids, len(self.fold) - 1)] != fold[rows][:, None]).reshape(total.shape)
            cos = np.concatenate([cosine[rows], total.reshape(len(rows), -1)], axis=1)
            ids = np.where(cos > 0, np.concatenate([found[rows], ids], axis=1), np.iinfo(np.int64).max)
            if cos.shape[1] > 4 * k:  # most cosines lie below the k-th best: leave them out of the sort
                least = np.partition(cos, -k, axis=1)[:, -k]
                most = int(((cos >= least[:, None]) & (cos > 0)).sum(axis=1).max())
                pick = np.argpartition(-cos, max(most, k) - 1, axis=1)[:, : max(most, k)]
                cos, ids = np.take_along_axis(cos, pick, 1), np.take_along_axis(ids, pick, 1)
            best = np.lexsort((ids, -cos), axis=1)[:, :k]
            cosine[rows] = np.take_along_axis(cos, best, 1)
            found[rows] = np.where(cosine[rows] > 0, np.take_along_axis(ids, best, 1), -1)
            done, width = done + width, 2 * width
            if done < self.blocks:
                ahead = bound[rows, order[rows, done]]
                rows = rows[(ahead > 0) & (ahead >= cosine[rows, -1])]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The share of label 1 among the neighbours [rows, k], by cosine times class weight."""
        if not len(self.ids):
            return np.full(len(found), self.rate)
        w = cosine * self.share[found] * (found >= 0)
        return ((w * self.labels[found]).sum(axis=1) + PRIOR * self.rate) / (w.sum(axis=1) + PRIOR)


def folds(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) % U64(FOLDS)).astype(np.int8)


def probability(votes: np.ndarray, calibration: tuple[float, float]) -> np.ndarray:
    slope, shift = calibration
    return 1 / (1 + np.exp(-np.clip(slope * _logit(votes) + shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_calibration(votes: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic of the votes' log odds, with rows weighted by share; the identity for one class."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x, a, b = _logit(votes), 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = share * (p * (1 - p)) + 1e-9
        g = np.array([(share * (labels - p) * x).sum() - 1e-3 * (a - 1), (share * (labels - p)).sum() - 1e-3 * b])
        step = np.linalg.solve([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]], g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def _weights(known: dict, used: dict) -> tuple[float, float]:
    """Weights of the classes 0 and 1: rows labelled over examples used, brought to a mean of 1 over the examples."""
    stands = [known.get(k, 0) / max(used.get(k, 0), 1) for k in (0, 1)]
    total = sum(used.get(k, 0) * stands[k] for k in (0, 1))
    return tuple(w * sum(used.values()) / total if total else 1.0 for w in stands)


def _fold_votes(shared):
    """(doc_id, label, terms, counts) -> (label, vote): each example by the neighbours outside its own fold."""

    def run(batches):
        for batch in batches:
            terms = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            counts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            if len(terms):
                index, cut = shared.value, np.cumsum([0, *map(len, terms)])
                rows = index.queries(cut, np.concatenate(terms), np.concatenate(counts))
                votes = index.vote(*index.nearest(*rows, fold=folds(batch.column(0).to_numpy())))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes)], ["label", "vote"])

    return run


class Toxicity:
    """The index, as sent to the executors, and the calibration of its votes."""

    def __init__(self, index: BlockMaxIndex, shared, calibration: tuple[float, float]):
        self.index, self.shared, self.calibration = index, shared, calibration


def build_index(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, class_bytes: int = CLASS_BYTES, by_relevance: bool = True) -> Toxicity:
    """docs(doc_id, text), labels(doc_id, label 0/1) -> the index with its calibration, over at most about `examples` labelled rows
    and `class_bytes` bytes of text of each class, chosen by the hash of doc_id.

    Null labels and ids are left out, and a doc_id that repeats counts once, under its largest label and least text;
    without labels every score is 0.5, and with one class all scores tend to it."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = known.join(texts.select("doc_id", F.octet_length("text").alias("size")), "doc_id").where(F.col("size") <= EXAMPLE_BYTES)
    of = {r.label: r for r in sized.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    rate = {k: min(1.0, examples / r.n, class_bytes / max(r.size, 1)) for k, r in of.items()}
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS))
    picked = F.lit(False)
    for k, share in rate.items():
        picked = picked | ((F.col("label") == k) & (slot < int(share * _SLOTS)))
    chosen = F.broadcast(known.where(picked))  # about 2 * examples ids at most
    rows = texts.where(F.octet_length("text") <= EXAMPLE_BYTES).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = stage(rows.select("doc_id", "text", "label").mapInArrow(_example_rows, "doc_id long, label int, terms binary, counts binary"), "examples")
    got = sorted(((r.doc_id, r.label, np.frombuffer(r.terms, np.uint64), np.frombuffer(r.counts, np.int64)) for r in rows.collect()), key=lambda e: e[0])
    used = {k: sum(e[1] == k for e in got) for k in (0, 1)}
    weights = _weights({k: r.n for k, r in of.items()}, used)
    index, calibration = BlockMaxIndex(got, weights, by_relevance), (1.0, 0.0)
    shared = spark.sparkContext.broadcast(index)  # bounded like the examples
    if min(used.values()):
        votes = rows.repartition(min(64, partitions(spark))).mapInArrow(_fold_votes(shared), "label int, vote double").collect()
        votes = sorted((r.label, r.vote) for r in votes)
        y, v = np.array([x for x, _ in votes], float), np.array([x for _, x in votes])
        calibration = fit_calibration(v, y, np.where(y == 1, weights[1], weights[0]))
    return Toxicity(index, shared, calibration)


def _scores(shared, calibration: tuple[float, float]):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        for batch in batches:
            index = shared.value
            for i, cut, term, count in _terms(batch.column(1)):
                found, cosine = index.nearest(*index.queries(cut, term, count))
                score = probability(index.vote(found, cosine), calibration)
                has = found >= 0
                near = pa.StructArray.from_arrays(
                    [pa.array(index.ids[found[has]] if len(index.ids) else np.zeros(0, np.int64)), pa.array(cosine[has]),
                     pa.array(index.labels[found[has]].astype(np.int32) if len(index.ids) else np.zeros(0, np.int32))], fields=list(kind.value_type)
                )
                evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)), near).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(cut) - 1), pa.array(score), evidence], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score, evidence), a row for each input row.

    score: the calibrated probability of label 1 from the votes of the nearest examples. evidence: those neighbours,
    nearest first; of equal cosines the example that stands earlier in the index. Null, empty and wordless texts, and
    texts without any word of an example, have no neighbours and the score of the examples' rate. Texts of any length are taken whole; repeated rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    doc = docs.schema["doc_id"].dataType.simpleString()
    kind = "array<struct<doc_id: long, cosine: double, label: int>>"
    return docs.select("doc_id", "text").mapInArrow(_scores(model.shared, model.calibration), f"doc_id {doc}, score double, evidence {kind}")
