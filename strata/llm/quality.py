"""Quality score: a regularised quadratic discriminant over transformed document statistics.

The statistics of every whole text are computed once, in numpy over Arrow batches. The discriminant is fitted on a
bounded sample of labelled rows: class covariances are shrunk toward the pooled one and toward a multiple of the
identity, their Cholesky factors are kept, and the score is the logistic of a calibrated difference of log densities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import byte_codes, chunks, hash_sample, prefix_hash, separated, ship, span_hash, words

#: Labelled rows that the fit reads at most (about), chosen by hash.
FIT_ROWS = 20_000
#: Shares of the pooled covariance and of the scaled identity.
POOLED, IDENTITY = 0.2, 0.02

_SPACE = np.zeros(256, np.int8)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_FLAGS = {
    "upper": list(range(0x41, 0x5B)),
    "lower": list(range(0x61, 0x7B)),
    "digit": list(range(0x30, 0x3A)),
    "stop": [ord(c) for c in ".,;:?"],
    "bang": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*+/<=>@\\^_`|~{}[]()\"'-"],
    "line": [0x0A],
    "space": [0x20],
    "wide": list(range(0x80, 0x100)),
}
STATISTICS = [
    "bytes", *_FLAGS, "words", "word_length", "word_spread", "distinct", "distinct_root", "top_word", "short", "long_word",
    "line_repeat", "word_repeat", "capital_word", "symbol_word",
]


def _table(members) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[members] = 1
    return out


_TABLES = [_table(m) for m in _FLAGS.values()]


def statistics(column: pa.Array):
    """Yields a matrix [rows, len(STATISTICS)] for runs of rows; empty texts are all zeros."""
    codes = byte_codes(True)
    for _, n, data, offsets in chunks(column):
        buf, at = separated(data, offsets, 0x0A)
        size = np.diff(offsets).astype(float)
        per = np.maximum(size, 1)
        share = [np.log1p(size)]
        for t in _TABLES:
            c = np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
            share.append((c[offsets[1:]] - c[offsets[:-1]]) / per)
        start, end = words(buf, 1 - _SPACE)
        h = prefix_hash(buf, codes)
        w = span_hash(h, start, end)
        length = (end - start).astype(float)
        first = np.searchsorted(start, at)
        lstart, lend = words(buf, (np.arange(256) != 0x0A).astype(np.int8))
        lines, lfirst = span_hash(h, lstart, lend), np.searchsorted(lstart, at)
        cap = ((buf[start] >= 0x41) & (buf[start] <= 0x5A)).astype(float)
        sym = (_TABLES[5] | _TABLES[4])[buf[end - 1]].astype(float)
        out = np.zeros((n, len(STATISTICS)))
        out[:, : 1 + len(_TABLES)] = np.array(share).T
        k0 = 1 + len(_TABLES)
        for k in range(n):
            a, z = int(first[k]), int(first[k + 1])
            if z == a:
                continue
            m, own, l = z - a, length[a:z], lines[lfirst[k] : lfirst[k + 1]]
            _, count = np.unique(w[a:z], return_counts=True)
            out[k, k0:] = (
                np.log1p(m), np.log(own.mean()), np.log1p(own.std()), len(count) / m, np.log(len(count)) / np.log1p(m), count.max() / m,
                (own <= 3).mean(), (own >= 15).mean(), 1 - len(np.unique(l)) / max(1, len(l)), (w[a + 1 : z] == w[a : z - 1]).mean() if m > 1 else 0.0,
                cap[a:z].mean(), sym[a:z].mean(),
            )
        yield out


def _rows(batches):
    for batch in batches:
        parts = list(statistics(batch.column(1)))
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        flat = pa.array(x.astype(np.float32).ravel())
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, x array<float>) in the order of STATISTICS, a row for each input row.

    A null text counts as empty; texts of any length are taken whole; repeated rows get equal statistics; an empty table
    gives no rows; other columns are ignored."""
    ship(docs.sparkSession)
    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {doc}, x array<float>")


def _transform(x: np.ndarray) -> np.ndarray:
    """Square roots spread the shares near 0; the first column and the logarithms stay."""
    return np.sign(x) * np.sqrt(np.abs(x))


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        x = _transform(np.asarray(x, float).reshape(-1, len(STATISTICS)))
        y = np.asarray(y, int)
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.center) / self.scale
        groups = [x[y == k] for k in (0, 1)]
        self.means = [g.mean(axis=0) for g in groups]
        own = [(g - m).T @ (g - m) for g, m in zip(groups, self.means, strict=True)]
        pooled = sum(own) / len(x)
        self.factors, self.constants = [], []
        for g, s in zip(groups, own, strict=True):
            c = (1 - POOLED) * s / len(g) + POOLED * pooled
            c = (1 - IDENTITY) * c + IDENTITY * np.trace(c) / len(c) * np.eye(len(c))
            lower = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(lower))
            self.constants.append(np.log(np.diag(lower)).sum())
        # Log densities of correlated statistics are overconfident: a logistic in their signed root calibrates them.
        d = self._root(x)
        a, b = 1.0, np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((y - p) * d).sum() - 1e-3 * a, (y - p).sum()])
            hess = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum()]])
            step = np.linalg.solve(hess, g)
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        self.slope, self.shift = max(a, 1e-3), b

    def _root(self, x: np.ndarray) -> np.ndarray:
        """Signed root of the difference of log densities, from Mahalanobis distances by the kept factors."""
        g = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - c for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        d = g[1] - g[0]
        return np.sign(d) * np.sqrt(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (_transform(np.asarray(x, float)) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.slope * self._root(z) + self.shift, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """stats(doc_id, x), labels(doc_id, label 0/1) -> the discriminant, from about `rows` labelled rows by hash at most.

    Null labels and ids are left out, a doc_id labelled twice counts under its larger label, and rows of a repeated
    doc_id all count. Ties of the sample's hash stay together. With one class only the score is that class; without labels it is 0.5."""
    known = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    got = stats.join(hash_sample(known, "doc_id", rows), "doc_id").select("x", "label").collect()
    got = sorted((r.label, tuple(r.x)) for r in got)  # the order of arrival doesn't matter
    return Discriminant(np.array([x for _, x in got], float).reshape(-1, len(STATISTICS)), np.array([y for y, _ in got], int))


def _scores(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats(doc_id, x) -> (doc_id, score), a row for each input row; empty texts have a score too, equal statistics equal
    scores, and an empty table no rows."""
    doc = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(_scores(model), f"doc_id {doc}, score double")
