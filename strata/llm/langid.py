"""Language identification by a byte convolutional network trained in numpy.

A window of WINDOW bytes is embedded byte by byte, convolved with filters of several widths, max-pooled over the
window and classified by a softmax layer. For inference the embedding and the filters fold into tables indexed by one
or two bytes, so a filter of width 4 costs two look-ups a position. A document's probabilities are the mean over all
windows of its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import chunks, ship

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 12, (2, 3, 4)
#: Labelled texts a language that training reads at most (about; chosen by hash), and windows from each.
TRAIN_TEXTS, TRAIN_WINDOWS = 1500, 2
EPOCHS, BATCH, RATE = 12, 128, 0.01
UNKNOWN = "und"


class Network:
    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "v": r.normal(0, 0.3, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = r.normal(0, 0.5 / np.sqrt(w), (w * EMBED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the cross-entropy of windows x [n, WINDOW] (bytes) with classes y."""
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, saved = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            out = cols @ p[f"w{w}"] + p[f"b{w}"]
            at = out.argmax(axis=1)
            top = np.take_along_axis(out, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            saved.append((cols, at, top))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["v"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        g = {"v": h.T @ z, "c": z.sum(axis=0), "e": np.zeros_like(p["e"])}
        gh = z @ p["v"].T
        for i, w in enumerate(WIDTHS):
            cols, at, top = saved[i]
            go = gh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            picked = cols[np.arange(n)[:, None], at]  # n, FILTERS, w * EMBED
            g[f"w{w}"] = np.einsum("nfk,nf->kf", picked, go)
            g[f"b{w}"] = go.sum(axis=0)
            back = np.einsum("nf,kf->nfk", go, p[f"w{w}"])
            for k in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], at + k], back[:, :, k * EMBED : (k + 1) * EMBED])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches; rare classes are drawn as often as common ones."""
        r = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        share = 1 / np.bincount(y)[y]
        for epoch in range(EPOCHS):
            for _ in range(0, len(x), BATCH):
                pick = r.choice(len(x), BATCH, p=share / share.sum())
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.step(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self):
        """The folded filters: for each width the (offset, two bytes or one, table) look-ups that make it up."""
        p, out = self.p, []
        for w in WIDTHS:
            one = [p["e"] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            parts = [(k, True, (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(-1, FILTERS)) for k in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, False, one[-1]))
            out.append((w, parts, p[f"b{w}"]))
        return out, p["v"], p["c"]


#: Windows that are classified at once.
WINDOWS = 16_384


def _windows(data: np.ndarray, offsets: np.ndarray):
    """Yields runs of all windows of some texts [n, WINDOW], padded with zero bytes, and the text of each."""
    lens = np.diff(offsets)
    count = -(-lens // WINDOW)
    text = np.repeat(np.arange(len(lens)), count)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    spare = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    place = np.arange(WINDOW)
    for i in range(0, len(text), WINDOWS):
        at, own = start[i : i + WINDOWS], text[i : i + WINDOWS]
        yield spare[at[:, None] + place] * (at[:, None] + place < offsets[1:][own][:, None]), own


def classify(model, x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows."""
    layers, v, c = model
    out = np.empty((len(x), len(c)), np.float32)
    for i in range(0, len(x), 256):
        flat = np.zeros(len(x[i : i + 256]) * WINDOW + 4, np.uint8)
        flat[:-4] = x[i : i + 256].ravel()
        n = len(flat) - 4
        two = flat[:-1].astype(np.uint16) << 8 | flat[1:]
        pooled = []
        for w, parts, bias in layers:
            s = None
            for k, double, t in parts:
                y = t[(two if double else flat)[k : k + n]]
                s = y if s is None else np.add(s, y, out=s)
            pooled.append(np.maximum(s.reshape(-1, WINDOW, FILTERS)[:, : WINDOW - w + 1].max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ v + c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[i : i + 256] = z / z.sum(axis=1, keepdims=True)
    return out


def train(texts: DataFrame, per_class: int = TRAIN_TEXTS, windows: int = TRAIN_WINDOWS):
    """texts(doc_id, text, lang) -> (languages, model). Reads about per_class texts a language, chosen by hash, and
    `windows` windows from each; rows with a null or letterless text or null lang are left out."""
    rows = texts.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    unit = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_003)) / 1_000_003.0
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    start = [F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1 for k in range(windows)]
    parts = F.array(*(F.substring("text", s, F.lit(WINDOW)) for s in start))
    got = rows.join(F.broadcast(counts), "lang").where(unit < per_class / F.col("n")).select("lang", parts.alias("parts")).collect()
    langs = sorted({r.lang for r in got})
    if not langs:
        return [], None
    x, y = [], []
    for r in got:
        for part in r.parts:
            b = np.frombuffer(part.encode("utf-8", "surrogatepass")[:WINDOW], np.uint8)
            x.append(np.concatenate([b, np.zeros(WINDOW - len(b), np.uint8)]))
            y.append(langs.index(r.lang))
    net = Network(len(langs))
    order = np.lexsort(np.array(x).T)  # the rows' order of arrival doesn't matter
    net.fit(np.array(x)[order], np.array(y)[order])
    return langs, net.tables()


def _predict(langs: list[str], model, at: int, first: int):
    """(lettered, .., columns) -> (the columns from `first` on, lang_pred, score); the text is column `at`."""

    def run(batches):
        for batch in batches:
            names, scores = [], []
            lettered = batch.column(0).to_numpy(zero_copy_only=False)
            for i, n, data, offsets in chunks(batch.column(at)):
                p = np.zeros((n, max(1, len(langs))))
                if model is not None:
                    for x, doc in _windows(data, offsets):
                        np.add.at(p, doc, classify(model, x))
                    p /= np.maximum(-(-np.diff(offsets) // WINDOW), 1)[:, None]
                best = p.argmax(axis=1)
                ok = lettered[i : i + n].astype(bool) & bool(langs)
                names += [langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
                scores += np.where(ok, np.clip(p[np.arange(n), best], 0, 1), 0.0).tolist()
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *found], [*batch.schema.names[first:], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, langs: list[str], model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score), a row for each input row, without a shuffle.

    score is the mean probability of lang_pred over all windows of the whole text, however long. A text that is null or
    has no letter is `und` with score 0, and so is every text when training found no labelled one. Ties go to the first
    language by name; repeated rows get equal results; an empty table gives no rows; columns of docs that keep does not
    name are left out. text names the column that holds the texts, which go to Python once even if they are kept.
    """
    ship(docs.sparkSession)
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_lettered")
    kind = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    sent = keep if text in keep else (text, *keep)
    run = _predict(langs, model, 1 + sent.index(text), 1 + len(sent) - len(keep))
    return docs.select(lettered, *sent).mapInArrow(run, f"{kind}lang_pred string, score double")
