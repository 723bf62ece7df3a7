"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the mean of hashed rows: the word itself and its first three, four and five letters. Filters of
several widths run over the whole text, are max-pooled and feed a logistic unit. Training is minibatch gradient descent
with Adagrad, on a bounded, class-balanced sample. Thresholds are calibrated by language; the language is read off the
text (nearest mean embedding), never from a column, and scores are rescaled so that the threshold lies at 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, keep_rows, slices, texts_of

_WORD = re.compile(r"[^\W\d_]+")
_PARTS = 4
_CACHE_WORDS = 300_000
_BLOCK_WORDS = 1 << 16


@dataclass
class Model:
    emb: np.ndarray  # buckets x size; row 0 is zero
    filters: list[tuple[np.ndarray, np.ndarray]]  # for each width: (width * size) x n, bias
    out: np.ndarray
    bias: float
    langs: tuple[str, ...]
    centres: np.ndarray  # unit mean embedding of each language
    cuts: np.ndarray  # threshold of each language; the last is for any text


def _rows(word: str, buckets: int) -> list[int]:
    h = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % (buckets - 1) + 1
    return [h("w|" + word)] + [h(f"{n}|{word[:n]}") if len(word) > n else 0 for n in (3, 4, 5)]


class Reader:
    """Texts to sequences of word numbers, with the hashed rows of each number; forgets when it holds too many words."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.forget()

    def forget(self) -> None:
        self.number, self.table, self.known = {}, [], None

    def read(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        number = self.number
        for w in set(words):
            if w not in number:
                number[w] = len(self.table)
                self.table.append(_rows(w, self.buckets))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


    def embed(self, emb: np.ndarray) -> np.ndarray:
        """Embeddings of all numbers so far; only new words are computed."""
        old = 0 if self.known is None else self.size
        if len(self.table) > old:
            room = len(self.table) * 2
            if self.known is None or len(self.known) < len(self.table):
                grown = np.zeros((room, emb.shape[1]), np.float32)
                grown[:old] = 0 if self.known is None else self.known[:old]
                self.known = grown
            self.known[old : len(self.table)] = _embed(np.array(self.table[old:], np.int64), emb)
            self.table[old:] = [None] * (len(self.table) - old)
            self.size = len(self.table)
        return np.zeros((0, emb.shape[1]), np.float32) if self.known is None else self.known


def _embed(rows: np.ndarray, emb: np.ndarray) -> np.ndarray:
    return emb[rows].sum(1) / np.maximum((rows > 0).sum(1, keepdims=True), 1)


def _maps(xt: np.ndarray, model: Model, n: int) -> list[np.ndarray]:
    """Filter values (filters x n) of each width at the first n places of xt (size x places); past its end lie zeros."""
    size = xt.shape[0]
    out = []
    for w, _ in model.filters:
        width = w.shape[0] // size
        z = w[:size].T @ xt[:, :n]
        for j in range(1, width):
            m = min(n, xt.shape[1] - j)
            if m > 0:
                z[:, :m] += (w[j * size : (j + 1) * size].T @ xt[:, j : j + m])
        out.append(z)
    return out


def _pool(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Max over all places for every filter, and where."""
    zs = _maps(np.ascontiguousarray(x.T), model, len(x))
    at = [z.argmax(1) for z in zs]
    best = [z[np.arange(len(z)), k] + b for z, k, (_, b) in zip(zs, at, model.filters)]
    return np.concatenate(best), np.concatenate(at)


def _features(x: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Pooled filters and sums of embeddings of non-empty texts whose word embeddings follow each other in x, in one pass."""
    size = model.emb.shape[1]
    gap = _widest(model) - 1
    starts = np.cumsum(lengths + gap) - lengths - gap
    places = np.arange(lengths.sum()) + np.repeat(gap * np.arange(len(lengths)), lengths)
    xt = np.zeros((size, int(starts[-1] + lengths[-1] + max(gap, 1))), np.float32)
    xt[:, places] = x.T
    cuts = np.stack([starts, starts + lengths], 1).ravel()
    pooled = np.concatenate([np.maximum.reduceat(z, cuts, axis=1)[:, ::2] + b[:, None] for z, (_, b) in zip(_maps(xt, model, xt.shape[1]), model.filters)])
    return pooled.T, np.add.reduceat(xt, starts, axis=1).T


def _widest(model: Model) -> int:
    return max(w.shape[0] for w, _ in model.filters) // model.emb.shape[1]


def logits(seqs: list[np.ndarray], known: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language number of each sequence of word numbers. Long texts go in overlapping pieces, short ones together, so memory is bounded."""
    gap, size = _widest(model) - 1, model.emb.shape[1]
    pooled = np.full((len(seqs), len(model.out)), -np.inf)
    sums, n = np.zeros((len(seqs), size)), np.array([len(q) for q in seqs])
    todo = [(i, a, min(a + _BLOCK_WORDS, len(q))) for i, q in enumerate(seqs) for a in range(0, len(q), _BLOCK_WORDS)]
    while todo:
        k, words = 0, 0
        while k < len(todo) and (k == 0 or words + todo[k][2] - todo[k][1] <= _BLOCK_WORDS):
            words += todo[k][2] - todo[k][1]
            k += 1
        part, todo = todo[:k], todo[k:]
        pieces = [seqs[i][max(0, a - gap) : b] for i, a, b in part]
        f, s = _features(known[np.concatenate(pieces)], np.array([len(q) for q in pieces]), model)
        owner = [i for i, _, _ in part]
        np.maximum.at(pooled, owner, f)
        np.add.at(sums, owner, s)
    logit = np.where(n > 0, np.maximum(pooled, 0) @ model.out + model.bias, model.bias)
    lang = np.full(len(seqs), len(model.cuts) - 1)
    if len(model.langs):
        lang = np.where(n > 0, (sums @ model.centres.T).argmax(1), lang)
    return logit, lang


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rescaled(p: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Monotone on [0, 1]; cut goes to 0.5."""
    return np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut))


def train(texts: list[str | None], labels: list[int], langs: list[str | None], buckets: int = 1 << 16, size: int = 12, filters: int = 12, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 4, seed: int = 11) -> Model:
    """Model of whole texts. langs only name the groups that thresholds are calibrated for."""
    rng = np.random.default_rng(seed)
    reader = Reader(buckets)
    seqs = [reader.read(t) for t in texts]
    rows = np.array(reader.table or [[0] * _PARTS], np.int64)
    y = np.array(labels, np.float64)
    emb = rng.normal(0, 0.05, (buckets, size)).astype(np.float32)
    held = rng.random(len(y)) < 0.15 if len(y) >= 100 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~held)

    # the first dimension starts from smoothed log odds of a bucket's presence in toxic texts
    count, total = np.zeros((2, buckets)), np.array([max(1, (y[learn] == k).sum()) for k in (0, 1)])
    for i in learn:
        count[int(y[i]), np.unique(rows[np.unique(seqs[i])])] += 1
    odds = np.log((count[1] + 1) / (total[1] + 2)) - np.log((count[0] + 1) / (total[0] + 2))
    emb[:, 0] = np.clip(odds, -2, 4) * np.minimum(1, count.sum(0) / 8) * 0.25
    emb[0] = 0
    model = Model(emb, [], np.zeros(0, np.float32), 0.0, (), np.zeros((0, size), np.float32), np.array([0.5]))
    for w in widths:
        k = rng.normal(0, 0.3, (w * size, filters)).astype(np.float32)
        k[::size, : filters // 2] += 1
        model.filters.append((k, np.zeros(filters, np.float32)))
    n = filters * len(widths)
    model.out = rng.normal(0.1, 0.1, n).astype(np.float32)
    model.bias = float(np.log(max(1, y.sum()) / max(1, (1 - y).sum())))
    grown = {"emb": np.full(buckets, 1e-2), "out": np.full(n, 1e-2), "bias": 1e-2, "f": [np.full(k.shape, 1e-2) for k, _ in model.filters], "b": [np.full(b.shape, 1e-2) for _, b in model.filters]}
    for epoch in range(epochs):
        order = rng.permutation(learn)
        rate = 0.1 / (1 + 0.3 * epoch)
        for start in range(0, len(order), 32):
            part = order[start : start + 32]
            d_out, d_bias = np.zeros(n), 0.0
            d_f, d_b = [np.zeros(k.shape) for k, _ in model.filters], [np.zeros(b.shape) for _, b in model.filters]
            touched, d_emb = [], []
            for i in part:
                if not len(seqs[i]):
                    continue
                r = rows[seqs[i]]
                x = _embed(r, model.emb)
                pooled, where = _pool(x, model)
                hidden = np.maximum(pooled, 0) * (rng.random(n) > 0.2) / 0.8
                g = (_sigmoid(hidden @ model.out + model.bias) - y[i]) / len(part)
                d_out += g * hidden
                d_bias += g
                d_hidden = g * model.out * (hidden > 0) / 0.8
                for f, (k, _) in enumerate(model.filters):
                    width, at, d = k.shape[0] // size, where[f * filters : (f + 1) * filters], d_hidden[f * filters : (f + 1) * filters]
                    d_b[f] += d
                    for j in range(width):
                        place = at + j
                        ok = place < len(x)
                        d_f[f][j * size : (j + 1) * size][:, ok] += x[place[ok]].T * d[ok]
                        touched.append(r[place[ok]])
                        d_emb.append((k[j * size : (j + 1) * size][:, ok] * d[ok]).T / np.maximum((r[place[ok]] > 0).sum(1, keepdims=True), 1))
            if not touched:
                continue
            d_out += 1e-4 * model.out
            grown["out"] += d_out**2
            model.out -= (rate * d_out / np.sqrt(grown["out"])).astype(np.float32)
            grown["bias"] += d_bias**2
            model.bias -= rate * d_bias / np.sqrt(grown["bias"])
            for f, (k, b) in enumerate(model.filters):
                grown["f"][f] += d_f[f] ** 2
                k -= (rate * d_f[f] / np.sqrt(grown["f"][f])).astype(np.float32)
                grown["b"][f] += d_b[f] ** 2
                b -= (rate * d_b[f] / np.sqrt(grown["b"][f])).astype(np.float32)
            at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(at), size))
            np.add.at(g, inverse.reshape(-1, _PARTS), np.concatenate(d_emb)[:, None, :].repeat(_PARTS, 1))
            grown["emb"][at] += (g**2).mean(1)
            model.emb[at] -= (0.5 * rate * g / np.sqrt(grown["emb"][at])[:, None]).astype(np.float32)
            model.emb[0] = 0
    _calibrate(model, seqs, _embed(rows, model.emb).astype(np.float32), y, langs, held)
    return model


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of most F1, midway between the scores around it."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.05, 0.95))


def _calibrate(model: Model, seqs: list[np.ndarray], known: np.ndarray, y: np.ndarray, langs: list[str | None], held: np.ndarray, least: int = 12) -> None:
    """A threshold for each language from the texts kept from training; for languages with few toxic ones, that of all."""
    names = tuple(sorted({v for v in langs if v is not None}))
    means = np.stack([known[q].mean(0) if len(q) else np.zeros(model.emb.shape[1]) for q in seqs])
    if names:
        centres = np.stack([means[[v == k for v in langs]].mean(0) for k in names])
        model.centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model.langs = names
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z, group = logits([seqs[i] for i in check], known, model)
    p = _sigmoid(z)
    every = _best_cut(p, y[check]) if len(check) and y[check].sum() else 0.5
    model.cuts = np.full(len(names) + 1, every)
    for k in range(len(names)):
        own = group == k
        if y[check][own].sum() >= least:
            model.cuts[k] = _best_cut(p[own], y[check][own])


def probabilities(texts: list[str | None], model: Model, reader: Reader) -> np.ndarray:
    """Calibrated scores of whole texts. A text of any length is read once; blocks of words bound the memory."""
    if len(reader.number) > _CACHE_WORDS:
        reader.forget()
    seqs = [reader.read(t) for t in texts]
    known = reader.embed(model.emb)
    z, lang = logits(seqs, known, model)
    return _rescaled(_sigmoid(z), model.cuts[lang])


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = 2000, sample_clean: int = 3000, held_fold: int = 0, folds: int = 5) -> Model | None:
    """Model from at most sample_toxic and sample_clean labelled documents outside the held-out fold, by hash of the id.

    Texts over common.SAMPLE_BYTES are scored, but not learned from. Null labels are left out; a document labelled twice
    is toxic if any label says so. None without both classes.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", folds) != held_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = {}
    for value, bound in ((1, sample_toxic), (0, sample_clean)):
        wanted |= {r.doc_id: value for r in marked.filter((F.col("toxic") > 0) == bool(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id").collect()}
    rows = [r for r in texts_of(docs, sorted(wanted), ["lang"]) if r.text is not None]
    y = [wanted[r.doc_id] for r in rows]
    if len(set(y)) < 2:
        return None
    return train([r.text for r in rows], y, [r.lang for r in rows])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone; score 0 to 1, predicted 1 from 0.5.

    Null and empty texts are scored as texts without words. Without a model (no labels) every score is 0. Repeated
    rows each get their result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(len(m.emb)) if m else None
        for b in slices(batches, 64):
            texts = b.column(1).to_pylist()
            if m is None:
                p = np.zeros(len(texts))
            else:
                p = probabilities(texts, m, reader)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of docs with a score under 0.5, their columns as they are, whatever their names.

    Every row is judged by its own whole text: rows that repeat an id or a text are each kept or not; null and empty
    texts are scored as texts without words. Without a model all rows stay; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        m = shared.value
        reader = Reader(len(m.emb)) if m else None
        return lambda texts: [True] * len(texts) if m is None else (probabilities(texts, m, reader) < 0.5).tolist()

    return keep_rows(docs, keep, 64)
