"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram binds the vectors of its letters, each permuted by its
place, by elementwise product; a document bundles (sums) its trigrams; a language's prototype bundles the unit vectors
of its training documents, and a few passes over misread training documents sharpen the prototypes. A document gets
the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fold, keep_rows, slices, texts_of

UNKNOWN = "und"
#: Runs without a letter, but for numbers such as fractions and circled ones, which are told by str.isalpha.
_NOT_LETTER, _MAYBE_LETTER = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]")
_PIECE = 1 << 20
#: Text lengths are told apart by powers of two up to this; a floor needs so many labelled texts of its length.
_SIZES, _FLOOR_TEXTS = 24, 20
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


@dataclass(frozen=True)
class Profiles:
    """langs[i] has prototype prototypes[i], a unit vector. sharpness scales cosines before the softmax of score.

    floors[b] is the least cosine of a text of 2**b to 2**(b+1) characters that keep_known takes for a known language.
    """

    langs: tuple[str, ...]
    prototypes: np.ndarray
    sharpness: float
    floors: np.ndarray


def _letter(code: int, dim: int) -> np.ndarray:
    if (code, dim) not in _VECTORS:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        _VECTORS[code, dim] = np.where(np.random.Generator(np.random.Philox(key=[code, 7])).random(dim) < 0.5, -1, 1).astype(np.int8)
    return _VECTORS[code, dim]


def _codes(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased letters, runs of anything else as one space, in pieces that overlap by two."""
    clean = _NOT_LETTER.sub(" ", text.lower())
    if not clean.replace(" ", "").isalpha():
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    clean = " " + clean.strip() + " "
    for at in range(0, len(clean) - 2, _PIECE):
        yield np.frombuffer(clean[at : at + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether text holds a character of category L."""
    return bool(text) and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def bundle(texts: list[str | None], dim: int) -> np.ndarray:
    """The unit bundle of each text; zeros without letters."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        if has_letter(t):
            for c in _codes(t):
                pieces.append(c)
                owner.append(i)
    out = np.zeros((len(texts), dim), np.float32)
    if not pieces:
        return out
    flat = np.concatenate(pieces)
    letters, place = np.unique(flat, return_inverse=True)
    k = len(letters)
    table = np.stack([_letter(int(c), dim) for c in letters])
    ends = np.cumsum([len(c) for c in pieces])
    grams = place[:-2] * (k * k) + place[1:-1] * k + place[2:]
    if k <= 160:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        names = np.flatnonzero(seen)
        number = np.zeros(k**3, np.int32)
        number[names] = np.arange(len(names), dtype=np.int32)
        grams = number[grams]
    else:
        names, grams = np.unique(grams, return_inverse=True)
    first, second, third = np.roll(table, 2, 1), np.roll(table, 1, 1), table
    for lo in range(0, len(names), 8192):  # blocks of trigrams bound the memory of their vectors
        part = names[lo : lo + 8192]
        vectors = (first[part // (k * k)] * second[part // k % k] * third[part % k]).astype(np.float32)
        counts = np.zeros((len(texts), len(part)), np.float32)
        start = 0
        for i, end in zip(owner, ends):
            g = grams[start : end - 2]
            if len(names) > 8192:
                g = g[(g >= lo) & (g < lo + 8192)] - lo
            counts[i] += np.bincount(g, minlength=len(part))
            start = end
        out += counts @ vectors
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def fit(docs: DataFrame, dim: int = 1024, sample_docs: int = 2400, held_fold: int = 2, folds: int = 4, epochs: int = 8) -> Profiles:
    """Profiles from at most sample_docs documents with text and lang outside the held-out fold, as many of each language as there are, evenly.

    The sample is by hash of the id, without texts over common.SAMPLE_BYTES. Without any such document the profiles are
    empty and every text gets `und`.
    """
    rows = docs.select("doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held_fold))
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    langs = rows.select("lang").distinct().limit(sample_docs).count()
    if not langs:
        return _none(dim)
    ids = [r.doc_id for r in rows.withColumn("at", at).filter(F.col("at") <= max(1, sample_docs // langs)).select("doc_id").distinct().collect()]
    sample = [r for r in texts_of(docs.filter(F.col("lang").isNotNull()), ids, ["lang"]) if has_letter(r.text)]
    return train([r.text for r in sample], [r.lang for r in sample], dim, epochs)


def _none(dim: int) -> Profiles:
    return Profiles((), np.zeros((0, dim), np.float32), 1.0, np.full(_SIZES, -1.0))


def _sizes(texts: list[str]) -> np.ndarray:
    return np.array([min(len(t).bit_length() - 1, _SIZES - 1) for t in texts])


def train(texts: list[str], langs: list[str], dim: int = 1024, epochs: int = 8) -> Profiles:
    names = tuple(sorted(set(langs)))
    if not names:
        return _none(dim)
    x = np.concatenate([bundle(texts[i : i + 128], dim) for i in range(0, len(texts), 128)])
    y = np.array([names.index(v) for v in langs])
    sums = np.stack([x[y == k].sum(0) for k in range(len(names))])
    best, best_right = None, -1
    for _ in range(epochs + 1):
        p = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        guess = (x @ p.T).argmax(1)
        if (guess == y).sum() > best_right:
            best, best_right = p, (guess == y).sum()
        wrong = np.flatnonzero(guess != y)
        if not len(wrong):
            break
        np.add.at(sums, y[wrong], 0.5 * x[wrong])
        np.subtract.at(sums, guess[wrong], 0.5 * x[wrong])
    cos = x @ best.T
    gap = np.median(np.partition(cos, -1, axis=1)[:, -1] - (np.partition(cos, -2, axis=1)[:, -2] if len(names) > 1 else 0))
    size, most = _sizes(texts), cos.max(1)
    noise = 2.5 / np.sqrt(dim)  # a random vector seldom comes as near
    floors = np.array([min(most[size == b].min() / 2, noise) if (size == b).sum() >= _FLOOR_TEXTS else -1.0 for b in range(_SIZES)])
    return Profiles(names, best.astype(np.float32), float(6 / max(gap, 1e-3)), floors)


def identify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if len(profiles.langs) and len(texts):
        cos = bundle(texts, profiles.prototypes.shape[1]) @ profiles.prototypes.T
        e = np.exp(profiles.sharpness * (cos - cos.max(1, keepdims=True)).astype(np.float64))
        best, share = cos.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
        for i, t in enumerate(texts):
            if has_letter(t):
                pred[i], score[i] = profiles.langs[best[i]], share[i]
    return pred, score


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text alone.

    score is the softmax share of the winning cosine. Null texts and texts without a letter get `und` and 0. Ties go
    to the language first in alphabet. Repeated rows each get their result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            pred, score = identify(b.column(1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def known(texts: list[str | None], profiles: Profiles) -> list[bool]:
    """Whether a text has a letter and comes nearer to a profile than chance: by half as much as any labelled text of about its length, or 2.5 standard deviations of a random vector's cosine."""
    out = [has_letter(t) for t in texts]
    if len(profiles.langs) and any(out):
        most = (bundle(texts, profiles.prototypes.shape[1]) @ profiles.prototypes.T).max(1)
        floors = profiles.floors[_sizes([t or " " for t in texts])]
        out = [o and bool(c >= f) for o, c, f in zip(out, most, floors)]
    return out


def keep_known(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Rows of docs in a language that can be told (see known), their columns as they are, whatever their names.

    Null texts, texts without a letter and texts far from every profile go. Every row is judged by its own whole text,
    rows that repeat an id too; lengths with few labelled texts have no floor, and without any profile every text with a
    letter stays. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    return keep_rows(docs, lambda: lambda texts: known(texts, model.value))
