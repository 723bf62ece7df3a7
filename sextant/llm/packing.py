"""Packing documents into training sequences by vector bin packing.

Every piece has a size in three dimensions: tokens, segments (one) and loss-bearing tokens (all but its first and those
of the document's prompt). Bins have limits in all three. The dot-product heuristic fills one bin at a time: of the
waiting pieces that fit, it takes the one whose size, as shares of the limits, has the largest dot product with what is
left of the bin. When nothing fits any more, or segments run out, a waiting piece is cut so that it closes the gap. A
bin that a limit closes before it is full, and the last ones of a task, are cut at powers of two: nothing is padded.

Each task packs its own rows: no shuffle, and nothing is held beyond `pool` waiting pieces of less than one sequence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import CACHES, slices

_CACHE_WORDS = 700_000
#: A bin is not prolonged by fewer tokens than this, unless they fill it, nor cut into sequences shorter than this.
_CRUMB = 64
#: For texts of these characters alone, Python's classes equal the tokenizer's, and normalisation only lowers case.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e ¡-±´-¸º»¿-įı-ž‐-‧‰-⁞]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_alphabet() -> dict[int, str]:
    """Public byte-level BPE alphabet: printable bytes stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_alphabet()


class _Numbers(dict):
    """Numbers strings in the order they are first asked for; fresh lists those since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class Encoder:
    """ids of texts by a word-level BPE tokenizer file, remembering those of words.

    Words between white space are looked up; new ones are cut into pre-tokens, and new pre-tokens go to the library.
    Texts beyond the plain characters, or with the text of a special token, go through the library whole. Only for
    tokenizers whose pre-tokens are those of _SPLIT (tests compare whole texts with the library).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def _model_ids(self, piece: str) -> list[int]:
        """ids of one pre-token by the model itself, its bytes written as the byte-level alphabet."""
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES))]

    def _store(self, n: int, ids) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), self.flat.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n], self.lengths[n] = self.used, len(ids)
        self.used += len(ids)

    def _learn(self) -> None:
        """Store the ids of all fresh words."""
        number, fresh = self.number, self.number.fresh
        single, several, at = [], [], 0
        while at < len(fresh):  # the list grows by pre-tokens that are new themselves
            word = fresh[at]
            at += 1
            pieces = [word] if word.isascii() and word.isalpha() else _SPLIT.findall(word)
            if len(pieces) == 1:
                single.append(word)
            else:
                several.append((number[word], [number[p] for p in pieces]))
        while len(number) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        for word in single:
            self._store(number[word], self._model_ids(word))
        for n, parts in several:
            self._store(n, np.concatenate([self.flat[self.starts[p] : self.starts[p] + self.lengths[p]] for p in parts]))
        fresh.clear()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > _CACHE_WORDS:
            self.forget()
        found: list[np.ndarray | None] = []
        look = self.number.__getitem__
        for t in texts:
            t = t or ""
            if _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                words = t.lower().split()
                found.append(np.fromiter(map(look, words), np.int64, len(words)))
            else:
                found.append(None)
        if self.number.fresh:
            self._learn()
        out = []
        for t, at in zip(texts, found):
            if at is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            n = self.lengths[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[at] - ends + n, n)].astype(np.uint32))
        return out


class Packer:
    """Places token arrays; done holds (doc_id, start, length, crc32, doc_tokens, sequence, offset, loss) of closed sequences.

    Of a piece's tokens, the first and those of the document's prompt bear no loss.
    """

    def __init__(self, limit: int = 4096, segments: int = 256, loss: int | None = None, pool: int = 512, first: int = 0):
        self.limit, self.loss = limit, limit if loss is None else loss
        self.caps = np.array([limit, segments, self.loss], np.float64)
        self.pool, self.next, self.done = pool, first, []
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens, prompt tokens)
        self.sizes, self.losses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _bears(start: int, n: int, prompt: int) -> int:
        return n - max(1, min(prompt - start, n))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total, prompt in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next, offset, self._bears(start, len(ids), prompt)))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0) -> None:
        total, at = len(ids), 0
        while at < total:
            n = min(total - at, self.limit)
            if self._bears(at, n, prompt) > self.loss:  # a half is easier to place than what just fits
                n = 1 << (max(1, min(prompt - at, n)) + self.loss).bit_length() - 1
            piece = (doc_id, at, ids[at : at + n], total, prompt)
            at += n
            if n == self.limit:
                self._close([piece])
            else:
                self.waiting.append(piece)
        if len(self.waiting) >= 2 * self.pool:
            self._count()
            while len(self.waiting) > self.pool:
                self._fill()

    def _count(self) -> None:
        self.sizes = np.array([len(w[2]) for w in self.waiting], np.int64)
        self.losses = np.array([self._bears(w[1], len(w[2]), w[4]) for w in self.waiting], np.int64)

    def _take(self, i: int, n: int) -> tuple:
        """The first n tokens of a waiting piece; what is left of it keeps waiting."""
        doc_id, start, ids, total, prompt = self.waiting[i]
        if n == len(ids):
            last = self.waiting.pop()
            if i < len(self.waiting):
                end = len(self.waiting)
                self.waiting[i], self.sizes[i], self.losses[i] = last, self.sizes[end], self.losses[end]
            self.sizes, self.losses = self.sizes[: len(self.waiting)], self.losses[: len(self.waiting)]
        else:
            self.waiting[i] = (doc_id, start + n, ids[n:], total, prompt)
            self.sizes[i] -= n
            self.losses[i] = self._bears(start + n, int(self.sizes[i]), prompt)
        return doc_id, start, ids[:n], total, prompt

    def _fill(self, last: bool = False) -> None:
        """Fill and close one bin. If a limit closes it before it is full, it is cut at powers of two; its last tokens, under _CRUMB, wait on unless it is the last."""
        bin_, left = [], self.caps.copy()
        while left[0] > 0 and left[1] > 0 and self.waiting:
            fits = (self.sizes <= left[0]) & (self.losses <= left[2])
            if left[1] > 1 and fits.any():
                share = left / self.caps
                dot = self.sizes / self.caps[0] * share[0] + share[1] / self.caps[1] + self.losses / max(self.caps[2], 1) * share[2]
                i = int(np.where(fits, dot, -1).argmax())
                n = int(self.sizes[i])
            else:  # nothing fits, or one segment is left: cut the piece that gives most to close the gap
                most = np.minimum(np.minimum(self.sizes, left[0]), self.sizes - self.losses + left[2])
                i = int(most.argmax())
                n = int(most[i])
                if bin_ and n < min(_CRUMB, left[0]):
                    break
            piece = self._take(i, n)
            bin_.append(piece)
            left -= [n, 1, self._bears(piece[1], n, piece[4])]
        total = int(self.caps[0] - left[0])
        if total == self.limit:
            return self._close(bin_)
        keep = total if last or total <= _CRUMB else total - total % _CRUMB
        back = total - keep
        for doc_id, start, ids, whole, prompt in reversed(bin_) if back else ():
            n = min(back, len(ids))
            self.waiting.append((doc_id, start + len(ids) - n, ids[len(ids) - n :], whole, prompt))
            back -= n
            if not back:
                self._count()
                break
        self._cut(bin_, keep)

    def _cut(self, pieces: list[tuple], total: int) -> None:
        """Close the first `total` tokens of pieces in sequences whose lengths are the powers of two that add up to it."""
        at, used = 0, 0  # piece, and tokens of it that are placed
        for bit in reversed(range(total.bit_length())):
            want, taken = total & (1 << bit), []
            while want:
                doc_id, start, ids, whole, prompt = pieces[at]
                n = min(want, len(ids) - used)
                taken.append((doc_id, start + used, ids[used : used + n], whole, prompt))
                want, used = want - n, used + n
                if used == len(ids):
                    at, used = at + 1, 0
            if taken:
                self._close(taken)

    def finish(self) -> None:
        """Close what waits."""
        self._count()
        while self.waiting:
            self._fill(bool((np.array([self.sizes.sum(), len(self.waiting), self.losses.sum()]) <= self.caps).all()))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ENCODERS: dict[str, Encoder] = {}
CACHES["packing"] = _ENCODERS.clear


def encoder_of(path: str) -> Encoder:
    """The worker process's encoder: its words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 4096, segments: int = 256, loss: int | None = None, prompt: Column | None = None) -> DataFrame:
    """One row for each piece: its document, span, checksum, sequence, offset there and number of loss-bearing tokens.

    Texts are tokenized whole and end in end_id; null and empty texts are that id alone. prompt gives the leading
    characters of a text that bear no loss (they should end at white space; null: none); loss limits the loss-bearing
    tokens of a sequence (None: no limit). Repeated rows are packed as often as they occur, null ids stay null, an empty
    table gives no rows, other columns are ignored. sequence_id is unique over all tasks: the task's partition times
    2**36, plus a count.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limit, segments, loss, first=TaskContext.get().partitionId() << 36)

        def flush():
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for b in slices(batches, 64, "packing"):
            texts, lead = b.column(1).to_pylist(), b.column(2).to_pylist()
            encode = encoder_of(tokenizer).encode
            asked = [len(ids) for ids in encode([t[:k] if t and k else "" for t, k in zip(texts, lead)])] if any(lead) else [0] * len(texts)
            for doc_id, ids, n in zip(b.column(0).to_pylist(), encode(texts), asked):
                packer.add(doc_id, np.append(ids, np.uint32(end_id)), n)
            if len(packer.done) > 2000:
                yield flush()
        packer.finish()
        if packer.done:
            yield flush()

    lead = F.lit(0) if prompt is None else F.coalesce(prompt, F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lead.cast("int").alias("lead")).mapInArrow(run, SCHEMA)


def first_line(text: str = "text") -> Column:
    """Characters of the first line with its end, 0 for texts of one line: the prompt of documents without a mask of their own."""
    return F.instr(F.col(text).cast("string"), "\n")
