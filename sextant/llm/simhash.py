"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits have a common point within half the radius of each.
Emitting the whole ball (2,081 variants of 64 bits for radius 4) is exact and needs no verification, but moves
2,081 rows for each fingerprint. The balls are therefore taken on key spaces: the 64 bits are cut in three blocks;
of at most four differing bits, the two blocks with fewest hold at most two (two thirds of four, rounded down), so
each fingerprint emits, for each of the three pairs of blocks, all variants of those 42 or 43 bits within one bit:
131 rows. Collisions are verified on all 64 bits. A variant that more than `run_limit` fingerprints share isn't
compared pairwise: its members go through the whole ball of 64 bits, where members of a variant are linked to its
smallest without any comparison. No link is lost in either way, and exact copies take part once, as one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import filter_ids, materialise, release, slices

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of all shingles, repeats included; 0 without words."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n, hashed = len(found) - words + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())
        h = np.fromiter((hashed(joined[a:b], 42) for a, b in spans), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row. Null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_variants(radius: int) -> list[tuple[int, int]]:
    """(mask, flip) of every variant: key = (fp & mask) ^ flip. Only for radii whose two best of three blocks hold 2 bits at most."""
    if 2 * radius // 3 > 2:
        return ball_variants(radius)
    blocks = [(1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43]
    out = []
    for a, b in combinations(blocks, 2):
        mask = a | b
        flips = [0] + [1 << i for i in range(64) if mask >> i & 1] * (2 * radius // 3 > 0)
        tag = ((1 << 64) - 1 ^ mask) & -((1 << 64) - 1 ^ mask)  # the lowest bit that isn't in the key marks the pair of blocks
        out += [(_signed(mask), _signed(f | tag)) for f in flips]
    return out


def ball_variants(radius: int) -> list[tuple[int, int]]:
    half = (radius + 1) // 2
    return [(-1, _signed(sum(1 << i for i in c))) for k in range(half + 1) for c in combinations(range(64), k)]


def _emit(fps: DataFrame, variants: list[tuple[int, int]]) -> DataFrame:
    table = F.expr("array(" + ",".join(f"named_struct('m',{m}L,'f',{f}L)" if m > -(1 << 63) and f > -(1 << 63) else f"named_struct('m',{_sql(m)},'f',{_sql(f)})" for m, f in variants) + ")")
    return fps.select("fp", F.explode(table).alias("v")).select(F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")


def _sql(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "shiftleft(1L, 63)"


def _components(m: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index that each member reaches in the run, by rows of the distance matrix."""
    n = len(m)
    label = np.full(n, -1)
    for s in range(n):
        if label[s] >= 0:
            continue
        label[s], todo = s, [s]
        while todo:
            near = np.flatnonzero((label < 0) & (np.bitwise_count(m ^ m[todo.pop()]) <= radius))
            label[near] = s
            todo += near.tolist()
    return label


def _links(radius: int, run_limit: int, exact: bool):
    """For rows sorted by key: (a, b) for a spanning forest of the true links of each run; (a, null) for members of runs over the limit."""

    def out(a, b) -> pa.RecordBatch:
        a, b = np.asarray(a, np.uint64).view(np.int64), None if b is None else np.asarray(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

    def stars(batches):  # every member of a run lies within half the radius of its key
        key = first = None
        for batch in batches:
            k, f = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            lead = np.where(new, np.arange(len(k)), -1)
            lead = np.maximum.accumulate(lead)
            head = np.where(lead >= 0, f[np.maximum(lead, 0)], first if first is not None else 0)
            key, first = k[-1], head[-1]
            keep = head != f
            yield out(head[keep].view(np.uint64), f[keep].view(np.uint64))

    def runs(k, f):
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(cut, len(k)))
        two = cut[sizes == 2]
        a, b = f[two], f[two + 1]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        left, right = [a[near]], [b[near]]
        for s, n in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            m = f[s : s + n]
            label = _components(m, radius)
            joined = label != np.arange(n)
            left.append(m[label[joined]])
            right.append(m[joined])
        return out(np.concatenate(left), np.concatenate(right))

    def pairs(batches):
        hot, ck, cf = None, np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:
                same = int(np.searchsorted(k, hot, side="right"))
                yield out(f[:same], None)
                k, f = k[same:], f[same:]
            if not len(k):
                continue
            hot = None
            k, f = np.concatenate([ck, k]), np.concatenate([cf, f])
            last = int(np.searchsorted(k, k[-1]))
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(cut, len(k)))
            big = sizes > run_limit
            if big.any():
                keep = np.repeat(~big, sizes)
                yield out(f[~keep], None)
                if big[-1]:
                    hot = k[-1]
                done = keep.copy()
                done[last:] = False
            else:
                keep = np.ones(len(k), bool)
                done = keep.copy()
                done[last:] = False
            if done.any():
                yield runs(k[done], f[done])
            ck, cf = (np.empty(0, np.int64), np.empty(0, np.uint64)) if hot is not None else (k[last:], f[last:])
        if len(ck):
            yield runs(ck, cf)

    return stars if exact else pairs


def links(fps: DataFrame, radius: int = 4, run_limit: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, each once) whose components are those of all links."""
    found = materialise(_emit(fps, block_variants(radius)).mapInArrow(_links(radius, run_limit, False), "a long, b long").distinct())
    edges, hot = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("fp"))
    if hot.limit(1).count():
        edges = edges.union(_emit(hot, ball_variants(radius)).mapInArrow(_links(radius, run_limit, True), "a long, b long")).distinct()
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest reachable: alternating large and small stars.

    Degrees of a hub are aggregated before they are joined back, so no group is gathered in one task.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = tuple(state)
        both = now.union(now.select("u", "v")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("u < v").distinct()
        after = materialise(small)
        release(now)
        now = after


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, run_limit: int = 2048) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs.

    Rows are the nodes: repeated rows and ties share a fingerprint and so a component. Null, empty and wordless texts
    have fingerprint 0, linked like any other. component_id is the smallest non-null doc_id reachable. An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    of_doc = materialise(fingerprints(docs, words))
    least = materialise(of_doc.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    linked = materialise(components(links(least.select("fp"), radius, run_limit)))
    member = linked.select(F.col("node").alias("fp"), "root").union(linked.select("root", "root").distinct())
    group = least.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    lowest = group.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = group.join(lowest, "root").select("fp", "component_id")
    return of_doc.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest doc_id.

    Rows that repeat a doc_id are one document, of which the row with the smallest text stays. Rows with a null doc_id
    can't be told apart and all stay.
    """
    groups = materialise(near_duplicates(docs.filter("doc_id is not null"), words, radius))
    gone = materialise(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    again = materialise(groups.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = filter_ids(docs, gone, "left_anti").select(*docs.columns)
    if again.limit(1).count():
        one = filter_ids(kept, again, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), F.coalesce("text", F.lit(""))).alias("_r"))
        kept = filter_ids(kept, again, "left_anti").select(*docs.columns).unionByName(one.select("doc_id", "_r.*"))
    return kept
