"""Fixed-window and heading-aware chunking, row by row: arrays are built inside the document's row, so nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocktypes import block_type
from ..functions.text import RX_FIRST, RX_HEADING, RX_HEADING_LINES, RX_TITLE, is_blank, let, py_strip, windows  # noqa: F401


def simple(docs: DataFrame, keys: list[str], text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """keys, chunk_index, chunk_start, chunk_end, chunk_text. Blank windows are dropped but use up an index; a tail inside the window before it is kept."""
    if size < 1:
        raise ValueError("size must be positive")
    step = max(1, size - overlap)

    def cut(t: Column) -> Column:
        # the length is a walk over the text: once for each text, not for each window
        piece = lambda n: lambda w, i: F.struct((i * step).alias("chunk_start"), F.least(i * step + size, n).alias("chunk_end"), w.alias("chunk_text"))
        return let(F.length(t), lambda n: F.transform(windows(t, size, step), piece(n)))

    rows = docs.select(*keys, let(F.col(text), cut).alias("_c")).select(*keys, F.posexplode("_c").alias("chunk_index", "c"))
    return rows.select(*keys, "chunk_index", "c.*").filter(~is_blank(F.col("chunk_text")))


def _offsets(lengths: Column, part: int = 256) -> Column:
    """Sums of the lengths before each; in parts, as an array is copied for each entry that is put to it."""
    running = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def join(parts: Column) -> Column:
        shift = lambda p, base: F.transform(F.slice(running(p), 1, F.size(p)), lambda x: x + base)
        return let(running(F.transform(parts, total)), lambda base: F.flatten(F.transform(parts, lambda p, i: let(F.get(base, i), lambda at: shift(p, at)))))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / part).cast("int")), lambda i: F.slice(a, i * part + 1, part))
    return let(lengths, lambda a: F.when(F.size(a) <= part, F.slice(running(a), 1, F.size(a))).otherwise(let(cut(a), join)))


def _split(text: Column, body) -> Column:
    """body(heads, texts, starts): heading lines, the texts before, between and after them, and where those begin."""
    heads, texts = F.regexp_extract_all(text, F.lit(RX_HEADING_LINES), F.lit(0)), F.split(text, RX_HEADING_LINES, -1)
    lengths = lambda hs, ts: F.zip_with(ts, hs, lambda t, h: F.length(t) + F.coalesce(F.length(h), F.lit(0)))
    return let(heads, lambda hs: let(texts, lambda ts: let(_offsets(lengths(hs, ts)), lambda starts: body(hs, ts, starts))))


def headings(text: Column) -> Column:
    """array<struct(start, stop, line)> of heading lines: up to six hashes at the line's start, then white space."""
    def of(heads: Column, texts: Column, starts: Column) -> Column:
        line = lambda h: F.regexp_replace(h, r"[\r\n]+\z", "").alias("line")
        return F.transform(heads, lambda h, i: F.struct((F.get(starts, i + 1) - F.length(h)).alias("start"), F.get(starts, i + 1).alias("stop"), line(h)))

    return _split(text, of)


def document_title(text: Column) -> Column:
    """Rest of the first line with one hash, indented or not; else the first line that isn't blank; else empty."""
    one = F.regexp_extract(text, RX_TITLE, 1)
    return F.coalesce(py_strip(F.when(one != "", one).otherwise(F.regexp_extract(text, RX_FIRST, 0))), F.lit(""))


def blocks(text: Column) -> Column:
    """array<struct(start, stop, hashes, title, text)>: what lies between heading lines; blank blocks are left out."""
    def of(heads: Column, texts: Column, starts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            head = F.coalesce(F.get(heads, i - 1), F.lit(""))
            hashes, title = F.length(F.regexp_extract(head, "^#*", 0)), py_strip(F.regexp_replace(head, "^#+", ""))
            start = F.get(starts, i)
            return F.struct(start.alias("start"), (start + F.length(t)).alias("stop"), hashes.alias("hashes"), title.alias("title"), t.alias("text"))

        return F.filter(F.transform(texts, one), lambda b: ~is_blank(b["text"]))

    return _split(text, of)


def structure(docs: DataFrame, keys: list[str], text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """keys, chunk_index, chunk_start, chunk_end, chunk_text, doc_title, block_title, block_type.

    Within a block the last window ends with the block; blank pieces use no index. overlap must be smaller than size.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - max(overlap, 0)

    def pieces(b: Column) -> Column:
        count = lambda n: F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step).cast("int"))

        def piece(n: Column, kind: Column):
            return lambda w, i: F.struct((b["start"] + i * step).alias("chunk_start"), (b["start"] + F.least(i * step + size, n)).alias("chunk_end"), w.alias("chunk_text"), b["title"].alias("block_title"), kind.alias("block_type"))

        every = lambda n, kind: F.transform(F.slice(windows(b["text"], size, step), 1, count(n)), piece(n, kind))
        return let(b["stop"] - b["start"], lambda n: let(block_type(b["hashes"], b["title"]), lambda kind: every(n, kind)))

    every = let(blocks(F.col(text)), lambda bs: F.filter(F.flatten(F.transform(bs, pieces)), lambda c: ~is_blank(c["chunk_text"])))
    # the arrays come first: beside a generator, other columns would be computed for each chunk
    rows = docs.select(*keys, document_title(F.col(text)).alias("doc_title"), every.alias("_c"))
    out = rows.select(*keys, "doc_title", F.posexplode("_c").alias("chunk_index", "c"))
    return out.select(*keys, "chunk_index", "c.chunk_start", "c.chunk_end", "c.chunk_text", "doc_title", "c.block_title", "c.block_type")


def chunk(docs: DataFrame, keys: list[str], strategy: str = "simple", **options) -> DataFrame:
    if strategy not in ("simple", "structure"):
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return (simple if strategy == "simple" else structure)(docs, keys, **options)


def with_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunks with chunk_id, "0" to "n-1" in the given total order.

    Two passes instead of one global window: a range partitioning by the order, the rows before each partition (as many
    numbers as partitions), and a count inside it.
    """
    parts = chunks.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sized = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sized.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", at).join(F.broadcast(before), "_p").withColumn("chunk_id", (F.col("_b") + F.col("_r") - 1).cast("string")).drop("_p", "_r", "_b")
