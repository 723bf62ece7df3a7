"""Benchmark decontamination with a broadcast hash set of normalised test n-grams, in DataFrame operations only.

Every training window is hashed. Up to `set_bound` distinct windows of the benchmark travel with the stage as a set of
hashes that is looked up inside the document's row, so that nothing but hits leaves it. Beyond that the windows' hashes
(not their words) leave the row and are joined, with a broadcast side up to `bound` windows and a salted shuffle over
it. In every way the hits are then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import filter_ids, is_at_most, let, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(ws: Column, n) -> Column:
    """Start places (from 1) of all windows of n words."""
    return F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, n: int = 8) -> DataFrame:
    """(window, n, hash, items) of every distinct window: n words, or all words of shorter items. Null ids and wordless items give none."""
    def of(w: Column) -> Column:
        m = F.least(F.lit(n), F.size(w))
        return F.transform(F.when(F.size(w) > 0, _windows(w, m)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.array_join(F.slice(w, i, m), " ").alias("window"), m.alias("n"), F.xxhash64(F.transform(F.slice(w, i, m), lambda x: F.xxhash64(x))).alias("hash")))

    each = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.explode(let(words(F.col("text")), of)).alias("x"))
    return each.select("x.*", "item").groupBy("window", "n", "hash").agg(F.collect_set("item").alias("items"))


#: A window's hash is joined under one of so many salts, so that a window of many documents is spread.
SALTS = 16
#: clean() broadcasts the spans to cut, if counted at or under this (some 16 bytes each).
BROADCAST_SPANS = 1_000_000


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda x: F.xxhash64(x))


def _places(h: Column, lengths: list[int]) -> Column:
    """array<struct(at, n, hash)> of all windows of the given lengths."""


    def of(m: int) -> Column:
        return F.transform(_windows(h, m), lambda i: F.struct(i.alias("at"), F.lit(m).alias("n"), F.xxhash64(F.slice(h, i, m)).alias("hash")))

    return F.concat(*map(of, lengths)) if lengths else F.array().cast("array<struct<at:int,n:int,hash:bigint>>")


def _hits_in_rows(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, rid, n_words, found) of every row, by a set of hashes inside the row; known is counted."""
    marks = {m: [] for m in lengths}
    for r in known.select("n", "hash").distinct().collect():
        marks[r.n].append(r.hash)

    def of(w: Column, h: Column, m: int) -> Column:
        at = F.filter(_windows(w, m), lambda i: F.xxhash64(F.slice(h, i, m)).isin(marks[m]))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i, m), " ").alias("window")))

    def row(w: Column, h: Column) -> Column:
        at = [of(w, h, m) for m in lengths]
        none = F.array().cast("array<struct<at:int,window:string>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), (F.concat(*at) if at else none).alias("hits"))

    found = let(words(F.col("text")), lambda w: let(_hashes(w), lambda h: row(w, h)))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), found.alias("f"))
    hits = rows.select("doc_id", "rid", "f.n_words", F.explode_outer("f.hits").alias("x")).select("doc_id", "rid", "n_words", F.col("x.at").alias("at"), F.col("x.window").alias("window"))
    sure = hits.join(F.broadcast(known.select("window", "n", "items")), "window", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("at", "n", "items"))
    return sure.groupBy("rid", "doc_id", "n_words").agg(F.collect_list(hit).alias("found"))


def _hits_by_join(docs: DataFrame, known: DataFrame, lengths: list[int], wide: bool) -> DataFrame:
    """As _hits_in_rows, for any number of windows. A row's hits are as many as its windows at most."""
    rows = materialise(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text")))
    ws = rows.select("rid", F.explode(let(words(F.col("text")), lambda w: let(_hashes(w), lambda h: _places(h, lengths)))).alias("x")).select("rid", "x.*")
    if wide:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = ws.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "n", "salt"])
    else:
        hits = ws.join(F.broadcast(known), ["hash", "n"])
    by_row = hits.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "window", "items")).alias("hits"))

    def row(w: Column, hits: Column) -> Column:
        sure = F.filter(hits, lambda x: F.array_join(F.slice(w, x["at"], x["n"]), " ") == x["window"])
        return F.struct(F.size(w).cast("long").alias("n_words"), F.transform(sure, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["items"].alias("items"))).alias("found"))

    none = F.array().cast("array<struct<at:int,n:int,window:string,items:array<string>>>")
    found = let(words(F.col("text")), lambda w: row(w, F.coalesce("hits", none)))
    return rows.join(by_row, "rid", "left").select("rid", "doc_id", found.alias("f")).select("rid", "doc_id", "f.n_words", "f.found")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 8, set_bound: int = 20_000, bound: int = 200_000, least_items: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of docs.

    spans are the verified windows as struct(at, n), at counted in words from 1. Null and wordless texts have no words
    and no hits. Items with the same window are all found; items that repeat an id are one item. Null item ids take no
    part. Repeated rows and null ids each get their result; an empty benchmark hits nothing and an empty table gives no
    rows. Other columns are ignored.
    """
    known = materialise(item_windows(items, n))
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # at most n different ones
    if is_at_most(known, set_bound):
        row = _hits_in_rows(docs, known, lengths)
    else:
        row = _hits_by_join(docs, known, lengths, wide=not is_at_most(known, bound))
    spans = F.sort_array(F.array_distinct(F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n")))))
    row = row.select("doc_id", "n_words", spans.alias("spans"), F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    return row.select(
        "doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"), "spans",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words of all spans and what stands between the words of a span."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def mend(t: Column, lead: Column) -> Column:
        # word k (from 1) is token lead + 2k - 1; a span of n words from word k covers 2n - 1 tokens
        gone = F.flatten(F.transform(spans, lambda s: F.sequence(lead + 2 * s["at"] - 1, lead + 2 * (s["at"] + s["n"] - 1) - 1)))
        left = F.array_except(F.sequence(F.lit(1), F.size(t)), gone)
        return F.array_join(F.transform(left, lambda i: F.element_at(t, i)), "")

    lead = F.when(text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    return let(tokens, lambda t: let(lead, lambda k: mend(t, k)))


def clean(docs: DataFrame, items: DataFrame, n: int = 8, set_bound: int = 20_000, bound: int = 200_000, least_items: int = 2) -> DataFrame:
    """docs without rows that hold windows of least_items items or more; spans of fewer items are cut from their text.

    Columns stay as they are, whatever their names; n_chars, if there is one, follows the text. Null texts and rows with
    a null doc_id are kept as they are. Rows that repeat a doc_id all go if one of them is contaminated; otherwise each
    loses the spans of its own text. An empty benchmark changes nothing; an empty table gives an empty one.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id")
    found = decontaminate(docs.filter("doc_id is not null").select(key, "text"), items, n, set_bound, bound, least_items)
    judged = materialise(found.filter("n_hit > 0").select("doc_id.*", "contaminated", "spans"))
    gone = judged.filter("contaminated").select("doc_id").distinct()
    mend = judged.filter("not contaminated").groupBy(F.col("doc_id").alias("_k"), F.col("h").alias("_h")).agg(F.first("spans").alias("_s"))
    size = mend.agg(F.sum(F.size("_s")) + F.count("*")).first()[0] or 0
    # the row travels as one struct: no name of docs can clash with those of the join
    kept = filter_ids(docs, gone, "left_anti").select(F.struct(*docs.columns).alias("_d"))
    kept = kept.join(F.broadcast(mend) if size <= BROADCAST_SPANS else mend, (F.col("_d.doc_id") == F.col("_k")) & (F.xxhash64(F.col("_d.text")) == F.col("_h")), "left")
    cut = F.col("_s").isNotNull()
    kept = kept.select("_d", F.when(cut, without_spans(F.col("_d.text"), F.col("_s"))).otherwise(F.col("_d.text")).alias("_t"), cut.alias("_c"))
    made = {"text": F.col("_t")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("_c"), F.length("_t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_d.n_chars"))
    return kept.select(*[made.get(c, F.col("_d")[c]).alias(c) for c in docs.columns])
