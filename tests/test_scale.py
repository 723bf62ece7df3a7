"""Work that grows with the input: what is held in memory, shuffled or walked over again."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.operators import retrieval


def test_lsh_writes_no_pairs_and_leaves_out_vectors_without_direction(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 8)))] + [(300, [0.0] * 8), (301, None)]
    index = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asks = index.filter("chunk_id % 10 = 0").selectExpr("chunk_id AS q_id", "embedding AS q_vec")
    near = retrieval.topk_lsh(index, asks, k=5, block=16)
    assert "explode" not in near._jdf.queryExecution().toString().lower()
    got, exact = ({(x.q_id, x.rank): (x.chunk_id, x.dist) for x in d.collect()} for d in (near, retrieval.topk(index, asks, k=5)))
    assert {q for q, _ in got} == set(range(0, 300, 10)) and got.keys() == exact.keys()
    assert sum(got[x] == exact[x] for x in got) >= 0.9 * len(exact)
    assert not retrieval.topk_lsh(index, asks, k=5, radius=1e-9).filter("dist > 0").count()


def shuffled(d) -> list[set[str]]:
    """Names of the columns of each shuffle in the plan."""
    plan = d.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(d._jdf.queryExecution(), "formatted")
    return [{c.strip().split("#")[0] for c in cs.split(",")} for cs in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_bm25_shuffles_no_terms_of_each_candidate(spark, sf):
    from sextant.plans import catalogue

    seen = shuffled(catalogue.QUERIES["bm25_rerank"](spark, sf))
    assert any("term" in s for s in seen) and not [s for s in seen if s & {"text", "tokens"} or s >= {"c_id", "term"}]
    rows = [("a", "red fish fish", 1, 1, "red fish"), ("a", "red fish fish", 2, 2, "blue red red"), ("a", "red fish fish", 3, 3, None), ("a", "red fish fish", 4, 4, "?!"), ("b", "red", 1, 1, "!"), ("c", None, 1, 1, "red")]
    d = spark.createDataFrame(rows, "q_id string, question string, c_id int, rank0 int, text string")
    got = {(r.q_id, r.c_id): (r.score, r.rank) for r in retrieval.bm25_rerank(d).collect()}
    given = {(r.q_id, r.c_id): (r.score, r.rank) for r in retrieval.bm25_rerank(d, questions=d.select("q_id", "question").distinct()).collect()}
    assert got == given
    # four candidates, five tokens in the three that have a text; idf of red: ln(2.5 / 2.5), of fish and blue: ln(3.5 / 1.5)
    fish = 2 * np.log(3.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (5 / 3)))
    assert got["a", 1] == (pytest.approx(fish, abs=1e-6), 1)
    assert [got["a", i] for i in (2, 3, 4)] == [(0.0, 2), (0.0, 3), (0.0, 4)] and got["b", 1] == got["c", 1] == (0.0, 1)


def seconds(d) -> float:
    import time

    t = time.time()
    d.write.format("noop").mode("overwrite").save()
    return time.time() - t


@pytest.mark.parametrize("line", ["", "## h\n"])
def test_chunks_of_a_text_take_time_in_proportion_to_its_length(spark, line):
    from sextant.operators import chunking

    unit = line + "some words here and there, no end of them\n"
    d = lambda chars: spark.createDataFrame([(0, chars // len(unit))], "i int, n int").coalesce(1).select("i", F.repeat(F.lit(unit), F.col("n")).alias("text"))
    short, long = (chunking.structure(d(chars), ["i"]) for chars in (500_000, 3_000_000))
    for _ in range(2):
        seconds(short)
    assert seconds(long) < 14 * seconds(short) + 1
    assert long.count() == pytest.approx(6 * short.count(), rel=0.01)


def test_headings_titles_and_blocks_of_odd_lines(spark):
    from sextant.operators import chunking

    r = random.Random(8)
    texts = ["".join(r.choices("a# # \t\n\r\x0b\x0c\x1c\x1f\x85  　é😀#", k=r.randrange(30))) for _ in range(3000)] + ["", "#", "# ", "# \n", "#\r\n# a\r\n", "#\x0b\n", "####### x", "x" + "\n# y" * 700]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = d.select("i", chunking.headings(F.col("t")).alias("h"), chunking.document_title(F.col("t")).alias("d"), chunking.blocks(F.col("t")).alias("b")).collect()
    for g in got:
        t, pos, heads = texts[g.i], 0, []
        for line in t.splitlines(keepends=True):
            bare = line.rstrip("\r\n")
            m = re.match(r"(#{1,6})\s+(.*)\Z", bare, re.S)
            if m:
                heads.append((pos, pos + len(line), bare, len(m[1]), m[2].strip()))
            pos += len(line)
        assert [tuple(h) for h in g.h] == [h[:3] for h in heads], repr(t)
        edges = [(0, 0, "")] + [(h[1], h[3], h[4]) for h in heads]
        stops = [h[0] for h in heads] + [len(t)]
        assert [tuple(b) for b in g.b] == [(s, e, n, title, t[s:e]) for (s, n, title), e in zip(edges, stops) if t[s:e].strip()], repr(t)
        lines = [x.strip() for x in t.splitlines()]
        rest = [re.sub(r"^#\s+", "", x) for x in lines if re.match(r"#\s+", x)][:1]
        assert g.d == ((rest and rest[0]) or next((x for x in lines if x), "")), repr(t)


def test_search_holds_bounded_products_in_memory():
    r = np.random.default_rng(2)
    asked = r.normal(size=(4096, 16))
    rows = np.repeat(r.normal(size=(8, 16)), 512, axis=0)  # chunks of the same document have the same vector
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])
    queries = SimpleNamespace(value=retrieval._by_size([(i, v) for i, v in enumerate(asked.tolist())]) if hasattr(retrieval, "_by_size") else asked.tolist())
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(list(retrieval._nearest(queries, 5)([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argmax(unit(asked) @ unit(rows[::512]).T, axis=1)
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("_q", "chunk_id")))) == [(q, 512 * b + i) for q, b in enumerate(best.tolist()) for i in range(5)]
    assert peak < 60e6


def test_rows_with_the_same_vector_are_one_row_of_the_search():
    r = np.random.default_rng(3)
    vectors, many = r.normal(size=(60, 8)), r.integers(1, 90, 60)
    rows, asked = np.repeat(vectors, many, axis=0), r.normal(size=(600, 8))
    ids = r.permutation(len(rows))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])
    queries = SimpleNamespace(value=retrieval._by_size(list(enumerate(asked.tolist()))))
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(list(retrieval._nearest(queries, 5)([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    dist = np.floor((1 - unit(asked) @ unit(vectors).T) * 1e6 + 0.5) / 1e6
    dist = np.repeat(dist, many, axis=1)
    want = [(q, i, d) for q in range(600) for d, i in sorted(zip(dist[q].tolist(), ids.tolist()))[:5]]
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("_q", "chunk_id", "dist")))) == sorted(want)
    assert peak < 3e6


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp"])
def test_search_runs_no_second_set_of_python_workers(spark, kind):
    r = np.random.default_rng(4)
    index = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(90, 8)).tolist())], "chunk_id long, embedding array<double>").localCheckpoint()
    asks = index.filter("chunk_id % 9 = 0").select(F.col("chunk_id").cast(kind).alias("q_id"), F.col("embedding").alias("q_vec"))
    for block in (4, 100):
        near = retrieval.topk(index, asks, k=3, block=block)
        assert dict(near.dtypes)["q_id"] == kind and near.filter("rank = 1 AND dist = 0").select("q_id").exceptAll(asks.select("q_id")).isEmpty()
        assert near.count() == 30 and near.select("q_id").distinct().exceptAll(asks.select("q_id")).isEmpty()
        # local rows made in Python come as an RDD that Python workers read; the checkpoint is one that they don't
        names = [x for x in near._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n") if "_q#" in x]
        assert names and all(x.startswith("LocalRelation") for x in names)
    assert retrieval.topk(index, asks.limit(0), k=3).isEmpty()
