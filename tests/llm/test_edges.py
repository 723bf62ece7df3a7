"""Every operator and stage on nulls, repeats, empty tables, and extra columns named like the operators' own."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import ann, chat, decontam, htmltext, langid, licenses, packing, simhash, toxicity, urls
from sextant.llm.queries import tokenizer_path
from tests.llm.test_operators import words

#: Names that operators give to columns of their own.
INTERNAL = (
    "fp", "root", "component_id", "node", "m", "v", "u", "x", "y", "a", "b", "e", "key", "count", "_r", "score", "predicted", "held_out", "lang_pred", "at", "n", "rid", "n_words", "hits", "found", "f", "items", "item", "window",
    "hash", "spans", "contaminated", "_d", "_k", "_h", "_s", "_t", "_c", "h", "salt", "lead", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "license", "coverage", "n_matches", "matches",
)


def clash(df, *taken):
    return df.withColumns({c: F.lit(1) for c in INTERNAL if c not in df.columns and c not in taken})


def written(folder, docs, labels, benchmark):
    t = lambda rows, schema: pa.table({k: pa.array([r[i] for r in rows], v) for i, (k, v) in enumerate(schema.items())})
    one = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    rows = [(i, x, g, None if i == 3 else "s", None if x is None else len(x)) for i, x, g in docs]
    table = t(rows, one)
    for c in INTERNAL:
        table = table.append_column(c, pa.array([7] * len(rows), pa.int32()))
    pq.write_table(table, folder / "documents.parquet")
    pq.write_table(t(labels, {"doc_id": pa.int64(), "quality": pa.int64(), "toxic": pa.int64()}), folder / "labels.parquet")
    pq.write_table(t(benchmark, {"item_id": pa.int64(), "text": pa.string()}), folder / "benchmark.parquet")
    return table.column_names


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(folder)))
        out[name] = docs
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, str(folder))


def test_pipeline_edges(spark, tmp_path):
    leak, leak2 = words(12, 70), words(12, 71)
    docs = [(i, words(60, i), "aa") for i in range(100, 140)] + [
        (1, None, "aa"), (2, "", None), (3, "12 ½ !", None), (4, words(50, 2), None), (4, words(50, 2), None), (5, words(50, 2) + " w1", None), (None, words(40, 3), None), (None, words(40, 3), None),
        (6, f"{words(30, 5)} {leak} {leak2}", None), (7, f"{words(30, 6)} {leak} {words(5, 8)}", None), (8, words(30_000, 9), None), (9, words(50, 2), "aa"),
    ]
    columns = written(tmp_path, docs, [(100, 1, 0), (101, None, None), (None, 1, 1), (102, 0, 0)], [(1, leak), (2, leak2), (3, None), (None, leak), (4, "")])
    by, packed = stages(spark, tmp_path)
    assert all(df.columns == columns for df in by.values())
    ids = {name: sorted((r.doc_id or -1) for r in df.select("doc_id").collect()) for name, df in by.items()}
    every = sorted((d[0] or -1) for d in docs)
    assert ids["toxicity"] == every  # labels of one kind: no model, all rows stay
    assert ids["language"] == [i for i in every if i not in (1, 2, 3)]
    assert [ids["near_copies"].count(i) for i in (-1, 4, 9, 100)] == [2, 1, 0, 1]
    last = {r.doc_id: r for r in by["decontamination"].filter("doc_id is not null").collect()}
    assert 6 not in last and leak not in last[7].text and last[7].n_chars == len(last[7].text) and last[7].fp == 7 and last[8].text == words(30_000, 9)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {t.doc_id for t in tokens} == {*last, None} and all(t.n == t.all for t in tokens if t.doc_id is not None)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    docs = [] if empty == "documents" else [(i, words(60, i), "aa") for i in range(30)]
    labels = [] if empty == "labels" else [(i, 1, i % 2) for i in range(10)]
    columns = written(tmp_path, docs, labels, [] if empty == "benchmark" else [(1, words(12, 70))])
    by, packed = stages(spark, tmp_path)
    assert all(df.columns == columns for df in by.values())
    if empty == "documents":
        assert packed.count() == 0
    if empty == "labels":
        assert packed.select("doc_id").distinct().count() == 30


def test_operators_with_clashing_columns(spark):
    d = clash(spark.createDataFrame([(1, "wolf moss wolf moss a b c", "aa"), (2, None, None), (2, "wolf moss wolf moss a b c", "bb"), (None, "x", "aa")], "doc_id long, text string, lang string"))
    bench = clash(spark.createDataFrame([(1, "wolf moss wolf")], "item_id long, text string"))
    marks = clash(spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    profiles = langid.train(["wolf moss", "banana"], ["aa", "bb"], 64)
    assert simhash.near_duplicates(d).count() == toxicity.score(d, toxicity.fit(d, marks)).count() == langid.predict(d, profiles).count() == licenses.scan_docs(d).count() == 4
    assert {r.component_id for r in simhash.near_duplicates(d).filter("doc_id = 1").collect()} == {1}
    assert sorted(r.n_hit for r in decontam.decontaminate(d, bench).collect()) == [0, 0, 3, 3]
    assert packing.pack(d, tokenizer_path(), prompt=packing.first_line()).select("doc_id").distinct().count() == 3
    for out in (simhash.deduplicate(d), toxicity.drop_toxic(d, None), langid.keep_known(d, profiles), decontam.clean(d, bench)):
        assert out.columns == d.columns and out.count() > 0
    pages = clash(spark.createDataFrame([(1, "http://a.com/en/1", "<p>x</p>")], "page_id long, url string, html string"))
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "ruled", "block", "verdict", "text", "s", "f_length", "b_length")})
    assert urls.judge(pages).first().verdict == "block" and htmltext.extract_pages(pages).first().text == "x"
    talk = clash(spark.createDataFrame([(1, 1, "a", "t"), (1, None, None, None)], "conv_id long, turn long, role string, text string"))
    talk = talk.withColumns({c: F.lit(1) for c in ("perspective", "speaker", "rendered", "block", "inside", "base", "loss", "end")})
    assert chat.rotate(talk).count() == 4 and chat.rotate(talk.limit(0)).count() == 0
    vectors = clash(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>"), "v")
    vectors = vectors.withColumns({c: F.lit(1) for c in ("id", "v", "asks", "list", "pv", "pq", "nv", "nq", "bound", "sure", "d", "top", "query_id", "rank")})
    assert ann.search(vectors, F.col("vec_id") == 0, k=3).count() == 3
    assert langid.predict(d.limit(0), profiles).count() == licenses.scan_docs(d.limit(0)).count() == simhash.deduplicate(d.limit(0)).count() == 0


def test_long_conversation(spark):
    d = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'ann', 'bob') AS role", "repeat('word ', 2000) AS text")
    got = chat.rotate(d).groupBy("perspective").agg(F.count("*").alias("n"), F.max("end").alias("end"), F.sum(F.length("rendered")).alias("all")).collect()
    assert len(got) == 2 and all(g.n == 3000 and g.end == g["all"] for g in got)
