"""Retrieval, measurement and statistics operators on hand-written edge rows; plans that must not change."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sextant import config
from sextant.operators import retrieval, summary, windows
from sextant.sources import http, readers
from sextant.streaming import samples as stream


def test_topk_ties_and_small_index(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 0.0])], "q_id string, q_vec array<float>")
    for block in (4096, 1):
        got = sorted((r.q_id, r.rank, r.chunk_id, r.dist) for r in retrieval.topk(index, q, block=block).collect())
        assert got == [("q", 1, "a", 0.0), ("q", 2, "b", 0.0), ("q", 3, "c", 1.0)]
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)] + [0.5]) for i in range(3000)]
    got = {}
    for x in retrieval.topk(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), spark.createDataFrame([("a", rows[0][1]), ("b", rows[5][1])], "q_id string, q_vec array<double>"), k=7).collect():
        got.setdefault(x.q_id, []).append((x.rank, x.dist, x.chunk_id))
    for q, v in (("a", rows[0][1]), ("b", rows[5][1])):
        dist = lambda w: round(max(0, 1 - sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w)), 6) + 0.0
        want = sorted((dist(w), i) for i, w in rows)[:7]
        assert [(d, i) for _, d, i in sorted(got[q])] == want


def test_threshold(spark):
    d = spark.createDataFrame([(0.5,), (2.0,)], "dist double")
    assert [retrieval.filter_threshold(d, t).count() for t in (0, 0.5, 2.0, 3.0)] == [2, 1, 2, 2]


def test_metadata_filter(spark):
    rows = [(1, " Title ", 0, 50), (2, "lemma", 0, 19), (3, "lemma", 0, 20), (4, None, 0, 30), (5, "text", None, 30), (6, "x", None, None)]
    d = spark.createDataFrame(rows, "i int, block_type string, chunk_start int, chunk_end int")
    assert sorted(r.i for r in retrieval.filter_metadata(d).collect()) == [3, 4, 5]


def bm25(question, texts):
    tok = lambda s: "".join(c if c.isalnum() else " " for c in s.lower()).split()
    docs = [tok(t) for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in tok(question)), 6) for d in docs]


def test_bm25(spark):
    sets = {"a": ("red red fish", ["red fish", "blue fish swims", "a red red red thing", "!!"]), "b": ("", ["x", "y"]), "c": ("x", ["x"]), "d": ("!", ["..", "??"])}
    rows = [(k, q, i, i + 1, t) for k, (q, ts) in sets.items() for i, t in enumerate(ts)]
    got = retrieval.bm25_rerank(spark.createDataFrame(rows, "q_id string, question string, c_id int, rank0 int, text string")).collect()
    for k, (q, ts) in sets.items():
        want = bm25(q, ts) if k in "ac" else [0.0] * len(ts)
        mine = sorted((g for g in got if g.q_id == k), key=lambda g: g.c_id)
        assert [g.score for g in mine] == pytest.approx(want)
        assert [g.c_id for g in sorted(mine, key=lambda g: g.rank)] == sorted(range(len(ts)), key=lambda i: (-want[i], i))


def test_answers_report_errors(spark):
    p = spark.createDataFrame([("q", "x", "p")], "q_id string, question string, prompt string")
    got = retrieval.answer(p, lambda prompts: 1 / 0).first()
    assert got.answer is None and "division" in got.error


def test_spans(spark):
    hits = spark.createDataFrame([("d", 0, 4), ("d", 4, 4), ("d", 3, 5), ("x", 0, 3), (None, 0, 3)], "source string, chunk_start int, chunk_end int")
    d = spark.createDataFrame([("d", " ab  cd")], "source string, text string")
    assert [r.span_text for r in retrieval.load_spans(hits, d, "source").collect()] == ["ab"]


# --- measurement ---


def test_marker_pairs(spark):
    r = random.Random(0)
    rows, want = [], []
    for key in range(120):
        open_at, at = None, 0
        for _ in range(r.randrange(9)):
            at += r.randrange(2)
            mark = r.choice(["START", "END"])
            rows.append((key, at, len(rows), mark))
            if mark == "START":
                open_at = at
            elif open_at is not None:
                if at > open_at:
                    want.append((key, open_at, at))
                open_at = None
    m = spark.createDataFrame(rows, "k int, ts_us long, line int, mark string")
    got = [(x.k, x.start_us, x.end_us) for x in windows.pair_markers(m, ["k"], ["ts_us", "line"]).collect()]
    assert sorted(got) == sorted(want)


def test_parse_markers(spark):
    lines = ["##MARK## ts_us=5 event=A_START q=1 junk q=2 r=a=b ", "noise", "x ##MARK## ts_us=1 event=X ##MARK## ts_us=7 event=B_END", "##MARK## ts_us=x event=C"]
    got = sorted((r.ts_us, r.event, r.meta) for r in windows.parse_markers(spark.createDataFrame([(x,) for x in lines], "line string")).collect())
    assert got == [(5, "A_START", {"q": "2", "r": "a=b"}), (7, "B_END", {})]


@pytest.mark.parametrize("bucket", [None, 3, 1000])
def test_interval_join(spark, bucket):
    r = random.Random(1)
    w = [(f"w{i}", s, s + r.randrange(12)) for i in range(25) for s in (r.randrange(60),)]
    ts = [r.randrange(80) for _ in range(200)]
    got = windows.interval_join(spark.createDataFrame([(t,) for t in ts], "ts_us long"), spark.createDataFrame(w, "name string, start_us long, end_us long"), bucket)
    assert sorted((x.ts_us, x.name) for x in got.collect()) == sorted((t, n) for t in ts for n, a, b in w if a <= t < b)


def test_normalise(spark):
    rows = [
        ("Package_0", "cpu_energy_rapl_msr_component", "uJ", "Package_0"), ("Package_1", "cpu_energy_rapl_msr_component", "uJ", None), ("Package_0", "cpu_energy_rapl_msr_component", "mJ", None),
        ("DRAM_1", "memory_energy_rapl_msr_component", "uJ", "DRAM_TOTAL"), ("g", "gpu_energy_nvidia_nvml_component", "uJ", "GPU_TOTAL"), ("[MACHINE]", "psu_energy_ac_mcp_machine", "uJ", "PSU_TOTAL"),
        ("app", "network_io_cgroup_container", "B", "app"), ("db", "network_io_cgroup_container", "B", None), ("x_Core-1", "lmsensors_temperature_component", "centi°C", "TEMP_CORE"), ("Package-id-0", "lmsensors_temperature_component", "centi_C", "TEMP_PACK"),
        ("nvme", "lmsensors_temperature_component", "centi°C", None), ("app", "unknown", "uJ", None), (None, "cpu_energy_rapl_msr_component", "uJ", None),
    ]
    s = spark.createDataFrame([(e, 1, m, 250.0, u) for e, m, u, _ in rows], stream.SAMPLE)
    got = windows.normalise(s).collect()
    assert sorted(g.entity for g in got) == sorted(w for *_, w in rows if w)
    assert {g.value for g in got if g.entity.startswith("TEMP")} == {2.5}
    maps = {r.out_entity: r.raw_entities for r in windows.entity_mappings(s).collect()}
    assert maps["TEMP_IGNORED"] == ["nvme"] and maps["DRAM_TOTAL"] == ["DRAM_1"]


# --- statistics ---


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 5.0], [-1.0, 1.0], [1.0, None, float("nan"), 4.0, 2.5]])
def test_metric_summary(spark, values):
    d = spark.createDataFrame([("k", v) for v in values] + [("empty", None)], "k string, value double")
    got = {r.k: r for r in summary.metric_summary(d, ["k"]).collect()}
    raw = {r.k: r for r in summary.metric_summary(d, ["k"], raw=True).collect()}
    assert got["empty"].n == 0 and got["empty"].mean is None
    v = [x for x in values if x is not None and x == x]
    if not v:
        return
    mean, sd = statistics.fmean(v), statistics.stdev(v) if len(v) > 1 else None
    assert got["k"].n == len(v) and got["k"].mean == round(mean, 2) and got["k"].stdev == (None if sd is None else round(sd, 2))
    cv = 100 * sd / abs(mean) if sd is not None and mean else None
    assert got["k"].cv_pct == (round(cv, 2) if cv else None)
    assert raw["k"].stdev == pytest.approx(sd or 0.0) and raw["k"].cv_pct == (pytest.approx((cv or 0.0)) if mean else None)
    want = statistics.quantiles(v, n=20, method="inclusive") if len(v) > 1 else [v[0]] * 19
    assert [raw["k"][p] for p in ("p10", "p25", "p50", "p75", "p90")] == pytest.approx([want[1], want[4], want[9], want[14], want[17]])


def test_weights_total_series_rounding(spark):
    d = spark.createDataFrame([("a", 1, 10.0, 3), ("a", 2, 20.0, None), ("b", 3, 5.0, -1), ("b", 1, None, 2)], "e string, run int, v double, w int")
    got = {r.e: r for r in summary.weighted_mean(d, ["e"], "v", "w").collect()}
    assert got["a"].mean_value == 12.5 and got["b"].mean_value == 5.0
    t = {r.e: r.sum_value for r in summary.with_total(d.withColumn("k", F.lit(1)), ["k"], "e", "v").collect()}
    assert t == {"a": 30.0, "b": 5.0, "TOTAL": 35.0}
    assert {r.e: r.series for r in summary.run_series(d, ["e"], "run", "v").collect()} == {"a": [10.0, 20.0], "b": [None, 5.0]}
    assert spark.createDataFrame([(2.675,)], "v double").select(summary.py_round(F.col("v"))).first()[0] == 2.67


# --- sources, settings, streams ---


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\xff\xc3\xa9")
    (tmp_path / "sub" / "b.TXT").write_text("b")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "c.md").write_text("c")
    assert sorted(r.text for r in readers.text_files(spark, str(tmp_path)).collect()) == ["b", "x\ny\nzé"]


def test_measurement_and_phase_files(spark, tmp_path):
    m = tmp_path / "r_measurements.json"
    m.write_text(json.dumps({"success": True, "data": [["e", 5, "m", 1.5, "uJ"], ["short", 1], ["f", 6, "m", 2, "uJ"]]}))
    assert sorted(tuple(r) for r in readers.measurements(spark, str(m)).collect()) == [("e", 5, "m", 1.5, "uJ"), ("f", 6, "m", 2.0, "uJ")]
    with pytest.raises(ValueError):
        readers.measurements(spark, "x.json.gz")
    p = tmp_path / "phase.json"
    p.write_text(json.dumps({"data": {"id": "r", "phases": [{"name": "[A]", "start": 1, "end": 3, "hidden": False}, {"name": "h", "start": 1, "end": 2, "hidden": True}]}}))
    w = windows.phases_to_windows(readers.phases(spark, str(p))).collect()
    assert [(x.name, x.kind, x.duration_s) for x in w] == [("[A]", "gmt_phase", 2e-6)]


def test_index_append(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([("0", 1), ("1", 2)], "chunk_id string, v int")
    readers.write_index(a, path)
    readers.write_index(spark.createDataFrame([("1", 9), ("2", 3)], "chunk_id string, v int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("0", 1), ("1", 2), ("2", 3)]
    readers.write_index(a, path, reset=True)
    assert spark.read.parquet(path).count() == 2


def test_config():
    c = config.load({"CHUNK_SIZE": "100", "METADATA_FILTER": "0", "POST_BM25_RERANK": "No", "TOP_K": "", "TEMPERATURE": "0.5", "LLM_HOST": "__GMT_VAR_LLM_HOST__", "OLLAMA_MODEL": "m", "METADATA_ENHACEMENT": "yes"})
    assert (c.chunk_size, c.metadata_filter, c.post_bm25_rerank, c.top_k, c.temperature, c.llm_host, c.llm_model, c.metadata_enhancement) == (100, True, False, 5, 0.5, "http://localhost", "m", True)


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert http.with_retries(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        http.with_retries(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)


def test_stream(spark, tmp_path):
    for k, rows in enumerate([[("Package_0", 5, "cpu_energy_rapl_msr_component", 2.0, "uJ")], [("Package_0", 1, "cpu_energy_rapl_msr_component", 3.0, "uJ"), ("Package_0", 50, "cpu_energy_rapl_msr_component", 3.0, "uJ")]]):
        spark.createDataFrame(rows, stream.SAMPLE).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    w = spark.createDataFrame([("w", 0, 10), ("v", 4, 6)], "name string, start_us long, end_us long")
    s = spark.readStream.schema(stream.SAMPLE).json(str(tmp_path / "in/*"))
    q = stream.window_sums(s, w).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window, r.sum_value, r.n) for r in spark.sql("select * from sums").collect()} == {("w", 5.0, 2), ("v", 2.0, 1)}
