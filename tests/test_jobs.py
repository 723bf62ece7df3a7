"""Jobs end to end: markers to windows, merged runs, judged answers, and files written and read back."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from sextant import logs
from sextant.config import Config
from sextant.operators import judging, retrieval, windows
from sextant.plans import merge
from sextant.sources import readers, sinks
from sextant.streaming import markers as marker_stream


def line(ts, event, **kv):
    return " ".join(["12:00 INFO x", "##MARK##", f"ts_us={ts}", f"event={event}", *(f"{k}={v}" for k, v in kv.items())])


LINES = [line(5, "CHUNKING_START"), line(7, "CHUNKING_START"), line(9, "CHUNKING_END", n=3), line(10, "CHUNKING_END"), line(11, "RETRIEVAL_START", q_id="q1"), line(12, "RETRIEVAL_START", q_id="q2"), line(15, "RETRIEVAL_END", q_id="q1"), line(16, "RETRIEVAL_END", q_id="q2"), line(17, "OTHER"), "no marker", line(20, "X_START"), line(20, "X_END")]
WINDOWS = {("p/CHUNKING", 7, 9), ("p/RETRIEVAL/q1", 11, 15), ("p/RETRIEVAL/q2", 12, 16)}


def test_markers_to_windows(spark):
    parsed = windows.parse_markers(spark.createDataFrame([(x,) for x in LINES], "line string"))
    got = windows.sub_windows(parsed, "p", keyed=True).collect()
    assert {(g.name, g.start_us, g.end_us) for g in got} == WINDOWS and {g.kind for g in got} == {"sub_window"}
    assert {g.name for g in windows.sub_windows(parsed, "p").collect()} == {"p/CHUNKING", "p/RETRIEVAL"}


def test_markers_of_a_stream(spark, tmp_path):
    for k, part in enumerate((LINES[:6], LINES[6:])):
        spark.createDataFrame([(x,) for x in part], "line string").coalesce(1).write.text(str(tmp_path / f"in/{k}"))
    lines = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).text(str(tmp_path / "in"))
    q = marker_stream.pair(lines, "p", keyed=True).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("pairs").collect()} == WINDOWS


def test_log_and_markers(tmp_path, spark):
    root = logging.getLogger()
    before, level = root.handlers[:], root.level
    root.handlers[:] = []
    try:
        logs.setup(Config(log_dir=str(tmp_path / "logs"), log_level="debug "))
        assert root.level == logging.DEBUG and len(root.handlers) == 2 and logs.setup(Config()) is root and len(root.handlers) == 2
        ts = logs.mark("A_START", q_id=4)
    finally:
        root.handlers[:] = before
        root.setLevel(level)
    got = windows.parse_markers(spark.read.text(str(tmp_path / "logs")).withColumnRenamed("value", "line")).first()
    assert (got.ts_us, got.event, got.meta) == (ts, "A_START", {"q_id": "4"})


@pytest.mark.parametrize("indent", [None, 1])
def test_measurements_of_any_layout(spark, tmp_path, indent):
    rows = [["[SYSTEM]", 5, "cpu_utilization_procfs_system", 1.5, "Ratio"], ["short", 1], ["a \"q\" \\ [x]", 6, "m", 2, "uJ"], ["app", 7, "m", -1e-3, "B"]]
    path = tmp_path / "r_measurements.json"
    path.write_text(json.dumps({"success": True, "data": rows, "after": [1]}, indent=indent))
    assert sorted(tuple(r) for r in readers.measurements(spark, str(path)).filter("unit is not null").collect()) == sorted((r[0], r[1], r[2], float(r[3]), r[4]) for r in rows if len(r) == 5)
    path.write_text('{"success": true, "data": []}')
    assert readers.measurements(spark, str(path)).count() == 0


def test_merge_run(spark, tmp_path):
    sub = tmp_path / "raw"
    sub.mkdir()
    (sub / "2024-05-06_r1_measurements.json").write_text(json.dumps({"data": [["Package_0", t, "cpu_energy_rapl_msr_component", 10, "uJ"] for t in range(20)] + [["nvme", 3, "lmsensors_temperature_component", 1, "centi_C"]]}))
    stdout = "\n".join(LINES)
    (sub / "2024-05-06_r1_phase-data.json").write_text(json.dumps({"data": {"id": "r1", "name": "n", "warnings": ["w"], "phases": [{"name": "[RUNTIME]", "start": 0, "end": 10}], "logs": {"app": [{"cmd": "python index.py", "stdout": stdout}, {"cmd": "python index.py", "stdout": "again"}]}}}))
    phase, measured = (readers.run_file(str(tmp_path), "r1", k) for k in ("phase-data", "measurements"))
    run = readers.run_info(spark, phase).first()
    assert (run.id, run.name, run.warnings, run.date) == ("r1", "n", 1, "2024-05-06")
    with pytest.raises(FileNotFoundError):
        readers.run_file(str(tmp_path), "r2", "measurements")
    out = merge.merge_run(spark, phase, measured, {"index.py": ("p", True)})
    energy = {r.window: (r["sum"], r["count"]) for r in out["records"].filter("entity = 'Package_0'").collect()}
    assert energy == {"[RUNTIME]": (100.0, 10), "p/CHUNKING": (20.0, 2), "p/RETRIEVAL/q1": (40.0, 4), "p/RETRIEVAL/q2": (40.0, 4)}
    assert tuple(out["counters"].first()) == (21, 20) and out["mappings"].first().raw_entities == ["nvme"] and out["markers"].count() == 11
    runs = out["records"].withColumn("run", F.lit(1)).unionByName(out["records"].withColumn("run", F.lit(2)))
    stats = {r.window: r for r in merge.summarise_runs(runs, "sum").filter("entity = 'Package_0'").collect()}
    assert set(stats) == {"[RUNTIME]"} and stats["[RUNTIME]"].n == 2 and stats["[RUNTIME]"].mean == 100.0


def test_judge(spark):
    rows = [("q1", "red fish", "a red thing", ["red fish swims"], "g"), ("q2", "x", "", [], None), ("q3", None, "b", None, "g"), ("bad", "x", "fail", ["c"], "g")]
    d = spark.createDataFrame(rows, "q_id string, question string, answer string, contexts array<string>, gold_doc string")
    got = {r.q_id: r for r in judging.score(d).collect()}
    assert (got["q1"].faithfulness, got["q1"].answer_relevancy, got["q1"].context_utilization, got["q1"].gold_doc) == (0.333333, 0.5, 0.333333, "g")
    assert (got["q2"].faithfulness, got["q2"].answer_relevancy, got["q2"].context_utilization) == (None, 0.0, None) and got["q3"].answer_relevancy == 0.0

    calls = {}

    def flaky(question, answer, contexts):
        calls[answer] = calls.get(answer, 0) + 1
        if answer == "fail" or calls[answer] < 2:
            raise OSError("busy")
        return 1

    again = {r.q_id: r for r in judging.score(d, dict.fromkeys(judging.OVERLAP, flaky), tries=3, delay=0).collect()}
    assert again["q1"].faithfulness == 1.0 and again["q1"].judge_error is None and again["bad"].judge_error == "OSError: busy" and again["bad"].faithfulness is None


def test_answers_fail_one_by_one(spark):
    p = spark.createDataFrame([(q, "x", q) for q in "abc"], "q_id string, question string, prompt string").coalesce(1)

    def generate(prompts):
        if prompts == ["b"]:
            raise OSError("no")
        return [x.upper() for x in prompts]

    assert sorted((r.q_id, r.answer, r.error) for r in retrieval.answer(p, generate, tries=2, delay=0).collect()) == [("a", "A", None), ("b", None, "no"), ("c", "C", None)]


@pytest.mark.parametrize("compress", [False, True])
def test_documents(spark, tmp_path, compress):
    d = spark.createDataFrame([("q2", None, [0.5]), ("q1", "ä \"", [])], "q_id string, answer string, scores array<double>")
    path = str(tmp_path / "out")
    sinks.write_document(d, path, {"run_id": "r", "api_url": "u"}, ["q_id"], compress)
    assert [(r.q_id, r.answer, r.scores) for r in sinks.read_document(spark, path, "q_id string, answer string, scores array<double>").collect()] == [("q1", "ä \"", []), ("q2", None, [0.5])]
    assert spark.read.text(path, wholetext=True).count() == 1 and spark.read.option("multiLine", True).json(path).first().meta.run_id == "r"
    sinks.write_document(d.limit(0), path, {}, ["q_id"])
    assert spark.read.option("multiLine", True).json(path).first().records == []


def test_judged_records_are_skipped(spark):
    rows = [("r", "q1", (0.5, None)), ("r", None, (1.0, 1.0)), ("r", "", (1.0, 1.0)), ("r", "q2", None)]
    d = spark.createDataFrame(rows, "run string, q_id string, metrics struct<faithfulness:double,answer_relevancy:double>")
    assert [tuple(r) for r in merge.judged_scores(d).collect()] == [("r", "q1", "faithfulness", 0.5)]


def test_texts_and_download(spark, tmp_path):
    d = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c")], "id string, text string")
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "old.txt").write_text("x")
    assert sinks.write_texts(d, str(folder), "id", wanted=["1", "2"]) == 2
    assert {p.name: p.read_text() for p in folder.iterdir() if p.suffix == ".txt"} == {"doc_1.txt": "a", "doc_2.txt": ""}
    with pytest.raises(RuntimeError, match="1 of 2"):
        sinks.write_texts(d, str(folder), "id", wanted=["1", "9"])
    (tmp_path / "sel.json").write_text(json.dumps({"dataset": "d", "split": "s", "revision": "v", "n": 1, "ids": ["1"]}))
    assert sinks.selection(spark, str(tmp_path / "sel.json"))["ids"] == ["1"]
    assert sinks.download("http://x", str(tmp_path / "raw.json"), fetch=lambda url, headers, timeout: {"a": "ä"}) == {"a": "ä"} == json.loads((tmp_path / "raw.json").read_text())

    def broken(url, headers, timeout):
        raise ValueError("not json")

    with pytest.raises(RuntimeError):
        sinks.download("http://x", str(tmp_path / "raw2.json"), fetch=broken)
