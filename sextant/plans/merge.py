"""Whole jobs over runs: measurements of a run merged with its phases and markers; statistics over merged runs and judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import summary, windows
from ..sources import readers

PHASES = ("[INSTALLATION]", "[RUNTIME]", "Download Dataset", "Indexing", "Indexing/CHUNKING", "Indexing/EMBEDDING", "Indexing/PERSIST_IN_DB", "RAG Querries")


def merge_run(spark: SparkSession, phase_path: str, measurement_path: str, logs: dict[str, tuple[str, bool]] | None = None, container: str = "app", prefix: str = "##MARK##") -> dict[str, DataFrame]:
    """windows, records, markers, mappings and counters of one run.

    logs: command (a part of it) in the container's log -> (parent window, whether its markers are told apart by q_id);
    the first log entry of a command counts, and its markers give sub-windows. records is dense: every window name, with
    count 0 where nothing was measured.
    """
    all_windows = windows.phases_to_windows(readers.phases(spark, phase_path))
    entries = readers.log_entries(spark, phase_path).filter(F.col("container") == container)
    markers = None
    for cmd, (parent, keyed) in (logs or {}).items():
        lines = readers.pick_log(entries, "run", "at", "cmd", "stdout", cmd).select(F.explode(F.split("stdout", "\n")).alias("line"))
        found = windows.parse_markers(lines, prefix=prefix)
        all_windows = all_windows.unionByName(windows.sub_windows(found, parent, keyed))
        found = found.select(F.lit(parent).alias("parent"), "ts_us", "event", "meta")
        markers = found if markers is None else markers.unionByName(found)
    samples = readers.measurements(spark, measurement_path)
    joined = windows.interval_join(windows.normalise(samples), all_windows)
    spec = windows.spec_entities(spark)
    records = windows.densify(windows.finalise(windows.aggregate(joined), spec), all_windows, spec)
    counters = samples.agg(F.count("*").alias("total_rows_seen")).crossJoin(joined.agg(F.count("*").alias("updates_written")))
    return {"windows": all_windows, "records": records, "markers": markers, "mappings": windows.entity_mappings(samples), "counters": counters}


def summarise_runs(runs: DataFrame, value: str, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """(window, metric, entity, statistics over runs) of merged records (run, window, metric, entity, value ...) in the listed phases."""
    return summary.metric_summary(runs.filter(F.col("window").isin(*phases)), ["window", "metric", "entity"], value)


def judged_scores(records: DataFrame) -> DataFrame:
    """(run, q_id, metric, value) of judged records (run, q_id, metrics struct): those without q_id or metrics, and missing scores, are skipped."""
    metrics = [f.name for f in records.schema["metrics"].dataType.fields]
    each = records.filter((F.coalesce("q_id", F.lit("")) != "") & F.col("metrics").isNotNull())
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("metrics")[m].cast("double").alias("value")) for m in metrics])
    return each.select("run", "q_id", F.explode(pairs).alias("x")).select("run", "q_id", "x.*").filter("value is not null")
