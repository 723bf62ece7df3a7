"""Measurement analytics: normalisation, markers, phases, interval join, per-window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CONTAINERS = ("app", "llm")
BYTE_UNITS = ("Bytes", "bytes", "Byte", "B")
CENTI_UNITS = ("centi°C", "centi_C")
#: metric, kind of aggregate, unit, output entities
SPECS = (
    ("cpu_energy_rapl_msr_component", "energy", "uJ", ("Package_0",)),
    ("memory_energy_rapl_msr_component", "energy", "uJ", ("DRAM_TOTAL",)),
    ("gpu_energy_nvidia_nvml_component", "energy", "uJ", ("GPU_TOTAL",)),
    ("psu_energy_ac_mcp_machine", "energy", "uJ", ("PSU_TOTAL",)),
    ("cpu_utilization_procfs_system", "gauge", "Ratio", ("[SYSTEM]",)),
    ("cpu_utilization_cgroup_container", "gauge", "Ratio", CONTAINERS),
    ("memory_used_cgroup_container", "gauge_bytes", "Bytes", CONTAINERS),
    ("network_io_cgroup_container", "sum_bytes", "Bytes", CONTAINERS),
    ("lmsensors_temperature_component", "gauge", "C", ("TEMP_CORE", "TEMP_PACK")),
)
MIB = 1048576.0
#: Windows up to this many are broadcast in interval_join; more are joined by time bucket.
BROADCAST_WINDOWS = 10_000


def spec_entities(spark: SparkSession) -> DataFrame:
    rows = [(m, kind, unit, e) for m, kind, unit, entities in SPECS for e in entities]
    return spark.createDataFrame(rows, "metric string, kind string, unit string, entity string")


def keep_rule() -> Column:
    """Whether the filter tool keeps a sample."""
    energy = F.col("metric").isin("cpu_energy_rapl_msr_component", "memory_energy_rapl_msr_component", "gpu_energy_nvidia_nvml_component") & (F.col("unit") == "uJ")
    load = (F.col("metric") == "cpu_utilization_cgroup_container") & (F.col("unit") == "Ratio") & F.col("entity").isin(*CONTAINERS)
    system = (F.col("metric") == "cpu_utilization_procfs_system") & (F.col("unit") == "Ratio") & (F.col("entity") == "[SYSTEM]")
    memory = (F.col("metric") == "memory_used_cgroup_container") & F.col("unit").isin(*BYTE_UNITS) & F.col("entity").isin(*CONTAINERS)
    return F.coalesce(energy | load | system | memory, F.lit(False))


def out_entity(ignored: bool = False) -> Column:
    """Entity that a sample counts for; null if for none (TEMP_IGNORED for other sensors, if asked for)."""
    m, u, e = F.col("metric"), F.col("unit"), F.col("entity")
    sensor = F.when(e.contains("_Core-"), "TEMP_CORE").when(e.contains("Package-id"), "TEMP_PACK")
    return (
        F.when((m == SPECS[0][0]) & (u == "uJ") & (e == "Package_0"), "Package_0")
        .when((m == SPECS[1][0]) & (u == "uJ") & e.startswith("DRAM"), "DRAM_TOTAL")
        .when((m == SPECS[2][0]) & (u == "uJ"), "GPU_TOTAL")
        .when((m == SPECS[3][0]) & (u == "uJ") & (e == "[MACHINE]"), "PSU_TOTAL")
        .when((m == SPECS[4][0]) & (u == "Ratio") & (e == "[SYSTEM]"), e)
        .when((m == SPECS[5][0]) & (u == "Ratio") & e.isin(*CONTAINERS), e)
        .when(m.isin(SPECS[6][0], SPECS[7][0]) & u.isin(*BYTE_UNITS) & e.isin(*CONTAINERS), e)
        .when((m == SPECS[8][0]) & u.isin(*CENTI_UNITS), sensor.otherwise("TEMP_IGNORED") if ignored else sensor)
    )


def normalise(samples: DataFrame) -> DataFrame:
    """(ts_us, metric, raw_entity, entity, value) of the samples that count."""
    value = F.when(F.col("metric") == SPECS[8][0], F.col("value") / 100.0).otherwise(F.col("value"))
    return samples.select("ts_us", "metric", F.col("entity").alias("raw_entity"), out_entity().alias("_e"), value.alias("value")).filter("_e is not null").withColumnRenamed("_e", "entity")


def entity_mappings(samples: DataFrame) -> DataFrame:
    """Raw entities behind each merged output entity, before any window is looked at."""
    out = samples.select(out_entity(True).alias("out_entity"), "entity").filter(F.col("out_entity").isin("DRAM_TOTAL", "GPU_TOTAL", "TEMP_CORE", "TEMP_PACK", "TEMP_IGNORED"))
    return out.groupBy("out_entity").agg(F.array_sort(F.collect_set("entity")).alias("raw_entities"))


def phases_to_windows(phases: DataFrame) -> DataFrame:
    """(name, kind, start_us, end_us, duration_s) of phases with a name that aren't hidden."""
    shown = phases.filter(~F.coalesce("hidden", F.lit(False)) & (F.coalesce("name", F.lit("")) != ""))
    kind = F.when(F.col("name").startswith("[") & F.col("name").endswith("]"), "gmt_phase").otherwise("workflow_step")
    return shown.select("name", kind.alias("kind"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"))


def parse_markers(lines: DataFrame, line: str = "line", prefix: str = "##MARK##") -> DataFrame:
    """(ts_us, event, meta) of lines with the last prefix followed by ts_us=, event= and key=value words."""
    rx = rf"^.*{prefix}\s+ts_us=(\d+)\s+event=([A-Z0-9_]+)(.*)$"
    words = F.filter(F.split(F.trim(F.regexp_extract(line, rx, 3)), r"\s+"), lambda w: w.contains("="))
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, r"^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return lines.filter(F.col(line).rlike(rx)).select(F.regexp_extract(line, rx, 1).cast("long").alias("ts_us"), F.regexp_extract(line, rx, 2).alias("event"), F.map_from_entries(last).alias("meta"))


def pair_markers(markers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, start_us, end_us: every END with the latest START of its key just before it, if that lies earlier in time."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = markers.withColumn("_k", F.lag("mark").over(w)).withColumn("start_us", F.lag("ts_us").over(w))
    return seen.filter((F.col("mark") == "END") & (F.col("_k") == "START") & (F.col("ts_us") > F.col("start_us"))).select(*keys, "start_us", F.col("ts_us").alias("end_us"))


def marker_bases(markers: DataFrame, parent: str, keyed: bool = False) -> DataFrame:
    """(name, ts_us, mark): markers whose event ends in _START or _END, named <parent>/<rest of the event>.

    keyed tells RETRIEVAL markers apart by their q_id, `unknown` without one.
    """
    parts = markers.select("ts_us", F.regexp_extract("event", "^(.*)_(START|END)$", 1).alias("base"), F.regexp_extract("event", "^(.*)_(START|END)$", 2).alias("mark"), F.try_element_at("meta", F.lit("q_id")).alias("q")).filter("mark <> ''")
    name = F.concat(F.lit(f"{parent}/"), "base")
    if keyed:
        name = F.when(F.col("base") == "RETRIEVAL", F.concat(name, F.lit("/"), F.coalesce("q", F.lit("unknown")))).otherwise(name)
    return parts.select(name.alias("name"), "ts_us", "mark")


def sub_windows(markers: DataFrame, parent: str, keyed: bool = False) -> DataFrame:
    """Windows (name, kind, start_us, end_us, duration_s) between the START and END markers of a log."""
    # of equal times the START comes first
    pairs = pair_markers(marker_bases(markers, parent, keyed).withColumn("_o", F.col("mark") == "END"), ["name"], ["ts_us", "_o"])
    return pairs.select("name", F.lit("sub_window").alias("kind"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"))


def interval_join(samples: DataFrame, windows: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """samples with every window that holds start_us <= ts_us < end_us.

    Few windows, by count, are broadcast; otherwise (or with bucket_us) windows are spread over time buckets and joined
    on them, so that each sample meets only the windows near it.
    """
    if bucket_us is None and windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        return samples.join(F.broadcast(windows), (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us")))
    size = bucket_us or 3_600_000_000
    spread = windows.filter("end_us > start_us").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / size), F.floor((F.col("end_us") - 1) / size))))
    return samples.withColumn("_b", F.floor(F.col("ts_us") / size)).join(spread, "_b").filter((F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us"))).drop("_b")


def aggregate(joined: DataFrame) -> DataFrame:
    """(window, metric, entity, sum_value, n, max_value); maxima are not kept for energy. Windows of one name share a bucket."""
    top = F.max(F.when(~F.col("metric").isin(*[s[0] for s in SPECS if s[1] == "energy"]), F.col("value")))
    return joined.groupBy(F.col("name").alias("window"), "metric", "entity").agg(F.sum("value").alias("sum_value"), F.count("*").alias("n"), top.alias("max_value"))


def finalise(buckets: DataFrame, spec: DataFrame) -> DataFrame:
    """Statistics by the metric's kind; those that a kind doesn't have are null."""
    b = buckets.join(F.broadcast(spec.select("metric", "kind", "unit").distinct()), "metric")
    k, mean = F.col("kind"), F.col("sum_value") / F.col("n")
    return b.select(
        "window", "metric", "entity", "unit", F.when(k.isin("energy", "sum_bytes"), F.col("sum_value")).alias("sum"), F.when(k == "energy", F.col("sum_value") / 3.6e9).alias("sum_wh"),
        F.when(k == "sum_bytes", F.col("sum_value") / MIB).alias("sum_mib"), F.when(k.isin("gauge", "gauge_bytes"), mean).alias("mean"), F.when(k == "gauge_bytes", mean / MIB).alias("mean_mib"), F.when(k != "energy", F.col("max_value")).alias("max"), F.col("n").alias("count"),
    )


def densify(final: DataFrame, windows: DataFrame, spec: DataFrame) -> DataFrame:
    """A row for each window name, metric and declared entity; count 0 and null statistics where nothing was measured."""
    grid = windows.select(F.col("name").alias("window")).distinct().crossJoin(F.broadcast(spec.select("metric", "entity", "unit")))
    return grid.join(final.drop("unit"), ["window", "metric", "entity"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
