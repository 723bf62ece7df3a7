"""Readers and writers of the data model's files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_blank

MEASUREMENTS = "success boolean, data array<array<string>>"
PHASES = "data struct<id:string,name:string,failed:boolean,warnings:array<string>,phases:array<struct<name:string,start:bigint,end:bigint,hidden:boolean>>,logs:map<string,array<struct<cmd:string,stdout:string>>>>"


def decode_utf8(column: str, df: DataFrame, out: str = "text") -> DataFrame:
    """df with its binary column as text: invalid bytes are dropped, line ends become line feeds. Nulls stay null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column) + f", `{out}` string"
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else x.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string())], [*rest, out])

    return df.mapInArrow(run, schema)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, type, text) of all .txt files below folder, whatever their suffix's case; blank files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = raw.filter(F.lower("path").endswith(".txt")).select(F.col("path").alias("source"), F.lit("txt").alias("type"), "content")
    return decode_utf8("content", found).filter(~is_blank(F.col("text")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("q_id string, question string, gold_doc string, ground_truth string").option("multiLine", True).json(path)


def samples_of(raw: DataFrame, data: str = "data") -> DataFrame:
    """(entity, ts_us, metric, value, unit) of arrays of five; entries of another length are skipped."""
    each = raw.select(F.explode(data).alias("d")).filter(F.size("d") == 5)
    return each.select(F.col("d")[0].alias("entity"), F.col("d")[1].cast("long").alias("ts_us"), F.col("d")[2].alias("metric"), F.col("d")[3].cast("double").alias("value"), F.col("d")[4].alias("unit"))


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """(entity, ts_us, metric, value, unit) of a file {"data": [[...], ...]} of any size.

    The text is cut after each array, wherever it stands in the file: records are as small as an entry, and large files
    are split over tasks. Entries of another length than five are skipped. Strings must not hold "],".
    """
    if not path.endswith(".json"):
        raise ValueError("measurement files end in .json")
    text = r'"(?:[^"\\]|\\.)*+"'
    entry = F.regexp_extract("value", rf'\[\s*((?:{text}|[^\[\]"\s])(?:{text}|[^\[\]"])*+)', 1)
    pieces = spark.read.option("lineSep", "],").text(path).select(entry.alias("entry")).filter("entry <> ''")
    return samples_of(pieces.select(F.array(F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), "array<string>")).alias("data")))


def phases(spark: SparkSession, path: str) -> DataFrame:
    """(run, name, start_us, end_us, hidden) of a phase file."""
    raw = spark.read.schema(PHASES).option("multiLine", True).json(path)
    each = raw.select(F.col("data.id").alias("run"), F.explode("data.phases").alias("p"))
    return each.select("run", F.col("p.name").alias("name"), F.col("p.start").alias("start_us"), F.col("p.end").alias("end_us"), F.col("p.hidden").alias("hidden"))


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """(run, container, at, cmd, stdout) of the logs in a phase file, at counting a container's entries."""
    raw = spark.read.schema(PHASES).option("multiLine", True).json(path).select(F.col("data.id").alias("run"), F.explode("data.logs").alias("container", "entries"))
    return raw.select("run", "container", F.posexplode("entries").alias("at", "e")).select("run", "container", "at", "e.cmd", "e.stdout")


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """Fields of the run of a phase file, the number of its warnings and the date in front of the file's name (else today's)."""
    fields = ("id", "name", "uri", "branch", "commit_hash", "filename", "machine_id", "gmt_hash", "created_at", "failed", "start_measurement", "end_measurement", "usage_scenario_variables")
    schema = "data struct<" + ",".join(f"{f}:{'boolean' if f == 'failed' else 'string'}" for f in fields) + ",warnings:array<string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(*[F.col(f"data.{f}").alias(f) for f in fields], F.size(F.coalesce("data.warnings", F.array())).alias("warnings"), date_prefix(F.input_file_name()).alias("date"))


def date_prefix(path: Column) -> Column:
    """The date before the first underscore of a path's last part; today's where there is none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_extract(name, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:_|$)", 1), F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), F.date_format(F.current_date(), "yyyy-MM-dd"))


def run_file(folder: str, run_id: str, kind: str) -> str:
    """Path of the first file *<run_id>_<kind>.json below folder; raises FileNotFoundError."""
    found = sorted(str(p) for p in Path(folder).rglob(f"*{run_id}_{kind}.json"))
    if not found:
        raise FileNotFoundError(f"no {kind} of run {run_id} below {folder}")
    return found[0]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """All gzip JSON records below folder, with the file each came from."""
    return spark.read.option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", True).json(folder).withColumn("file", F.input_file_name())


def select_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def missing_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(rows, key, "left_anti")


def pick_log(logs: DataFrame, key: str, order: str, cmd: str, stdout: str, needle: str) -> DataFrame:
    """(key, stdout) of the first entry of each key whose command contains needle."""
    hits = logs.filter(F.contains(F.coalesce(cmd, F.lit("")), F.lit(needle)))
    return hits.groupBy(key).agg(F.min_by(F.struct(F.col(stdout).alias("s")), F.struct(order, stdout)).alias("x")).select(key, F.col("x.s").alias(stdout))


def write_index(index: DataFrame, path: str, reset: bool = False) -> None:
    """Append rows whose chunk_id isn't stored yet, or start over. Rows that repeat a chunk_id are stored once."""
    spark = index.sparkSession
    index = index.dropDuplicates(["chunk_id"])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if reset or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        index.write.mode("overwrite").parquet(path)
        return
    known = spark.read.parquet(path).select("chunk_id")
    index.join(known, "chunk_id", "left_anti").write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def write_merged(run_rows: DataFrame, path: str) -> None:
    """One gzip JSON document: long-form rows (window, metric, entity, ...) as nested records."""
    stats = [c for c in run_rows.columns if c not in ("window", "metric", "entity", "unit")]
    entity = run_rows.groupBy("window", "metric", "unit").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", F.struct(*stats))))).alias("entities"))
    window = entity.groupBy("window").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("unit", F.map_keys("entities").alias("names"), F.map_values("entities").alias("stats")))))).alias("metrics"))
    window.select(F.to_json(F.struct("window", "metrics")).alias("value")).coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)
