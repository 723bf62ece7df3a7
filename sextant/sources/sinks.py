"""Whole documents as files: answers, scores and summaries in one JSON, a text file for each row, raw downloads."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .http import fetch_json


def write_document(records: DataFrame, path: str, meta: dict, order: list[str], compress: bool = False, rows: str = "records") -> None:
    """One JSON document {"meta": meta, rows: [...]} of the records in order, as the only part of folder path.

    One task writes, since it is one file; it streams, so that memory doesn't grow with the records.
    """
    head, mid = json.dumps(meta, ensure_ascii=False, separators=(",", ":")), json.dumps(rows)
    each = records.select(F.lit(1).alias("_g"), F.struct(*order).alias("_o"), F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    # a row of its own for the head, so that there is a task to write it even without records
    top = records.sparkSession.range(1).select(F.lit(0).alias("_g"), F.lit(None).cast(each.schema["_o"].dataType).alias("_o"), F.lit(None).cast("string").alias("value"))
    lines = top.unionByName(each).orderBy("_g", "_o").select("value")

    def run(batches):
        seen = 0
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                out.append(f'{{"meta":{head},{mid}:[' if v is None else "," * (seen > 0) + v)
                seen += v is not None
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    lines.coalesce(1).mapInArrow(run, "value string").write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def read_document(spark: SparkSession, path: str, schema: str, rows: str = "records") -> DataFrame:
    """Records of documents of write_document, with the file each came from. schema is that of one record."""
    raw = spark.read.schema(f"`{rows}` array<struct<{schema}>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.select(F.input_file_name().alias("file"), F.explode(rows).alias("r")).select("file", "r.*")


def write_texts(docs: DataFrame, folder: str, key: str, text: str = "text", prefix: str = "doc_", wanted: Iterable | None = None) -> int:
    """A file <prefix><key>.txt for each row of docs, after the .txt files there are gone; returns how many.

    Executors write, so folder must be one that they share. With `wanted`, missing ids raise.
    """
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    where.create_dir(root)
    for f in where.get_file_info(fs.FileSelector(root)):
        if f.path.endswith(".txt"):
            where.delete_file(f.path)

    def run(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with where.open_output_stream(posixpath.join(root, f"{prefix}{k}.txt")) as out:
                    out.write((t or "").encode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["k"])

    if wanted is not None:
        ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], f"k {dict(docs.dtypes)[key]}").distinct()
        lost = ids.join(docs.select(F.col(key).alias("k")), "k", "left_anti").count()
        docs = docs.join(ids.withColumnRenamed("k", key), key, "left_semi")
    done = docs.select(F.col(key).cast("string").alias("k"), text).mapInArrow(run, "k string").count()
    if wanted is not None and lost:
        raise RuntimeError(f"{lost} of {ids.count()} documents are missing")
    return done


def selection(spark: SparkSession, path: str) -> dict:
    """A dataset selection file: dataset, split, revision, n, ids."""
    raw = spark.read.schema("dataset string, split string, revision string, n int, ids array<string>").option("multiLine", True).json(path).first()
    return raw.asDict()


def download(url: str, path: str, headers: dict[str, str] | None = None, timeout: float = 600, fetch: Callable = fetch_json) -> dict:
    """Fetch a JSON document and keep it as a file; raises RuntimeError where the answer isn't JSON."""
    try:
        found = fetch(url, headers, timeout=timeout)
    except ValueError as e:
        raise RuntimeError(f"no JSON from {url}") from e
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False)
    return found
