"""What several operators of this package share: tables, scratch tables, bounded samples and id filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of Python objects that a worker holds at once, cut from larger Arrow batches.
SLICE_ROWS = 256
#: Ids up to this many are broadcast in filter_ids (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Local masters without one get a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sextant-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    atexit.register(_delete, spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended before; its folder goes with it
        pass


def release(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing will read again."""
    _delete(df.sparkSession, df._scratch_path)  # type: ignore[attr-defined]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row. The optimizer merges projections and would otherwise compute a column again for each element of a lambda that mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. Null ids fall in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0))


#: What worker processes remember from task to task, by operator: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str) -> None:
    """Drop what other operators remember in this worker process, so that only one holds a cache at a time."""
    for name, clear in CACHES.items():
        if name != owner:
            clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, owner: str = "") -> Iterator[pa.RecordBatch]:
    claim(owner)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def is_at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows; reads no more than it must to tell."""
    return df.limit(bound + 1).count() <= bound


def filter_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", bound: int = BROADCAST_IDS) -> DataFrame:
    """left_semi or left_anti of docs against one column of ids, broadcast only if counted at or under bound.

    ids should be cheap to read twice, such as a table of materialise().
    """
    return docs.join(F.broadcast(ids) if is_at_most(ids, bound) else ids, key, how)


def keep_rows(docs: DataFrame, keep: Callable[[], Callable[[list[str | None]], list[bool]]], rows: int = 128) -> DataFrame:
    """Rows of docs whose text passes. keep() is called once for each task and gives the function of a list of texts. No shuffle; columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for b in slices(batches, rows):
            yield b.filter(pa.array(passes(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Longer texts (in UTF-8 bytes) aren't learned from, so that a sample of n texts is at most n times as large.
SAMPLE_BYTES = 65_536


def texts_of(docs: DataFrame, ids: list, extra: list[str] = (), most: int = SAMPLE_BYTES) -> list:
    """Rows (doc_id, text, ...) of a bounded list of ids with a text of at most `most` bytes, one row for each id: the smallest text if it repeats."""
    spark = docs.sparkSession
    if not ids:
        return []
    keys = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = docs.select("doc_id", "text", *extra).filter(F.octet_length("text") <= most).join(F.broadcast(keys), "doc_id").collect()
    best: dict = {}
    for r in rows:
        if r.doc_id not in best or (r.text or "") < (best[r.doc_id].text or ""):
            best[r.doc_id] = r
    return [best[i] for i in sorted(best)]
