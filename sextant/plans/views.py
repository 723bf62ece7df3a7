"""The data model's inputs, derived from the driver tables: the same expressions as in SQL (see SQL_*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import SPECS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MD = """'# ' || source || chr(10) || substr(text, 1, 200) || chr(10) || '## Part ' || CAST(doc_id AS STRING) || chr(10) || substr(text, 201, 400) || chr(10) || '###### '
 || CASE doc_id % 6 WHEN 0 THEN 'Lemma 1.' WHEN 1 THEN '(Proof)' WHEN 2 THEN 'Remarks on it' WHEN 3 THEN '3.1 Setup' WHEN 4 THEN 'Contents' ELSE 'Foo' END || chr(10) || substr(text, 601)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document with headings put in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD).alias("text"))


_METRIC = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(SPECS)) + " END"
_ENTITY = """CASE event_id % 9 WHEN 0 THEN 'Package_' || CAST(user_id % 2 AS {s}) WHEN 1 THEN 'DRAM_' || CAST(user_id % 2 AS {s}) WHEN 2 THEN 'GPU-' || CAST(user_id % 3 AS {s})
 WHEN 3 THEN '[MACHINE]' WHEN 4 THEN '[SYSTEM]' WHEN 8 THEN CASE user_id % 3 WHEN 0 THEN 'coretemp_Core-1' WHEN 1 THEN 'coretemp_Package-id-0' ELSE 'nvme' END
 ELSE CASE user_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'llm' ELSE 'db' END END"""
_UNIT = "CASE WHEN event_id % 11 = 7 THEN 'other' WHEN event_id % 9 <= 3 THEN 'uJ' WHEN event_id % 9 <= 5 THEN 'Ratio' WHEN event_id % 9 = 8 THEN 'centi°C' WHEN event_id % 2 = 0 THEN 'Bytes' ELSE 'B' END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ts_us, metric, value, unit, event_id) of every event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(_ENTITY.format(s="STRING")).alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.expr(_METRIC).alias("metric"), "value", F.expr(_UNIT).alias("unit"), "event_id")


_DAY, _ZERO = 86_400_000_000, 1_704_067_200_000_000
#: name, hidden, first day, last day of January 2024 (exclusive)
PHASES = (
    ("[RUNTIME]", False, 0, 31), ("Indexing", False, 4, 14), ("Indexing/CHUNKING", False, 4, 7), ("Indexing/EMBEDDING", None, 6, 11), ("Load", False, 15, 17), ("Load", False, 19, 21),
    ("Empty", False, 9, 9), ("Before", False, -20, -10), ("Secret", True, 0, 31), (None, False, 0, 31), ("", False, 0, 31),
)


def phases(spark: SparkSession) -> DataFrame:
    rows = [(n, h, _ZERO + a * _DAY, _ZERO + b * _DAY) for n, h, a, b in PHASES]
    return spark.createDataFrame(rows, "name string, hidden boolean, start_us long, end_us long")


def _lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()


SQL_MD = f"md AS (SELECT doc_id, {_MD.replace('AS STRING', 'AS VARCHAR')} AS text FROM documents)"
SQL_SAMPLES = f"samples AS (SELECT {_ENTITY.format(s='VARCHAR')} AS entity, epoch_us(ts)::BIGINT AS ts_us, {_METRIC} AS metric, value, {_UNIT} AS unit, event_id FROM events)"
SQL_PHASES = "phases AS (SELECT * FROM (VALUES " + ", ".join(f"({_lit(n)}, {_lit(h)}, {_ZERO + a * _DAY}::BIGINT, {_ZERO + b * _DAY}::BIGINT)" for n, h, a, b in PHASES) + ") t(name, hidden, start_us, end_us))"
SQL_WINDOWS = SQL_PHASES + """, windows AS (SELECT name, CASE WHEN name LIKE '[%' AND name LIKE '%]' THEN 'gmt_phase' ELSE 'workflow_step' END AS kind, start_us, end_us, (end_us - start_us) / 1e6 AS duration_s
 FROM phases WHERE NOT coalesce(hidden, false) AND coalesce(name, '') <> '')"""
SQL_NORMAL = SQL_SAMPLES + f""", marked AS (SELECT *, CASE
 WHEN metric = '{SPECS[0][0]}' AND unit = 'uJ' AND entity = 'Package_0' THEN 'Package_0' WHEN metric = '{SPECS[1][0]}' AND unit = 'uJ' AND entity LIKE 'DRAM%' THEN 'DRAM_TOTAL'
 WHEN metric = '{SPECS[2][0]}' AND unit = 'uJ' THEN 'GPU_TOTAL' WHEN metric = '{SPECS[3][0]}' AND unit = 'uJ' AND entity = '[MACHINE]' THEN 'PSU_TOTAL'
 WHEN metric = '{SPECS[4][0]}' AND unit = 'Ratio' AND entity = '[SYSTEM]' THEN entity WHEN metric = '{SPECS[5][0]}' AND unit = 'Ratio' AND entity IN ('app', 'llm') THEN entity
 WHEN metric IN ('{SPECS[6][0]}', '{SPECS[7][0]}') AND unit IN ('Bytes', 'bytes', 'Byte', 'B') AND entity IN ('app', 'llm') THEN entity
 WHEN metric = '{SPECS[8][0]}' AND unit IN ('centi°C', 'centi_C') THEN CASE WHEN entity LIKE '%\\_Core-%' ESCAPE '\\' THEN 'TEMP_CORE' WHEN entity LIKE '%Package-id%' THEN 'TEMP_PACK' ELSE 'TEMP_IGNORED' END END AS out_entity FROM samples),
normal AS (SELECT ts_us, metric, entity AS raw_entity, out_entity AS entity, CASE WHEN metric = '{SPECS[8][0]}' THEN value / 100.0 ELSE value END AS value FROM marked WHERE out_entity IS NOT NULL AND out_entity <> 'TEMP_IGNORED')"""
_KINDS = ", ".join(f"('{m}', '{k}', '{u}', '{e}')" for m, k, u, es in SPECS for e in es)
SQL_BUCKETS = f"""{SQL_NORMAL}, {SQL_WINDOWS}, spec AS (SELECT * FROM (VALUES {_KINDS}) t(metric, kind, unit, entity)),
hits AS (SELECT n.*, w.name FROM normal n JOIN windows w ON n.ts_us >= w.start_us AND n.ts_us < w.end_us),
buckets AS (SELECT name AS "window", metric, entity, sum(value) AS sum_value, count(*)::BIGINT AS n, max(CASE WHEN metric LIKE '%energy%' THEN NULL ELSE value END) AS max_value FROM hits GROUP BY ALL),
final AS (SELECT "window", b.metric, b.entity, unit, CASE WHEN kind IN ('energy', 'sum_bytes') THEN sum_value END AS "sum", CASE WHEN kind = 'energy' THEN sum_value / 3.6e9 END AS sum_wh,
 CASE WHEN kind = 'sum_bytes' THEN sum_value / 1048576.0 END AS sum_mib, CASE WHEN kind IN ('gauge', 'gauge_bytes') THEN sum_value / n END AS mean, CASE WHEN kind = 'gauge_bytes' THEN sum_value / n / 1048576.0 END AS mean_mib,
 CASE WHEN kind <> 'energy' THEN max_value END AS "max", n AS "count" FROM buckets b JOIN (SELECT DISTINCT metric, kind, unit FROM spec) s USING (metric))"""
