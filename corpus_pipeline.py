"""A corpus pipeline over `documents`: drop toxic texts, texts of no language, near copies and benchmark passages; pack the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import decontam, langid, packing, simhash, toxicity
from sextant.llm.common import materialise, table
from sextant.llm.queries import LOSS_TOKENS, tokenizer_path
from sextant.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the classifier, fitted on the labelled among them, doesn't call toxic.

    Null and empty texts are scored as texts without words; repeated rows are judged alike; without labels of both kinds,
    or without rows, all rows stay. Columns stay as they are, whatever their names.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that can be told: null and letterless texts go, and those no nearer to any profile than chance.

    Profiles are fitted on the rows with a lang; without any, every text with a letter stays. Repeated rows are judged
    alike; columns stay as they are, whatever their names; an empty table stays empty.
    """
    ship(spark)
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Rows that repeat a doc_id are one document; rows with a null doc_id all stay; null, empty and wordless texts are
    copies of each other. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    ship(spark)
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without those that hold windows of two or more benchmark items; spans of single items are cut from the text.

    Null texts and rows with a null doc_id stay as they are; rows that repeat a doc_id go together; an empty benchmark
    changes nothing. Columns stay as they are, whatever their names; n_chars follows the text.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 4,096 tokens; a document's first line is its prompt and bears no loss.

    Null and empty texts are the end token alone; repeated rows are packed as often as they occur, null ids stay null;
    an empty table gives no pieces. Columns other than doc_id and text are ignored.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path(), loss=LOSS_TOKENS, prompt=packing.first_line())


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: Trained classifiers and packing have no SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
