"""Scores of answers by judges: functions of one record that may be slow, fail and be tried again."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.http import with_retries

#: metric, whether it needs contexts
METRICS = (("faithfulness", True), ("answer_relevancy", False), ("context_utilization", True))
_TOKEN = re.compile(r"\w+")


def _share(part: str, whole: str) -> float:
    asked = set(_TOKEN.findall(part.lower()))
    return round(len(asked & set(_TOKEN.findall(whole.lower()))) / len(asked), 6) if asked else 0.0


#: Stand-ins for judging models: shares of distinct words.
OVERLAP: dict[str, Callable[[str, str, list[str]], float]] = {
    "faithfulness": lambda question, answer, contexts: _share(answer, "\n".join(contexts)),
    "answer_relevancy": lambda question, answer, contexts: _share(question, answer),
    "context_utilization": lambda question, answer, contexts: _share("\n".join(contexts), answer),
}


def score(records: DataFrame, judges: dict[str, Callable] = OVERLAP, concurrency: int = 4, tries: int = 6, delay: float = 1.0) -> DataFrame:
    """records (question, answer, contexts and any others, carried through) with a double for each metric, and judge_error.

    A judge is a function of (question, answer, contexts). Those that need contexts aren't asked where there are none.
    A task asks for `concurrency` records at once; a call that fails is tried again after growing delays, and a record
    whose last try fails keeps null scores and gets the error, without an end of the run. Null questions and answers
    count as empty.
    """
    names = records.columns
    at = [names.index(c) for c in ("question", "answer", "contexts")]

    def one(record: tuple) -> tuple[list, str | None]:
        question, answer, contexts = record[0] or "", record[1] or "", [c or "" for c in record[2] or []]
        try:
            return [with_retries(lambda m=m: float(judges[m](question, answer, contexts)), tries, delay) if contexts or not needs else None for m, needs in METRICS], None
        except Exception as e:  # noqa: BLE001 - reported in the row
            return [None] * len(METRICS), f"{type(e).__name__}: {e}"

    def run(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                done = list(pool.map(one, zip(*(b.column(i).to_pylist() for i in at))))
                made = [pa.array([d[0][k] for d in done], pa.float64()) for k in range(len(METRICS))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made, pa.array([d[1] for d in done], pa.string())], [*names, *(m for m, _ in METRICS), "judge_error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields), *(f"{m} double" for m, _ in METRICS), "judge_error string"])
    return records.mapInArrow(run, schema)
