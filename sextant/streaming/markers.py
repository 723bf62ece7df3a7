"""Marker lines of a stream, paired into windows while they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import marker_bases, parse_markers

PAIRS = "name string, start_us long, end_us long"


def pair(lines: DataFrame, parent: str, keyed: bool = False, line: str = "line", prefix: str = "##MARK##") -> DataFrame:
    """(name, start_us, end_us) of every END with the latest open START of its name, in append mode.

    The state of a name is the start that is still open, so it is as large as the number of open windows. Lines of one
    micro-batch are taken in order of their time.
    """
    marks = marker_bases(parse_markers(lines, line, prefix), parent, keyed)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_at = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts_us", "mark"], ascending=[True, False], kind="stable")
        for ts, mark in zip(rows["ts_us"].tolist(), rows["mark"].tolist()):
            if mark == "START":
                open_at = ts
            else:
                if open_at is not None and ts > open_at:
                    out.append((key[0], open_at, ts))
                open_at = None
        if open_at is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_at,))
        yield pd.DataFrame(out, columns=["name", "start_us", "end_us"])

    return marks.groupBy("name").applyInPandasWithState(step, PAIRS, "open_at long", "append", GroupStateTimeout.NoTimeout)
