"""A growing log as a stream: a transaction's entries come out together once its commit has been read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "log string, txn long, at long, entry string"
STATE = "txn long, dead boolean, at array<long>, entry array<string>"


def committed_stream(stream: DataFrame) -> DataFrame:
    """stream: log string, at long, entry string, kind string (entry, commit, damaged), in any number of logs.

    State is kept by log: the number of the open transaction, its entries, and whether damage ended the log.  A commit
    sends its transaction out once; entries after damage are never sent.  Within a batch entries go by `at`; a log's
    batches must come in order, as an append-only file gives them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        txn, dead, at, entry = state.get if state.exists else (1, False, [], [])
        at, entry, out = list(at), list(entry), []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for a, e, kind in zip(rows["at"], rows["entry"], rows["kind"], strict=True):
            if dead:
                break
            if kind == "damaged":
                dead, at, entry = True, [], []
            elif kind == "commit":
                out += [(key[0], txn, x, y) for x, y in zip([*at, a], [*entry, e], strict=True)]
                txn, at, entry = txn + 1, [], []
            else:
                at.append(a)
                entry.append(e)
        state.update((txn, dead, at, entry))
        yield pd.DataFrame(out, columns=["log", "txn", "at", "entry"])

    return stream.groupBy("log").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
