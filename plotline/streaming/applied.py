"""Which proposals are in effect, kept up as commands stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotline.session import ship

OUT = "proposal long, seq long, change string, count long"


def step(count: int, delta: int) -> tuple[int, str | None]:
    """The number of commands in effect after one more, and what changed for the proposal."""
    after = max(0, count + delta)
    if after == 0 and count > 0:
        return after, "undone"
    return after, "redone" if after > 0 and count == 0 else None


def applied_stream(log: DataFrame) -> DataFrame:
    """Changes of state of a streaming log (proposal, seq, delta); one number of state per proposal."""
    ship(log.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            count, change = step(count, int(row.delta))
            if change:
                out.append((key[0], row.seq, change, count))
        state.update((count,))
        yield pd.DataFrame(out, columns=["proposal", "seq", "change", "count"])

    return log.groupBy("proposal").applyInPandasWithState(run, OUT, "count long", "append", GroupStateTimeout.NoTimeout)
