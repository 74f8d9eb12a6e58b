"""Sessions over a stream of actions."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boardflow.operators.session import ACTIONS, RESULT, begun, columns, fold


def replay_stream(log: DataFrame, boards: DataFrame) -> DataFrame:
    """As ``operators.session.replay``, kept from batch to batch; rows of a batch are folded in order of seq."""
    actions = dict(ACTIONS)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        # what this function itself has written to the state store
        s = pickle.loads(state.get[0]) if state.exists else begun(rows.iloc[0])
        yield pd.DataFrame(fold(rows, s, actions), columns=columns()).astype({"distance": "Int32"})
        state.update((pickle.dumps(s),))

    both = log.select("session_id", "seq", "action", "x", "y").join(boards, "session_id")
    return both.groupBy("session_id").applyInPandasWithState(step, RESULT, "session binary", "append", GroupStateTimeout.NoTimeout)
