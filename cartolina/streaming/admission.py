"""An admission gate as a stateful operator: a bound on active jobs, and on starts within a window that begins with a call."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETRY_BUSY_S = 15
OUT = "gate string, seq long, status int, retry_s int"
STATE = "active long, starts long, since long"


def decide(state: tuple[int, int, int | None], now_ms: int, event: str, most_active: int, most_starts: int, window_ms: int) -> tuple[tuple[int, int, int | None], int, int | None]:
    """The state after an event, and its answer: 200, 503 if too many jobs run, 429 if too many began. A start beyond the window opens a new one, even if it is refused."""
    active, starts, since = state
    if event == "release":
        if not active:
            raise ValueError("released more often than admitted")
        return (active - 1, starts, since), 200, None
    if since is None or now_ms - since >= window_ms:
        starts, since = 0, now_ms
    if active >= most_active:
        return (active, starts, since), 503, RETRY_BUSY_S
    if starts >= most_starts:
        return (active, starts, since), 429, max(1, math.ceil((since + window_ms - now_ms) / 1000))
    return (active + 1, starts + 1, since), 200, None


def admissions(events: DataFrame, most_active: int, most_starts: int, window_ms: int) -> DataFrame:
    """gate, seq, status, retry_s for each event (gate, seq, now_ms, event: start or release), by gate in the order of seq.

    On a stream the state outlives batches; on a table each gate is one group. Decisions of a gate depend on all before.
    """
    if events.isStreaming:

        def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            state = held.get if held.exists else (0, 0, -1)
            now = (state[0], state[1], None if state[2] < 0 else state[2])
            for batch in batches:
                out, now = _decided(key[0], batch, now, most_active, most_starts, window_ms)
                yield out
            held.update((now[0], now[1], -1 if now[2] is None else now[2]))

        return events.groupBy("gate").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def whole(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        return _decided(key[0], batch, (0, 0, None), most_active, most_starts, window_ms)[0]

    return events.groupBy("gate").applyInPandas(whole, OUT)


def _decided(gate: str, batch: pd.DataFrame, state: tuple, most_active: int, most_starts: int, window_ms: int) -> tuple[pd.DataFrame, tuple]:
    rows = []
    for r in batch.sort_values("seq").itertuples():
        state, status, retry = decide(state, int(r.now_ms), r.event, most_active, most_starts, window_ms)
        rows.append((gate, int(r.seq), status, retry))
    out = pd.DataFrame(rows, columns=["gate", "seq", "status", "retry_s"])
    return out.astype({"retry_s": "Int32"}), state
