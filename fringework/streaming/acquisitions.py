"""Acquisitions as a stream: each one pairs with the one before it on its frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "frame long, ref_time timestamp, sec_time timestamp, seconds double"


def _paired(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    times = sorted(t for f in frames for t in f["time"].dropna().unique())
    rows = []
    for t in times:
        now = pd.Timestamp(t)
        if last is not None and now <= pd.Timestamp(last):
            continue  # late or repeated: its place in the sequence has passed
        if last is not None:
            rows.append((key[0], pd.Timestamp(last), now, (now - pd.Timestamp(last)).total_seconds()))
        last = now
    if last is not None:
        state.update((pd.Timestamp(last).to_pydatetime(),))
    yield pd.DataFrame(rows, columns=["frame", "ref_time", "sec_time", "seconds"])


def sequential_pairs(stream: DataFrame) -> DataFrame:
    """(frame, ref_time, sec_time, seconds) for a stream of (frame, time); the state of a frame is its last time."""
    return stream.select("frame", "time").groupBy("frame").applyInPandasWithState(_paired, OUTPUT, "last timestamp", "append", GroupStateTimeout.NoTimeout)
