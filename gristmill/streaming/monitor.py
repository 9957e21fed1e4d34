"""Warning episodes over a stream: the batch machine's rules, with state by entity and rule.

Late rows are bounded by a watermark; within a batch an entity's rows are put in time order.  State
is a handful of numbers, so a long-lived entity costs no more than a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "trues long, falses long, open boolean, ordinal long, notes long, emitted long, seen long"
_OUT = "entity string, rule_key string, time timestamp, kind string, episode_ordinal long, notification_ordinal long"


def advance(state: tuple | None, time: int, truth: bool | None, persistence: int, resolution: int, cooldown: int, interval: int | None) -> tuple[tuple, tuple[str, int, int] | None]:
    """One step of the warning machine on microseconds: the new state, and a notification or None."""
    trues, falses, is_open, ordinal, notes, emitted, seen = state or (0, 0, False, -1, 0, None, None)
    if seen is not None and interval is not None and time - seen > interval:
        return (0, 0, is_open, ordinal, notes, emitted, time), None
    trues = trues + 1 if truth is True else 0
    falses = falses + 1 if truth is False else 0
    note = None
    if truth and not is_open and trues >= persistence:
        is_open, ordinal, notes, emitted = True, ordinal + 1, 1, time
        note = ("episode_reopen" if ordinal else "episode_open", ordinal, 0)
    elif is_open and truth is False and falses >= resolution:
        is_open = False
    elif is_open and truth and time - emitted >= cooldown:
        note, notes, emitted = ("repeated", ordinal, notes), notes + 1, time
    return (trues, falses, is_open, ordinal, notes, emitted, time), note


def notifications_stream(matrix: DataFrame, *, entity: str, time: str, watermark: str = "1 day", interval_us: int | None = None) -> DataFrame:
    """Notifications from a streaming rule matrix (entity, time, rule_key, persistence, resolution, cooldown, truth)."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("time")
        held = state.get if state.exists else None
        out = []
        for at, truth, persistence, resolution, cooldown in zip(rows["time"], rows["truth"], rows["persistence"], rows["resolution"], rows["cooldown"], strict=True):
            us = at.value // 1000
            held, note = advance(held, us, None if pd.isna(truth) else bool(truth), int(persistence), int(resolution), int(cooldown), interval_us)
            if note:
                out.append((key[0], key[1], at, *note))
        state.update(held)
        yield pd.DataFrame(out, columns=["entity", "rule_key", "time", "kind", "episode_ordinal", "notification_ordinal"])

    ready = matrix.select(F.col(entity).cast("string").alias("entity"), "rule_key", F.col(time).cast("timestamp").alias("time"), "truth", "persistence", "resolution", "cooldown").withWatermark("time", watermark)
    return ready.groupBy("entity", "rule_key").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_rates(matrix: DataFrame, *, time: str, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Evaluations and hits by rule and tumbling window, for batch or stream; late rows within the watermark count."""
    rows = matrix.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", watermark) if rows.isStreaming else rows
    return rows.groupBy(F.window("_t", window).alias("window"), "rule_key").agg(F.count(F.lit(1)).alias("evaluations"), F.count_if("truth").alias("hits"))
