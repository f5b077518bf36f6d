"""Streams of snapshots, sightings and events. Each job's output equals what a batch over all its input gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrace.operators.changes import change_set, latest, merged


def snapshot_changes(snapshots: DataFrame, store: str, log: str, key: str, fields: dict[str, Column], order: list[Column]) -> DataStreamWriter:
    """Compares each batch of a source's rows with what is stored, and stores it.

    Batch n writes its changes to log/batch=n and all rows to store/version=n, made of version n - 1; a batch that is run
    again writes the same. Of several rows of a key in a batch the first in order counts. Rows have `claimed`, an array.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, latest(batch, [key], order)
        old = spark.read.parquet(f"{store}/version={n - 1}") if n else new.limit(0)
        change_set(old, new, key, fields).write.mode("overwrite").parquet(f"{log}/batch={n}")
        kept = [c for c in new.columns if c not in (key, "claimed")]
        claims = old.select(key, "claimed").unionByName(new.join(old, key, "left_anti").select(key, "claimed"))
        merged(old, new, key, kept).join(claims, key).write.mode("overwrite").parquet(f"{store}/version={n}")

    return snapshots.writeStream.foreachBatch(step)


def first_shown(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """The first row that comes of each key; later ones change nothing."""
    return sightings.dropDuplicates(keys)


def to_ask(questions: DataFrame, hours: float) -> DataFrame:
    """key, at: questions (key, at) without an answer that holds, which are asked; an answer holds so long. Within a batch by time.

    State is dropped when its answer has expired for all that can still come, as the watermark tells.
    """
    span = int(hours * 3_600_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for at in sorted(pd.concat(list(frames))["at"]):
            now = int(at.timestamp() * 1000)
            if last is None or now - last >= span:
                last = now
                out.append((key[0], at))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at"])

    known = questions.withWatermark("at", f"{span} milliseconds")
    return known.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def is_new(shown_at: Column, now: Column, days: int = 7) -> Column:
    return shown_at > now - F.make_dt_interval(F.lit(days))


def released_withdrawals(events: DataFrame) -> DataFrame:
    """object_id, old_id, new_id: withdrawals wait, in order of their coming, until an arrival of their object is published.

    events: object_id, kind (withdrawn or published), id, at. A published arrival that finds nothing waiting is not kept.
    Within a batch events are taken in order of their time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for kind, i in zip(rows.kind, rows.id, strict=True):
            if kind == "withdrawn":
                waiting.append(int(i))
            elif waiting:
                out.append((key[0], waiting.pop(0), int(i)))
        if waiting:
            state.update((waiting,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["object_id", "old_id", "new_id"])

    return events.groupBy("object_id").applyInPandasWithState(step, "object_id long, old_id long, new_id long", "waiting array<long>", "append", GroupStateTimeout.NoTimeout)
