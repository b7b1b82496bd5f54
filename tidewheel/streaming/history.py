"""A user's latest events as keyed state of a stream; the batch form is :func:`tidewheel.operators.sequence.latest_history`."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_KEPT = "ts array<timestamp>, item array<bigint>, events bigint"
OUT = "user_id bigint, events bigint, items array<bigint>"


class LatestHistory(StatefulProcessor):
    """Keeps the last ``n`` items of every user by (time, item), newest first, and how many events there were.

    What is kept of a set of events doesn't depend on the order in which they come, so a late row takes its place, or none if ``n`` later ones are known. A user without
    an event for ``ttl_ms`` of processing time is forgotten (0: never).
    """

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", _KEPT, self.ttl_ms or None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.kept.get() if self.kept.exists() else None
        parts, events = [pd.DataFrame({"ts": list(old[0]), "item_id": list(old[1])})] if old else [], old[2] if old else 0
        for pdf in rows:
            events += len(pdf)
            parts.append(pdf[["ts", "item_id"]])
        now = pd.concat(parts).sort_values(["ts", "item_id"], ascending=False).head(self.n)
        ts, items = [x.to_pydatetime() for x in pd.to_datetime(now["ts"])], [int(i) for i in now["item_id"]]
        self.kept.update((ts, items, events))
        yield pd.DataFrame({"user_id": [key[0]], "events": [events], "items": [items]})

    def close(self) -> None:
        pass


def latest_history(events: DataFrame, n: int = 50, ttl_ms: int = 0) -> DataFrame:
    """A stream of ``user_id, events, items`` for the users of each batch of the stream ``events(user_id, item_id, ts)``, in update mode.

    The session's state store must be the RocksDB one. State and offsets are in the query's checkpoint, so a restart goes on where it was.
    """
    rows = events.selectExpr("cast(user_id as bigint) user_id", "cast(item_id as bigint) item_id", "cast(ts as timestamp) ts").where("user_id is not null and ts is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(LatestHistory(n, ttl_ms), OUT, "Update", "ProcessingTime")
