"""Listeners of streams, and diagnostics of changed files."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.store import Store
from .incremental import last_state

LOG = logging.getLogger(__name__)


class Listeners(StreamingQueryListener):
    """Several listeners an event, called in the order of their subscription; one that fails is logged, and the
    others are called all the same. `spark.streams.addListener(listeners)` makes it hear a session's streams; other
    events are published by whoever has them."""

    STREAM = ("started", "progress", "idle", "terminated")

    def __init__(self) -> None:
        self._heard: dict[str, list[list[Callable]]] = defaultdict(list)

    def subscribe(self, event: str, listener: Callable) -> Callable[[], None]:
        """Returns what ends the subscription."""
        if not callable(listener):
            raise TypeError("a listener is a callable")
        entry = [listener]  # subscribing twice is two subscriptions
        self._heard[event].append(entry)

        def end() -> None:
            self._heard[event] = [x for x in self._heard[event] if x is not entry]

        return end

    def count(self, event: str) -> int:
        return len(self._heard.get(event, ()))

    def publish(self, event: str, *values: object) -> int:
        """The number of listeners that failed."""
        failed = 0
        for (listener,) in tuple(self._heard.get(event, ())):
            try:
                listener(*values)
            except Exception:
                failed += 1
                LOG.exception("a listener of %s failed", event)
        return failed

    def onQueryStarted(self, event) -> None:
        self.publish("started", event)

    def onQueryProgress(self, event) -> None:
        self.publish("progress", event)

    def onQueryIdle(self, event) -> None:
        self.publish("idle", event)

    def onQueryTerminated(self, event) -> None:
        self.publish("terminated", event)


class Diagnoser:
    """X11: keeps the table `diagnostics` (file, ...) up to date with changed files.

    check(paths) gives the diagnostics, with a column file, of the files in a DataFrame of `at_once` partitions, which is
    how many run side by side. A file that changes several times in a batch is checked once, one that is deleted loses
    its diagnostics, and what a batch finds takes the place of all that was known of its files. The stream's trigger is
    the debouncing, and a batch isn't begun before the one before it has ended, so nothing queues up.
    """

    def __init__(self, store: Store, check: Callable[[DataFrame], DataFrame], at_once: int = 4) -> None:
        self.store, self.check, self.at_once = store, check, at_once

    def apply(self, batch: DataFrame) -> None:
        state = last_state(batch).persist()
        if not state.isEmpty():
            paths = state.filter("op <> 'delete'").select("path").repartition(self.at_once, "path")
            found = self.check(paths)
            self.store.upsert("diagnostics", found, ["file"], deleted=state.select(F.col("path").alias("file")))
        state.unpersist()

    def start(self, change_events: DataFrame, checkpoint: str, every: str = "1 second", **trigger) -> StreamingQuery:
        out = change_events.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"processingTime": every})).start()
