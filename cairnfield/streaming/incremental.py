"""Incremental maintenance from change events with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import dirname
from ..operators.graph import impact_radius
from ..sources.scan import excluded
from ..sources.store import Store

EVENT_SCHEMA = "ts timestamp, path string, op string"
#: Share of changed files above which a rebuild is cheaper (X6); batches between two compactions.
REBUILD_ABOVE, COMPACT_EVERY = 0.5, 32


def events(spark: SparkSession, folder: str, exclude: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Change events (op: upsert or delete) from files that arrive in a folder, without excluded paths."""
    raw = spark.readStream.schema(EVENT_SCHEMA).json(folder)
    return raw.filter(~excluded(F.col("path"), exclude)).withWatermark("ts", late)


def debounced(change_events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Bursts of events, each closed by a silence of `gap`: (first, last, events) a path."""
    return change_events.groupBy("path", F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("session_window")


def last_state(batch: DataFrame) -> DataFrame:
    """The last operation on each path of a batch: what X2's set of pending paths holds."""
    return batch.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))


def needs_rebuild(changed: int, files: int) -> bool:
    """X6."""
    return files == 0 or changed > REBUILD_ABOVE * files


class Maintainer:
    """Keeps the tables `records` (path, ...) and `edges` (source, target, ...) up to date.

    derive(paths) gives the records of files as they are now, for a DataFrame of paths; resolve(records, files) gives
    the edges that go out from records. A batch deletes first, then derives what changed, then resolves anew the
    changed files, those that import a changed or deleted one, those that import a file shadowed by a new one, and (X5)
    where imports of a package mean all its files, those that import a package with a new or deleted file.

    The two tables are written one after the other. A batch that ends in between is run again by the stream, from the
    records as they are then: deletions and derivations repeat with the same result, and edges follow. Tables that are
    there but can't be read are an error, never an empty state: a batch alone wouldn't rebuild them.
    """

    def __init__(self, store: Store, derive: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame, DataFrame], DataFrame], shadows: Callable[[DataFrame, DataFrame], DataFrame] | None = None, expand_packages: bool = False) -> None:
        self.store, self.derive, self.resolve, self.shadows, self.expand_packages = store, derive, resolve, shadows, expand_packages
        self.batches, self.rebuilds = 0, 0

    def rebuild(self, paths: DataFrame) -> None:
        records = self.derive(paths)
        self.store.replace("records", records, keys=["path"])
        records = self.store.read("records")
        self.store.replace("edges", self.resolve(records, records.select("path")), keys=["source"])
        self.rebuilds += 1

    def apply(self, batch: DataFrame) -> None:
        """One batch of events(ts, path, op); batches come one at a time."""
        state = last_state(batch).persist()
        records, edges = self.store.read("records"), self.store.read("edges")
        changed, total = state.count(), 0 if records is None else records.count()
        if changed:
            if records is None or needs_rebuild(changed, total):
                paths = state.filter("op <> 'delete'").select("path")
                if records is not None:
                    paths = records.select("path").join(state.select("path"), "path", "left_anti").union(paths)
                self.rebuild(paths.distinct())
            else:
                self._delta(state, records, edges)
        state.unpersist()
        self.batches += 1

    def _delta(self, state: DataFrame, records: DataFrame, edges: DataFrame) -> None:
        upserts = state.filter("op <> 'delete'").select("path")
        touched = state.select("path")
        new = upserts.join(records.select("path"), "path", "left_anti")
        near = edges.join(touched.withColumnRenamed("path", "target"), "target", "left_semi").select(F.col("source").alias("path"))
        if self.shadows is not None:
            lost = self.shadows(new, records.select("path")).select(F.col("shadows").alias("target"))
            near = near.union(edges.join(lost, "target", "left_semi").select(F.col("source").alias("path")))
        if self.expand_packages:
            near = near.union(self._package_importers(records, edges, state, new))
        waiting = self._unresolved(records, edges, new)
        again = touched.union(near).union(waiting).distinct().persist()
        derived = self.derive(upserts)
        self.store.upsert("records", derived, ["path"], deleted=touched)
        records = self.store.read("records")
        redo = records.join(again, "path", "left_semi")
        fresh = self.resolve(redo, records.select("path"))
        self.store.upsert("edges", fresh, ["source"], deleted=again.withColumnRenamed("path", "source"))
        again.unpersist()

    @staticmethod
    def _package_importers(records: DataFrame, edges: DataFrame, state: DataFrame, new: DataFrame) -> DataFrame:
        """Files that import a file of a package (a directory) in which a file came or went."""
        moved = new.select("path").union(state.filter("op = 'delete'").select("path")).select(dirname(F.col("path")).alias("package")).distinct()
        members = records.select(F.col("path").alias("target"), dirname(F.col("path")).alias("package")).join(moved, "package", "left_semi")
        return edges.join(members.select("target"), "target", "left_semi").select(F.col("source").alias("path"))

    @staticmethod
    def _unresolved(records: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
        """A new file may be what an import waited for: files with an import without an edge are resolved anew."""
        if "imports" not in records.columns or new.isEmpty():
            return records.select("path").limit(0)
        wanted = records.select("path", F.size("imports").alias("n"))
        have = edges.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("m"))
        return wanted.join(have, "path", "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("path")

    def start(self, change_events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The stream; foreachBatch runs batches in order and one at a time."""
        return change_events.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch_impact(files: DataFrame, edges: DataFrame, batch: DataFrame, depth: int = 3) -> DataFrame:
    """The impact radius of each file of a batch."""
    start = last_state(batch).select(F.col("path").alias("root"), F.col("path").alias("node"))
    return impact_radius(files, edges, start, depth)


def cycles_stale(batch_edges: DataFrame, old_edges: DataFrame) -> bool:
    """Whether cycles must be computed anew: if any edge came or went. Looking at known cycles' files alone would
    miss a new cycle among files that were in none."""
    a, b = batch_edges.select("source", "target"), old_edges.select("source", "target")
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()


def append_trend(snapshot: DataFrame, store: Store, name: str = "trend", compact_every: int = COMPACT_EVERY) -> None:
    """Adds a row (ts, ...) to the history; every so many appends its small files become one."""
    store.append(name, snapshot)
    if len((store._pointer(name) or {"data": ()})["data"]) >= compact_every:
        store.compact(name)


def trend(history: DataFrame, by: str = "day") -> DataFrame:
    """The latest row of every day or ISO week."""
    week = F.concat(F.expr("extract(YEAROFWEEK FROM ts)"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    bucket = F.date_format("ts", "yyyy-MM-dd") if by == "day" else week
    rest = [c for c in history.columns if c != "ts"]
    out = history.withColumn("bucket", bucket).groupBy("bucket").agg(F.max_by(F.struct("ts", *rest), "ts").alias("x"))
    return out.select("bucket", "x.*")
