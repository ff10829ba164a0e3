"""Versioned tables: full-replace and upsert sinks, keyed reads, freshness."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1


@dataclass(frozen=True)
class Stamp:
    """What a stored table was made from; strict freshness compares all of it, coarse freshness the head alone."""

    version: int
    head: str
    files: int
    config: str
    signature: str

    def fresh(self, other: Stamp, strict: bool = True) -> bool:
        return self == other if strict else (self.version, self.head) == (other.version, other.head)


def config_hash(config: dict) -> str:
    """the same for equal configurations, whatever the order of their keys."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of old and new (path, mtime, size, hash): added, deleted, same (time and size), touched (hash
    the same) or changed."""
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("mtime", "size", "hash")]).withColumn("was", F.lit(True))
    n = new.select("path", *[F.col(c).alias(f"n_{c}") for c in ("mtime", "size", "hash")]).withColumn("now", F.lit(True))
    state = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted")
        .when(F.col("o_mtime").eqNullSafe(F.col("n_mtime")) & F.col("o_size").eqNullSafe(F.col("n_size")), "same")
        .when(F.col("o_hash").eqNullSafe(F.col("n_hash")), "touched").otherwise("changed")
    )
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


class StoreError(RuntimeError):
    """A table whose files are there but whose pointers can't be read."""


class Store:
    """Tables below a folder. A write makes new directories and then, in one rename, a pointer of the next number; the
    pointer of the highest number is the table. Readers see the old state or the new one, and a write that ends between
    any two steps changes nothing. The state before the newest one is kept, as plans made from it may still have to run.

    A table with keys lies in buckets by the hash of its keys, so that an upsert reads and writes those buckets alone
    that hold one of its keys.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int = VERSION, buckets: int = 16) -> None:
        self.spark, self.folder, self.version, self.buckets = spark, folder.rstrip("/"), version, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _children(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self, name: str) -> list[int]:
        """The numbers of the table's pointers, the newest first."""
        found = [n.removeprefix("pointer-").removesuffix(".json") for n in self._children(f"{self.folder}/{name}") if n.startswith("pointer-")]
        return sorted((int(n) for n in found if n.isdigit()), reverse=True)

    def _pointer(self, name: str, number: int | None = None) -> dict | None:
        numbers = [number] if number is not None else self._numbers(name)
        if not numbers:
            return None
        fs, at = self._fs(f"{self.folder}/{name}/pointer-{numbers[0]:012d}.json")
        return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8"))

    def exists(self, name: str) -> bool:
        """Whether there is a state of any version."""
        return bool(self._numbers(name))

    def broken(self, name: str) -> bool:
        """Whether the table has data but no pointer: not a new table, but one whose pointers were lost."""
        return not self.exists(name) and any(n.startswith("data-") for n in self._children(f"{self.folder}/{name}"))

    def _point(self, name: str, pointer: dict) -> None:
        numbers = self._numbers(name)
        number = numbers[0] + 1 if numbers else 1
        fs, tmp = self._fs(f"{self.folder}/{name}/.pointer-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(pointer | {"version": self.version}).encode()))
        out.close()
        _, at = self._fs(f"{self.folder}/{name}/pointer-{number:012d}.json")
        if fs.exists(at) or not fs.rename(tmp, at):
            raise StoreError(f"another writer of {name} was faster")
        self._tidy(name, numbers)

    def _tidy(self, name: str, numbers: list[int]) -> None:
        """Deletes states older than the one before the newest, and what only they hold."""
        if len(numbers) < 2:
            return
        keep = {p for n in (None, numbers[0]) for p in self._pointer(name, n)["data"].values()}
        for n in numbers[1:]:
            for path in set(self._pointer(name, n)["data"].values()) - keep:
                fs, at = self._fs(path)
                fs.delete(at, True)
            fs, at = self._fs(f"{self.folder}/{name}/pointer-{n:012d}.json")
            fs.delete(at, False)

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, df: DataFrame, keys: list[str] | None) -> dict[str, str]:
        """Writes rows; returns the new paths by bucket."""
        data = f"{self.folder}/{name}/data-{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(data)
            return {data.rpartition("-")[2]: data}
        df.withColumn("__bucket", self._bucket(keys)).repartition("__bucket").write.partitionBy("__bucket").parquet(data)
        return {n.removeprefix("__bucket="): f"{data}/{n}" for n in self._children(data) if n.startswith("__bucket=")}

    def replace(self, name: str, df: DataFrame, stamp: Stamp | None = None, keys: list[str] | None = None) -> None:
        """The whole table anew; with keys it can be upserted by bucket."""
        self._point(name, {"data": self._write(name, df, keys), "keys": keys, "buckets": self.buckets, "schema": df.schema.json(), "stamp": asdict(stamp) if stamp else None})

    def append(self, name: str, df: DataFrame, stamp: Stamp | None = None) -> None:
        """Adds rows to a table without keys."""
        p = self._pointer(name)
        if p is None or p["version"] != self.version:
            return self.replace(name, df, stamp)
        if p["keys"]:
            raise ValueError("a table with keys takes upserts")
        return self._point(name, p | {"data": p["data"] | self._write(name, df, None), "stamp": asdict(stamp) if stamp else None})

    def upsert(self, name: str, rows: DataFrame, keys: list[str], deleted: DataFrame | None = None, stamp: Stamp | None = None) -> None:
        """Rows take the place of those with their keys; deleted(keys) go. Other buckets stay as they are."""
        if self.broken(name):
            raise StoreError(f"{name} has data but no pointer")
        p = self._pointer(name)
        if p is None or p["version"] != self.version:
            return self.replace(name, rows, stamp, keys)
        if p["keys"] != keys or p["buckets"] != self.buckets:
            self.replace(name, self.read(name), stamp, keys)
            p = self._pointer(name)
        rows = rows.persist()
        gone = rows.select(*keys) if deleted is None else rows.select(*keys).union(deleted.select(*keys))
        gone = gone.distinct().persist()
        touched = {str(r[0]) for r in gone.select(self._bucket(keys)).distinct().collect()}  # `buckets` numbers at most
        old = self._frame(p, touched)
        new = self._write(name, old.join(gone, keys, "left_anti").unionByName(rows), keys)
        rows.unpersist()
        gone.unpersist()
        rest = {b: path for b, path in p["data"].items() if b not in touched}
        return self._point(name, p | {"data": rest | new, "stamp": asdict(stamp) if stamp else None})

    def _frame(self, pointer: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(pointer["schema"]))
        paths = [path for b, path in sorted(pointer["data"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame | None:
        """The table, or None if there is none of this version. One that has lost its pointers is an error."""
        if self.broken(name):
            raise StoreError(f"{name} has data but no pointer")
        p = self._pointer(name)
        return self._frame(p) if p and p["version"] == self.version else None

    def lookup(self, name: str, keys: DataFrame, on: list[str]) -> DataFrame | None:
        """The table's rows with these keys, from their buckets alone where `on` are the table's keys."""
        p = self._pointer(name)
        if p is None or p["version"] != self.version:
            return None
        keys = keys.select(*on).distinct()
        only = {str(r[0]) for r in keys.select(self._bucket(on)).distinct().collect()} if p["keys"] == on and p["buckets"] == self.buckets else None
        return self._frame(p, only).join(keys, on, "left_semi")

    def compact(self, name: str, files: int = 1) -> None:
        """A table without keys in `files` files; the pointer moves when they are written."""
        p = self._pointer(name)
        if p and not p["keys"]:
            self.replace(name, self._frame(p).repartition(files))

    def stamp(self, name: str) -> Stamp | None:
        p = self._pointer(name)
        return Stamp(**p["stamp"]) if p and p["version"] == self.version and p["stamp"] else None

    def stats(self, *names: str) -> dict[str, int]:
        """Rows of each table that is there."""
        return {n: df.count() for n in names if (df := self.read(n)) is not None}


def warm_counts(files: DataFrame, parsed: DataFrame, symbols_: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of what is kept: files, parse_results, symbols (distinct names), diagnostics and total_lines."""
    lines = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.col("line_count").cast("long")), F.lit(0)).alias("total_lines"))
    rest = (parsed.agg(F.count("*").alias("parse_results")), symbols_.agg(F.countDistinct("name").alias("symbols")), diagnostics.agg(F.count("*").alias("diagnostics")))
    for one in rest:  # a row each
        lines = lines.join(one)
    return lines


def restored(files: DataFrame, metrics: DataFrame, tests: DataFrame) -> DataFrame:
    """Files with pagerank and tests as they were kept: metrics(file, dimension, value) and tests(source, test).

    Of several ranks of a file the largest counts. A file without a kept rank has null, and one without tests an empty
    list; what is kept of files that are gone is left out.
    """
    rank = metrics.filter("dimension = 'pagerank'").groupBy(F.col("file").alias("path")).agg(F.max("value").alias("pagerank"))
    own = tests.groupBy(F.col("source").alias("path")).agg(F.sort_array(F.collect_set("test")).alias("tests"))
    out = files.drop("pagerank", "tests").join(rank, "path", "left").join(own, "path", "left")
    return out.withColumn("tests", F.coalesce("tests", F.array().cast(own.schema["tests"].dataType)))


def signature(files: DataFrame, *columns: str) -> Column | DataFrame:
    """A23 for many files: one row with the sum of the rows' hashes, which no order changes and partial sums suffice for."""
    return files.agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("signature"), F.count("*").alias("n"))
