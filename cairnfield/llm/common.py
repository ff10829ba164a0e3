"""What the operators of this subpackage share: intermediate tables, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and the letters that are lower-cased.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a side of a join may have to be broadcast, and so to pass through the driver.
SMALL = 1 << 17

#: Paths below the shared folder that are not deleted yet, in the order in which they were made.
_LIVE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    It lies in a folder of this application, which goes with the application's end at the latest. Where the setting is
    absent, a temporary folder stands in, but only in local mode.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cairnfield.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairnfield-")
        spark.conf.set("cairnfield.shared.dir", base)
    folder = f"{base.rstrip('/')}/cairnfield-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(where):
        files.deleteOnExit(where)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and survives lost executors.

    release() deletes it; the end of a scratch() or of the application does where a result still reads from it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join: over SMALL rows it is joined by merge, and else Spark decides.

    Spark's size check goes by files, and keys compress: a broadcast may take over ten times its files in the driver.
    rows: a bound of df's rows, else they are counted; for an inner join, which may broadcast the other side, a bound of
    both. A merge join can split the rows of a frequent key where both sides are stored tables.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > SMALL else df


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables made by stored(), once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)  # type: ignore[attr-defined]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _LIVE:
        _LIVE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() and shared_dir() have made inside: for callers that write a result elsewhere."""
    before = set(_LIVE)
    try:
        yield
    finally:
        for path in [p for p in _LIVE if p not in before]:
            remove(spark, path)


def carried(docs: DataFrame, keep: Sequence[str], made: Sequence[str]) -> tuple[DataFrame, list[str], str]:
    """(the kept columns of docs under positional names, then its text; their own names; their schema as DDL).

    Columns that an operator makes win over columns of docs by the same name, whatever their case, which are left out.
    """
    taken = {m.lower() for m in made}
    names = [c for c in (keep or docs.columns) if c.lower() not in taken]
    fields = [docs.schema[c] for c in names]
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in names]
    return docs.select(*(c.alias(f"c{k}") for k, c in enumerate(quoted)), F.col("text").alias("t")), names, ddl


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null and blank texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE_CLASS)
    return F.filter(parts, lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps: each replaces edges by edges to the smallest neighbour, so an edge
    list never grows and rounds go with the logarithm of the longest path. Each step is written to the shared folder.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    rows = now.count()
    if not rows:
        return now.selectExpr("a AS node", "b AS root")
    made: list[DataFrame] = []

    def by_node(least: DataFrame) -> DataFrame:
        if 2 * rows <= SMALL:  # edges never grow, so neither do the nodes at their ends
            return least
        made.append(stored(least, "least"))
        return side(made[-1], 2 * rows)

    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = by_node(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").selectExpr("b AS a", "m AS b").filter("a <> b").distinct()
        large = stored(large, "large")
        lower = by_node(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").filter("b <> m").selectExpr("b AS a", "m AS b").union(lower.selectExpr("a", "m AS b")).distinct()
        small = stored(small, "small")
        release(now, large, *made)
        made.clear()
        now = small
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == mark:
            break
        mark = row
    roots = now.selectExpr("a AS node", "b AS root")  # the result reads the last table
    return roots.union(roots.selectExpr("root", "root").distinct())
