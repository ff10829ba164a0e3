"""SimHash near-duplicates, joined on a grid of segment popcounts.

A fingerprint's 64 bits are 32 segments of two; a segment's popcount is 0, 1 or 2. Written in unary (00, 01, 11) the
popcounts make a 64-bit word again, and the Manhattan distance between two popcount vectors is the number of bits in
which those words differ. It is a lower bound of the fingerprints' Hamming distance, as a flipped bit moves one popcount
by one at most. The vector has two halves of 16 dimensions. Two vectors at a distance of 3 or less are at a distance of 1
or less in one half, so the range join is an equi-join of grid cells: every fingerprint stands in its own cell of either
half and, on the other side, in the cells next to it. The pairs found are then compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, release, side, stored

#: The lower bit of each segment, and half of a word.
LOW, HALF = 0x5555555555555555, 0xFFFFFFFF
#: Shingles that are counted at a time, to bound memory for very long texts.
BLOCK = 1 << 18


def fingerprint(text: str | None, n: int = 3) -> int:
    """The SimHash of a text's n-word shingles, repeats included, as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, stops = (ends - size).tolist(), ends.tolist()
    if len(parts) < n:
        starts, stops = starts[:1], stops[-1:]
    else:
        starts, stops = starts[: len(starts) - n + 1], stops[n - 1 :]
    hashed = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(stops)
    for k in range(0, total, BLOCK):
        h = np.fromiter([hashed(joined[a:b], 42) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], np.uint64)
        ones += _ones(h)
    bits = 2 * ones > total
    return int(np.packbits(bits).view(">u8")[0])


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest first: bytes are counted, then their bits."""
    seen = h.byteswap().view(np.uint8).reshape(-1, 8)
    if len(h) < 400:
        return np.unpackbits(seen, axis=1).sum(0, dtype=np.int64)
    counts = np.stack([np.bincount(seen[:, k], minlength=256) for k in range(8)])
    return (counts @ BITS_OF_BYTE).ravel()


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text); fp is signed as Spark has no unsigned type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids.simpleString()}, fp bigint")


def embedding(fp: Column) -> Column:
    """The segments' popcounts in unary."""
    up = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return up.bitwiseOR(fp).bitwiseAND(low).bitwiseOR(F.shiftleft(up.bitwiseAND(fp).bitwiseAND(low), 1))


def _halves(fp: Column) -> Column:
    """The fingerprint's cells in the two grids."""
    e = embedding(fp)
    return F.array(F.shiftrightunsigned(e, 32), e.bitwiseAND(F.lit(HALF)))


def _near(cell: Column) -> Column:
    """The cell and those at a Manhattan distance of 1: one bit flipped, where the code stays unary (no 10)."""
    flips = F.array(*[F.lit(1 << b) for b in range(32)])
    moved = F.transform(flips, lambda m: cell.bitwiseXOR(m))
    bad = F.lit(0x55555555)
    fine = F.filter(moved, lambda c: F.shiftrightunsigned(c, 1).bitwiseAND(F.bitwise_not(c)).bitwiseAND(bad) == 0)
    return F.concat(F.array(cell), fine)


def _flip_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints at a distance of 2 or less, 65 rows each, however dense they are.

    Two fingerprints at a distance of 2 or less are both within one bit of some 64-bit word; all that are within one
    bit of a word are linked to the smallest of them, if they are at a distance of 2 or less, which they are.
    """
    flips = F.array(F.lit(0), *[F.lit(1 << b) if b < 63 else F.lit(-(1 << 63)) for b in range(64)])
    at = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    least = at.withColumn("b", F.min("fp").over(Window.partitionBy("word")))
    return least.filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, distance: int = 3, dense: int = 64) -> DataFrame:
    """(a, b) over distinct fingerprints fps(fp): links whose components are those of "differ in <= distance bits".

    Where `dense` fingerprints or more share a cell (many versions of one text), those cells' members are linked
    through _flip_links first. Such a cell has a main root then, the most frequent one; two members that both have it
    need no comparison, so its join takes the others against all: no component changes, and no cell compares all
    its pairs. distance is at most 3.

    Spark takes an exploded table for hardly larger than the file below it, and would broadcast the near cells, some 50
    rows a half of a fingerprint, from files of a few MB. So their joins are merge joins, and joins with what is known of
    crowded cells are such that only that side can be broadcast.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves hold distances up to 3")
    own = fps.select("fp", F.posexplode(_halves(F.col("fp"))).alias("k", "cell"))
    counts = own.groupBy("k", "cell").agg(F.count("*").alias("n")).filter(F.col("n") >= dense)
    crowd = stored(own.join(counts, ["k", "cell"], "left_semi").select("fp").distinct(), "crowd")
    first = stored(_flip_links(crowd) if distance >= 2 else crowd.selectExpr("fp AS a", "fp AS b").limit(0), "flips")
    roots = components(first).withColumnRenamed("node", "fp").filter("fp <> root")
    known = stored(fps.join(side(roots), "fp", "left").select("fp", "root"), "grid")  # null: its own root
    own = known.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.posexplode(_halves(F.col("fp"))).alias("k", "cell"))
    of = F.coalesce("ra", "a")
    main = own.join(counts, ["k", "cell"], "left_semi").groupBy("k", "cell", of.alias("r")).agg(F.count("*").alias("n"))
    main = stored(main.groupBy("k", "cell").agg(F.max_by("r", F.struct("n", "r")).alias("main")), "main")
    own = own.join(main, ["k", "cell"], "left").withColumn("usual", F.coalesce(of == F.col("main"), F.lit(False)))
    near = known.select(F.col("fp").alias("b"), F.col("root").alias("rb"), F.posexplode(F.transform(_halves(F.col("fp")), _near)).alias("k", "cells"))
    near = near.select("b", "rb", "k", F.explode("cells").alias("cell"))
    close = (F.col("a") < F.col("b")) & (of != F.coalesce("rb", "b"))
    bound = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= distance
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.hint("merge"), (left["k"] == right["k"]) & (left["cell"] == right["cell"]) & close & bound & exact).select("a", "b")

    few = own.filter("NOT usual").drop("usual", "main")
    most = own.filter("usual").drop("usual", "main")
    # an outer join, as an inner one may broadcast its left side; cells without a main root go by the filter
    strangers = near.join(main, ["k", "cell"], "left").filter(F.coalesce("main", "rb", "b") != F.coalesce("rb", "b")).drop("main")
    out = stored(first.union(met(few, near)).union(met(most, strangers)).distinct(), "links")
    release(crowd, first, known, main)
    return out


def near_duplicates(docs: DataFrame, n: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text); other columns are ignored.

    Fingerprints that differ in `distance` bits or fewer are linked; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have fingerprint 0. Repeated rows repeat. Rows without a doc_id take part but lend no
    id: a component of such rows alone has a null component_id. An empty table gives an empty one.
    """
    rows = stored(fingerprints(docs, n), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = links(classes.select("fp"), distance)
    linked = components(pairs).withColumnRenamed("node", "fp")
    rooted = stored(classes.join(side(linked), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stored(rooted.join(side(least, rooted.count()), "root").select("fp", "component_id"), "components")
    release(pairs, classes, rooted, least)
    return rows.join(side(named, rows.count()), "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, n: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id. Rows without a doc_id stay."""
    found = near_duplicates(docs, n, distance)
    kept = stored(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    out = docs.join(side(kept.filter("rows = 1")), "doc_id", "left_semi")
    repeated = kept.filter("rows > 1")
    if not repeated.isEmpty():
        out = out.union(docs.join(side(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.union(docs.filter("doc_id IS NULL")).select(*docs.columns)
