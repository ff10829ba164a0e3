"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Only DataFrame functions. An item of q distinct word shingles is contained in a document if the document has t * q of
them or more. A MinHash signature of a long document says next to nothing about a short item, so the sketch is taken
from the item's side alone, where it can be made exact:

- items fall into partitions by size, powers of two of q;
- an item's sketch is its k smallest shingle hashes (bottom-k MinHash), with k = q - ceil(t * q) + 1. A document that
  misses all k of them misses more than (1 - t) * q shingles, so no contained item is lost, at any document's length;
- a size partition looks only at documents with as many shingles as its smallest item needs;
- documents that share a sketch hash of a partition are candidates of its item. Only sketches are looked up among all
  shingles of all documents: for a threshold of 0.8 about a fifth of the items' shingles;
- candidates' texts are read again, and the shingles that document and item share are counted as texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, release, stored, words


def shingle_hashes(w: Column, n: int) -> Column:
    """Hashes of all n-word shingles of the array of words w, repeats included; none if w is shorter."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _sketched(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item_id, n, hashes, shingles, q, need, size_class, sketch): an item with fewer words than a shingle is one shingle."""
    own = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    own = own.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("n"), F.array_distinct(F.when(F.size("w") < shingle, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(shingle_hashes(F.col("w"), shingle))).alias("hashes"), F.array_distinct(F.when(F.size("w") < shingle, F.array(F.array_join("w", " "))).otherwise(short_shingles(F.col("w"), shingle))).alias("shingles"))
    own = own.withColumn("q", F.size("shingles")).withColumn("need", F.ceil(F.col("q") * F.lit(threshold) - 1e-9).cast("int"))
    own = own.withColumn("size_class", F.floor(F.log2("q")).cast("int"))
    return own.withColumn("sketch", F.slice(F.array_sort("hashes"), F.lit(1), F.col("q") - F.col("need") + 1))


def _items(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """_sketched() of distinct items with an id, in the shared folder, with item_key and the items' own shingles as texts."""
    own = items.filter("item_id IS NOT NULL").select("item_id", "text").distinct()
    own = _sketched(own, shingle, threshold)
    return stored(own.withColumn("item_key", F.xxhash64("item_id", "hashes")), "items")


def _of_lengths(lengths: list[int], shingle: int, of: Callable[[Column, int], Column]) -> Callable[[Column], Column]:
    """words -> the distinct shingles of all lengths."""
    return lambda w: F.array_distinct(F.concat(*[of(w, n) for n in lengths]))


def candidates(docs: DataFrame, known: DataFrame, lengths: list[int], shingle: int) -> DataFrame:
    """(doc_id, text_key, item_key): documents with a sketch hash of an item, by size partition."""
    of_class = known.groupBy("size_class").agg(F.min("need").alias("class_need"))
    lookup = stored(known.join(of_class, "size_class").select("item_key", "class_need", F.explode("sketch").alias("h")), "sketches")

    def of(w: Column, n: int) -> Column:
        return shingle_hashes(w, n) if n == shingle else F.transform(short_shingles(w, n), lambda s: F.xxhash64(s))

    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), let(words(F.col("text")), _of_lengths(lengths, shingle, of)).alias("hs"))
    rows = own.select("doc_id", "text_key", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    # The lookup's size decides between a broadcast and a shuffle by hash.
    found = rows.join(lookup, "h").filter("size >= class_need").select("doc_id", "text_key", "item_key").distinct()
    out = stored(found, "candidates")
    release(lookup)
    return out


def _verified(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared): rows of docs, told apart by id and hash of the text, that contain an item."""
    known = _items(items, shingle, threshold)
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # at most `shingle` numbers
    if not lengths:
        none = docs.select("doc_id", F.xxhash64("text").alias("text_key")).limit(0)
        return none.crossJoin(items.select("item_id").limit(0)).select("*", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"))
    pairs = candidates(docs, known, lengths, shingle)
    few = stored(pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "candidate-documents")
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    of = _of_lengths(lengths, shingle, short_shingles)
    # Few documents hold a candidate; of these, a row a distinct shingle, which is kept if an item has it.
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(few, here, "left_semi")
    own = own.select("doc_id", "text_key", F.explode(let(words(F.col("text")), of)).alias("s")).distinct()
    lone = known.select("item_key", "item_id", F.col("q").cast("long").alias("n_item"), "need", F.explode("shingles").alias("s"))
    met = own.join(lone, "s")
    same = [met["doc_id"].eqNullSafe(pairs["doc_id"]), met["text_key"] == pairs["text_key"], met["item_key"] == pairs["item_key"]]
    met = met.join(pairs, same, "left_semi")
    out = met.groupBy("doc_id", "text_key", "item_key", "item_id", "n_item", "need").agg(F.count("*").alias("n_shared")).filter("n_shared >= need")
    out = stored(out.select("doc_id", "text_key", "item_id", "n_item", "n_shared"), "contained")
    release(known, pairs, few)
    return out


def contained(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document and item that it contains.

    docs(doc_id, text), items(item_id, text); other columns are ignored. Words are maximal runs without white space, A-Z
    lower-cased. Items without words (null, empty, blank) are in no document; documents without words contain
    nothing. Items shorter than a shingle are one shingle of their own length, looked up among the documents' shingles
    of that length. Rows of equal doc_id and text count once, as do items of equal id and text; of items with an id
    but different texts the best containment is returned, and likewise for documents.
    """
    out = _verified(docs, items, shingle, threshold).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.n_shared", "m.containment")


def short_shingles(w: Column, n: int) -> Column:
    """All n-word shingles as texts."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that contain an item. Rows are judged each, whether they have a doc_id or share one."""
    bad = _verified(docs, items, shingle, threshold).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = stored(bad, "contaminated")  # its size, now known, decides how it is joined
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")
