"""LM scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by workers.

Words are 64-bit hashes; a document is its words and one end token, the first of which follows start marks. Training
goes over the corpus twice, and every count covers all of it:

1. words: tasks sum their counts and send them, by hash range, as sorted arrays of hashes and counts; each range is
   merged and written as a shard of the vocabulary. A word's place in the vocabulary is its id.
2. pairs: a pair of ids is one 64-bit number, and that times an odd constant (mod 2**64) is a hash without collisions,
   which spreads the pairs of a frequent word over all ranges. Merged shards hold the pairs' counts; from them follow
   each context's total and its pairs of count 1, 2 and more, and each word's number of distinct predecessors.
   At order 3 tasks send triples instead, by the hash of the pair that they begin with: a context's successors meet in
   one range, at most one a word. A shard of triples holds ids and counts of successors in the order of their contexts.
   What a pair counts is then its number of distinct predecessors, summed by range from the merged triples, and beside
   it stands how many successors it has.

Shards lie in the shared folder. A worker maps them into memory (a copy of theirs, where the folder isn't a local path)
and looks sorted, distinct hashes up by binary search, a block of text at a time.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, release, shared_dir, stored

#: Bytes of text tokenized at a time, tokens summed up before they are sent on, bytes of a word that numpy hashes.
BLOCK, FLUSH, SHORT = 1 << 22, 1 << 22, 48
#: Hashes of the start mark and of the end token, and constants of the hashes.
START, END = np.uint64(0), np.uint64(1)
PRIME, GOLDEN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(int(GOLDEN), -1, 1 << 64))

#: By byte: white space is 0, A-Z are lower-cased.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word in the bytes data; a hash is 2 or more."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    at, left = start[order], size[order]
    big = int(np.searchsorted(-left, -SHORT))
    h = np.full(len(at), 0xCBF29CE484222325, np.uint64)
    fold = _FOLD[data].astype(np.uint64)
    live = len(at)
    counts = np.bincount(np.minimum(left, SHORT), minlength=SHORT + 1) if len(left) else np.zeros(SHORT + 1, np.int64)
    for k in range(SHORT):
        live -= int(counts[k])
        if live <= 0:
            break
        part = (h[:live] ^ fold[at[:live] + k]) * PRIME
        h[:live] = part ^ (part >> np.uint64(29))
    h = h * GOLDEN
    h ^= h >> np.uint64(32)
    h *= GOLDEN
    if big and left[0] > SHORT:
        low = _FOLD[data].tobytes()
        for i in np.flatnonzero(left[:big] > SHORT):
            h[i] = xxhash.xxh64_intdigest(low[at[i] : at[i] + left[i]], 7)
    out[order] = h
    return start, np.maximum(out, np.uint64(2))


@dataclass
class Tokens:
    """A block: the row of each token, its hash, and the hashes of the token before it and of the one before that."""

    row: np.ndarray
    token: np.ndarray
    before: np.ndarray
    earlier: np.ndarray


def tokens(texts: list[str | None]) -> Iterator[Tokens]:
    """Blocks of about BLOCK bytes over all texts; long texts are cut between words."""
    rows: list[int] = []
    parts: list[bytes] = []
    lasts: list[bool] = []
    carry, size = np.array([START, START]), 0

    def block() -> Tokens:
        nonlocal carry
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        at, h = word_hashes(data)
        part = np.searchsorted(ends, at, "right")
        last = np.array(lasts)
        closing = np.flatnonzero(last)
        # The end token comes after the words of its part.
        part = np.concatenate([part, closing])
        h = np.concatenate([h, np.full(len(closing), END)])
        order = np.argsort(part, kind="stable")
        part, h = part[order], h[order]
        row = np.array(rows)[part]
        flow = np.concatenate([carry, h])
        carry = np.array([START, START]) if last[-1] else flow[-2:]
        flow = np.where(flow == END, START, flow)
        before = flow[1:-1]
        return Tokens(row, h, before, np.where(before == START, START, flow[:-2]))

    for r, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = len(data)
            if end - at > BLOCK:
                cut = max(data.rfind(s, at, at + BLOCK) for s in (b" ", b"\n"))
                if cut <= at:  # a word longer than a block stays whole
                    cut = min((p for s in (b" ", b"\n") if (p := data.find(s, at + BLOCK)) > 0), default=end)
                end = cut
            rows.append(r)
            parts.append(data[at:end])
            lasts.append(end == len(data))
            size += end - at
            at = end
            if size >= BLOCK:
                yield block()
                rows, parts, lasts, size = [], [], [], 0
            if at == len(data):
                break
    if parts:
        yield block()


def _packed(keys: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers: differences, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    """x in the narrowest unsigned type that holds it."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _column(x: np.ndarray) -> bytes:
    x = _small(x)
    return bytes([x.itemsize]) + zstandard.compress(x.tobytes(), 1)


def _from_column(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and each column's sums."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[first], *(np.add.reduceat(c[order], first) for c in columns)


def _ranges(keys: np.ndarray, bits: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Sorted keys, split by their top bits."""
    cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
    for b, (x, y) in enumerate(zip([0, *cut], [*cut, len(keys)], strict=True)):
        if y > x:
            yield b, _packed(keys[x:y]), [_column(c[x:y]) for c in columns]


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _write(path: str, x: np.ndarray) -> None:
    at, name = _where(path)
    at.create_dir(name.rpartition("/")[0], recursive=True)
    with at.open_output_stream(name) as f:
        f.write(np.ascontiguousarray(x).data)


@lru_cache(4096)
def mapped(path: str, dtype: str, n: int) -> np.ndarray:
    """The array in a file, mapped into memory; a remote file by way of a local copy without a name."""
    if n == 0:
        return np.zeros(0, dtype)
    at, name = _where(path)
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r", shape=(n,))
    handle, copy = tempfile.mkstemp()
    try:
        with at.open_input_stream(name) as f, os.fdopen(handle, "wb") as out:
            while piece := f.read(1 << 22):
                out.write(piece)
        return np.memmap(copy, dtype, "r", shape=(n,))
    finally:
        os.unlink(copy)


@dataclass(frozen=True)
class Shards:
    """Sorted 64-bit keys with a value each, in 2**bits files by the keys' top bits."""

    bits: int
    files: tuple[tuple[str, str, int], ...]  # (path without ending, type of the values, length)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of sorted distinct keys; value 0 where a key isn't there. Places count over all files."""
        place, value = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        cut = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).tolist()
        base = 0
        for (path, kind, n), x, y in zip(self.files, [0, *cut], [*cut, len(keys)], strict=True):
            if y > x and n:
                own = mapped(path + ".keys", "u8", n)
                i = np.minimum(np.searchsorted(own, keys[x:y]), n - 1)
                place[x:y] = base + i
                value[x:y] = np.where(own[i] == keys[x:y], mapped(path + ".values", kind, n)[i], 0)
            base += n
        return place, value


@dataclass(frozen=True)
class Dense:
    """A number for each id, in files of `step` ids."""

    step: int
    files: tuple[tuple[str, str, int], ...]

    def take(self, ids: np.ndarray) -> np.ndarray:
        """The numbers of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, np.arange(1, len(self.files)) * self.step).tolist()
        for k, ((path, kind, n), x, y) in enumerate(zip(self.files, [0, *cut], [*cut, len(ids)], strict=True)):
            if y > x and n:
                out[x:y] = mapped(path, kind, n)[ids[x:y] - k * self.step]
        return out


def _starts(blocks: np.ndarray, many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the successors of the pairs `at` begin: blocks has the start of every 16th pair, many the numbers of each."""
    first = at & ~15
    out = blocks[at >> 4].astype(np.int64)
    for j in range(15):
        out += np.where(first + j < at, many[np.minimum(first + j, len(many) - 1)], 0)
    return out


@dataclass(frozen=True)
class Successors:
    """What follows each pair, in a file a range of pairs: (pairs, type of their numbers, contexts with more than one
    successor, types of their totals, ones and twos, triples, type of their counts, path of the pairs, path of the triples)."""

    bits: int
    files: tuple[tuple | None, ...]

    def find(self, contexts: np.ndarray, which: np.ndarray, word: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(total, discounted mass) of sorted distinct contexts, and counts of tokens: after context `which`, or none if
        it is -1, the word of this id, or none if that is -1."""
        total, mass, times = np.zeros(len(contexts), np.int64), np.zeros(len(contexts)), np.zeros(len(which), np.int64)
        cut = np.searchsorted(contexts, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).tolist()
        order = np.argsort(which, kind="stable")
        edge = np.searchsorted(which[order], [0, *cut, len(contexts)]).tolist()
        for k, (x, y) in enumerate(zip([0, *cut], [*cut, len(contexts)], strict=True)):
            if y == x or self.files[k] is None:
                continue
            n, many_kind, n_multi, kinds, triples, kind, path, under = self.files[k]
            if not n or not triples:
                continue
            keys, many = mapped(path + ".keys", "u8", n), mapped(path + ".many", many_kind, n)
            counts, ids = mapped(under + ".counts", kind, triples), mapped(under + ".ids", "u4", triples)
            i = np.minimum(np.searchsorted(keys, contexts[x:y]), n - 1)
            own = np.where(keys[i] == contexts[x:y], many[i], 0).astype(np.int64)
            start = _starts(mapped(path + ".blocks", "u4", (n + 15) // 16), many, i)
            lone = np.flatnonzero(own == 1)
            c = counts[start[lone]].astype(np.int64)
            total[x + lone], mass[x + lone] = c, d[np.minimum(c, 3)]
            full = np.flatnonzero(own > 1)
            if len(full):
                m = np.searchsorted(mapped(path + ".multi", "u4", n_multi), i[full])
                all_, ones, twos = (mapped(f"{path}.{name}", t, n_multi)[m].astype(np.int64) for name, t in zip(("total", "ones", "twos"), kinds, strict=True))
                total[x + full], mass[x + full] = all_, d[1] * ones + d[2] * twos + d[3] * (own[full] - ones - twos)
            t = order[edge[k] : edge[k + 1]]
            t = t[(word[t] >= 0) & (own[which[t] - x] > 0)]
            low = start[which[t] - x]
            high = low + own[which[t] - x]
            end, want = high, word[t].astype(np.uint32)
            todo = np.flatnonzero(high > low)
            while len(todo):  # the first successor whose id isn't smaller
                middle = (low[todo] + high[todo]) >> 1
                less = ids[middle] < want[todo]
                low[todo] = np.where(less, middle + 1, low[todo])
                high = high.copy() if high is end else high
                high[todo] = np.where(less, high[todo], middle)
                todo = todo[high[todo] > low[todo]]
            at = np.minimum(low, triples - 1)
            times[t] = np.where((low < end) & (ids[at] == want), counts[at], 0)
        return total, mass, times


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) from the numbers of n-grams of count 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array(out)


@dataclass(frozen=True)
class Model:
    """V words of N tokens; arrays by word id, the start mark being id V. Triples are there at order 3."""

    V: int
    N: int
    words: Shards
    pairs: Shards
    total: Dense
    ones: Dense
    twos: Dense
    more: Dense
    preceded: Dense
    d_pair: np.ndarray
    d_word: np.ndarray
    pair_types: int
    word_ones: tuple[int, int, int]
    triples: Successors | None = None
    d_triple: np.ndarray | None = None

    def unigram(self, n: np.ndarray) -> np.ndarray:
        """Probability of a word with n distinct predecessors; 0 is an unknown word, one of V + 1 kinds."""
        if not self.pair_types:
            return np.full(len(n), 1 / (self.V + 1))
        spread = float(self.d_word[1:] @ np.array(self.word_ones)) / self.pair_types
        return (n - self.d_word[np.minimum(n, 3)]) / self.pair_types + spread / (self.V + 1)

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token: its training count, and its probability in the base and in the model, as log10."""
        both = np.concatenate([t.token, t.before, t.earlier] if self.triples else [t.token, t.before])
        known, back = np.unique(both, return_inverse=True)
        place, count = self.words.find(known)
        ids = np.where(count > 0, place, -1)
        ids[known == START] = self.V  # no word has this hash
        by_id = np.argsort(ids, kind="stable")
        stats = {}
        for name in ("total", "ones", "twos", "more", "preceded"):
            own = np.zeros(len(ids), np.int64)
            own[by_id] = np.where(ids[by_id] >= 0, getattr(self, name).take(np.maximum(ids[by_id], 0)), 0)
            stats[name] = own
        n = len(t.token)
        w, u = back[:n], back[n : 2 * n]
        c = count[w]
        base = np.log10((count + 0.5) / (self.N + 0.5 * (self.V + 1)))[w]
        low = self.unigram(stats["preceded"])[w]
        total = np.maximum(stats["total"], 1)
        left = (self.d_pair[1] * stats["ones"] + self.d_pair[2] * stats["twos"] + self.d_pair[3] * stats["more"]) / total
        left = np.where(stats["total"] > 0, left, 1.0)[u]
        seen = np.zeros(n)
        may = np.flatnonzero((c > 0) & (stats["total"][u] > 0))
        key = ((ids[u[may]].astype(np.uint64) << np.uint64(32)) | ids[w[may]].astype(np.uint64)) * GOLDEN
        keys, again = np.unique(key, return_inverse=True)
        times = self.pairs.find(keys)[1][again]
        seen[may] = (times - self.d_pair[np.minimum(times, 3)]) / total[u[may]]
        low = seen + left * low
        if self.triples:
            first, then = ids[back[2 * n :]], ids[u]
            both = (first >= 0) & (then >= 0)
            key = ((first[both].astype(np.uint64) << np.uint64(32)) | then[both].astype(np.uint64)) * GOLDEN
            contexts, again = np.unique(key, return_inverse=True)
            which = np.full(n, -1)
            which[both] = again
            total, mass, times = self.triples.find(contexts, which, np.where(c > 0, ids[w], -1), self.d_triple)
            total, mass = np.append(total, 0)[which], np.append(mass, 0.0)[which]
            some = np.maximum(total, 1)
            low = (times - self.d_triple[np.minimum(times, 3)]) / some + np.where(total > 0, mass / some, 1.0) * low
        return c, base, np.log10(low)


def _gather(docs: DataFrame, bits: int, keys_of: Callable[[Tokens], np.ndarray]) -> DataFrame:
    """(bucket, keys, counts): keys of all tokens of docs(text), summed up in tasks, by their top bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            own = summed(np.concatenate([k for k, _ in sums]), np.concatenate([c for _, c in sums]))
            rows = list(_ranges(own[0], bits, own[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2][0] for r in rows], pa.binary())], names=["bucket", "keys", "counts"])

        for b in batches:
            for t in tokens(b.column(0).to_pylist()):
                keys, counts = np.unique(keys_of(t), return_counts=True)
                sums.append((keys, counts))
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    sums, size = [], 0
        if sums:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary")


def _counted(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in ascending order, and the sums of their counts."""
    if not len(context):
        return context, word, counts
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    first = np.concatenate([[0], np.flatnonzero((context[1:] != context[:-1]) | (word[1:] != word[:-1])) + 1])
    return context[first], word[first], np.add.reduceat(counts[order], first)


def _gather_triples(docs: DataFrame, bits: int, parts_of: Callable[[Tokens], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(bucket, keys, many, words, counts): contexts by their top bits, and the words that follow each, summed up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            context, word, counts = _counted(*(np.concatenate(c) for c in zip(*sums, strict=True)))
            cut = np.searchsorted(context, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
            rows = []
            for b, (x, y) in enumerate(zip([0, *cut], [*cut, len(context)], strict=True)):
                if y > x:
                    keys, many = np.unique(context[x:y], return_counts=True)
                    rows.append((b, _packed(keys), _column(many), _column(word[x:y]), _column(counts[x:y])))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "keys", "many", "words", "counts"])

        for b in batches:
            for t in tokens(b.column(0).to_pylist()):
                context, word = parts_of(t)
                sums.append(_counted(context, word, np.ones(len(word), np.int64)))
                size += len(sums[-1][0])
                if size >= FLUSH:
                    yield from flush()
                    sums, size = [], 0
        if sums:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, many binary, words binary, counts binary")


def train(spark: SparkSession, docs: DataFrame, order: int = 2) -> Model:
    """Counts docs(text) for a model of order 2 or 3; a null text is an empty document. Order 3 takes some three times the
    disk of order 2, for its triples in shuffles and shards.

    Ranges are as many as shuffle partitions or, where there are more, as input partitions, rounded up to a power of 2:
    so what a task merges doesn't grow with the corpus.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    folder = shared_dir(spark, "kneser-ney")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())
    bits = max(ranges - 1, 1).bit_length()

    def merge_words(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        keys, counts = summed(np.concatenate([_unpacked(k) for k in t["keys"].to_pylist()]), np.concatenate([_from_column(c) for c in t["counts"].to_pylist()]))
        path = f"{folder}/words-{bucket}-{os.urandom(8).hex()}"
        counts_small = _small(counts)
        _write(path + ".keys", keys)
        _write(path + ".values", counts_small)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "path": [path], "kind": [f"u{counts_small.itemsize}"], "n": [len(keys)], "tokens": [int(counts.sum())]})

    table = stored(_gather(docs, bits, lambda t: t.token).groupBy("bucket").applyInArrow(merge_words, "bucket int, path string, kind string, n bigint, tokens bigint"), "words")
    shards = table.collect()  # a row a range
    release(table)
    words = _shards(bits, shards)
    V, N = sum(r.n for r in shards), sum(r.tokens for r in shards)
    if V >= (1 << 32) - 1:
        raise ValueError("a pair of ids must fit in 64 bits: over 2**32 - 2 distinct words")
    step = (V >> bits) + 1

    def ids_of(*hashes: np.ndarray) -> list[np.ndarray]:
        known, back = np.unique(np.concatenate(hashes), return_inverse=True)
        ids = np.where(known == START, V, words.find(known)[0]).astype(np.uint64)
        return np.split(ids[back], len(hashes))

    def pair_keys(t: Tokens) -> np.ndarray:
        u, w = ids_of(t.before, t.token)
        return ((u << np.uint64(32)) | w) * GOLDEN

    def triple_parts(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        u, v, w = ids_of(t.earlier, t.before, t.token)
        return ((u << np.uint64(32)) | v) * GOLDEN, w.astype(np.uint32)

    def merge_triples(t: pa.Table) -> pa.Table:
        """Writes a range's triples; returns, by range, the pairs that end them with their distinct first words, and a
        row about the range itself, its contexts among it."""
        bucket = t["bucket"][0].as_py()
        many = [_from_column(c) for c in t["many"].to_pylist()]
        context = np.concatenate([np.repeat(_unpacked(k), m) for k, m in zip(t["keys"].to_pylist(), many, strict=True)])
        word = np.concatenate([_from_column(c) for c in t["words"].to_pylist()]).astype(np.uint32)
        context, word, counts = _counted(context, word, np.concatenate([_from_column(c) for c in t["counts"].to_pylist()]))
        path, small = f"{folder}/triples-{bucket}-{os.urandom(8).hex()}", _small(counts)
        _write(path + ".ids", word)
        _write(path + ".counts", small)
        keys, first, number = np.unique(context, return_index=True, return_counts=True)
        stats = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2)]
        own = [_column(number), *(_column(x[number > 1]) for x in stats)]
        about = f"u{small.itemsize},{len(word)},{','.join(str(int((counts == k).sum())) for k in (1, 2, 3, 4))},{path}".encode()
        rows = [(bucket, _packed(keys), own[0], own[1], own[2], own[3], about)]
        then = (context * UNMIX) & np.uint64((1 << 32) - 1)
        ending, before = np.unique(((then << np.uint64(32)) | word.astype(np.uint64)) * GOLDEN, return_counts=True)
        rows += [(b, k, c[0], b"", b"", b"", b"") for b, k, c in _ranges(ending, bits, before)]
        names = ["bucket", "keys", "c0", "c1", "c2", "c3", "about"]
        kinds = [pa.int32(), *[pa.binary()] * 6]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    def merge_pairs(t: pa.Table) -> pa.Table:
        """Writes a range's pairs, their counts and what is known of their successors; returns statistics by word id."""
        bucket, rows = t["bucket"][0].as_py(), t.to_pylist()
        counted = [r for r in rows if not r.get("about")]
        none = np.zeros(0, np.uint64)
        keys, counts = summed(np.concatenate([none, *(_unpacked(r["keys"]) for r in counted)]), np.concatenate([none.astype(np.int64), *(_from_column(r["c0"]) for r in counted)]))
        path, about = f"{folder}/pairs-{bucket}-{os.urandom(8).hex()}", b""
        for r in rows:
            if not r.get("about"):
                continue
            contexts, number = _unpacked(r["keys"]), _from_column(r["c0"])
            everything = np.union1d(keys, contexts)
            spread = np.zeros(len(everything), np.int64)
            spread[np.searchsorted(everything, keys)] = counts
            keys, counts = everything, spread
            at, many = np.searchsorted(keys, contexts), np.zeros(len(keys), np.int64)
            many[at] = number
            arrays = {"many": _small(many), "blocks": (np.cumsum(many) - many)[::16].astype(np.uint32), "multi": at[number > 1].astype(np.uint32)}
            arrays |= {name: _small(_from_column(r[c])) for name, c in (("total", "c1"), ("ones", "c2"), ("twos", "c3"))}
            for name, x in arrays.items():
                _write(f"{path}.{name}", x)
            about = ",".join([f"u{arrays['many'].itemsize}", str(len(arrays["multi"])), *(f"u{arrays[k].itemsize}" for k in ("total", "ones", "twos"))]).encode() + b"," + r["about"]
        small = _small(counts)
        _write(path + ".keys", keys)
        _write(path + ".values", small)
        real = counts > 0
        pair, seen = keys[real] * UNMIX, counts[real]
        out = [(-1, bucket, path.encode(), [f"u{small.itemsize}".encode(), str(len(keys)).encode(), b",".join(str(int(k)).encode() for k in (*((seen == k).sum() for k in (1, 2, 3, 4)), len(seen))), about])]
        u, total, ones, twos, more = summed((pair >> np.uint64(32)).astype(np.int64), seen, *((seen == k).astype(np.int64) for k in (1, 2)), (seen > 2).astype(np.int64))
        w, preceded = summed((pair & np.uint64((1 << 32) - 1)).astype(np.int64), np.ones(len(pair), np.int64))
        for kind, ids, columns in ((0, u, (total, ones, twos, more)), (1, w, (preceded,))):
            cut = np.searchsorted(ids, np.arange(0, (V // step) + 2) * step)
            for k in range(len(cut) - 1):
                x, y = int(cut[k]), int(cut[k + 1])
                if y > x:
                    out.append((kind, k, _packed(ids[x:y].astype(np.uint64)), [*(_column(c[x:y]) for c in columns), b"", b"", b""][:4]))
        return pa.table({"kind": pa.array([r[0] for r in out], pa.int32()), "part": pa.array([r[1] for r in out], pa.int32()), "ids": pa.array([r[2] for r in out], pa.binary()), **{f"c{j}": pa.array([r[3][j] for r in out], pa.binary()) for j in range(4)}})

    if order == 3:
        gathered = _gather_triples(docs, bits, triple_parts).groupBy("bucket").applyInArrow(merge_triples, "bucket int, keys binary, c0 binary, c1 binary, c2 binary, c3 binary, about binary")
    else:
        gathered = _gather(docs, bits, pair_keys).withColumnRenamed("counts", "c0")
    merged = stored(gathered.groupBy("bucket").applyInArrow(merge_pairs, "kind int, part int, ids binary, c0 binary, c1 binary, c2 binary, c3 binary"), "pairs")
    found = merged.filter("kind = -1").collect()  # a row a range
    pairs = _shards(bits, [_Shard(r.part, r.ids.decode(), r.c0.decode(), int(r.c1)) for r in found])
    of_pairs = [sum(int(r.c2.split(b",")[k]) for r in found) for k in range(4)]

    def merge_stats(t: pa.Table) -> pa.Table:
        kind, part = t["kind"][0].as_py(), t["part"][0].as_py()
        n = max(min(step, V + 1 - part * step), 0)
        ids = np.concatenate([_unpacked(k) for k in t["ids"].to_pylist()]).astype(np.int64) - part * step
        rows = []
        for j, name in enumerate(("total", "ones", "twos", "more") if kind == 0 else ("preceded",)):
            own = np.bincount(ids, np.concatenate([_from_column(c) for c in t[f"c{j}"].to_pylist()]), n).astype(np.int64)
            path = f"{folder}/{name}-{part}-{os.urandom(8).hex()}"
            small = _small(own)
            _write(path, small)
            rows.append((name, part, path, f"u{small.itemsize}", n, *(int((own == k).sum()) for k in (1, 2, 3, 4)), int((own > 2).sum())))
        names = ["name", "part", "path", "kind", "n", "n1", "n2", "n3", "n4", "many"]
        return pa.table({k: list(c) for k, c in zip(names, zip(*rows, strict=True), strict=True)})

    table = stored(merged.filter("kind >= 0").groupBy("kind", "part").applyInArrow(merge_stats, "name string, part bigint, path string, kind string, n bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, many bigint"), "stats")
    stats = table.collect()  # five rows a range
    release(table, merged)

    def dense(name: str) -> Dense:
        own = {r.part: (r.path, r.kind, r.n) for r in stats if r.name == name}
        return Dense(step, tuple(own.get(k, ("", "u1", 0)) for k in range(V // step + 1)))

    of_words = [r for r in stats if r.name == "preceded"]
    counts = [sum(r[f"n{k}"] for r in of_words) for k in (1, 2, 3, 4)]
    word_ones = (counts[0], counts[1], sum(r.many for r in of_words))
    types = sum(int(r.c2.split(b",")[4]) for r in found)
    triples, d_triple, of_triples = None, None, [0] * 4
    if order == 3:
        files: list[tuple | None] = [None] * (1 << bits)
        for r in found:
            if r.c3:
                many, multi, total, ones, twos, kind, n, *of, under = bytes(r.c3).decode().split(",", 11)
                files[r.part] = (int(r.c1), many, int(multi), (total, ones, twos), int(n), kind, r.ids.decode(), under)
                of_triples = [a + int(b) for a, b in zip(of_triples, of, strict=True)]
        triples, d_triple = Successors(bits, tuple(files)), discounts(of_triples)
    return Model(V, N, words, pairs, dense("total"), dense("ones"), dense("twos"), dense("more"), dense("preceded"), discounts(of_pairs), discounts(counts), types, word_ones, triples, d_triple)


@dataclass
class _Shard:
    bucket: int
    path: str
    kind: str
    n: int


def _shards(bits: int, rows: list) -> Shards:
    own = {r.bucket: (r.path, r.kind, r.n) for r in rows}
    return Shards(bits, tuple(own.get(b, ("", "u1", 0)) for b in range(1 << bits)))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns `keep` with n_tokens, n_known, train_tokens, base_score, score and perplexity, for every row.

    A null, empty or blank text is its end token alone. perplexity is that of the model, a token.
    """
    shared = spark.sparkContext.broadcast(model)  # paths and a few numbers a range
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    source, names, ddl = carried(docs, keep, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n = b.num_rows
            sums = np.zeros((4, n))
            for t in tokens(b.column(len(names)).to_pylist()):
                c, base, own = model.score(t)
                for k, x in enumerate((None, c > 0, base, own)):
                    sums[k] += np.bincount(t.row, x, n)
            whole = [pa.array(x.astype(np.int64)) for x in (sums[0], sums[1], np.full(n, model.N))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *whole, pa.array(sums[2]), pa.array(sums[3])], names=[*names, *made[:5]])

    out = source.mapInArrow(run, ", ".join([ddl] * bool(names) + ["n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"]))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
