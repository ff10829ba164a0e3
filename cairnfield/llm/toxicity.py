"""Toxicity: a linear classifier by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic texts (P) and texts without any label (U) train it; texts known to be harmless aren't needed. With class
prior pi and logistic loss l, the risk of a classifier g over the whole corpus is

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),

the second term being the negatives' risk, estimated from U and corrected by P; where the estimate falls below zero the
step goes the other way, which keeps the model from memorising P. Features are a text's distinct words and word
beginnings, and the n-grams of characters in long words and in scripts without spaces, hashed, as log counts weighted by inverse document frequency and scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried

#: Bytes handled at a time; a longer text goes in parts, cut between words, whose features are summed.
BLOCK = 1 << 20
#: Lengths, in bytes, of the word beginnings that are features beside the words themselves.
HEADS = (4, 6)
#: Longer words, in bytes, are read by n-grams of so many characters, from each character on; other words from each character
#: of three bytes or more on, which is where scripts without spaces are. AHEAD bytes hold the longest n-gram.
LONG, GRAMS, AHEAD = 40, (2, 3, 4), 16
#: Multiplier of the rolling hash, and of the final mix.
PRIME, GOLDEN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

#: By byte: lower-cased letters and all bytes of other scripts, else 0.
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_LETTER[128:] = np.arange(128, 256)


def _hashes(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every word, of the beginnings of longer ones and of n-grams, in the bytes data."""
    fold = _LETTER[data]
    inside = np.concatenate([[False], fold > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    at, size = edge[::2], edge[1::2] - edge[::2]
    places, buckets = map(list, _grams(data, fold, at[size > LONG], size[size > LONG], bits))
    h = np.full(len(at), 0xCBF29CE484222325, np.uint64)
    k = 0

    def out(which: np.ndarray, kind: int) -> None:
        mixed = (h[which] + np.uint64(kind)) * GOLDEN
        places.append(at[which])
        buckets.append((mixed >> np.uint64(64 - bits)).astype(np.int64))

    while len(at):
        if k in HEADS:
            out(size > k, k)
        out(size == k, 0)
        live = size > k
        at, size, h = at[live], size[live], h[live]
        h = (h ^ fold[at + k].astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
        k += 1
        if k > LONG:  # what is left are words of over 40 bytes: beside their n-grams, their first 41 are a feature
            out(np.ones(len(at), bool), 1)
            break
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)])


def _grams(data: np.ndarray, fold: np.ndarray, at: np.ndarray, size: np.ndarray, bits: int) -> tuple[list, list]:
    """(places, buckets), an array per length in GRAMS, of n-grams of characters; at and size are the long words'."""
    within = np.zeros(len(data) + 1, np.int32)
    within[at] += 1
    within[at + size] -= 1
    begins = (data & 0xC0) != 0x80
    use = begins & (fold > 0) & ((data >= 0xE0) | (np.cumsum(within[:-1]) > 0))
    if not use.any():
        return [], []
    starts = np.flatnonzero(begins)
    code = fold[starts].astype(np.uint64)
    after = np.append(starts[1:], len(data))
    for k in range(1, 4):
        more = starts + k < after
        code[more] = (code[more] << np.uint64(8)) | data[starts[more] + k].astype(np.uint64)
    i = np.flatnonzero(use[starts])
    h = np.full(len(i), 0x84222325CBF29CE4, np.uint64)
    places, buckets = [], []
    for n in range(1, max(GRAMS) + 1):
        live = i + n <= len(code)
        live[live] = code[i[live] + n - 1] > 0
        i, h = i[live], h[live]
        h = (h ^ code[i + n - 1]) * PRIME
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            places.append(starts[i])
            buckets.append((((h + np.uint64(n)) * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64))
    return places, buckets


def features(texts: list[str | None], bits: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR (indptr, buckets, counts) of the texts; known, by bucket, tells which buckets count."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    part: list[bytes] = []
    ahead: list[int] = []
    pending, size = [], 0

    def flush() -> None:
        nonlocal part, ahead, pending, size
        if not pending:
            return
        starts = np.cumsum([0, *map(len, part)])
        place, bucket = _hashes(np.frombuffer(b"".join(part), np.uint8), bits)
        if known is not None:
            own = known[bucket]
            place, bucket = place[own], bucket[own]
        doc = np.searchsorted(starts, place, "right") - 1
        if any(ahead):  # what begins in the bytes ahead is the next part's
            own = place < (starts[1:] - 1 - np.array(ahead))[doc]
            place, bucket, doc = place[own], bucket[own], doc[own]
        keys, counts = np.unique((doc << bits) | bucket, return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(part) + 1) << bits)
        for i, r in enumerate(pending):
            own = keys[cut[i] : cut[i + 1]] & ((1 << bits) - 1), counts[cut[i] : cut[i + 1]]
            if r == len(out) - 1:
                both, where = np.unique(np.concatenate([out[r][0], own[0]]), return_inverse=True)
                own = both, np.bincount(where, np.concatenate([out[r][1], own[1]])).astype(np.int64)
                out[r] = own
            else:
                out.append(own)
        part, ahead, pending, size = [], [], [], 0

    for r, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = len(data) if len(data) - at <= BLOCK else max(data.rfind(b" ", at, at + BLOCK), data.rfind(b"\n", at, at + BLOCK)) + 1
            inside = end <= at and len(data) > at
            end = at + BLOCK if inside else end
            more = data[end : end + AHEAD] if inside else b""
            part.append(data[at:end] + more + b"\n")
            ahead.append(len(more))
            pending.append(r)
            size += end - at
            at = end
            if size >= BLOCK:
                flush()
            if at >= len(data):
                break
    flush()
    indptr = np.cumsum([0, *(len(x[0]) for x in out)])
    none = np.zeros(0, np.int64)
    return indptr, np.concatenate([none, *(x[0] for x in out)]), np.concatenate([none, *(x[1] for x in out)])


def _weighted(indptr: np.ndarray, buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[buckets]
    norm = np.sqrt(_sums(x * x, indptr))
    return x / np.repeat(np.where(norm > 0, norm, 1), np.diff(indptr))


def _sums(x: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[indptr[1:]] - total[indptr[:-1]]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    idf: np.ndarray
    bias: float
    bits: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        indptr, buckets, counts = features(texts, self.bits, self.idf > 0)
        x = _weighted(indptr, buckets, counts, self.idf)
        return _sigmoid(_sums(x * self.weights[buckets], indptr) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(indptr: np.ndarray, buckets: np.ndarray, counts: np.ndarray, positive: np.ndarray, prior: float, bits: int, rounds: int = 80, rate: float = 0.3, decay: float = 1e-4, least: int = 5) -> Model:
    """Full-batch Adam on the non-negative risk; features in fewer than `least` texts are left out.

    Every third text is set aside: on these, which the weights don't know, the same risk fits a scale and an offset of
    the classifier's output, so that scores are near to probabilities.
    """
    width, n = 1 << bits, len(indptr) - 1
    df = np.bincount(buckets, minlength=width)
    idf = np.where(df >= least, np.log((n + 1) / (df + 1)) + 0.1, 0.0)
    own = idf[buckets] > 0
    indptr = np.concatenate([[0], np.cumsum(own)])[indptr]
    buckets, counts = buckets[own], counts[own]
    x = _weighted(indptr, buckets, counts, idf)
    rows = np.repeat(np.arange(n), np.diff(indptr))
    aside = np.arange(n) % 3 == 2 if n >= 30 else np.zeros(n, bool)

    def output(w: np.ndarray) -> np.ndarray:
        return _sums(x * w[:-1][buckets], indptr) + w[-1]

    def pulled(slope: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(buckets, slope[rows] * x, width) + decay * w[:-1], slope.sum())

    offset = np.log(prior / (1 - prior))
    w = _descend(output, pulled, np.append(np.zeros(width), offset), positive, ~aside, prior, rounds, rate)
    scale = np.array([1.0, 0.0])
    if aside.any() and positive[aside].any():
        g = output(w)
        scale = _descend(lambda s: s[0] * g + s[1], lambda slope, s: np.array([slope @ g, slope.sum()]), scale, positive, aside, prior, 300, 0.05)
    return Model(w[:-1] * scale[0], idf, float(w[-1] * scale[0] + scale[1]), bits)


def _descend(output: Callable, pulled: Callable, w: np.ndarray, positive: np.ndarray, use: np.ndarray, prior: float, rounds: int, rate: float) -> np.ndarray:
    """Adam on the non-negative risk over the rows `use`; output(w) scores rows, pulled(slopes, w) is the gradient."""
    p_rows, u_rows = positive & use, ~positive & use
    share_p, share_u = p_rows / max(p_rows.sum(), 1), u_rows / max(u_rows.sum(), 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = _sigmoid(output(w))  # dl(-g)/dg = p, dl(g)/dg = p - 1
        away = -np.log(np.maximum(1 - p, 1e-12))
        negative = share_u @ away - prior * (share_p @ away)
        pull = share_u * p - prior * share_p * p
        grad = pulled(prior * share_p * (p - 1) + pull if negative >= 0 else -pull, w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, positives: int = 2500, unlabelled: int = 7500, bits: int = 16) -> Model:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic 0/1).

    The sample is bounded: of the confirmed toxic texts `positives`, of all texts `unlabelled`, those of the smallest
    hash of doc_id. The class prior is the share of toxic rows among all labelled ones, kept within 0.001 and 0.5.
    Without a toxic text the model scores every text with the prior.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").join(known, "doc_id")
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = min(max(share, 0.001), 0.5)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(positives).withColumn("positive", F.lit(True))
    rest = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(*order).limit(unlabelled).withColumn("positive", F.lit(False))
    # At most positives + unlabelled ids, so this side is broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(toxic.union(rest)), "doc_id").select("doc_id", "positive", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            indptr, buckets, counts = features(b.column(2).to_pylist(), bits)
            cut = lambda x, t: pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut(buckets, pa.int32()), cut(np.minimum(counts, 32767), pa.int16())], names=["doc_id", "positive", "buckets", "counts"])

    got = chosen.mapInArrow(build, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, positive boolean, buckets array<int>, counts array<smallint>").toArrow().combine_chunks().sort_by([("positive", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    positive = np.array(got["positive"].to_pylist(), bool)
    width = 1 << bits
    if not positive.any():
        return Model(np.zeros(width), np.zeros(width), float(np.log(prior / (1 - prior))), bits)
    lists = got["buckets"].combine_chunks()
    sizes = np.array([len(x) for x in lists]) if len(lists) else np.zeros(0, int)
    return fit(np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(), got["counts"].combine_chunks().flatten().to_numpy().astype(np.int64), positive, prior, bits)


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns `keep` with score (0 to 1) and predicted (1 if score >= threshold), for every row and whole text.

    Null, empty and wordless texts have no feature and score by the bias alone. Without `keep` all columns pass through,
    but for such as are named score or predicted.
    """
    shared = spark.sparkContext.broadcast(model)
    source, names, ddl = carried(docs, keep, ("score", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(shared.value.score(b.column(len(names)).to_pylist()))], names=[*names, "score"])

    out = source.mapInArrow(run, ", ".join([ddl] * bool(names) + ["score double"]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
