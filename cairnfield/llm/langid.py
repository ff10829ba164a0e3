"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, in Spark, how often each language's texts hold each of 2**bits hashed n-grams (1 to `orders`
characters); the smoothed log-probabilities make a matrix of languages by buckets, which is broadcast: its size is
fixed by the number of languages and not by the corpus. Scoring builds, for a batch of texts, the rows of a sparse
document-by-bucket matrix (CSR: indices in one array, row starts in another) and multiplies it by the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried

#: Characters handled at a time, to bound memory; longer texts go in pieces that overlap by an n-gram less one.
BLOCK = 1 << 19
UNKNOWN = "und"
#: Fixed value of the multiplicative hash.
GOLDEN = np.uint32(0x9E3779B1)


@lru_cache(1)
def _folded() -> np.ndarray:
    """By code point: the letter in lower case, or a space for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _pieces(texts: list[str | None], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, folded characters with `reach` spaces after each text, starts) of blocks of texts or parts."""
    rows, parts, size = [], [], 0
    for r, t in enumerate(texts):
        t = t or ""
        for at in range(0, max(len(t), 1), BLOCK):
            rows.append(r)
            # A part carries the characters that its last n-grams reach into; the end of the text is spaces.
            parts.append(t[at : at + BLOCK + reach].ljust(min(len(t) - at, BLOCK) + reach))
            size += len(parts[-1])
            if size >= BLOCK:
                yield _block(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield _block(rows, parts)


def _block(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.array(rows), _folded()[points], starts


def ngrams(points: np.ndarray, starts: np.ndarray, orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at every place, and whether the place counts: it starts in the text
    proper and its first and last characters aren't both outside of a word."""
    reach = orders - 1
    real = np.ones(len(points), bool)
    for k in range(1, reach + 1):
        real[np.maximum(starts[1:] - k, 0)] = False
    letter = points != 32
    h = np.zeros(len(points), np.uint32)
    for n in range(orders):
        ahead = points if n == 0 else np.concatenate([points[n:], np.full(n, 32, np.uint32)])
        h = (h * np.uint32(0x01000193)) ^ (ahead * np.uint32(0x85EBCA6B))
        ends = letter if n == 0 else np.concatenate([letter[n:], np.zeros(n, bool)])
        mixed = (h ^ (h >> np.uint32(15))) * GOLDEN
        yield (mixed >> np.uint32(32 - bits)).astype(np.int32), real & (letter | ends)


@dataclass(frozen=True)
class Model:
    """langs in ascending order; logp: buckets by languages; prior: log-probability of each language."""

    langs: tuple[str, ...]
    logp: np.ndarray
    prior: np.ndarray
    orders: int
    bits: int

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood by text and language, number of letters by text)."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for rows, points, starts in _pieces(texts, self.orders - 1):
            for n, (bucket, counts) in enumerate(ngrams(points, starts, self.orders, self.bits)):
                indptr = np.concatenate([[0], np.cumsum(counts)])[starts]
                if n == 0:  # single characters that count are letters
                    letters += np.bincount(rows, np.diff(indptr), len(texts)).astype(np.int64)
                indices = bucket[counts]
                full = indptr[1:] > indptr[:-1]
                if full.any():
                    for k in range(len(self.langs)):
                        part = np.add.reduceat(self.logp[k].take(indices), indptr[:-1][full], dtype=np.float64)
                        out[:, k] += np.bincount(rows[full], part, len(texts))
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores, letters = self.score(texts)
        scores += self.prior
        best = scores.argmax(1)
        odds = np.exp(scores - scores.max(1, keepdims=True))
        share = odds.max(1) / odds.sum(1)
        named = [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        return named, np.where(letters > 0, share, 0.0)


def train(docs: DataFrame, orders: int = 4, bits: int = 16, alpha: float = 0.5, most: int = 512) -> Model:
    """Counts n-grams of docs(text, lang) by language; rows with a null lang or text teach nothing.

    Only sums go to the driver: languages by 2**bits numbers, and the matrix is broadcast, so `most` bounds the number of
    languages; more raise an error. Without any row the model has no language.
    """
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(width, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + len(own)
                for _, points, starts in _pieces(own, orders - 1):
                    for bucket, counts in ngrams(points, starts, orders, bits):
                        total += np.bincount(bucket[counts], minlength=width)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            at, n = np.append(at, -1), np.append(total[at], docs_of[lang])  # bucket -1: documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    own = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    if (many := own.select("lang").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"over {most} languages ({many} or more): the matrix of log-probabilities would outgrow a broadcast")
    found = own.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, at, n = found["lang"].to_pylist(), found["bucket"].to_numpy(), found["n"].to_numpy()
    langs = tuple(sorted(set(names)))
    row = np.array([langs.index(x) for x in names], np.int64)
    counts, size = np.zeros((len(langs), width)), np.zeros(len(langs))
    counts[row[at >= 0], at[at >= 0]] = n[at >= 0]
    size[row[at < 0]] = n[at < 0]
    logp = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * width)
    return Model(langs, logp.astype(np.float32), np.log(size / max(size.sum(), 1)), orders, bits)


def identify(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns `keep` with lang_pred and score, the posterior of the language, for every row.

    A text that is null, empty or without a letter is "und" with score 0; so is every text under a model without
    languages. Of equal posteriors the first language by name wins. Without `keep` all columns pass through, but for
    such as are named lang_pred or score.
    """
    shared = spark.sparkContext.broadcast(model)
    source, names, ddl = carried(docs, keep, ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, score = shared.value.predict(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(named, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, ", ".join([ddl] * bool(names) + ["lang_pred string, score double"]))
