"""Best-fit packing of tokenized documents into sequences, planned on a histogram of lengths.

Tasks tokenize whole texts, cut those longer than a sequence and number the pieces of each length. How pieces fill
sequences depends on their lengths alone, so the driver plans on the number of pieces by length (as many numbers as a
sequence has tokens), by best-two-fit: a bin is filled greedily with the longest piece that fits, then its smallest
document is replaced by two unpacked ones if these fill the gap, expanded by the smallest, more tightly. A filled bin is
a pattern, used as often as the counts allow. Tasks then look their pieces' places up in the plan by length and number.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters encoded at a time.
BLOCK = 1 << 20
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes in: printable bytes as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids by the tokenizers file at path, with add_special_tokens=False.

    That option adds no token around a text; the file's special tokens that stand in a text are one id each, as
    tokenizers has it. A plain byte-level BPE file gives the same ids through tiktoken, which is faster, with the file's
    own vocabulary as ranks. It is used only where that can be told from the file: ids ascend with the merges, added
    tokens match plainly, and nothing else is set; otherwise tokenizers does the work.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain(spec):
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import tiktoken

    letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all") if any(t in text for t in special) else fast.encode_ordinary(text)


def _plain(spec: dict) -> bool:
    """Whether a tokenizers file is byte-level BPE alone: its vocabulary is the bytes and, in order, what merges make."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", ())
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if spec.get("normalizer") or spec.get("truncation") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    single = [vocab.get(c) for c in _byte_letters()]
    return None not in made and None not in single and made == sorted(made) and len(set(made)) == len(made) and max(single) < min(made, default=1 << 62)


def encode(text: str, ids_of: Callable[[str], list[int]]) -> np.ndarray:
    """Ids of a whole text; long ones go in blocks cut before white space, where no token reaches across."""
    if len(text) <= BLOCK:
        return np.array(ids_of(text), np.uint32)
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK:
            cut = re.compile(r"(?<=\S)(?=\s)").search(text, at + BLOCK)
            end = cut.start() if cut else end
        out.append(np.array(ids_of(text[at:end]), np.uint32))
        at = end
    return np.concatenate(out)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row of docs(doc_id, text): PIECES, and ids if asked for. Null text is empty: its end id alone.

    Only documents longer than size are cut; their first piece is the short one. task and number tell a length's pieces
    apart: number counts those of a length within a task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            rows, which, all_ids = [], [], []
            for r, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or "", ids_of), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((k, x, y - x, zlib.crc32(ids[x:y].tobytes()), task, seen[y - x]))
                    which.append(r)
                    seen[y - x] += 1
                    if keep_ids:
                        all_ids.append(ids[x:y].astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else []), names=names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {PIECES}" + ", ids array<int>" * keep_ids)


def best_two(lengths: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces with the largest sum within room; lengths ascend, left tells how many there are of each."""
    here = left > 0
    a, n = lengths[here], left[here]
    if not len(a):
        return None
    at = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
    at = np.where((at >= 0) & (a[at] == a) & (n < 2), at - 1, at)
    total = np.where(at >= 0, a + a[at], -1)
    best = int(total.argmax())
    return (int(a[best]), int(a[at[best]])) if total[best] >= 0 else None


def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Slots (length, first number, how many, first sequence, offset) by length and number, and the sequences used."""
    lengths = np.array(sorted(k for k, v in counts.items() if v > 0), np.int64)
    left = np.array([counts[k] for k in lengths.tolist()], np.int64)
    used = np.zeros(len(lengths), np.int64)
    slots, sequences = [], 0
    top = len(lengths) - 1
    while top >= 0:
        if left[top] == 0:
            top -= 1
            continue
        bin_, gap = [top], size - int(lengths[top])
        left[top] -= 1
        while gap > 0:
            i = int(np.searchsorted(lengths, gap, "right")) - 1
            while i >= 0 and left[i] == 0:
                i -= 1
            if i < 0:
                break
            bin_.append(i)
            left[i] -= 1
            gap -= int(lengths[i])
        if gap > 0:
            small = bin_[-1]  # greedy filling goes from the longest to the smallest
            pair = best_two(lengths, left, gap + int(lengths[small]))
            if pair and sum(pair) > lengths[small]:
                left[small] += 1
                bin_[-1:] = [int(np.searchsorted(lengths, p)) for p in pair]
                for p in bin_[-2:]:
                    left[p] -= 1
        kinds, each = np.unique(bin_, return_counts=True)
        times = 1 + int((left[kinds] // each).min())
        offset = 0
        for i in bin_:
            slots.append((int(lengths[i]), int(used[i]), times, sequences, offset))
            used[i] += times
            offset += int(lengths[i])
        left[kinds] -= each * (times - 1)
        sequences += times
    table = np.array(slots, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every row of docs.

    Sequences are numbered from 0 without gaps, hold at most size ids, and are filled from offset 0 without gaps. Rows
    that repeat are packed each; a null doc_id is no obstacle. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = stored(pieces(docs, tokenizer, size, end_id, keep_ids), "pieces")  # the result reads it
    by_task = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = stored(by_task.select("length", "task", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots, _ = plan(counts, size)
    shared = spark.sparkContext.broadcast(slots)  # patterns of lengths: their number doesn't follow the corpus
    names = [*own.columns[:5], "sequence_id", "offset", *own.columns[7:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        top = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0].astype(object) * top + table[:, 1] if (size + 1) * top >= 1 << 62 else table[:, 0] * top + table[:, 1]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("at").to_numpy()
            # A length's last slot begins at or before any number of that length.
            k = np.searchsorted(keys, length * top + np.minimum(number, top - 1), "right") - 1
            arrays = [*b.columns[:5], pa.array(table[k, 3] + number - table[k, 1]), pa.array(table[k, 4]), *b.columns[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    placed = own.join(by_task.select("length", "task", "before"), ["length", "task"]).select(*own.columns[:5], (F.col("before") + F.col("number")).alias("at"), *own.columns[7:])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:5]), "sequence_id bigint, offset bigint", *(["ids array<int>"] * keep_ids)])
    return placed.mapInArrow(run, schema)
