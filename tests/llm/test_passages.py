"""Passages of lines against brute force."""

import random

import pytest

import corpus_pipeline
from cairnfield.llm import line_dedup


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def brute(docs, least):
    """Lines left by doc_id: without those in a run of `least` words, or more, that stands earlier."""
    lines = {i: t.split("\n") for i, t in docs}
    first, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        full = [k for k, x in enumerate(lines[i]) if x.split()]
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(lines[i][k] for k in full[a : b + 1])
                if sum(len(x.split()) for x in run) < least:
                    continue
                doc, end = first.setdefault(run, (i, full[b]))
                if doc != i or full[a] > end:
                    gone[i] |= set(range(full[a], full[b] + 1))
    return {i: [x for k, x in enumerate(x) if k not in gone[i]] for i, x in lines.items()}


@pytest.mark.parametrize("n", range(3, 9))
def test_short_wrapped_passages_go_whole(spark, n):
    rng = random.Random(n)
    line = lambda k: " ".join(str(rng.getrandbits(40)) for _ in range(k))
    docs, passages = [], []
    for i in range(20):
        passages.append([line(-(-51 // n)) for _ in range(n)])
        for j in (0, 1):
            docs.append((2 * i + j, [line(6) for _ in range(4)], [line(7) for _ in range(3)], passages[i]))
    d = [(i, "\n".join([*a, *p, *b])) for i, a, b, p in docs]
    want = {i: "\n".join([*a, *(p if i % 2 == 0 else []), *b]) for i, a, b, p in docs}
    rows = line_dedup.dedup_passages(frame(spark, d)).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert {r.removed_lines for r in rows if r.doc_id % 2} == {n}
    old = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, d)).collect()}
    assert any(old[i] != want[i] for i in old)


def test_runs_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 5, 9]))) for _ in range(12)]
    blocks = [[rng.choice([*pool, "", " \t"]) for _ in range(rng.randint(2, 9))] for _ in range(8)]
    docs = []
    for i in range(30):
        text = [str(rng.getrandbits(50))]
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(blocks) + [str(rng.getrandbits(50))] * rng.randint(0, 1)
        docs.append((i, "\n".join(text)))
    docs += [(50, "\n".join(["ha ha"] * 40)), (51, "\n".join(["ha ha"] * 7))]
    least = 10
    only = brute(docs, least)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_passages(frame(spark, docs), least).collect()}
    chunks = {i for i, t in docs if _chunk_repeats(spark, docs, i, least)}
    for i, kept in only.items():
        # Chunks of fewer words may go beyond the runs, never the other way.
        assert [x for x in got[i] if x.split()] == [x for x in kept if x.split()] if i not in chunks else set(got[i]) <= set(kept)
    assert len(chunks) < len(docs) and sum(map(len, only.values())) < sum(len(t.split("\n")) for _, t in docs)
    assert {x for _, t in docs for x in t.split("\n") if x.split()} == {x for kept in got.values() for x in kept if x.split()}


_REPEATS: dict = {}


def _chunk_repeats(spark, docs, i, least):
    """Whether dedup() itself takes a chunk out of document i."""
    if not _REPEATS:
        _REPEATS.update({r.doc_id: r.removed_chunks for r in line_dedup.dedup(frame(spark, docs), least).collect()})
    return _REPEATS[i] > 0


def test_odd_rows(spark):
    odd = frame(spark, [(None, None), (None, "x " * 60), (1, None), (2, ""), (3, " \n\n "), (4, "a b"), (4, "a b"), (5, "x " * 60), (5, "x " * 60)])
    rows = sorted((r.doc_id or 99, r.text, r.removed_lines) for r in line_dedup.dedup_passages(odd).collect() if r.text is not None)
    assert rows == [(2, "", 0), (3, " \n\n ", 0), (4, "a b", 0), (4, "a b", 0), (5, "x " * 60, 0), (5, "x " * 60, 0), (99, "", 1)]
    assert line_dedup.dedup_passages(odd).filter("text IS NULL").count() == 2 and line_dedup.dedup_passages(odd.limit(0)).count() == 0


def test_pipeline_takes_passages_out(spark, sf):
    line = lambda k: " ".join(f"{k}w{i}" for i in range(12))
    p = "\n".join(line(k) for k in range(5))
    d = spark.createDataFrame([(1, f"{line(8)}\n{p}", "en", "s", 9), (2, f"{line(9)}\n{p}\n{line(10)}", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, d, sf).collect()}
    left = f"{line(9)}\n{line(10)}"
    assert out[2] == (left, len(left)) and out[1][1] == 9
