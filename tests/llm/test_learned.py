"""Language ID, toxicity and the whole pipeline against plain versions in Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cairnfield.llm import langid, queries, toxicity
from tests.llm.test_copies import plain_fingerprint, shingles, union_find

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def plain_ngrams(text, orders=4, bits=16):
    """Buckets of the character n-grams, one after another."""
    fold = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
    fold += [" "] * orders
    out = []
    for i in range(len(text or "")):
        h = 0
        for n in range(orders):
            h = ((h * 0x01000193) & M32) ^ ((ord(fold[i + n]) * 0x85EBCA6B) & M32)
            if fold[i] != " " or fold[i + n] != " ":
                out.append((((h ^ (h >> 15)) * 0x9E3779B1) & M32) >> (32 - bits))
    return out


def plain_language(train, text, alpha=0.5, bits=16):
    """(language, posterior) by multinomial naive Bayes over train, (text, lang) pairs."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train:
        if t is not None and lang is not None:
            counts[lang].update(plain_ngrams(t))
            docs[lang] += 1
    own = Counter(plain_ngrams(text))
    score = {}
    for lang, c in counts.items():
        total = sum(c.values()) + alpha * (1 << bits)
        score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((c[b] + alpha) / total) for b, n in own.items())
    best = max(score.values())
    odds = {k: math.exp(v - best) for k, v in score.items()}
    return min(k for k, v in score.items() if v == best), max(odds.values()) / sum(odds.values())


VOCAB = {"en": "the house and was river with stone under morning light".split(), "de": "das Haus und über Straße mit Öl früh nicht große".split(), "fr": "la maison été où avec garçon sous très rivière et".split()}


def documents(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(VOCAB))
        out.append((i, " ".join(rng.choices(VOCAB[lang], k=rng.randint(1, 12))), rng.choice([lang, lang, None])))
    return out + [(n, None, "en"), (n + 1, "", "en"), (n + 2, "12 !?", "de"), (n + 3, "ñ", None), (n + 4, "mixed the das la", None)]


def test_language_against_brute_force(spark):
    docs = documents(1, 60)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    train = [(t, lang) for i, t, lang in docs if i % 2 == 0]
    rows = langid.identify(spark, d, langid.train(d.filter("doc_id % 2 = 0")), ("doc_id", "text")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        lang, score = plain_language(train, r.text)
        assert math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-3)
        assert r.lang_pred == lang or abs(r.score - 0.5) < 1e-3


def plain_features(text, bits):
    """Counts of buckets: words of up to 40 bytes, and the beginnings of longer ones, of texts in ASCII."""
    out = Counter()
    for word in re.findall("[a-z]+", text.lower()):
        h = 0xCBF29CE484222325
        for k, c in enumerate(word.encode()):
            if k in (4, 6):
                out[(((h + k) & M64) * 0x9E3779B97F4A7C15 & M64) >> (64 - bits)] += 1
            h = ((h ^ c) * 0x100000001B3) & M64
            h ^= h >> 29
        out[(h * 0x9E3779B97F4A7C15 & M64) >> (64 - bits)] += 1
    return out


def test_toxicity_features_and_scores_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a bad word appears somewhere hereabouts, isn't it? Vile NASTY".split(), k=rng.randint(0, 20))) for _ in range(30)] + ["", "..."]
    indptr, buckets, counts = toxicity.features(texts, 16)
    for k, t in enumerate(texts):
        assert dict(zip(buckets[indptr[k] : indptr[k + 1]].tolist(), counts[indptr[k] : indptr[k + 1]].tolist(), strict=True)) == plain_features(t, 16)
    gen = np.random.default_rng(0)
    weights, idf = gen.normal(size=1 << 16), np.where(gen.random(1 << 16) < 0.7, gen.random(1 << 16) + 0.1, 0.0)
    model = toxicity.Model(weights, idf, -0.3, 16)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(spark, d, model).collect():
        x = {b: math.log1p(n) * idf[b] for b, n in plain_features(r.text, 16).items() if idf[b] > 0}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        want = 1 / (1 + math.exp(0.3 - sum(v / norm * weights[b] for b, v in x.items())))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == int(want >= 0.3)


@pytest.mark.parametrize("confident", [0.0, 6.0])
def test_toxicity_slopes_are_those_of_the_non_negative_risk(confident):
    """The step's slopes by output against differences of the risk, on both sides of zero."""
    rng = np.random.default_rng(3)
    positive, prior = np.array([True] * 4 + [False] * 9), 0.3
    g = rng.normal(size=13)
    g[:4] -= confident  # confirmed texts that look harmless: the negatives' risk falls below zero
    g[4:] -= confident * 2

    def parts(out):
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(out[positive]).mean(), loss(-out[~positive]).mean() - prior * loss(-out[positive]).mean()

    seen = []

    def pulled(slope, w):
        seen.append(slope.copy())
        return np.zeros_like(w)

    toxicity._descend(lambda w: g, pulled, np.zeros(2), positive, np.ones(13, bool), prior, 1, 0.1)
    kept = parts(g)[1] >= 0
    assert kept == (confident == 0)
    for i in range(13):
        step = np.zeros(13)
        step[i] = 1e-6
        up, down = parts(g + step), parts(g - step)
        want = (sum(up) - sum(down)) / 2e-6 if kept else -(up[1] - down[1]) / 2e-6
        assert math.isclose(seen[0][i], want, rel_tol=1e-4, abs_tol=1e-7)


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over documents with every kind of row that a stage takes out, against each stage in plain Python."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = lambda k: " ".join(word() for _ in range(k))
    passage, items = [line(20) for _ in range(4)], [(k, line(30)) for k in range(4)]
    docs = []
    for i in range(70):
        lines = [line(rng.randint(30, 60)) for _ in range(rng.randint(2, 6))]
        if i % 7 == 3:
            lines[1:1] = passage
        if i % 10 == 5:
            lines.append(f"{line(3)} {items[i % 4][1]} {line(3)}")
        docs.append([i, "\n".join(lines), rng.choice(["en", "de", None])])
    for i in range(70, 80):  # copies, and copies with another word
        words = docs[i - 60][1].split(" ")
        words[len(words) // 2] = word() if i % 2 else words[len(words) // 2]
        docs.append([i, " ".join(words), "en"])
    docs += [[80, None, "en"], [81, "", "de"], [82, "1 2 3", None], [83, "x" * 9000, "en"], [84, "1 2 3", None]]
    d = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    train = [(t, lang) for _, t, lang in docs]
    left = {i: t for i, t, _ in docs if any(c.isalpha() for c in t or "") and plain_language(train[:12] + [x for x in train if x[1]][:12], t)[0] != "und"}
    # Lines of a run of 50 words or more that stands earlier go.
    first, gone = {}, defaultdict(set)
    lines = {i: t.split("\n") for i, t in left.items()}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a, len(lines[i])):
                run = "\n".join(lines[i][a : b + 1])
                if len(run.split()) >= 50 and first.setdefault(run, i) != i:
                    gone[i] |= set(range(a, b + 1))
    left = {i: "\n".join(x for k, x in enumerate(own) if k not in gone[i]) for i, own in lines.items()}
    fp = {i: plain_fingerprint(t) for i, t in left.items()}
    root = union_find(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    left = {i: t for i, t in left.items() if root[i] == i}
    left = {i: t for i, t in left.items() if not any(len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x)) for _, x in items)}
    own = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for i, t in left.items():
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(i, k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert 82 not in left and 40 < len(left) < 75
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in map(sorted, bins.values()):
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_pipeline_leaves_nothing_behind_but_its_result(spark, sf):
    """What the stages have made is gone; the sequences are the one table left."""
    from cairnfield.llm import common

    before = set(common._LIVE)
    corpus_pipeline.run(spark, sf)
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in common._LIVE if p not in before] == ["sequences"]
