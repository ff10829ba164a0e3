"""Language ID, toxicity, Kneser-Ney and packing: brute force, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairnfield.llm import kneser_ney, langid, packing, queries, toxicity

ODD = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "123 !?"), (5, "x" * 5000), (6, "Été ÑANDÚ straße"), (6, "Été ÑANDÚ straße"), (7, "a b a b a b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "n", k) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, lang string, score string, k int")


def test_language_accuracy_and_contract(spark, sf):
    rows = queries.op1_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_blocks_and_counts():
    texts = ["the cat sat", "", None, "das Öl und ß", "no1letter2s", "...", "a" * 50]
    w = np.random.default_rng(0).normal(size=(2, 1 << 16)).astype(np.float32)
    model = langid.Model(("aa", "bb"), w, np.zeros(2), 4, 16)
    whole = model.score(texts)
    old, langid.BLOCK = langid.BLOCK, 7
    try:
        parts = model.score(texts)
    finally:
        langid.BLOCK = old
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all()
    assert whole[1].tolist() == [sum(c.isalpha() for c in t or "") for t in texts]
    assert model.predict(["12", None])[0] == ["und", "und"]


def test_language_odd_rows(spark, odd):
    model = langid.train(odd)
    rows = langid.identify(spark, odd.drop("score"), model, ("doc_id", "k")).collect()
    by = {r.k: r for r in rows}
    assert len(rows) == len(ODD)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in range(5))
    none = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(spark, odd, none, ("doc_id",)).collect()} == {"und"}
    assert langid.identify(spark, odd.limit(0), model, ("doc_id",)).count() == 0


def test_toxicity_learns(spark):
    rng = random.Random(3)
    good, bad = [f"word{i}" for i in range(40)], ["vile", "nasty", "rotten"]
    docs, labels = [], []
    for i in range(600):
        w = rng.choices(good, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            w += rng.choices(bad, k=1 + len(w) // 8)
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x for x in labels if x[0] < 300], "doc_id long, toxic int")
    model = toxicity.train(d, lab, 200, 400)
    rows = toxicity.score(spark, d, model, keep=("doc_id",)).filter("doc_id >= 300").collect()
    truth = dict(labels)
    pos, neg = [r.score for r in rows if truth[r.doc_id]], [r.score for r in rows if not truth[r.doc_id]]
    auc = np.mean([[p > n for n in neg] for p in pos])
    assert auc > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_features_in_parts_and_odd_rows(spark, odd):
    texts = [t for _, t in ODD] + ["ab cd " * 300, "überlang" * 20]
    whole = toxicity.features(texts, 16)
    old, toxicity.BLOCK = toxicity.BLOCK, 64
    try:
        parts = toxicity.features(texts, 16)
    finally:
        toxicity.BLOCK = old
    short = [k for k, t in enumerate(texts) if len(max((t or "").split() or [""], key=len)) < 40]
    for k in short:
        cut = lambda x, k=k: {int(a): int(b) for a, b in zip(x[1][x[0][k] : x[0][k + 1]], x[2][x[0][k] : x[0][k + 1]], strict=True)}
        assert cut(whole) == cut(parts)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty)
    rows = toxicity.score(spark, odd.drop("score"), model, keep=("doc_id",)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(spark, odd.limit(0), model, keep=("doc_id",)).count() == 0


def words(text):
    return (text or "").encode().lower().split() + ["END"]


def ngrams_of(docs, n):
    """Counts of n-grams of the documents' words, which follow start marks."""
    out = Counter()
    for w in docs:
        padded = ["START"] * (n - 1) + w
        out.update(zip(*(padded[k:] for k in range(n)), strict=False))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_against_brute_force(spark, sf, order):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()[:120] + [(10**6, None), (10**6 + 1, " A b \n" + "é" * 200), (10**6 + 2, "a a a a a a a a")]
    d = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    model = kneser_ney.train(spark, d.filter("doc_id % 5 <> 1"), order)
    known = [words(r[1]) for r in rows if r[0] % 5 != 1]
    uni = Counter(x for w in known for x in w)
    V, N = len(uni), sum(uni.values())
    counts = {order: ngrams_of(known, order)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    assert (model.V, model.N, model.pair_types) == (V, N, len(counts[2]))
    D = {n: kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    total, mass = {n: Counter() for n in counts}, {n: defaultdict(float) for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            total[n][g[:-1]] += x
            mass[n][g[:-1]] += D[n][min(x, 3)]

    def p(g):
        n, x = len(g), counts[len(g)][g]
        low = p(g[1:]) if n > 1 else 1 / (V + 1)
        t = total[n][g[:-1]]
        return (x - D[n][min(x, 3)]) / t + mass[n][g[:-1]] / t * low if t else low

    start = ("START",) * (order - 1)
    assert abs(sum(p((*start, w)) for w in uni) + p((*start, "unknown")) - 1) < 1e-9
    for r in kneser_ney.score(spark, d, model, ("doc_id",)).collect():
        w = words(next(x[1] for x in rows if x[0] == r.doc_id))
        assert r.n_tokens == len(w) and r.n_known == sum(x in uni for x in w) and r.train_tokens == N
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        padded = [*start, *w]
        assert math.isclose(r.score, sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(w))), rel_tol=1e-9, abs_tol=1e-9)


def test_kneser_ney_odd_rows_and_nothing_to_learn(spark, odd):
    assert pytest.raises(ValueError, kneser_ney.train, spark, odd, 4)
    model = kneser_ney.train(spark, odd.limit(0))
    rows = kneser_ney.score(spark, odd.drop("score"), model, ("doc_id", "k")).collect()
    assert len(rows) == len(ODD) and {r.n_known for r in rows} == {0}
    model = kneser_ney.train(spark, odd)
    assert kneser_ney.score(spark, odd.limit(0).drop("score"), model, ("doc_id",)).count() == 0


def test_kneser_ney_tokens_in_parts():
    texts = [t for _, t in ODD] + ["w%d " % i * 9 for i in range(30)]
    whole = [(t.row, t.token, t.before, t.earlier) for t in kneser_ney.tokens(texts)]
    old, kneser_ney.BLOCK = kneser_ney.BLOCK, 16
    try:
        parts = [(t.row, t.token, t.before, t.earlier) for t in kneser_ney.tokens(texts)]
    finally:
        kneser_ney.BLOCK = old
    for k in range(4):
        assert (np.concatenate([x[k] for x in whole]) == np.concatenate([x[k] for x in parts])).all()


def test_packing_is_whole_and_tight(spark, sf):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op8_packing(spark, sf).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in map(sorted, bins.values()):
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1
    own = Tokenizer.from_file(queries.tokenizer_path())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc in d.collect():
        ids = np.array(own.encode(doc.text or "", add_special_tokens=False).ids + [0], "<u4")
        ps = sorted(by[doc.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [p.length for p in ps[1:]] == [2048] * (len(ps) - 1) and sum(p.length for p in ps) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in ps)


def test_packing_plan_beats_or_equals_greedy():
    rng = random.Random(1)
    for _ in range(20):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 300)))
        slots, n = packing.plan(dict(counts), 100)
        assert sum(s[2] for s in slots) == sum(counts.values())
        for length, c in counts.items():
            own = slots[slots[:, 0] == length]
            assert sorted(x for s in own for x in range(s[1], s[1] + s[2])) == list(range(c))
        assert n >= math.ceil(sum(k * v for k, v in counts.items()) / 100)
    assert packing.plan({}, 10)[1] == 0
    assert packing.best_two(np.array([2, 3, 7]), np.array([1, 1, 1]), 9) == (7, 2)
    assert packing.best_two(np.array([4]), np.array([1]), 9) is None


def test_packing_odd_rows_and_blocks(spark, odd):
    rows = packing.pack(odd, queries.tokenizer_path(), size=64).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0)[6] == 2
    assert all(r.length == 1 for r in rows if r.doc_id in (1, 2) or r.doc_id is None)
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0
    kept = packing.pack(odd.filter("doc_id = 7"), queries.tokenizer_path(), keep_ids=True).first()
    assert len(kept.ids) == kept.length and kept.ids[-1] == 0
    ids_of, text = packing.encoder(queries.tokenizer_path()), "One  two\n\nthree " * 50 + "x" * 300
    old, packing.BLOCK = packing.BLOCK, 20
    try:
        assert packing.encode(text, ids_of).tolist() == ids_of(text)
    finally:
        packing.BLOCK = old


def test_packing_ids_are_those_of_the_plain_tokenizer(spark):
    """Special tokens in a text are one id; 10,000 random texts through both ways, and a text through the operator."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, ids_of = Tokenizer.from_file(path), packing.encoder(path)
    assert ids_of("a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\r\n", "\t", "\u3000", "\xa0", "'s", "'LL", "12", "3.5", "été", "ñ", "漢字", "🙂", "ﬁ", "e\u0301", "\u200d", "\x00", "ß", "the", "Hello", "world", "x" * 9, "!?", "...", "<", "|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(9000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0x10000, 0x1FBFF)])) for _ in range(rng.randint(1, 30))) for _ in range(1000)]
    assert [ids_of(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    text = "one <|endoftext|>two" * 3
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, keep_ids=True).first()
    assert row.ids == [*own.encode(text, add_special_tokens=False).ids, 0]
    spec = {"model": {"type": "BPE", "vocab": {c: i for i, c in enumerate(packing._byte_letters())} | {"ab": 257, "bc": 256}, "merges": ["a b", "b c"]}, "pre_tokenizer": {"type": "ByteLevel"}}
    assert not packing._plain(spec)
