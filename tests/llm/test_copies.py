"""Line dedup, SimHash, decontamination and the pipeline against brute force, and on odd rows."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cairnfield.llm import decontaminate, kneser_ney, langid, line_dedup, packing, queries, simhash, toxicity
from cairnfield.llm.common import components

ODD = [(None, None), (None, "solo line"), (1, None), (2, ""), (3, " \n\n "), (4, "a b"), (4, "a b"), (5, "one\ntwo\nthree\nfour"), (6, "one\ntwo\nthree\nfour"), (7, "x " * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "n", k) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, chunk string, j int")


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_simhash(spark, sf).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert len(rows) == len(text) and fp == {i: plain_fingerprint(t) for i, t in text.items()}
    ids = sorted(fp)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("dense", [2, 20, 10**6])
def test_links_in_a_dense_ball(spark, dense):
    rng = random.Random(4)
    centre, points = rng.getrandbits(64), set()
    for _ in range(500):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 7)):
            x ^= 1 << b
        points.add(x - (1 << 64) if x >> 63 else x)
    points = sorted(points)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), dense=dense)).collect()}
    want = union_find(points, [(a, b) for k, a in enumerate(points) for b in points[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert all(got.get(p, p) == r for p, r in want.items())


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(6)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    rows = df.select("a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("d")).collect()
    for r in rows:
        pc = lambda x: [(x >> k & 3).bit_count() for k in range(0, 64, 2)]
        assert r.d == sum(abs(x - y) for x, y in zip(pc(r.a), pc(r.b), strict=True)) <= (r.a ^ r.b).bit_count()


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 7] and sum(r.doc_id is None for r in kept) == 2
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_one(odd.limit(0)).count() == 0


def shingles(text, n=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def test_contained_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 12, 40])))) for i in range(40)] + [(99, None), (98, ""), (97, " \t"), (None, "w1 w2 w3 w4 w5"), (0, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    own[rng.randrange(len(own))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((i, " \n ".join(w).upper()))
    docs += [(None, items[3][1]), (500, None), (501, ""), docs[0]]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int"), spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, q int")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared, r.containment) for r in decontaminate.contained(d, b).collect()}
    want = {}
    for i, t in docs:
        whole = shingles(t)
        for j, item in items:
            q = shingles(item)
            n = len(next(iter(q), ()))
            own = whole if n == 5 else {tuple(w[k : k + n]) for w in [t.lower().encode().split() if t else []] for k in range(len(w) - n + 1)} if n else set()
            if j is not None and q and len(q & own) >= 0.8 * len(q) - 1e-9:
                key, val = (i, j), (len(q), len(q & own), round(len(q & own) / len(q), 6))
                if key not in want or (val[2], val[0], val[1]) > (want[key][2], want[key][0], want[key][1]):
                    want[key] = val
    assert got == want and len(want) > 30
    assert decontaminate.contained(d.limit(0), b).count() == 0 and decontaminate.contained(d, b.limit(0)).count() == 0
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}


def test_rows_are_cleaned_each(spark):
    """A null id protects no row, and a shared id condemns none; columns that clash with the operator's own pass through."""
    item = "w1 w2 w3 w4 w5 w6 w7"
    d = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (1, f"a {item} b", 3), (1, "clean too", 4), (2, None, 5)], "doc_id long, text string, bad_key int").withColumn("item_id", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("d", F.lit(1))
    out = decontaminate.clean(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.bad_key for r in out.collect()) == [2, 4, 5] and out.columns == d.columns


def test_the_sketch_chooses_what_is_compared(spark, monkeypatch):
    """Without sketches nothing is found; with them a part of the pairs that share a shingle is compared, and none is lost."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(30)]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=80)
        part = items[i % 30][1].split()
        w[40:40] = part if i < 30 else part[: rng.randint(6, 12)]  # most hold a short passage of an item only
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen = []
    real = decontaminate.candidates

    def counted(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(decontaminate, "candidates", counted)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(d, b).collect()}
    meet = [(i, j) for i, t in docs for j, x in items if shingles(t) & shingles(x)]
    want = {(i, j) for i, j in meet if len(shingles(docs[i][1]) & shingles(items[j][1])) >= 0.8 * len(shingles(items[j][1]))}
    assert got == want and len(want) >= 30
    assert len(want) <= seen[0] < 0.9 * len(meet)
    sketched = decontaminate._sketched
    monkeypatch.setattr(decontaminate, "_sketched", lambda *a: sketched(*a).withColumn("sketch", F.array().cast("array<bigint>")))
    assert decontaminate.contained(d, b).count() == 0


def test_chunks_join_to_the_text(spark, odd):
    from pyspark.sql import functions as F

    rows = odd.select("text", line_dedup.chunks(F.col("text"), 50).alias("c")).collect()
    assert all("\n".join(x.chunk for x in r.c) == (r.text or "") for r in rows)
    assert all(x.n_lines == x.chunk.count("\n") + 1 for r in rows for x in r.c)


def test_moved_passages_are_found_and_clean_text_stays(spark):
    rng = random.Random(8)
    line = lambda: " ".join(str(rng.getrandbits(40)) for _ in range(6))
    passage, wrapped = [line() for _ in range(14)], " ".join(str(rng.getrandbits(30)) for _ in range(60))
    docs = []
    for i in range(12):
        own = [line() for _ in range(rng.randint(5, 15))]
        if i % 3 == 0:
            own[3:3] = passage
        if i % 4 == 1:
            own.insert(2, wrapped)
        docs.append((i, "\n".join(own)))
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), solo=50).collect()}
    assert out[0].text == docs[0][1] and out[1].text == docs[1][1]
    for i in (3, 6, 9):
        assert sum(p in out[i].text.split("\n") for p in passage) <= 8 and out[i].removed_lines >= 6
    assert all(wrapped not in out[i].text for i in (5, 9))
    for i in range(12):
        kept = out[i].text.split("\n")
        assert [x for x in docs[i][1].split("\n") if x not in passage and x != wrapped] == [x for x in kept if x not in passage and x != wrapped]


def test_line_dedup_odd_rows(spark, odd):
    rows = line_dedup.dedup(odd, solo=50).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {"doc_id", "text", "chunk", "j", "removed_chunks", "removed_lines"}
    by = {r.j: r for r in rows}
    assert by[0].text is None and by[3].text == "" and by[7].text == ODD[7][1] and by[8].text != ODD[8][1] and by[9].text == ODD[9][1]
    assert line_dedup.dedup(odd.limit(0)).count() == 0


def test_names_that_clash(spark):
    """Columns named like the operators' own, or like their helpers: helpers don't matter, what is returned wins."""
    d = spark.createDataFrame([(1, "a b\nc d\ne f", "en"), (2, "a b\nc d\ne f", "de")], "doc_id long, text string, lang string")
    for k, c in enumerate(("gone", "row_key", "removed_lines", "removed_chunks", "js", "rest", "x", "h", "chunk", "lang_pred", "score", "predicted", "t", "c0", "fp", "n", "component_id", "root", "a`b", "x.y", "n_tokens", "perplexity")):
        d = d.withColumn(c if c != "x.y" else "x.y", F.lit(f"own{k}"))
    d = d.drop("a`b", "x.y")
    for out, made in (
        (line_dedup.dedup(d), ["removed_chunks", "removed_lines"]),
        (line_dedup.dedup_passages(d, 4), ["removed_lines"]),
        (langid.identify(spark, d, langid.train(d)), ["lang_pred", "score"]),
        (toxicity.score(spark, d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))), ["score", "predicted"]),
        (kneser_ney.score(spark, d, kneser_ney.train(spark, d)), ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]),
        (simhash.keep_one(d), []),
        (decontaminate.clean(d, d.selectExpr("doc_id AS item_id", "'q' AS text")), []),
    ):
        assert len(set(out.columns)) == len(out.columns) and set(out.columns) == set(d.columns) | set(made)
        rows = out.collect()
        others = [c for c in d.columns if c not in made and c != "text"]
        want = {tuple(r[c] for c in others) for r in d.collect()}
        assert {tuple(r[c] for c in others) for r in rows} <= want and len(rows) in (1, 2)
    assert [r.removed_lines > 1 for r in line_dedup.dedup(d).orderBy("doc_id").collect()] == [False, True]
    assert simhash.near_duplicates(d).count() == 2 and packing.pack(d, queries.tokenizer_path()).count() == 2
    assert line_dedup.dedup(d.select("doc_id", "text")).filter("removed_chunks > 0").count() == 1


def test_only_chunks_of_lines_unless_asked(spark):
    text = "w " * 60
    d = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.removed_lines for r in line_dedup.dedup(d).collect()} == {0}
    assert {r.removed_lines for r in line_dedup.dedup(d, solo=50).collect()} == {0, 1}


def test_pipeline_stages_pass_columns_on(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    start = d.count()
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
        if name != "sequences":
            assert tuple(d.columns) == corpus_pipeline.COLUMNS and 0 < d.count() <= start
    rows = d.collect()
    assert rows and {"doc_id", "piece", "sequence_id"} <= set(d.columns)


def test_pipeline_on_odd_rows(spark, sf, odd):
    d = odd.selectExpr("doc_id", "text", "cast(null as string) AS lang", "chunk AS source", "cast(j AS long) AS n_chars")
    for rows in (d, d.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
        rows.collect()
