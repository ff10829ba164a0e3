"""Graph operators on small graphs."""

import random

import pytest

from cairnfield.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def nodes(spark, names):
    return spark.createDataFrame([(n, False, False) for n in names], "node string, is_entry boolean, is_test boolean")


def ranks(df):
    return {r.node: r.rank for r in df.collect()}


def test_pagerank_shapes(spark):
    tri = ranks(graph.pagerank(nodes(spark, "abc"), frame(spark, [("a", "b"), ("b", "c"), ("c", "a")])))
    assert all(abs(r - 1 / 3) < 1e-9 for r in tri.values())
    star = ranks(graph.pagerank(nodes(spark, "habcd"), frame(spark, [(x, "h") for x in "abcd"])))
    assert all(star["h"] > star[x] for x in "abcd") and abs(sum(star.values()) - 1) < 1e-9
    alone = ranks(graph.pagerank(nodes(spark, "abc"), frame(spark, [("a", "a"), ("b", "nowhere")])))
    assert all(abs(r - 1 / 3) < 1e-9 for r in alone.values())
    assert graph.pagerank(nodes(spark, []), frame(spark, [])).count() == 0


def test_pagerank_series_equals_rounds(spark):
    e, v = frame(spark, [tuple(p) for p in ("ab", "bc", "ca", "cd", "ed", "ff", "ga")]), nodes(spark, "abcdefgh")
    series, loop = ranks(graph.pagerank(v, e, 6)), ranks(graph.pagerank(v, e, 6, epsilon=0.0))
    assert series == pytest.approx(loop, abs=1e-12) and sum(series.values()) == pytest.approx(1)
    assert ranks(graph.pagerank(v, e, 0)) == pytest.approx({k: 1 / 8 for k in "abcdefgh"})
    assert ranks(graph.pagerank(v, frame(spark, [("h", "h")]), 3)) == pytest.approx({k: 1 / 8 for k in "abcdefgh"})


def test_pagerank_warm_start(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")])
    cold = graph.pagerank(nodes(spark, "abcd"), e, 8)
    got = ranks(graph.pagerank(nodes(spark, "abcde"), e, 8, epsilon=0.02, previous=cold))
    full = ranks(graph.pagerank(nodes(spark, "abcde"), e, 8))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["e"] > 0
    assert all(abs(got[n] - full[n]) < 0.05 for n in full)


@pytest.mark.parametrize("small", [10**6, 0])
def test_scc_both_ways(spark, small):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    r = {n: reach(n) for n in {x for p in pairs for x in p}}
    want = {n: min(m for m in r if m == n or (m in r[n] and n in r[m])) for n in r if any(m != n and m in r[n] and n in r[m] for m in r)}
    got = {x.node: x.scc for x in graph.scc(frame(spark, pairs), small).collect()}
    assert got == want


def test_cycles_and_caps(spark):
    assert [r.path for r in graph.cycles(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).collect()] == [["a", "b", "c"]]
    full = [(a, b) for a in "abcdef" for b in "abcdef" if a != b] + [("x", "y"), ("y", "z"), ("z", "x")]
    rows = graph.cycles(frame(spark, full), longest=5).collect()
    dense = [r for r in rows if r.scc == "a"]
    assert len(dense) == 25 and all(r.truncated for r in dense)
    assert [r.path for r in rows if r.scc == "x"] == [["x", "y", "z"]]
    cut = graph.cycle_break(graph.cycles(frame(spark, [("a", "b"), ("b", "a"), ("c", "a")])), graph.degrees(nodes(spark, "abc"), frame(spark, [("a", "b"), ("b", "a"), ("c", "a")])), None).first()
    assert (cut.source, cut.target) == ("b", "a")


def test_impact_stops_at_entries_and_grows_with_depth(spark):
    e = frame(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("x", "gone")])
    f = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False)], "node string, is_entry boolean, is_test boolean")
    start = spark.createDataFrame([("a", "a")], "root string, node string")
    assert [r.node for r in graph.impact_radius(f, e, start, 3).collect()] == ["b"]
    free = f.withColumn("is_entry", f.is_test & ~f.is_test)
    before = set()
    for depth in range(1, 5):
        now = {(r.node, r.level) for r in graph.impact_radius(free, e, start, depth).collect()}
        assert before <= now
        before = now
    assert before == {("b", 1), ("c", 2), ("d", 3)}
    assert [(r.test, r.distance) for r in graph.affected_tests(f, e, start).collect()] == [("c", 2)]
    assert {r.node: r.via for r in graph.bfs(graph.reverse(e), start, 3).collect()}["d"] == ["a", "b", "c", "d"]


def test_reverse_twice_is_the_graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "b")]
    assert {tuple(r) for r in graph.reverse(graph.reverse(frame(spark, pairs))).collect()} == set(pairs)


def test_cycle_caps_are_told(spark):
    """A complete graph of 100 nodes ends and says that it is cut, as do a ring longer than the cap and a cap over all."""
    e = lambda pairs: spark.createDataFrame(pairs, "source long, target long")
    full = graph.cycles(e([(a, b) for a in range(100) for b in range(100) if a != b])).collect()
    assert len(full) == 25 and all(r.truncated for r in full) and [r.path for r in full][:2] == [[0, 1], [0, 2]]
    ring = graph.cycles(e([(k, (k + 1) % 12) for k in range(12)])).collect()
    assert [(r.path, r.truncated) for r in ring] == [([], True)]
    three = [(10 * g + a, 10 * g + b) for g in range(5) for a, b in ((0, 1), (1, 2), (2, 0))]
    assert [r.truncated for r in graph.cycles(e(three), most=3).collect()] == [True] * 3
    assert sorted((r.path, r.truncated) for r in graph.cycles(e(three)).collect()) == [([10 * g, 10 * g + 1, 10 * g + 2], False) for g in range(5)]
    layers = [(a, b) for k in range(6) for a in range(20 * k, 20 * k + 20) for b in range(20 * ((k + 1) % 6), 20 * ((k + 1) % 6) + 20)]
    assert all(r.truncated for r in graph.cycles(e(layers), beam=500).collect())


def test_reuse_candidates_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from cairnfield.functions.similarity import similarity
    from cairnfield.operators import diff

    rng = random.Random(2)
    words_, calls = ["get", "set", "user", "load", "x"], ["a", "b", "c"]

    def row(i):
        shape = (rng.randint(0, 2), rng.choice([[], [], rng.sample(calls, rng.randint(1, 2))]), rng.random() < 0.3, False, False, rng.randint(0, 2), rng.randint(0, 1))
        return (f"f{rng.randint(0, 7)}", "".join(w.capitalize() for w in rng.choices(words_, k=2)) + str(i), rng.choice([None, shape, shape, shape]))

    schema = "file string, name string, fingerprint struct<paramCount:int,callCallees:array<string>,isAsync:boolean,isGenerator:boolean,hasTryCatch:boolean,branchCount:int,returnCount:int>"
    changed, functions = spark.createDataFrame([row(i) for i in range(25)], schema), spark.createDataFrame([row(100 + i) for i in range(120)], schema)
    a, b = changed.toDF("file_a", "name_a", "pa").distinct(), functions.toDF("file_b", "name_b", "pb").distinct()
    pairs = a.join(b, F.col("file_a") != F.col("file_b")).withColumn("s", F.round(similarity(F.col("name_a"), F.col("name_b"), F.col("pa"), F.col("pb")), 9)).filter("s >= 0.5").collect()
    want = set()
    for key in {(r.file_a, r.name_a) for r in pairs}:
        own = sorted((-r.s, r.file_b, r.name_b) for r in pairs if (r.file_a, r.name_a) == key)[:3]
        want |= {(*key, f, n, -s, k + 1) for k, (s, f, n) in enumerate(own)}
    got = {(r.file_a, r.name_a, r.file_b, r.name_b, round(r.score, 9), r["rank"]) for r in diff.reuse_candidates(changed, functions).collect()}
    assert got == want and len(want) > 20
