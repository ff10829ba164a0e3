"""What a review found on odd and larger tables: small cases in which the same went wrong."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cairnfield import queries as whole
from cairnfield.llm import simhash
from cairnfield.operators import findings


def lines(spark, path, pairs):
    """A table of lineitems in which every pair of parts is a strict edge."""
    rows = [(order, part, number, 0, 50.0, "N", "F", 0.0) for order, pair in enumerate(pairs) for number, part in enumerate(pair)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/lineitem.parquet")


def in_sql(path, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con.sql(whole.ORACLE_SQL[name]).fetchall()


def test_cycles_of_many_and_of_long_components(spark, tmp_path):
    """F8: a component without a cycle of 8 nodes has no row; 1,100 triangles have a row each."""
    ring = [(k, (k + 1) % 12) for k in range(12)]
    triangles = [(100 + 3 * g + a, 100 + 3 * g + b) for g in range(1100) for a, b in ((0, 1), (1, 2), (2, 0))]
    lines(spark, str(tmp_path), ring + triangles)
    got = sorted((r.scc, r.path, r.truncated) for r in whole.g8_cycles(spark, str(tmp_path)).collect())
    assert got == sorted(in_sql(tmp_path, "g8_cycles", ["lineitem"]))
    assert len(got) == 1100 and not any(t for _, _, t in got)


def test_exploded_cells_are_not_broadcast(spark, monkeypatch):
    """near cells are 50 times as many as fingerprints; Spark's estimate of their size must not broadcast them."""
    plans, kept = [], simhash.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "stored", seen)
    around = [(int(x),) for x in np.unique(np.random.default_rng(1).integers(0, 2**62, 300))] + [(1 << a | 1 << b,) for a in range(12) for b in range(a)]
    found = simhash.links(spark.createDataFrame(around, "fp long")).collect()
    assert len(found) >= 65 and all((r.a ^ r.b).bit_count() <= 3 for r in found)
    for plan in plans:
        lines = [(len(re.match(r"[ :|+-]*", x)[0]), x) for x in plan.splitlines()]
        for n, (depth, line) in enumerate(lines):
            if "BroadcastExchange" in line:
                below = next((m for m in range(n + 1, len(lines)) if lines[m][0] <= depth), len(lines))
                assert not any("Generate explode(" in x for _, x in lines[n:below]), plan


def test_best_symbol_makes_no_pairs(spark):
    """every order of scores against all pairs; 3,000 importers of a name that 3,000 files export end soon."""
    dirs, exts = ["a", "a/b", "a/b/c", "a/b/d", "x/y", None], ["js", "py", None]
    at = {n: (dirs[n * 7 % 6], exts[n % 3]) for n in range(40)}
    f = spark.createDataFrame([(n, *v) for n, v in at.items()], "node long, package string, ext string")
    has = {"one": [3], "few": [4, 9, 17], "all": list(range(40)), "some": list(range(1, 40, 4))}
    x = spark.createDataFrame([(n, name, True) for name, ns in has.items() for n in ns], "node long, name string, is_exported boolean")
    w = spark.createDataFrame([(n, name) for n in at for name in has], "importer long, name string")
    two = lambda d: d.split("/")[:2]
    for gap, same_dir, same_module, same_ext in ((20, 40, 20, 10), (5, 20, 20, 20), (0, 30, 0, 40), (10, 10, 10, 0)):
        want = set()
        for n, (d, e) in at.items():
            for name, ns in has.items():
                near = []
                for m in ns:
                    dm, em = at[m]
                    place = same_dir if d and d == dm else same_module if d and dm and len(two(d)) == 2 and two(d) == two(dm) else 0
                    near.append((-(place + (same_ext if e and e == em else 0)), m))
                near.sort()
                if len(near) == 1 or near[1][0] - near[0][0] >= gap:
                    want.add((n, name, near[0][1], -near[0][0]))
        assert {tuple(r) for r in findings.best_symbol(w, x, f, gap, same_dir, same_module, same_ext).collect()} == want and want
    f = spark.range(3000).selectExpr("id AS node", "concat('d', id % 50) AS package", "'js' AS ext")
    same = findings.best_symbol(f.selectExpr("node AS importer", "'x' AS name"), f.selectExpr("node", "'x' AS name", "true AS is_exported"), f)
    assert same.count() == 0
    rows = [int(n) for n in re.findall(r"number of output rows: ([\d,]+)", metrics(same))]
    assert max(rows) <= 3000


def metrics(df):
    """The plan that ran, with a line for every node's number of output rows."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            todo += [p.children().apply(k) for k in range(p.children().size())]
        if p.metrics().contains("numOutputRows"):
            out.append(f"number of output rows: {p.metrics().apply('numOutputRows').value()}")
    return "\n".join(out)


def test_symbol_impact_is_one_short_plan(spark, sf):
    """levels were nested in the plan, each with all before it several times."""
    from cairnfield.record_queries import g13_symbol_impact

    out = g13_symbol_impact(spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8 and out.count() > 0


def test_packages_expand_without_a_shuffle_of_pairs(spark):
    """pairs of importers and a package's files were dealt out again, and exploded paths broadcast."""
    from cairnfield.plans import resolve

    none = F.array().cast("array<string>")
    i = spark.range(60).select(F.concat(F.lit("u/U"), "id", F.lit(".java")).alias("path"), F.lit("java").alias("lang"), F.lit("x.y").alias("source"), none.alias("imported"), F.lit(True).alias("uses_all"))
    f = spark.range(70).select(F.concat(F.lit("src/x/y/C"), "id", F.lit(".java")).alias("path"))
    out = resolve.resolve(i, f).select("path", "target")
    assert len({tuple(r) for r in out.collect()}) == out.count() == 60 * 70
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[import_id#\w+, target#", plan)
    # A path that a class and a wildcard of one import both mean is one row; an import that only means itself has no target.
    i = spark.createDataFrame([("u/U.java", "java", "main.java", [], True), ("src/x/A.java", "java", "x", [], True), ("u/U.java", "java", "main.java", [], True)], "path string, lang string, source string, imported array<string>, uses_all boolean")
    f = spark.createDataFrame([("src/main/java/main.java",), ("src/main/java/B.java",), ("src/x/A.java",)], "path string")
    got = sorted((r.path, r.target or "") for r in resolve.resolve(i, f).collect())
    assert got == [("src/x/A.java", ""), ("u/U.java", "src/main/java/B.java"), ("u/U.java", "src/main/java/main.java")]


def test_imports_meet_files_and_declared_packages_without_pairs(spark):
    """an import was dealt out as 15 paths, and every file as often as its manifest has packages."""
    from cairnfield.plans import resolve

    source = F.expr("CASE id % 4 WHEN 0 THEN concat('./m', id + 1) WHEN 1 THEN concat('../d', id % 3, '/m', id, '.js') WHEN 2 THEN concat('lib', id % 900) ELSE './index' END")
    i = spark.range(400).select(F.expr("concat('src/d', id % 2, '/m', id, '.js')").alias("path"), F.lit("javascript").alias("lang"), source.alias("source"), F.array(F.lit("x")).alias("imported"), F.lit(False).alias("uses_all"))
    endings = F.expr("CASE id % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '/index.tsx' WHEN 3 THEN '' WHEN 4 THEN '.js.js' ELSE '.py' END")
    f = spark.range(800).select(F.concat(F.expr("concat('src/d', id % 2, '/', if(id % 230 = 7, 'index', concat('m', id % 401)))"), endings).alias("path"))
    d = spark.range(600).select(F.lit("").alias("dir"), F.concat(F.lit("lib"), "id").alias("name"))
    # Twice the same import: one row if it has a target, else two.
    out = resolve.resolve(i.union(i.limit(8)), f, declared=d).select("path", "source", "target", "is_external")
    there, want = {r.path for r in f.collect()}, []
    for n, r in enumerate(i.collect()):
        parts = r.path.split("/")[:-1]
        for x in r.source.split("/"):
            parts = parts[:-1] if x == ".." else parts if x == "." else [*parts, x]
        t = "/".join(parts)
        tried = [t + e for e in resolve.JS_ENDINGS] + [re.sub(r"\.js$", "", t) + e for e in (".ts", ".tsx")]
        target = next((x for x in tried if x in there), None) if r.source.startswith(".") else None
        target = None if target == r.path else target
        known = r.source.startswith("lib") and int(r.source[3:]) < 600
        want += [(r.path, r.source, target or "", known)] * (2 if n < 8 and target is None else 1)
    assert sorted((r.path, r.source, r.target or "", r.is_external) for r in out.collect()) == sorted(want)
    assert 50 < sum(t != "" for _, _, t, _ in want) < 350 and 50 < sum(k for *_, k in want)
    assert max(int(n) for n in re.findall(r"number of output rows: ([\d,]+)", metrics(out))) <= 1000


def test_relative_imports_of_lines_without_keys(spark, tmp_path):
    """rows are made distinct by their keys; without one of them a path or a source is null."""
    from cairnfield.record_queries import i2_relative_imports

    rows = [(n, s, p, k, f) for n, (s, p, k, f) in enumerate((s, p, k, f) for s in (None, 0, 1, 2) for p in (None, 0, 1) for k in (None, 1, 2) for f in ("N", "A", "R", "X", None))]
    spark.createDataFrame(rows * 2, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 1.0), (1, -1.0)], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in i2_relative_imports(spark, str(tmp_path)).collect()) == order(in_sql(tmp_path, "i2_relative_imports", ["lineitem", "supplier"]))


def test_the_near_duplicates_stage_broadcasts_no_exploded_cells(spark, monkeypatch):
    """the stage as the pipeline runs it, by its plans and against all pairs of fingerprints."""
    import corpus_pipeline

    plans, kept = [], simhash.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "stored", seen)
    words = np.random.default_rng(2).integers(0, 10**6, (40, 600)).astype(str)
    texts = {8 * k + n: " ".join([*w, "end"][n // 2 :]) for k, w in enumerate(words) for n in range(8)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    got = sorted(r.doc_id for r in out.collect())
    prints, least = {i: simhash.fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in range(8):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert got == sorted(set(least.values())) and 40 <= len(got) < len(texts)
    for plan in plans:
        lines = [(len(re.match(r"[ :|+-]*", x)[0]), x) for x in plan.splitlines()]
        for n, (depth, line) in enumerate(lines):
            if "BroadcastExchange" in line:
                below = next((m for m in range(n + 1, len(lines)) if lines[m][0] <= depth), len(lines))
                assert not any("Generate explode(" in x for _, x in lines[n:below]), plan


def test_no_side_of_the_near_duplicates_stage_that_grows_is_broadcast(spark):
    """the driver held a row for each class, each document and each one kept, as their files were below Spark's threshold."""
    import corpus_pipeline
    from cairnfield.llm.common import SMALL

    store, n = spark._jsparkSession.sharedState().statusStore(), SMALL + 9000
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("concat('a ', id % 140000, ' b')").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    d = d.union(d.filter("doc_id < 4000").withColumn("doc_id", F.col("doc_id") + 200000)).union(d.filter("doc_id < 3"))
    out = corpus_pipeline.near_duplicates(spark, d, "")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(range(min(n, 140000)))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most, done = 0, store.executionsList()
    for e in (done.apply(k) for k in range(done.size())):
        if e.executionId() not in before:
            values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if node.name().startswith("BroadcastExchange"):
                    for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                            most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert 0 < most <= SMALL


def test_components_over_many_edges_are_the_same(spark, monkeypatch):
    """where edges are many, least neighbours are stored and joined by merge."""
    from cairnfield.llm import common

    monkeypatch.setattr(common, "SMALL", 10)
    rng = np.random.default_rng(5)
    pairs = [(k, k + 1) for k in range(500, 520)] + [(900, k) for k in range(901, 930)] + rng.integers(0, 200, (120, 2)).tolist()
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(40):
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    before = len(common._LIVE)
    assert {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert len(common._LIVE) == before + 1
