"""Functions, parsers, resolution, the SQL gate, store, streams and the facade, on a small tree."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import comments, paths, similarity
from cairnfield.operators import diff, findings, history, scoring, symbols
from cairnfield.plans import report, resolve
from cairnfield.plans.sql import Surface, gate
from cairnfield.sources import git, parsers, scan, store
from cairnfield.streaming import incremental
from cairnfield.workspace import Workspace

TREE = {
    "package.json": "{}",
    "src/lib.js": "export function used() { return helper(); }\nexport function deadFn(a, b) { if (a) { return b; } }\nfunction helper() { return 1; }\n",
    "src/orphan.js": "export const orphanValue = 3;\n",
    "src/barrel.js": "export { used } from './lib.js';\nexport * from './deep/index.js';\n",
    "src/deep/index.js": "export class Deep { }\n",
    "src/main.js": "import { used } from './barrel.js';\nimport * as d from './deep';\nimport fs from 'fs';\nimport gone from './missing.js';\nused(); eval('x');\nfetch('/api/users/42');\napp.get('/api/users/:id', used);\n",
    "test/lib.test.js": "import { used } from '../src/lib.js';\nused();\n",
    "py/pkg/__init__.py": "",
    "py/pkg/a.py": "from .b import thing\nfrom . import c\nimport os\n\n\ndef go(x, y):\n    try:\n        return thing(x)\n    except ValueError:\n        return y\n",
    "py/pkg/b.py": "def thing(x: int) -> int:\n    return x\n",
    "py/pkg/c.py": "from py.pkg.a import go  # late\n\n\ndef broken(:\n",
    "src/main/java/com/x/A.java": "package com.x;\nimport com.y.B;\npublic class A { public B batchRun(int n) { return new B(); } }\n",
    "src/main/java/com/y/B.java": "package com.y;\npublic class B { }\n",
    "cmd/app.go": "package main\nimport (\n  \"fmt\"\n  \"example.com/m/util\"\n)\nfunc main() { fmt.Println(util.Do()) }\n",
    "util/util.go": "package util\nfunc Do() int { return 1 }\nfunc SaveAll(n int) int { return n }\n",
    "src/lib.rs": "mod net;\nuse crate::net::Conn;\npub fn open() -> Conn { net::make() }\n",
    "src/net.rs": "pub struct Conn;\npub fn make() -> Conn { Conn }\n",
    "c/one.cpp": "#include \"two.h\"\nint add(int a, int b) { return a + b; }\n",
    "c/two.h": "struct Two { int x; };\n",
    "web/App.vue": "<template/>\n<script>\nimport x from '../src/lib.js'\nexport const y = 1\n</script>\n",
    "node_modules/z/index.js": "export const hidden = 1;\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def space(spark, tree):
    return Workspace(spark, tree, go_module="example.com/m")


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("x")).first().x


def test_url_paths(spark):
    for raw, want in [("https://api.example.com/api/users", "/api/users"), ("/api/users/", "/api/users"), ("api/users", "/api/users"), ("/api/users/:id", "/api/users/{}"), ("/api/users/{userId}", "/api/users/{}"), ("http://h", "/"), ("", ""), ("a//b", "/a/b")]:
        assert one(spark, paths.url_path(F.col("p")), p=raw) == want


def test_paths(spark):
    rows = spark.createDataFrame([("src/a/FooTest.java",), ("tests/test_foo.py",), ("src/foo.test.js",), ("docs/readme.md",), ("vendor/x.js",), ("examples/x.js",), ("src/examples/x.js",), ("main.py",), ("a/b/c/d.e.ts",)], "p string")
    got = rows.select("p", paths.is_test(F.col("p")).alias("t"), paths.role(F.col("p")).alias("r"), paths.signature(F.col("p")).alias("s"), paths.directory_role(F.col("p"), {"main.py": "archive"}).alias("d"), paths.extension(F.col("p")).alias("e"), paths.prefix(F.col("p"), 2).alias("x")).collect()
    by = {r.p: r for r in got}
    assert [by[p].t for p in ("src/a/FooTest.java", "tests/test_foo.py", "src/foo.test.js", "docs/readme.md")] == [True, True, True, False]
    assert by["src/a/FooTest.java"].s == "a/foo" and by["tests/test_foo.py"].s == "foo" and by["src/foo.test.js"].s == "foo"
    assert by["docs/readme.md"].r == "docs" and by["main.py"].r == "entry" and by["main.py"].d == "archive" and by["vendor/x.js"].d == "active"
    assert by["examples/x.js"].d == "reference" and by["src/examples/x.js"].d == "active"
    assert by["a/b/c/d.e.ts"].e == "ts" and by["a/b/c/d.e.ts"].x == "a/b" and by["main.py"].x == "."
    assert one(spark, paths.matches(F.lit("src/a/b.js"), "src/**/*.js")) and not one(spark, paths.matches(F.lit("src/a/b.js"), "src/*.js")) and one(spark, paths.matches(F.lit("SRC/b.js"), "src/?.js"))


def test_similarity(spark):
    s = similarity.similarity(F.col("a"), F.col("b"))
    assert abs(one(spark, s, a="fetchUserData", b="fetchOrderData") - 2 / 3) < 1e-9
    print_ = F.struct(F.lit(2).alias("paramCount"), F.lit(False).alias("isAsync"), F.lit(False).alias("isGenerator"), F.lit(True).alias("hasTryCatch"), F.lit(3).alias("branchCount"), F.lit(1).alias("returnCount"), F.array(F.lit("log")).alias("callCallees"))
    assert abs(one(spark, similarity.similarity(F.lit("processPayment"), F.lit("processRefund"), print_, print_)) - 0.875) < 1e-9
    assert one(spark, similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_comments_keep_strings_and_lines():
    assert comments.strip("a // x\n'//s' /* b\nc */ d", "javascript") == "a     \n'//s'     \n     d"
    assert comments.strip('x = "#" # y\n"""doc\n"""', "python").split("\n")[0].rstrip() == 'x = "#"'
    assert comments.strip(None, "go") is None


def test_scan_and_classify(space):
    files = {r.path: r for r in space.files.collect()}
    assert "node_modules/z/index.js" not in files and "src/lib.js" in files
    assert files["src/lib.js"].line_count == 4 and files["src/lib.js"].lang == "javascript" and files["test/lib.test.js"].is_test and files["src/main.js"].is_entry
    assert scan.patterns(["go.mod"]) == ["go"] and "py" in scan.patterns([])
    with pytest.raises(ValueError):
        scan.load_config('{"nope": 1}')


def test_size_guard(spark, tree):
    small = {r.path: r for r in scan.scan(spark, tree, guard=40).collect()}
    assert small["src/lib.js"].text is None and small["src/lib.js"].parse_mode_reason == "file-too-large"


def test_parsers(space):
    rows = {r.path: r for r in space.records.collect()}
    lib = rows["src/lib.js"]
    assert {e.name for e in lib.exports} == {"used", "deadFn"}
    dead = next(f for f in lib.functions if f.name == "deadFn")
    assert dead.param_count == 2 and dead.branch_count == 1 and dead.return_count == 1 and dead.is_exported
    assert rows["py/pkg/a.py"].parse_mode == "ast" and rows["py/pkg/c.py"].parse_mode_reason == "regex-fallback"
    go = next(f for f in rows["py/pkg/a.py"].functions if f.name == "go")
    assert go.has_try_catch and go.has_parameter_type_hints is False and go.callees == ["thing"]
    assert [i.source for i in rows["web/App.vue"].imports] == ["../src/lib.js"]
    assert {i.source for i in rows["cmd/app.go"].imports} == {"fmt", "example.com/m/util"}
    assert {e.name for e in rows["src/net.rs"].exports} == {"Conn", "make"}
    assert parsers.parse_one("x", "cobol").reason == "unsupported-extension" and parsers.parse_one(None, "go").mode == "none"


def test_edges_by_language(space):
    got = {(r.source, r.target) for r in space.edges.collect()}
    want = {
        ("src/main.js", "src/barrel.js"), ("src/main.js", "src/deep/index.js"), ("src/barrel.js", "src/lib.js"), ("test/lib.test.js", "src/lib.js"), ("web/App.vue", "src/lib.js"),
        ("py/pkg/a.py", "py/pkg/b.py"), ("py/pkg/a.py", "py/pkg/c.py"), ("py/pkg/c.py", "py/pkg/a.py"), ("src/main/java/com/x/A.java", "src/main/java/com/y/B.java"),
        ("cmd/app.go", "util/util.go"), ("src/lib.rs", "src/net.rs"), ("c/one.cpp", "c/two.h"),
    }
    assert want <= got, want - got
    assert [(r.file, r.source) for r in space.unresolved().collect()] == [("src/main.js", "./missing.js")]


def test_commands(space):
    assert {r.name for r in space.dead_exports().collect() if r.file in ("src/lib.js", "src/orphan.js")} == {"deadFn", "orphanValue"}
    assert "src/orphan.js" in {r.path for r in space.orphans().collect()}
    assert {(r.node, r.level) for r in space.impact("src/deep/index.js").collect()} == {("src/barrel.js", 1), ("src/main.js", 1)}
    assert {r.test: r.signal for r in space.affected_tests("src/lib.js").collect()} == {"test/lib.test.js": "graph"}
    assert {(r.user, r.level) for r in space.symbol_impact("src/lib.js", "used").collect()} >= {("src/barrel.js", 1), ("test/lib.test.js", 1), ("src/main.js", 2)}
    assert {r.rule for r in space.security().collect()} == {"js-eval"}
    assert {(r.path, r.status) for r in space.contracts().collect()} == {("/api/users/42", "client-only"), ("/api/users/{}", "server-only")}
    assert {r.rule for r in space.ast_rules().collect()} >= {"exported-function-missing-error-return", "batch-no-transactional", "public-function-no-type-hints"}
    assert space.cycles().first().path == ["py/pkg/a.py", "py/pkg/c.py"]
    assert space.guard("src/lib.js")["blocked"] is False and space.stats().first().files == len(TREE) - 2
    assert space.sql("SELECT count(*) AS n FROM files").rows[0]["n"] == len(TREE) - 2
    out = report.envelope("orphans", {"result": space.orphans()})
    assert out["has_findings"] and report.exit_code(out, True) == 1 and "src/orphan.js" in report.rendered(out, "md") and report.rendered(out, "jsonl").count("\n") == out["result"]["total"] - 1
    assert set(space.overview(["orphans"])) == {"orphans", "omitted"}
    assert space.stability().count() == len(TREE) - 2 and space.map()["tree"].count() > 3
    assert space.hotspots().count() >= 0


def test_resolve_above_root_and_declared(spark):
    i = spark.createDataFrame([("a.js", "javascript", "../x.js", ["d"], False, 1), ("p/q/b.js", "javascript", "lodash/fp", [], True, 1), ("p/b.js", "javascript", "left", [], True, 1)], "path string, lang string, source string, imported array<string>, uses_all boolean, line int")
    f = spark.createDataFrame([("x.js",), ("a.js",)], "path string")
    d = spark.createDataFrame([("p", "lodash"), ("", "left")], "dir string, name string")
    out = {r.source: r for r in resolve.resolve(i, f, declared=d).collect()}
    assert out["../x.js"].target is None and out["lodash/fp"].is_external and not out["left"].is_external


def test_sql_gate(spark):
    bad = ["", "DROP TABLE t", "selectx", "WITH a AS (SELECT 1) SELECT 1", "SELECT 1 UNION SELECT 2", "SELECT 1; SELECT 2", "SELECT a INTERSECT SELECT b", "select 1 except select 2", "SELECT 1 /* x */ Union select 2"]
    bad += ["SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect`('a', 'b')", "SELECT java_method ('a', 'b')", "SELECT input_file_name() FROM t", "SELECT id FROM range(3)", "SELECT 1 /**/ ; DROP TABLE t"]
    for statement in bad:
        assert gate(statement)[1], statement
    for good in ("select\nid FROM t", "SELECT 'please update; delete' AS x", 'SELECT "drop" -- union', "SELECT id FROM t WHERE id IN (1, 2) AND (id > 1)"):
        assert gate(good)[1] is None, good
    s = Surface(spark, {"t": spark.range(1500)})
    assert len(s.query("SELECT id FROM t;").rows) == 1000 and s.query("SELECT id FROM t").truncated
    assert s.query("SELECT a.id FROM t a JOIN t ON a.id = t.id WHERE a.id < 2").ok
    assert s.query("EXPLAIN SELECT id FROM t").ok and s.query("PRAGMA table_info(t)").rows[0]["col_name"] == "id"
    assert not s.query("SELECT nope FROM t").ok
    spark.range(1).createOrReplaceTempView("foreign_view")
    for odd in ("SELECT value FROM text.`/etc/hostname`", "SELECT * FROM foreign_view", "SELECT id FROM t WHERE id IN (SELECT id FROM foreign_view)", "SELECT (SELECT max(id) FROM foreign_view) FROM t", "SELECT a.id FROM t a JOIN parquet.`/tmp` b ON true", "EXPLAIN SELECT * FROM foreign_view", "PRAGMA table_info(foreign_view)"):
        assert not s.query(odd).ok, odd
    assert s.query("SELECT upper('please update') AS x, count(*) AS n FROM (SELECT id FROM t WHERE id < 3) q").rows == [{"x": "PLEASE UPDATE", "n": 3}]


def test_git_texts(spark):
    text = f"{git.MARK}c1\x1fAnn\x1fA@x\x1f2024-01-02T00:00:00+00:00\x1ffix\n\na.js\nb.js\n{git.MARK}c2\x1fBob\x1f\x1f2024-01-05T00:00:00+00:00\x1fRevert x\n\na.js\n"
    commits, files = git.log(spark, text)
    assert {(r.commit, r.author) for r in commits.collect()} == {("c1", "a@x"), ("c2", "bob")} or {(r.commit, r.author) for r in commits.collect()} == {("c1", "a@x"), ("c2", "Bob")}
    h = {r.file: r for r in history.history(commits, files, F.lit(datetime.datetime(2024, 1, 6, 12))).collect()}
    assert (h["a.js"].commit_count, h["a.js"].days_ago, h["a.js"].revert_like) == (2, 1, 1)
    b = git.blame(spark.createDataFrame([("f", "author Ann\nauthor-mail <A@x>\n\tx\nauthor N\nauthor-mail <not.committed.yet>\n\ty\n")], "file string, text string"))
    assert [(r.author, r.author_name) for r in b.collect()] == [("a@x", "Ann")]
    assert {tuple(r) for r in git.status(" M a.js\nR  b -> c\n", spark).collect()} == {("a.js", "M"), ("c", "R")}
    assert git.mailmap(spark, "Ann <a@x> <old@x>").first().alias == "old@x"
    k = history.knowledge(spark.createDataFrame([("f", "old@x"), ("f", "a@x")], "file string, author string"), git.mailmap(spark, "Ann <a@x> <old@x>")).first()
    assert (k.authors, k.primary_author) == (1, "a@x")
    lint = git.diagnostics(spark.createDataFrame([("a.py:3:7: error: bad",), ("b.ts(4,5): error TS1: worse",), ("a.py:3:7: error: bad",), ("noise",)], "line string"))
    assert sorted((r.file, r.line, r.severity) for r in lint.collect()) == [("a.py", 3, "error"), ("b.ts", 4, "error")]
    sem = git.semgrep(spark.createDataFrame([('{"results":[{"check_id":"r","path":"p","start":{"line":2},"extra":{"severity":"WARNING","message":"m"}}]}',)], "json string")).first()
    assert (sem.rule, sem.line, sem.severity) == ("r", 2, "medium")


def test_cochange(spark):
    cf = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "c"), ("4", "d"), ("1", "a")] + [("5", f"f{i}") for i in range(25)], "commit string, file string")
    assert {tuple(r) for r in history.cochange_pairs(cf).collect()} == {("a", "b", 2), ("a", "c", 1)}
    assert [(r.file, r.partner) for r in history.cochange_partners(history.cochange_pairs(cf)).orderBy("file").collect()] == [("a", "b"), ("b", "a")]


def test_diffs(spark):
    text = "@@ -1,2 +3,4 @@\n@@ -9 +10 @@\n@@ -5,1 +6,0 @@\n"
    assert [(x.first, x.last) for x in one(spark, diff.hunks(F.lit(text)))] == [(3, 6), (10, 10)]
    n = {r.file: r for r in diff.numstat(spark.createDataFrame([("3\t1\ta",), ("-\t-\tb.png",), ("x",)], "line string")).collect()}
    assert (n["a"].added, n["b.png"].removed) == (3, 0)
    f = spark.createDataFrame([("x", f"f{i}", i * 10, i * 10 + 9) for i in range(30)], "file string, name string, start int, end int")
    r = spark.createDataFrame([("x", 5, 12), ("x", 100, 250), ("y", 1, 9)], "file string, first int, last int")
    assert {x.name for x in diff.changed_functions(f, r).collect()} == {x.name for x in diff.overlapping(f, r, 16).collect()} and diff.overlapping(f, r, 16).count() == diff.overlapping(f, r, 64).count()
    reuse = diff.reuse_candidates(spark.createDataFrame([("a", "getUserName")], "file string, name string"), spark.createDataFrame([("a", "getUserName"), ("b", "getUser"), ("c", "x")], "file string, name string")).collect()
    assert [(r.file_b, r.rank) for r in reuse] == [("b", 1)]
    calls = spark.createDataFrame([("c", "GET", "/api/users"), ("c", "POST", "/api/users"), ("c", None, "/api/ghost")], "file string, method string, path string")
    routes = spark.createDataFrame([("s", "get", "/api/users/"), ("s", "POST", "/api/users"), ("s", "DELETE", "/api/users/:id")], "file string, method string, path string")
    assert sorted(r.status for r in diff.contracts(calls, routes).collect()) == ["client-only", "matched", "matched", "server-only"]


def test_symbols_and_scores(spark):
    x = spark.createDataFrame([("a.js", "foo", True), ("b.js", "foo", True)], "node string, name string, is_exported boolean")
    assert findings.duplicates(x).first().places == ["a.js", "b.js"]
    f = spark.createDataFrame([("a.js", "m", "js"), ("b.js", "n", "js"), ("z.js", "m", "js")], "node string, package string, ext string")
    w = spark.createDataFrame([("z.js", "foo")], "importer string, name string")
    assert findings.best_symbol(w, x, f).first().node == "a.js"
    private = spark.createDataFrame([("a.js", "foo", False), ("b.js", "foo", False)], "node string, name string, is_exported boolean")
    assert findings.best_symbol(w, private, f).count() == 0
    none = [F.lit(None).cast("long")] * 4
    args = (F.lit("library"), F.lit(0.5), F.lit(2))
    assert one(spark, scoring.hotspot_score(*none, *args)) == 50 and one(spark, scoring.hotspot_score(*none, *args, compat=True)) == 18
    assert one(spark, scoring.worst_quality(F.lit("certain"), F.lit("degraded"))) == "degraded"
    fn = spark.createDataFrame([("f", "a", True, ["b"]), ("f", "b", False, ["c"]), ("f", "c", False, [])], "path string, name string, is_exported boolean, callees array<string>")
    ch = spark.createDataFrame([("f", "c")], "path string, name string")
    assert [r.exported for r in symbols.exporting_callers(fn, ch).collect()] == ["a"]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.read("t") is None
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    stamp = store.Stamp(1, "h", 2, store.config_hash({"b": 1, "a": 2}), "x")
    s.replace("t", a, stamp)
    assert s.stamp("t").fresh(stamp) and stamp.config == store.config_hash({"a": 2, "b": 1})
    s.upsert("t", spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"], deleted=spark.createDataFrame([("a",)], "k string"))
    assert {tuple(r) for r in s.read("t").collect()} == {("b", 3), ("c", 4)}
    assert s.lookup("t", spark.createDataFrame([("c",)], "k string"), ["k"]).count() == 1
    assert store.Store(spark, f"file://{tmp_path}/s", version=2).read("t") is None


def test_stream_equals_rebuild(spark, tmp_path):
    texts = {f"d/f{i}.js": f"import './f{i + 1}.js'\n" for i in range(8)}
    now = dict(texts)

    def derive(paths_):
        have = spark.createDataFrame([(p, "javascript", t) for p, t in now.items()], "path string, lang string, text string")
        return parsers.parse(have.join(paths_.distinct(), "path", "left_semi"))

    def link(records, files):
        return resolve.edges(resolve.resolve(parsers.import_records(records), files)).select("source", "target")

    s = store.Store(spark, f"file://{tmp_path}/live")
    m = incremental.Maintainer(s, derive, link, resolve.shadowed)
    folder = tmp_path / "events"
    folder.mkdir()
    t0 = datetime.datetime(2024, 1, 1)

    def send(n, ops):
        import json

        lines = [json.dumps({"ts": (t0 + datetime.timedelta(seconds=n * 100 + k)).isoformat(), "path": p, "op": o}) for k, (p, o) in enumerate(ops)]
        (folder / f"{n}.json").write_text("\n".join(lines))
        q = m.start(incremental.events(spark, f"file://{folder}"), f"file://{tmp_path}/check")
        q.awaitTermination()

    send(0, [(p, "upsert") for p in texts] + [("node_modules/x.js", "upsert")])
    now["d/f8.js"] = "import './f0.js'\n"
    now["d/f2.js"] = "import './f5.js'\nimport './f7.js'\n"
    send(1, [("d/f8.js", "upsert"), ("d/f2.js", "delete"), ("d/f2.js", "upsert")])
    del now["d/f4.js"]
    send(2, [("d/f4.js", "delete")])
    got = {tuple(r) for r in s.read("edges").collect()}
    full = store.Store(spark, f"file://{tmp_path}/full")
    incremental.Maintainer(full, derive, link).rebuild(spark.createDataFrame([(p,) for p in now], "path string"))
    assert got == {tuple(r) for r in full.read("edges").collect()} and ("d/f7.js", "d/f8.js") in got and m.rebuilds == 1
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    assert incremental.cycles_stale(e, e.limit(0)) and not incremental.cycles_stale(e, e)


def test_debounce_and_trend(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(milliseconds=300)), ("a", t + datetime.timedelta(seconds=2))], "path string, ts timestamp")
    assert sorted(r.events for r in incremental.debounced(ev).collect()) == [1, 2]
    s = store.Store(spark, f"file://{tmp_path}/s")
    for k in range(4):
        incremental.append_trend(spark.createDataFrame([(t + datetime.timedelta(hours=20 * k), k)], "ts timestamp, n int"), s, compact_every=3)
    assert s.read("trend").count() == 4 and len(s._pointer("trend")["data"]) == 2
    assert {(r.bucket, r.n) for r in incremental.trend(s.read("trend")).collect()} == {("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["data", "pointer", "rename", "tidy"])
def test_a_write_that_ends_between_two_steps(spark, tmp_path, monkeypatch, step):
    """The table is the old state or the new one, whichever step is the last; the next write goes on."""
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    for v in range(3):
        s.replace("t", rows(*((f"k{i}", v) for i in range(20))), keys=["k"])
    before = {tuple(r) for r in s.read("t").collect()}
    real_write, real_point = s._write, s._point

    def write(*args):
        real_write(*args)
        raise Crash

    def point(name, pointer):
        if step == "pointer":
            (tmp_path / "s" / "t" / ".pointer-half").write_text("{")  # what a write that ended in the middle leaves
            raise Crash
        monkeypatch.setattr(s, "_tidy", lambda *a: (_ for _ in ()).throw(Crash()))
        if step == "rename":
            real = s._numbers
            monkeypatch.setattr(s, "_numbers", lambda name: real(name)[1:])  # another writer has this number by now
        real_point(name, pointer)

    if step == "data":
        monkeypatch.setattr(s, "_write", write)
    else:
        monkeypatch.setattr(s, "_point", point)
    with pytest.raises((Crash, store.StoreError)):
        s.upsert("t", rows(("k1", 9), ("new", 9)), ["k"], deleted=spark.createDataFrame([("k2",)], "k string"))
    after = (before - {("k1", 2), ("k2", 2)}) | {("k1", 9), ("new", 9)}
    fresh = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    assert {tuple(r) for r in fresh.read("t").collect()} == (after if step == "tidy" else before)
    fresh.upsert("t", rows(("k3", 7)), ["k"])
    assert ("k3", 7) in {tuple(r) for r in fresh.read("t").collect()}
    for p in (tmp_path / "s" / "t").glob("pointer-*"):
        p.unlink()
    with pytest.raises(store.StoreError):
        fresh.read("t")
    with pytest.raises(store.StoreError):
        incremental.Maintainer(store.Store(spark, f"file://{tmp_path}/s"), None, None).store.read("t")


def test_upserts_rewrite_their_buckets_alone(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=8)
    s.replace("t", spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"), keys=["k"])
    old = s._pointer("t")["data"]
    s.upsert("t", spark.createDataFrame([("k5", -1)], "k string, v int"), ["k"])
    new = s._pointer("t")["data"]
    assert len(old) == 8 and sum(old[b] != new[b] for b in old) == 1
    assert s.lookup("t", spark.createDataFrame([("k5",)], "k string"), ["k"]).first().v == -1 and s.stats("t", "none") == {"t": 100}
    empty = spark.createDataFrame([], "k string, v int")
    s.replace("e", empty, keys=["k"])
    s.upsert("e", empty, ["k"])
    assert s.read("e").count() == 0


def test_package_importers(spark):
    records = spark.createDataFrame([("p/a.go",), ("p/b.go",), ("q/c.go",)], "path string")
    edges = spark.createDataFrame([("q/c.go", "p/a.go")], "source string, target string")
    state = spark.createDataFrame([("p/new.go", "upsert")], "path string, op string")
    got = incremental.Maintainer._package_importers(records, edges, state, state.select("path"))
    assert [r.path for r in got.collect()] == ["q/c.go"]


def test_security_rules(spark):
    """A hit and a miss for every rule; ids, severities, allowed lines and configured rules."""
    hits = {
        "js-eval": "x = eval (s)", "js-innerHTML": "el.innerHTML = s", "js-document-write": "document.write(s)", "js-new-function": "new Function('a')",
        "js-dangerous-timeout": "setTimeout('x()', 1)", "js-dangerous-interval": "setInterval(`x()`, 1)", "js-hardcoded-secret": "apiKey: 1, TOKEN: 'abcdefgh1'", "js-log-sensitive": "console.warn('user', Password)",
        "py-exec": "exec(s)", "py-eval": "eval(s)", "py-shell-true": "subprocess.run(c, shell=True)", "py-os-system": "os.system(c)", "py-hardcoded-secret": "password = 'longenough'", "py-log-sensitive": "logger.info(f'{credential}')",
        "java-runtime-exec": "Runtime.getRuntime().exec (c)", "java-process-builder": "new ProcessBuilder(c)", "java-file-upload": "f.transferTo(g)", "java-hardcoded-secret": 'String apikey = "abcdefgh"', "java-log-sensitive": "log.debug(secret)",
    }
    kind = {"js": ("typescript", "a.ts"), "py": ("python", "a.py"), "java": ("java", "A.java")}
    rows = [(kind[r.split("-")[0]][1], kind[r.split("-")[0]][0], t, False) for r, t in hits.items()]
    for clean in ("retrieval(s)", "timeout(x, 1)", "token = 'short'"):
        rows += [("b.js", "javascript", clean, False)]
    rows += [("c.py", "python", "d = {'password': 'longenough'}", False), ("c.py", "python", "token: 'longenough'", False), ("d.js", "javascript", "eval(x) // security-scan-ignore", False), ("d.js", "javascript", "expect(() => eval(x)).toThrow()", False), ("x/test/f.js", "javascript", "secret = 'dummy_value_1'", False), ("t.js", "javascript", "eval(x)", True)]
    rows += [("e.py", "python", "eval(x)  # security-scan-ignore", False)]
    t = spark.createDataFrame(rows, "path string, lang string, text string, is_test boolean")
    got = findings.security_scan(t).collect()
    own = {r.rule for r in got if r.path in {p for _, p in kind.values()}}
    assert own == set(hits) == set(findings.SECURITY_IDS)
    assert {(r.path, r.rule) for r in got if r.path not in {p for _, p in kind.values()}} == {("e.py", "py-eval")}
    assert {r.rule: r.severity for r in got}["java-log-sensitive"] == "low"
    assert {r.rule for r in findings.security_scan(t, language="java").collect()} == {r for r in hits if r.startswith("java")}
    rules, allow = findings.security_rules({"rules": [{"lang": "x", "ext": r"\.py$", "rules": [{"id": "no-os", "pattern": "OS\\.", "flags": "i", "severity": "high"}]}], "allowlist": [{"ruleIdContains": ["no-os"], "pattern": "never"}]})
    assert {(r.path, r.rule) for r in findings.security_scan(t, rules, allow).collect()} == {("a.py", "no-os")}
    with pytest.raises(ValueError):
        findings.security_rules({"rules": [{"ext": "", "rules": [{"id": "x", "pattern": "(", "severity": "low"}]}]})


def test_public_modules_and_registries(spark):
    files = spark.createDataFrame([(p, p) for p in ("k/src/lib.rs", "k/src/a.rs", "k/src/a/b.rs", "k/src/c/mod.rs", "k/src/hidden.rs", "r.js")], "node string, path string")
    exports = spark.createDataFrame([("k/src/lib.rs", "a", "module"), ("k/src/lib.rs", "c", "module"), ("k/src/a.rs", "b", "module"), ("k/src/a.rs", "f", "function")], "node string, name string, kind string")
    public = findings.rust_public_modules(files, exports)
    assert {r.node for r in public.collect()} == {"k/src/a.rs", "k/src/a/b.rs", "k/src/c/mod.rs"}
    dead = spark.createDataFrame([(n, x, 0, "high", 0.95) for n, x in (("k/src/a.rs", "f"), ("k/src/hidden.rs", "g"), ("r.js", "REG"))], "node string, name string, importers int, confidence string, value double")
    out = {r.node: (r.confidence, r.value, r.false_positive) for r in findings.downgraded(dead, files, public, [("r.js", ["REG"])]).collect()}
    assert out == {"k/src/a.rs": ("low", 0.5, "rust-public-api"), "k/src/hidden.rs": ("high", 0.95, None), "r.js": ("low", 0.5, "dynamic-registry-export")}


def test_frameworks_and_scaffolds(spark):
    rows = [("a.ts", "@Controller()\nclass A {}", "nestjs"), ("b.js", "x" * 9000 + " APP.GET('/')", "express"), ("m.vue", "import { ref } from 'vue'", "vue"), ("t.py", "@shared_task", "celery"), ("s.java", "@ControllerAdvice", "spring-boot"), ("c.java", "@RestController", "spring"), ("g.go", "c *fiber.Ctx", "fiber"), ("r.rs", "Router::new()", "axum"), ("k.kt", "routing {", "ktor"), ("n.txt", "@Controller", None), ("proj/urls.py", "", "django"), ("z.js", None, None)]
    got = {r.path: r.hint for r in spark.createDataFrame([r[:2] for r in rows], "path string, text string").select("path", scan.framework_hint(F.col("path"), F.col("text")).alias("hint")).collect()}
    assert got == {r[0]: r[2] for r in rows}
    scan.register_framework("php", "laravel", ["Route::get("])
    assert one(spark, scan.framework_hint(F.lit("w.php"), F.lit("route::get('/')"))) == "laravel"
    want = {"a/SysUser.java": "scaffold-ruoyi", "x/ruoyi/StringUtils.java": "scaffold-ruoyi", "x/StringUtils.java": None, "src/permission.js": "scaffold-vue-admin", "src/generator/x.ts": "scaffold-vue-admin", "src/x.ts": None}
    assert {r.p: r.s for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", scan.scaffold(F.col("p")).alias("s")).collect()} == want


def test_filtered(spark):
    df = spark.createDataFrame([("a", "high"), ("b", "low"), ("c", "high")], "path string, risk string").orderBy("path")
    levels = ("high", "medium", "low")
    assert report.filtered(df, "risk", "high", levels, 5, 1) == {"count": 1, "total": 3, "items": [{"path": "a", "risk": "high"}]}
    assert report.filtered(df, "risk", "odd", levels)["count"] == 3 and report.filtered(df, "risk", None, levels, 2)["count"] == 2
