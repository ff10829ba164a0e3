"""More of the registry: symbols, import resolution, texts that tools print, rules and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths
from .functions.similarity import name_tokens, number
from .operators import diff, findings, graph, history, scoring, symbols
from .plans import report, resolve
from .queries import _HUB, _base, _hub, query
from .sources import domain, git
from .sources.domain import table, with_ctes


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Import records by file: type-only edges re-export what they import."""
    i = domain.import_records(spark, d, "type_only")
    return i.select(F.col("source").alias("path"), "target", F.array("imported").alias("imported"), "uses_all", F.col("type_only").alias("re_export"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return domain.export_records(spark, d).select(F.col("node").alias("file"), "name").distinct()


_IMPORTS = ", sym AS (SELECT DISTINCT node AS file, name FROM export_records), imp AS (SELECT i.source AS path, i.target, i.imported, i.uses_all, e.type_only AS re_export FROM import_records i JOIN edges e ON e.source = i.source AND e.target = i.target)"


# Symbols


@query(with_ctes("edges export_records import_records", _IMPORTS + """ SELECT file, name, path AS user, bool_and(uses_all AND imported <> name) AS "all" FROM sym JOIN imp ON target = file AND (uses_all OR imported = name) GROUP BY ALL"""))
def j7_symbol_dependents(spark, d):
    return symbols.symbol_dependents(_imports(spark, d), _symbols(spark, d))


@query(with_ctes("edges export_records import_records", _IMPORTS + """, carried AS (SELECT file AS root, name, file, 1 AS level FROM sym UNION
  SELECT root, name, path, level + 1 FROM carried JOIN imp ON target = file AND re_export AND (uses_all OR imported = name) WHERE level < 4)
SELECT root AS file, name, path AS user, min(level) AS level FROM carried JOIN imp ON target = file AND (uses_all OR imported = name) GROUP BY ALL""", recursive=True))
def g13_symbol_impact(spark, d):
    return symbols.symbol_impact(_imports(spark, d), _symbols(spark, d))


def _named_files(spark: SparkSession, d: str) -> DataFrame:
    """Files named by their part's name, tests apart: src/brand7/cold_widget.js, tests/brand7/test_cold_widget.js."""
    f = domain.files(spark, d).select(F.col("node").alias("p_partkey"), "ext", "is_test", "package")
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("stem"))
    brand = F.split("package", "/")[0]
    tests = F.concat(F.lit("tests/"), brand, F.lit("/test_"))
    path = F.concat(F.when(F.col("is_test"), tests).otherwise(F.concat(F.lit("src/"), brand, F.lit("/"))), "stem", F.lit("."), "ext")
    return f.join(p, "p_partkey").select(path.alias("path"), "is_test").distinct()


@query(with_ctes("files", """, f AS (SELECT DISTINCT (CASE WHEN is_test THEN 'tests/' ELSE 'src/' END) || brand || '/' || (CASE WHEN is_test THEN 'test_' ELSE '' END) || leaf || '.' || ext AS path, is_test, ext, brand,
    CASE WHEN is_test AND ext = 'java' THEN 'test_' || leaf ELSE leaf END AS leaf
    FROM (SELECT is_test, ext, string_split(package, '/')[1] AS brand, replace(p_name, ' ', '_') AS leaf FROM files JOIN part ON p_partkey = node)),
  alone AS (SELECT ext, leaf, min(path) AS source FROM f WHERE NOT is_test GROUP BY ALL HAVING count(*) = 1)
SELECT s.path AS source, t.path AS test FROM f s JOIN f t USING (ext, brand, leaf) WHERE NOT s.is_test AND t.is_test UNION SELECT source, t.path FROM alone JOIN f t USING (ext, leaf) WHERE t.is_test"""))
def j17_tests_by_name(spark, d):
    return symbols.tests_by_name(_named_files(spark, d))


@query(with_ctes("files", """, f AS (SELECT DISTINCT (CASE WHEN is_test THEN 'tests/' ELSE 'src/' END) || brand || '/' || (CASE WHEN is_test THEN 'test_' ELSE '' END) || leaf || '.' || ext AS path, is_test AS placed, CASE WHEN is_test AND ext <> 'java' THEN leaf WHEN is_test THEN 'test_' || leaf ELSE leaf END AS leaf
    FROM (SELECT is_test, ext, string_split(package, '/')[1] AS brand, replace(p_name, ' ', '_') AS leaf FROM files JOIN part ON p_partkey = node))
SELECT path, placed AS is_test, leaf FROM f"""))
def p6_test_files(spark, d):
    f = _named_files(spark, d)
    return f.select("path", paths.is_test(F.col("path")).alias("is_test"), paths.test_stem(F.col("path")).alias("leaf"))


# Names and shapes


@query("SELECT DISTINCT p_name, string_split(p_name, ' ') AS tokens FROM part")
def f5_name_tokens(spark, d):
    words = F.split("p_name", " ")
    camel = F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, 99), lambda w: F.initcap(w)), ""))
    return table(spark, d, "part").select("p_name", name_tokens(camel).alias("tokens")).distinct()


@query("""SELECT s_suppkey, p_partkey, round(CASE WHEN s_nationkey = 0 AND p_size = 0 THEN 1.0 ELSE least(s_nationkey, p_size) / greatest(s_nationkey, p_size, 1)::DOUBLE END, 6) AS alike FROM supplier JOIN part ON p_partkey = s_suppkey""")
def f8_number_similarity(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return j.select("s_suppkey", "p_partkey", F.round(number(F.col("s_nationkey"), F.col("p_size")), 6).alias("alike"))


@query("""WITH a AS (SELECT n_nationkey AS file_a, n_name AS name_a, n_regionkey AS p, n_nationkey AS b FROM nation), f AS (SELECT 1000 + p_partkey AS file_b, p_name AS name_b, p_size % 7 AS p, p_size AS b FROM part),
  n AS (SELECT file_a, name_a, file_b, name_b, CASE WHEN a.p = 0 AND f.p = 0 THEN 1.0 ELSE least(a.p, f.p) / greatest(a.p, f.p, 1)::DOUBLE END AS params, CASE WHEN a.b = 0 AND f.b = 0 THEN 1.0 ELSE least(a.b, f.b) / greatest(a.b, f.b, 1)::DOUBLE END AS branches FROM a, f),
  s AS (SELECT file_a, name_a, file_b, name_b, round(0.75 * (0.25 * params + 0.4 + 0.35 * (0.3 + 0.1 + 0.2 + 0.2 * branches + 0.2)), 9) AS score FROM n),
  r AS (SELECT *, row_number() OVER (PARTITION BY file_a, name_a ORDER BY score DESC, file_b, name_b) AS rank FROM s WHERE score >= 0.5)
SELECT file_a, name_a, file_b, name_b, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def j20_reuse_candidates(spark, d):
    """Nations stand for changed functions, parts for all others; shapes differ in parameters and branches."""

    def shape(params, branches):
        none = F.array().cast("array<string>")
        return F.struct(params.alias("paramCount"), branches.alias("branchCount"), F.lit(0).alias("returnCount"), none.alias("callCallees"), *[F.lit(False).alias(n) for n in ("isAsync", "isGenerator", "hasTryCatch")]).alias("fingerprint")

    changed = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("name"), shape(F.col("n_regionkey"), F.col("n_nationkey")))
    functions = table(spark, d, "part").select((F.col("p_partkey") + 1000).alias("file"), F.col("p_name").alias("name"), shape(F.col("p_size") % 7, F.col("p_size")))
    return diff.reuse_candidates(changed, functions).select("file_a", "name_a", "file_b", "name_b", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Import resolution


@query(r"""WITH f AS (SELECT DISTINCT 'src/s' || l_suppkey || '/m' || l_partkey || '.js' AS path FROM lineitem),
  i AS (SELECT DISTINCT 'src/s' || l_suppkey || '/m' || l_partkey || '.js' AS path, CASE WHEN l_returnflag = 'N' THEN './m' || l_partkey + 1 WHEN l_returnflag = 'A' THEN '../s' || l_linenumber || '/m' || l_partkey ELSE 'lib' || l_suppkey END AS source,
    CASE WHEN l_returnflag = 'N' THEN 'src/s' || l_suppkey || '/m' || l_partkey + 1 || '.js' WHEN l_returnflag = 'A' THEN 'src/s' || l_linenumber || '/m' || l_partkey || '.js' END AS wanted FROM lineitem)
SELECT i.path, i.source, f.path AS target, wanted IS NULL AND source IN (SELECT 'lib' || s_suppkey FROM supplier WHERE s_acctbal > 0) AS is_external FROM i LEFT JOIN f ON f.path = wanted AND f.path <> i.path""")
def i2_relative_imports(spark, d):
    at = F.concat(F.lit("src/s"), "l_suppkey", F.lit("/m"), "l_partkey", F.lit(".js"))
    source = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("./m"), F.col("l_partkey") + 1)).when(F.col("l_returnflag") == "A", F.concat(F.lit("../s"), "l_linenumber", F.lit("/m"), "l_partkey")).otherwise(F.concat(F.lit("lib"), "l_suppkey"))
    lines, placed, flag = table(spark, d, "lineitem"), at.isNotNull(), F.col("l_returnflag")
    files = lines.filter(placed).select("l_suppkey", "l_partkey").distinct().select(at.alias("path"))
    # Rows are made distinct by what path and source follow from, which is shorter; without a path, by the source.
    of = {"l_suppkey": F.col("l_suppkey"), "l_partkey": F.col("l_partkey"), "l_returnflag": F.when(flag.isin("N", "A"), flag), "l_linenumber": F.when(flag == "A", F.col("l_linenumber"))}
    short = lines.select(*[F.when(placed, c).alias(n) for n, c in of.items()], F.when(~placed, source).alias("odd")).distinct()
    imports = short.select(at.alias("path"), F.lit("javascript").alias("lang"), F.when(placed, source).otherwise(F.col("odd")).alias("source"))
    imports = imports.withColumns({"imported": F.array(F.lit("x")), "uses_all": F.lit(False)})
    manifest = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.lit("").alias("dir"), F.concat(F.lit("lib"), "s_suppkey").alias("name"))
    return resolve.resolve(imports, files, declared=manifest).select("path", "source", "target", "is_external")


# Texts that tools print


@query("SELECT l_orderkey, l_linenumber, l_partkey AS first, l_partkey + l_linenumber - 2 AS last FROM lineitem WHERE l_linenumber > 1")
def s18_hunks(spark, d):
    text = F.concat(F.lit("--- a\n+++ b\n@@ -1 +"), "l_partkey", F.lit(","), F.col("l_linenumber") - 1, F.lit(" @@ f\n-old\n+new"))
    h = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(diff.hunks(text)).alias("h"))
    return h.select("l_orderkey", "l_linenumber", F.col("h.first").cast("long").alias("first"), F.col("h.last").cast("long").alias("last"))


@query("SELECT 'f' || l_partkey AS file, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS removed FROM lineitem GROUP BY ALL")
def s19_numstat(spark, d):
    n = lambda c: F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col(c).cast("long").cast("string"))
    lines = table(spark, d, "lineitem").select(F.concat_ws("\t", n("l_quantity"), n("l_linenumber"), F.concat(F.lit("f"), "l_partkey")).alias("line"))
    return diff.numstat(lines).groupBy("file").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query("""SELECT severity, count(*) AS n, count(DISTINCT file) AS files FROM (SELECT DISTINCT 'src/f' || l_partkey || '.js' AS file, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS col, CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'info' END AS severity FROM lineitem) GROUP BY severity""")
def a17_diagnostics(spark, d):
    file = F.concat(F.lit("src/f"), "l_partkey", F.lit(".js"))
    a = F.concat(file, F.lit("("), "l_linenumber", F.lit(","), "l_suppkey", F.lit("): error unused"))
    n = F.concat(file, F.lit(":"), "l_linenumber", F.lit(":"), "l_suppkey", F.lit(": warning: unused"))
    r = F.concat(file, F.lit(":"), "l_linenumber", F.lit(": unused"))
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r).alias("line"))
    return git.diagnostics(lines).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query(with_ctes("blame_lines", """, m AS (SELECT c_custkey AS alias, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS author FROM customer),
  n AS (SELECT file, coalesce(m.author, b.author) AS author, count(*) AS n FROM blame_lines b LEFT JOIN m ON alias = b.author GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY file) AS lines, count(*) OVER (PARTITION BY file) AS authors, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS r FROM n)
SELECT file, CAST(lines AS BIGINT) AS lines, authors, author AS primary_author, round(n / lines, 6) AS primary_share FROM r WHERE r = 1"""))
def s30_mailmap(spark, d):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("alias"), F.min("c_custkey").over(w).alias("author"))
    return history.knowledge(domain.blame_lines(spark, d), names).withColumn("primary_share", F.round("primary_share", 6))


# Predicates, ratios, set operations


@query(with_ctes("edges", " SELECT source, target FROM edges WHERE NOT is_lazy AND tier <> 'tier3'"))
def p11_cycle_edges(spark, d):
    return graph.cycle_edges(domain.edges(spark, d))


@query(with_ctes("files", " SELECT node, path FROM files WHERE regexp_matches(path, '^brand1[^/]*/promo/.*$') OR regexp_matches(path, '^brand[^/]/.*[.]go$')"))
def p21_globs(spark, d):
    p = F.col("path")
    return domain.files(spark, d).filter(paths.matches(p, "brand1*/PROMO/**") | paths.matches(p, "brand?/**.go")).select("node", "path")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type IN ('error', 'purchase')")
def p16_at_least(spark, d):
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return report.at_least(table(spark, d, "events").select("event_id", level.alias("severity")), "medium")


@query(with_ctes("files edges", """, e AS (SELECT lang, count(*) AS n FROM edges JOIN files ON node = source GROUP BY lang)
SELECT lang, count(*) AS files, coalesce(any_value(n), 0) AS edges, CASE WHEN coalesce(any_value(n), 0) / count(*) < 0.1 OR lang IN ('java', 'kotlin') THEN 'low' ELSE 'high' END AS confidence FROM files LEFT JOIN e USING (lang) GROUP BY lang"""))
def r20_domain_confidence(spark, d):
    f, e = _base(spark, d)
    return report.domain_confidence(f.select(F.col("node").alias("path"), "lang"), e)


@query(with_ctes("files edges", " SELECT target AS node, count(DISTINCT array_to_string(string_split(path, '/')[1:2], '/')) AS crossings FROM edges JOIN files ON node = source GROUP BY target"))
def a26_directory_crossings(spark, d):
    f, e = _base(spark, d)
    near = f.select(F.col("node").alias("source"), paths.prefix(F.col("path"), 2).alias("prefix"))
    return e.join(near, "source").groupBy(F.col("target").alias("node")).agg(F.countDistinct("prefix").alias("crossings"))


@query(with_ctes("files edges", " SELECT (SELECT count(*) FROM files) AS files, count(*) AS edges, round(count(*) / (SELECT count(*) FROM files), 6) AS ratio, count(*) / (SELECT count(*) FROM files) < 0.1 AS sparse, count(*) FILTER (tier = 'tier3') AS weak FROM edges"))
def a21_edge_ratio(spark, d):
    f, e = _base(spark, d)
    s = f.agg(F.count("*").alias("files")).join(e.agg(F.count("*").alias("edges"), F.count_if(F.col("tier") == "tier3").alias("weak")))
    ratio = F.col("edges") / F.col("files")
    return s.select("files", "edges", F.round(ratio, 6).alias("ratio"), (ratio < 0.1).alias("sparse"), "weak")


@query(with_ctes("files edges", " SELECT a.package AS from_package, b.package AS to_package, bool_and(tier = 'tier3') AS weak_only, count(*) AS edges FROM edges JOIN files a ON a.node = source JOIN files b ON b.node = target GROUP BY ALL"))
def g23_weak_packages(spark, d):
    f, e = _base(spark, d)
    p = f.select("node", "package")
    j = e.join(p.toDF("source", "from_package"), "source").join(p.toDF("target", "to_package"), "target")
    return j.groupBy("from_package", "to_package").agg(F.min(F.col("tier") == "tier3").alias("weak_only"), F.count("*").alias("edges"))


@query(with_ctes("files edges", " SELECT DISTINCT source AS node FROM edges WHERE target IN (SELECT node FROM files WHERE is_entry) EXCEPT SELECT node FROM files WHERE is_entry"))
def u1_entry_dependents(spark, d):
    f, e = _base(spark, d)
    entries = f.filter("is_entry").select("node")
    return e.join(entries.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node")).distinct().join(entries, "node", "left_anti")


@query(with_ctes("blame_lines", """, n AS (SELECT file, author, count(*) AS n FROM blame_lines GROUP BY ALL), s AS (SELECT file, count(*) AS authors, max(n) / sum(n) AS share FROM n GROUP BY file)
SELECT file, authors, CASE WHEN authors = 1 THEN 'high' ELSE 'medium' END AS level FROM s WHERE authors <= 2 OR share > 0.8"""))
def q5_knowledge_risk(spark, d):
    k = history.knowledge(domain.blame_lines(spark, d))
    return k.withColumn("level", history.knowledge_level(F.col("authors"), F.col("primary_share"))).filter("level IN ('high', 'medium')").select("file", "authors", "level")


@query(with_ctes("files edges", f", {_HUB} SELECT root, source AS node, CAST(source AS VARCHAR) || ' imports ' || root || ' (distance 1)' AS sentence FROM edges JOIN hub ON target = root"))
def r17_explanations(spark, d):
    f, e = _base(spark, d)
    return report.explanations(graph.impact_radius(f, e, _hub(e), 1).filter("level = 1"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_linestatus NOT IN ('O', 'F') THEN 'unavailable' WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'degraded' ELSE 'certain' END AS quality FROM lineitem")
def r14_worst_quality(spark, d):
    flag = F.when(F.col("l_returnflag") == "N", "certain").when(F.col("l_returnflag") == "A", "degraded")
    status = F.when(F.col("l_linestatus") == "O", "certain").when(F.col("l_linestatus") == "F", "degraded")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.worst_quality(flag, status).alias("quality"))


@query(with_ctes("files edges export_records import_records", """, i AS (SELECT target, count(DISTINCT source) AS n FROM import_records GROUP BY target), r AS (SELECT path, coalesce(n, 0) AS n FROM files LEFT JOIN i ON target = node)
SELECT reason, count(*) AS files FROM (SELECT CASE WHEN n = 0 THEN 'likely-dead' ELSE 'uncertain' END AS reason FROM r) GROUP BY reason"""))
def a14_reasons(spark, d):
    f = domain.files(spark, d)
    who = domain.import_records(spark, d).groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("importers"))
    reason = findings.dead_reason(F.col("path"), F.coalesce("importers", F.lit(0)), F.lit(False))
    return f.join(who, "node", "left").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("files"))
