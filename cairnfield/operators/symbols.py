"""Symbol-level impact, function-level impact, tests by name and mention, the project map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..lineage import cut


def symbol_dependents(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, user, all) of symbols(file, name): who imports the name, or everything of its file.

    imports(path, target, imported, uses_all): names are exploded and met by equality; importers of everything are a
    union beside, so there is no condition but equality.
    """
    i = imports.filter("target IS NOT NULL")
    named = i.select(F.col("path").alias("user"), F.col("target").alias("file"), F.explode("imported").alias("name")).join(symbols, ["file", "name"]).select("file", "name", "user", F.lit(False).alias("all"))
    whole = i.filter("uses_all").select(F.col("path").alias("user"), F.col("target").alias("file")).join(symbols, "file").select("file", "name", "user", F.lit(True).alias("all"))
    return named.union(whole).groupBy("file", "name", "user").agg(F.min("all").alias("all"))


def symbol_impact(imports: DataFrame, symbols: DataFrame, depth: int = 4) -> DataFrame:
    """(file, name, user, level): direct users, and users through chains of re-exports of `depth` steps at most.

    Users and chains are both steps from a file and name to a file, so users of a level are found where the chains are,
    once all chains are known. What is carried is cut at every step: else each plan holds the plans before it many times.
    """
    i = cut(imports.filter("target IS NOT NULL").select("path", "target", "imported", "uses_all", "re_export"))
    one = i.select("path", "target", F.explode("imported").alias("name"), "re_export").distinct()
    whole = i.filter("uses_all").select("path", "target", "re_export").distinct()

    def step(at: DataFrame, named: DataFrame, all_: DataFrame) -> DataFrame:
        by_name = at.join(named, (F.col("file") == F.col("target")) & (at["name"] == named["name"])).select("root", at["name"], "level", "path")
        return by_name.union(at.join(all_, F.col("file") == F.col("target")).select("root", "name", "level", "path"))

    carried = cut(symbols.select(F.col("file").alias("root"), "name", "file", F.lit(1).alias("level")).distinct())
    seen = carried
    for level in range(2, depth + 1):
        hop = step(carried, one.filter("re_export"), whole.filter("re_export")).select("root", "name", F.col("path").alias("file"), F.lit(level).alias("level")).distinct()
        carried = cut(hop.join(seen.select("root", "name", "file"), ["root", "name", "file"], "left_anti"))
        if carried.isEmpty():
            break
        seen = seen.union(carried)
    out = step(seen, one, whole).withColumnRenamed("path", "user")
    return out.groupBy(F.col("root").alias("file"), "name", "user").agg(F.min("level").alias("level"))


def exporting_callers(functions: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """(path, name, exported): for each changed(path, name) itself if it is exported, else the exported functions
    of its file that call it, through callers inside the file."""
    calls = functions.select("path", F.col("name").alias("caller"), "is_exported", F.explode("callees").alias("callee"))
    own = functions.select("path", "name", "is_exported")
    now = changed.select("path", "name", F.col("name").alias("at")).join(own.withColumnRenamed("name", "at"), ["path", "at"])
    done = now.filter("is_exported").select("path", "name", F.col("at").alias("exported"))
    open_, seen = now.filter("NOT is_exported").select("path", "name", "at"), now.select("path", "name", "at")
    for _ in range(depth):
        step = open_.join(calls, (open_["path"] == calls["path"]) & (open_["at"] == calls["callee"])).select(open_["path"], "name", F.col("caller").alias("at"), "is_exported").distinct()
        step = step.join(seen, ["path", "name", "at"], "left_anti").select("path", "name", "at", "is_exported")
        done = done.union(step.filter("is_exported").select("path", "name", "at"))
        open_ = step.filter("NOT is_exported").select("path", "name", "at")
        seen = seen.union(step.select("path", "name", "at"))
    return done.distinct()


def function_tests(impact: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, name, test, distance) from impact(file, name, user) and tests(root, test, distance) of the users."""
    hit = impact.join(tests, F.col("user") == F.col("root")).select("file", "name", "test", (F.col("distance") + 1).alias("distance"))
    return hit.groupBy("file", "name", "test").agg(F.min("distance").alias("distance"))


def called_in_importers(dead: DataFrame, imports: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, name) of dead(path, name) that an importer's text calls. Called names are taken out of a text once,
    and meet the candidates by equality."""
    called = texts.select(F.col("path").alias("user"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), 1))).alias("name"))
    pairs = imports.filter("target IS NOT NULL").select(F.col("path").alias("user"), F.col("target").alias("path")).distinct()
    return dead.select("path", "name").join(pairs, "path").join(called, ["user", "name"], "left_semi").select("path", "name").distinct()


def called_locally(dead: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, name) of dead that the file itself uses, lines with the declaration or an export aside."""
    lines = texts.select("path", F.explode(F.split("text", "\r?\n")).alias("s")).filter(~F.col("s").rlike(r"\b(export|function|def|class|fn|func)\b"))
    used = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("name")).distinct()
    return dead.select("path", "name").join(used, ["path", "name"], "left_semi")


def tests_by_name(files: DataFrame) -> DataFrame:
    """(source, test) of one language family and signature, or of one family and leaf name where the leaf is
    unique among the sources."""
    f = files.select("path", "is_test", paths.family(F.col("path")).alias("family"), paths.signature(F.col("path")).alias("sig"), paths.test_stem(F.col("path")).alias("leaf")).filter("family <> 'unknown' AND leaf <> ''")
    src, tst = f.filter("NOT is_test"), f.filter("is_test")
    exact = src.select(F.col("path").alias("source"), "family", "sig").join(tst.select(F.col("path").alias("test"), "family", "sig"), ["family", "sig"]).select("source", "test")
    alone = src.groupBy("family", "leaf").agg(F.count("*").alias("n"), F.min("path").alias("source")).filter("n = 1")
    by_leaf = alone.join(tst.select(F.col("path").alias("test"), "family", "leaf"), ["family", "leaf"]).select("source", "test")
    return exact.union(by_leaf).distinct()


def tests_by_mention(files: DataFrame, texts: DataFrame, least: int = 4) -> DataFrame:
    """(source, test) where a test's text, without comments, holds the source's stem as a word."""
    stems = files.filter("NOT is_test").select(F.col("path").alias("source"), F.lower(paths.stem(F.col("path"))).alias("w")).filter(F.length("w") >= least)
    plain = stems.filter(F.col("w").rlike(r"^\w+$"))
    seen = texts.join(files.filter("is_test").select("path"), "path", "left_semi").select(F.col("path").alias("test"), F.lower("text").alias("t"))
    words = seen.select("test", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\w+"), 0))).alias("w"))
    by_word = plain.join(words, "w").select("source", "test")
    parts = stems.filter(~F.col("w").rlike(r"^\w+$")).withColumn("first", F.regexp_extract("w", r"\w+", 0))
    by_parts = parts.join(words.withColumnRenamed("w", "first"), "first").join(seen, "test").filter(F.contains("t", "w")).select("source", "test")
    return by_word.union(by_parts).distinct()


def all_affected_tests(graph_tests: DataFrame, by_name: DataFrame, by_mention: DataFrame, depth: int = 5) -> DataFrame:
    """(source, test, signal, distance): one signal a pair, graph before name before mention."""
    g = graph_tests.select(F.col("root").alias("source"), "test", F.lit("graph").alias("signal"), F.col("distance").cast("int").alias("distance"), F.lit(0).alias("order"))
    n = by_name.select("source", "test", F.lit("heuristic"), F.lit(depth + 1), F.lit(1))
    m = by_mention.select("source", "test", F.lit("mention"), F.lit(depth + 2), F.lit(2))
    w = Window.partitionBy("source", "test").orderBy("order", "distance")
    return g.union(n).union(m).withColumn("r", F.row_number().over(w)).filter("r = 1").select("source", "test", "signal", "distance")


def project_map(files: DataFrame, edges: DataFrame, issues: DataFrame, levels: int = 3) -> dict[str, DataFrame]:
    """Tree (directory, files, size), module edges and issues by module."""
    module = paths.prefix(F.col("path"), levels)
    dirs = F.split(paths.dirname(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(dirs), F.lit(levels))), lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/"))
    tree = files.select(F.explode(above).alias("directory"), "size").groupBy("directory").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    m = files.select("path", module.alias("module"))
    pairs = edges.join(m.select(F.col("path").alias("source"), F.col("module").alias("a")), "source").join(m.select(F.col("path").alias("target"), F.col("module").alias("b")), "target")
    return {"tree": tree, "edges": pairs.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "issues": issues.join(m, "path").groupBy("module", "category").agg(F.count("*").alias("n"))}
