"""Diffs: baselines, changed ranges, contracts, change types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import url_path
from ..functions.similarity import name_tokens, similarity, structural


def baseline(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status fixed, new or open, by one full outer join."""
    a = previous.select(*keys).distinct().withColumn("was", F.lit(True))
    b = current.select(*keys).distinct().withColumn("is", F.lit(True))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("open")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def regression_status(diff: DataFrame) -> DataFrame:
    """Counts by status, degraded if anything is new."""
    n = {s: F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("new", "fixed", "open")}
    return diff.agg(*n.values()).fillna(0).withColumn("verdict", F.when(F.col("new") > 0, "degraded").otherwise("ok"))


def origin(findings: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """Findings with origin: introduced in changed(file), or inherited."""
    mark = changed.select(F.col("file").alias(key)).distinct().withColumn("hit", F.lit(True))
    return findings.join(mark, key, "left").withColumn("origin", F.when(F.col("hit"), "introduced").otherwise("inherited")).drop("hit")


def relevant(findings: DataFrame, changed: DataFrame, radius: DataFrame, key: str = "file") -> DataFrame:
    """Findings in changed(file) or in its impact radius(node)."""
    near = changed.select(F.col("file").alias(key)).union(radius.select("node")).distinct()
    return findings.join(near, key, "left_semi")


def changed_functions(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """functions(file, name, start, end) that overlap ranges(file, first, last), ends included; equi on file first."""
    return functions.join(ranges, "file").filter((F.col("start") <= F.col("last")) & (F.col("first") <= F.col("end"))).select("file", "name", "start", "end").distinct()


def overlapping(functions: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """J8 for files with very many functions and ranges: both sides are dealt to the blocks of `width` lines that they
    touch, so the join is on (file, block), and each overlap counts in its first block alone."""

    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.filter(F.col(a) <= F.col(b)).withColumn("block", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))

    both = dealt(functions, "start", "end").join(dealt(ranges, "first", "last"), ["file", "block"])
    hit = (F.col("start") <= F.col("last")) & (F.col("first") <= F.col("end")) & (F.col("block") == F.floor(F.greatest("start", "first") / width))
    return both.filter(hit).drop("block")


def hunks(diff: Column) -> Column:
    """array<struct<first, last>> of the new side's ranges in a unified diff; empty ranges are dropped."""
    heads = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), 1)
    parsed = F.transform(heads, lambda h: F.struct(F.split(h, ",")[0].cast("int").alias("first"), F.coalesce(F.get(F.split(h, ","), F.lit(1)).cast("int"), F.lit(1)).alias("n")))
    return F.transform(F.filter(parsed, lambda p: p["n"] > 0), lambda p: F.struct(p["first"].alias("first"), (p["first"] + p["n"] - 1).alias("last")))


def numstat(lines: DataFrame) -> DataFrame:
    """(file, added, removed) of numstat lines(line); binary files count as 0."""
    parts = F.split("line", "\t")
    n = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    return lines.filter(F.size(parts) >= 3).select(F.get(parts, F.lit(2)).alias("file"), n(0).alias("added"), n(1).alias("removed"))


def client_calls(sources: DataFrame) -> DataFrame:
    """(file, method, path) of axios and fetch calls in sources(file, text)."""
    axios = F.transform(F.regexp_extract_all("text", F.lit(r"axios\.(?:get|post|put|patch|delete)\(\s*['\"`][^'\"`]+"), 0), lambda m: F.struct(F.upper(F.regexp_extract(m, r"axios\.(\w+)", 1)).alias("method"), F.regexp_extract(m, r"['\"`](.+)$", 1).alias("path")))
    fetch = F.transform(F.regexp_extract_all("text", F.lit(r"\bfetch\(\s*['\"`][^'\"`]+['\"`](?:\s*,\s*\{[^}]*\})?"), 0), lambda m: F.struct(F.upper(F.coalesce(F.nullif(F.regexp_extract(m, r"method\s*:\s*['\"](\w+)", 1), F.lit("")), F.lit("GET"))).alias("method"), F.regexp_extract(m, r"['\"`]([^'\"`]+)", 1).alias("path")))
    return sources.select("file", F.explode(F.concat(axios, fetch)).alias("c")).select("file", "c.method", "c.path")


def server_routes(sources: DataFrame) -> DataFrame:
    """(file, method, path) of route declarations in the whole texts of sources(file, text)."""
    text = F.col("text")
    js = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*['\"`][^'\"`]+"), 0), lambda m: F.struct(F.upper(F.regexp_extract(m, r"\.(\w+)\(", 1)).alias("method"), F.regexp_extract(m, r"['\"`](.+)$", 1).alias("path")))
    py = F.transform(F.regexp_extract_all(text, F.lit(r"@\w+\.(?:get|post|put|patch|delete)\(\s*['\"][^'\"]+"), 0), lambda m: F.struct(F.upper(F.regexp_extract(m, r"\.(\w+)\(", 1)).alias("method"), F.regexp_extract(m, r"['\"](.+)$", 1).alias("path")))
    java = F.transform(F.regexp_extract_all(text, F.lit(r"@(?:Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"[^\"]+"), 0), lambda m: F.struct(F.upper(F.regexp_extract(m, r"@(\w+)Mapping", 1)).alias("method"), F.regexp_extract(m, r"\"(.+)$", 1).alias("path")))
    return sources.select("file", F.explode(F.concat(js, py, java)).alias("c")).select("file", "c.method", "c.path")


def contracts(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(method, path, status, clients, servers): matched, client-only or server-only by method and normalised path."""

    def side(df: DataFrame, name: str) -> DataFrame:
        method = F.when(F.col("method").isNull() | (F.trim("method") == ""), "GET").otherwise(F.upper(F.trim("method")))
        return df.groupBy(method.alias("method"), url_path(F.col("path")).alias("path")).agg(F.countDistinct("file").alias(name))

    both = side(calls, "clients").join(side(routes, "servers"), ["method", "path"], "full_outer")
    status = F.when(F.col("servers").isNull(), "client-only").when(F.col("clients").isNull(), "server-only").otherwise("matched")
    return both.select("method", "path", status.alias("status"), "clients", "servers").fillna(0, ["clients", "servers"])


#: Parts of a fingerprint that shape alone compares.
_SHAPE = ("paramCount", "isAsync", "isGenerator", "hasTryCatch", "branchCount", "returnCount")


def reuse_candidates(changed: DataFrame, functions: DataFrame, least: float = 0.5, top: int = 3) -> DataFrame:
    """For each of changed(file, name[, fingerprint]) the most similar functions of other files.

    Pairs meet without a product of both sides, and none of `least` or more is lost. Names give a quarter of the score
    and callees 0.3 of it, so without a common word and a common callee a pair has 0.45 at most, unless neither calls
    anything. So pairs meet on words and on callees. Those that call nothing meet by shape: shapes are few, each is
    compared once, and as all functions of a shape are alike but for their words, the first few of each stand for it.
    A least score that would need other pairs is refused. Repeated rows count once.
    """
    has = "fingerprint" in changed.columns and "fingerprint" in functions.columns
    if least <= (0.45 if has else 0):
        raise ValueError("a least score that pairs without anything in common may reach")

    def side(df: DataFrame, k: str) -> DataFrame:
        print_ = [F.col("fingerprint").alias(f"print_{k}")] if has else []
        return df.select(F.col("file").alias(f"file_{k}"), F.col("name").alias(f"name_{k}"), *print_).distinct()

    def keyed(df: DataFrame, k: str) -> DataFrame:
        keys = F.transform(name_tokens(F.col(f"name_{k}")), lambda t: F.concat(F.lit("w:"), t))
        if has:
            keys = F.concat(keys, F.coalesce(F.transform(F.col(f"print_{k}.callCallees"), lambda c: F.concat(F.lit("c:"), c)), F.array().cast("array<string>")))
        return df.withColumn("key", F.explode(F.array_distinct(keys)))

    a, b = side(changed, "a"), side(functions, "b")
    columns = [*a.columns, *b.columns]
    pairs = keyed(a, "a").join(keyed(b, "b"), "key").filter("file_a <> file_b").select(*columns).distinct()
    if has:

        def quiet(df: DataFrame, k: str) -> DataFrame:
            print_ = F.col(f"print_{k}")
            parts = [F.coalesce(print_[n], F.lit(False)) if n.startswith(("is", "has")) else print_[n] for n in _SHAPE]
            alone = df.filter(print_.isNotNull() & (F.coalesce(F.size(print_["callCallees"]), F.lit(0)) <= 0))
            return alone.withColumn(f"shape_{k}", F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(0)))

        qa, qb = quiet(a, "a"), quiet(b, "b")
        # Of a shape, `top` functions of each of `top` + 1 files: enough, whichever file the changed one is in.
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("file_b", "name_b"))
        few = qb.withColumn("__n", rank("shape_b", "file_b")).filter(F.col("__n") <= top).drop("__n")
        few = few.withColumn("__f", F.dense_rank().over(Window.partitionBy("shape_b").orderBy("file_b"))).filter(F.col("__f") <= top + 1).drop("__f")
        one = lambda df, k: df.groupBy(f"shape_{k}").agg(F.first(f"print_{k}").alias(f"print_{k}"))
        alike = one(qa, "a").join(one(qb, "b"), structural(F.col("print_a"), F.col("print_b")) * 0.75 >= least - 1e-12).select("shape_a", "shape_b")
        pairs = pairs.union(qa.join(alike, "shape_a").join(few, "shape_b").filter("file_a <> file_b").select(*columns)).distinct()
    score = similarity(F.col("name_a"), F.col("name_b"), *([F.col("print_a"), F.col("print_b")] if has else []))
    pairs = pairs.withColumn("score", score).filter(F.col("score") >= least)
    w = Window.partitionBy("file_a", "name_a").orderBy(F.desc("score"), "file_b", "name_b")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("file_a", "name_a", "file_b", "name_b", "score", "rank")


def change_type(changed: DataFrame) -> DataFrame:
    """One word for a set of changed files(file_role, directory_role)."""
    kind = F.when(F.col("file_role") == "docs", "docs").when(F.col("file_role") == "config", "config").when(F.col("file_role") == "test", "tests").when(F.col("file_role") == "script", "scripts").otherwise("code")
    own = changed.filter(~F.col("directory_role").isin("reference", "archive")).withColumn("kind", kind)
    n = {k: F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("docs", "config", "tests", "scripts", "code")}
    s = own.agg(*n.values()).fillna(0)
    total = sum((F.col(k) for k in n), F.lit(0))
    half = total / 2
    out = (
        F.when(total == 0, "docs").when((F.col("docs") > half) & (F.col("code") == 0) & (F.col("tests") == 0), "docs")
        .when(F.col("tests") > half, "tests").when(F.col("config") > half, "config").when(F.col("scripts") > half, "scripts").when(F.col("code") > half, "code")
        .when(F.col("code") / total > 0.2, "code").when(F.col("tests") > 0, "tests").when(F.col("config") > 0, "config").when(F.col("scripts") > 0, "scripts").when(F.col("docs") > 0, "docs").otherwise("code")
    )
    return s.withColumn("change_type", out)
