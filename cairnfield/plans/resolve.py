"""Import resolution: specifiers to files, by joins of candidate paths with the file table.

Every strategy writes the paths that a specifier may mean, in order; the first of them that is there wins. An import meets
the files by what its paths have in common, their stem, so that hardly more rows than imports are dealt out; the paths
themselves are looked up among the files of that stem. All languages are resolved by one explode and one join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname

#: Endings that a script specifier may leave out; confidences and source roots.
JS_ENDINGS = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
JAVA_ROOTS = ("", "src/main/java/", "src/test/java/", "src/", "app/src/main/java/", "src/main/kotlin/")
CONFIDENCE = {"tier1": 1.0, "tier2": 0.8, "tier3": 0.3}
#: Standard modules that are never files of a project, by first part.
BUILTIN = {
    "javascript": ("fs", "path", "os", "http", "https", "util", "events", "stream", "crypto", "child_process", "assert", "url", "zlib", "buffer", "net", "worker_threads"),
    "python": ("os", "sys", "re", "json", "math", "typing", "collections", "itertools", "functools", "pathlib", "subprocess", "logging", "datetime", "abc", "dataclasses", "unittest", "asyncio", "time"),
    "java": ("java", "javax", "jdk", "sun"),
    "kotlin": ("kotlin", "kotlinx", "java", "javax"),
    "go": ("fmt", "os", "io", "net", "strings", "errors", "context", "sync", "time", "bytes", "encoding", "log", "math", "sort", "strconv", "testing"),
    "rust": ("std", "core", "alloc"),
}
SCRIPTS = ("javascript", "typescript", "vue", "svelte")
#: Endings that stems are without.
ENDING = r"\.(jsx?|tsx?|mjs|cjs|vue|svelte|py|java|kt|rs)\z"


def joined(base: Column, rest: Column) -> Column:
    """base/rest with . and .. taken out; a .. above the root leads nowhere (null)."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit("")), rest), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        up = p == ".."
        kept = F.when(up, F.slice(acc["a"], F.lit(1), F.greatest(F.size(acc["a"]) - 1, F.lit(0)))).otherwise(F.concat(acc["a"], F.array(p)))
        return F.struct(kept.alias("a"), (acc["ok"] & ~(up & (F.size(acc["a"]) == 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["a"], "/")))


def _endings(p: Column, endings: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(p, e))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _folder(p: Column) -> Column:
    return F.regexp_replace(p, r"/(index|__init__|mod)\z", "")


def stem(p: Column) -> Column:
    """A path without its ending, then without the name of a directory's own module."""
    return _folder(F.regexp_replace(p, ENDING, ""))


def external(lang: Column, source: Column, declared: Column | None = None) -> Column:
    """Standard modules, and packages that the project declares."""
    out = F.lit(False)
    for name, known in BUILTIN.items():
        of = lang.isin(*SCRIPTS) if name == "javascript" else lang == name
        first = F.split(F.regexp_replace(source, "^node:", ""), r"[./:]")[0]
        out = out | (of & first.isin(*known)) | (of & F.lit(name == "javascript") & source.startswith("node:"))
    return out if declared is None else out | declared


def _js_target(aliases: Mapping[str, str] | None) -> Column:
    s = F.col("source")
    target = F.when(s.startswith("."), joined(dirname(F.col("path")), s)).when(s.startswith("/"), s.substr(F.lit(2), F.length(s)))
    for prefix, base in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        stem, to = prefix.rstrip("*"), base.rstrip("*")
        target = target.when(s.startswith(stem), joined(F.lit(to), s.substr(F.lit(len(stem) + 1), F.length(s))))
    return target


def _swapped(target: Column) -> Column:
    return F.regexp_replace(target, r"\.js$", "")  # TypeScript sources are imported by the name they compile to


def js(aliases: Mapping[str, str] | None = None) -> Column:
    """Relative specifiers, and prefixes that the configuration maps to directories."""
    return _let(_js_target(aliases), lambda t: F.concat(_endings(t, JS_ENDINGS), _endings(_swapped(t), (".ts", ".tsx"))))


def py(roots: Sequence[str] = ("", "src/")) -> Column:
    """From the importer's package by dots, else from a source root; an imported name may be a module of the
    package, which comes first, and a package itself is its __init__."""
    s = F.col("source")
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(s, r"^\.+", ""), r"\.", "/")
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int"))
    near = joined(dirname(F.col("path")), F.concat(up, rest))
    files = lambda base: F.concat(F.transform("imported", lambda n: F.concat(base, F.lit("/"), n, F.lit(".py"))), _endings(base, (".py", "/__init__.py")))
    far = F.concat(*[files(joined(F.lit(r), rest)) for r in roots], files(joined(dirname(F.col("path")), rest)))
    return F.when(dots > 0, files(near)).otherwise(far)


def jvm(endings: Sequence[str] = (".java", ".kt")) -> Column:
    """I4: a class below a source root; for a nested or static name also its outer class."""
    base = F.regexp_replace(F.col("source"), r"\.", "/")
    outer = F.regexp_replace(base, "/[^/]+$", "")
    return F.concat(*[F.transform(F.array(*[F.concat(F.lit(r), b, F.lit(e)) for r in JAVA_ROOTS for e in endings]), lambda x: x) for b in (base, outer)])


def rs() -> Column:
    """Crate, super and self paths; a module is name.rs or name/mod.rs, and the last part may be an item in it."""
    s, here = F.col("source"), dirname(F.col("path"))
    inner = F.regexp_replace(F.regexp_replace(s, r"^(crate|self|super)(::super)*(::|$)", ""), "::", "/")
    base = F.when(s.startswith("crate"), joined(F.lit("src"), inner)).when(s.startswith("self"), joined(here, inner)).when(s.startswith("super"), joined(here, F.concat(F.lit("./"), inner))).otherwise(joined(here, F.regexp_replace(s, "::", "/")))
    item = F.regexp_replace(base, "/[^/]+$", "")
    return F.concat(*[_endings(b, (".rs", "/mod.rs")) for b in (base, item)])


def c() -> Column:
    """Quoted includes, beside the file or below include and src."""
    s = F.col("source")
    return F.array(joined(dirname(F.col("path")), s), joined(F.lit("include"), s), joined(F.lit("src"), s), s)


def candidates(aliases: Mapping[str, str] | None = None) -> Column:
    """The paths an import record may mean, by language; empty for Go, whose imports are directories."""
    lang = F.col("lang")
    return F.when(lang.isin(*SCRIPTS), js(aliases)).when(lang == "python", py()).when(lang.isin("java", "kotlin"), jvm()).when(lang == "rust", rs()).when(lang.isin("c", "cpp"), c()).otherwise(F.array().cast("array<string>"))


def stems(aliases: Mapping[str, str] | None = None) -> Column:
    """The stems of candidates(), each once; scripts' are told from the target, without writing its fifteen paths."""
    of_scripts = _let(_js_target(aliases), lambda t: F.array(stem(t), _folder(t), t, _folder(_swapped(t))))
    return F.array_distinct(F.when(F.col("lang").isin(*SCRIPTS), of_scripts).otherwise(F.transform(candidates(aliases), stem)))


def resolve(imports: DataFrame, files: DataFrame, aliases: Mapping[str, str] | None = None, go_module: str = "", declared: DataFrame | None = None) -> DataFrame:
    """imports with target, tier, method, confidence and is_external; target is null where nothing was found.

    imports(path, lang, source, imported, ...), files(path[, is_test]); declared(path, name) are packages by manifest
    directory. First path found wins (I1-I7); Go and Java packages expand to all their files (J10, J11).
    """
    single = (F.col("lang") == "python") & (F.size("imported") > 1)  # each name may be a module of its own
    names = F.when(single, F.transform("imported", lambda n: F.array(n))).otherwise(F.array("imported"))
    imports = imports.withColumn("one", F.explode(names)).withColumn("imported", F.col("one")).drop("one")
    keyed = imports.withColumn("import_id", F.xxhash64("path", "source", F.array_join("imported", ","), "lang", *[c for c in ("line",) if c in imports.columns]))
    own = files.select(stem(F.col("path")).alias("stem"), "path").select("stem", F.col("path").substr(F.length("stem") + 1, F.length("path")).alias("ending"))
    meant = keyed.select("import_id", F.explode(stems(aliases)).alias("stem")).filter("stem IS NOT NULL")
    near = meant.join(own.hint("merge"), "stem")  # Spark takes the exploded side for hardly larger than the imports, and would broadcast it
    near = near.groupBy("import_id").agg(F.collect_set(F.concat("stem", "ending")).alias("near"))
    first = F.when(F.col("near").isNotNull(), F.get(F.filter(candidates(aliases), lambda p: F.array_contains("near", p)), F.lit(0)))
    members = files.filter("NOT is_test") if "is_test" in files.columns else files
    members = members.select(F.col("path").alias("target"), dirname(F.col("path")).alias("dir")).distinct()
    inside = F.when(F.lit(bool(go_module)) & F.col("source").startswith(go_module), F.regexp_replace(F.col("source").substr(F.lit(len(go_module) + 1), F.length("source")), "^/", "")).when(F.col("source").startswith("."), joined(dirname(F.col("path")), F.col("source")))
    flagged = (lambda df: df) if declared is None else lambda df: with_declared(df, declared, keyed, ("import_id",))
    once = lambda langs: flagged(keyed.filter(F.col("lang").isin(*langs)).dropDuplicates(["import_id"]))
    go = once(["go"]).withColumn("dir", inside).withColumns({"known": F.lit(None).cast("string"), "method": F.lit("package")})
    go_files = members.filter(F.col("target").endswith(".go"))
    spread = F.explode(F.array(*[F.concat(F.lit(r), F.regexp_replace("source", r"\.", "/")) for r in JAVA_ROOTS]))
    wild = once(["java", "kotlin"]).filter("uses_all").join(near, "import_id", "left").withColumn("known", first).withColumn("dir", spread).withColumn("method", F.lit("wildcard"))
    jvm_files = members.filter(F.col("target").rlike(r"\.(java|kt)$"))
    # An import has a directory once and a directory a file once, so the expansion has no row twice, and isn't dealt out
    # again; whether it has rows is told from the directories, of which Spark can't know how many the explode makes.
    cols = [*imports.columns, *(["is_declared"] if declared is not None else []), "target", "method"]
    grown, some = [], None
    for found_in, inner in ((go, go_files), (wild, jvm_files)):
        grown.append(found_in.join(inner.hint("merge"), "dir").filter((F.col("target") != F.col("path")) & ~F.col("target").eqNullSafe(F.col("known"))).select(*cols))
        least = inner.groupBy("dir").agg(F.count("*").alias("n"), F.min("target").alias("least"))
        ids = found_in.join(least.hint("merge"), "dir").filter("n > 1 OR least <> path").select("import_id")
        some = ids if some is None else some.union(ids)
    # Imports are dealt out once, by their number; of equal ones that have a target, the first stands for all.
    nth = F.row_number().over(Window.partitionBy("import_id").orderBy(F.lit(0)))
    out = keyed.withColumn("nth", nth).join(near.hint("merge"), "import_id", "left").join(some.distinct().withColumn("has_more", F.lit(True)), "import_id", "left")
    out = flagged(out.withColumn("target", first)).withColumn("target", F.when(F.col("target") != F.col("path"), F.col("target")))
    out = out.filter("CASE WHEN target IS NOT NULL THEN nth = 1 ELSE has_more IS NULL END").withColumn("method", F.when(F.col("target").isNotNull(), "path")).select(*cols)
    for more in grown:
        out = out.union(more)
    ext = external(F.col("lang"), F.col("source"), F.col("is_declared") if declared is not None else None)
    tier = F.when(F.col("target").isNotNull(), "tier1")
    return out.withColumn("tier", tier).withColumn("confidence", F.when(F.col("target").isNotNull(), 1.0)).withColumn("is_external", F.col("target").isNull() & ext)


def with_declared(imports: DataFrame, declared: DataFrame, known: DataFrame | None = None, by: Sequence[str] = ("path", "root")) -> DataFrame:
    """Whether the nearest manifest above a file declares the import's package: the directories above the file meet
    the manifests' directories, and the deepest one with any declaration decides.

    Only packages that are imported meet the declarations. known are the imports to learn it from, if not the same; by
    are columns that path and package follow from.
    """
    root = F.regexp_extract("source", r"^(@[^/]+/[^/]+|[^/.:]+)", 1)
    wanted = (imports if known is None else known).withColumns({"root": root, "here": F.coalesce(dirname(F.col("path")), F.lit(""))}).filter("root <> ''").select(*dict.fromkeys([*by, "here", "root"]))
    pairs = wanted.select("here", "root").distinct()
    parts = F.split("here", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nearest = pairs.select("here").distinct().select("here", F.explode(F.array_distinct(above)).alias("dir")).join(declared.select("dir").distinct(), "dir").groupBy("here").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    named = pairs.join(nearest, "here").join(declared.select("dir", F.col("name").alias("root")).distinct(), ["dir", "root"]).select("here", "root")
    flags = wanted.join(named, ["here", "root"]).select(*by).distinct().withColumn("is_declared", F.lit(True))
    return imports.withColumn("root", root).join(flags, list(by), "left").withColumn("is_declared", F.coalesce("is_declared", F.lit(False))).drop("root")


def by_symbol(unresolved: DataFrame, exports: DataFrame, languages: Sequence[str] = ("java", "kotlin", "go", "rust", "c", "cpp")) -> DataFrame:
    """I8: (path, source, target) where just one file exports the name that a specifier ends in; not for scripts or
    Python, whose specifiers are paths. Tier 2."""
    name = F.element_at(F.split("source", r"[./:]+"), -1)
    only = exports.filter("is_exported").select("name", "path").distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("target")).filter("n = 1")
    out = unresolved.select("path", "source", "lang").filter(F.col("lang").isin(*languages)).withColumn("name", name).join(only.select("name", "target"), "name").filter("target <> path")
    return out.select("path", "source", "target", F.lit("tier2").alias("tier"), F.lit("symbol").alias("method"), F.lit(CONFIDENCE["tier2"]).alias("confidence"))


def same_package(files: DataFrame, exports: DataFrame, calls: DataFrame) -> DataFrame:
    """(source, target) of JVM and Go files of one directory, the first calling a name that the second exports.

    The join is on directory and name, so a directory of n files doesn't make n * n rows. Tier 3.
    """
    f = files.filter(F.col("lang").isin("java", "kotlin", "go")).select("path", dirname(F.col("path")).alias("dir"))
    has = exports.select("path", "name").distinct().join(f, "path").select("dir", "name", F.col("path").alias("target"))
    wants = calls.select("path", "name").distinct().join(f, "path").select("dir", "name", F.col("path").alias("source"))
    out = wants.join(has, ["dir", "name"]).filter("source <> target").select("source", "target").distinct()
    return out.withColumn("tier", F.lit("tier3")).withColumn("method", F.lit("same-package")).withColumn("confidence", F.lit(CONFIDENCE["tier3"]))


#: Imports that frameworks make from strings: (id, language pattern, expression whose first group is the specifier).
IMPLICIT: list[tuple[str, str, str]] = [
    ("router-component", "javascript|typescript|vue", r"component\s*:\s*\(\)\s*=>\s*import\(\s*['\"]([^'\"]+)['\"]"),
    ("react-lazy", "javascript|typescript", r"\blazy\(\s*\(\)\s*=>\s*import\(\s*['\"]([^'\"]+)['\"]"),
    ("next-dynamic", "javascript|typescript", r"\bdynamic\(\s*\(\)\s*=>\s*import\(\s*['\"]([^'\"]+)['\"]"),
    ("load-children", "javascript|typescript", r"loadChildren\s*:\s*['\"]([^'\"#]+)"),
    ("worker", "javascript|typescript", r"new\s+Worker\(\s*(?:new\s+URL\(\s*)?['\"]([^'\"]+)['\"]"),
    ("django-include", "python", r"\binclude\(\s*['\"]([\w.]+)['\"]"),
]


def implicit_imports(files: DataFrame) -> DataFrame:
    """(path, lang, source, imported, uses_all, pattern) of files(path, lang, text), as import records."""
    found = [_named(langs, expression, name) for name, langs, expression in IMPLICIT]
    out = files.filter("text IS NOT NULL").select("path", "lang", F.explode(F.concat(*found)).alias("x"))
    return out.select("path", "lang", "x.source", F.array().cast("array<string>").alias("imported"), F.lit(True).alias("uses_all"), "x.pattern")


def _named(langs: str, expression: str, name: str) -> Column:
    hits = F.when(F.col("lang").rlike(f"^({langs})$"), F.regexp_extract_all("text", F.lit(expression), 1)).otherwise(F.array().cast("array<string>"))
    return F.transform(hits, lambda s: F.struct(s.alias("source"), F.lit(name).alias("pattern")))


def phases(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Post-processing in order; each phase must be idempotent."""
    for step in steps:
        df = df.transform(step)
    return df


def shadowed(new: DataFrame, files: DataFrame) -> DataFrame:
    """(path, shadows): files whose importers a new file may take, having the same stem and another script ending."""
    stem = lambda p: F.regexp_replace(F.regexp_replace(p, r"\.(jsx?|tsx?|mjs|cjs|vue|svelte|py|java|kt)$", ""), r"/(index|__init__)$", "")
    a = new.select("path", stem(F.col("path")).alias("stem"))
    b = files.select(F.col("path").alias("shadows"), stem(F.col("path")).alias("stem"))
    return a.join(b, "stem").filter("path <> shadows").select("path", "shadows")


def edges(resolved: DataFrame) -> DataFrame:
    """One row per (source, target): the best confidence, lazy and type-only if all its imports are."""
    hit = resolved.filter("target IS NOT NULL")
    lazy = F.min(F.coalesce("is_lazy", F.lit(False))) if "is_lazy" in resolved.columns else F.lit(False)
    typed = F.min(F.coalesce("is_type_only", F.lit(False))) if "is_type_only" in resolved.columns else F.lit(False)
    out = hit.groupBy(F.col("path").alias("source"), "target").agg(F.max("confidence").alias("confidence"), F.min("tier").alias("tier"), F.min("method").alias("method"), lazy.alias("is_lazy"), typed.alias("type_only"))
    return out
