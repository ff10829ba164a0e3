"""More of the registry: parsers, resolvers, classifiers and text functions over source texts that are written from parts.

A template names columns of a part between percent signs: %k% its key, %a% and %b% the words of its name, %s% its size.
The query fills templates by column functions, and its SQL states the records that must come out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.comments import stripped
from .functions.similarity import similarity, structural
from .lineage import cut, workshop
from .operators import diff, findings, graph, symbols
from .plans import resolve
from .queries import query
from .sources import adapters, domain, git, parsers, scan, store
from .sources.domain import table, with_ctes
from .streaming import incremental, listeners

_P = "p AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size AS s FROM part)"


def _p(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), words[0].alias("a"), words[1].alias("b"), F.col("p_size").alias("s"))


def _pieces(template: str) -> list[str]:
    return re.split(r"%(\w)%", template)


def _fill(template: str) -> Column:
    """A template as a column."""
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(_pieces(template))])


def _sql(template: str) -> str:
    """A template as SQL."""
    return " || ".join(x if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(_pieces(template)))


def _by(n: int, *templates: str | None) -> Column:
    """The template that the size modulo n picks."""
    out = F
    for i, t in enumerate(templates):
        out = out.when(F.col("s") % n == i, F.lit(None).cast("string") if t is None else _fill(t))
    return out


def _by_sql(n: int, *templates: str | None) -> str:
    return "CASE s % " + str(n) + " " + " ".join(f"WHEN {i} THEN {'NULL' if t is None else _sql(t)}" for i, t in enumerate(templates)) + " END"


# Parsers


def _noted(parsed: DataFrame) -> DataFrame:
    """(path, part, name, first, last, note): import, export and function records as one table."""
    word = lambda c, w: F.when(c, w).otherwise("")
    i = parsers.import_records(parsed)
    imports = F.concat(F.array_join("imported", ","), word(F.col("uses_all"), "*"), word(F.col("re_export"), " re-export"), word(F.col("is_lazy"), " lazy"), word(F.col("is_type_only"), " type"))
    x = parsers.export_records(parsed)
    f = parsers.function_records(parsed)
    shape = F.concat_ws(" ", "param_count", "branch_count", "return_count", F.when(F.col("is_async"), "async"), F.when(~F.col("is_exported"), "private"), F.nullif(F.array_join("callees", ","), F.lit("")))
    out = i.select("path", F.lit("import").alias("part"), F.col("source").alias("name"), F.col("line").alias("first"), F.col("line").alias("last"), imports.alias("note"))
    out = out.union(x.select("path", F.lit("export"), "name", "line_start", "line_end", F.concat("kind", word(~F.col("is_exported"), " private"))))
    return out.union(f.select("path", F.lit("function"), "name", "line_start", "line_end", shape))


def _parser(name: str, lang: str, text: str, *expected: tuple[str, str, int, int, str]) -> None:
    """Registers a query that parses the text of every part; expected are its records."""
    rows = [f"SELECT {_sql('m%k%')} AS path, '{part}' AS part, {_sql(of)} AS name, {first} AS first, {last} AS last, {_sql(note)} AS note FROM p" for part, of, first, last, note in expected]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _noted(parsers.parse(_p(spark, d).select(_fill("m%k%").alias("path"), F.lit(lang).alias("lang"), _fill(text).alias("text"))))

    run.__name__ = name
    query(f"WITH {_P} " + " UNION ALL ".join(rows))(run)


_parser(
    "s6_script_records", "javascript",
    "import { %a%, %b% as other } from './m%k%'\nimport * as ns from '../lib/x%s%'\n// import { no } from './no'\nexport async function f%k%(x, y) {\n  if (x) { return y }\n  return %a%(x)\n}\nexport const %b% = %s%\nexport * from './all%k%'\n",
    ("import", "./m%k%", 1, 1, "%a%,%b%"), ("import", "../lib/x%s%", 2, 2, "*"), ("import", "./all%k%", 9, 9, "* re-export"),
    ("export", "f%k%", 4, 7, "function"), ("export", "%b%", 8, 8, "const"), ("function", "f%k%", 4, 7, "2 1 2 async %a%"),
)
_parser(
    "s7_python_records", "python",
    "import os\nfrom .%a% import %b%, other\n\nclass C%k%:\n    pass\ndef f%k%(x: int, y: int) -> int:\n    import late\n    return %a%(x) if y else 0\ndef _hidden():\n    return 1\n",
    ("import", "os", 1, 1, "*"), ("import", ".%a%", 2, 2, "%b%,other"), ("import", "late", 7, 7, "* lazy"),
    ("export", "C%k%", 4, 5, "class"), ("export", "f%k%", 6, 8, "function"), ("export", "_hidden", 9, 10, "function private"),
    ("function", "f%k%", 6, 8, "2 1 1 %a%"), ("function", "_hidden", 9, 10, "0 0 1 private"),
)
_parser(
    "s8_java_records", "java",
    "package p;\nimport java.util.List;\nimport x.%a%.*;\npublic class C%k% {\n  @Override\n  public int f%k%(int x, int y) { return x; }\n  private void g() { }\n}\n",
    ("import", "java.util.List", 2, 2, "List"), ("import", "x.%a%", 3, 3, "*"), ("export", "C%k%", 4, 8, "class"),
    ("function", "f%k%", 6, 6, "2 0 1"), ("function", "g", 7, 7, "0 0 0 private"),
)
_parser(
    "s9_kotlin_records", "kotlin",
    "package p\nimport x.%a%.%b%\nclass C%k% {\n  fun f%k%(x: Int): Int {\n    return if (x > 0) x else %a%(x)\n  }\n}\n",
    ("import", "x.%a%.%b%", 2, 2, "%b%"), ("export", "C%k%", 3, 7, "class"), ("export", "f%k%", 4, 6, "function"), ("function", "f%k%", 4, 6, "1 1 1 %a%"),
)
_parser(
    "s9_go_records", "go",
    'package m\nimport "x/%a%"\ntype T%k% struct {\n}\nfunc F%k%(x int) int {\n  return %a%.Run(x)\n}\nfunc g() { }\n',
    ("import", "x/%a%", 2, 2, "*"), ("export", "T%k%", 3, 4, "type"), ("export", "F%k%", 5, 7, "function"), ("export", "g", 8, 8, "function private"),
    ("function", "F%k%", 5, 7, "1 0 1 Run"), ("function", "g", 8, 8, "0 0 0 private"),
)
_parser(
    "s9_rust_records", "rust",
    "use crate::%a%::%b%;\npub struct S%k% {\n}\npub fn f%k%(x: i32) -> i32 {\n    match x { 0 => %a%(x), _ => x }\n}\nfn g() {}\n",
    ("import", "crate::%a%::%b%", 1, 1, ""), ("export", "S%k%", 2, 3, "struct"), ("export", "f%k%", 4, 6, "function"), ("export", "g", 7, 7, "function private"),
    ("function", "f%k%", 4, 6, "1 0 0 %a%"), ("function", "g", 7, 7, "0 0 0 private"),
)
_parser(
    "s9_cpp_records", "cpp",
    '#include "%a%.h"\n#include <vector>\nclass C%k% {\n};\nint f%k%(int x) {\n  if (x) { return %a%(x); }\n  return 0;\n}\n',
    ("import", "%a%.h", 1, 1, "*"), ("export", "C%k%", 3, 4, "class"), ("export", "f%k%", 5, 8, "function"), ("function", "f%k%", 5, 8, "1 1 2 %a%"),
)
_parser(
    "s10_regex_fallback", "python",
    "import os\nfrom %a% import %b%\ndef f%k%(x:\n    return\n",
    ("import", "os", 1, 1, "*"), ("import", "%a%", 2, 2, "%b%"), ("export", "f%k%", 3, 3, "function"), ("function", "f%k%", 3, 3, "0 0 0"),
)
_parser(
    "s11_component_records", "vue",
    "<template><p>%a%</p></template>\n<script>\nimport %a% from './%b%.vue'\nconst x = () => import('./lazy%k%')\nexport { x as y%s% }\n</script>\n",
    ("import", "./%b%.vue", 3, 3, "default"), ("import", "./lazy%k%", 4, 4, "* lazy"), ("export", "y%s%", 5, 5, "const"),
)
_parser(
    "s12_c_records", "c",
    '#include "%a%.h"\nstatic int g%k%(int x) { return x; }\nint f%k%(int y) { return g%k%(y); }\n',
    ("import", "%a%.h", 1, 1, "*"), ("export", "g%k%", 2, 2, "function private"), ("export", "f%k%", 3, 3, "function"),
    ("function", "g%k%", 2, 2, "1 0 1 private"), ("function", "f%k%", 3, 3, "1 0 1 g%k%"),
)


@query(f"WITH {_P} SELECT 'f' || k AS name, 'm' || k AS file, 1 AS line, 'function' AS type FROM p UNION ALL SELECT a, 'm' || k, 2, 'const' FROM p UNION ALL SELECT 'C' || k, 'm' || k, 4, 'class' FROM p")
def f29_symbol_lines(spark, d):
    text = _fill("export function f%k%() {}\n  const %a% = 1\n// nothing\nclass C%k% {}")
    return parsers.symbol_index(_p(spark, d).select(_fill("m%k%").alias("path"), F.lit("javascript").alias("lang"), text.alias("text"))).select("name", "file", "line", "type")


@query(f"""WITH {_P} SELECT k, 'a' || k || ' ' || repeat(' ', 3 + length(a)) || chr(10) || 'b = "// ' || b || '" ' || repeat(' ', 6 + length(a)) || ' c' AS code FROM p""")
def f11_comments(spark, d):
    return _p(spark, d).select("k", stripped(_fill('a%k% // %a%\nb = "// %b%" /* %a% */ c'), F.lit("javascript")).alias("code"))


@query(f"WITH {_P} SELECT k AS file, 'POST' AS method, '/api/' || a || '/' || k AS path FROM p UNION ALL SELECT k, 'GET', '/x/' || b FROM p UNION ALL SELECT k, 'PUT', '/y/' || s FROM p")
def f21_client_calls(spark, d):
    return diff.client_calls(_p(spark, d).select(F.col("k").alias("file"), _fill("axios.post('/api/%a%/%k%')\nfetch(`/x/%b%`)\nfetch('/y/%s%', { method: 'PUT' })").alias("text")))


@query(f"WITH {_P} SELECT k AS file, 'GET' AS method, '/a/' || a AS path FROM p UNION ALL SELECT k, 'POST', '/b/' || b FROM p UNION ALL SELECT k, 'DELETE', '/c/' || k FROM p")
def f22_server_routes(spark, d):
    """Declarations far into a text count as well."""
    text = F.concat(_fill("app.get('/a/%a%', h)\n"), F.repeat(F.lit("x = 1;\n"), 3000), _fill('@api.post("/b/%b%")\n@DeleteMapping("/c/%k%")'))
    return diff.server_routes(_p(spark, d).select(F.col("k").alias("file"), text.alias("text")))


# Paths, names and classes of files


@query(f"WITH {_P} SELECT k, 'src/' || a || '/' || b || '/f' || k || '.js' AS normal, a || '/' || b || '/f' || k || '.js' AS below FROM p")
def f1_paths(spark, d):
    normal = paths.normalized(_fill("./src//%a%\\%b%/./f%k%.js/"))
    return _p(spark, d).select("k", normal.alias("normal"), paths.relative(normal, "src").alias("below"))


@query(f"WITH {_P} SELECT k, 'src/' || a AS two, 'src/' || a || '/' || b AS three, '.' AS top FROM p")
def f3_prefixes(spark, d):
    path = _fill("src/%a%/%b%/deep/f%k%.js")
    return _p(spark, d).select("k", paths.prefix(path, 2).alias("two"), paths.prefix(path, 3).alias("three"), paths.prefix(_fill("f%k%.js"), 2).alias("top"))


_TESTED = ("src/%a%/%b%.js", "tests/%a%/test_%b%_test.py", "src/test/java/%a%/%b%IntegrationTest.java", "%a%/%b%.spec.ts")


@query(f"WITH {_P} SELECT k, {_by_sql(4, *_TESTED)} AS path, a || '/' || b AS signature, CASE s % 4 WHEN 1 THEN 'python-family' WHEN 2 THEN 'java-family' ELSE 'js-family' END AS family FROM p")
def f4_signatures(spark, d):
    path = _by(4, *_TESTED)
    return _p(spark, d).select("k", path.alias("path"), paths.signature(path).alias("signature"), paths.family(path).alias("family"))


_NUMBER = "CASE WHEN {0} = 0 AND {1} = 0 THEN 1.0 ELSE least({0}, {1}) / greatest({0}, {1}, 1)::DOUBLE END"


@query(f"""WITH {_P}, j AS (SELECT x.k, x.a, x.b, x.s, y.a AS c, y.b AS d, y.s AS t FROM p x JOIN p y ON y.k = x.k + 1),
  m AS (SELECT k, 0.25 * {_NUMBER.format('(s % 5)', '(t % 5)')} + 0.4 * CAST(a = c AS INT) + 0.35 * (0.3 * CAST(s % 2 = t % 2 AS INT) + 0.3 + 0.2 * {_NUMBER.format('s', 't')} + 0.2) AS shape,
    len(list_intersect(list_distinct([a, b]), list_distinct([c, d]))) * 2.0 / (len(list_distinct([a, b])) + len(list_distinct([c, d]))) AS names FROM j)
SELECT k, round(shape + 1e-9, 6) AS shape, round(0.75 * shape + 0.25 * names + 1e-9, 6) AS alike FROM m""")
def f9_structural(spark, d):
    """every part's function beside the next one's."""
    print_ = F.struct((F.col("s") % 5).alias("paramCount"), F.col("s").alias("branchCount"), F.lit(0).alias("returnCount"), F.array("a").alias("callCallees"), (F.col("s") % 2 == 0).alias("isAsync"), F.lit(False).alias("isGenerator"), F.lit(True).alias("hasTryCatch"))
    x = _p(spark, d).select("k", _fill("%a%_%b%").alias("name_a"), print_.alias("a"))
    j = x.join(x.select((F.col("k") - 1).alias("k"), F.col("name_a").alias("name_b"), F.col("a").alias("b")), "k")
    alike = similarity(F.col("name_a"), F.col("name_b"), F.col("a"), F.col("b"))
    return j.select("k", F.round(structural(F.col("a"), F.col("b")) + 1e-9, 6).alias("shape"), F.round(alike + 1e-9, 6).alias("alike"))


_PLACES = ("examples/%a%/dist/f%k%.js", "legacy/%a%/f%k%.js", "dist/%a%/f%k%.js", "src/%a%/legacy/f%k%.js")


@query(f"WITH {_P} SELECT {_by_sql(4, *_PLACES)} AS path, CASE WHEN s % 4 = 0 THEN 'reference' WHEN s % 4 = 1 THEN 'archive' WHEN s % 4 = 2 THEN CASE WHEN a = 'red' THEN 'active' ELSE 'generated' END WHEN a = 'gear' THEN 'archive' ELSE 'active' END AS role FROM p")
def p2_directory_roles(spark, d):
    """Hints count at the top alone, and what is configured goes before them."""
    path = _by(4, *_PLACES)
    return _p(spark, d).select(path.alias("path"), paths.directory_role(path, {"src": "active", "src/gear": "archive", "dist/red": "active"}).alias("role"))


_HINTED = ("app/%a%/page.tsx", "pages/%a%.js", "%a%/urls.py", "src/%a%.js")


@query(f"WITH {_P} SELECT k, {_by_sql(4, 'next-app', 'next-pages', 'django', None)} AS framework FROM p")
def p7_framework_paths(spark, d):
    return _p(spark, d).select("k", scan.framework_hint(_by(4, *_HINTED), F.lit(None).cast("string")).alias("framework"))


_MARKED = (("%k%.py", "@shared_task", "celery"), ("%k%.js", "router.get(", "express"), ("%k%.java", "@RestController", "spring"), ("%k%.go", "gin.New()", "gin"), ("%k%.rs", "Router::new", "axum"), ("%k%.py", "router.get(", None))


@query(f"WITH {_P} SELECT k, {_by_sql(6, *[m[2] for m in _MARKED])} AS framework FROM p")
def p8_framework_marks(spark, d):
    """Marks anywhere in a text tell it, and only in files of the framework's family."""
    text = F.concat(F.repeat(F.lit("x = 1\n"), 1000), _by(6, *[m[1] for m in _MARKED]))
    return _p(spark, d).select("k", scan.framework_hint(_by(6, *[m[0] for m in _MARKED]), text).alias("framework"))


_ENTRIES = ("src/%a%/%k%/main.js", "%a%/%k%/x.py", "bin/%a%%k%.js", "src/%a%/%k%.js")


@query(f"WITH {_P} SELECT {_by_sql(4, *_ENTRIES)} AS path, {_by_sql(4, 'entry', 'library', 'script', 'library')} AS file_role, s % 4 < 3 AS is_entry, false AS is_test, true AS is_mainline FROM p")
def p9_entry_files(spark, d):
    """Classes of files by path and text."""
    text = F.when(F.col("s") % 4 == 1, "if __name__ == '__main__':\n    run()").otherwise("x")
    f = _p(spark, d).select(_by(4, *_ENTRIES).alias("path"), text.alias("text"))
    return scan.classified(f).select("path", "file_role", "is_entry", "is_test", "is_mainline")


_NAMES = ("constructor", "__%a%__", "mockX%k%", "%a%%k%")


@query(f"WITH {_P} SELECT k, {_by_sql(4, *_NAMES)} AS name FROM p WHERE s % 4 = 3")
def p13_dead_names(spark, d):
    name = _by(4, *_NAMES)
    return _p(spark, d).filter(~paths.conventionally_used(name)).select("k", name.alias("name"))


_JAVA = ("x/%a%Constants.java", "x/%a%Utils.java", "x/%a%.java")


@query(f"WITH {_P} SELECT k, CASE WHEN k % 7 = 0 THEN 'likely-dead' WHEN s % 3 < 2 THEN 'java-constants-warehouse' ELSE 'uncertain' END AS reason FROM p")
def p14_warehouses(spark, d):
    return _p(spark, d).select("k", findings.dead_reason(_by(3, *_JAVA), F.col("k") % 7, F.lit(False)).alias("reason"))


_SCAFFOLDS = ("src/SysUser.java", "web/ruoyi/%a%.js", "ruoyi-common/%a%Utils.java", "src/%a%.js")


@query(f"WITH {_P} SELECT k, {_by_sql(4, 'scaffold-ruoyi', 'scaffold-vue-admin', 'scaffold-ruoyi', None)} AS template FROM p")
def p15_scaffolds(spark, d):
    return _p(spark, d).select("k", scan.scaffold(_by(4, *_SCAFFOLDS)).alias("template"))


@query(f"WITH {_P} SELECT k, a AS id FROM p WHERE a NOT IN ('gear', 'red', 'cold')")
def p18_not_ignored(spark, d):
    return scan.not_ignored(_p(spark, d).select("k", F.col("a").alias("id")), ("gear", "red", "cold"))


@query(f"WITH {_P} SELECT 'src/' || k || '.js' AS path, 2 AS line, 'js-hardcoded-secret' AS rule, 'medium' AS severity FROM p WHERE s % 2 = 1")
def p20_allowed(spark, d):
    """Placeholders are allowed below a test directory, and nowhere else."""
    t = _p(spark, d).select(_by(2, "src/test/%k%.js", "src/%k%.js").alias("path"), F.lit("javascript").alias("lang"), _fill("\nconst password = 'example_%k%_word'").alias("text"), F.lit(False).alias("is_test"))
    return findings.security_scan(t).select("path", "line", "rule", "severity")


_OUTSIDE = (("python", "os.path"), ("typescript", "node:fs"), ("java", "java.util.%a%"), ("python", "%a%.x"), ("rust", "std::%a%"), ("go", "x/%a%"))


@query(f"WITH {_P} SELECT k, s % 6 NOT IN (3, 5) AS outside FROM p")
def p22_external(spark, d):
    return _p(spark, d).select("k", resolve.external(_by(6, *[x for x, _ in _OUTSIDE]), _by(6, *[x for _, x in _OUTSIDE])).alias("outside"))


# Resolvers


def _resolver(name: str, lang: str, importer: str, sources: tuple[str, ...], files: tuple[str, ...], targets: tuple[str | None, ...], imported: str = "x", **options) -> None:
    """Registers a query that resolves an import of every part; sources, files and targets go by the size."""
    n = len(sources)

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = _p(spark, d)
        i = p.select(_fill(importer).alias("path"), F.lit(lang).alias("lang"), _by(n, *sources).alias("source"), F.array(_fill(imported)).alias("imported"), F.lit(False).alias("uses_all"))
        return resolve.resolve(i, p.select(_by(n, *files).alias("path")), **options).select("path", "source", "target", "tier", "confidence")

    run.__name__ = name
    query(f"WITH {_P}, r AS (SELECT {_sql(importer)} AS path, {_by_sql(n, *sources)} AS source, {_by_sql(n, *targets)} AS target FROM p) SELECT *, CASE WHEN target IS NOT NULL THEN 'tier1' END AS tier, CASE WHEN target IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM r")(run)


_resolver("i1_alias_imports", "typescript", "src/app/u%k%.ts", ("@/%a%/m%k%", "@/none/m%k%"), ("src/%a%/m%k%.ts", "src/%a%/m%k%.ts"), ("src/%a%/m%k%.ts", None), aliases={"@/*": "src/*"})
_resolver("i3_python_imports", "python", "src/pkg/u%k%.py", (".%a%", "pkg.%a%.m%k%"), ("src/pkg/%a%/m%k%.py",) * 2, ("src/pkg/%a%/m%k%.py",) * 2, imported="m%k%")
_resolver("i4_java_imports", "java", "src/main/java/u/U%k%.java", ("x.%a%.C%k%", "x.%a%.C%k%.Inner", "x.%a%.D%k%"), ("src/main/java/x/%a%/C%k%.java",) * 3, ("src/main/java/x/%a%/C%k%.java",) * 2 + (None,))
_resolver("i6_rust_imports", "rust", "src/%a%/u%k%.rs", ("crate::%a%::m%k%::Item", "self::m%k%"), ("src/%a%/m%k%.rs", "src/%a%/m%k%/mod.rs"), ("src/%a%/m%k%.rs", "src/%a%/m%k%/mod.rs"))
_resolver("i7_includes", "c", "src/%a%/u%k%.c", ("%b%/m%k%.h",) * 3, ("src/%a%/%b%/m%k%.h", "include/%b%/m%k%.h", "other/m%k%.h"), ("src/%a%/%b%/m%k%.h", "include/%b%/m%k%.h", None))


def _expansion(importer: str, member: str) -> str:
    return f"WITH {_P} SELECT {_sql(importer)} AS path, t.member AS target FROM p JOIN (SELECT a, b, s, {_sql(member)} AS member FROM p) t USING (a, b, s)"


@query(_expansion("u/U%k%.java", "src/main/java/x/%a%/%b%/s%s%/C%k%.java"))
def j10_wildcards(spark, d):
    p = _p(spark, d)
    i = p.select(_fill("u/U%k%.java").alias("path"), F.lit("java").alias("lang"), _fill("x.%a%.%b%.s%s%").alias("source"), F.array().cast("array<string>").alias("imported"), F.lit(True).alias("uses_all"))
    return resolve.resolve(i, p.select(_fill("src/main/java/x/%a%/%b%/s%s%/C%k%.java").alias("path"))).select("path", "target")


@query(_expansion("cmd/u%k%.go", "%a%/%b%/s%s%/f%k%.go"))
def j11_go_packages(spark, d):
    """An import of a module's directory means all its files."""
    p = _p(spark, d)
    i = p.select(_fill("cmd/u%k%.go").alias("path"), F.lit("go").alias("lang"), _fill("example/mod/%a%/%b%/s%s%").alias("source"), F.array().cast("array<string>").alias("imported"), F.lit(True).alias("uses_all"))
    return resolve.resolve(i, p.select(_fill("%a%/%b%/s%s%/f%k%.go").alias("path")), go_module="example/mod").select("path", "target")


@query(f"WITH {_P}, one AS (SELECT a, s, min(k) AS t FROM p GROUP BY ALL HAVING count(*) = 1) SELECT 'u/' || k || '.java' AS path, 'q.' || a || s AS source, 'x/f' || t || '.java' AS target, 'tier2' AS tier FROM p JOIN one USING (a, s) WHERE s % 3 <> 0")
def i8_by_symbol(spark, d):
    p = _p(spark, d)
    wanted = p.select(_fill("u/%k%.java").alias("path"), _fill("q.%a%%s%").alias("source"), F.when(F.col("s") % 3 == 0, "python").otherwise("java").alias("lang"))
    return resolve.by_symbol(wanted, p.select(_fill("%a%%s%").alias("name"), _fill("x/f%k%.java").alias("path"), F.lit(True).alias("is_exported"))).select("path", "source", "target", "tier")


@query(f"WITH {_P} SELECT 'm' || k AS path, './views/' || a || k || '.vue' AS source, 'router-component' AS pattern FROM p UNION ALL SELECT 'm' || k, './x' || k, 'react-lazy' FROM p")
def i9_implicit_imports(spark, d):
    text = _fill("{ component: () => import('./views/%a%%k%.vue') }\nconst X = lazy(() => import('./x%k%'))")
    return resolve.implicit_imports(_p(spark, d).select(_fill("m%k%").alias("path"), F.lit("javascript").alias("lang"), text.alias("text"))).select("path", "source", "pattern")


@query(f"WITH {_P} SELECT 'pkg/' || a || '/f' || k || '.js' AS path, CASE WHEN a = 'cold' THEN b = 'gear' ELSE b IN ('gear', 'widget') END AS is_declared FROM p")
def j21_declared(spark, d):
    """The nearest manifest decides."""
    manifests = spark.createDataFrame([("", "gear"), ("", "widget"), ("pkg/cold", "gear")], "dir string, name string")
    i = _p(spark, d).select(_fill("pkg/%a%/f%k%.js").alias("path"), F.col("b").alias("source"))
    return resolve.with_declared(i, manifests).select("path", "is_declared")


@query(f"WITH {_P} SELECT 'src/' || k || '.js' AS path, {_by_sql(2, 'src/%k%.ts', 'src/%k%/index.ts')} AS shadows FROM p")
def g27_shadowed(spark, d):
    p = _p(spark, d)
    return resolve.shadowed(p.select(_fill("src/%k%.js").alias("path")), p.select(_by(2, "src/%k%.ts", "src/%k%/index.ts").alias("path")))


# Symbols, tests and cycles


@query(f"WITH {_P} SELECT 'f' || k AS path, a AS name FROM p WHERE s % 2 = 0")
def g9b_called_in_importers(spark, d):
    p = _p(spark, d)
    dead = p.select(_fill("f%k%").alias("path"), F.col("a").alias("name"))
    i = p.select(_fill("u%k%").alias("path"), _fill("f%k%").alias("target"))
    return symbols.called_in_importers(dead, i, p.select(_fill("u%k%").alias("path"), _by(2, "x = %a%(1)", "x = %a%").alias("text")))


@query(f"WITH {_P} SELECT 'f' || k AS path, a AS name FROM p WHERE s % 2 = 0")
def g9c_called_locally(spark, d):
    p = _p(spark, d)
    text = _by(2, "function %a%() {}\ny = %a% + 1", "function %a%() {}\ny = no%a%")
    return symbols.called_locally(p.select(_fill("f%k%").alias("path"), F.col("a").alias("name")), p.select(_fill("f%k%").alias("path"), text.alias("text")))


@query(f"""WITH {_P}, f AS (SELECT k AS node, a AS name, CASE WHEN s % 3 = 0 AND a IN ('gear', 'red') THEN 'dynamic-registry-export' WHEN s % 3 = 1 AND s % 2 = 1 THEN 'rust-public-api' END AS false_positive FROM p)
SELECT node, name, CASE WHEN false_positive IS NULL THEN 'high' ELSE 'low' END AS confidence, CASE WHEN false_positive IS NULL THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS value, false_positive FROM f""")
def g9d_downgraded(spark, d):
    p = _p(spark, d)
    root = spark.createDataFrame([(-1, "src/lib.rs")], "node long, path string")
    files = p.select(F.col("k").alias("node"), _by(3, "x%k%/registry.js", "src/m%k%.rs", "src/o%k%.js").alias("path")).union(root)
    modules = p.filter("s % 2 = 1").select(F.lit(-1).cast("long").alias("node"), _fill("m%k%").alias("name"), F.lit("module").alias("kind"))
    dead = p.select(F.col("k").alias("node"), F.col("a").alias("name"), F.lit("high").alias("confidence"), F.lit(0.95).alias("value"))
    return findings.downgraded(dead, files, findings.rust_public_modules(files, modules), (("registry.js", ("gear", "red")),))


@query(f"WITH {_P} SELECT 'f' || k AS source, 't' || s AS test, CASE WHEN s % 2 = 0 THEN 'graph' WHEN s % 3 = 0 THEN 'heuristic' ELSE 'mention' END AS signal, CASE WHEN s % 2 = 0 THEN s % 5 + 1 WHEN s % 3 = 0 THEN 6 ELSE 7 END AS distance FROM p WHERE s % 2 = 0 OR s % 3 = 0 OR s % 5 = 0")
def g10b_all_tests(spark, d):
    """Graph before name before mention."""
    p = _p(spark, d).withColumns({"f": _fill("f%k%"), "test": _fill("t%s%")})
    pairs = lambda n: p.filter(F.col("s") % n == 0).select(F.col("f").alias("source"), "test")
    tests = p.filter("s % 2 = 0").select(F.col("f").alias("root"), "test", (F.col("s") % 5 + 1).alias("distance"))
    return symbols.all_affected_tests(tests, pairs(3), pairs(5))


@query(f"WITH {_P} SELECT 'f' || k AS path, 'inner' AS name, CASE WHEN s % 2 = 0 THEN 'inner' ELSE 'out' || a END AS exported FROM p")
def g14_exporting_callers(spark, d):
    p = _p(spark, d)
    row = lambda name, exported, callees: p.select(_fill("f%k%").alias("path"), _fill(name).alias("name"), exported.alias("is_exported"), callees.cast("array<string>").alias("callees"))
    functions = row("inner", F.col("s") % 2 == 0, F.array()).union(row("mid", F.lit(False), F.array(F.lit("inner")))).union(row("out%a%", F.lit(True), F.array(F.lit("mid"))))
    return symbols.exporting_callers(functions, p.select(_fill("f%k%").alias("path"), F.lit("inner").alias("name")))


@query(f"WITH {_P} SELECT k AS file, a AS name, 't' || n_regionkey AS test, min(n_regionkey) + 2 AS distance FROM p JOIN nation ON n_nationkey = s GROUP BY ALL")
def g15_function_tests(spark, d):
    tests = table(spark, d, "nation").select(F.col("n_nationkey").alias("root"), F.concat(F.lit("t"), "n_regionkey").alias("test"), (F.col("n_regionkey") + 1).alias("distance"))
    return symbols.function_tests(_p(spark, d).select(F.col("k").alias("file"), F.col("a").alias("name"), F.col("s").alias("user")), tests)


@query(f"""WITH {_P}, c AS (SELECT k AS scc, unnest([[k, k + 1], [k + 1, k + 2], [k + 2, k]]) AS e FROM p), w AS (SELECT scc, e[1] AS source, e[2] AS target, 2 * s + length(b) AS cost FROM c JOIN p ON p.k = e[1])
SELECT scc, source, target, cost FROM (SELECT *, row_number() OVER (PARTITION BY scc ORDER BY cost, source, target) AS r FROM w) WHERE r = 1""")
def g21_cycle_breaks(spark, d):
    """Rings of three files that follow each other."""
    p = _p(spark, d)
    rings = p.select(F.col("k").alias("scc"), F.array(F.col("k"), F.col("k") + 1, F.col("k") + 2).alias("path"))
    degrees = p.select(F.col("k").alias("node"), F.col("s").alias("fan_in"), F.length("b").alias("fan_out"))
    return graph.cycle_break(rings, degrees, domain.edges(spark, d)).select("scc", "source", "target", "cost")


@query(with_ctes("files", ", u AS (SELECT string_split(path, '/')[1] AS directory, size FROM files UNION ALL SELECT package, size FROM files) SELECT directory, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM u GROUP BY directory"))
def g25_project_tree(spark, d):
    f = domain.files(spark, d)
    issues = f.select("path", F.lit("none").alias("category"))
    return symbols.project_map(f.select("path", "size"), domain.edges(spark, d), issues)["tree"]


@query(with_ctes("files edges", """, r AS (SELECT node AS root, node, 0 AS level FROM files WHERE size = 50 UNION
  SELECT r.root, e.source, r.level + 1 FROM r JOIN edges e ON e.target = r.node WHERE r.level < 3 AND (r.level = 0 OR r.node NOT IN (SELECT node FROM files WHERE is_entry)))
SELECT root, node, min(level) AS level FROM r GROUP BY ALL HAVING min(level) > 0""", recursive=True))
def x10_watch_impact(spark, d):
    """A batch in which every file of the largest size changes, after having been deleted."""
    f = domain.files(spark, d)
    e = f.filter("size = 50").select(F.lit(0).cast("timestamp").alias("ts"), F.col("node").alias("path"), F.lit("delete").alias("op"))
    batch = e.union(e.select((F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), "path", F.lit("upsert")))
    return incremental.watch_impact(f, domain.edges(spark, d), batch).select("root", "node", "level")


# Texts that tools print


@query("SELECT o_orderkey::VARCHAR AS commit, 'c' || o_custkey || '@x.org' AS author, o_orderpriority AS subject, 'f' || l_partkey AS file FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def s14_git_log(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("f"), "l_partkey")).alias("files"))
    head = F.concat_ws("\x1f", "o_orderkey", F.lit("Name"), F.concat(F.lit("C"), "o_custkey", F.lit("@X.org")), F.lit("2024-01-02T03:04:05Z"), "o_orderpriority")
    blocks = table(spark, d, "orders").join(lines, "o_orderkey").select(F.concat(head, F.lit("\n\n"), F.array_join("files", "\n"), F.lit("\n")).alias("block"))
    commits, files = git.log_blocks(blocks)
    return commits.join(files, "commit").select("commit", "author", "subject", "file")


@query("SELECT c_custkey AS file, 'c' || c_nationkey || '@x.org' AS author, c_mktsegment AS author_name FROM customer")
def s16_blame(spark, d):
    text = F.concat(F.lit("1 1 1\nauthor "), "c_mktsegment", F.lit("\nauthor-mail <C"), "c_nationkey", F.lit("@x.org>\n\tline\n2 2 2\nauthor Nobody\nauthor-mail <not.committed.yet>\n\tnew\n"))
    return git.blame(table(spark, d, "customer").select(F.col("c_custkey").alias("file"), text.alias("text")))


@query(f"WITH {_P} SELECT 'r-' || a AS rule, 'f' || k || '.js' AS file, s AS line, CASE s % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, b AS message FROM p")
def s26_semgrep(spark, d):
    """S26, F18."""
    level = _by(3, "ERROR", "WARNING", "INFO")
    one = F.struct(_fill("r-%a%").alias("check_id"), _fill("f%k%.js").alias("path"), F.struct(F.col("s").alias("line")).alias("start"), F.struct(level.alias("severity"), F.col("b").alias("message")).alias("extra"))
    return git.semgrep(_p(spark, d).select(F.to_json(F.struct(F.array(one).alias("results"))).alias("json")))


@query(f"WITH {_P} SELECT k, CASE WHEN s % 6 IN (0, 1) THEN 'error' WHEN s % 6 IN (2, 3) THEN 'warning' ELSE 'info' END AS severity FROM p")
def f27_linter_severity(spark, d):
    return _p(spark, d).select("k", git.linter_severity(_by(6, "Fatal", "2", "WARN", "1", "note", "%a%")).alias("severity"))


@query(f"""WITH {_P} SELECT 'semgrep' AS tool, 'r-' || a AS rule, CASE s % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'f' || k AS file, s AS line, s + 2 AS line_end, b AS message FROM p
UNION ALL SELECT 'codeql', 'q-' || a, CASE WHEN s % 2 = 0 THEN 'high' ELSE 'medium' END, 'f' || k, s, s, b FROM p WHERE s % 5 <> 0""")
def e7_adapters(spark, d):
    """Findings of two tools; one leaves out a level, ends of findings, and here and there the place."""
    p = _p(spark, d)
    line = lambda c: F.struct(c.alias("line"))
    extra = F.struct(_by(3, "ERROR", "WARNING", "INFO").alias("severity"), F.col("b").alias("message"))
    one = F.struct(_fill("r-%a%").alias("check_id"), _fill("f%k%").alias("path"), line(F.col("s")).alias("start"), line(F.col("s") + 2).alias("end"), extra.alias("extra"))
    place = F.struct(F.struct(F.struct(_fill("f%k%").alias("uri")).alias("artifactLocation"), F.struct(F.col("s").alias("startLine")).alias("region")).alias("physicalLocation"))
    places = F.when(F.col("s") % 5 == 0, F.array().cast("array<" + "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>")).otherwise(F.array(place))
    two = F.struct(_fill("q-%a%").alias("ruleId"), _by(2, "error", None).alias("level"), F.struct(F.col("b").alias("text")).alias("message"), places.alias("locations"))
    report = lambda c: p.select(F.to_json(c).alias("json"))
    runs = F.struct(F.array(F.struct(F.array(two).alias("results"))).alias("runs"))
    return adapters.combined({adapters.Semgrep(): report(F.struct(F.array(one).alias("results"))), adapters.Sarif("codeql"): report(runs)})


# Stored tables and their maintenance


@query(f"WITH {_P} SELECT k, b AS a FROM p WHERE s > 10")
def s22_replaced(spark, d):
    p = _p(spark, d)
    with workshop(spark) as folder:
        kept = store.Store(spark, folder)
        kept.replace("t", p.select("k", "a"), keys=["k"])
        kept.replace("t", p.filter("s > 10").select("k", F.col("b").alias("a")), keys=["k"])
        return cut(kept.read("t"))


@query(f"WITH {_P} SELECT k, CASE WHEN s % 3 = 0 THEN 'again' ELSE a END AS a FROM p WHERE s % 3 = 0 OR (s % 5 <> 0 AND k % 2 = 0)")
def s23_upserted(spark, d):
    """Every other row is there before; some are replaced or added, and some deleted."""
    p = _p(spark, d)
    with workshop(spark) as folder:
        kept = store.Store(spark, folder)
        kept.replace("t", p.filter("k % 2 = 0").select("k", "a"), keys=["k"])
        kept.upsert("t", p.filter("s % 3 = 0").select("k", F.lit("again").alias("a")), ["k"], deleted=p.filter("s % 5 = 0").select("k"))
        return cut(kept.read("t"))


@query(f"WITH {_P} SELECT k, a, b FROM p WHERE s = 50")
def s21_looked_up(spark, d):
    p = _p(spark, d)
    with workshop(spark) as folder:
        kept = store.Store(spark, folder)
        kept.replace("t", p.select("k", "a", "b"), keys=["k"])
        return cut(kept.lookup("t", p.filter("s = 50").select("k"), ["k"]))


def _rings(spark: SparkSession, d: str, folder: str) -> tuple[DataFrame, incremental.Maintainer]:
    """(all files, a maintainer of the edges that join a file with the next one), of the files of size 40 or less."""
    everything = _p(spark, d).select(_fill("f%k%").alias("path"), "k", "s")

    def derive(of: DataFrame) -> DataFrame:
        return everything.join(of, "path", "left_semi").select("path", F.array(F.concat(F.lit("f"), F.col("k") + 1)).alias("imports"))

    def resolved(records: DataFrame, files: DataFrame) -> DataFrame:
        wanted = records.select(F.col("path").alias("source"), F.explode("imports").alias("target"))
        return wanted.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target")

    return everything, incremental.Maintainer(store.Store(spark, folder), derive, resolved)


@query(f"WITH {_P} SELECT 'f' || x.k AS source, 'f' || y.k AS target FROM p x JOIN p y ON y.k = x.k + 1 WHERE x.s > 5 AND y.s > 5")
def x4_delta_edges(spark, d):
    """Files of size 40 or less are there before; a batch deletes the smallest and brings the others. The edges
    kept up to date are those of a rebuild."""
    with workshop(spark) as folder:
        everything, keeper = _rings(spark, d, folder)
        keeper.rebuild(everything.filter("s <= 40").select("path"))
        op = F.when(F.col("s") <= 5, "delete").otherwise("upsert")
        keeper.apply(everything.filter("s <= 5 OR s > 40").select(F.lit(0).cast("timestamp").alias("ts"), "path", op.alias("op")))
        if keeper.rebuilds != 1:
            raise AssertionError("the batch was to be a delta")
        return cut(keeper.store.read("edges"))


@query(f"WITH {_P} SELECT 'f' || k AS file, CASE WHEN s % 4 = 0 THEN 'second' ELSE 'first' END AS message FROM p WHERE s % 4 = 0 OR (s % 4 <> 1 AND s % 2 = 1) OR s % 4 = 2")
def x11_diagnosed(spark, d):
    """All files are checked; then those of a size that 4 divides change, and those one larger go."""
    files = _p(spark, d).select(_fill("f%k%").alias("path"), "s")
    at = F.lit(0).cast("timestamp").alias("ts")
    with workshop(spark) as folder:
        kept = store.Store(spark, folder)
        for message, batch in (("first", files.select(at, "path", F.lit("upsert").alias("op"))), ("second", files.filter("s % 4 < 2").select(at, "path", F.when(F.col("s") % 4 == 0, "upsert").otherwise("delete").alias("op")))):
            listeners.Diagnoser(kept, lambda paths_, m=message: paths_.select(F.col("path").alias("file"), F.lit(m).alias("message"))).apply(batch)
        return cut(kept.read("diagnostics"))


@query("SELECT ts, event_type AS kind, value FROM events WHERE event_type IN ('error', 'purchase', 'click')")
def x13_trend(spark, d):
    """Snapshots are appended, and compacted every second time."""
    e = table(spark, d, "events").select("ts", F.col("event_type").alias("kind"), "value")
    with workshop(spark) as folder:
        kept = store.Store(spark, folder)
        for kind in ("error", "purchase", "click"):
            incremental.append_trend(e.filter(F.col("kind") == kind), kept, compact_every=2)
        return cut(kept.read("trend"))


@query(f"WITH {_P} SELECT count(*) AS files, CAST(sum(s) AS BIGINT) AS total_lines, count(*) AS parse_results, (SELECT count(DISTINCT w) FROM (SELECT a AS w FROM p UNION ALL SELECT b FROM p)) AS symbols, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS diagnostics FROM p")
def a25_warm_counts(spark, d):
    p = _p(spark, d)
    names = p.select(F.explode(F.array("a", "b")).alias("name"))
    return store.warm_counts(p.select(F.col("s").alias("line_count")), p.select("k"), names, table(spark, d, "lineitem").filter("l_returnflag = 'R'"))


@query("""WITH m AS (SELECT l_partkey AS node, max(l_quantity) AS pagerank FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), t AS (SELECT l_partkey AS node, list_sort(list(DISTINCT l_suppkey)) AS tests FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT p_partkey AS path, pagerank, coalesce(tests, []) AS tests FROM part LEFT JOIN m ON m.node = p_partkey LEFT JOIN t ON t.node = p_partkey""")
def j23_restored(spark, d):
    lines = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "pagerank").otherwise("coupling")
    metrics = lines.select(F.col("l_partkey").alias("file"), kind.alias("dimension"), F.col("l_quantity").alias("value"))
    tests = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("test"))
    return store.restored(table(spark, d, "part").select(F.col("p_partkey").alias("path")), metrics, tests)
