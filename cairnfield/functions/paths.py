"""Paths and names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that hold tests, and names of test files, both case-insensitive.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "cypress", "e2e")
TEST_NAMES = (r"\.test\.", r"\.spec\.", r"(test|tests|it)\.java$", r"^test.*\.py$", r"^tests\.py$", r"^test_", r"_test\.", r"tests?\.kt$", r"_spec\.rb$", r"\.cy\.", r"\.e2e\.", r"\.integration\.")
#: Directory names that say nothing about what a file is about.
ROOTS = ("src", "app", "lib", "source", "sources", "test", "tests", "__tests__", "spec", "specs", "main", "java", "python", "js", "jsx", "ts", "tsx", "mjs", "cjs", "packages", "package", "kotlin", "go", "rust", "cypress", "e2e", "integration")
#: Language families by extension, for matching tests with sources.
FAMILIES = {"js": "js-family", "jsx": "js-family", "ts": "js-family", "tsx": "js-family", "mjs": "js-family", "cjs": "js-family", "java": "java-family", "kt": "java-family", "py": "python-family", "go": "go-family", "rs": "rust-family", "rb": "ruby-family"}
JAVA_TEST_END = r"(?:UnitTests?|IntegrationTests?|SystemTests?|TestSuites?|FunctionalTests?|TestCases?|Tests?|Specs?|ITs?)$"


def normalized(path: Column) -> Column:
    """forward slashes, no ./ and no doubled slash."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"(?<=.)/$", "")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), path.substr(F.lit(len(root) + 1), F.length(path))).otherwise(path)


def extension(path: Column) -> Column:
    """without the dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$|^\.[^./]+\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def prefix(path: Column, levels: int) -> Column:
    """the first directories of a path, without its name; "." for files at the top."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.when(F.size(dirs) <= 0, ".").otherwise(F.array_join(F.slice(dirs, 1, levels), "/"))


def is_test(path: Column) -> Column:
    """A directory or a name that marks tests."""
    low = F.concat(F.lit("/"), F.lower(path))
    return low.rlike("/(" + "|".join(TEST_DIRS) + ")/") | basename(low).rlike("|".join(TEST_NAMES))


def family(path: Column) -> Column:
    out = F
    for ext, name in FAMILIES.items():
        out = out.when(extension(path) == ext, name)
    return out.otherwise("unknown")


def test_stem(path: Column) -> Column:
    """the name that a test and what it tests have in common."""
    base, ext = stem(path), extension(path)
    plain = F.lower(base)
    for pattern in (r"^test_", r"_test$", r"(?:\.|_)(?:cy|e2e|integration)$", r"(?:\.|_)(?:test|spec)$"):
        plain = F.regexp_replace(plain, pattern, "")
    return F.when(ext == "java", F.lower(F.regexp_replace(base, JAVA_TEST_END, ""))).when(ext == "kt", F.lower(F.regexp_replace(base, r"(?:Tests?|Test)$", ""))).otherwise(plain)


def signature(path: Column) -> Column:
    """the path in lower case without root directories, ending in test_stem; empty if nothing is left."""
    dirs = F.filter(F.split(F.lower(dirname(path)), "/"), lambda d: (d != "") & ~d.isin(*ROOTS))
    leaf = test_stem(path)
    return F.when(leaf == "", "").otherwise(F.array_join(F.concat(dirs, F.array(leaf)), "/"))


def role(path: Column) -> Column:
    """What a file is for, by the first rule that holds; library otherwise."""
    p, b, e = F.lower(path), F.lower(basename(path)), extension(path)
    in_dir = lambda *names: F.concat(F.lit("/"), p).rlike("/(" + "|".join(map(re.escape, names)) + ")/")
    test = in_dir("test", "tests", "__tests__", "benchmark", "benchmarks", "e2e", "fixtures", "mocks", "mock", "__mocks__") | b.rlike(r"\.test\.|\.spec\.|^test_|_test\.|^tests\.py$")
    entry = b.rlike(r"^(main|index|app|server|cli|manage|wsgi|asgi|__main__)\.(js|jsx|ts|tsx|mjs|cjs|py|go|rs|java|kt|vue)$|application.*\.java$|servletinitializer\.java$")
    return (
        F.when(test, "test").when(entry, "entry")
        .when(in_dir("migrations", "migration"), "migration")
        .when(in_dir("scripts", "script", "bin", "tools") | e.isin("sh", "bash", "ps1", "bat"), "script")
        .when(e.isin("md", "mdx", "rst", "txt", "adoc") | in_dir("docs", "doc"), "docs")
        .when(e.isin("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "properties") | b.rlike(r"\.config\.|^dockerfile$|^makefile$|^\.[^/]+rc$"), "config")
        .when(e.isin("css", "scss", "sass", "less", "styl"), "style")
        .when(e.isin("png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "mp4", "mp3", "pdf"), "asset")
        .otherwise("library")
    )


#: Fixed values: names of directories at the top that tell a role; earlier roles come first.
DIRECTORY_HINTS = {
    "generated": ("dist", "build", "coverage", ".next", "out", "generated", ".turbo"),
    "archive": ("archive", "archives", "attic", "deprecated", "legacy", "prototype", "prototypes"),
    "reference": ("reference", "references", "example", "examples", "sample", "samples", "demo", "demos", "benchmark", "benchmarks", "e2e", "fixtures", "mocks", "mock", "__mocks__"),
}


def directory_role(path: Column, configured: dict[str, str] | None = None) -> Column:
    """Configured prefixes come first, the longest of them; then the name of the top directory; active otherwise."""
    top, out = F.split(path, "/")[0], F.lit("active")
    for name, dirs in DIRECTORY_HINTS.items():
        out = F.when(top.isin(*dirs), name).otherwise(out)
    for at, name in sorted((configured or {}).items(), key=lambda kv: len(kv[0])):
        out = F.when((path == at) | path.startswith(at.rstrip("/") + "/"), name).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """** any characters, * any but a slash, ? one but a slash; the whole path, without regard to case."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
        out.append("(?:.*/)?" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return "(?i)^" + "".join(out) + "$"


def matches(path: Column, glob: str) -> Column:
    """P21."""
    return path.rlike(glob_regex(glob))


def url_path(raw: Column) -> Column:
    """path of a URL or path, one slash each, none at the end, variable segments as {}; empty for null."""
    p = F.trim(raw)
    after = F.regexp_extract(p, r"^(?s:.*?)://[^/]*(/(?s:.*))$", 1)
    p = F.when(F.instr(p, "://") > 0, F.when(after == "", "/").otherwise(after)).otherwise(p)
    p = F.regexp_replace(p, "/+", "/")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(raw.isNull() | (raw == ""), "").otherwise(F.regexp_replace(p, r"\{[^/]+\}|:[^/]+", "{}"))


def conventionally_used(name: Column) -> Column:
    """P13, negated: constructors, dunder names and mocks are never dead."""
    return (name == "constructor") | name.rlike("^__.*__$") | name.rlike("^(mock|stub|spy|fake)[A-Z]")
