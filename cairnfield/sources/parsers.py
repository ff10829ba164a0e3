"""Parsers: source text to import, export and function records, by language, in Arrow batches.

Python goes through the standard library's syntax tree. The other languages are read by regular expressions over text
without comments; both return the same records. A file that can't be parsed as a tree falls back to expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.comments import strip

SCHEMA = """path string, lang string, parse_mode string, parse_mode_reason string,
imports array<struct<source:string,imported:array<string>,uses_all:boolean,re_export:boolean,is_lazy:boolean,is_type_only:boolean,line:int>>,
exports array<struct<name:string,kind:string,line_start:int,line_end:int,is_exported:boolean>>,
functions array<struct<name:string,line_start:int,line_end:int,is_exported:boolean,return_type:string,decorators:array<string>,param_count:int,has_parameter_type_hints:boolean,branch_count:int,max_arms:int,return_count:int,is_async:boolean,is_generator:boolean,has_try_catch:boolean,callees:array<string>>>"""
#: Names of callees kept a function.
MOST_CALLEES = 20


@dataclass
class Records:
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    mode: str = "regex"
    reason: str = "regex-native"

    def add_import(self, source: str, imported=(), uses_all=False, re_export=False, lazy=False, type_only=False, line=0) -> None:
        self.imports.append({"source": source, "imported": list(imported), "uses_all": uses_all, "re_export": re_export, "is_lazy": lazy, "is_type_only": type_only, "line": line})

    def add_export(self, name: str, kind: str, start: int, end: int | None = None, exported: bool = True) -> None:
        self.exports.append({"name": name, "kind": kind, "line_start": start, "line_end": end or start, "is_exported": exported})


def _function(name: str, start: int, end: int, exported: bool, body: str, params: str = "", returns: str | None = None, decorators=(), hints: bool | None = None, is_async: bool = False) -> dict:
    calls = sorted({c for c in re.findall(r"\b([A-Za-z_]\w*)\s*\(", body) if c not in ("if", "for", "while", "switch", "catch", "return", "function", "match", "fn", "func")})[:MOST_CALLEES]
    arms = max((len(re.findall(r"\bcase\b|\bdefault\s*:|=>", s)) for s in re.split(r"\b(?:switch|match|when)\b", body)[1:]), default=0)
    chain = len(re.findall(r"\belse\s+if\b|\belif\b", body))
    return {
        "name": name, "line_start": start, "line_end": end, "is_exported": exported, "return_type": returns, "decorators": list(decorators), "param_count": len([p for p in params.split(",") if p.strip()]),
        "has_parameter_type_hints": hints, "branch_count": len(re.findall(r"\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\||\?(?!\.)", body)), "max_arms": max(arms, chain + 1 if chain else 0),
        "return_count": len(re.findall(r"\breturn\b", body)), "is_async": is_async, "is_generator": bool(re.search(r"\byield\b", body)), "has_try_catch": bool(re.search(r"\btry\b", body)), "callees": calls,
    }


def _braced(text: str, at: int) -> int:
    """Index after the brace that closes the first one at or after `at`."""
    start, depth = text.find("{", at), 0
    if start < 0:
        return len(text)
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return start + m.end()
    return len(text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _names(inner: str) -> list[str]:
    return [re.split(r"\s+as\s+", p.strip())[0].removeprefix("type ").strip() for p in inner.split(",") if p.strip()]


def javascript(text: str, lang: str = "javascript") -> Records:
    r, code = Records(), strip(text, lang)
    for m in re.finditer(r"(?m)^[ \t]*import\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+[\w$]+|\{([^}]*)\})?\s*(?:from\s+)?['\"]([^'\"]+)['\"]", code):
        names = (["default"] if m[2] else []) + (_names(m[3]) if m[3] else [])
        bare = not m[2] and m[3] is None
        r.add_import(m[4], names, uses_all="* as" in m[0] or bare, type_only=bool(m[1]), line=_line(code, m.start()))
    for m in re.finditer(r"(?m)^[ \t]*export\s+(?:type\s+)?(?:(\*)(?:\s+as\s+[\w$]+)?|\{([^}]*)\})\s*from\s*['\"]([^'\"]+)['\"]", code):
        r.add_import(m[3], _names(m[2] or ""), uses_all=bool(m[1]), re_export=True, line=_line(code, m.start()))
    for m in re.finditer(r"(?:(?:const|let|var)\s+(?:\{([^}]*)\}|([\w$]+))\s*=\s*)?(?:await\s+)?\b(require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        names = [n.split(":")[0].strip() for n in (m[1] or "").split(",") if n.strip()]
        inside = len(re.findall(r"\{", code[: m.start()])) > len(re.findall(r"\}", code[: m.start()]))
        r.add_import(m[4], names, uses_all=not names, lazy=m[3] == "import" or inside, line=_line(code, m.start()))
    for m in re.finditer(r"(?m)^[ \t]*export\s+(default\s+)?(?:abstract\s+)?(async\s+)?(function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)", code):
        kind = {"let": "const", "var": "const", "function*": "function"}.get(m[3], m[3])
        end = _line(code, _braced(code, m.end())) if kind in ("function", "class", "interface", "enum") else _line(code, m.start())
        r.add_export("default" if m[1] else m[4], kind, _line(code, m.start()), end)
    for m in re.finditer(r"(?m)^[ \t]*export\s*\{([^}]*)\}(?!\s*from)", code):
        for part in m[1].split(","):
            if part.strip():
                r.add_export(re.split(r"\s+as\s+", part.strip())[-1], "const", _line(code, m.start()))
    for m in re.finditer(r"(?m)\bmodule\.exports\s*=\s*\{([^}]*)\}|\b(?:module\.)?exports\.([\w$]+)\s*=", code):
        for name in [n.split(":")[0].strip() for n in (m[1] or m[2] or "").split(",")]:
            if re.fullmatch(r"[\w$]+", name):
                r.add_export(name, "const", _line(code, m.start()))
    public = {e["name"] for e in r.exports}
    found = re.finditer(r"(?m)(export\s+)?(?:default\s+)?(async\s+)?(?:function\*?\s+([\w$]+)\s*|(?:const|let)\s+([\w$]+)\s*=\s*(?:async\s*)?(?=\([^)]*\)[^=\n]*=>))\(([^)]*)\)\s*(?::\s*([\w<>\[\]| ]+))?\s*(?:=>)?\s*\{", code)
    for m in found:
        end = _braced(code, m.end() - 1)
        name = m[3] or m[4]
        r.functions.append(_function(name, _line(code, m.start()), _line(code, end), bool(m[1]) or name in public, code[m.end() - 1 : end], m[5], m[6], hints=":" in m[5] if m[5].strip() else None, is_async=bool(m[2]) or "async" in m[0]))
    return r


def component(text: str, lang: str) -> Records:
    """The script of a single-file component."""
    scripts = list(re.finditer(r"(?s)<script[^>]*>(.*?)</script>", text))
    before = text[: scripts[0].start(1)].count("\n") if scripts else 0
    return javascript("\n" * before + "\n".join(m[1] for m in scripts), "javascript")


def python(text: str, lang: str = "python") -> Records:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(text)
    r = Records(mode="ast", reason="ast-success")
    top = set(map(id, tree.body))
    guarded = {id(n) for t in tree.body if isinstance(t, ast.If) and "TYPE_CHECKING" in ast.unparse(t.test) for n in ast.walk(t)}
    listed = None
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            listed = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}
    public = lambda name: name in listed if listed is not None else not name.startswith("_")
    inner = {id(x) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in ast.walk(f)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                r.add_import(a.name, [], uses_all=True, lazy=id(n) in inner, type_only=id(n) in guarded, line=n.lineno)
        elif isinstance(n, ast.ImportFrom):
            names = [a.name for a in n.names]
            r.add_import("." * n.level + (n.module or ""), [x for x in names if x != "*"], uses_all="*" in names, lazy=id(n) in inner, type_only=id(n) in guarded, line=n.lineno)
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            r.add_export(n.name, "class", n.lineno, n.end_lineno, public(n.name))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            r.add_export(n.name, "function", n.lineno, n.end_lineno, public(n.name))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and not t.id.startswith("__"):
                    r.add_export(t.id, "const", n.lineno, n.end_lineno, public(t.id))
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [a for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs) if a.arg not in ("self", "cls")]
            own = list(ast.walk(n))
            chain, arms = 0, 0
            for x in own:
                if isinstance(x, ast.Match):
                    arms = max(arms, len(x.cases))
                if isinstance(x, ast.If):
                    k, y = 1, x
                    while len(y.orelse) == 1 and isinstance(y.orelse[0], ast.If):
                        k, y = k + 1, y.orelse[0]
                    chain = max(chain, k + 1 if k > 1 and y.orelse else k if k > 1 else 0)
            names = sorted({x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in own if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))})[:MOST_CALLEES]
            branches = sum(isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)) for x in own) + sum(len(x.values) - 1 for x in own if isinstance(x, ast.BoolOp))
            r.functions.append({
                "name": n.name, "line_start": n.lineno, "line_end": n.end_lineno, "is_exported": id(n) in top and public(n.name), "return_type": ast.unparse(n.returns) if n.returns else None, "decorators": [ast.unparse(d) for d in n.decorator_list],
                "param_count": len(args), "has_parameter_type_hints": any(a.annotation for a in args) if args else None, "branch_count": branches, "max_arms": max(arms, chain), "return_count": sum(isinstance(x, ast.Return) for x in own),
                "is_async": isinstance(n, ast.AsyncFunctionDef), "is_generator": any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in own), "has_try_catch": any(isinstance(x, ast.Try) for x in own), "callees": names,
            })
    return r


def _python_lines(text: str) -> Records:
    r, code = Records(mode="regex", reason="regex-fallback"), strip(text, "python")
    for m in re.finditer(r"(?m)^([ \t]*)(?:from\s+(\.*[\w.]*)\s+import\s+\(?([^)\n]+)|import\s+([\w., \t]+))", code):
        if m[4]:
            for name in m[4].split(","):
                r.add_import(re.split(r"\s+as\s+", name.strip())[0], [], uses_all=True, lazy=bool(m[1]), line=_line(code, m.start()))
        else:
            names = _names(m[3])
            r.add_import(m[2], [x for x in names if x != "*"], uses_all="*" in names, lazy=bool(m[1]), line=_line(code, m.start()))
    for m in re.finditer(r"(?m)^(class|(?:async\s+)?def)\s+(\w+)", code):
        kind = "class" if m[1] == "class" else "function"
        r.add_export(m[2], kind, _line(code, m.start()), exported=not m[2].startswith("_"))
        if kind == "function":
            r.functions.append(_function(m[2], _line(code, m.start()), _line(code, m.start()), not m[2].startswith("_"), ""))
    return r


def _c_like(imports: str, exports: str, functions: str, public: Callable[[re.Match], bool]) -> Callable[[str, str], Records]:
    """A parser from three expressions: imports with groups source and all; exports with kind and name; functions with
    name, params and ret. public tells from a match whether it is exported."""

    def parse(text: str, lang: str) -> Records:
        r, code = Records(), strip(text, lang)
        for m in re.finditer(imports, code):
            g = m.groupdict()
            source = g["source"]
            r.add_import(source, [source.split(".")[-1]] if lang in ("java", "kotlin") and not g.get("all") else [], uses_all=bool(g.get("all")) or lang in ("go", "c", "cpp"), line=_line(code, m.start()))
        for m in re.finditer(exports, code):
            r.add_export(m["name"], m["kind"], _line(code, m.start()), _line(code, _braced(code, m.end())), public(m))
        for m in re.finditer(functions, code):
            end = _braced(code, m.end() - 1)
            deco = re.findall(r"@(\w+)", code[max(0, code.rfind("}", 0, m.start())) : m.start()].rsplit(";", 1)[-1])
            r.functions.append(_function(m["name"], _line(code, m.start()), _line(code, end), public(m), code[m.end() - 1 : end], m["params"], (m["ret"] or "").strip() or None, deco))
        return r

    return parse


java = _c_like(
    r"(?m)^\s*import\s+(?:static\s+)?(?P<source>[\w.]+?)(?P<all>\.\*)?\s*;",
    r"(?m)^[ \t]*(?P<mod>(?:public|protected|private|abstract|final|static|sealed)\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)",
    r"(?m)(?:^|(?<=[{};]))[ \t]*(?P<mod>(?:public|protected|private|static|final|synchronized|abstract)\s+)+(?P<ret>[\w<>\[\], ?]+)\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws [\w., ]+)?\{",
    lambda m: "private" not in m[0],
)
kotlin = _c_like(
    r"(?m)^\s*import\s+(?P<source>[\w.]+?)(?P<all>\.\*)?\s*$",
    r"(?m)^[ \t]*(?P<mod>(?:public|internal|private|open|data|sealed|abstract)\s+)*(?P<kind>class|interface|object)\s+(?P<name>\w+)",
    r"(?m)^[ \t]*(?P<mod>(?:public|internal|private|override|suspend|inline)\s+)*fun\s+(?:[\w<>]+\.)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?::\s*(?P<ret>[\w<>?, ]+))?\s*\{",
    lambda m: "private" not in m[0],
)
rust = _c_like(
    r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<source>[\w:]+?)(?P<all>::\*)?(?:::\{[^}]*\})?(?:\s+as\s+\w+)?\s*;)",
    r"(?m)^[ \t]*(?P<mod>pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait|mod|const|static|type)\s+(?P<name>\w+)",
    r"(?m)^[ \t]*(?P<mod>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)(?:<[^>]*>)?\s*\((?P<params>[^)]*)\)\s*(?:->\s*(?P<ret>[^{]+))?\{",
    lambda m: bool(m["mod"]),
)
cpp = _c_like(
    r"(?m)^\s*#\s*include\s*\"(?P<source>[^\"]+)\"",
    r"(?m)^[ \t]*(?P<kind>class|struct|enum|namespace)\s+(?P<name>\w+)\s*(?=[:{])",
    r"(?m)^(?P<ret>[\w:<>*&, ]+?)[ *&]+(?P<name>(?!(?:if|for|while|switch|catch)\b)\w+)\s*\((?P<params>[^)]*)\)\s*(?:const\s*)?\{",
    lambda m: "static" not in m[0],
)
_go_plain = _c_like(
    r"(?m)^\s*import\s+(?:\w+\s+)?\"(?P<source>[^\"]+)\"",
    r"(?m)^(?P<kind>type|var|const)\s+(?P<name>\w+)",
    r"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?P<ret>[^{\n]*)\{",
    lambda m: m["name"][:1].isupper(),
)


def go(text: str, lang: str = "go") -> Records:
    r = _go_plain(text, "go")
    for block in re.finditer(r"(?s)^import\s*\((.*?)\)", strip(text, "go") or "", re.M):
        for m in re.finditer(r"\"([^\"]+)\"", block[1]):
            r.add_import(m[1], [], uses_all=True, line=_line(text, block.start()))
    return r


#: Language to parser; register() adds to it.
PARSERS: dict[str, Callable[[str, str], Records]] = {
    "javascript": javascript, "typescript": javascript, "vue": component, "svelte": component, "python": python, "java": java, "kotlin": kotlin, "rust": rust, "go": go, "c": cpp, "cpp": cpp,
}


def register(lang: str, parser: Callable[[str, str], Records]) -> None:
    """A parser for a language; it must be importable on the executors."""
    PARSERS[lang] = parser


def parse_one(text: str | None, lang: str | None) -> Records:
    """Records of one text; unknown languages and missing texts give none."""
    parser = PARSERS.get(lang or "")
    if text is None:
        return Records(mode="none", reason="file-too-large")
    if parser is None:
        return Records(mode="none", reason="unsupported-extension")
    r = parser(text, lang)
    if r.functions:
        have = {e["name"] for e in r.exports}
        if lang in ("go", "rust", "kotlin", "c", "cpp"):
            for f in r.functions:
                if f["name"] not in have:
                    r.add_export(f["name"], "function", f["line_start"], f["line_end"], f["is_exported"])
    return r


def parse(files: DataFrame, parsers: dict[str, Callable[[str, str], Records]] | None = None) -> DataFrame:
    """SCHEMA for every row of files(path, lang, text). Files are independent, so this scales with partitions."""
    extra = dict(parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        PARSERS.update(extra)
        for b in batches:
            rows = []
            for path, lang, text in zip(b["path"], b["lang"], b["text"], strict=True):
                r = parse_one(text if isinstance(text, str) else None, lang)
                rows.append((path, lang, r.mode, r.reason, r.imports, r.exports, r.functions))
            yield pd.DataFrame(rows, columns=["path", "lang", "parse_mode", "parse_mode_reason", "imports", "exports", "functions"])

    return files.select("path", "lang", "text").mapInPandas(run, SCHEMA)


def import_records(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "lang", F.explode("imports").alias("i")).select("path", "lang", "i.*")


def export_records(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "lang", F.explode("exports").alias("e")).select("path", "lang", "e.*")


def function_records(parsed: DataFrame) -> DataFrame:
    typed = F.exists("functions", lambda f: f["return_type"].isNotNull())
    return parsed.select("path", "lang", typed.alias("typed_file"), F.explode("functions").alias("f")).select("path", "lang", "typed_file", F.lit("function").alias("kind"), "f.*")


#: Symbols line by line, for the quick index.
SYMBOL_LINES = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|const|let|var)\s+([\w$]+)",
    "python": r"^\s*(?:async\s+)?(def|class)\s+(\w+)",
    "java": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(class|interface|enum)\s+(\w+)",
    "go": r"^(func|type|var|const)\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(fn|struct|enum|trait|mod)\s+(\w+)",
}


def symbol_index(files: DataFrame) -> DataFrame:
    """(name, file, line, type, signature) of lines that declare something, without a parser: built-in functions only."""
    lines = files.filter("text IS NOT NULL").select("path", "lang", F.posexplode(F.split("text", "\r?\n")).alias("at", "s"))
    kind, name = F, F
    for lang, pattern in SYMBOL_LINES.items():
        of = F.col("lang").isin("typescript", "javascript") if lang == "javascript" else F.col("lang") == lang
        kind, name = kind.when(of, F.regexp_extract("s", pattern, 1)), name.when(of, F.regexp_extract("s", pattern, 2))
    out = lines.select(name.alias("name"), F.col("path").alias("file"), (F.col("at") + 1).alias("line"), kind.alias("type"), F.trim("s").alias("signature"))
    return out.filter("name IS NOT NULL AND name <> ''")
