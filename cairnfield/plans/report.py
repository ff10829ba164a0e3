"""Results for people and programs: truncation, formats, advice, dashboard."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import SEVERITY_RANK

#: Exit codes; output caps; files of a healthy project; stacks by marker file; their commands.
EXIT = {"ok": 0, "findings": 1, "error": 2}
MOST, MOST_TEXT = 50, 2000
HEALTH = {"readme": ("README.md", "README.rst", "README"), "license": ("LICENSE", "LICENSE.md", "COPYING"), "ignore": (".gitignore",), "tests": ("test", "tests", "spec"), "ci": (".github", ".gitlab-ci.yml", ".circleci")}
STACKS = {"package.json": "node", "tsconfig.json": "typescript", "pyproject.toml": "python", "requirements.txt": "python", "pom.xml": "java", "build.gradle": "java", "go.mod": "go", "Cargo.toml": "rust"}
COMMANDS = {"node": ("npx eslint .", "npm test"), "typescript": ("npx tsc --noEmit", "npm test"), "python": ("ruff check .", "pytest"), "java": ("mvn -q compile", "mvn -q test"), "go": ("go vet ./...", "go test ./..."), "rust": ("cargo check", "cargo test")}


def truncated(df: DataFrame, most: int = MOST) -> dict:
    """{items, truncated, total}; counting goes over the data, the rows returned don't exceed the cap."""
    items = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    cut = len(items) > most
    return {"items": items[:most], "truncated": cut, "total": df.count() if cut else len(items)}


def elided(value: Any, most: int = MOST, text: int = MOST_TEXT) -> Any:
    """Long lists and texts inside a result, cut and marked."""
    if isinstance(value, str):
        return value if len(value) <= text else value[:text] + "…"
    if isinstance(value, Mapping):
        return {k: elided(v, most, text) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        out = [elided(v, most, text) for v in value[:most]]
        return out + [f"… {len(value) - most} more"] if len(value) > most else out
    return value


def at_least(df: DataFrame, severity: str | None, column: str = "severity") -> DataFrame:
    """Rows of this severity or worse; an unknown word keeps all."""
    if severity not in SEVERITY_RANK:
        return df
    return df.filter(F.col(column).isin(*[s for s, r in SEVERITY_RANK.items() if r >= SEVERITY_RANK[severity]]))


def sections(all_: Mapping[str, Any], wanted: Sequence[str] | None) -> dict:
    """The wanted sections; the others are named, and never computed, as they are plans until then."""
    if not wanted:
        return dict(all_)
    return {k: v for k, v in all_.items() if k in wanted} | {"omitted": sorted(set(all_) - set(wanted))}


def envelope(command: str, result: Mapping[str, Any], warnings: Sequence[str] = (), fields: Sequence[str] | None = None) -> dict:
    """The contract of a result: ok, command, has_findings, truncated, warnings, and its parts (P19 picks fields)."""
    parts = {k: truncated(v) if isinstance(v, DataFrame) else v for k, v in result.items()}
    lists = [v for v in parts.values() if isinstance(v, dict) and "items" in v]
    if fields:
        parts = {k: v for k, v in parts.items() if k in fields}
    return {"ok": True, "command": command, "has_findings": any(v["total"] for v in lists), "truncated": any(v["truncated"] for v in lists), "warnings": list(warnings), **parts}


def exit_code(result: Mapping[str, Any], fail_on_findings: bool = False) -> int:
    return EXIT["error"] if not result.get("ok") else EXIT["findings"] if fail_on_findings and result.get("has_findings") else EXIT["ok"]


def rendered(result: Mapping[str, Any], form: str = "json") -> str:
    """Json, jsonl (a line an item), md, text, or ai (short)."""
    if form == "json":
        return json.dumps(result, indent=2, default=str)
    rows = [(k, item) for k, v in result.items() if isinstance(v, dict) and "items" in v for item in v["items"]]
    if form == "jsonl":
        return "\n".join(json.dumps({"section": k, **item}, default=str) for k, item in rows)
    if form == "ai":
        short = elided({k: v for k, v in result.items() if k != "warnings"}, 10, 200)
        return json.dumps(short, separators=(",", ":"), default=str)
    out = [f"# {result['command']}" if form == "md" else str(result["command"])]
    for k, v in result.items():
        if isinstance(v, dict) and "items" in v:
            out.append(f"\n## {k} ({v['total']})\n" if form == "md" else f"\n{k}: {v['total']}")
            if form == "md" and v["items"]:
                names = list(v["items"][0])
                out += ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
                out += ["| " + " | ".join(str(i[n]).replace("|", "\\|") for n in names) + " |" for i in v["items"]]
            else:
                out += ["  " + ", ".join(f"{a}={b}" for a, b in i.items()) for i in v["items"]]
    return "\n".join(out)


def dashboard(title: str, hotspots: DataFrame, trend: DataFrame, most: int = 100) -> str:
    """One HTML page with the first hotspots and the trend."""

    def table(df: DataFrame) -> str:
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><h2>Hotspots</h2>{table(hotspots)}<h2>Trend</h2>{table(trend)}"


def health(names: Iterable[str]) -> dict:
    """Which of five things the root directory has."""
    found = set(names)
    checks = {k: any(n in found for n in any_) for k, any_ in HEALTH.items()}
    return {"checks": checks, "passed": sum(checks.values()), "of": len(checks)}


def stacks(names: Iterable[str]) -> list[str]:
    """R19."""
    return sorted({STACKS[n] for n in names if n in STACKS})


def advice(found: Sequence[str], severity: str, tests: Sequence[str], change: str = "code") -> list[dict]:
    """What to run, in phases: smoke always, focused where tests are known, full where the risk is high."""
    if change == "docs":
        return [{"phase": "smoke", "commands": []}]
    out = [{"phase": "smoke", "commands": [COMMANDS[s][0] for s in found if s in COMMANDS]}]
    if tests:
        out.append({"phase": "focused", "commands": [f"{COMMANDS[s][1]} {' '.join(sorted(tests)[:20])}" for s in found if s in COMMANDS]})
    if severity == "high" or not tests and severity == "medium":
        out.append({"phase": "full", "commands": [COMMANDS[s][1] for s in found if s in COMMANDS]})
    return out


def explanations(impact: DataFrame) -> DataFrame:
    """Impact rows (root, node, level, reason) as sentences."""
    return impact.select("root", "node", F.concat_ws(" ", F.col("node"), F.when(F.col("reason") == "direct", "imports").otherwise("depends, over other files, on"), F.col("root"), F.concat(F.lit("(distance "), F.col("level"), F.lit(")"))).alias("sentence"))


def domain_confidence(files: DataFrame, edges: DataFrame) -> DataFrame:
    """By language, low where there are few edges a file or dependencies are injected at run time."""
    n = files.groupBy("lang").agg(F.count("*").alias("files"))
    m = edges.join(files.select(F.col("path").alias("source"), "lang"), "source").groupBy("lang").agg(F.count("*").alias("edges"))
    out = n.join(m, "lang", "left").fillna(0, ["edges"])
    low = (F.col("edges") / F.col("files") < 0.1) | F.col("lang").isin("java", "kotlin")
    return out.withColumn("confidence", F.when(low, "low").otherwise("high"))


def filtered(df: DataFrame, column: str, value: str | None, values: Sequence[str], limit: int = 0, max_files: int = 0) -> dict:
    """Q4, Q6: {count, total, items}: rows whose column has the value (any, if it is none of `values`), in df's order, cut
    at the smaller of the limits that are above 0; total counts df's rows."""
    own = df.filter(F.col(column) == value) if value in values else df
    caps = [n for n in (limit, max_files) if n > 0]
    items = [r.asDict(recursive=True) for r in (own.limit(min(caps)) if caps else own).collect()]
    return {"count": len(items), "total": df.count(), "items": items}
