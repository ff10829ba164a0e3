"""python -m cairnfield.cli COMMAND ROOT [FILE...] [--format json|jsonl|md|text|ai] [--fields a,b] [--severity s] [--fail]"""

from __future__ import annotations

import argparse
import sys

from .plans import report
from .session import local_session
from .workspace import Workspace

#: Commands by name: the method, and whether it takes files.
COMMANDS = {
    "stats": ("stats", False), "impact": ("impact", True), "affected-tests": ("affected_tests", True), "affected-routes": ("affected_routes", True), "dependencies": ("dependencies", True),
    "dependents": ("dependents", True), "tree": ("tree", True), "audit-boundaries": ("boundaries", False), "audit-smells": ("smells", False), "audit-security": ("security", False),
    "dead-exports": ("dead_exports", False), "unresolved": ("unresolved", False), "cycles": ("cycles", False), "orphans": ("orphans", False), "query-hotspots": ("hotspots", False),
    "query-stability": ("stability", False), "api-contracts": ("contracts", False), "audit-map": ("map", False), "audit-overview": ("overview", False), "guard": ("guard", True), "health": ("health", False),
    "symbol-impact": ("symbol_impact", True), "ast-rules": ("ast_rules", False), "query": ("sql", True),
}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairnfield", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("root")
    p.add_argument("files", nargs="*")
    p.add_argument("--format", default="json", choices=["json", "jsonl", "md", "text", "ai"])
    p.add_argument("--fields")
    p.add_argument("--severity")
    p.add_argument("--git", action="store_true", help="read the history from git")
    p.add_argument("--fail", action="store_true", help="exit with 1 if there are findings")
    a = p.parse_args(args)
    spark = local_session()
    w = Workspace.from_git(spark, a.root) if a.git else Workspace(spark, a.root)
    name, takes = COMMANDS[a.command]
    try:
        got = getattr(w, name)(*(a.files if takes else ()))
    except Exception as e:  # noqa: BLE001  a failed command is a result
        result = {"ok": False, "command": a.command, "error": str(e).splitlines()[0]}
    else:
        if a.command == "query":
            result = {"ok": got.ok, "command": a.command, "error": got.error, "rows": got.rows, "truncated": got.truncated}
        else:
            parts = got if isinstance(got, dict) else {"result": report.at_least(got, a.severity) if a.severity and "severity" in got.columns else got}
            result = report.envelope(a.command, parts, fields=a.fields.split(",") if a.fields else None)
    print(report.rendered(result, a.format))
    return report.exit_code(result, a.fail)


if __name__ == "__main__":
    sys.exit(main())
