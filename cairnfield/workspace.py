"""A source tree as tables, and one method per command over them."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.comments import stripped
from .lineage import cut
from .operators import diff, findings, graph, history, scoring, symbols
from .plans import report, resolve
from .plans.sql import Answer, Surface
from .sources import git, parsers, scan


class Workspace:
    """Tables of a tree: files, records (parsed), imports (resolved), edges; lazy, made once when first asked for, and
    checkpointed, so that what builds on them has a short plan and survives lost executors.

    commits and commit_files, blame may be given; the command line reads them from git.
    """

    def __init__(self, spark: SparkSession, root: str, config: Mapping | None = None, commits: DataFrame | None = None, commit_files: DataFrame | None = None, blame: DataFrame | None = None, aliases: Mapping[str, str] | None = None, go_module: str = "") -> None:
        self.spark, self.root = spark, root
        self.config = dict(config or scan.load_config(None))
        self._history = commits, commit_files
        self._blame, self.aliases, self.go_module = blame, aliases, go_module

    @cached_property
    def files(self) -> DataFrame:
        raw = scan.scan(self.spark, self.root, exclude=self.config["exclude"])
        return cut(scan.classified(raw, self.config["directories"], self.config["entries"]).withColumn("node", F.col("path")))

    @cached_property
    def records(self) -> DataFrame:
        return cut(parsers.parse(self.files))

    @cached_property
    def imports(self) -> DataFrame:
        own = parsers.import_records(self.records)
        extra = resolve.implicit_imports(self.files)
        more = extra.select("path", "lang", "source", "imported", "uses_all", F.lit(False).alias("re_export"), F.lit(True).alias("is_lazy"), F.lit(False).alias("is_type_only"), F.lit(0).alias("line"))
        return cut(resolve.resolve(own.unionByName(more).dropDuplicates(["path", "source", "line"]), self.files, self.aliases, self.go_module))

    @cached_property
    def edges(self) -> DataFrame:
        first = resolve.edges(self.imports)
        missing = self.imports.filter("target IS NULL AND NOT is_external")
        named = resolve.by_symbol(missing, self.exports)
        more = named.select("path", "target", "confidence", "tier", "method")
        calls = parsers.function_records(self.records).select("path", F.explode("callees").alias("name"))
        near = resolve.same_package(self.files, self.exports, calls).select(F.col("source").alias("path"), "target", "confidence", "tier", "method")
        rest = more.union(near).groupBy(F.col("path").alias("source"), "target").agg(F.max("confidence").alias("confidence"), F.min("tier").alias("tier"), F.min("method").alias("method"))
        rest = rest.join(first, ["source", "target"], "left_anti").select("source", "target", "confidence", "tier", "method", F.lit(False).alias("is_lazy"), F.lit(False).alias("type_only"))
        return cut(first.select(*rest.columns).union(rest))

    @cached_property
    def exports(self) -> DataFrame:
        return parsers.export_records(self.records).filter("is_exported")

    @cached_property
    def functions(self) -> DataFrame:
        return parsers.function_records(self.records)

    def _start(self, files: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(f, f) for f in files], "root string, node string")

    def _used(self) -> DataFrame:
        """Import records as (source, target, imported, uses_all, tier), a row a name."""
        i = self.imports.filter("target IS NOT NULL").select(F.col("path").alias("source"), "target", F.explode_outer("imported").alias("imported"), "uses_all", "tier")
        soft = self.edges.filter("tier <> 'tier1'").select("source", "target", F.lit(None).cast("string").alias("imported"), F.lit(False).alias("uses_all"), "tier")
        return i.union(soft)

    # Commands

    def stats(self) -> DataFrame:
        f = self.files.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum(F.col("is_test").cast("long")).alias("tests"))
        return f.withColumn("edges", self.edges.agg(F.count("*").alias("n")).scalar()).withColumn("exports", self.exports.agg(F.count("*").alias("n")).scalar())

    def dependencies(self, file: str) -> DataFrame:
        return self.edges.filter(F.col("source") == file).select(F.col("target").alias("file"), "tier", "confidence")

    def dependents(self, file: str) -> DataFrame:
        return self.edges.filter(F.col("target") == file).select(F.col("source").alias("file"), "tier", "confidence")

    def impact(self, *files: str, depth: int = 3) -> DataFrame:
        return graph.impact_radius(self.files, self.edges, self._start(files), depth)

    def tree(self, file: str, depth: int = 3, fan_out: int = 20) -> DataFrame:
        return graph.dependency_tree(self.edges, self._start([file]), depth, fan_out)

    def cycles(self) -> DataFrame:
        return graph.cycles(graph.cycle_edges(self.edges))

    def dead_exports(self) -> DataFrame:
        exports = self.exports.withColumn("node", F.col("path"))
        first = findings.dead_exports(self.files, exports, self._used())
        found = first.select(F.col("node").alias("path"), "name")
        texts = self.files.select("path", stripped(F.col("text"), F.col("lang")).alias("text"))
        rescued = symbols.called_in_importers(found, self.imports, texts).union(symbols.called_locally(found, texts)).withColumnRenamed("path", "node")
        who = first.filter("importers = 0").select("node", "name")
        return first.join(rescued.join(who, ["node", "name"], "left_anti"), ["node", "name"], "left_anti").select(F.concat(F.lit("dead-export:"), "node").alias("id"), F.col("node").alias("file"), "name", "importers", "confidence", "value")

    def unresolved(self) -> DataFrame:
        left = self.imports.filter("target IS NULL AND NOT is_external AND source RLIKE '^[.@~/]|::|^[a-z_]+\\\\.'")
        reason = findings.unresolved_reason(F.col("source"), F.lit(""), bool(self.aliases))
        out = left.filter(F.col("source").rlike(r"^(\.|@/|~/|/)") | (F.col("lang").isin("rust") & F.col("source").rlike("^(crate|self|super)::"))).select(F.concat(F.lit("unresolved:"), "path").alias("id"), F.col("path").alias("file"), "source", "line", reason.alias("reason")).distinct()
        return scan.not_ignored(out, self.config["ignore"]["findings"])

    def orphans(self) -> DataFrame:
        return findings.orphans(self.files, self.edges)

    def smells(self) -> DataFrame:
        return findings.smells(self.functions).select("path", "name", "line_start", "max_arms", "complexity", "smell")

    def boundaries(self) -> DataFrame:
        rules = self.config["boundaries"]
        return findings.check_boundaries(self.files, self.edges, rules) if rules else findings.suggested_boundaries(self.files, self.edges)

    def security(self, config: Mapping | None = None, language: str | None = None) -> DataFrame:
        """With the built-in rules, or with those of a configuration."""
        rules, allow = findings.security_rules(config) if config else (findings.SECURITY_RULES, findings.SECURITY_ALLOWED)
        return findings.security_scan(self.files.select("path", "lang", "text", "is_test"), rules, allow, language)

    def ast_rules(self) -> DataFrame:
        return findings.ast_rules(self.functions)

    def affected_tests(self, *files: str) -> DataFrame:
        start = self._start(files)
        direct = graph.affected_tests(self.files, self.edges, start)
        own = start.select(F.col("root").alias("source"))
        name = symbols.tests_by_name(self.files).join(own, "source", "left_semi")
        texts = self.files.select("path", stripped(F.col("text"), F.col("lang")).alias("text"))
        mention = symbols.tests_by_mention(self.files, texts).join(own, "source", "left_semi")
        return symbols.all_affected_tests(direct, name, mention)

    def routes(self) -> DataFrame:
        return diff.server_routes(self.files.filter("NOT is_test").select(F.col("path").alias("file"), "text")).select("file", "method", F.col("path").alias("route"))

    def affected_routes(self, *files: str) -> DataFrame:
        return graph.affected_routes(self.files, self.edges, self.routes(), self._start(files))

    def contracts(self) -> DataFrame:
        sources = self.files.filter("NOT is_test").select(F.col("path").alias("file"), "text")
        return diff.contracts(diff.client_calls(sources), diff.server_routes(sources))

    def symbol_impact(self, file: str, *names: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(file, n) for n in names], "file string, name string") if names else self.exports.filter(F.col("path") == file).select(F.col("path").alias("file"), "name")
        return symbols.symbol_impact(self.imports, wanted)

    def history(self) -> DataFrame:
        commits, files = self._history
        if commits is None:
            raise ValueError("no history given")
        return history.history(commits, files, commits.agg(F.max("ts").alias("m")).scalar())

    def cochange(self) -> DataFrame:
        return history.cochange_partners(history.cochange_pairs(self._history[1]))

    def knowledge_risk(self) -> DataFrame:
        k = history.knowledge(self._blame)
        return k.withColumn("level", history.knowledge_level(F.col("authors"), F.col("primary_share")))

    def hotspots(self) -> DataFrame:
        """R2: with history if there is one."""
        deg = graph.degrees(self.files, self.edges).select("node", "total")
        prod = self.files.filter("NOT is_test")
        rank = graph.pagerank(prod, self.edges, epsilon=1e-5)
        j = self.files.select("node", "path", "file_role").join(deg, "node").join(rank, "node", "left")
        if self._history[0] is not None:
            j = j.join(self.history().withColumnRenamed("file", "node"), "node", "left")
        else:
            j = j.select("*", *[F.lit(None).cast("long").alias(c) for c in ("commit_count", "author_count", "days_ago", "revert_like")])
        n = self.files.count()
        score = scoring.hotspot_score(F.col("commit_count"), F.col("author_count"), F.col("days_ago"), F.col("revert_like"), F.col("file_role"), F.col("rank"), F.lit(n))
        risk = history.risk_score(F.col("commit_count"), F.col("author_count"), F.col("days_ago"), F.col("revert_like"))
        out = j.select("path", "total", score.alias("score"), F.coalesce(history.score_level(risk), F.lit("low")).alias("risk"))
        return out.filter("score > 30 OR total > 10").orderBy(F.desc("score"), "path")

    def query_hotspots(self, risk: str | None = None, limit: int = 0, max_files: int = 0) -> dict:
        """Q4: hotspots of one risk, at most the smaller of the two limits that are given."""
        return report.filtered(self.hotspots(), "risk", risk, ("high", "medium", "low"), limit, max_files)

    def query_stability(self, assessment: str | None = None, limit: int = 0, max_files: int = 0) -> dict:
        """Q6: files of one assessment, likewise."""
        return report.filtered(self.stability().orderBy("score", "path"), "assessment", assessment, ("fragile", "moderate", "stable"), limit, max_files)

    def stability(self) -> DataFrame:
        tested = self.edges.join(self.files.filter("is_test").select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct().withColumn("tested", F.lit(True))
        looped = graph.scc(graph.cycle_edges(self.edges)).select("node").withColumn("looped", F.lit(True))
        j = self.files.join(graph.degrees(self.files, self.edges).select("node", "fan_in"), "node").join(tested, "node", "left").join(looped, "node", "left")
        s = scoring.stability_score(F.coalesce("tested", F.lit(False)), F.col("fan_in"), F.col("is_mainline"), F.coalesce("looped", F.lit(False)), F.col("file_role"))
        return j.select("path", s.alias("score"), scoring.stability_level(s).alias("assessment"))

    def guard(self, *files: str, most: int = 50) -> dict:
        """Whether a change of these files reaches too many others."""
        start = self._start(files).withColumn("root", F.lit("all"))
        n = graph.impact_radius(self.files, self.edges, start).agg(F.sum((F.col("level") == 1).cast("long")), F.sum((F.col("level") > 1).cast("long"))).first()
        direct, transitive = n[0] or 0, n[1] or 0
        return {"direct": direct, "transitive": transitive, "blocked": direct > most or transitive > most}

    def map(self) -> dict[str, DataFrame]:
        issues = self.orphans().select("path", F.lit("orphan").alias("category")).union(self.dead_exports().select("file", F.lit("dead-export")))
        return symbols.project_map(self.files, self.edges, issues)

    def overview(self, sections: Sequence[str] | None = None) -> dict:
        """Every section as a plan; those that aren't wanted are never computed."""
        parts = {"hotspots": self.hotspots, "stability": self.stability, "orphans": self.orphans, "unresolved": self.unresolved, "cycles": self.cycles, "dead_exports": self.dead_exports, "ast_rules": self.ast_rules, "smells": self.smells, "boundaries": self.boundaries}
        wanted = report.sections(parts, sections)
        return {k: v() if callable(v) else v for k, v in wanted.items()}

    def sql(self, statement: str) -> Answer:
        tables = {"files": self.files.drop("text"), "edges": self.edges, "imports": self.imports, "exports": self.exports, "functions": self.functions}
        return Surface(self.spark, tables).query(statement)

    def health(self) -> dict:
        return report.health(os.listdir(self.root)) if os.path.isdir(self.root) else report.health([])

    @classmethod
    def from_git(cls, spark: SparkSession, root: str, commits: int = 300, **more) -> Workspace:
        """With the history that git prints on the driver."""
        log, files = git.log(spark, git.run(["log", git.LOG_FORMAT, "--name-only", "--no-merges", "-n", str(commits)], root))
        return cls(spark, root, commits=log, commit_files=files, **more)
