"""Adapters of analysis tools: what a tool reports, as one table of findings.

Tools aren't started here: they run where the sources are, and leave reports that an adapter reads.
"""

from __future__ import annotations

import shutil
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of findings, whatever the tool.
COLUMNS = ("tool", "rule", "severity", "file", "line", "line_end", "message")


class Adapter(ABC):
    """One tool. read() knows its reports; findings() gives them their common form.

    A finding without a rule or a file is left out, severities are high, medium or low, and a finding that doesn't say
    where it ends does so in the line where it begins.
    """

    #: The tool's name, and the program that has to be there to run it.
    name: str
    program: str
    #: The tool's words for severities, in lower case; other words are low.
    high: tuple[str, ...] = ("error", "critical", "high")
    medium: tuple[str, ...] = ("warning", "medium", "moderate")

    def available(self) -> bool:
        return shutil.which(self.program) is not None

    @abstractmethod
    def read(self, reports: DataFrame) -> DataFrame:
        """(rule, level, file, line, line_end, message) of reports(json), one report a row; line_end may be null."""

    def severity(self, level: Column) -> Column:
        low = F.lower(F.trim(level))
        return F.when(low.isin(*self.high), "high").when(low.isin(*self.medium), "medium").otherwise("low")

    def findings(self, reports: DataFrame) -> DataFrame:
        r = self.read(reports).filter("rule IS NOT NULL AND file IS NOT NULL")
        own = {"tool": F.lit(self.name), "severity": self.severity(F.col("level")), "line_end": F.coalesce("line_end", "line")}
        return r.select(*[own.get(c, F.col(c)).alias(c) for c in COLUMNS]).distinct()


class Semgrep(Adapter):
    """semgrep --json."""

    name = program = "semgrep"
    SCHEMA = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string>>>"

    def read(self, reports: DataFrame) -> DataFrame:
        r = reports.select(F.explode(F.from_json("json", self.SCHEMA)["results"]).alias("r"))
        return r.select(F.col("r.check_id").alias("rule"), F.col("r.extra.severity").alias("level"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.end.line").alias("line_end"), F.col("r.extra.message").alias("message"))


class Sarif(Adapter):
    """SARIF 2.1, which many tools print; the first location of a result counts, and its level is warning if none is given."""

    SCHEMA = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"

    def __init__(self, name: str, program: str | None = None) -> None:
        self.name, self.program = name, program or name

    def read(self, reports: DataFrame) -> DataFrame:
        run = reports.select(F.explode(F.from_json("json", self.SCHEMA)["runs"]).alias("run"))
        r = run.select(F.explode("run.results").alias("r")).withColumn("at", F.get(F.col("r.locations"), F.lit(0))["physicalLocation"])
        return r.select(F.col("r.ruleId").alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), F.col("at.artifactLocation.uri").alias("file"), F.col("at.region.startLine").alias("line"), F.col("at.region.endLine").alias("line_end"), F.col("r.message.text").alias("message"))


def combined(reports: dict[Adapter, DataFrame]) -> DataFrame:
    """The findings of several tools."""
    return reduce(DataFrame.unionByName, (adapter.findings(r) for adapter, r in reports.items()))
