"""What git, linters and scanners print, as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a log is printed, and what blame calls lines that aren't committed.
MARK = "\x01"
LOG_FORMAT = f"--format={MARK}%H%x1f%an%x1f%ae%x1f%aI%x1f%s"
UNCOMMITTED = "not.committed.yet"


def run(args: Sequence[str], root: str) -> str:
    """Output of git in root, on the driver: the command line's adapter; everything below works on its text."""
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def log(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """commits(commit, author_name, author, ts, subject) and commit_files(commit, file) of a printed log."""
    blocks = spark.createDataFrame([(b,) for b in text.split(MARK) if b.strip()], "block string")
    return log_blocks(blocks)


def log_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S14 for logs that lie in files: blocks(block), one a commit."""
    head = F.split(F.split("block", "\n")[0], "\x1f")
    commits = blocks.select(head[0].alias("commit"), head[1].alias("author_name"), F.lower(F.coalesce(F.nullif(head[2], F.lit("")), head[1])).alias("author"), head[3].cast("timestamp").alias("ts"), head[4].alias("subject"))
    files = blocks.select(head[0].alias("commit"), F.explode(F.slice(F.split("block", "\n"), F.lit(2), F.greatest(F.size(F.split("block", "\n")) - 1, F.lit(0)))).alias("file"))
    return commits, files.filter("file <> ''").distinct()


def blame(porcelain: DataFrame) -> DataFrame:
    """(file, author, author_name), a row a committed line, of porcelain(file, text) with --line-porcelain."""
    mails = F.regexp_extract_all("text", F.lit(r"(?m)^author-mail <([^>]*)>$"), 1)
    names = F.regexp_extract_all("text", F.lit(r"(?m)^author (.*)$"), 1)
    rows = porcelain.select("file", F.explode(F.arrays_zip(mails.alias("author"), names.alias("author_name"))).alias("x")).select("file", F.lower("x.author").alias("author"), "x.author_name")
    return rows.filter(F.col("author") != UNCOMMITTED)


def status(text: str, spark: SparkSession) -> DataFrame:
    """(file, state) of git status --porcelain or git diff --name-status."""
    rows = []
    for line in text.splitlines():
        if "\t" in line:
            state, *names = line.split("\t")
            rows.append((names[-1], state[:1]))
        elif len(line) > 3:
            rows.append((line[3:].split(" -> ")[-1].strip('"'), line[:2].strip()[:1]))
    return spark.createDataFrame(rows, "file string, state string").distinct()


def mailmap(spark: SparkSession, text: str) -> DataFrame:
    """(alias, author): every other address on a line stands for the first."""
    import re

    rows = []
    for line in text.splitlines():
        mails = [m.lower() for m in re.findall(r"<([^>]+)>", line.split("#")[0])]
        rows += [(m, mails[0]) for m in mails[1:]]
    return spark.createDataFrame(rows, "alias string, author string").dropDuplicates(["alias"])


def linter_severity(word: Column) -> Column:
    """F27."""
    low = F.lower(word)
    return F.when(low.rlike("^(e|err|error|fatal|2)$"), "error").when(low.rlike("^(w|warn|warning|1)$"), "warning").otherwise("info")


def diagnostics(output: DataFrame) -> DataFrame:
    """(file, line, column, severity, message), distinct, of lines(line) in three common shapes:
    file:1:2: error: text, file(1,2): error CODE: text, and file:1: text."""
    a = r"^(.+?):(\d+):(\d+):?\s+(error|warning|info|note|fatal)?:?\s*(.*)$"
    b = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning|info)\s*(.*)$"
    c = r"^(.+?):(\d+):()()\s*(.+)$"
    pick = lambda i: F.coalesce(*[F.when(F.col("line").rlike(p), F.regexp_extract("line", p, i)) for p in (b, a, c)])
    out = output.select(pick(1).alias("file"), pick(2).cast("int").alias("at"), F.coalesce(F.nullif(pick(3), F.lit("")).cast("int"), F.lit(0)).alias("column"), linter_severity(pick(4)).alias("severity"), F.trim(pick(5)).alias("message"))
    return out.filter("file IS NOT NULL").withColumnRenamed("at", "line").distinct()


def semgrep(reports: DataFrame) -> DataFrame:
    """(rule, file, line, severity, message) of semgrep JSON reports(json)."""
    schema = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>"
    r = reports.select(F.explode(F.from_json("json", schema)["results"]).alias("r"))
    level = F.when(F.col("r.extra.severity") == "ERROR", "high").when(F.col("r.extra.severity") == "WARNING", "medium").otherwise("low")
    return r.select(F.col("r.check_id").alias("rule"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), level.alias("severity"), F.col("r.extra.message").alias("message"))


def save_baseline(findings: DataFrame, path: str) -> None:
    """S29."""
    findings.write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
