"""Change-history operators over commits(commit, author, ts, subject), commit_files(commit, file), blame_lines(file, author)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a commit that takes something back says.
REVERT_LIKE = r"(?i)\b(revert|rollback|roll back|hotfix)\b"


def sized_commits(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Distinct (commit, file) of commits that touch least to most files: one partial aggregation, one join."""
    pairs = commit_files.select("commit", "file").distinct()
    sizes = pairs.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    return pairs.join(sizes.select("commit"), "commit", "left_semi")


def cochange_pairs(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """A4: (a, b, n), a < b, commits that touch both. A commit's files are collected into one array of `most` at most,
    so pairs are made without a self-join and no commit makes more than most * (most - 1) / 2."""
    one = commit_files.select("commit", "file").distinct().groupBy("commit").agg(F.sort_array(F.collect_list("file")).alias("fs")).filter(F.size("fs").between(least, most))
    pairs = F.flatten(F.transform("fs", lambda a, i: F.transform(F.slice("fs", i + 2, F.greatest(F.size("fs") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return one.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def change_counts(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """A4: commits by file, over the commits that pairs are counted in."""
    return sized_commits(commit_files, least, most).groupBy("file").agg(F.count("*").alias("n"))


def cochange_partners(pairs: DataFrame, least: int = 2, top: int = 10) -> DataFrame:
    """(file, partner, n, rank) of pairs seen `least` times, both ways, the `top` of each file."""
    both = pairs.filter(F.col("n") >= least)
    both = both.select(F.col("a").alias("file"), F.col("b").alias("partner"), "n").union(both.select("b", "a", "n"))
    w = Window.partitionBy("file").orderBy(F.desc("n"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def newest(commits: DataFrame, commit_files: DataFrame, n: int = 10) -> DataFrame:
    """Each file's n newest commits."""
    w = Window.partitionBy("file").orderBy(F.desc("ts"), "commit")
    return commit_files.join(commits, "commit").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def history(commits: DataFrame, commit_files: DataFrame, as_of: Column) -> DataFrame:
    """commit_count, author_count, days_ago (whole days, 0 at least), revert_like by file."""
    h = commit_files.join(commits, "commit")
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(F.max("ts").cast("timestamp"))) / F.lit(86_400_000_000)))
    return h.groupBy("file").agg(F.count("*").alias("commit_count"), F.countDistinct("author").alias("author_count"), days.cast("long").alias("days_ago"), F.sum(F.col("subject").rlike(REVERT_LIKE).cast("long")).alias("revert_like"))


def risk_score(commits: Column, authors: Column, days: Column, reverts: Column) -> Column:
    """Within a group the first rule that holds counts."""
    return (
        F.when(commits >= 8, 3).when(commits >= 4, 2).when(commits >= 2, 1).otherwise(0)
        + F.when(authors >= 3, 2).when(authors >= 2, 1).otherwise(0)
        + F.when(days <= 7, 2).when(days <= 30, 1).otherwise(0)
        + F.when(reverts > 0, 2).otherwise(0)
    )


def score_level(score: Column) -> Column:
    """6 and more is high, 3 and more medium."""
    return F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")


def knowledge(blame_lines: DataFrame, mailmap: DataFrame | None = None) -> DataFrame:
    """(file, lines, authors, primary_author, primary_share); mailmap(alias, author) names authors canonically."""
    b = blame_lines
    if mailmap is not None:
        b = b.join(mailmap.withColumnRenamed("author", "canonical"), F.col("author") == F.col("alias"), "left").select("file", F.coalesce("canonical", "author").alias("author"))
    per = b.groupBy("file", "author").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("author")).alias("o") if dict(per.dtypes)["author"] in ("bigint", "int") else F.col("author").alias("o"), "author"))
    out = per.groupBy("file").agg(F.sum("n").alias("lines"), F.count("*").alias("authors"), top.alias("t"))
    return out.select("file", "lines", "authors", F.col("t.author").alias("primary_author"), (F.col("t.n") / F.col("lines")).alias("primary_share"))


def knowledge_level(authors: Column, share: Column) -> Column:
    """One author is a high risk; two, or one with over 4/5 of the lines, a medium one."""
    return F.when(authors == 0, "unknown").when(authors == 1, "high").when((authors == 2) | (share > 0.8), "medium").otherwise("low")
