"""The domain model as DataFrames, projected from the star schema of the test tables, with the same CTEs in SQL.

A part is a file; two parts that follow each other in an order are joined by an import edge; an order is a commit and its
lines are the files it touched; a line of an order is also a blamed line of the part, by the order's customer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File extensions by part key modulo 5, and their languages.
EXTENSIONS = ("js", "py", "java", "go", "rs")
LANGUAGES = {"js": "javascript", "py": "python", "java": "java", "go": "go", "rs": "rust"}
#: Roles by part type.
ROLES = {"PROMO": "test", "SMALL": "config", "MEDIUM": "script", "LARGE": "docs", "ECONOMY": "library", "STANDARD": "library"}
ENTRY_SIZE = 5
QUANTITY = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, path, ext, lang, file_role, directory_role, is_entry, is_test, is_mainline, package, size."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    package = F.concat(F.lit("brand"), number, F.lit("/"), F.lower("p_type"))
    role = reduce(lambda c, kv: c.when(F.col("p_type") == kv[0], kv[1]), ROLES.items(), F).otherwise("library")
    lang = reduce(lambda c, kv: c.when(F.col("ext") == kv[0], kv[1]), LANGUAGES.items(), F)
    out = p.select(F.col("p_partkey").alias("node"), package.alias("package"), ext.alias("ext"), role.alias("file_role"), F.when(number % 10 == 0, "reference").when(number % 10 == 1, "archive").otherwise("active").alias("directory_role"), F.col("p_size").alias("size"))
    return out.select(
        "node", F.concat("package", F.lit("/f"), "node", F.lit("."), "ext").alias("path"), "ext", lang.alias("lang"), "file_role", "directory_role",
        (F.col("size") <= ENTRY_SIZE).alias("is_entry"), (F.col("file_role") == "test").alias("is_test"), (F.col("directory_role") == "active").alias("is_mainline"), "package", "size",
    )


def edges(spark: SparkSession, sf_dir: str, quantity: int = QUANTITY) -> DataFrame:
    """source, target, confidence, tier, is_lazy, type_only: one row per pair, self-loops dropped."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = lines.withColumn("target", F.lead("l_partkey").over(w)).filter((F.col("l_quantity") >= quantity) & (F.col("target") != F.col("l_partkey")))
    conf = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.8).otherwise(0.3)
    out = pairs.groupBy(F.col("l_partkey").alias("source"), "target").agg(F.max(conf).alias("confidence"), F.min(F.col("l_linestatus") == "O").alias("is_lazy"), F.min(F.col("l_discount") >= 0.09).alias("type_only"))
    tier = F.when(F.col("confidence") == 1.0, "tier1").when(F.col("confidence") == 0.8, "tier2").otherwise("tier3")
    return out.select("source", "target", "confidence", tier.alias("tier"), "is_lazy", "type_only")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, author, ts, subject."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority") == "1-URGENT", "hotfix: urgent").otherwise("change").alias("subject"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, author: a row per line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("o_orderkey"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("author")), "o_orderkey").select("file", "author")


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, name, kind, is_exported: the two words of a part's name."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.explode(F.split("p_name", " ")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, "type").otherwise("function").alias("kind"), (F.col("p_partkey") % 7 != 0).alias("is_exported"))


def import_records(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """source, target, imported, uses_all, tier: an edge imports its source's first word; every 11th imports all.

    also: further columns of the edges, for callers that would join with them again."""
    first = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.split("p_name", " ")[0].alias("imported"))
    e = edges(spark, sf_dir)
    return e.join(first, "source").select("source", "target", "imported", ((F.col("source") + F.col("target")) % 11 == 0).alias("uses_all"), "tier", *also)


CTES = {
    "files": """files AS (SELECT node, package || '/f' || node || '.' || ext AS path, ext, CASE ext WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' ELSE 'rust' END AS lang,
  file_role, directory_role, size <= 5 AS is_entry, file_role = 'test' AS is_test, directory_role = 'active' AS is_mainline, package, size
  FROM (SELECT p_partkey AS node, 'brand' || n || '/' || lower(p_type) AS package, (['js', 'py', 'java', 'go', 'rs'])[p_partkey % 5 + 1] AS ext,
    CASE p_type WHEN 'PROMO' THEN 'test' WHEN 'SMALL' THEN 'config' WHEN 'MEDIUM' THEN 'script' WHEN 'LARGE' THEN 'docs' ELSE 'library' END AS file_role,
    CASE WHEN n % 10 = 0 THEN 'reference' WHEN n % 10 = 1 THEN 'archive' ELSE 'active' END AS directory_role, p_size AS size
    FROM (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part)))""",
    "edges": """edges AS (SELECT *, CASE WHEN confidence = 1.0 THEN 'tier1' WHEN confidence = 0.8 THEN 'tier2' ELSE 'tier3' END AS tier FROM (
  SELECT l_partkey AS source, target, max(CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END) AS confidence, bool_and(l_linestatus = 'O') AS is_lazy, bool_and(l_discount >= 0.09) AS type_only
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS target FROM lineitem)
  WHERE l_quantity >= 45 AND target <> l_partkey GROUP BY ALL))""",
    "commits": "commits AS (SELECT o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts, CASE WHEN o_orderpriority = '1-URGENT' THEN 'hotfix: urgent' ELSE 'change' END AS subject FROM orders)",
    "commit_files": "commit_files AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem)",
    "blame_lines": "blame_lines AS (SELECT l_partkey AS file, o_custkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "export_records": "export_records AS (SELECT p_partkey AS node, unnest(string_split(p_name, ' ')) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'type' ELSE 'function' END AS kind, p_partkey % 7 <> 0 AS is_exported FROM part)",
    "import_records": "import_records AS (SELECT source, target, string_split(p_name, ' ')[1] AS imported, (source + target) % 11 = 0 AS uses_all, tier FROM edges JOIN part ON p_partkey = source)",
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """body behind the named CTEs; a body may go on with CTEs of its own, beginning with a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(CTES[n] for n in names.split()) + body


def edges_at(quantity: int) -> str:
    return CTES["edges"].replace("edges AS", f"edges{quantity} AS", 1).replace("l_quantity >= 45", f"l_quantity >= {quantity}")
