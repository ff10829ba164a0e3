"""The queries of this subpackage: one opN_<name> an operator, over whole tables, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, flac, kneser_ney, langid, line_dedup, packing, simhash, toxicity, url_reputation, warc

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n: what splits held-out rows off."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt where the remainder mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(3) == 1)
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(spark, docs, model, ("doc_id", "held_out"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes as a FLAC stream, decoded into PCM blocks, and digests of both."""
    return flac.digests(flac.to_blocks(flac.to_media(table(spark, sf_dir, "documents"))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text, learnt where the remainder mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(5) == 1).alias("held_out"))
    model = kneser_ney.train(spark, docs.filter(~F.col("held_out")), order=2)
    return kneser_ney.score(spark, docs, model, ("doc_id", "held_out"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts on the pages that they fit are the outcomes that hosts are judged by."""
    out = url_reputation.judge(table(spark, sf_dir, "pages"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", *(F.round(c, 6).alias(c) for c in ("mean", "upper", "floor")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near-duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary that op8 names; installed on every machine, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document without chunks that stand elsewhere before; paragraphs of 50 words on a line are chunks."""
    return line_dedup.dedup(table(spark, sf_dir, "documents"), solo=50).select("doc_id", "text", "removed_chunks", "removed_lines")


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document without passages that stand elsewhere before, wherever chunks would cut them."""
    return line_dedup.dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt where the remainder mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(4) == 2).alias("held_out"))
    model = toxicity.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(spark, docs, model, keep=("doc_id", "held_out"))


#: What DuckDB's regular expressions call a word.
_WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) {} END"

OP4_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, list_distinct({_SHINGLES.format("ELSE [array_to_string(w, ' ')]")}) AS s FROM b WHERE len(w) > 0),
lone AS (SELECT item_id, len(s) AS n_item, unnest(s) AS s FROM items),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
own AS (SELECT doc_id, unnest(list_distinct({_SHINGLES.format("")})) AS s FROM d),
hits AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM own JOIN lone USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM hits WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""

_LEVEL = """
{name}_rho AS (SELECT sum(pow(k - n * prior, 2) - n * prior * (1 - prior)) AS gap, sum(n * (n - 1) * prior * (1 - prior)) AS room FROM {source}),
{name}_m AS (SELECT CASE WHEN coalesce(room, 0) <= 0 OR gap / room <= 1.0 / 1001 THEN 1000.0 ELSE greatest(2.0, room / gap - 1) END AS m FROM {name}_rho),
{name}_post AS (SELECT {key}, prior * m + k AS alpha, (1 - prior) * m + n - k AS beta FROM {source}, {name}_m)"""

_SECOND = ", ".join(f"'{x}'" for x in url_reputation.SECOND_LEVELS)

OP6_SQL = (
    r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
counted AS (SELECT host, CAST(count(rule) AS DOUBLE) AS n, CAST(count(*) FILTER (rule IN ('org/', 'com/fr/')) AS DOUBLE) AS k FROM ruled GROUP BY host),
labels_of AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), ':[0-9]*$', ''), '.') AS l FROM counted),
parted AS (SELECT *, array_to_string(l, '.') AS site, CASE WHEN regexp_matches(array_to_string(l, '.'), '^([0-9]+\.){3}[0-9]+$|^\[') THEN len(l)
  WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ("""
    + _SECOND
    + r""") THEN 2 ELSE 1 END AS s FROM labels_of),
hosts AS (SELECT host, n, k, array_to_string(l[len(l) - s + 1:], '.') AS suffix, array_to_string(l[greatest(len(l) - s, 1):], '.') AS domain FROM parted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (sum(sum(k)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS prior FROM domains GROUP BY suffix),"""
    + _LEVEL.format(name="s", source="suffixes", key="suffix")
    + ", d AS (SELECT domains.*, alpha / (alpha + beta) AS prior FROM domains JOIN s_post USING (suffix)),"
    + _LEVEL.format(name="d", source="d", key="domain")
    + ", h AS (SELECT hosts.*, alpha / (alpha + beta) AS prior FROM hosts JOIN d_post USING (domain)),"
    + _LEVEL.format(name="h", source="h", key="host")
    + """,
known AS (SELECT host, alpha / (alpha + beta) AS mean, alpha + beta AS n FROM h_post),
bound AS (SELECT host, mean, least(1.0, mean + 1.645 * sqrt(mean * (1 - mean) / (n + 1))) AS upper, (SELECT min(prior) FROM suffixes) AS floor FROM known)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR upper < floor THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS mean, round(upper, 6) AS upper, round(floor, 6) AS floor FROM ruled JOIN bound USING (host)
"""
)

OP9_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, x[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(string_split_regex(line, '[\x20\x09-\x0D]+')) >= 50 AS s FROM l),
r AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 1000003 + h) % 2147483647 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, coalesce(lead(s) OVER w, true) OR s OR (i > 0 AND r < lead(r) OVER w AND r < lag(r) OVER w) AS e FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM e),
k AS (SELECT doc_id, j, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines FROM c GROUP BY ALL),
n AS (SELECT *, trim(chunk) <> '' AND (n_lines > 1 OR len(string_split_regex(chunk, '[\x20\x09-\x0D]+')) >= 50) AS counts FROM k),
g AS (SELECT *, counts AND row_number() OVER (PARTITION BY counts, chunk ORDER BY doc_id, j) > 1 AS gone FROM n)
SELECT doc_id, CASE WHEN bool_or(text IS NULL) THEN NULL ELSE coalesce(string_agg(chunk, chr(10) ORDER BY j) FILTER (NOT gone), '') END AS text,
  CAST(count(*) FILTER (gone) AS INT) AS removed_chunks, CAST(coalesce(sum(n_lines) FILTER (gone), 0) AS BIGINT) AS removed_lines
FROM g JOIN documents USING (doc_id) GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_flac": op3_flac,
    "op4_decontamination": op4_decontamination,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_url_reputation": op6_url_reputation,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op6_url_reputation": OP6_SQL, "op9_line_dedup": OP9_SQL}
