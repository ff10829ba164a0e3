"""Line dedup: content-defined chunks of lines; chunks that repeat anywhere in the corpus are removed but once.

Only DataFrame functions. A chunk of lines is cut where the lines themselves say so, so that a passage moved to
another place in another document is cut at the same places again:

- every line has a 31-bit hash, and every place i a rolling hash of the lines i - 1 and i;
- a chunk ends after line i if the rolling hash there is smaller than at both neighbours, which puts two lines into a
  chunk at least (but at a document's ends) and three on average;
- where `solo` is given, a line of so many words is a wrapped paragraph, and a chunk of its own.

A chunk that lies across the edge of a passage stands only once, so dedup() leaves parts of a passage and may miss a short
one. dedup_passages() compares runs of lines as well, from every line on, and misses no passage of `least` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, release, stored

#: Fixed values of the rolling hash.
MULTIPLIER, MODULUS = 1000003, 2147483647
#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def _key(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(row_key, doc_id, text, and all columns as one struct; the names of those to return).

    row_key is the same for rows of equal doc_id and text. Columns of docs are inside the struct, so none clashes with
    a helper column; one that is named as what the operator returns is left out.
    """
    names = [c for c in docs.columns if c.lower() not in made]
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return docs.select(key.alias("row_key"), "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")], F.lit(0).alias("__none")).alias("rest")), names


def _whole(joined: DataFrame, names: list[str], text: Column, extra: list[Column]) -> DataFrame:
    """The rows of _key() with another text, and the operator's own columns."""
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("rest").getField(c).alias(c) for c in names], *extra)


def _ends(lines: Column, solo: int | None) -> Column:
    """The indices (from 0) after which a chunk ends."""
    hashed = F.transform(lines, lambda x: F.struct(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long").alias("h"), _solo(x, solo).alias("s")))

    def roll(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(F.pmod(F.coalesce(F.get(h, i - 1)["h"], F.lit(0)) * MULTIPLIER + x["h"], F.lit(MODULUS)).alias("r"), x["s"].alias("s")))

    def flag(facts: Column) -> Column:
        def ends(x: Column, i: Column) -> Column:
            after = F.get(facts, i + 1)
            low = (i > 0) & (x["r"] < after["r"]) & (x["r"] < F.get(facts, i - 1)["r"])
            return F.when(after.isNull() | x["s"] | after["s"] | low, i)

        return F.filter(F.transform(facts, ends), lambda i: i.isNotNull())

    return let(let(hashed, roll), flag)


def _solo(line: Column, solo: int | None) -> Column:
    """Whether a line is a chunk by itself."""
    return F.lit(False) if solo is None else F.size(F.split(line, SPACE_CLASS)) >= solo


def chunks(text: Column, solo: int | None = None) -> Column:
    """array<struct<chunk: text of the lines, n_lines>>; the chunks joined by newlines are the text."""

    def cut(lines: Column) -> Column:
        def from_ends(ends: Column) -> Column:
            def chunk(end: Column, j: Column) -> Column:
                start = F.coalesce(F.get(ends, j - 1) + 1, F.lit(0))
                return F.struct(F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("chunk"), (end - start + 1).alias("n_lines"))

            return F.transform(ends, chunk)

        return let(_ends(lines, solo), from_ends)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def dedup(docs: DataFrame, solo: int | None = None) -> DataFrame:
    """docs with removed_chunks and removed_lines, and text without the chunks that stand elsewhere before.

    Chunks of two lines or more count, and with `solo` those of one line of so many words; blank ones don't. Of equal
    chunks (compared byte by byte, after a hash has found them) the first stays: in the row of the smallest doc_id (null
    is largest), there the first. Rows of equal doc_id and text are one document and get the same result. Null text
    stays null. A text none of whose chunks goes is returned as it is; one that loses all is "". Other columns pass
    through, but for such as are named removed_chunks or removed_lines.
    """
    keyed, names = _key(docs, ("removed_chunks", "removed_lines"))
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "j")
    counts = (F.trim("chunk") != "") & ((F.col("n_lines") > 1) | _solo(F.col("chunk"), solo))
    # Places and hashes of all chunks, without their texts.
    parts = keyed.select("row_key", F.posexplode(chunks(F.col("text"), solo)).alias("j", "c")).select("row_key", "j", "c.*").filter(counts)
    parts = stored(parts.select("row_key", "j", F.xxhash64("chunk").alias("h")), "places")
    # 1. Hashes that occur twice or more: counted before the shuffle, so a frequent chunk is one row a task.
    often = parts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    found = stored(parts.join(often, "h", "left_semi").groupBy("row_key").agg(F.collect_set("j").alias("js")), "found")
    own = keyed.select("doc_id", "row_key", "text").join(found.hint("merge"), "row_key")
    cut = F.filter(F.transform(chunks(F.col("text"), solo), lambda c, j: F.struct(j.alias("j"), c.alias("c"))), lambda x: F.array_contains("js", x["j"]))
    own = own.select("doc_id", "row_key", F.explode(cut).alias("x")).select("doc_id", "row_key", "x.j", "x.c.*")
    repeated = stored(own.select(F.xxhash64("chunk").alias("h"), where.alias("at"), "n_lines", "chunk"), "repeated")
    release(parts, found)
    # 2. Their texts, compared byte by byte as keys of an aggregation, which keeps a place of each: a row a task of a
    #    frequent chunk. A place that isn't kept goes, so texts needn't meet their first place again.
    first = repeated.groupBy("h", "chunk").agg(F.min("at").alias("at")).select("at.row_key", "at.j")
    # Equal rows give equal places.
    gone = repeated.select("at.row_key", "at.j", "n_lines").distinct().join(first, ["row_key", "j"], "left_anti")
    gone = gone.groupBy("row_key").agg(F.collect_set("j").alias("gone"), F.sum("n_lines").cast("long").alias("removed_lines"))
    gone = stored(gone, "gone")
    release(repeated)
    joined = keyed.join(gone.hint("merge"), "row_key", "left")
    kept = F.filter(chunks(F.col("text"), solo), lambda c, j: ~F.array_contains(F.col("gone"), j))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["chunk"]), "\n"))
    return _whole(joined, names, text, [F.coalesce(F.size("gone"), F.lit(0)).alias("removed_chunks"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines")])


def _pieces(text: Column, least: int) -> Column:
    """array<struct<start, end, run, h>>: places (lines from 0) and hashes of what may stand elsewhere.

    Runs: from every line that isn't blank on, and up to every such line, the fewest lines that have `least` words
    together. So every line of a passage of `least` words is in a run inside it. Blank lines don't count; as each other
    line has a word, no run has more than `least` lines. Chunks: those of fewer words, as dedup() takes them.
    """

    def length(lines: Column) -> Column:
        """Of facts in order: how many, from the first on, have `least` words; null if all together have fewer."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
        got = F.aggregate(lines, start, lambda a, x: F.when(a["n"] >= least, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (a["k"] + 1).alias("k"))))
        return let(got, lambda a: F.when(a["n"] >= least, a["k"]))

    def piece(start: Column, end: Column, run: bool, h: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(run).alias("run"), h.alias("h"))

    def runs(full: Column) -> Column:
        def spans(_: Column, i: Column) -> Column:
            back = F.greatest(i - (least - 1), F.lit(0))
            after, before = length(F.slice(full, i + 1, F.lit(least))), length(F.reverse(F.slice(full, back + 1, i - back + 1)))
            return F.array(F.struct(i.alias("at"), after.alias("k")), F.struct((i - before + 1).alias("at"), before.alias("k")))

        def place(x: Column) -> Column:
            own = F.slice(full, x["at"] + 1, x["k"])
            return piece(F.get(full, x["at"])["i"], F.get(full, x["at"] + x["k"] - 1)["i"], True, F.xxhash64(F.transform(own, lambda y: y["h"])))

        found = F.array_distinct(F.filter(F.flatten(F.transform(full, spans)), lambda x: x["k"].isNotNull()))
        return F.transform(found, place)

    def from_lines(lines: Column) -> Column:
        facts = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(x).alias("h")))

        def both(facts: Column) -> Column:
            def from_ends(ends: Column) -> Column:
                def chunk(end: Column, j: Column) -> Column:
                    start = F.coalesce(F.get(ends, j - 1) + 1, F.lit(0))
                    return let(F.array_join(F.slice(lines, start + 1, end - start + 1), "\n"), lambda c: F.when(few(start, end) & counts(c, end - start + 1), piece(start, end, False, F.xxhash64(c))))

                return F.filter(F.transform(ends, chunk), lambda x: x.isNotNull())

            def few(start: Column, end: Column) -> Column:
                return F.aggregate(F.slice(facts, start + 1, end - start + 1), F.lit(0), lambda a, x: a + x["n"]) < least

            def counts(c: Column, n: Column) -> Column:
                return (F.trim(c) != "") & ((n > 1) | (F.size(F.split(c, SPACE_CLASS)) >= least))

            return F.concat(let(F.filter(facts, lambda x: x["n"] > 0), runs), let(_ends(lines, least), from_ends))

        return let(facts, both)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), from_lines)


def dedup_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs with removed_lines, and text without the lines that stand in an earlier copy of their passage.

    A line goes if it is in a run of consecutive lines, of `least` words or more, that stands elsewhere before; runs are
    compared without their blank lines. It goes as well if dedup() finds its chunk elsewhere before. Earlier is: in the
    row of the smallest doc_id (null is largest), there the first; a copy that overlaps the first one stays. Runs and
    chunks are compared by SHA-256 after a shorter hash has found them. Equal rows, null texts and other columns are
    treated as by dedup().
    """
    keyed, names = _key(docs, ("removed_lines",))
    places = stored(keyed.select("row_key", F.explode(_pieces(F.col("text"), least)).alias("p")).select("row_key", "p.*"), "places")
    often = places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    found = stored(places.join(often, "h", "left_semi").groupBy("row_key").agg(F.collect_set(F.struct("start", "end", "run")).alias("ps")), "found")
    release(places)
    own = keyed.select("doc_id", "row_key", "text").join(found.hint("merge"), "row_key")

    def keys(lines: Column) -> Column:
        def key(p: Column) -> Column:
            part = F.slice(lines, p["start"] + 1, p["end"] - p["start"] + 1)
            full = F.when(p["run"], F.filter(part, lambda x: x.rlike(WORD))).otherwise(part)
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.concat(p["run"].cast("string"), F.sha2(F.array_join(full, "\n"), 256)).alias("key"))

        return F.transform("ps", key)

    own = own.select("doc_id", "row_key", F.explode(let(F.split("text", "\n", -1), keys)).alias("x"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "x.start", "x.end")
    repeated = stored(own.select("x.key", at.alias("at")), "repeated")
    release(found)
    # A copy stays if it is the first of its key or overlaps the first in its own row; all others go, so a frequent
    # key needn't meet its first place in one task.
    first = repeated.groupBy("key").agg(F.min("at").alias("at")).select("key", F.col("at.row_key").alias("row_key"), F.col("at.end").alias("upto"))
    places = repeated.select("key", "at.row_key", "at.start", "at.end")
    gone = places.join(first, (places["key"] == first["key"]) & (places["row_key"] == first["row_key"]) & (places["start"] <= first["upto"]), "left_anti")
    gone = gone.groupBy("row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lost = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"]))))
    gone = stored(gone.select("row_key", lost.alias("gone")), "gone")
    release(repeated)
    joined = keyed.join(gone.hint("merge"), "row_key", "left")

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), left))
    return _whole(joined, names, text, [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines")])
