"""Line dedup over content-defined chunks of lines, grown to whole passages by pairs of lines.

A text's lines are hashed; where the rolling hash of ROLL neighbouring line hashes hits a residue, a
chunk ends.  Boundaries depend on nearby lines only, so they stay in place when lines are put in
elsewhere, and a passage that occurs again has the same chunks inside.  A chunk of two or more lines
that also occurs earlier (in a smaller doc_id, or earlier in the same document, not overlapping) is
removed; the first occurrence stays.

Chunks miss the ends of a passage, and passages within one chunk.  So what later copies of chunks don't
hold is looked up by pairs of neighbouring lines: those that reach over a boundary, and all of a chunk
that isn't a later copy.  Copies' own pairs need no looking up, as the first copy of the chunk has the
same ones and earlier.  The lines that found chunks and pairs cover are the maximal runs.  Where three
or more blank lines lie between two others, the passage from one to the other is looked up as well, so
the blank lines go with it; at the ends of a chunk one blank line counts, as in pairs.

Chunks and pairs are found by 64-bit hashes, and a group of equal hashes is acted on only when all its
texts are the same bytes.

Null texts stay null, empty texts stay empty.  Pairs of blank lines are left.  Repeated rows of one
doc_id and text are one document: each keeps what the other keeps.  Null ids come last in order.
All columns pass through; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import apart, cut, keyed

#: Lines under the rolling hash; one boundary for so many lines on average.
ROLL, EVERY = 2, 4
#: Copies of chunks whose places are broadcast at most (with four more for each document that has any).
FEW = 1_000_000
DOC = ["__id", "__th"]


def line_hashes(documents: DataFrame) -> DataFrame:
    """__id, __th, h (hashes of the lines), full (which of them aren't blank)."""
    d = apart(keyed(documents).where("text IS NOT NULL").select(*DOC, "text"), lines=F.split("text", "\n")).drop("text")
    return apart(d, h=F.transform("lines", lambda x: F.xxhash64(x)), full=F.transform("lines", lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")).drop("lines")


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.xxhash64(F.lit(kind), F.slice("h", start + 1, end - start)).alias("k"))


def chunks(lines: DataFrame) -> DataFrame:
    """The chunks of two or more lines that aren't blank all: __id, __th, start and end line, k (a hash of the lines)."""
    n = F.size("h")
    rolling = lambda i: F.xxhash64(F.slice("h", i - (ROLL - 2), F.lit(ROLL)))
    ends = F.filter(F.when(n > ROLL, F.sequence(F.lit(ROLL - 1), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.pmod(rolling(i), F.lit(EVERY)) == 0)
    d = apart(lines, ends=F.concat(F.transform(ends, lambda i: i + 1), F.array(n)))
    d = apart(d, parts=F.zip_with(F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1)), "ends", lambda a, b: F.struct(a.alias("start"), F.slice("full", a + 1, b - a).alias("full"))))
    # from the blank line before the first full one to the blank line after the last full one
    first = lambda x: x["start"] + F.greatest(F.array_position(x["full"], True).cast("int") - 2, F.lit(0))
    last = lambda x: x["start"] + F.least(F.size(x["full"]) - F.array_position(F.reverse(x["full"]), True).cast("int") + 2, F.size(x["full"]))
    cores = F.transform(F.filter("parts", lambda x: F.array_contains(x["full"], True)), lambda x: F.struct(first(x).alias("start"), last(x).alias("end")))
    d = apart(d.select(*DOC, "h", cores.alias("cores")), cores=F.filter("cores", lambda c: c["end"] - c["start"] >= 2))
    return d.select(*DOC, F.explode(F.transform("cores", lambda c: _span("chunk", c["start"], c["end"]))).alias("c")).select(*DOC, "c.*")


def pairs(lines: DataFrame) -> DataFrame:
    """Pairs of neighbouring lines and passages over blank lines that no copy of a chunk (``copies``, or null) holds: as ``chunks``."""
    d = apart(lines, at=F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("full", i)), held=F.flatten(F.transform(F.coalesce("copies", F.array().cast("array<struct<start:int,end:int>>")), lambda c: F.sequence(c["start"], c["end"] - 2))))
    every = F.when(F.size("h") > 1, F.sequence(F.lit(0), F.size("h") - 2)).otherwise(F.array().cast("array<int>"))
    left = F.filter(F.array_except(every, F.col("held")), lambda i: F.get("full", i) | F.get("full", i + 1))
    gaps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gaps = F.transform(F.filter(gaps, lambda x: x["b"] - x["a"] > 3), lambda x: _span("pair", x["a"], x["b"] + 1))
    return d.select(*DOC, F.explode(F.concat(F.transform(left, lambda i: _span("pair", i, i + 2)), gaps)).alias("c")).select(*DOC, "c.*")


def _again(spans: DataFrame) -> DataFrame:
    """The spans whose hash occurs more than once, with the smallest id that holds it (``first_id``)."""
    groups = spans.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first_id")).where("n > 1").drop("n")
    return spans.join(groups, "k")


def _later(found: DataFrame) -> DataFrame:
    """Those of the found spans that have an earlier occurrence."""
    own = Window.partitionBy(*DOC, "k")
    return found.withColumn("first_end", F.min("end").over(own)).where("__id <> first_id OR start >= first_end").drop("first_end")


def repeated(documents: DataFrame) -> DataFrame:
    """The spans of lines to remove: __id, __th, start, end."""
    lines = line_hashes(documents)
    by_chunk = cut(_again(cut(chunks(lines))))
    copies = cut(_later(by_chunk).groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("copies")))
    few = (copies.agg(F.sum(F.size("copies") + 4)).first()[0] or 0) <= FEW
    by_pair = cut(_again(pairs(lines.join(F.broadcast(copies) if few else copies, DOC, "left"))))
    found = by_chunk.unionByName(by_pair)
    # texts of the found spans, cut from the documents that hold any
    spans = found.groupBy(*DOC).agg(F.collect_set(F.struct("start", "end", "k")).alias("found"))
    texts = keyed(documents).select(*DOC, "text").dropDuplicates(DOC).join(spans, DOC)
    texts = apart(texts, lines=F.split("text", "\n")).drop("text")
    texts = texts.select("lines", F.explode("found").alias("c")).select("c.k", F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")), "\n").alias("passage"))
    same = texts.groupBy("k").agg(F.min("passage").alias("least"), F.max("passage").alias("most")).where("least = most").select("k")
    return _later(found).join(same, "k", "left_semi").select(*DOC, "start", "end").distinct()


def dedup(documents: DataFrame, *, counts: bool = False) -> DataFrame:
    """The documents without globally repeated passages of lines; ``counts`` adds __lines and __removed."""
    gone = repeated(documents).groupBy("__id", "__th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1)))).alias("__gone"))
    joined = keyed(documents).join(gone, ["__id", "__th"], "left")
    joined = apart(joined, __split=F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), "__gone"), lambda i: F.get("__split", i))
    out = joined.withColumns({"text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))} | ({
        "__lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)),
        "__removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")),
    } if counts else {}))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns, *(["__lines", "__removed"] if counts else []))


def report(documents: DataFrame) -> DataFrame:
    d = dedup(documents.select("doc_id", "text"), counts=True)
    return d.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines")).cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
