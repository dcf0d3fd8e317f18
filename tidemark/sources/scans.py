"""Scans: delimited text, matrices, sequences, vector shards, JSON documents, file listings (contents of any size: streams)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, columns: list[str], *, sep: str = "\t", header: bool = True, select: list[str] | None = None, encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """All columns as text; empty fields and those that short rows lack are empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep=sep, header=header, encoding=encoding, mode="PERMISSIVE", maxCharsPerColumn=10_000_000, enforceSchema=True).csv(path)
    df = df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in (select or columns)))
    return df if limit is None else df.limit(limit)


def lenient(spark: SparkSession, path: str, columns: list[str], *, sep: str = "\t", header: bool = True, limit: int | None = None) -> DataFrame:
    """All columns as text of unquoted lines: empty fields stay empty, short rows are padded with nulls, further fields are left out, a line may be as long as it likes."""
    lines = spark.read.text(path)
    if header:
        lines = lines.where(F.col("value") != sep.join(columns))
    cells = F.split("value", f"\\Q{sep}\\E", -1)
    df = lines.select(*(F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)))
    return df if limit is None else df.limit(limit)


def matrix(spark: SparkSession, path: str, key: str, samples: list[str], *, sep: str = "\t") -> DataFrame:
    """key and one array of doubles, in the order of the samples."""
    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(s, T.DoubleType()) for s in samples)])
    return spark.read.schema(schema).options(sep=sep, header=True).csv(path).select(key, F.array(*samples).alias("values"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (first word of the header) and seq (lines joined); text before the first header of a file raises.

    A file's first record alone begins with the header mark (or is blank, where the file begins with
    a line end), so a file without such a record has text before it; one pass over the records tells.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    headed = raw.groupBy("file").agg(F.bool_or(F.col("value").startswith(">") | (F.trim("value") == "")).alias("headed"))
    if (bad := headed.where("NOT headed").first()) is not None:
        raise ValueError(f"text before the first header of {bad['file']}")
    records = raw.select(F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    return records.where(F.length(F.trim("r")) > 0).select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def vector_shards(spark: SparkSession, *paths: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """key and vector of Parquet shards in several folders; null or repeated keys, null vectors and several widths are an error."""
    df = reduce(DataFrame.unionByName, (spark.read.parquet(p).select(key, vector) for p in paths))
    facts = df.agg(F.count_if(F.col(key).isNull() | F.col(vector).isNull()).alias("nulls"), F.count(key).alias("n"), F.countDistinct(key).alias("ids"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if facts["nulls"] or facts["n"] != facts["ids"] or facts["a"] != facts["b"]:
        raise ValueError(f"{facts['nulls']} nulls, {facts['n'] - facts['ids']} repeated keys, widths {facts['a']} to {facts['b']}")
    return df


def json_status(spark: SparkSession, root: str) -> DataFrame:
    """status, n of the JSON documents under a root; unparsable ones have the status null."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    return docs.select(F.try_variant_get(F.try_parse_json("value"), "$.status", "string").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tabular_profile(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """By file: rows, columns of the header, rows of another width."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.size(F.split("value", sep)).alias("width"), F.monotonically_increasing_id().alias("n"))
    by_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.min_by("width", "n").alias("columns"))
    return lines.join(by_file, "file").groupBy("file", "columns").agg((F.first("lines") - 1).alias("rows"), F.count_if(F.col("width") != F.col("columns")).alias("odd_rows"))


def sequence_profile(records: DataFrame) -> DataFrame:
    """Sequences, residues, the longest record's length, and of the first record its id and first 100 residues."""
    one = records.withColumn("__n", F.monotonically_increasing_id()).agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("residues"), F.max(F.length("seq")).alias("longest"), F.min_by(F.struct("id", F.substring("seq", 1, 100).alias("p")), "__n").alias("f"))
    return one.select("sequences", "residues", "longest", F.col("f.id").alias("first_id"), F.col("f.p").alias("preview"))


def files(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """path, size and time of the files under a root; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), "modificationTime")
    return df if exclude is None else df.where(~F.regexp_like("path", F.lit(exclude)))


def part_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes of each part of a Parquet table."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("bytes")).groupBy("part", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def repaired_table(spark: SparkSession, path: str, first: str, sep: str = "\t") -> DataFrame:
    """A table whose header may lack its first column: one wider rows get it, mixed widths raise; all but the first column are numbers or null.

    The header is the first line of the file by its place, so a later line that says the same is a row.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), F.size(F.split("value", f"\\Q{sep}\\E", -1)).alias("width"))
    head = lines.agg(F.min_by("value", "place").alias("value"), F.min("place").alias("place")).first()
    header = head["value"].split(sep)
    body = lines.where((F.col("place.block") != head["place"]["block"]) | (F.col("place.n") != head["place"]["n"]))
    least, most = body.agg(F.min("width"), F.max("width")).first()
    if least == most == len(header) + 1:
        header = [first, *header]
    elif least is not None and (least, most) != (len(header), len(header)):
        raise ValueError(f"rows have {least} to {most} fields, the header {len(header)}")
    cells = F.split("value", f"\\Q{sep}\\E", -1)
    number = lambda i: F.expr(f"try_cast(nullif(nullif(nullif(cells[{i}], 'NA'), 'NaN'), '') as double)")
    return body.select(cells.alias("cells")).select(F.col("cells")[0].alias(header[0]), *(number(i).alias(c) for i, c in enumerate(header) if i))
