"""Contracts on files: artifact manifests, and archives with an index of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import safe_member
from tidemark.operators.contracts import require_columns
from tidemark.operators.shared import reliable
from tidemark.sources import streams


def relative(path: Column, root: str) -> Column:
    """A file's path below a root, whatever scheme either is written with."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.substring_index(path, f"{bare}/", -1), "^/+", "")


def verify_manifest(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """artifact_id, role, uri, exists, size_ok, sha256_ok, md5_ok, status, by the files under a root.

    ``uri`` is a path below the root.  An expected size or digest that is null or blank is not
    checked.  An artifact passes if its file exists and nothing that is checked differs; a manifest
    with repeated ids is an error.  Files are streamed, so they may be of any size.
    """
    require_columns(manifest, ["artifact_id", "role", "uri", "md5", "sha256", "size_bytes"])
    if manifest.groupBy("artifact_id").count().where("count > 1").limit(1).count():
        raise ValueError("the manifest repeats an artifact_id")
    found = streams.file_digests(spark, root).select(relative(F.col("path"), root).alias("uri"), F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha256"), F.col("md5").alias("__md5"))
    wanted = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    same = lambda c: F.when(wanted(c).isNotNull(), F.coalesce(wanted(c) == F.lower(F.col(f"__{'bytes' if c == 'size_bytes' else c}").cast("string")), F.lit(False)))
    out = manifest.join(found, "uri", "left").withColumns({"exists": F.col("__bytes").isNotNull(), "size_ok": same("size_bytes"), "sha256_ok": same("sha256"), "md5_ok": same("md5")})
    passes = F.col("exists")
    for c in ("size_ok", "sha256_ok", "md5_ok"):
        passes = passes & F.coalesce(F.col(c), F.lit(True))
    return out.select("artifact_id", "role", "uri", "exists", "size_ok", "sha256_ok", "md5_ok", F.when(passes, "PASS").otherwise("FAIL").alias("status"))


def verify_packages(spark: SparkSession, index: DataFrame, root: str, key: str, kinds: list[str], reference: DataFrame | None = None) -> DataFrame:
    """check, observed, passed: breaches of the contract between an index of archive members and the archives under a root.

    Index: ``key``, kind, archive_path (below the root), member_path, original_sha256, original_bytes,
    archive_sha256.  No nulls; (key, kind) once; every key has all kinds and no others; the keys are
    those of ``reference``, where one is given; one digest for each archive; safe member names; the
    members of the archives are exactly those of the index, with the sizes and digests that it gives;
    the archives have theirs.  The archives are read once for their members and once for their own
    digests, whatever number of checks there is.
    """
    columns = [key, "kind", "archive_path", "member_path", "original_sha256", "original_bytes", "archive_sha256"]
    rows = reliable(require_columns(index, columns).select(*columns))
    members = streams.archive_members(spark, root).select(relative(F.col("archive"), root).alias("archive_path"), F.col("member").alias("member_path"), F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha256"))
    both = rows.withColumn("__indexed", F.lit(True)).join(members, ["archive_path", "member_path"], "full")
    there = F.col("__indexed").isNotNull() & F.col("__sha256").isNotNull()
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | F.col(c).isNull()
    count = lambda name, bad: F.count_if(bad).alias(name)
    by_row = rows.agg(count("null_fields", nulls), count("unsafe_members", ~safe_member(F.col("member_path"))), count("unexpected_kinds", ~F.col("kind").isin(kinds)))
    by_pair = rows.groupBy(key, "kind").count().agg(count("repeated_keys", F.col("count") > 1))
    named = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.when(F.col("kind").isin(kinds), F.col("kind")))).alias("__kinds"))
    by_key = named.agg(count("incomplete_kinds", F.col("__kinds") != F.array(*map(F.lit, sorted(kinds)))))
    by_member = both.agg(
        count("missing_members", F.col("__sha256").isNull()), count("unlisted_members", F.col("__indexed").isNull()),
        count("other_sizes", there & (F.col("__bytes") != F.col("original_bytes"))), count("other_digests", there & (F.col("__sha256") != F.lower("original_sha256"))),
    )
    by_archive = rows.groupBy("archive_path").agg(F.countDistinct("archive_sha256").alias("n")).agg(count("archives_of_several_digests", F.col("n") > 1))
    archives = streams.file_digests(spark, root).select(relative(F.col("path"), root).alias("archive_path"), F.col("sha256").alias("__archive"))
    own = rows.select("archive_path", "archive_sha256").distinct().join(archives, "archive_path", "left")
    by_digest = own.agg(count("other_archive_digests", F.coalesce(F.col("__archive") != F.lower("archive_sha256"), F.lit(True))))
    found = [by_row, by_pair, by_key, by_member, by_archive, by_digest]
    if reference is not None:
        ids = rows.select(key).distinct().withColumn("__here", F.lit(True)).join(reference.select(key).distinct().withColumn("__there", F.lit(True)), key, "full")
        found.append(ids.agg(count("missing_ids", F.col("__here").isNull()), count("extra_ids", F.col("__there").isNull())))
    long = [f.unpivot([], f.columns, "check", "observed") for f in found]
    out = long[0]
    for one in long[1:]:
        out = out.unionByName(one)
    return out.withColumn("passed", F.col("observed") == 0)
