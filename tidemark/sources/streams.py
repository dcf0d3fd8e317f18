"""Files and archives read as streams: digests of files of any size, members of tar archives.

A task holds CHUNK bytes of a file at once.  Files are opened through pyarrow's file systems (local,
HDFS, S3, GCS, Azure), so executors reach the store that holds them.
"""

from __future__ import annotations

import hashlib
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.contracts import ContractError, repeated_keys
from tidemark.operators.shared import reliable

CHUNK = 8 << 20
#: Bytes that a task digests: of small files together, of one archive's neighbouring members.  A file or member over it is a task of its own.
SHARE = 256 << 20
#: Files that a task writes or digests.
FILES = 2_000


def located(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before the path in a URI of it."""
    uri = re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri, "file:"
    system, path = fs.FileSystem.from_uri(uri)
    scheme, rest = uri.split("://", 1)
    return system, path, f"{scheme}://{rest.split('/', 1)[0] if scheme == 'hdfs' else ''}"


def opened(uri: str) -> pa.NativeFile:
    """A file that can be read from any place."""
    system, path, _ = located(uri)
    return system.open_input_file(path)


def digests(stream: IO[bytes], *names: str, size: int | None = None) -> tuple[int, list[str]]:
    """Bytes read (to the end, or ``size`` of them) and their hex digests."""
    running, n = [hashlib.new(name) for name in names], 0
    while size is None or n < size:
        chunk = stream.read(CHUNK if size is None else min(CHUNK, size - n))
        if not chunk:
            break
        n += len(chunk)
        for d in running:
            d.update(chunk)
    return n, [d.hexdigest() for d in running]


@dataclass
class Files(InputPartition):
    paths: list[str]


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(root)``: path, bytes, sha256 and md5 of the files under a root.

    The listing alone is the driver's work; names that start with a dot or an underscore are left out,
    as Spark's own sources do.  A partition is a large file or some small ones, FILES at most.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string, md5 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options["path"], int(self.options.get("share", SHARE)))


class DigestReader(DataSourceReader):
    def __init__(self, root: str, share: int):
        self.root, self.share = root, share

    def partitions(self) -> list[Files]:
        system, path, prefix = located(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        below = path.rstrip("/")
        seen = [f for f in found if f.type == fs.FileType.File and not any(part[0] in "._" for part in f.path.removeprefix(below).split("/") if part)]
        out, size = [Files([])], 0
        for f in sorted(seen, key=lambda f: (-f.size, f.path)):
            if out[-1].paths and (size + f.size > self.share or len(out[-1].paths) == FILES):
                out.append(Files([]))
                size = 0
            out[-1].paths.append(prefix + f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with opened(path) as stream:
                n, (sha256, md5) = digests(stream, "sha256", "md5")
            yield path, n, sha256, md5


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 and md5 of the files under a root."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(root)


MEMBERS = "archive string, member string, bytes long, at long, sha256 string"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], list(names))


def headers(archive: str) -> Iterator[tuple]:
    """MEMBERS of an archive.

    A plain archive is passed from header to header, and ``at`` says where a member's bytes are.  A
    compressed one is read through once, and ``sha256`` is there instead; so it is for sparse members.
    """
    with opened(archive) as stream:
        plain = stream.read(262)[257:] == b"ustar"
        stream.seek(0)
        with tarfile.open(fileobj=stream, mode="r:" if plain else "r|*") as tar:
            for m in tar:
                tar.members = []
                if m.isfile() and plain and not m.issparse():
                    yield archive, m.name, m.size, m.offset_data, None
                elif m.isfile():
                    yield archive, m.name, *(lambda n, d: (n, None, d[0]))(*digests(tar.extractfile(m), "sha256"))


def archive_members(spark: SparkSession, root: str, *, share: int = SHARE) -> DataFrame:
    """archive, member, bytes, sha256 of the regular files in the tar archives under a root.

    First the headers of each archive, then its members by ranges: an archive's range of ``share``
    bytes is one task's work, so a large archive is many tasks.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["path"].to_pylist():
                rows = []
                for row in headers(archive):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _rows(rows, MEMBERS)
                        rows = []
                yield _rows(rows, MEMBERS)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            rows = []
            for archive, member, size, at in zip(*(batch[c].to_pylist() for c in ("archive", "member", "bytes", "at")), strict=True):
                if archive != path:
                    if stream is not None:
                        stream.close()
                    path, stream = archive, opened(archive)
                stream.seek(at)
                rows.append((archive, member, size, digests(stream, "sha256", size=size)[1][0]))
            yield _rows(rows, "archive string, member string, bytes long, sha256 string")
        if stream is not None:
            stream.close()

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar*").load(root).select("path")
    heads = reliable(archives.mapInArrow(listed, MEMBERS))
    there = heads.where("at IS NOT NULL").withColumn("range", F.floor(F.col("at") / share))
    ranges = there.select("archive", "range").distinct().count()
    sent = there.repartition(max(1, ranges), "archive", "range").sortWithinPartitions("archive", "at").drop("range", "sha256")
    return sent.mapInArrow(digested, "archive string, member string, bytes long, sha256 string").union(heads.where("at IS NULL").select("archive", "member", "bytes", "sha256"))


def write_archives(members: DataFrame, root: str) -> DataFrame:
    """Writes members (archive, member, content) to tar archives below a root, one for each ``archive``.

    Returns archive_path, member_path, original_sha256, original_bytes, archive_sha256.  An archive is
    written by one task, member by member, under a name of its own and then renamed, so a task that is
    run again does no harm.
    """
    index = "archive_path string, member_path string, original_sha256 string, original_bytes long, archive_sha256 string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, tar, stream, rows, staged = None, None, None, [], ""

        def done() -> pa.RecordBatch:
            tar.close()
            stream.close()
            system, path, _ = located(f"{root.rstrip('/')}/{archive}")
            with system.open_input_stream(staged) as again:
                digest = digests(again, "sha256")[1][0]
            system.move(staged, path)
            return _rows([(*r, digest) for r in rows], index)

        for batch in batches:
            for name, member, content in zip(*(batch[c].to_pylist() for c in ("archive", "member", "content")), strict=True):
                if name != archive:
                    if archive is not None:
                        yield done()
                    archive, rows = name, []
                    system, path, _ = located(f"{root.rstrip('/')}/{archive}")
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    staged = f"{path.rsplit('/', 1)[0]}/.{hashlib.sha256(f'{archive} {id(batch)}'.encode()).hexdigest()[:16]}"
                    stream = system.open_output_stream(staged)
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(content)
                tar.addfile(info, pa.BufferReader(content))
                rows.append((archive, member, hashlib.sha256(content).hexdigest(), len(content)))
        if archive is not None:
            yield done()

    rows = members.select("archive", "member", F.col("content").cast("binary").alias("content"))
    return reliable(rows.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(write, index))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (path, content) to files below a root, one for each; a repeated path is an error.  Returns path, bytes.

    Tasks write the files themselves, as a commit of Spark's sinks costs the driver time for each of
    them.  A task that is run again writes the same bytes.
    """
    if (bad := repeated_keys(rows, ["path"]).first()) is not None:
        raise ContractError(f"the path {bad['path']} repeats")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            written = []
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                system, path, _ = located(f"{root.rstrip('/')}/{name}")
                if (folder := path.rsplit("/", 1)[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(path, compression=None) as stream:
                    stream.write(content)
                written.append((name, len(content)))
            yield _rows(written, "path string, bytes long")

    out = rows.select("path", F.col("content").cast("binary").alias("content"))
    return reliable(out.repartition(1 + out.count() // FILES, "path").mapInArrow(write, "path string, bytes long"))
