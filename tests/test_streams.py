"""Files and archives as streams: sizes beyond a task's memory, compressed and plain archives, ranges of members."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile

import pytest

from tidemark.operators import packages
from tidemark.operators.contracts import ContractError
from tidemark.sources import scans, streams


def archive(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "elsewhere"
        tar.addfile(link)


def test_digests_of_small_files_and_odd_names(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    bodies = {"a.txt": b"", "sub dir/b #1.bin": os.urandom(100_000), "c": b"x", "_left": b"out", ".left": b"out"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].split(f"{tmp_path}/")[1]: tuple(r)[1:] for r in streams.file_digests(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), hashlib.md5(v).hexdigest()) for k, v in bodies.items() if "left" not in k}
    assert streams.file_digests(spark, f"file://{tmp_path}").count() == 3


def test_partitions_hold_bounded_shares(tmp_path):
    for i, size in enumerate((50, 10, 10, 10, 70)):
        (tmp_path / f"f{i}").write_bytes(b"x" * size)
    sizes = [[os.path.getsize(p.removeprefix("file:")) for p in part.paths] for part in streams.DigestReader(str(tmp_path), 60).partitions()]
    assert sorted(map(sum, sizes)) == [20, 60, 70] and all(sum(s) <= 60 or len(s) == 1 for s in sizes)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)  # sparse: no disk is used
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(zeros)
    want.update(bytes(size % (1 << 20)))
    row = ("x", "input", "large", None, want.hexdigest(), size)
    got = packages.verify_manifest(spark, spark.createDataFrame([row], "artifact_id string, role string, uri string, md5 string, sha256 string, size_bytes long"), str(tmp_path)).first()
    assert got["status"] == "PASS" and got["sha256_ok"]


@pytest.mark.parametrize("share", [1, 1_000, 1 << 30])
def test_members_of_plain_and_compressed_archives(spark, tmp_path, share):
    members = {f"d/{i}": os.urandom(i * 37) for i in range(40)} | {"x" * 180: b"long name", "d/1": b"again"}
    archive(tmp_path / "p.tar", members)
    archive(tmp_path / "z.tar.gz", members, "w:gz")
    archive(tmp_path / "e.tar", {})
    got = sorted((r["archive"].rsplit("/", 1)[1], r["member"], r["bytes"], r["sha256"]) for r in streams.archive_members(spark, str(tmp_path), share=share).collect())
    assert got == sorted((a, k, len(v), hashlib.sha256(v).hexdigest()) for a in ("p.tar", "z.tar.gz") for k, v in members.items())


def test_archives_are_written_and_verified(spark, tmp_path):
    rows = [(f"part-{i % 3}.tar", f"u{i}/{kind}.txt", bytes([i]) * i * 50) for i in range(9) for kind in "ab"]
    index = streams.write_archives(spark.createDataFrame(rows, "archive string, member string, content binary"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["part-0.tar", "part-1.tar", "part-2.tar"]
    index = index.selectExpr("*", "split(member_path, '/')[0] AS id", "substr(split(member_path, '/')[1], 1, 1) AS kind")
    reference = spark.createDataFrame([(f"u{i}",) for i in range(9)], "id string")
    checks = lambda rows, kinds="ab", ids=reference: {r["check"]: r["observed"] for r in packages.verify_packages(spark, rows, str(tmp_path / "out"), "id", list(kinds), ids).collect() if not r["passed"]}
    assert checks(index) == {}
    assert checks(index, ids=reference.where("id <> 'u3'").union(spark.createDataFrame([("u9",)], "id string"))) == {"missing_ids": 1, "extra_ids": 1}
    assert checks(index, kinds="abc") == {"incomplete_kinds": 9}
    assert checks(index, kinds="a") == {"unexpected_kinds": 9}
    assert checks(index.where("id <> 'u2'")) == {"missing_ids": 1, "unlisted_members": 2}


def test_a_row_that_says_what_the_header_says(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\nx\t1\na\tb\ny\t2\n")
    got = scans.repaired_table(spark, str(tmp_path / "t.tsv"), "k").collect()
    assert [tuple(r) for r in got] == [("x", 1.0), ("a", None), ("y", 2.0)]
    (tmp_path / "u.tsv").write_text("b\nx\t1\ny\t\n")
    assert [r.asDict() for r in scans.repaired_table(spark, str(tmp_path / "u.tsv"), "k").collect()] == [{"k": "x", "b": 1.0}, {"k": "y", "b": None}]
    (tmp_path / "h.tsv").write_text("a\tb\n")
    assert scans.repaired_table(spark, str(tmp_path / "h.tsv"), "k").columns == ["a", "b"]


def test_a_file_for_each_row(spark, tmp_path, monkeypatch):
    """Files are written by several tasks and digested by several; a repeated path is an error, as one file would be lost."""
    monkeypatch.setattr(streams, "FILES", 40)
    rows = spark.range(100).selectExpr("concat(id % 3, '/', id, '.gz') AS path", "concat('row ', id) AS content")
    got = streams.write_files(rows, f"file://{tmp_path}")
    assert {tuple(r) for r in got.collect()} == {(f"{i % 3}/{i}.gz", len(f"row {i}")) for i in range(100)} and got.rdd.getNumPartitions() == 3
    assert {i: (tmp_path / f"{i % 3}/{i}.gz").read_bytes() for i in range(100)} == {i: f"row {i}".encode() for i in range(100)}
    assert sorted(len(p.paths) for p in streams.DigestReader(str(tmp_path), streams.SHARE).partitions()) == [20, 40, 40]
    with pytest.raises(ContractError):
        streams.write_files(rows.union(rows.limit(1)), str(tmp_path / "again"))
