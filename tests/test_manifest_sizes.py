"""Checksums of files that are too large to be held."""

import hashlib

from mailsift.sources.manifest import delivered_files, violations


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for name, size in (("a.bin", 10), ("b.bin", 5_000), ("sub dir/c d%20.bin", 6_000)):
        (tmp_path / name).write_bytes(bytes(i * 7 % 256 for i in range(size)))
    whole = {r.name: (r.bytes, r.sha256) for r in delivered_files(spark, str(tmp_path)).collect()}
    assert whole["b.bin"] == (5_000, hashlib.sha256((tmp_path / "b.bin").read_bytes()).hexdigest())
    assert {r.name: (r.bytes, r.sha256) for r in delivered_files(spark, str(tmp_path), held_bytes=100).collect()} == whole


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)  # a file with a hole: it takes no disk
    found = delivered_files(spark, str(tmp_path))
    wanted = spark.createDataFrame([("large.bin", "0", size)], "name string, sha256 string, max_bytes long")
    assert [tuple(r) for r in violations(found, wanted).collect()] == [("large.bin", "checksum differs")]
    assert found.first().bytes == size
