"""Archives read where they lie."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sitemill.sources import archives, files
from sitemill.vocab import VOCABULARY


def packed(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members:
            archive.writestr(zipfile.ZipInfo(name), content)
    return str(path)


def test_members_are_rows(spark, tmp_path):
    held = [("set/adi/1.JPG", b"x" * 5000), ("set/tum/2.png", b""), ("set/", b""), ("set/other/3.png", os.urandom(3000)), ("set/lym/4.txt", b"no"), ("set/tum/2.png", b"again")]
    one = packed(tmp_path / "a.zip", held)
    packed(tmp_path / "b.ZIP", [("x", b"1")])
    (tmp_path / ".c.zip").write_bytes(b"no")
    want = sorted((n, len(c), c) for n, c in held if not n.endswith("/"))
    for most in (1, 2000, 1 << 20):
        frame = archives.read_archives(spark, one, part_bytes=most)
        assert sorted((r["path"], r["size"], bytes(r["content"])) for r in frame.collect()) == want
    assert archives.read_archives(spark, one, part_bytes=1).rdd.getNumPartitions() == 5
    both = archives.read_archives(spark, str(tmp_path), content=False)
    assert both.count() == 6 and both.where("content IS NOT NULL").count() == 0
    found = files.labelled_paths(both.where("path LIKE 'set/%'").select(F.concat(F.lit("/"), "path").alias("path")), VOCABULARY.table(spark), root="/set/")
    assert sorted((r["image"], r["label"]) for r in found.collect()) == [("adi/1.JPG", 0), ("tum/2.png", 8), ("tum/2.png", 8)]
    assert archives.read_archives(spark, packed(tmp_path / "empty.zip", [])).count() == 0


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "..\\x", "\\x"])
def test_names_that_leave_are_refused(spark, tmp_path, name):
    path = packed(tmp_path / "a.zip", [("fine", b"1"), (name, b"2")])
    with pytest.raises(Exception, match="leaves its folder"):
        archives.read_archives(spark, path).collect()
    assert not archives.leaves("a/../b") and not archives.leaves("..a/b..")


def test_damage_is_refused(spark, tmp_path):
    whole = open(packed(tmp_path / "a.zip", [("a", b"abc" * 1000), ("b", os.urandom(500))]), "rb").read()
    (tmp_path / "a.zip").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="not an archive"):
        archives.read_archives(spark, str(tmp_path)).collect()
    at = whole.index(b"b") + 40
    (tmp_path / "a.zip").write_bytes(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])
    with pytest.raises(Exception, match="CRC|Error"):
        archives.read_archives(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no archive"):
        archives.read_archives(spark, str(tmp_path / "none")).collect()


def test_archives_are_written_by_tasks(spark, tmp_path):
    rows = [(f"d{i % 3}/{i}", bytes([i]) * i if i else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    told = archives.write_archives(frame, str(tmp_path), 3).collect()
    assert sum(r["members"] for r in told) == 40 and sorted(os.path.basename(r["archive"]) for r in told) == sorted(x for x in os.listdir(tmp_path) if not x.startswith("."))
    assert sorted((r["path"], bytes(r["content"])) for r in archives.read_archives(spark, str(tmp_path)).collect()) == sorted((p, c or b"") for p, c in rows)
    for bad in (None, "../x"):
        with pytest.raises(Exception, match="can't be a member"):
            archives.write_archives(spark.createDataFrame([(bad, b"x")], "path string, content binary"), str(tmp_path / "bad"), 1).collect()
