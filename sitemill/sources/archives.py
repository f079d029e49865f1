"""Zip archives as a data source: members are rows, read where they lie.

``spark.read.format("archive").load(path)`` reads a ``.zip`` file or all of a
folder: ``archive, path, size, content``. The driver reads central directories
alone; a partition is a run of members of one archive of about ``partBytes``
packed bytes, so a large archive is unpacked by many tasks and nothing is
written to disk. Option ``content`` set to ``false`` lists members without
reading any. Checksums are verified; an archive that can't be opened, a member
that is encrypted, and a name that would leave the folder it is unpacked into
are refused before any task starts. Directories are no members; names that are
there twice are rows each.

``write_archives`` makes archives of rows, one a task, which get their names
when they are whole.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..storage import cut
from .tensors import store

ROW_DDL = "archive string, path string, size bigint, content binary"
#: Packed bytes of a partition, and unpacked ones of a batch.
PART_BYTES, BATCH_BYTES = 32 << 20, 8 << 20


def leaves(name: str) -> bool:
    """Whether a member's name leads out of the folder that it is unpacked into."""
    depth = 0
    for part in name.replace("\\", "/").split("/"):
        depth += 0 if part in ("", ".") else -1 if part == ".." else 1
        if depth < 0:
            return True
    return name.startswith(("/", "\\"))


class _File:
    """A store's file that fails as a local one does when sought before its
    start, by which small archives are told."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.file.seek(to, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name: str) -> object:
        return getattr(self.file, name)


@dataclass
class Members(InputPartition):
    """Places in the central directory of an archive."""

    archive: str
    places: list[int]


def plan(path: str, most: int = PART_BYTES) -> list[Members]:
    """Partitions of an archive, or of all in a folder, in order of names."""
    fs, own = store(path)
    if fs.get_file_info(own).type == pafs.FileType.File:
        files = [own]
    else:
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(own, allow_not_found=True)) if x.is_file and x.base_name.lower().endswith(".zip") and not x.base_name.startswith((".", "_")))
    if not files:
        raise FileNotFoundError(f"no archive in {path}")
    out: list[Members] = []
    for name in files:
        try:
            with fs.open_input_file(name) as file, zipfile.ZipFile(_File(file)) as archive:
                listed = archive.infolist()
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise ValueError(f"{name}: not an archive: {e}") from e
        held, size = [], 0
        for i, info in enumerate(listed):
            if leaves(info.filename):
                raise ValueError(f"{name}: {info.filename} leaves its folder")
            if info.flag_bits & 1:
                raise ValueError(f"{name}: {info.filename} is encrypted")
            if info.is_dir():
                continue
            if held and size + info.compress_size > most:
                out.append(Members(name, held))
                held, size = [], 0
            held.append(i)
            size += info.compress_size
        if held:
            out.append(Members(name, held))
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options.get("path"), int(options.get("partbytes") or PART_BYTES)
        self.content = options.get("content", "true").lower() != "false"

    def partitions(self) -> list[Members]:
        if not self.path:
            raise ValueError("an archive needs a path")
        return plan(self.path, self.most)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Members):  # archives without members
            return
        fs, _ = store(self.path)
        rows: list[tuple[str, int, bytes | None]] = []

        def batch() -> pa.RecordBatch:
            paths, sizes, contents = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.repeat(partition.archive, len(rows)), pa.array(paths), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], ["archive", "path", "size", "content"])

        with fs.open_input_file(partition.archive) as file, zipfile.ZipFile(_File(file)) as archive:
            listed, held = archive.infolist(), 0
            for i in partition.places:
                rows.append((listed[i].filename, listed[i].file_size, archive.read(listed[i]) if self.content else None))
                held += listed[i].file_size if self.content else 1000
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()


class Archive(DataSource):
    """The data source ``archive``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ROW_DDL

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, content: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(Archive)
    return spark.read.format("archive").option("content", str(content).lower()).option("partBytes", part_bytes).load(path)


def write_archives(members: DataFrame, folder: str, files: int) -> DataFrame:
    """Writes ``path, content`` into ``files`` archives at most and returns
    ``archive, members`` once they are all there. Null contents are empty;
    null names and those that leave their folder are refused."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = store(folder)
        fs.create_dir(own, recursive=True)
        name, count, number = f"{own}/.{uuid.uuid4().hex}", 0, None
        with fs.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for part, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if path is None or leaves(path):
                        raise ValueError(f"{path} can't be a member")
                    archive.writestr(zipfile.ZipInfo(path), content.as_py() or b"", zipfile.ZIP_DEFLATED)
                    count, number = count + 1, part
        if number is None:
            fs.delete_file(name)
            return
        final = f"{own}/part-{number:05d}.zip"
        fs.move(name, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([count])], ["archive", "members"])

    dealt = members.repartition(files, "path").select(F.spark_partition_id().alias("part"), "path", "content")
    return cut(dealt.mapInArrow(run, "archive string, members bigint"), "archives")
