"""Scans: labelled file trees, JSON records, adapter checkpoints."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import resolve_path
from ..operators.adapters import overlay
from ..vocab import RECORD_DDL, SUFFIXES
from .tensors import read_tensors, tensors_of


def labelled_paths(paths: DataFrame, classes: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """``image, label, label_name, raw_label`` of the paths with an image
    suffix (in any case) whose folder, in upper case, is a class. The path is
    given relative to ``root``. Only paths are read, never contents."""
    p = F.col(path)
    folder = F.upper(F.element_at(F.split(p, "/"), -2))
    suffix = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
    found = paths.where(suffix.isin(*SUFFIXES)).select(p.alias("full"), folder.alias("folder"))
    image = F.when(F.startswith("full", F.lit(root)), F.substr("full", F.lit(len(root) + 1))).otherwise(F.col("full")) if root else F.col("full")
    return found.join(F.broadcast(classes), F.col("folder") == F.col("code")).select(image.alias("image"), F.col("idx").alias("label"), F.col("canonical").alias("label_name"), F.col("code").alias("raw_label"))


def traversal(path: Column) -> list[Column]:
    """The order in which a walk meets files: a folder's own by name, then its
    folders by name, each with all below it."""
    return [F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.element_at(F.split(path, "/"), -1)]


def scan_labelled(spark: SparkSession, folder: str, classes: DataFrame) -> DataFrame:
    """The same of a folder and all below it; order by ``traversal`` where the
    order counts. Spark lists files itself, so any
    store that it reads will do; it passes over names that begin with a dot or
    an underscore. A missing folder or one without records is refused."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    top = listed.select(F.regexp_extract("path", r"^([a-z]+:/*)?(/.*)$", 2).alias("path"))
    own = folder.split(":", 1)[-1].rstrip("/")
    records = labelled_paths(top, classes, root="/" + own.lstrip("/") + "/")
    if not records.take(1):
        raise ValueError(f"no labelled files in {folder}")
    return records


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that each hold an array, or one object."""
    return spark.read.schema(RECORD_DDL).option("multiLine", True).json(path)


def existing(records: DataFrame, files: DataFrame, root: str, most: int | None = None, order: list[str | Column] | None = None) -> DataFrame:
    """The first ``most`` records, then those of them whose file exists: so
    fewer may be left. ``files`` has a column ``path``."""
    if most is not None and most < 0:
        raise ValueError("the number of records must not be negative")
    head = records if most is None else records.orderBy(*(order or ["image"])).limit(most)
    return head.join(files.select(F.col("path").alias("there")), resolve_path(F.col("image"), root) == F.col("there"), "left_semi")


def load_checkpoint(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("base_key", "factor", "r")) -> DataFrame:
    """An adapter checkpoint of Parquet files: ``adapter.parquet`` if it is
    there, else all of them, the later name winning where keys clash."""
    one = f"{folder.rstrip('/')}/adapter.parquet"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(one)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(one)
    parts = spark.read.option("recursiveFileLookup", True).parquet(folder).withColumn("_file", F.col("_metadata.file_path"))
    return overlay(parts, list(keys), "_file").drop("_file")


def load_global_file(spark: SparkSession, path: str) -> DataFrame:
    """A global model's file of tensors, which must lie under ``model``."""
    tensors_of(path, "model")  # refuses a bad file here, not when it is read
    return read_tensors(spark, path, "model")


def load_global(spark: SparkSession, path: str) -> DataFrame:
    """A global model's table; it must have the columns of one."""
    table = spark.read.parquet(path)
    if lost := {"base_key", "factor", "r", "vec"} - set(table.columns):
        raise ValueError(f"not a global model: no {sorted(lost)}")
    return table


def model_source(path: str) -> str:
    """What a model path is: ``table`` of a global model, ``adapter`` folder,
    or an ``id`` to be loaded directly."""
    if path.endswith((".pt", ".parquet")):
        return "table"
    if os.path.isfile(os.path.join(path, "adapter_config.json")):
        return "adapter"
    return "id"


def is_valid_zip(path: str) -> bool:
    """Whether an archive is there, not empty, and has a readable directory."""
    if not os.path.isfile(path) or not os.path.getsize(path):
        return False
    try:
        with zipfile.ZipFile(path):
            return True
    except zipfile.BadZipFile:
        return False


def safe_members(path: str, folder: str) -> Iterator[tuple[str, str]]:
    """(member, target) of an archive; one that leaves ``folder`` is refused."""
    top = os.path.realpath(folder)
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            target = os.path.realpath(os.path.join(top, name))
            if target != top and not target.startswith(top + os.sep):
                raise ValueError(f"{name} leaves {folder}")
            yield name, target


def extract(path: str, folder: str) -> None:
    """Unpacks an archive after all of its members have proved safe."""
    names = list(safe_members(path, folder))
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(path) as archive:
        for name, _ in names:
            archive.extract(name, folder)
