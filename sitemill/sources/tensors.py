"""Tensor checkpoints as a data source, read and written.

``spark.read.format("tensors").load(path)`` reads a file or a checkpoint
folder: ``adapter_model.safetensors`` if it is there, else all
``*.safetensors`` in order of their names, the last file that has a key winning,
else ``pytorch_model.bin`` (in its ``state_dict``, if it has one). Suffixes
``.pt`` and ``.bin`` are zipped pickles, of which only tensors, dictionaries and
plain values are read and no code is ever run; option ``member`` names the key
under which such a file must hold its tensors (``model`` for a global model).

The driver reads headers alone: names, types, shapes and places. A partition is
a run of byte ranges of about ``partBytes``, cut between rows, so a large
tensor is read by many tasks and small ones go together; keys that a later file
has are never read from an earlier one. A header that is damaged, or does not
account for every byte of a file, is refused before any task starts.

Rows are ``file, key, dtype, shape, row, vec``: ``row`` counts over all
dimensions but the last. Empty tensors have no row. Whole numbers beyond 2^53
can't be told in a double and are refused.

``df.write.format("tensors")`` takes ``key, row, vec`` (and ``shape``, where a
tensor isn't a matrix), each key's rows together and in order, as
``write_checkpoint`` deals them. Every task streams its tensors into one file;
the files get their names when all tasks have succeeded, and an index last, so a
task that is lost or run twice leaves nothing that a reader sees.

Paths are those of any store that pyarrow opens.
"""

from __future__ import annotations

import io
import json
import math
import pickle
import shutil
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.scalars import add_model_prefix, base_key, factor_kind, strip_model_prefix

ROW_DDL = "file string, key string, dtype string, shape array<bigint>, row bigint, vec array<double>"
#: Bytes of tensors that a partition reads, and those of a batch.
PART_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: No header is longer than this.
MOST_HEADER = 100 << 20

# Names of types in headers, with the numpy type of their bytes (BF16: the upper half of a float's).
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
# Storage classes in pickles, with the name of their type.
STORAGES = {"DoubleStorage": "F64", "FloatStorage": "F32", "HalfStorage": "F16", "BFloat16Storage": "BF16", "LongStorage": "I64", "IntStorage": "I32", "ShortStorage": "I16", "CharStorage": "I8", "ByteStorage": "U8", "BoolStorage": "BOOL"}


@dataclass(frozen=True)
class Tensor:
    """Where a tensor's bytes lie."""

    file: str
    key: str
    dtype: str
    shape: tuple[int, ...]
    start: int

    @property
    def width(self) -> int:
        return self.shape[-1] if self.shape else 1

    @property
    def rows(self) -> int:
        return math.prod(self.shape) // self.width if math.prod(self.shape) else 0

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(TYPES[self.dtype]).itemsize


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a name is there twice")
    return dict(pairs)


def read_header(file: io.RawIOBase, size: int, name: str) -> list[Tensor]:
    """Tensors of a file whose header is JSON, each byte accounted for."""
    try:
        n = int.from_bytes(file.read(8), "little")
        if size < 8 or not 2 <= n <= min(MOST_HEADER, size - 8):
            raise ValueError(f"a header of {n} bytes in a file of {size}")
        header = json.loads(file.read(n), object_pairs_hook=_once)
        if not isinstance(header, dict):
            raise ValueError("the header is no object")
        header.pop("__metadata__", None)
        found, end = [], 0
        for key, at in sorted(header.items(), key=lambda x: (x[1]["data_offsets"], x[0])):
            first, last = at["data_offsets"]
            shape = tuple(at["shape"])
            if at["dtype"] not in TYPES or not all(type(k) is int and k >= 0 for k in (*shape, first, last)):
                raise ValueError(f"{key} has a type or shape that can't be read")
            if first != end or last - first != math.prod(shape) * np.dtype(TYPES[at["dtype"]]).itemsize:
                raise ValueError(f"{key} has bytes {first} to {last}")
            found.append(Tensor(name, key, at["dtype"], shape, 8 + n + first))
            end = last
        if end != size - 8 - n:
            raise ValueError(f"{size - 8 - n - end} bytes belong to no tensor")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{name}: damaged header: {e}") from e
    return found


class _Pickled(pickle.Unpickler):
    """Reads tensors' places; knows no other classes and calls none."""

    def find_class(self, module: str, name: str) -> Callable:
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return lambda storage, offset, shape, stride, *_: ("tensor", storage, offset, tuple(shape), tuple(stride))
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda data, *_: data
        if module == "torch" and name in STORAGES:
            return ("storage", STORAGES[name])
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a checkpoint")

    def persistent_load(self, pid: tuple) -> tuple:
        return pid[2], pid[1][1]  # the member's number, the type


def read_pickle(file: io.RawIOBase, name: str, member: str | None, unwrap: str | None = None) -> list[Tensor]:
    """Tensors of a zipped pickle, under ``member``, or under ``unwrap`` if it is there."""
    try:
        with zipfile.ZipFile(file) as archive:
            places = {x.filename: x for x in archive.infolist()}
            (root,) = (x for x in places if x.endswith("data.pkl"))
            held = _Pickled(io.BytesIO(archive.read(root))).load()
    except (zipfile.BadZipFile, pickle.UnpicklingError, ValueError, EOFError, IndexError, KeyError, AttributeError, TypeError) as e:
        raise ValueError(f"{name}: not a tensor checkpoint: {e}") from e
    if not isinstance(held, dict):
        raise ValueError(f"{name}: no dictionary of tensors but {type(held).__name__}")
    if member is not None:
        if held.get(member) is None:
            raise ValueError(f"{name}: no key {member!r} among {sorted(map(str, held))}")
        held = held[member]
    elif unwrap in held:
        held = held[unwrap]
    found = []
    for key, x in held.items():
        if not (isinstance(x, tuple) and x and x[0] == "tensor"):
            continue
        _, (number, dtype), offset, shape, stride = x
        steps = tuple(math.prod(shape[i + 1 :]) for i in range(len(shape)))
        if any(n > 1 and a != b for n, a, b in zip(shape, stride, steps, strict=True)):
            raise ValueError(f"{name}: {key} is not contiguous")
        entry = places.get(f"{root.removesuffix('data.pkl')}data/{number}")
        size = np.dtype(TYPES[dtype]).itemsize
        if entry is None or entry.compress_type != zipfile.ZIP_STORED or (offset + math.prod(shape)) * size > entry.file_size:
            raise ValueError(f"{name}: the bytes of {key} are not there")
        file.seek(entry.header_offset)
        local = file.read(30)  # its last two numbers are the lengths of what follows
        start = entry.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
        found.append(Tensor(name, str(key), dtype, shape, start + offset * size))
    return found


def tensors_of(path: str, member: str | None = None) -> list[Tensor]:
    """All tensors of a file or checkpoint folder; of a key in several files
    the last one."""
    fs, own = store(path)
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.File:
        files = [own]
    else:
        listed = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(own, allow_not_found=True)) if x.is_file and not x.base_name.startswith((".", "_")))
        by_name = {x.rsplit("/", 1)[-1]: x for x in listed}
        one = by_name.get("adapter_model.safetensors")
        files = [one] if one else [x for x in listed if x.endswith(".safetensors")] or [by_name[x] for x in ("pytorch_model.bin",) if x in by_name]
    if not files:
        raise FileNotFoundError(f"no checkpoint in {path}")
    won: dict[str, Tensor] = {}
    for name in files:
        with fs.open_input_file(name) as file:
            found = read_pickle(file, name, member, "state_dict") if name.endswith((".pt", ".bin")) else read_header(file, file.size(), name)
        won |= {t.key: t for t in found}
    return list(won.values())


@dataclass
class Range(InputPartition):
    """Rows of tensors of one file: (tensor, first row, rows)."""

    parts: list[tuple[Tensor, int, int]]


def plan(tensors: list[Tensor], most: int = PART_BYTES) -> list[Range]:
    """Partitions of about ``most`` bytes, cut between rows."""
    out: list[Range] = []
    held: list[tuple[Tensor, int, int]] = []
    size = 0
    for t in sorted(tensors, key=lambda t: (t.file, t.start, t.key)):
        at = 0
        while at < t.rows:
            n = min(t.rows - at, max(1, (most - size) // t.row_bytes))
            if held and (held[0][0].file != t.file or size + n * t.row_bytes > most):
                out.append(Range(held))
                held, size = [], 0
                continue
            held.append((t, at, n))
            at, size = at + n, size + n * t.row_bytes
    return [*out, Range(held)] if held else out


def values(raw: bytes, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, TYPES[dtype])
    if dtype == "BF16":
        return (x.astype("<u4") << 16).view("<f4").astype(np.float64)
    if dtype == "I64" and len(x) and max(int(x.max()), -int(x.min())) > 1 << 53:
        raise ValueError("a whole number beyond 2^53")
    return x.astype(np.float64)


def to_bytes(x: np.ndarray, dtype: str) -> bytes:
    """The bytes of numbers in a type; those of a half float are rounded to even."""
    if dtype == "BF16":
        bits = x.astype("<f4").view("<u4")
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
        return np.where(np.isnan(x), 0x7FC0, rounded).astype("<u2").tobytes()
    return x.astype(TYPES[dtype]).tobytes()


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.member = options.get("path"), options.get("member")
        self.most = int(options.get("partbytes") or PART_BYTES)

    def partitions(self) -> list[Range]:
        if not self.path:
            raise ValueError("a checkpoint needs a path")
        return plan(tensors_of(self.path, self.member), self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):  # an empty checkpoint has no partition
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.parts[0][0].file) as file:
            for t, first, n in partition.parts:
                step = max(1, BATCH_BYTES // (t.width * 8))
                for at in range(first, first + n, step):
                    rows = min(step, first + n - at)
                    file.seek(t.start + at * t.row_bytes)
                    raw = file.read(rows * t.row_bytes)
                    if len(raw) < rows * t.row_bytes:
                        raise ValueError(f"{t.file}: {t.key} is cut off")
                    vecs = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * t.width, pa.int32()), pa.array(values(raw, t.dtype)))
                    shape = pa.array([list(t.shape)] * rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(t.file, rows), pa.repeat(t.key, rows), pa.repeat(t.dtype, rows), shape, pa.array(np.arange(at, at + rows)), vecs], ["file", "key", "dtype", "shape", "row", "vec"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    keys: list[str]
    size: int


class TensorWriter(DataSourceArrowWriter):
    """A file a task; see the module's head."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if lost := {"key", "row", "vec"} - set(schema.names):
            raise ValueError(f"not tensors: no {sorted(lost)}")
        self.folder, self.dtype = options["path"].rstrip("/"), options.get("dtype", "F32")
        self.name, self.overwrite, self.has_shape = options.get("name", "model"), overwrite, "shape" in schema.names
        if self.dtype not in TYPES:
            raise ValueError(f"no type {self.dtype}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        header: dict[str, dict] = {}
        key, rows, width, shape, start = None, 0, 0, None, 0

        def close() -> None:
            if key is None:
                return
            own = list(shape) if shape is not None else [rows, width]
            if math.prod(own) != rows * width:
                raise ValueError(f"{key}: {rows} rows of {width} don't fill {own}")
            header[key] = {"dtype": self.dtype, "shape": own, "data_offsets": [start, data.tell()]}

        with tempfile.TemporaryFile() as data:
            for batch in iterator:
                held = {n: batch.column(batch.schema.get_field_index(n)) for n in ("key", "row", "vec", *(["shape"] if self.has_shape else []))}
                for i, (k, r) in enumerate(zip(held["key"].to_pylist(), held["row"].to_pylist(), strict=True)):
                    vec = held["vec"][i].values
                    if vec is None or vec.null_count:
                        raise ValueError(f"{k}: a null value")
                    if k != key:
                        close()
                        if k is None or k in header:
                            raise ValueError(f"{k}: the rows of a key must lie together")
                        key, rows, width, start = k, 0, len(vec), data.tell()
                        shape = held["shape"][i].as_py() if self.has_shape else None
                    if r != rows or len(vec) != width:
                        raise ValueError(f"{k}: row {r} of {len(vec)} values where row {rows} of {width} comes next")
                    data.write(to_bytes(vec.to_numpy(zero_copy_only=False).astype(np.float64), self.dtype))
                    rows += 1
            close()
            if not header:
                return Written(None, [], 0)
            raw = json.dumps(header, separators=(",", ":")).encode()
            raw += b" " * (-len(raw) % 8)
            fs, folder = store(self.folder)
            fs.create_dir(folder, recursive=True)
            path = f"{folder}/.{uuid.uuid4().hex}"
            size = data.tell()
            data.seek(0)
            with fs.open_output_stream(path) as out:
                out.write(len(raw).to_bytes(8, "little") + raw)
                shutil.copyfileobj(data, out, 1 << 20)
        return Written(path, list(header), size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.folder)
        files = [m for m in messages if m is not None and m.file]
        fs.create_dir(folder, recursive=True)
        there = [x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if x.is_file and not x.base_name.startswith(".") and x.base_name.split("-0")[0].split(".")[0] == self.name]
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{folder} has a checkpoint {self.name} already")
        if len(keys := [k for m in files for k in m.keys]) > len(set(keys)):
            self.abort(messages)
            raise ValueError("the rows of a key lie in several tasks")
        for x in there:
            fs.delete_file(x)
        names = [f"{self.name}.safetensors"] if len(files) == 1 else [f"{self.name}-{i + 1:05d}-of-{len(files):05d}.safetensors" for i in range(len(files))]
        for m, name in zip(files, names, strict=True):
            fs.move(m.file, f"{folder}/{name}")
        if len(files) > 1:
            index = {"metadata": {"total_size": sum(m.size for m in files)}, "weight_map": {k: name for m, name in zip(files, names, strict=True) for k in m.keys}}
            with fs.open_output_stream(f"{folder}/{self.name}.safetensors.index.json") as out:
                out.write(json.dumps(index, indent=2, sort_keys=True).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = store(self.folder)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(m.file)


class Tensors(DataSource):
    """The data source ``tensors``."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return ROW_DDL

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options, schema, overwrite)


def read_tensors(spark: SparkSession, path: str, member: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(Tensors)
    reader = spark.read.format("tensors").option("partBytes", part_bytes)
    return (reader if member is None else reader.option("member", member)).load(path)


def write_checkpoint(tensors: DataFrame, folder: str, name: str = "model", dtype: str = "F32", files: int | None = None, overwrite: bool = True) -> None:
    """Writes ``key, row, vec`` (and ``shape``) as a checkpoint of ``files``
    files at most; every key's rows go to one task, in order, and through it a
    row at a time."""
    tensors.sparkSession.dataSource.register(Tensors)
    dealt = tensors.repartition("key") if files is None else tensors.repartition(files, "key")
    ordered = dealt.sortWithinPartitions("key", "row")
    ordered.write.format("tensors").options(name=name, dtype=dtype).mode("overwrite" if overwrite else "append").save(folder)


def factor_rows(tensors: DataFrame) -> DataFrame:
    """``base_key, factor, r, vec`` of the adapter tensors: a component is a
    row of an A, a column of a B. Keys lose the model's prefix; other tensors
    are left out. Tensors that are no matrices are refused."""
    key = strip_model_prefix(F.col("key"))
    kind = factor_kind(key)
    fine = F.when(F.size("shape") == 2, base_key(key)).otherwise(F.raise_error(F.concat(F.lit("a factor must be a matrix: "), "key")).cast("string"))
    own = tensors.where(kind.isNotNull()).select(fine.alias("base_key"), kind.alias("factor"), "row", "vec")
    a = own.where("factor = 'A'").select("base_key", "factor", F.col("row").cast("int").alias("r"), "vec")
    cells = own.where("factor = 'B'").select("base_key", "factor", "row", F.posexplode("vec").alias("r", "x"))
    column = F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda c: c["x"])
    return a.unionByName(cells.groupBy("base_key", "factor", "r").agg(column.alias("vec")))


def factor_tensors(factors: DataFrame, prefix: bool = True) -> DataFrame:
    """The other way round: ``key, row, vec`` of tensors whose keys have the
    factor's mark before their last part (a base key without a dot is refused)
    and the model's prefix before all. Components must be numbered from 0
    without gaps."""
    marked = F.regexp_replace(F.col("base_key"), F.lit(r"\.([^.]*)$"), F.concat(F.lit(".lora_"), "factor", F.lit(".$1")))
    where = F.when(F.contains("base_key", F.lit(".")), marked).otherwise(F.raise_error(F.concat(F.lit("a base key without a dot: "), "base_key")).cast("string"))
    named = factors.withColumn("key", add_model_prefix(where) if prefix else where)
    a = named.where("factor = 'A'").select("key", F.col("r").cast("bigint").alias("row"), F.col("vec").cast("array<double>").alias("vec"))
    cells = named.where("factor = 'B'").select("key", "r", F.posexplode(F.col("vec").cast("array<double>")).alias("row", "x"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda c: c["x"])
    return a.unionByName(cells.groupBy("key", F.col("row").cast("bigint").alias("row")).agg(line.alias("vec")))
