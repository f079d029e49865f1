"""Tensor checkpoints: round trips, files that are damaged, which file wins."""

import io
import json
import os
import pickle
import struct
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.sources import files, tensors


def plain_file(path, held, metadata=None):
    """The format by hand: {key: (dtype, array)}."""
    header, body = ({"__metadata__": metadata} if metadata else {}), b""
    for key, (dtype, x) in held.items():
        raw = x.tobytes()
        header[key] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    raw = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + body)


def rows_of(frame):
    return {(r["key"], r["row"]): tuple(r["vec"]) for r in frame.collect()}


def test_reads_every_type_and_shape(spark, tmp_path):
    rng = np.random.default_rng(1)
    held = {
        "f64": ("F64", rng.normal(size=(3, 4))), "f32": ("F32", rng.normal(size=(2, 3, 4)).astype("<f4")), "f16": ("F16", rng.normal(size=(5, 1)).astype("<f2")),
        "i64": ("I64", np.array([[1, -(2**53)], [2**53, 0]])), "i8": ("I8", np.array([-128, 127], "i1")), "u8": ("U8", np.array([255, 0, 7], "u1")), "bool": ("BOOL", np.array([True, False])),
        "scalar": ("I32", np.array(-5, "<i4")), "empty": ("F32", np.zeros((0, 4), "<f4")), "half": ("BF16", np.array([0x3F80, 0xC000, 0x7FC0], "<u2")),
    }
    plain_file(tmp_path / "adapter_model.safetensors", held, {"format": "pt"})
    plain_file(tmp_path / "other.safetensors", {"f64": ("F32", np.zeros((1, 1), "<f4"))})
    for most in (1, 40, 1 << 20):
        found = rows_of(tensors.read_tensors(spark, str(tmp_path), part_bytes=most))
        for key, (_, x) in held.items():
            if key == "half":
                assert found["half", 0][:2] == (1.0, -2.0) and np.isnan(found["half", 0][2])
                continue
            flat = x.reshape(-1, x.shape[-1] if x.shape else 1)
            assert all(found[key, i] == tuple(v.astype(float)) for i, v in enumerate(flat))
        assert not [k for k in found if k[0] == "empty"]
    one = tensors.read_tensors(spark, f"file://{tmp_path}/adapter_model.safetensors", part_bytes=1)
    assert one.rdd.getNumPartitions() > 10 and {tuple(r["shape"]) for r in one.select("shape").collect()} >= {(2, 3, 4)}
    plain_file(tmp_path / "wide.safetensors", {"w": ("I64", np.array([2**53 + 1]))})
    with pytest.raises(Exception, match="beyond 2\\^53"):
        tensors.read_tensors(spark, f"{tmp_path}/wide.safetensors").collect()


def test_the_last_file_wins_and_only_it_is_read(spark, tmp_path):
    plain_file(tmp_path / "b.safetensors", {"x": ("F32", np.full((2, 2), 2, "<f4")), "y": ("F32", np.full((1, 2), 2, "<f4"))})
    plain_file(tmp_path / "a.safetensors", {"x": ("F32", np.full((3, 2), 1, "<f4")), "z": ("F32", np.full((1, 2), 1, "<f4"))})
    (tmp_path / ".hidden.safetensors").write_bytes(b"no")
    assert rows_of(tensors.read_tensors(spark, str(tmp_path))) == {("x", 0): (2, 2), ("x", 1): (2, 2), ("y", 0): (2, 2), ("z", 0): (1, 1)}
    assert sum(n for p in tensors.plan(tensors.tensors_of(str(tmp_path))) for _, _, n in p.parts) == 4
    with pytest.raises(Exception, match="no checkpoint"):
        tensors.read_tensors(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("damage", ["short", "length", "json", "hole", "overlap", "size", "type", "twice", "extra", "cut", "list"])
def test_damaged_headers_are_refused(tmp_path, damage):
    x = {"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "F32", "shape": [1], "data_offsets": [8, 12]}}
    body = bytes(12)
    if damage == "hole":
        x["b"]["data_offsets"], body = [12, 16], bytes(16)
    elif damage == "overlap":
        x["b"]["data_offsets"] = [4, 8]
    elif damage == "size":
        x["a"]["shape"] = [3]
    elif damage == "type":
        x["a"]["dtype"] = "F31"
    elif damage == "extra":
        body += b"x"
    elif damage == "cut":
        body = body[:-1]
    raw = json.dumps([x] if damage == "list" else x).encode()
    if damage == "json":
        raw = raw[:-3]
    elif damage == "twice":
        raw = raw.replace(b'"b"', b'"a"')
    whole = struct.pack("<Q", len(raw) * (1000 if damage == "length" else 1)) + raw + body
    path = tmp_path / "model.safetensors"
    path.write_bytes(whole[:5] if damage == "short" else whole)
    with pytest.raises(ValueError, match="damaged header"):
        tensors.tensors_of(str(path))


@pytest.mark.parametrize("dtype", ["F32", "F16", "BF16", "F64"])
def test_round_trip_in_several_files(spark, tmp_path, dtype):
    rng = np.random.default_rng(2)
    held = [(f"model.k{k}", r, [float(v) for v in np.float32(rng.normal(size=3 + k))]) for k in range(7) for r in range(k + 1)]
    frame = spark.createDataFrame(held, "key string, row bigint, vec array<double>").repartition(5)
    tensors.write_checkpoint(frame, str(tmp_path), "net", dtype, files=3)
    found = rows_of(tensors.read_tensors(spark, str(tmp_path)))
    back = {(k, r): tuple(tensors.values(tensors.to_bytes(np.array(v), dtype), dtype)) for k, r, v in held}
    assert found == back
    if dtype in ("F32", "F64"):
        assert back == {(k, r): tuple(v) for k, r, v in held}
    names = sorted(x for x in os.listdir(tmp_path) if not x.startswith("."))
    shards = [x for x in names if x.endswith(".safetensors")]
    index = json.loads((tmp_path / "net.safetensors.index.json").read_text())
    assert set(index["weight_map"]) == {k for k, _, _ in held} and set(index["weight_map"].values()) == set(shards)
    tensors.write_checkpoint(frame.where("key = 'model.k1'"), str(tmp_path), "net", dtype, files=1)
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["net.safetensors"]
    with pytest.raises(Exception, match="already"):
        tensors.write_checkpoint(frame, str(tmp_path), "net", dtype, overwrite=False)
    assert len(rows_of(tensors.read_tensors(spark, str(tmp_path)))) == 2


def test_half_floats_round_to_even():
    x = np.array([1.0, 1.00390625, 1.01171875, 3.3895314e38, float("inf"), float("-inf"), 0.0, -0.0])
    assert [hex(v) for v in np.frombuffer(tensors.to_bytes(x, "BF16"), "<u2")] == ["0x3f80", "0x3f80", "0x3f82", "0x7f7f", "0x7f80", "0xff80", "0x0", "0x8000"]
    assert np.isnan(tensors.values(tensors.to_bytes(np.array([np.nan]), "BF16"), "BF16"))


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    good = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])]
    for bad in ([("a", 2, [1.0])], [("a", 5, [1.0, 2.0])], [("b", 0, [1.0, None])], [(None, 0, [1.0])], [("a", 1, [9.0, 9.0])]):
        with pytest.raises(Exception, match="ValueError|PythonException|Error"):
            tensors.write_checkpoint(spark.createDataFrame(good + bad, "key string, row bigint, vec array<double>"), str(tmp_path), files=1)
        assert not [x for x in os.listdir(tmp_path) if not x.startswith(".")]
    spark.dataSource.register(tensors.Tensors)
    with pytest.raises(Exception, match="no \\['vec'\\]"):
        spark.range(1).selectExpr("'k' AS key", "id AS row").write.format("tensors").mode("append").save(str(tmp_path))
    split = spark.createDataFrame([("a", 0, [1.0])], "key string, row bigint, vec array<double>")
    with pytest.raises(Exception, match="in several tasks"):
        split.union(split).write.format("tensors").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    tensors.write_checkpoint(spark.createDataFrame(good, "key string, row bigint, vec array<double>").where("row > 5"), str(tmp_path), files=1)
    assert os.listdir(tmp_path) == []


def test_shapes_are_kept(spark, tmp_path):
    held = [("flat", 0, [1.0, 2.0, 3.0], [3]), ("cube", 0, [1.0, 2.0], [2, 1, 2]), ("cube", 1, [3.0, 4.0], [2, 1, 2]), ("one", 0, [7.0], [])]
    frame = spark.createDataFrame(held, "key string, row bigint, vec array<double>, shape array<bigint>")
    tensors.write_checkpoint(frame, str(tmp_path), files=1)
    assert sorted((r["key"], r["row"], r["vec"], r["shape"]) for r in tensors.read_tensors(spark, str(tmp_path)).collect()) == sorted(held)
    with pytest.raises(Exception, match="don't fill"):
        tensors.write_checkpoint(frame.withColumn("shape", F.array(F.lit(5).cast("bigint"))), str(tmp_path / "x"), files=1)


@pytest.fixture
def torch_names(monkeypatch):
    """Names that a pickle of tensors refers to, without their code."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")

    class FloatStorage:
        pass

    FloatStorage.__module__, FloatStorage.__qualname__ = "torch", "FloatStorage"

    def _rebuild_tensor_v2(*_):
        raise AssertionError

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    torch.FloatStorage, torch._utils, utils._rebuild_tensor_v2 = FloatStorage, utils, _rebuild_tensor_v2
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    return torch


def pickled(path, held, torch, wrap=None, stride=None, extra=None):
    """A zipped pickle by hand, tensors as float storages."""
    storages = {}

    class Placed:
        def __init__(self, x):
            self.x = x

        def __reduce__(self):
            number = str(len(storages))
            storages[number] = self.x.astype("<f4").tobytes()
            steps = stride or tuple(int(s // 4) for s in self.x.astype("<f4").strides)
            return torch._utils._rebuild_tensor_v2, (Storage(number, self.x.size), 0, self.x.shape, steps, False, OrderedDict())

    class Storage:
        def __init__(self, number, n):
            self.pid = ("storage", torch.FloatStorage, number, "cpu", n)

    class Pickler(pickle.Pickler):
        def persistent_id(self, obj):
            return obj.pid if isinstance(obj, Storage) else None

    state = OrderedDict((k, Placed(v) if isinstance(v, np.ndarray) else v) for k, v in held.items())
    buffer = io.BytesIO()
    Pickler(buffer, 2).dump(({wrap: state} if wrap else state) | (extra or {}))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("archive/data.pkl", buffer.getvalue())
        for number, raw in storages.items():
            archive.writestr(f"archive/data/{number}", raw)
        archive.writestr("archive/version", "3\n")


def test_pickled_checkpoints(spark, tmp_path, torch_names):
    held = {"m.lora_A.weight": np.arange(12.0).reshape(3, 4), "m.lora_B.weight": np.arange(6.0).reshape(2, 3), "bias": np.arange(3.0)}
    want = {(k, i): tuple(v) for k, x in held.items() for i, v in enumerate(x.reshape(-1, x.shape[-1]))}
    pickled(tmp_path / "pytorch_model.bin", held | {"note": "text", "n": 3}, torch_names, "state_dict")
    assert rows_of(tensors.read_tensors(spark, str(tmp_path))) == want
    pickled(tmp_path / "pytorch_model.bin", held, torch_names)
    assert rows_of(tensors.read_tensors(spark, str(tmp_path), part_bytes=10)) == want
    pickled(tmp_path / "global.pt", held, torch_names, "model", extra={"round": 3})
    assert rows_of(tensors.read_tensors(spark, f"{tmp_path}/global.pt", "model")) == want
    assert rows_of(files.load_global_file(spark, f"{tmp_path}/global.pt")) == want
    with pytest.raises(ValueError, match="no key 'model'"):
        files.load_global_file(spark, f"{tmp_path}/pytorch_model.bin").collect()
    pickled(tmp_path / "odd.pt", {"x": np.arange(4.0).reshape(2, 2)}, torch_names, stride=(1, 2))
    with pytest.raises(ValueError, match="not contiguous"):
        tensors.tensors_of(f"{tmp_path}/odd.pt")
    factors = {(r["base_key"], r["factor"], r["r"]): r["vec"] for r in tensors.factor_rows(tensors.read_tensors(spark, str(tmp_path))).collect()}
    assert factors["m.weight", "A", 1] == [4, 5, 6, 7] and factors["m.weight", "B", 2] == [2, 5] and len(factors) == 6


def test_pickles_never_run_code(tmp_path, torch_names):
    ran = tmp_path / "ran"

    class Evil:
        def __reduce__(self):
            return os.mkdir, (str(ran),)

    pickled(tmp_path / "evil.pt", {"x": Evil()}, torch_names)
    with pytest.raises(ValueError, match="not allowed"):
        tensors.tensors_of(f"{tmp_path}/evil.pt")
    assert not ran.exists()
    (tmp_path / "text.pt").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="not a tensor checkpoint"):
        tensors.tensors_of(f"{tmp_path}/text.pt")
    with zipfile.ZipFile(tmp_path / "list.pt", "w") as archive:
        archive.writestr("a/data.pkl", pickle.dumps([1]))
    with pytest.raises(ValueError, match="no dictionary"):
        tensors.tensors_of(f"{tmp_path}/list.pt")


def test_factors_of_odd_tensors(spark):
    rows = [("model.a.lora_A.w", "F32", [2], 0, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, tensors.ROW_DDL.replace("file string, ", ""))
    with pytest.raises(Exception, match="must be a matrix"):
        tensors.factor_rows(frame).collect()
    with pytest.raises(Exception, match="without a dot"):
        tensors.factor_tensors(spark.createDataFrame([("nodot", "A", 0, [1.0])], "base_key string, factor string, r int, vec array<double>")).collect()
