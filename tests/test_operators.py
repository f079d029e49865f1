import datetime as dt
import hashlib
import json
import os
import re
import time
import zipfile
from collections import Counter
from xml.etree import ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill import storage
from sitemill.functions import scalars as S
from sitemill.functions import settings
from sitemill.operators import adapters, aggregation, collate, evaluation, features, histograms, sampling, splits
from sitemill.plans import fixtures, predict
from sitemill.sources import files, sinks
from sitemill.streaming import rounds as streams
from sitemill.vocab import LABELS, VOCABULARY

D = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "pred"),
    [(f"{LABELS[7]} or {LABELS[2]}", 2), ("(D) lymphocytes", 3), (LABELS[0].lower(), -1), ("", -1), ("xxI: colorectal adenocarcinoma epitheliumyy", 8)],
)
def test_parse_takes_the_lowest_class(spark, text, pred):
    assert one(spark, S.parse_label(F.col("t")), t=text) == pred


def test_scalars(spark):
    assert one(spark, S.alt_label(F.lit("X: a: b"))) == "(X) a: b"
    assert [one(spark, S.label_name_or(F.lit(v).cast("string"), F.lit("c"))) for v in (None, "", "n")] == ["c", "c", "n"]
    assert one(spark, S.resolve_path(F.lit(" \ta/./b/../c\n"), "/r")) == "/r/a/c"
    assert one(spark, S.resolve_path(F.lit("../../../x"), "/r/s")) == "/x"
    assert one(spark, S.resolve_path(F.lit(" /abs/x "), "/r")) == "/abs/x"
    assert one(spark, S.base_key(F.lit("m.lora_A.q.lora_A.w"))) == "m.q.lora_A.w"
    assert one(spark, S.base_key(F.lit("m.q.w"))) is None
    assert one(spark, S.strip_model_prefix(F.lit("x.model.y"))) == "x.model.y"
    assert one(spark, S.parse_ranks(F.lit("4, ,8,"))) == [4, 8]
    assert one(spark, S.bracket_groups(F.lit("[0,1],[2]"))) == ["[0,1]", "[2]"]
    assert one(spark, S.mask_tokens(F.array(F.lit(1), F.lit(5)), [5])) == [1, -100]
    assert one(spark, S.pad_tokens(F.array(F.lit(1)), F.lit(3), 0, left=True)) == [0, 0, 1]
    assert len(one(spark, S.preview(F.lit("a" * 300)))) == 243
    for path, unsafe in (("a/../b", False), ("../b", True), ("a/../../b", True), ("/etc/x", True), ("a/b", False)):
        assert one(spark, S.is_unsafe_member(F.lit(path))) is unsafe
    message = one(spark, S.chat(F.lit("A: adipose")))
    assert [m["role"] for m in message] == ["user", "assistant"] and message[0]["content"][0]["text"] is None
    assert message[0]["content"][1]["text"] == VOCABULARY.prompt


def test_hash_rank_is_the_sorted_place(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = sampling.hash_rank(rows, "id", 42, "pos", ["g"]).collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(1, len(own) + 1))
        import hashlib

        assert [r["id"] for r in own] == sorted((r["id"] for r in own), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def test_cut_tables_are_cleared(spark):
    table = storage.cut(spark.range(5), "five")
    folder = table.inputFiles()[0]
    assert table.count() == 5 and f"sitemill-{spark.sparkContext.applicationId}" in folder
    storage.clear(spark)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_samples(spark):
    rows = spark.range(20)
    assert sampling.sample(rows, "id", 0, 1).count() == sampling.sample(rows, "id", None, 1).count() == 20
    assert {r["id"] for r in sampling.sample(rows, "id", 5, 1).collect()} == {r["id"] for r in sampling.sample(rows, "id", None, 1).collect() if r["pos"] <= 5}
    assert sampling.round_subset(rows, "id", 20, 1).count() == 20 and sampling.round_subset(rows, "id", 6, 1).count() == 6
    with pytest.raises(ValueError):
        sampling.first_rows(rows, ["id"], -1)


def test_counts_are_refused():
    assert splits.check_counts(10, 3, None, 1) == [4, 3, 3] and splits.check_counts(10, 3, 2, 1) == [2, 2, 2]
    for bad in ((10, 0, None, 1), (10, 3, 0, 1), (2, 3, 1, 0), (10, 3, None, 3), (10, 3, None, -1)):
        with pytest.raises(ValueError):
            splits.check_counts(*bad)
    with pytest.raises(ValueError):
        splits.preference(F.lit(3), 9, F.lit(0), F.lit(0), 1.5)


@pytest.mark.parametrize("strategy", ["random", "heterogeneous", "sequential"])
@pytest.mark.parametrize("n", [1, 3, 11])
def test_splits(spark, strategy, n):
    rows = fixtures.records(spark, D)
    out = splits.split_records(rows, "vec_id", "label", 9, n, strategy, validation=5).collect()
    assert len({r["vec_id"] for r in out}) == len(out) <= rows.count()
    sizes = Counter(r["site"] for r in out)
    total = rows.count()
    assert sorted(sizes.values(), reverse=True) == [total // n + (i < total % n) for i in range(n)]
    assert Counter(r["site"] for r in out if r["split"] == "validation") == dict.fromkeys(sizes, 5)
    if strategy != "random" and n == 3:
        own = {s: set(ls) for s, ls in splits.dominant_labels(3, LABELS)}
        assert all(sum(LABELS[r["label"]] in own[s] for r in out if r["site"] == s) > 0.7 * sizes[s] for s in sizes)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        splits.split_records(spark.range(3), "id", "id", 9, 1, "other")


def test_histogram_has_zeros_and_chart(spark):
    split = spark.createDataFrame([("site-1", 0), ("site-1", 0), ("site-10", 2)], "site string, label int")
    names = spark.createDataFrame([("site-1",), ("site-10",), ("site-2",)], "site string")
    table = histograms.label_histogram(split, "label", VOCABULARY.table(spark), names)
    assert table.count() == 27 and table.agg(F.sum("cnt")).first()[0] == 3
    rows = histograms.chart_rows(table)
    assert rows.agg(F.max("bar")).first()[0] == 470.0
    svg = sinks.chart_svg(rows, LABELS, {"site-1": ["A & B"]})
    assert svg.index("site-1 (") < svg.index("site-10") < svg.index("site-2") and "A &amp; B" in svg
    page = ET.fromstring(svg)
    ns = "{http://www.w3.org/2000/svg}"
    texts = [t.text for t in page.iter(f"{ns}text")]
    assert page.find(f"{ns}title").text == texts[0] and page.find(f"{ns}desc").text and page.get("viewBox").endswith(page.get("height"))
    assert len(texts) == 1 + 3 * (1 + 2 * 9) and len(list(page.iter(f"{ns}rect"))) == 3 * (1 + 2 * 9)
    bars = sorted({float(r.get("width")) for r in page.iter(f"{ns}rect") if r.get("height") == "16"})
    assert bars == [0, 235, 470]
    assert histograms.chart_rows(table.withColumn("cnt", F.lit(0))).agg(F.max("bar")).first()[0] == 0


def test_adapter_checks(spark):
    assert adapters.missing_pairs(fixtures.factors(spark, D, guarded=False), ["client", "layer"]).count() > 0
    with pytest.raises(ValueError):
        adapters.require_pairs(fixtures.factors(spark, D, guarded=False), ["client", "layer"])
    adapters.require_pairs(fixtures.factors(spark, D), ["client", "layer"])
    assert adapters.uniform_rank(fixtures.factors(spark, D).where("client = 1"), ["layer"]) == 8
    with pytest.raises(ValueError):
        adapters.uniform_rank(fixtures.factors(spark, D), ["client", "layer"])
    with pytest.raises(ValueError):
        adapters.uniform_rank(fixtures.factors(spark, D).limit(0), ["layer"])
    with pytest.raises(ValueError):
        adapters.require_positive_ranks(spark.createDataFrame([("a", 0)], "base_key string, rank int"))
    assert fixtures.factors(spark, D).limit(0).agg(adapters.size_mb().alias("x")).first()["x"] == 0


@pytest.mark.parametrize(("n", "g", "ranks"), [(3, 16, [4, 8, 16]), (2, 5, [2, 5]), (4, 4, [1, 2, 3, 4]), (5, 16, [1, 2, 4, 8, 16])])
def test_default_ranks(spark, n, g, ranks):
    assert adapters.site_ranks(n, g) == ranks
    grid = spark.createDataFrame([(n, g)], "n int, g int")
    assert [r["rank"] for r in adapters.default_ranks(grid).orderBy("client").collect()] == ranks


def test_site_ranks_are_checked():
    assert adapters.site_ranks(2, 8, [1, 8]) == [1, 8]
    for bad in ((5, 4, None), (2, 8, [1]), (2, 8, [0, 8]), (2, 8, [1, 9])):
        with pytest.raises(ValueError):
            adapters.site_ranks(*bad)


def updates(spark, rows):
    return spark.createDataFrame(rows, "round int, client string, params_type string, metrics map<string,double>, meta map<string,double>")


def test_weights_and_metrics(spark):
    u = updates(spark, [(1, "a", "FULL", {"loss": 1.0}, {"num_examples": 3.0}), (1, "b", "FULL", {"loss": 5.0, "x": 2.0}, {"num_examples": None, "num_steps": 7.0}), (1, "c", "FULL", {}, {"num_steps": 2.0}), (1, "d", "FULL", {}, None)])
    assert [r["w"] for r in u.select(aggregation.client_weight(F.col("meta")).alias("w")).collect()] == [3, 1, 2, 1]
    means = {r["metric"]: r["value"] for r in aggregation.metric_mean(u).collect()}
    assert means == {"loss": (3 * 1 + 5) / 4, "x": 2}
    silent = u.union(updates(spark, [(1, "e", "FULL", None, {})]))
    assert aggregation.metric_mean(silent).count() == 0
    aggregation.check_updates(u, 4)
    for bad in ([(1, "a", "DIFF", {}, {})], [(1, "a", "FULL", {}, {"num_examples": 0.0})], [(1, "a", "FULL", {}, {"num_examples": -1.0})], []):
        with pytest.raises(ValueError):
            aggregation.check_updates(updates(spark, bad))
    with pytest.raises(ValueError):
        aggregation.check_updates(u, 5)


def bank_of(spark, seed, ranks, m=6, n=5):
    rng = np.random.default_rng(seed)
    mats = {c: (rng.normal(size=(m, r)), rng.normal(size=(r, n))) for c, r in enumerate(ranks)}
    rows = [(c, "k", f, i, v.tolist()) for c, (b, a) in mats.items() for f, x in (("B", b.T), ("A", a)) for i, v in enumerate(x)]
    weights = spark.createDataFrame([(c, float(c + 1)) for c in mats], "client int, w double")
    return mats, spark.createDataFrame(rows, "client int, base_key string, factor string, r int, vec array<double>"), weights


def matrices(rows, target):
    got = {f: np.stack([r["vec"] for r in sorted((r for r in rows if r["factor"] == f), key=lambda r: r["r"])]) for f in ("A", "B")}
    assert got["A"].shape[0] == got["B"].shape[0] == target
    return got["B"].T, got["A"]


def test_means_against_numpy(spark):
    mats, factors, weights = bank_of(spark, 1, (1, 2, 4))
    mean = sum((c + 1) / 6 * b @ a for c, (b, a) in mats.items())
    cells = aggregation.update_mean(factors, weights, ["base_key"]).collect()
    dense = np.zeros((6, 5))
    for r in cells:
        dense[r["i"], r["j"]] = r["value"]
    assert np.allclose(dense, mean)
    b, a = matrices(aggregation.naive(factors, weights, "base_key", 3).collect(), 3)
    want = np.zeros((6, 3))
    for c, (x, _) in mats.items():
        want[:, : min(3, x.shape[1])] += (c + 1) / 6 * x[:, :3]
    assert np.allclose(b, want)


def test_mean_updates_in_tiles(spark):
    """As one product, whatever the tiles and sums a tile; no map of cells."""
    mats, factors, weights = bank_of(spark, 7, (3,) * 5)
    mean = sum((c + 1) / 15 * b @ a for c, (b, a) in mats.items())
    for edge, most in ((None, None), (4, None), (4, 2), (3, 1)):
        found = aggregation.update_mean(factors, weights, ["base_key"], edge, most)
        assert not re.search(r"Aggregate\(keys?=\[[^\]]*\bj#", found._jdf.queryExecution().executedPlan().toString())
        cells = {(r["i"], r["j"]): r["value"] for r in found.collect()}
        assert len(cells) == 30 and np.allclose([cells[i, j] for i in range(6) for j in range(5)], mean.reshape(-1))


@pytest.mark.parametrize("edge, most", [(None, None), (2, None), (2, 1)])
def test_mean_updates_of_odd_vectors(spark, edge, most):
    """A null counts for nothing, vectors may be shorter than others, and what
    is no number stays none."""
    nan = float("nan")
    rows = [(0, "A", 0, [1.0, None, 2.0]), (0, "B", 0, [3.0, 4.0]), (1, "A", 0, [5.0]), (1, "B", 0, [6.0, None, 7.0]), (0, "A", 1, []), (0, "B", 1, [1.0] * 5), (0, "A", 2, [float("inf"), 1.0]), (0, "B", 2, [nan, None, None, 2.0]), (1, "A", 3, [9.0] * 9), (2, "A", 0, [1.0]), (2, "B", 0, [1.0]), (0, "A", 4, None), (0, "B", 4, [1.0] * 7)]
    factors = spark.createDataFrame([("k", *r) for r in rows], "base_key string, client int, factor string, r int, vec array<double>")
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "client int, w double")
    got = {(r["i"], r["j"]): r["value"] for r in aggregation.update_mean(factors, weights, ["base_key"], edge, most).collect()}
    want = {}
    pairs = [(1.0, [3.0, 4.0], [1.0, None, 2.0]), (3.0, [6.0, None, 7.0], [5.0]), (1.0, [nan, None, None, 2.0], [float("inf"), 1.0])]
    for w, b, a in pairs:
        for i, x in enumerate(b):
            for j, y in enumerate(a):
                had = want.setdefault((i, j), None)
                want[i, j] = had if x is None or y is None else (had or 0.0) + w * x * y
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or np.isclose(got[k], v / 4, equal_nan=True)) for k, v in want.items())
    assert aggregation.update_mean(factors.limit(0), weights, ["base_key"], edge, most).count() == 0


@pytest.mark.parametrize("target", [2, 5, 9])
def test_reconstruction(spark, target):
    mats, factors, weights = bank_of(spark, 2, (1, 2, 4))
    mean = sum((c + 1) / 6 * b @ a for c, (b, a) in mats.items())
    b, a = matrices(aggregation.reconstruct(factors, weights, "base_key", target).collect(), target)
    s = np.linalg.svd(mean, compute_uv=False)
    k = min(target, 5)
    assert np.allclose(b[:, :k].T @ b[:, :k], np.eye(k)) and not a[k:].any()
    assert np.linalg.norm(b @ a - mean) == pytest.approx(np.sqrt((s[target:] ** 2).sum()), abs=1e-9)
    assert (np.diff(np.linalg.norm(a, axis=1)) <= 1e-9).all()


def test_many_clients_are_merged_in_groups(spark):
    """No task takes all clients, and the product stays what it is."""
    mats, factors, weights = bank_of(spark, 6, (3,) * 40)
    total = sum(c + 1 for c in mats)
    mean = sum((c + 1) / total * b @ a for c, (b, a) in mats.items())
    for target in (2, 5):
        whole = matrices(aggregation.reconstruct(factors, weights, "base_key", target).collect(), target)
        parts = matrices(aggregation.reconstruct(factors, weights, "base_key", target, most=12).collect(), target)
        assert np.allclose(whole[0] @ whole[1], parts[0] @ parts[1])
    assert np.allclose(parts[0] @ parts[1], mean)
    b, a = aggregation.merged(np.ones((4, 9)), np.ones((9, 3)))
    assert b.shape == (4, 3) and np.allclose(b @ a, 9)


def test_reconstruction_of_zeros():
    b, a = aggregation.truncated(np.zeros((4, 2)), np.zeros((2, 3)), 5)
    assert b.shape == (4, 5) and not (b @ a).any()
    b, a = aggregation.truncated(np.zeros((4, 0)), np.zeros((0, 3)), 2)
    assert not b.any() and not a.any()


def test_unpaired_factors_are_refused(spark):
    _, factors, weights = bank_of(spark, 3, (2, 2))
    with pytest.raises(Exception, match="partner"):
        aggregation.reconstruct(factors.where("NOT (client = 1 AND factor = 'A' AND r = 1)"), weights, "base_key", 2).collect()


def test_key_mismatches(spark):
    keys = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")], "client string, key string")
    assert {tuple(r) for r in aggregation.key_mismatches(keys, "a").collect()} == {("b", "z", "extra"), ("b", "y", "missing")}


def test_evaluation(spark):
    p = spark.createDataFrame([(0, 0, 0), (0, 1, -1), (1, 2, 2)], "model int, label int, pred int")
    got = {r["model"]: tuple(r)[1:] for r in evaluation.accuracy(p, ["model"]).collect()}
    assert got == {0: (0.5, 1, 2, 1), 1: (1.0, 1, 1, 0)}
    delta = evaluation.accuracy_delta(evaluation.accuracy(p, ["model"]), 0, 1).first()
    assert delta["delta"] == 0.5
    assert evaluation.accuracy_delta(evaluation.accuracy(p.where("model = 1"), ["model"]), 0, 1).count() == 0
    assert evaluation.accuracy(p.limit(0), []).first()["accuracy"] == 0
    with pytest.raises(ValueError):
        evaluation.batch_of(F.col("label"), 0)
    scored = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert evaluation.roc_auc(scored, "score", "label").first()["value"] == pytest.approx(0.625)
    assert evaluation.pr_auc(scored, "score", "label").first()["value"] == pytest.approx((1 * 1 / 2 + 1 * 2 / 3) / 2)
    assert evaluation.roc_auc(scored.where("label = 1"), "score", "label").first()["value"] is None
    assert one(spark, evaluation.peak_delta(F.lit(1.0), F.lit(3.0))) == 0


def test_features(spark):
    long = spark.createDataFrame([(1, "a", 1.0, True), (2, "a", None, False), (3, "a", 3.0, True), (1, "b", None, True), (3, "b", 1.0, True)], "row int, f string, v double, train boolean")
    assert {tuple(r) for r in features.mask_drop_impute(long, "row", "f", "v", "train").collect()} == {(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)}
    assert features.top_fraction(spark.range(1001), "id", "id", 0.001).count() == 2
    tiles = spark.createDataFrame([(1, s, x, 0.0) for s, x in ((9.0, 0.0), (8.0, 1.0), (7.0, 50.0), (6.0, 2.0))], "slide int, score double, x double, y double")
    assert [r["score"] for r in features.spaced(tiles, "slide", "score", "x", "y", 10.0, 3).orderBy("chosen").collect()] == [9, 7, 8]


def test_labelled_files(spark, tmp_path):
    for name in ("adi/1.JPG", "deep/er/Tum/2.png", "tum/3.txt", "other/4.png", "lym/5", "lym/.6.png"):
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = files.scan_labelled(spark, str(tmp_path / "set"), VOCABULARY.table(spark))
    assert {tuple(r) for r in got.collect()} == {("adi/1.JPG", 0, LABELS[0], "ADI"), ("deep/er/Tum/2.png", 8, LABELS[8], "TUM")}
    (tmp_path / "set" / "adi" / "1.JPG").unlink()
    (tmp_path / "set" / "deep" / "er" / "Tum" / "2.png").unlink()
    with pytest.raises(ValueError):
        files.scan_labelled(spark, str(tmp_path / "set"), VOCABULARY.table(spark))


def test_json_and_sinks(spark, tmp_path):
    rows = [("a/1", 0, LABELS[0], "ADI", "site-1", "train"), ("a/2", 1, LABELS[1], "BACK", "site-1", "train"), ("a/3", 1, LABELS[1], "BACK", "site-2", "validation")]
    split = spark.createDataFrame(rows, "image string, label int, label_name string, raw_label string, site string, split string")
    (tmp_path / "one.json").write_text(sinks.site_json(split, "site-1", "train"))
    assert {r["image"] for r in files.read_records(spark, str(tmp_path / "one.json")).collect()} == {"a/1", "a/2"}
    (tmp_path / "two.json").write_text(json.dumps({"image": "b", "label": 3}))
    assert files.read_records(spark, str(tmp_path / "two.json")).first()["label"] == 3
    with pytest.raises(ValueError):
        sinks.site_json(split, "site-1", "train", most=1)
    sinks.write_sites(split, str(tmp_path / "sites"))
    assert spark.read.json(str(tmp_path / "sites")).where("site = 'site-2'").count() == 1
    with pytest.raises(ValueError):
        files.existing(split, split, "/r", -1)


def test_checkpoints(spark, tmp_path):
    schema = "base_key string, factor string, r int, vec array<double>"
    for name, value in (("a", 1.0), ("b", 2.0)):
        spark.createDataFrame([("k", "A", 0, [value]), (name, "A", 0, [value])], schema).coalesce(1).write.parquet(str(tmp_path / "parts" / name))
    got = {r["base_key"]: r["vec"][0] for r in files.load_checkpoint(spark, str(tmp_path / "parts")).collect()}
    assert got == {"k": 2.0, "a": 1.0, "b": 2.0}
    sinks.write_adapter(files.load_checkpoint(spark, str(tmp_path / "parts")), str(tmp_path / "one" / "adapter.parquet"))
    assert {r["base_key"] for r in files.load_checkpoint(spark, str(tmp_path / "one")).collect()} == {"model.k", "model.a", "model.b"}
    assert files.load_global(spark, str(tmp_path / "parts" / "a")).count() == 2
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        files.load_global(spark, str(tmp_path / "bad"))
    (tmp_path / "adapter_config.json").write_text("{}")
    assert [files.model_source(p) for p in ("x.pt", str(tmp_path), "name/of-model")] == ["table", "adapter", "id"]


def test_archives(tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a/b.txt", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../b.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"PK")
    assert files.is_valid_zip(str(good)) and not files.is_valid_zip(str(tmp_path / "broken.zip")) and not files.is_valid_zip(str(tmp_path / "none.zip"))
    files.extract(str(good), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.txt").read_text() == "x"
    with pytest.raises(ValueError):
        files.extract(str(bad), str(tmp_path / "out"))


def test_prediction_in_batches(spark):
    records = spark.range(10).select(F.col("id"), (F.col("id") % 9).cast("int").alias("label"))

    def factory():
        def model(items):
            assert 1 <= len(items) <= 3
            return [LABELS[i % 9] for i in items]

        return model

    got = evaluation.accuracy(predict.evaluate(records, {"a": factory, "b": factory}, "id", 3), ["model"]).collect()
    assert {(r["model"], r["accuracy"], r["total"]) for r in got} == {("a", 1.0, 10), ("b", 1.0, 10)}
    with pytest.raises(ValueError):
        predict.generate(records, factory, "id", 0)
    with pytest.raises(ValueError):
        predict.evaluate(records, {}, "id")


def test_same_clients_are_the_identity(spark):
    mats, factors, weights = bank_of(spark, 5, (3,))
    twice = factors.union(factors.withColumn("client", F.lit(1)))
    both = spark.createDataFrame([(0, 1.0), (1, 5.0)], "client int, w double")
    b, a = matrices(aggregation.reconstruct(twice, both, "base_key", 3).collect(), 3)
    assert np.allclose(b @ a, mats[0][0] @ mats[0][1])


def test_round_barrier(spark, tmp_path):
    """Complete rounds are given once; state goes with the watermark."""
    schema = "round long, client string, weight double, ts timestamp"
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 1.0, 0), (1, "b", 2.0, 0), (1, "a", 9.0, 0), (2, "a", 1.0, 1), (3, "b", 1.0, 1), (3, "a", 4.0, 1), (3, "c", 7.0, 1), (4, "a", 1.0, 40), (4, "b", 1.0, 40), (2, "b", 5.0, 1), (5, "a", 1.0, 41), (5, "b", 1.0, 41)]
    for k in range(0, len(rows), 3):
        spark.createDataFrame([(*r[:3], day + dt.timedelta(days=r[3])) for r in rows[k : k + 3]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["round"]: (r["clients"], r["weight"]) for r in streams.run_available(streams.complete_rounds(stream, 2), "barrier").collect()}
    assert set(got) - {2} == {1, 3, 4, 5} and got[1] == (2, 3.0)


def test_windows_of_a_stream_in_several_batches(spark, tmp_path):
    schema = "event_type string, value double, ts timestamp"
    day = dt.datetime(2024, 1, 1)
    for k in range(3):
        spark.createDataFrame([("x", float(k + i), day + dt.timedelta(minutes=20 * i)) for i in range(6)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in streams.run_available(streams.windowed_metrics(stream, late="1 day"), "windows", ["start", "event_type"]).collect())
    assert got == sorted(tuple(r) for r in streams.windowed_metrics(spark.read.parquet(str(tmp_path / "in"))).collect())


@pytest.mark.parametrize("strategy", ["random", "heterogeneous", "sequential"])
@pytest.mark.parametrize("bad", [{"n": 0}, {"n": -1}, {"n": 3, "validation": -1}, {"n": 3, "validation": 10}, {"n": 40}, {"n": 40, "samples_per_client": 2}])
def test_every_split_refuses_bad_counts(spark, strategy, bad):
    rows = spark.range(30).select("id", (F.col("id") % 9).cast("int").alias("label"))
    with pytest.raises(Exception, match="client|validation"):
        splits.split_records(rows, "id", "label", 9, strategy=strategy, **{"validation": 0, **bad}).collect()


@pytest.mark.parametrize("strategy", ["random", "heterogeneous", "sequential"])
def test_samples_per_client(spark, strategy):
    rows = spark.range(60).select("id", (F.col("id") % 9).cast("int").alias("label"))
    for asked, each in ((0, 20), (-3, 20), (None, 20), (7, 7), (50, 20)):
        got = Counter(r["site"] for r in splits.split_records(rows, "id", "label", 9, 3, strategy, asked, validation=2).collect())
        assert set(got.values()) == {each} and len(got) == 3


@pytest.mark.parametrize("block", [7, 50, 1 << 20])
def test_sequential_split_by_hand(spark, block):
    """The same fold, record by record, over records in hash order; blocks change nothing."""
    n, validation, fraction = 4, 3, 0.7
    rows = [(i, i * 7 % 9) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, label int").repartition(3)
    got = {r["id"]: (r["site"], r["split"]) for r in splits.split_sequential(frame, "id", "label", 9, n, validation, fraction, per_client=20, block=block).collect()}
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    own, room, placed = [{0, 1, 2}, {3, 4}, {5, 6}, {7, 8}], [20] * n, []
    for key, label in order:
        chances = [room[i] * (fraction / len(own[i]) if label in own[i] else (1 - fraction) / (9 - len(own[i]))) for i in range(n)]
        if any(room):
            goal = int(hashlib.md5(f"43:{key}".encode()).hexdigest()[:13], 16) / 2**52 * sum(chances)
            site = next(i for i in range(n) if room[i] and sum(chances[: i + 1]) >= goal)
            room[site] -= 1
            placed.append((key, site))
    assert {k: f"site-{s + 1}" for k, s in placed} == {k: s for k, (s, _) in got.items()} and len(got) == 80
    assert Counter(got.values()) == {(f"site-{i + 1}", part): k for i in range(n) for part, k in (("validation", 3), ("train", 17))}


def test_sequential_split_refuses_labels(spark):
    for bad in (9, -1, None):
        with pytest.raises(Exception, match="no class"):
            splits.split_sequential(spark.createDataFrame([(i, bad) for i in range(9)], "id long, label int"), "id", "label", 9, 3, 0)


def test_devices_and_paths():
    assert [settings.device_map(x) for x in ("cpu", "cuda", "cuda:3", "mps")] == [None, {"": 0}, {"": 3}, None]
    for bad in ("cuda:x", "cudax", "cuda:"):
        with pytest.raises(ValueError):
            settings.device_map(bad)
    assert settings.absolute("/a/../b") == "/b" and settings.absolute("~").startswith("/")


def test_collate(spark):
    rows = spark.createDataFrame([(0, [1, 2, 9]), (0, [3]), (1, [])], "b int, ids array<int>")
    got = {tuple(r["ids"]): (r["input_ids"], r["attention_mask"], r["labels"]) for r in collate.collate(rows, "b", "ids", 0, [9], left=True).collect()}
    assert got == {(1, 2, 9): ([1, 2, 9], [1, 1, 1], [1, 2, -100]), (3,): ([0, 0, 3], [0, 0, 1], [-100, -100, 3]), (): ([], [], [])}
    with pytest.raises(Exception, match="filler"):
        collate.collate(rows, "b", "ids", None, []).collect()
    assert collate.collate(rows.where("b = 1"), "b", "ids", None, []).first()["labels"] == []


def test_one_input_is_a_batch_of_one(spark):
    factory = lambda: lambda items: [f"It is {LABELS[i]}" if i >= 0 else "no" for i in items]
    assert predict.respond(factory, 3) == f"It is {LABELS[3]}"
    assert predict.label_of_one(factory, 3)[1:] == (3, LABELS[3]) and predict.label_of_one(factory, -1) == ("no", -1, "<unparsed>")


def test_applied_states_replace_rows(spark):
    bank = spark.createDataFrame([("l", "A", 0, 1), ("l", "A", 1, 2), ("h", None, 0, 3)], "base_key string, factor string, r int, v int")
    state = spark.createDataFrame([("l", "A", 1, 9), ("h", None, 0, 8)], "base_key string, factor string, r int, v int")
    assert sorted(r["v"] for r in adapters.apply_state(bank, state).collect()) == [1, 8, 9]


def test_server_state(spark):
    bank = spark.createDataFrame([("l.0", "A", 0), ("l.0", "B", 0), ("head", None, 0)], "base_key string, factor string, r int")
    state = adapters.server_state(bank)
    assert {r["base_key"] for r in state.collect()} == {"model.l.0", "model.head"}
    own, unused = adapters.load_server_state(state)
    assert {r["base_key"] for r in own.collect()} == {"l.0"} and unused == []
    bare = state.where("factor IS NULL")
    with pytest.raises(ValueError):
        adapters.load_server_state(bare)
    assert adapters.load_server_state(bare, strict=False)[1] == ["model.head"]


def test_walks_meet_files_in_order(spark, tmp_path):
    for name in ("b.png", "sub-x/c.png", "sub/z.png", "sub/deep/a.png", "a.png", "sub/B.png"):
        path = tmp_path / "ADI" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select(F.regexp_extract("path", "(/ADI/.*)", 1).alias("path"))
    got = [r["path"] for r in paths.orderBy(*files.traversal(F.col("path"))).collect()]
    want = []
    for top, folders, names in os.walk(tmp_path):
        folders.sort()
        want += [os.path.join(top, n)[len(str(tmp_path)) :] for n in sorted(names)]
    assert got == want


def test_arrays_of_records(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{i}.png", i % 9, "x", "ADI") for i in range(500)], "image string, label int, label_name string, raw_label string")
    sinks.write_arrays(rows, str(tmp_path / "out"), F.col("raw_label"), most=50)
    names = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part") and p.stat().st_size]
    assert all(isinstance(json.loads(p.read_text()), list) and len(json.loads(p.read_text())) <= 50 for p in names) and len(names) >= 10
    assert Counter(map(tuple, files.read_records(spark, str(tmp_path / "out")).collect())) == Counter(map(tuple, rows.collect()))
    (tmp_path / "one.json").write_text(json.dumps({"image": "x.png", "label": 1}))
    assert files.read_records(spark, str(tmp_path / "one.json")).first()["image"] == "x.png"


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(type("Session", (), {"conf": Conf(), "sparkContext": Context}))


def test_discarded_tables_are_gone(spark):
    one, two = storage.cut(spark.range(3), "one"), storage.cut(spark.range(4), "two")
    storage.discard(one)
    assert not os.path.exists(one.cut_path.removeprefix("file://")) and two.count() == 4
