"""Training over many tasks, and rounds, against numpy on one machine."""

import numpy as np
import pytest

from sitemill.operators import aggregation
from sitemill.plans import rounds, trainer

D = "/root/testdata/sf0.01"
SITES = [("site-1", 2), ("site-2", 4)]


def bank_of(spark, a, b):
    rows = [("A", r, v.tolist()) for r, v in enumerate(a)] + [("B", r, v.tolist()) for r, v in enumerate(b.T)]
    return spark.createDataFrame(rows, "factor string, r int, vec array<double>")


def by_hand(rows, a, b, how):
    """Adam on one site's rows, written out: (a, b, mean loss)."""
    x = np.array([r["embedding"] for r in rows], np.float64)
    y = np.eye(len(b))[[r["label"] for r in rows]]
    m, v, lost = [np.zeros_like(a), np.zeros_like(b)], [np.zeros_like(a), np.zeros_like(b)], 0.0
    rising = int(np.ceil(how.warmup * how.steps))
    for t in range(how.steps):
        z = x @ a.T @ b.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        lost -= np.log((p * y).sum(1)).mean() / how.steps
        e = (p - y) / len(x)
        grads = [(e @ b).T @ x, e.T @ (x @ a.T)]
        norm = np.sqrt(sum((g**2).sum() for g in grads))
        grads = [g * min(1.0, how.clip / norm) for g in grads] if norm > 0 else grads
        rate = how.rate * ((t + 1) / rising if t < rising else (how.steps - t) / max(1, how.steps - rising))
        new = []
        for i, (w, g) in enumerate(zip((a, b), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g**2
            new.append(w * (1 - rate * how.decay) - rate * (m[i] / (1 - 0.9 ** (t + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (t + 1))) + how.tiny))
        a, b = new
    return a, b, lost


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").selectExpr("concat('site-', IF(vec_id % 7 = 0, 2, 1)) AS site", "embedding", "label", "vec_id").cache()
    yield rows
    rows.unpersist()


@pytest.fixture
def start():
    rng = np.random.default_rng(0)
    return rng.normal(size=(4, 64)) / 8, rng.normal(size=(10, 4)) / 10


@pytest.mark.parametrize("how", [trainer.Schedule(), trainer.Schedule(steps=9, warmup=0.3, clip=0.02, decay=0.1, rate=0.01)])
def test_sites_train_as_they_would_alone(spark, table, start, how, monkeypatch):
    monkeypatch.setattr(trainer, "BLOCK", 37)
    a, b = start
    spread = trainer.spread_rows(table, 3)
    ranks = spark.createDataFrame([*SITES, ("site-9", 1)], "site string, rank int")
    frame = trainer.train_sites(spread, bank_of(spark, a, b), ranks, how)
    got = {(r["site"], r["factor"], r["r"]): r for r in frame.collect()}
    assert len(got) == 2 * (2 + 4)
    for site, k in SITES:
        rows = table.where(f"site = '{site}'").collect()
        new_a, new_b, loss = by_hand(rows, a[:k], b[:, :k], how)
        assert np.allclose([got[site, "A", r]["vec"] for r in range(k)], new_a, atol=1e-9)
        assert np.allclose([got[site, "B", r]["vec"] for r in range(k)], new_b.T, atol=1e-9)
        assert got[site, "A", 0]["n"] == len(rows) and got[site, "A", 0]["loss"] == pytest.approx(loss)
    # groups of sites are trained one after the other, to the same end
    monkeypatch.setattr(trainer, "STATE_BYTES", 1000)
    again = {(r["site"], r["factor"], r["r"]): r["vec"] for r in trainer.train_sites(spread, bank_of(spark, a, b), ranks, how).collect()}
    assert all(np.allclose(again[k], got[k]["vec"]) for k in got) and len(again) == len(got)
    spread.unpersist()


def test_a_site_lies_in_many_tasks(table):
    from pyspark.sql import functions as F

    spread = trainer.spread_rows(table, 4)
    assert spread.withColumn("part", F.spark_partition_id()).groupBy("site").agg(F.countDistinct("part").alias("n")).where("n < 4").count() == 0
    spread.unpersist()


def test_rows_that_do_not_fit(spark, table, start):
    a, b = start
    odd = spark.createDataFrame([("site-1", None, 1), (None, [1.0] * 64, 1), ("site-1", [1.0] * 64, None), ("other", [1.0] * 64, 3)], "site string, embedding array<float>, label int")
    ranks, bank = spark.createDataFrame(SITES, "site string, rank int"), bank_of(spark, a, b)
    assert trainer.train_sites(trainer.spread_rows(odd, 2), bank, ranks).count() == 0
    for bad, match in (([("site-1", [1.0] * 64, 10)], "no class"), ([("site-1", [1.0] * 64, -1)], "no class"), ([("site-1", [1.0] * 63, 1)], "width")):
        with pytest.raises(Exception, match=match):
            trainer.train_sites(trainer.spread_rows(spark.createDataFrame(bad, "site string, embedding array<float>, label int"), 2), bank, ranks).collect()
    with pytest.raises(ValueError, match="both factors"):
        trainer.train_sites(trainer.spread_rows(odd, 2), bank.where("factor = 'A'"), ranks)
    with pytest.raises(ValueError, match="no sites"):
        trainer.train_sites(trainer.spread_rows(odd, 2), bank, ranks.limit(0))


def test_evaluation(spark, table, start):
    a, b = start
    rows = table.collect()
    z = np.array([r["embedding"] for r in rows], np.float64) @ a.T @ b.T
    label = np.array([r["label"] for r in rows])
    loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), label]).mean()
    got = trainer.evaluate(table, bank_of(spark, a, b)).first()
    assert got["eval_loss"] == pytest.approx(loss) == -got["neg_eval_loss"]
    assert got["accuracy"] == pytest.approx((z.argmax(1) == label).mean()) and got["total"] == len(rows)
    none = trainer.evaluate(table.limit(0), bank_of(spark, a, b)).first()
    assert np.isnan(none["eval_loss"]) and none["accuracy"] == 0 and none["total"] == 0


def test_rounds_against_numpy(spark, table, start):
    """Truncate, train, average, judge: three rounds of the same by hand."""
    a, b = start
    held_out = table.where("vec_id % 5 = 0").selectExpr("vec_id AS key", "embedding", "label")
    data, ranks = table.where("vec_id % 5 <> 0"), spark.createDataFrame(SITES, "site string, rank int")
    new, log = rounds.run_rounds(data, bank_of(spark, a, b), ranks, 3, 4, "naive", held_out=held_out)
    got = log.orderBy("round").collect()
    for k in range(3):
        sums, total, lost = [np.zeros_like(a), np.zeros_like(b)], 0, 0.0
        for site, rank in SITES:
            rows = data.where(f"site = '{site}'").collect()
            p, q, loss = by_hand(rows, a[:rank], b[:, :rank], trainer.Schedule())
            lost, total = lost + len(rows) * loss, total + len(rows)
            sums[0][:rank] += len(rows) * p
            sums[1][:, :rank] += len(rows) * q
        a, b = sums[0] / total, sums[1] / total
        assert got[k]["round"] == k + 1 and got[k]["loss"] == pytest.approx(lost / total)
        assert got[k]["eval_loss"] == pytest.approx(trainer.evaluate(held_out, bank_of(spark, a, b)).first()["eval_loss"])
    last = {(r["factor"], r["r"]): r["vec"] for r in new.collect()}
    assert np.allclose([last["A", r] for r in range(4)], a) and np.allclose([last["B", r] for r in range(4)], b.T)


def test_rounds_refuse_updates(spark, table, start):
    """Absent sites, and factors that only some sites send."""
    bank, ranks = bank_of(spark, *start), spark.createDataFrame(SITES, "site string, rank int")
    with pytest.raises(ValueError, match="1 of 2"):
        rounds.run_rounds(table.where("site = 'site-1'"), bank, ranks, 1, 4)
    with pytest.raises(ValueError, match="differ"):
        aggregation.require_same_keys(spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "A")], "client string, key string"))
    with pytest.raises(ValueError, match="differ"):
        rounds.run_rounds(table, bank, ranks, 1, 4, trainer=lambda *x: trainer.train_sites(*x).where("site = 'site-1' OR factor = 'A'"))
    new, log = rounds.run_rounds(table, bank, ranks, 1, 4, "reconstructed")
    assert new.count() == 8 and np.isnan(log.first()["eval_loss"])
