"""Training of low-rank adapters on all sites at once, in a barrier stage.

A site's model gives each record a chance for every class, softmax(B A x), with
A of its rank by the width of x and B of classes by rank. Rows are dealt to the
tasks of one barrier stage whatever their site, so a site of any size is
trained by all of them: each task goes over its own rows, which it keeps in a
scratch file of its own and reads a block at a time, adds up gradients for every
site, and ``allGather`` hands the sums round. All tasks then make the same step,
and the first one gives the result. What is handed round is one gradient a site,
never rows; sites go in groups whose adapters take ``STATE_BYTES`` at most.

The steps are Adam's with decoupled decay, gradients cut to a norm, a rate that
rises over the first part of the steps and then falls to zero in a line. A
step takes all rows of a site. A barrier stage is run again as a whole when one
of its executors is lost.

Rows without a site, vector or label are left out; sites without a rank too.
Labels that are no class and vectors of another width than A are refused.
"""

from __future__ import annotations

import base64
import math
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Bytes of adapters that are trained together, and rows of a block.
STATE_BYTES, BLOCK = 4 << 20, 1 << 14


@dataclass(frozen=True)
class Schedule:
    """Steps of a round, and how they are made."""

    steps: int = 5
    rate: float = 0.05
    warmup: float = 0.03
    clip: float = 0.3
    decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    tiny: float = 1e-8

    def rate_of(self, step: int) -> float:
        """The rate of a step, from 0."""
        rising = math.ceil(self.warmup * self.steps)
        if step < rising:
            return self.rate * (step + 1) / rising
        return self.rate * (self.steps - step) / max(1, self.steps - rising)


class Adapter:
    """A site's factors, with the moments of their gradients."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a.copy(), b.copy()
        self.first, self.second = np.zeros(self.size), np.zeros(self.size)

    @property
    def size(self) -> int:
        return self.a.size + self.b.size

    def gradient(self, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of losses of some rows, and that of their gradients."""
        hidden = x @ self.a.T
        logits = hidden @ self.b.T
        logits -= logits.max(1, keepdims=True)
        chance = np.exp(logits)
        total = chance.sum(1)
        loss = float((np.log(total) - logits[np.arange(len(x)), label]).sum())
        chance /= total[:, None]
        chance[np.arange(len(x)), label] -= 1
        return loss, np.concatenate([((chance @ self.b).T @ x).reshape(-1), (chance.T @ hidden).reshape(-1)])

    def step(self, gradient: np.ndarray, number: int, how: Schedule) -> None:
        norm = float(np.sqrt((gradient * gradient).sum()))
        if how.clip and norm > how.clip:
            gradient = gradient * (how.clip / norm)
        for moment, beta, x in ((self.first, how.betas[0], gradient), (self.second, how.betas[1], gradient * gradient)):
            moment *= beta
            moment += (1 - beta) * x
        mean, spread = (m / (1 - beta ** (number + 1)) for m, beta in zip((self.first, self.second), how.betas, strict=True))
        rate = how.rate_of(number)
        change = rate * mean / (np.sqrt(spread) + how.tiny)
        for own, part in ((self.a, change[: self.a.size]), (self.b, change[self.a.size :])):
            own *= 1 - rate * how.decay
            own -= part.reshape(own.shape)


class _Rows:
    """A task's rows in a scratch file, which goes when the task ends."""

    def __init__(self, width: int):
        self.kind = np.dtype([("site", "<i4"), ("label", "<i4"), ("x", "<f4", (width,))])
        self.file = tempfile.TemporaryFile()  # noqa: SIM115

    def add(self, site: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        rows = np.empty(len(site), self.kind)
        rows["site"], rows["label"], rows["x"] = site, label, x
        rows.tofile(self.file)

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Site, vectors and labels, a site of a block at a time."""
        self.file.seek(0)
        while len(rows := np.frombuffer(self.file.read(BLOCK * self.kind.itemsize), self.kind)):
            rows = rows[np.argsort(rows["site"], kind="stable")]
            for part in np.split(rows, np.flatnonzero(np.diff(rows["site"])) + 1):
                yield int(part["site"][0]), part["x"].astype(np.float64), part["label"]


def spread_rows(data: DataFrame, tasks: int | None = None) -> DataFrame:
    """``site, embedding, label`` dealt evenly to as many partitions as tasks
    can run at once, and kept on the executors' disks for all rounds; what a
    lost one held is dealt again. Unpersist it when done."""
    n = tasks or data.sparkSession.sparkContext.defaultParallelism
    return data.where("site IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL").select("site", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label")).repartition(n).persist(StorageLevel.DISK_ONLY)


def sides(bank: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A and B of a bank's ``factor, r, vec`` on the driver: as large as one adapter."""
    held: dict[str, list] = {"A": [], "B": []}
    for row in bank.select("factor", "r", "vec").orderBy("r").collect():
        held[row["factor"]].append(row["vec"])
    if not held["A"] or len(held["A"]) != len(held["B"]):
        raise ValueError("a bank needs both factors of one rank")
    return np.array(held["A"]), np.array(held["B"]).T


def train_sites(spread: DataFrame, bank: DataFrame, ranks: DataFrame, how: Schedule | None = None) -> DataFrame:
    """``site, factor, r, vec, loss, n``: each site's factors after training
    from the bank's first components on its own rows; ``loss`` is the mean of
    its steps' mean losses. A site without rows gives none."""
    how = how or Schedule()
    a, b = sides(bank)
    width, classes = a.shape[1], b.shape[0]
    sites = [(r["site"], min(r["rank"], len(a))) for r in ranks.select("site", "rank").orderBy("site").collect()]  # a row a site
    groups: list[list[tuple[str, int]]] = [[]]
    for site in sites:
        if groups[-1] and sum(k for _, k in [*groups[-1], site]) * (width + classes) * 8 > STATE_BYTES:
            groups.append([])
        groups[-1].append(site)

    def of_group(group: list[tuple[str, int]]) -> DataFrame:
        numbers = spread.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(group)], "site string, number int")
        rows = spread.join(F.broadcast(numbers), "site").select("number", "label", "embedding")  # a row a site of the group

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, held = BarrierTaskContext.get(), _Rows(width)
            for batch in batches:
                label, vecs = batch.column(1).to_numpy(), batch.column(2)
                if len(label) and (label.min() < 0 or label.max() >= classes):
                    raise ValueError("a label that is no class")
                if (vecs.value_lengths().to_numpy() != width).any():
                    raise ValueError(f"a vector whose width isn't {width}")
                held.add(batch.column(0).to_numpy(), label, vecs.flatten().to_numpy().reshape(-1, width))
            own = [Adapter(a[:k], b[:, :k]) for _, k in group]
            ends = np.cumsum([0, *(x.size for x in own)])
            counts, lost = np.zeros(len(group)), np.zeros(len(group))
            for number in range(how.steps):
                sums = np.zeros(ends[-1] + 2 * len(group))
                for site, x, label in held.blocks():
                    loss, gradient = own[site].gradient(x, label)
                    sums[ends[site] : ends[site + 1]] += gradient
                    sums[ends[-1] + 2 * site : ends[-1] + 2 * site + 2] += loss, len(x)
                told = context.allGather(base64.b64encode(sums.tobytes()).decode())
                total = np.sum([np.frombuffer(base64.b64decode(x)) for x in told], axis=0)
                loss, counts = total[ends[-1] :].reshape(-1, 2).T
                lost += loss / np.maximum(counts, 1) / how.steps
                for i in np.flatnonzero(counts):
                    own[i].step(total[ends[i] : ends[i + 1]] / counts[i], number, how)
            if context.partitionId() == 0:
                out = [(group[i][0], f, r, v.tolist(), lost[i], int(counts[i])) for i in np.flatnonzero(counts) for f, m in (("A", own[i].a), ("B", own[i].b.T)) for r, v in enumerate(m)]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["site", "factor", "r", "vec", "loss", "n"])

        return rows.mapInArrow(run, "site string, factor string, r int, vec array<double>, loss double, n long", barrier=True)

    if not sites:
        raise ValueError("there are no sites")
    # several groups are written in turn: two barriers in one stage would ask for the tasks of both at once
    out = [of_group(g) if len(groups) == 1 else cut(of_group(g), "trained") for g in groups]
    joined = out[0]
    for x in out[1:]:
        joined = joined.union(x)
    return joined


def evaluate(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """``eval_loss, neg_eval_loss, accuracy, total`` of a bank on ``embedding,
    label``; the loss of no rows is NaN, their accuracy 0."""
    a, b = sides(bank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label = batch.column(0).flatten().to_numpy().reshape(-1, a.shape[1]).astype(np.float64), batch.column(1).to_numpy()
            logits = x @ a.T @ b.T
            logits -= logits.max(1, keepdims=True)
            loss = np.log(np.exp(logits).sum(1)) - logits[np.arange(len(x)), label]
            yield pa.RecordBatch.from_arrays([pa.array([float(loss.sum())]), pa.array([int((logits.argmax(1) == label).sum())]), pa.array([len(x)])], ["loss", "correct", "n"])

    held = rows.where("embedding IS NOT NULL AND label IS NOT NULL").select("embedding", F.col("label").cast("int").alias("label"))
    summed = held.mapInArrow(run, "loss double, correct long, n long").agg(F.sum("loss").alias("loss"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    mean = F.when(F.col("total") > 0, F.col("loss") / F.col("total")).otherwise(F.lit(float("nan")))
    return summed.select(mean.alias("eval_loss"), (-mean).alias("neg_eval_loss"), F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"), "total")


#: (spread rows, bank, ranks) -> site, factor, r, vec, loss, n
Trainer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
