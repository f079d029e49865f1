"""The round loop: truncate the bank for each site, train, aggregate, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregation import AGGREGATORS, Aggregator, check_updates, client_weight, require_same_keys
from ..operators.sampling import round_subset
from ..storage import cut
from .trainer import Trainer, evaluate, spread_rows, train_sites


def run_rounds(data: DataFrame, bank: DataFrame, ranks: DataFrame, n_rounds: int, target: int, aggregator: Aggregator | str = "reconstructed", trainer: Trainer = train_sites, held_out: DataFrame | None = None, eval_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """The bank after ``n_rounds`` and ``round, loss, eval_loss,
    neg_eval_loss, accuracy`` of each. ``data`` has ``site, embedding, label``;
    every site must answer in every round, with a positive weight and the same
    keys. After a round the new bank is judged on ``eval_size`` rows of
    ``held_out`` (``key, embedding, label``), drawn anew each round; 0 means
    all, and without such rows the last columns are NaN. Rows are dealt to
    tasks once; each round is written, so lineage stays one round long."""
    combine = AGGREGATORS[aggregator] if isinstance(aggregator, str) else aggregator
    n_sites, log = ranks.count(), None
    spread = spread_rows(data)
    try:
        for k in range(n_rounds):
            trained = cut(trainer(spread, bank, ranks), "round")
            updates = trained.select(F.col("site").alias("client"), F.lit("FULL").alias("params_type"), F.create_map(F.lit("num_examples"), F.col("n").cast("double")).alias("meta"), "loss").dropDuplicates(["client"])
            check_updates(updates, n_sites)
            require_same_keys(trained.select(F.col("site").alias("client"), F.col("factor").alias("key")))
            weights = updates.select("client", client_weight(F.col("meta")).alias("w"), "loss")
            row = weights.agg((F.sum(F.col("loss") * F.col("w")) / F.sum("w")).alias("loss")).select(F.lit(k + 1).alias("round"), "loss")
            factors = trained.select(F.col("site").alias("client"), F.lit("all").alias("base_key"), "factor", "r", "vec")
            bank = cut(combine(factors, weights.drop("loss"), "base_key", target), "bank").select("factor", "r", "vec")
            if held_out is None:
                nan = F.lit(float("nan"))
                row = row.select("*", nan.alias("eval_loss"), nan.alias("neg_eval_loss"), nan.alias("accuracy"))
            else:
                row = row.crossJoin(F.broadcast(evaluate(round_subset(held_out, "key", eval_size, k + 1), bank).drop("total")))  # a row by a row
            log = row if log is None else log.union(row)
        log = None if log is None else cut(log, "rounds")
    finally:
        spread.unpersist()
    return bank, log
