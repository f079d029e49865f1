"""Adapter tables: a row a rank component, ``base_key, factor, r, vec``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalars import add_model_prefix, strip_model_prefix


def overlay(parts: DataFrame, keys: list[str], file_col: str) -> DataFrame:
    """One row a key from several checkpoint files: the last file wins."""
    newest = W.Window.partitionBy(*keys).orderBy(F.col(file_col).desc())
    return parts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def apply_state(bank: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("base_key", "factor", "r")) -> DataFrame:
    """A bank with the rows that a state has in place of its own of those keys;
    rows of the bank that the state doesn't have stay."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}"))
    kept = bank.alias("b").join(state.select(*keys).distinct().alias("s"), same, "left_anti")
    return kept.unionByName(state.select(*bank.columns))


def pairs(factors: DataFrame, by: list[str]) -> DataFrame:
    """Whether each base has both factors."""
    return factors.groupBy(*by).agg(F.max(F.when(F.col("factor") == "A", 1).otherwise(0)).alias("has_a"), F.max(F.when(F.col("factor") == "B", 1).otherwise(0)).alias("has_b"))


def missing_pairs(factors: DataFrame, by: list[str]) -> DataFrame:
    return pairs(factors, by).where("has_a + has_b < 2")


def require_pairs(factors: DataFrame, by: list[str]) -> None:
    lost = missing_pairs(factors, by).orderBy(*by).take(3)
    if lost:
        raise ValueError(f"factors without their partner: {[tuple(r[b] for b in by) for r in lost]}")


def ranks(factors: DataFrame, by: list[str]) -> DataFrame:
    """The rank of each factor matrix."""
    return factors.groupBy(*by, "factor").agg((F.max("r") + 1).alias("rank"))


def uniform_rank(factors: DataFrame, by: list[str]) -> int:
    """The one rank of a checkpoint; none or several are refused."""
    found = sorted(r["rank"] for r in ranks(factors, by).select("rank").distinct().collect())
    if not found:
        raise ValueError("no adapter factors")
    if len(found) > 1:
        raise ValueError(f"several ranks: {found}")
    return found[0]


def rank_map(base_keys: DataFrame, overrides: DataFrame, default: int) -> DataFrame:
    """``base_key, rank`` of every base: its own where given, else the default."""
    own = overrides.select(F.col("base_key").alias("k"), F.col("rank").alias("own"))
    return base_keys.join(F.broadcast(own), F.col("base_key") == F.col("k"), "left").select("base_key", F.coalesce("own", F.lit(default)).alias("rank"))


def require_positive_ranks(ranked: DataFrame) -> None:
    if bad := ranked.where("rank <= 0").take(1):
        raise ValueError(f"a rank must be positive: {bad[0]}")


def truncate_bank(factors: DataFrame, site_ranks: DataFrame) -> DataFrame:
    """The part of a bank that each site takes: components under its rank;
    other tensors (no factor) go whole."""
    return factors.crossJoin(F.broadcast(site_ranks)).where((F.col("r") < F.col("rank")) | F.col("factor").isNull()).drop("rank")


def server_state(factors: DataFrame, prefix: str = "") -> DataFrame:
    """What a server shows of a model: its adapter's rows alone, keys under
    ``prefix`` and the model's own. ``factor`` is null for other tensors, which
    an adapter may hold whole."""
    return factors.withColumn("base_key", F.concat(F.lit(prefix), add_model_prefix(F.col("base_key"))))


def load_server_state(state: DataFrame, strict: bool = True) -> tuple[DataFrame, list[str]]:
    """The adapter's rows of a state, keys without the model's prefix, and the
    keys that could not be used. A state with no adapter rows is refused if
    ``strict``; else nothing is loaded and its keys come back, all of them,
    since only a state without any adapter is so small."""
    own = state.where(F.col("factor").isNotNull()).withColumn("base_key", strip_model_prefix(F.col("base_key")))
    if own.take(1):
        return own, []
    if strict:
        raise ValueError("a state without adapter keys")
    return own, sorted(r["base_key"] for r in state.select("base_key").distinct().collect())


def size_mb(vec: str = "vec") -> Column:
    """Size of a table of 4-byte components in MB; 0 if it is empty."""
    return F.coalesce(F.sum(F.size(vec) * 4) / 1048576, F.lit(0.0))


def default_ranks(grid: DataFrame) -> DataFrame:
    """``n, g, client, rank`` for each (n clients, g the greatest rank): halves
    of g, the least first, rounded half to even and then strictly rising."""
    c = grid.where("n <= g").select("n", "g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("client"))
    raw = F.greatest(F.lit(1), F.bround(F.col("g") / F.pow(F.lit(2.0), F.col("n") - 1 - F.col("client"))).cast("int"))
    rising = F.max(raw - F.col("client")).over(W.Window.partitionBy("n", "g").orderBy("client"))
    ranked = c.withColumn("rank", (rising + F.col("client")).cast("int"))
    top = F.max("rank").over(W.Window.partitionBy("n", "g"))
    return ranked.withColumn("rank", F.when(top > F.col("g"), F.col("g") - F.col("n") + 1 + F.col("client")).otherwise(F.col("rank")))


def site_ranks(n: int, greatest: int, given: list[int] | None = None) -> list[int]:
    """Ranks of the sites on the driver: those given, checked, or the defaults."""
    if given is not None:
        if len(given) != n:
            raise ValueError("one rank a client is needed")
        if any(not 0 < k <= greatest for k in given):
            raise ValueError("ranks lie between 1 and the greatest")
        return given
    if n > greatest:
        raise ValueError("more clients than ranks")
    out: list[int] = []
    for i in range(n):
        out.append(max(1, round(greatest / 2 ** (n - 1 - i)), out[-1] + 1 if out else 1))
    return out if out[-1] <= greatest else list(range(greatest - n + 1, greatest + 1))


def rank_fault(ranks: Column, n: Column, greatest: Column) -> Column:
    """Why a list of ranks can't be that of ``n`` sites, or null: the same
    refusals for rows of a table."""
    bad = F.exists(ranks, lambda k: k.isNull() | (k <= 0) | (k > greatest))
    return F.when(ranks.isNull() | (F.size(ranks) != n), F.lit("one rank a client is needed")).when(bad, F.lit("ranks lie between 1 and the greatest"))
