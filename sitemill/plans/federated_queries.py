"""Queries on adapters and client updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables
from ..operators import adapters, aggregation
from ..sources import files, sinks, tensors
from ..storage import cut, own_path
from . import fixtures as X
from . import rounds

TARGET = 16


def exact(column: str | F.Column) -> F.Column:
    """To 6 decimals, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def _vec_sum() -> F.Column:
    return F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4) + F.lit(0.0)


def pair_check(spark: SparkSession, d: str) -> DataFrame:
    return adapters.pairs(X.factors(spark, d), ["client", "layer"])


def pair_missing(spark: SparkSession, d: str) -> DataFrame:
    return adapters.missing_pairs(X.factors(spark, d, guarded=False), ["client", "layer"])


def infer_rank(spark: SparkSession, d: str) -> DataFrame:
    return adapters.ranks(X.factors(spark, d), ["client", "layer"]).groupBy("client").agg(F.sort_array(F.collect_set("rank")).alias("found")).select("client", F.concat_ws(",", F.col("found").cast("array<string>")).alias("ranks"))


def default_ranks(spark: SparkSession, d: str) -> DataFrame:
    """For as many clients as order lines are numbered, and greatest ranks as
    quantities are sold."""
    grid = X.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("g")).distinct()
    return adapters.default_ranks(grid)


def rank_map(spark: SparkSession, d: str) -> DataFrame:
    layers = X.factors(spark, d).select(F.col("layer").alias("base_key")).distinct()
    return adapters.rank_map(layers, spark.createDataFrame([(0, 4), (3, 32)], "base_key int, rank int"), TARGET)


def truncate_bank(spark: SparkSession, d: str) -> DataFrame:
    bank = X.factors(spark, d).where("client = 2").drop("client")
    site_ranks = spark.createDataFrame([("site-1", 4), ("site-2", 8), ("site-3", 16)], "site string, rank int")
    return adapters.truncate_bank(bank, site_ranks).select("site", "layer", "factor", "r", _vec_sum().alias("vec_sum"))


def adapter_size_mb(spark: SparkSession, d: str) -> DataFrame:
    return X.factors(spark, d).groupBy("client").agg(adapters.size_mb().alias("size_mb"))


def checkpoint_overlay(spark: SparkSession, d: str) -> DataFrame:
    return adapters.overlay(X.factors(spark, d), ["layer", "factor", "r"], "client").select("layer", "factor", "r", _vec_sum().alias("vec_sum"))


def checkpoint_files(spark: SparkSession, d: str) -> DataFrame:
    """Three clients' adapters as tensor files in one folder, each without a
    third of the layers; read back, the last file wins."""
    folder = own_path(spark, "checkpoint")
    for client in range(3):
        held = X.factors(spark, d).where((F.col("client") == client) & ((F.col("layer") + client) % 3 != 0))
        named = held.select(F.concat(F.lit("layers."), F.col("layer").cast("string"), F.lit(".weight")).alias("base_key"), "factor", "r", "vec")
        tensors.write_checkpoint(tensors.factor_tensors(named), folder, f"client{client}", files=2)
    found = tensors.factor_rows(tensors.read_tensors(spark, folder))
    return found.select(F.split("base_key", r"\.")[1].cast("int").alias("layer"), "factor", "r", _vec_sum().alias("vec_sum"))


def explode_adapter(spark: SparkSession, d: str) -> DataFrame:
    """Each cell of every factor."""
    cells = X.factors(spark, d).select("client", "layer", "factor", "r", F.posexplode("vec").alias("pos", "value"))
    return cells.select("client", "layer", "factor", "r", "pos", exact(F.col("value").cast("double")).alias("value"))


def fit_rank(spark: SparkSession, d: str) -> DataFrame:
    """All factors cut or filled to ten components, by the table function in SQL."""
    tables.register(spark)
    fitted = spark.sql("SELECT * FROM fit_rank(TABLE(SELECT client, layer, factor, r, vec FROM {factors}), 10)", factors=X.factors(spark, d))
    return fitted.select("client", "layer", "factor", "r", _vec_sum().alias("vec_sum"))


def apply_state(spark: SparkSession, d: str) -> DataFrame:
    """The greatest client's bank with the middle one's components on top."""
    of = lambda c: X.factors(spark, d).where(F.col("client") == c).drop("client")
    return adapters.apply_state(of(2), of(1), ("layer", "factor", "r")).select("layer", "factor", "r", _vec_sum().alias("vec_sum"))


def agg_weight(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("vec_id") % 4
    value = (F.col("vec_id") + 1).cast("double")
    none = F.create_map().cast("map<string,double>")
    meta = F.when(kind == 0, F.create_map(F.lit("num_examples"), value)).when(kind == 1, F.create_map(F.lit("num_examples"), F.lit(None).cast("double"), F.lit("num_steps"), F.lit(7.0))).when(kind == 2, F.create_map(F.lit("num_steps"), value)).otherwise(none)
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("client"), aggregation.client_weight(meta).alias("weight"))


def key_mismatch(spark: SparkSession, d: str) -> DataFrame:
    keys = X.factors(spark, d).select(F.col("client").cast("string").alias("client"), F.concat_ws(".", F.col("layer").cast("string"), "factor", F.col("r").cast("string")).alias("key"))
    return aggregation.key_mismatches(keys, "1")


def agg_dense(spark: SparkSession, d: str) -> DataFrame:
    """Three clients' dense tensors, a key for every three vectors."""
    tensors = X.table(spark, d, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("client"), F.expr("vec_id div 3").alias("key"), F.col("embedding").alias("vec"))
    return aggregation.dense_mean(tensors, X.weights(spark), ["key"]).select("key", "pos", exact("value").alias("value"))


def agg_naive(spark: SparkSession, d: str) -> DataFrame:
    cells = aggregation.factor_mean(X.factors(spark, d), X.weights(spark), ["layer"], TARGET)
    return cells.select("layer", "factor", "r", "pos", exact("value").alias("value"))


def delta_w(spark: SparkSession, d: str) -> DataFrame:
    return aggregation.update_mean(X.factors(spark, d), X.weights(spark), ["layer"]).select("layer", "i", "j", exact("value").alias("value"))


def agg_reconstructed(spark: SparkSession, d: str) -> DataFrame:
    """The product of the factors of ``reconstruct``: with a target of the sum
    of all ranks it is the mean update itself."""
    bank = cut(aggregation.reconstruct(X.factors(spark, d), X.weights(spark), "layer", 32), "bank").withColumn("client", F.lit(0))
    one = spark.createDataFrame([(0, 1.0)], "client int, w double")
    return aggregation.update_mean(bank, one, ["layer"]).select("layer", "i", "j", exact("value").alias("value"))


def agg_reconstructed_wide(spark: SparkSession, d: str) -> DataFrame:
    """The same where ranks add up to more than a task takes and sides are
    wider still: in blocks of 24 of the 64 values, triangles joined in a tree."""
    bank = cut(aggregation.reconstruct(X.factors(spark, d), X.weights(spark), "layer", 32, 8, 24), "bank").withColumn("client", F.lit(0))
    one = spark.createDataFrame([(0, 1.0)], "client int, w double")
    return aggregation.update_mean(bank, one, ["layer"]).select("layer", "i", "j", exact("value").alias("value"))


def _updates(spark: SparkSession, d: str, sent: F.Column | None = None) -> DataFrame:
    """An update a client and user: mean values by event type as metrics;
    users fall to seven rounds."""
    means = X.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    maps = means.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "x"))).alias("metrics"))
    metrics = F.col("metrics") if sent is None else F.when(sent, F.col("metrics"))
    return maps.select((F.col("user_id") % 7).alias("round"), metrics.alias("metrics"), F.create_map(F.lit("num_examples"), (F.col("user_id") % 3 + 1).cast("double")).alias("meta"))


def agg_metrics(spark: SparkSession, d: str) -> DataFrame:
    return aggregation.metric_mean(_updates(spark, d)).select("metric", exact("value").alias("value"))


def agg_metrics_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Seven rounds, of which those are without metrics that have a silent user."""
    return aggregation.metric_mean(_updates(spark, d, ~F.col("user_id").isin(14, 29, 30)), ["round"]).select("round", "metric", exact("value").alias("value"))


def explicit_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ranks as they are typed, one a site, and what is wrong with them."""
    lines = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.concat_ws(" , ", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"].cast("string"))).alias("typed"))
    ranks = S.parse_ranks(F.col("typed"))
    return lines.select("l_orderkey", F.size(ranks).alias("given"), adapters.rank_fault(ranks, F.col("n"), F.lit(45)).alias("fault"))


def load_global(spark: SparkSession, d: str) -> DataFrame:
    """A global bank's file, written and loaded again."""
    path = own_path(spark, "global")
    sinks.write_adapter(X.factors(spark, d).where("client = 2").select(F.col("layer").cast("string").alias("base_key"), "factor", "r", "vec"), path)
    return files.load_global(spark, path).select("base_key", "factor", "r", _vec_sum().alias("vec_sum"))


def server_state(spark: SparkSession, d: str) -> DataFrame:
    """What a server shows of each client's adapter, loaded back by a client."""
    shown = adapters.server_state(X.factors(spark, d).where("client = 1").select(F.concat(F.lit("layers."), F.col("layer").cast("string")).alias("base_key"), "factor", "r", "vec"))
    own, _ = adapters.load_server_state(shown)
    return shown.select(F.col("base_key").alias("shown"), "factor", "r", "vec").join(own.select(F.concat(F.lit("model."), "base_key").alias("shown"), "base_key", "factor", "r"), ["shown", "factor", "r"]).select("shown", "base_key", "factor", "r", _vec_sum().alias("vec_sum"))


def round_loop(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of three sites on four fifths of the vectors, each judged
    on 40 of the others."""
    rows = X.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("site-"), (F.col("vec_id") % 3 + 1).cast("string")).alias("site"), "embedding", "label")
    rng = np.random.default_rng(3)
    start = [("A", r, (rng.normal(size=64) / 8).tolist()) for r in range(TARGET)] + [("B", r, [0.0] * 10) for r in range(TARGET)]
    bank = spark.createDataFrame(start, "factor string, r int, vec array<double>")
    ranks = spark.createDataFrame([("site-1", 4), ("site-2", 8), ("site-3", 16)], "site string, rank int")
    held_out = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("key"), "embedding", "label")
    return rounds.run_rounds(rows.where("vec_id % 5 <> 0"), bank, ranks, 3, TARGET, held_out=held_out, eval_size=40)[1]


_SUM = "round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 4) + 0.0"
_F = f"WITH {X.factors_sql()}"
_DELTA = f"""{_F}, a AS (SELECT client, layer, r, unnest(vec) AS x, unnest(range(0, len(vec))) AS j FROM fac WHERE factor = 'A'),
b AS (SELECT client, layer, r, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM fac WHERE factor = 'B')
SELECT b.layer, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w.w * CAST(b.x AS DOUBLE) * CAST(a.x AS DOUBLE)) / 6, 6) + 0.0 AS value
FROM a JOIN b ON a.client = b.client AND a.layer = b.layer AND a.r = b.r JOIN w ON w.client = a.client GROUP BY b.layer, i, j"""
_METRICS = """SELECT event_type AS metric, round(sum((user_id % 3 + 1) * x) / sum(user_id % 3 + 1), 6) + 0.0 AS value
FROM (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY user_id, event_type) GROUP BY event_type"""

QUERIES = {
    "pair_check": (pair_check, f"{_F} SELECT client, layer, CAST(max(CASE WHEN factor = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS has_a, CAST(max(CASE WHEN factor = 'B' THEN 1 ELSE 0 END) AS INTEGER) AS has_b FROM fac GROUP BY client, layer"),
    "pair_missing": (pair_missing, f"WITH {X.factors_sql(False)}, p AS (SELECT client, layer, CAST(max(CASE WHEN factor = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS has_a, CAST(max(CASE WHEN factor = 'B' THEN 1 ELSE 0 END) AS INTEGER) AS has_b FROM fac GROUP BY client, layer) SELECT * FROM p WHERE has_a + has_b < 2"),
    "infer_rank": (infer_rank, f"{_F}, m AS (SELECT DISTINCT client, max(r) + 1 AS rank FROM fac GROUP BY client, layer, factor) SELECT client, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks FROM m GROUP BY client"),
    "default_ranks": (default_ranks, "WITH c AS (SELECT n, g, CAST(i AS INTEGER) AS client FROM (SELECT DISTINCT l_linenumber AS n, CAST(l_quantity AS INTEGER) AS g FROM lineitem) JOIN range(0, 100) k(i) ON i < n WHERE n <= g), r AS (SELECT *, greatest(1, CAST(round_even(g / power(CAST(2 AS DOUBLE), n - 1 - client), 0) AS INTEGER)) AS raw FROM c), s AS (SELECT *, max(raw - client) OVER (PARTITION BY n, g ORDER BY client) + client AS rank FROM r), t AS (SELECT *, max(rank) OVER (PARTITION BY n, g) AS top FROM s) SELECT n, g, client, CAST(CASE WHEN top > g THEN g - n + 1 + client ELSE rank END AS INTEGER) AS rank FROM t"),
    "rank_map": (rank_map, f"{_F} SELECT DISTINCT layer AS base_key, CASE layer WHEN 0 THEN 4 WHEN 3 THEN 32 ELSE 16 END AS rank FROM fac"),
    "truncate_bank": (truncate_bank, f"{_F} SELECT s.site, layer, factor, r, {_SUM} AS vec_sum FROM fac JOIN (VALUES ('site-1', 4), ('site-2', 8), ('site-3', 16)) s(site, k) ON r < k WHERE client = 2"),
    "adapter_size_mb": (adapter_size_mb, f"{_F} SELECT client, CAST(sum(len(vec) * 4) AS DOUBLE) / 1048576 AS size_mb FROM fac GROUP BY client"),
    "checkpoint_overlay": (checkpoint_overlay, f"{_F} SELECT layer, factor, r, {_SUM} AS vec_sum FROM (SELECT *, row_number() OVER (PARTITION BY layer, factor, r ORDER BY client DESC) AS n FROM fac) WHERE n = 1"),
    "checkpoint_files": (checkpoint_files, f"{_F} SELECT layer, factor, r, {_SUM} AS vec_sum FROM (SELECT *, rank() OVER (PARTITION BY layer, factor ORDER BY client DESC) AS n FROM fac WHERE (layer + client) % 3 <> 0) WHERE n = 1"),
    "explode_adapter": (explode_adapter, f"{_F} SELECT client, layer, factor, r, CAST(pos AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) + 0.0 AS value FROM (SELECT client, layer, factor, r, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM fac)"),
    "fit_rank": (fit_rank, f"{_F}, own AS (SELECT DISTINCT client, layer, factor FROM fac) SELECT o.client, o.layer, o.factor, CAST(k AS INTEGER) AS r, coalesce({_SUM}, 0.0) AS vec_sum FROM own o CROSS JOIN range(10) g(k) LEFT JOIN fac f ON f.client = o.client AND f.layer = o.layer AND f.factor = o.factor AND f.r = k"),
    "apply_state": (apply_state, f"{_F}, own AS (SELECT * FROM fac WHERE client = 2), sent AS (SELECT * FROM fac WHERE client = 1) SELECT layer, factor, r, {_SUM} AS vec_sum FROM (SELECT * FROM sent UNION ALL SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.layer = o.layer AND s.factor = o.factor AND s.r = o.r))"),
    "agg_weight": (agg_weight, "SELECT vec_id AS client, CAST(CASE vec_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE vec_id + 1 END AS DOUBLE) AS weight FROM embeddings"),
    "key_mismatch": (key_mismatch, f"{_F}, k AS (SELECT CAST(client AS VARCHAR) AS client, layer || '.' || factor || '.' || r AS key FROM fac), o AS (SELECT key FROM k WHERE client = '1') SELECT client, key, 'extra' AS side FROM k WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT c.client, o.key, 'missing' AS side FROM (SELECT DISTINCT client FROM k) c CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.client = c.client AND k.key = o.key)"),
    "agg_dense": (agg_dense, "WITH e AS (SELECT vec_id // 3 AS key, CAST(vec_id % 3 + 1 AS DOUBLE) AS w, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) SELECT key, CAST(pos AS INTEGER) AS pos, round(sum(w * CAST(x AS DOUBLE)) / 6, 6) + 0.0 AS value FROM e GROUP BY key, pos"),
    "agg_naive": (agg_naive, f"{_F}, c AS (SELECT f.layer, f.factor, f.r, w.w, unnest(f.vec) AS x, unnest(range(0, len(f.vec))) AS pos FROM fac f JOIN w ON w.client = f.client WHERE f.r < 16), m AS (SELECT layer, factor, r, pos, sum(w * CAST(x AS DOUBLE)) / 6 AS value FROM c GROUP BY layer, factor, r, pos), g AS (SELECT DISTINCT layer, factor FROM fac) SELECT g.layer, g.factor, CAST(rr.r AS INTEGER) AS r, CAST(p.pos AS INTEGER) AS pos, round(coalesce(m.value, 0.0), 6) + 0.0 AS value FROM g CROSS JOIN range(16) rr(r) CROSS JOIN range(64) p(pos) LEFT JOIN m ON m.layer = g.layer AND m.factor = g.factor AND m.r = rr.r AND m.pos = p.pos"),
    "delta_w": (delta_w, _DELTA),
    "agg_reconstructed": (agg_reconstructed, _DELTA),
    "agg_reconstructed_wide": (agg_reconstructed_wide, _DELTA),
    "agg_metrics": (agg_metrics, _METRICS),
    "agg_metrics_suppressed": (agg_metrics_suppressed, "SELECT user_id % 7 AS round, event_type AS metric, round(sum((user_id % 3 + 1) * x) / sum(user_id % 3 + 1), 6) + 0.0 AS value FROM (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY user_id, event_type) WHERE user_id % 7 NOT IN (SELECT user_id % 7 FROM events WHERE user_id IN (14, 29, 30)) GROUP BY 1, 2"),
    "explicit_ranks": (explicit_ranks, "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS given, CASE WHEN count(*) <> max(l_linenumber) THEN 'one rank a client is needed' WHEN max(CAST(l_quantity AS INTEGER)) > 45 OR min(CAST(l_quantity AS INTEGER)) <= 0 THEN 'ranks lie between 1 and the greatest' END AS fault FROM lineitem GROUP BY l_orderkey"),
    "load_global": (load_global, f"{_F} SELECT 'model.' || layer AS base_key, factor, r, {_SUM} AS vec_sum FROM fac WHERE client = 2"),
    "server_state": (server_state, f"{_F} SELECT 'model.layers.' || layer AS shown, 'layers.' || layer AS base_key, factor, r, {_SUM} AS vec_sum FROM fac WHERE client = 1"),
    "round_loop": (round_loop, None),
}
