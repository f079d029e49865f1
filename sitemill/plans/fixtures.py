"""Inputs of the queries, derived from the test tables: for Spark, and as the
text of common table expressions for the SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import VOCABULARY

RANKS = (4, 8, 16)
N_CLASSES = len(VOCABULARY.codes)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def classes(spark: SparkSession) -> DataFrame:
    return F.broadcast(VOCABULARY.table(spark))


def records(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, code, canonical, alt`` of vectors with a class."""
    return table(spark, d, "embeddings").select("vec_id", "label").join(classes(spark), F.col("label") == F.col("idx")).drop("idx")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """``model, item, label, response``: two models' answers of five kinds."""
    rows = records(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("model"))
    names = F.array(*[F.lit(x) for x in VOCABULARY.labels])
    other = F.get(names, (F.col("label") + 4 + F.col("model")) % N_CLASSES)
    kind = (F.col("vec_id") * 7 + F.col("model") * 3) % 5
    text = F.when(kind == 0, F.col("canonical")).when(kind == 1, F.concat(F.lit("The tissue is **"), "alt", F.lit("**."))).when(kind == 2, "Unsure.").when(kind == 3, F.lower("canonical")).otherwise(F.concat(other, F.lit(" or "), "canonical"))
    return rows.select("model", F.col("vec_id").alias("item"), "label", text.alias("response"))


def image_paths(spark: SparkSession, d: str) -> DataFrame:
    """``path``: a file a vector, in its class's folder, with six suffixes."""
    suffix = F.get(F.array(*[F.lit(x) for x in (".JPG", ".tif", ".png", ".txt", "", ".jpeg")]), (F.col("vec_id") % 6).cast("int"))
    code = F.get(F.array(*[F.lit(x) for x in (*VOCABULARY.codes, "other")]), F.col("label"))
    return table(spark, d, "embeddings").select(F.concat(F.lit("/data/"), F.lower(code), F.lit("/img-"), F.col("vec_id").cast("string"), suffix).alias("path"))


def factors(spark: SparkSession, d: str, guarded: bool = True) -> DataFrame:
    """``client, layer, factor, r, vec``: adapters of three clients, ranks
    4, 8 and 16; without the guard the last layer is incomplete."""
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("client"), F.expr("vec_id div 3").alias("slot"), F.col("embedding").alias("vec"))
    rows = rows.select("client", F.expr("cast(slot div 32 as int)").alias("layer"), F.when(F.col("slot") % 32 < 16, "A").otherwise("B").alias("factor"), (F.col("slot") % 16).cast("int").alias("r"), "vec")
    rank = F.get(F.array(*[F.lit(x) for x in RANKS]), F.col("client"))
    kept = rows.where(F.col("r") < rank)
    if not guarded:
        return kept
    n = table(spark, d, "embeddings").agg(F.expr("cast(count(*) div 96 as int)").alias("layers"))
    return kept.crossJoin(F.broadcast(n)).where("layer < layers").drop("layers")


def weights(spark: SparkSession) -> DataFrame:
    return spark.range(3).select(F.col("id").cast("int").alias("client"), (F.col("id") + 1).cast("double").alias("w"))


_ROWS = ", ".join("({}, {}, {}, {})".format(*("'" + x.replace("'", "''") + "'" if isinstance(x, str) else x for x in row)) for row in zip(VOCABULARY.codes, range(N_CLASSES), VOCABULARY.labels, VOCABULARY.alternatives, strict=True))
CLASSES = f"classes(code, idx, canonical, alt) AS (VALUES {_ROWS})"
RECORDS = f"{CLASSES}, rec AS (SELECT e.vec_id, e.label, c.code, c.canonical, c.alt FROM embeddings e JOIN classes c ON c.idx = e.label)"
RESPONSES = f"""{RECORDS}, resp AS (
  SELECT m.model, r.vec_id AS item, r.label,
    CASE (r.vec_id * 7 + m.model * 3) % 5 WHEN 0 THEN r.canonical WHEN 1 THEN 'The tissue is **' || r.alt || '**.' WHEN 2 THEN 'Unsure.'
      WHEN 3 THEN lower(r.canonical) ELSE o.canonical || ' or ' || r.canonical END AS response
  FROM rec r CROSS JOIN (VALUES (0), (1)) m(model) JOIN classes o ON o.idx = (r.label + 4 + m.model) % 9)"""
PARSED = f"""{RESPONSES}, parsed AS (
  SELECT p.model, p.item, p.label, p.response, CAST(coalesce(min(k.idx), -1) AS INTEGER) AS pred
  FROM resp p LEFT JOIN classes k ON contains(p.response, k.canonical) OR contains(p.response, k.alt)
  GROUP BY p.model, p.item, p.label, p.response)"""
PATHS = """img AS (SELECT '/data/' || lower(CASE label WHEN 0 THEN 'ADI' WHEN 1 THEN 'BACK' WHEN 2 THEN 'DEB' WHEN 3 THEN 'LYM' WHEN 4 THEN 'MUC'
    WHEN 5 THEN 'MUS' WHEN 6 THEN 'NORM' WHEN 7 THEN 'STR' WHEN 8 THEN 'TUM' ELSE 'other' END) || '/img-' || vec_id ||
    CASE vec_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.tif' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.jpeg' END AS path FROM embeddings)"""


def factors_sql(guarded: bool = True) -> str:
    guard = " AND layer < (SELECT count(*) // 96 FROM embeddings)" if guarded else ""
    return f"""fac AS (SELECT * FROM (
    SELECT CAST(vec_id % 3 AS INTEGER) AS client, CAST(vec_id // 3 // 32 AS INTEGER) AS layer,
      CASE WHEN (vec_id // 3) % 32 < 16 THEN 'A' ELSE 'B' END AS factor, CAST((vec_id // 3) % 16 AS INTEGER) AS r, embedding AS vec FROM embeddings)
  WHERE r < CASE client WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END{guard}),
w(client, w) AS (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE), (2, 3.0::DOUBLE))"""


#: Sites, quotas and the quota split of ``rec_in(key, label)``, seed 42, three sites, 20 rows for validation.
QUOTA = """
h AS (SELECT key, label, md5('42:' || key) AS h FROM rec_in),
tot AS (SELECT count(*) AS total FROM h),
grid AS (SELECT s.i AS idx, 'site-' || (s.i + 1) AS site, l.l AS l, CAST(total // 3 + CASE WHEN s.i < total % 3 THEN 1 ELSE 0 END AS BIGINT) AS cap,
    CASE WHEN l.l >= 3 * s.i AND l.l < 3 * s.i + 3 THEN CAST(0.8 AS DOUBLE) / 3 ELSE (CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) / 6 END AS pref
  FROM range(3) s(i), range(9) l(l), tot),
wished AS (SELECT *, CAST(floor(cap * pref) AS BIGINT) AS wish FROM grid),
supplied AS (SELECT g.*, coalesce(p.n, 0) AS supply, sum(wish) OVER (PARTITION BY l) AS wanted
  FROM wished g LEFT JOIN (SELECT label, count(*) AS n FROM h GROUP BY label) p ON p.label = g.l),
quota AS (SELECT *, CASE WHEN wanted > 0 THEN CAST(floor(wish * least(CAST(1.0 AS DOUBLE), CAST(supply AS DOUBLE) / CAST(wanted AS DOUBLE))) AS BIGINT) ELSE 0 END AS quota FROM supplied),
spans AS (SELECT l, site, sum(quota) OVER (PARTITION BY l ORDER BY idx) AS hi, sum(quota) OVER (PARTITION BY l ORDER BY idx) - quota AS lo FROM quota),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, key) AS rk FROM h),
first AS (SELECT r.key, r.label, r.h, s.site FROM ranked r LEFT JOIN spans s ON s.l = r.label AND r.rk > s.lo AND r.rk <= s.hi),
free AS (SELECT idx, site, max(cap) - sum(quota) AS free FROM quota GROUP BY idx, site),
gaps AS (SELECT site, sum(free) OVER (ORDER BY idx) AS hi, sum(free) OVER (ORDER BY idx) - free AS lo FROM free),
left_over AS (SELECT key, label, h, row_number() OVER (ORDER BY h, key) AS rk FROM first WHERE site IS NULL),
placed AS (SELECT key, label, h, site FROM first WHERE site IS NOT NULL
  UNION ALL SELECT o.key, o.label, o.h, g.site FROM left_over o JOIN gaps g ON o.rk > g.lo AND o.rk <= g.hi),
het AS (SELECT key, label, site, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY h, key) <= 20 THEN 'validation' ELSE 'train' END AS split FROM placed)"""
