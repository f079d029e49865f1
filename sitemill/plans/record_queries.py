"""Queries on records: scans, scalars, samples, splits, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import variants as V
from ..operators import collate, histograms, sampling, splits
from ..operators.asof import asof_join
from ..sources import archives, files, sinks
from ..storage import own_path
from ..vocab import QUESTION, VOCABULARY
from . import fixtures as X

PROMPT_SQL = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in (QUESTION, *VOCABULARY.labels))
N, VALIDATION = 3, 20


def alt_labels(spark: SparkSession, d: str) -> DataFrame:
    """Other forms of every part's label, ``brand: type: name``, and of the classes'."""
    parts = X.table(spark, d, "part").select(F.concat_ws(": ", "p_brand", "p_type", "p_name").alias("canonical"))
    return parts.union(X.records(spark, d).select("canonical")).select("canonical", S.alt_label(F.col("canonical")).alias("alt"))


def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    return X.records(spark, d).select("vec_id", F.col("label").alias("idx"), "code", "canonical")


def scan_labelled_paths(spark: SparkSession, d: str) -> DataFrame:
    return files.labelled_paths(X.image_paths(spark, d), X.classes(spark), root="/data/")


def scan_archives(spark: SparkSession, d: str) -> DataFrame:
    """The same files packed into archives of the shared folder, and their
    labels and sizes read straight from there."""
    paths = X.image_paths(spark, d)
    folder = own_path(spark, "archives")
    archives.write_archives(paths.select(F.substr("path", F.lit(2)).alias("path"), F.encode(F.repeat(F.col("path"), F.lit(3)), "UTF-8").alias("content")), folder, 4)
    held = archives.read_archives(spark, folder).select(F.concat(F.lit("/"), "path").alias("path"), F.octet_length("content").cast("bigint").alias("size"))
    found = files.labelled_paths(held.select("path"), X.classes(spark), root="/data/")
    return found.join(held, F.concat(F.lit("/data/"), "image") == F.col("path")).select("image", "label", "size")


def ordered_traversal(spark: SparkSession, d: str) -> DataFrame:
    """The place of each labelled path in a walk, folders nested at two depths."""
    paths = X.image_paths(spark, d).select(F.when(F.length("path") % 3 == 0, F.concat(F.lit("/data/a-b"), F.substr("path", F.lit(6)))).when(F.length("path") % 3 == 1, F.concat(F.lit("/data/a"), F.substr("path", F.lit(6)))).otherwise(F.col("path")).alias("path"))
    found = files.labelled_paths(paths, X.classes(spark), root="/data/")
    return sampling.ordered_rank(found.select("image", "label"), files.traversal(F.col("image")))


def label_name_fallback(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("vec_id") % 3 == 0, F.lit("")).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("own "), "code"))
    return X.records(spark, d).select("vec_id", S.label_name_or(given, F.col("canonical")).alias("label_name"))


def chat_training(spark: SparkSession, d: str) -> DataFrame:
    return X.records(spark, d).select("vec_id", S.messages_text(S.chat(F.col("canonical"))).alias("messages_text"))


def chat_inference(spark: SparkSession, d: str) -> DataFrame:
    return X.records(spark, d).select("vec_id", S.messages_text(S.chat()).alias("messages_text"))


def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("vec_id") % 3
    code = F.concat("code", F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    given = F.when(kind == 0, F.concat(F.lit(" \t"), code, F.lit("\n"))).when(kind == 1, F.concat(F.lit("/abs/"), code)).otherwise(code)
    return X.records(spark, d).select("vec_id", S.resolve_path(given, "/root/images").alias("output"))


def unsafe_paths(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("page_id") % 4
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    path = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("../"), name)).when(kind == 2, F.concat(F.lit("/etc/"), name)).otherwise(F.concat(F.lit("a/../b/"), name))
    return X.table(spark, d, "pages").select("page_id", path.alias("path")).where(S.is_unsafe_member(F.col("path")))


def keys(spark: SparkSession, d: str) -> DataFrame:
    """Adapter keys, of every kind."""
    f = X.factors(spark, d).select("layer", "factor").distinct()
    made = F.concat(F.lit("model.layers."), F.col("layer").cast("string"), F.lit(".attn.lora_"), "factor", F.lit(".lora_"), "factor", F.lit(".weight"))
    odd = spark.createDataFrame([("model.head.weight",), ("x.model.lora_A.a.lora_A.b",), ("a.lora_B.b.lora_A.c",), ("lora_A.x",)], "input string")
    return f.select(made.alias("input")).union(odd)


def key_classify(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).select("input", S.factor_kind(F.col("input")).alias("output"))


def base_key(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).select("input", S.base_key(F.col("input")).alias("output"))


def strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).select("input", S.strip_model_prefix(F.col("input")).alias("output"))


def prefix_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    bare = keys(spark, d).select(S.strip_model_prefix(F.col("input")).alias("input"))
    return bare.select("input", S.strip_model_prefix(S.add_model_prefix(F.col("input"))).alias("output"))


def bracket_groups(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("["), F.col("vec_id").cast("string"), F.lit(",1],x,[]"), F.when(F.col("vec_id") % 2 == 0, "[a b]").otherwise("[open"))
    return X.table(spark, d, "embeddings").select("vec_id", F.concat_ws("|", S.bracket_groups(text)).alias("groups"))


def rank_list_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("vec_id").cast("string"), F.lit(", ,8,"), (F.col("vec_id") % 7).cast("string"), F.lit(" ,"))
    parsed = S.parse_ranks(text)
    return X.table(spark, d, "embeddings").select("vec_id", F.size(parsed).alias("n"), F.aggregate(parsed, F.lit(0), lambda a, x: a * 31 + x).alias("code"))


def _tokens(n: str = "4") -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.expr(f"cast(vec_id % {n} as int)")), lambda i: ((F.col("vec_id") + i * 5) % 9).cast("int"))


def mask_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", F.concat_ws(",", S.mask_tokens(_tokens(), [0, 3]).cast("array<string>")).alias("tokens"))


def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("batch"), _tokens("5").alias("ids"))
    longest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("most"))
    joined = rows.join(longest, "batch")
    return joined.select("vec_id", F.concat_ws(",", S.pad_tokens(F.col("ids"), F.col("most"), 7).cast("array<string>")).alias("right_padded"), F.concat_ws(",", S.pad_tokens(F.col("ids"), F.col("most"), 7, left=True).cast("array<string>")).alias("left_padded"))


def collate_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("batch"), _tokens("5").alias("ids"))
    out = collate.collate(rows, "batch", "ids", 7, [0, 3])
    return out.select("vec_id", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def limit_then_semi(spark: SparkSession, d: str) -> DataFrame:
    images = X.records(spark, d).select("vec_id", F.concat("code", F.lit("/"), F.col("vec_id").cast("string")).alias("image"))
    there = X.records(spark, d).where("vec_id % 2 = 0").select(F.concat(F.lit("/r/"), "code", F.lit("/"), F.col("vec_id").cast("string")).alias("path"))
    return files.existing(images, there, "/r", 100, ["vec_id"]).select("vec_id", "image")


def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(X.table(spark, d, "documents").select("doc_id"), "doc_id", 50, 42)


def sample_all(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(X.table(spark, d, "documents").select("doc_id"), "doc_id", None, 42)


def round_eval_subset(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select("doc_id")
    rounds = [sampling.round_subset(docs, "doc_id", 30, k).select(F.lit(k).alias("round"), "pos", "doc_id") for k in range(3)]
    return rounds[0].union(rounds[1]).union(rounds[2])


def late_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Keys are sampled first, from one narrow column; texts are joined after."""
    docs = X.table(spark, d, "documents")
    drawn = sampling.sample(docs.select("doc_id"), "doc_id", 50, 7)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("pos", "doc_id", F.length("text").alias("length"))


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """What every click's JSON tells: rows that are no JSON are marked."""
    value = V.parsed(F.col("props"))
    return X.table(spark, d, "clicks").select("click_id", "props", value.alias("v")).select("click_id", V.is_broken(F.col("props"), F.col("v")).alias("is_broken"), V.path(F.col("v"), "$.k", "bigint").alias("k"), V.path(F.col("v"), "$.device.os", "string").alias("os"), V.path(F.col("v"), "$.items[0].sku", "bigint").alias("first_sku"), V.total(F.col("v"), "$.items", "qty").alias("qty"))


def asof_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every sale with the newest change of its client up to that time."""
    sales = X.table(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    return asof_join(sales, X.table(spark, d, "client_changes"), ["client_id"], "sold_at", "valid_at", ["seq", "segment", "city"], ["seq", "change_id"]).select("sale_id", "client_id", "seq", "segment", "city")


def _counts(spark: SparkSession, d: str, per_client: int | None) -> DataFrame:
    total = X.table(spark, d, "documents").agg(F.count("*").alias("total"))
    grid = spark.range(2, 8).select(F.col("id").cast("int").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("client"))
    return grid.crossJoin(F.broadcast(total)).select("n", "client", splits.client_counts(F.col("total"), F.col("n"), F.col("client"), per_client).alias("cnt"))


def client_counts_even(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, None)


def client_counts_capped(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, 60)


def _wishes(spark: SparkSession, d: str) -> DataFrame:
    """Clients and labels: as many clients as there are quantities sold, the
    vectors' labels that are classes."""
    n = X.table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("n")).distinct().select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("client"))
    return n.crossJoin(F.broadcast(X.records(spark, d).select("label").distinct()))  # a row a class


def dominant_groups(spark: SparkSession, d: str) -> DataFrame:
    return _wishes(spark, d).select("n", "client", "label", splits.dominant(F.col("n"), X.N_CLASSES, F.col("client"), F.col("label")).alias("is_dominant")).where("is_dominant")


def preference_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _wishes(spark, d).select("n", "client", "label", F.round(splits.preference(F.col("n"), X.N_CLASSES, F.col("client"), F.col("label"), 0.8), 6).alias("weight"))


def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    """The site that each document draws among three to six, by weights of
    its own length; a fifth of the documents has none above 0."""
    weights = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4 + 2).cast("int")), lambda i: F.when(F.col("doc_id") % 5 > 0, ((F.col("n_chars") + i * 3) % 7).cast("double")).otherwise(0.0))
    return X.table(spark, d, "documents").select("doc_id", splits.weighted_choice(weights, splits.uniform(F.col("doc_id"), 42)).alias("site"))


def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_random(X.table(spark, d, "documents"), "doc_id", N, VALIDATION)


def split_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each strategy by its name, 0 samples a client meaning all."""
    rows = X.records(spark, d)
    out = [splits.split_records(rows, "vec_id", "label", X.N_CLASSES, N, name, 0, validation=VALIDATION).select(F.lit(name).alias("strategy"), "vec_id", "site", "split") for name in ("random", "heterogeneous")]
    return out[0].union(out[1])


def split_heterogeneous(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_quota(X.records(spark, d), "vec_id", "label", X.N_CLASSES, N, VALIDATION)


def split_sequential(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_sequential(X.records(spark, d), "vec_id", "label", X.N_CLASSES, N, VALIDATION)


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    train = split_heterogeneous(spark, d).where("split = 'train'")
    return histograms.label_histogram(train, "label", X.classes(spark), splits.sites(spark, N))


def label_hist(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d).select("site", F.col("idx").alias("label"), "cnt")


def label_hist_text(spark: SparkSession, d: str) -> DataFrame:
    return histograms.histogram_text(_histogram(spark, d), X.classes(spark))


def chart_rows(spark: SparkSession, d: str) -> DataFrame:
    return histograms.chart_rows(_histogram(spark, d)).select("site", F.col("idx").alias("label"), "cnt", "bar")


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = X.records(spark, d).select(F.concat("code", F.lit("/"), F.col("vec_id").cast("string")).alias("image"), "label", F.col("canonical").alias("label_name"), F.col("code").alias("raw_label"))
    path = own_path(spark, "json")
    sinks.write_arrays(rows, path, F.col("raw_label"))
    return files.read_records(spark, path)


_USER = f"'user[image=,text=' || {PROMPT_SQL} || ']'"
_KEYS = f"""{X.factors_sql()}, keys AS (SELECT DISTINCT 'model.layers.' || layer || '.attn.lora_' || factor || '.lora_' || factor || '.weight' AS input FROM fac
  UNION ALL VALUES ('model.head.weight'), ('x.model.lora_A.a.lora_A.b'), ('a.lora_B.b.lora_A.c'), ('lora_A.x'))"""
_TOK = "list_transform(range(0, vec_id % {n} + 1), lambda i: CAST((vec_id + i * 5) % 9 AS INTEGER))"
_REC_IN = f"{X.RECORDS}, rec_in AS (SELECT vec_id AS key, label FROM rec)"
_HIST = f"""WITH {_REC_IN}, {X.QUOTA}, hist AS (SELECT s.site, c.idx, c.code, CAST(count(t.key) AS BIGINT) AS cnt
  FROM (VALUES ('site-1'), ('site-2'), ('site-3')) s(site) CROSS JOIN classes c LEFT JOIN (SELECT * FROM het WHERE split = 'train') t ON t.site = s.site AND t.label = c.idx
  GROUP BY s.site, c.idx, c.code)"""
_WISH = f"""WITH {X.RECORDS}, g AS (SELECT n.n, CAST(i.i AS INTEGER) AS client, c.label, n.n > 9 AS more, 9 // n.n AS size, 9 % n.n AS extra
  FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS n FROM lineitem) n JOIN range(0, 1000) i(i) ON i.i < n.n CROSS JOIN (SELECT DISTINCT label FROM rec) c),
m AS (SELECT *, CASE WHEN more THEN label = client % 9 ELSE label >= client * size + least(client, extra) AND label < client * size + least(client, extra) + size + CASE WHEN client < extra THEN 1 ELSE 0 END END AS is_dominant,
  CASE WHEN more THEN 1 ELSE size + CASE WHEN client < extra THEN 1 ELSE 0 END END AS mine FROM g)"""

QUERIES = {
    "alt_labels": (alt_labels, f"WITH {X.RECORDS}, l AS (SELECT p_brand || ': ' || p_type || ': ' || p_name AS canonical FROM part UNION ALL SELECT canonical FROM rec) SELECT canonical, '(' || split_part(canonical, ': ', 1) || ') ' || substr(canonical, strpos(canonical, ': ') + 2) AS alt FROM l"),
    "dict_encode": (dict_encode, f"WITH {X.RECORDS} SELECT vec_id, label AS idx, code, canonical FROM rec"),
    "scan_labelled_paths": (scan_labelled_paths, f"WITH {X.CLASSES}, {X.PATHS} SELECT substr(path, 7) AS image, c.idx AS label, c.canonical AS label_name, c.code AS raw_label FROM img JOIN classes c ON c.code = upper(split_part(path, '/', -2)) WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.bmp', '.jpeg', '.jpg', '.png', '.tif', '.tiff', '.webp')"),
    "scan_archives": (scan_archives, f"WITH {X.CLASSES}, {X.PATHS} SELECT substr(path, 7) AS image, c.idx AS label, CAST(3 * length(path) AS BIGINT) AS size FROM img JOIN classes c ON c.code = upper(split_part(path, '/', -2)) WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.bmp', '.jpeg', '.jpg', '.png', '.tif', '.tiff', '.webp')"),
    "ordered_traversal": (ordered_traversal, f"""WITH {X.CLASSES}, {X.PATHS}, p AS (SELECT CASE length(path) % 3 WHEN 0 THEN 'a-b' || substr(path, 6) WHEN 1 THEN 'a' || substr(path, 6) ELSE substr(path, 7) END AS image FROM img WHERE lower(regexp_extract(path, '[.][^./]+$')) IN ('.bmp', '.jpeg', '.jpg', '.png', '.tif', '.tiff', '.webp'))
  SELECT image, c.idx AS label, row_number() OVER (ORDER BY string_split(image, '/')[:-2], string_split(image, '/')[-1]) AS place FROM p JOIN classes c ON c.code = upper(split_part(image, '/', -2))"""),
    "collate_batch": (collate_batch, f"""WITH t AS (SELECT vec_id, {_TOK.format(n=5)} AS ids, max(vec_id % 5 + 1) OVER (PARTITION BY vec_id // 4) AS most FROM embeddings),
  f AS (SELECT vec_id, most, len(ids) AS n, ids || list_transform(range(0, most - len(ids)), lambda i: CAST(7 AS INTEGER)) AS filled FROM t)
  SELECT vec_id, array_to_string(filled, ',') AS input_ids, array_to_string(list_transform(range(0, most), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), ',') AS attention_mask, array_to_string(list_transform(filled, lambda x: CASE WHEN x IN (0, 3, 7) THEN -100 ELSE x END), ',') AS labels FROM f"""),
    "label_name_fallback": (label_name_fallback, f"WITH {X.RECORDS} SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN 'own ' || code ELSE canonical END AS label_name FROM rec"),
    "chat_training": (chat_training, f"WITH {X.RECORDS} SELECT vec_id, {_USER} || ';assistant[text=' || canonical || ']' AS messages_text FROM rec"),
    "chat_inference": (chat_inference, f"WITH {X.RECORDS} SELECT vec_id, {_USER} AS messages_text FROM rec"),
    "resolve_path": (resolve_path, f"WITH {X.RECORDS} SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN '/abs/' ELSE '/root/images/' END || code || '/' || vec_id || '.png' AS output FROM rec"),
    "unsafe_paths": (unsafe_paths, "SELECT page_id, CASE page_id % 4 WHEN 1 THEN '../p' ELSE '/etc/p' END || page_id AS path FROM pages WHERE page_id % 4 IN (1, 2)"),
    "key_classify": (key_classify, f"WITH {_KEYS} SELECT input, CASE WHEN contains(input, '.lora_A.') THEN 'A' WHEN contains(input, '.lora_B.') THEN 'B' END AS output FROM keys"),
    "base_key": (base_key, f"WITH {_KEYS} SELECT input, CASE WHEN contains(input, '.lora_A.') THEN regexp_replace(input, '\\.lora_A\\.', '.') WHEN contains(input, '.lora_B.') THEN regexp_replace(input, '\\.lora_B\\.', '.') END AS output FROM keys"),
    "strip_prefix": (strip_prefix, f"WITH {_KEYS} SELECT input, CASE WHEN starts_with(input, 'model.') THEN substr(input, 7) ELSE input END AS output FROM keys"),
    "prefix_roundtrip": (prefix_roundtrip, f"WITH {_KEYS}, b AS (SELECT CASE WHEN starts_with(input, 'model.') THEN substr(input, 7) ELSE input END AS input FROM keys) SELECT input, input AS output FROM b"),
    "bracket_groups": (bracket_groups, "SELECT vec_id, array_to_string(regexp_extract_all('[' || vec_id || ',1],x,[]' || CASE WHEN vec_id % 2 = 0 THEN '[a b]' ELSE '[open' END, '\\[[^\\]]*\\]'), '|') AS groups FROM embeddings"),
    "rank_list_parse": (rank_list_parse, "SELECT vec_id, 3 AS n, CAST((vec_id * 31 + 8) * 31 + vec_id % 7 AS INTEGER) AS code FROM embeddings"),
    "mask_tokens": (mask_tokens, f"SELECT vec_id, array_to_string(list_transform({_TOK.format(n=4)}, lambda x: CASE WHEN x IN (0, 3) THEN -100 ELSE x END), ',') AS tokens FROM embeddings"),
    "pad_batch": (pad_batch, f"WITH t AS (SELECT vec_id, vec_id // 4 AS b, {_TOK.format(n=5)} AS ids FROM embeddings), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY b) AS most FROM t) SELECT vec_id, array_to_string(ids || list_transform(range(0, most - len(ids)), lambda i: 7), ',') AS right_padded, array_to_string(list_transform(range(0, most - len(ids)), lambda i: 7) || ids, ',') AS left_padded FROM m"),
    "limit_then_semi": (limit_then_semi, f"WITH {X.RECORDS} SELECT vec_id, code || '/' || vec_id AS image FROM (SELECT * FROM rec ORDER BY vec_id LIMIT 100) WHERE vec_id % 2 = 0"),
    "sample_n": (sample_n, "SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents) WHERE pos <= 50"),
    "sample_all": (sample_all, "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents"),
    "round_eval_subset": (round_eval_subset, "SELECT * FROM (SELECT CAST(k AS INTEGER) AS round, row_number() OVER (PARTITION BY k ORDER BY md5((42 + k) || ':' || doc_id), doc_id) AS pos, doc_id FROM documents, range(3) r(k)) WHERE pos <= 30"),
    "late_materialize": (late_materialize, "SELECT * FROM (SELECT row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS pos, doc_id, CAST(length(text) AS INTEGER) AS length FROM documents) WHERE pos <= 50"),
    "json_paths": (json_paths, """WITH c AS (SELECT click_id, props, TRY_CAST(props AS JSON) AS v FROM clicks)
  SELECT click_id, props IS NOT NULL AND v IS NULL AS is_broken, TRY_CAST(v->>'$.k' AS BIGINT) AS k, v->>'$.device.os' AS os, TRY_CAST(v->>'$.items[0].sku' AS BIGINT) AS first_sku,
    CASE WHEN json_type(v, '$.items') = 'ARRAY' THEN CAST(coalesce(list_sum(list_transform(CAST(json_extract(v, '$.items[*].qty') AS VARCHAR[]), lambda x: TRY_CAST(x AS BIGINT))), 0) AS BIGINT) END AS qty FROM c"""),
    "asof_changes": (asof_changes, """WITH r AS (SELECT * FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1)
  SELECT s.sale_id, s.client_id, r.seq, r.segment, r.city FROM sales s ASOF LEFT JOIN r ON s.client_id = r.client_id AND s.sold_at >= r.valid_at"""),
    "client_counts_even": (client_counts_even, "SELECT CAST(n AS INTEGER) AS n, CAST(i AS INTEGER) AS client, CAST(t // n + CASE WHEN i < t % n THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM range(2, 8) a(n) JOIN range(0, 7) b(i) ON i < n CROSS JOIN (SELECT count(*) AS t FROM documents)"),
    "client_counts_capped": (client_counts_capped, "SELECT CAST(n AS INTEGER) AS n, CAST(i AS INTEGER) AS client, CAST(least(60, t // n) AS BIGINT) AS cnt FROM range(2, 8) a(n) JOIN range(0, 7) b(i) ON i < n CROSS JOIN (SELECT count(*) AS t FROM documents)"),
    "dominant_groups": (dominant_groups, f"{_WISH} SELECT n, client, label, is_dominant FROM m WHERE is_dominant"),
    "preference_matrix": (preference_matrix, f"{_WISH} SELECT n, client, label, round(CASE WHEN mine = 9 THEN CAST(1.0 AS DOUBLE) / 9 WHEN is_dominant THEN CAST(0.8 AS DOUBLE) / mine ELSE (CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) / (9 - mine) END, 6) AS weight FROM m"),
    "weighted_choice": (weighted_choice, """WITH w AS (SELECT doc_id, list_transform(range(doc_id % 4 + 3), lambda i: CASE WHEN doc_id % 5 > 0 THEN CAST((n_chars + i * 3) % 7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS w, CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
  t AS (SELECT *, list_sum(w) AS total, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])) AS so_far FROM w)
  SELECT doc_id, CAST(CASE WHEN total > 0 THEN len(list_filter(so_far, lambda x: x < u * total)) ELSE least(floor(u * len(w)), len(w) - 1) END AS INTEGER) AS site FROM t"""),
    "split_random": (split_random, "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents), t AS (SELECT count(*) AS t FROM documents), c AS (SELECT 'site-' || (i + 1) AS site, i * (t // 3) + least(i, t % 3) AS lo, (i + 1) * (t // 3) + least(i + 1, t % 3) AS hi FROM range(3) x(i), t) SELECT doc_id, site, CASE WHEN pos - lo <= 20 THEN 'validation' ELSE 'train' END AS split FROM r JOIN c ON pos > lo AND pos <= hi"),
    "split_dispatch": (split_dispatch, f"""WITH {_REC_IN}, {X.QUOTA}, c AS (SELECT 'site-' || (i + 1) AS site, i * (total // 3) + least(i, total % 3) AS lo, (i + 1) * (total // 3) + least(i + 1, total % 3) AS hi FROM range(3) x(i), tot)
  SELECT 'heterogeneous' AS strategy, key AS vec_id, site, split FROM het UNION ALL
  SELECT 'random', key, site, CASE WHEN pos - lo <= 20 THEN 'validation' ELSE 'train' END FROM (SELECT key, row_number() OVER (ORDER BY h, key) AS pos FROM h) JOIN c ON pos > lo AND pos <= hi"""),
    "split_heterogeneous": (split_heterogeneous, f"WITH {_REC_IN}, {X.QUOTA} SELECT key AS vec_id, label, site, split FROM het"),
    "split_sequential": (split_sequential, f"""WITH RECURSIVE {_REC_IN}, o AS (SELECT key, label, md5('42:' || key) AS h, CAST('0x' || substr(md5('43:' || key), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u, row_number() OVER (ORDER BY md5('42:' || key), key) AS i FROM rec_in),
  g AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(CAST(t // 3 + CASE WHEN s < t % 3 THEN 1 ELSE 0 END AS BIGINT) ORDER BY s) FROM range(3) r(s), (SELECT count(*) AS t FROM rec_in)) AS room, CAST(-1 AS BIGINT) AS took
    UNION ALL SELECT i, list_transform(range(3), lambda s: room[s + 1] - CASE WHEN s = took THEN 1 ELSE 0 END), took
    FROM (SELECT i, room, len(list_filter(range(3), lambda s: list_sum(w[1:s + 1]) < u * list_sum(w))) AS took
      FROM (SELECT o.i, o.u, g.room, list_transform(range(3), lambda s: CASE WHEN o.label // 3 = s THEN CAST(0.8 AS DOUBLE) / 3 ELSE (1 - CAST(0.8 AS DOUBLE)) / 6 END * g.room[s + 1]) AS w FROM g JOIN o ON o.i = g.i + 1))),
  p AS (SELECT o.key, o.label, o.h, 'site-' || (g.took + 1) AS site FROM o JOIN g USING (i))
  SELECT key AS vec_id, label, site, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY h, key) <= 20 THEN 'validation' ELSE 'train' END AS split FROM p"""),
    "label_hist": (label_hist, f"{_HIST} SELECT site, idx AS label, cnt FROM hist"),
    "label_hist_text": (label_hist_text, f"{_HIST} SELECT site, string_agg(code || '=' || cnt, ', ' ORDER BY idx) AS summary FROM hist GROUP BY site"),
    "chart_rows": (chart_rows, f"{_HIST} SELECT site, idx AS label, cnt, round(CAST(cnt AS DOUBLE) / greatest(max(cnt) OVER (), 1) * CAST(470.0 AS DOUBLE), 1) AS bar FROM hist"),
    "json_roundtrip": (json_roundtrip, f"WITH {X.RECORDS} SELECT code || '/' || vec_id AS image, label, canonical AS label_name, code AS raw_label FROM rec"),
}
