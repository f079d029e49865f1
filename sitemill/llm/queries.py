"""The queries of this subpackage: each applies its operator, with production
parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, dac, gam, media, packing, rules, rules_sql, sentencepieces, sentences, sharding, simhash, suffixarray, warc, windows
from .texts import held_out

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir), SHARDS, ["source", "lang", "doc_id"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), digest=True)


#: A document counts as good from this chance on.
GOOD = 0.7


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scored = gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("kept.doc_id", held_out("kept.doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


#: Bytes of a repeated passage: some 37 words, so that any passage of over 50
#: words counts, whatever stands around it.
PASSAGE = 200


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; ``passage_bytes`` tells of shorter passages."""
    return suffixarray.remove_repeats(table(spark, sf_dir), result="digest", passage=PASSAGE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeated_runs(table(spark, sf_dir))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_segments(dac.write_segments(table(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir))


#: Centroids, rounds, components, scale and seed of the clustering.
CLUSTERS = {"k": 40, "rounds": 5, "dims": 64, "scale": 256, "seed": 2}


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(table(spark, sf_dir, "embeddings"), **CLUSTERS)


#: Seconds of a short and a long window.
WINDOWS = (600, 43200)


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling(windows.document_times(table(spark, sf_dir)), WINDOWS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_records(warc.write_records(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_suffix_array": op4_suffix_array,
    "op5_packing": op5_packing,
    "op6_sentences": op6_sentences,
    "op7_token_binary": op7_token_binary,
    "op8_rules": op8_rules,
    "op9_simhash": op9_simhash,
    "op10_flac": op10_flac,
    "op11_ball_tree": op11_ball_tree,
    "op12_windows": op12_windows,
    "op13_warc": op13_warc,
}
#: DuckDB has no CRC-32, tokenizer or suffix array; the other queries are tested by brute force.
ORACLES: dict[str, str] = {"op6_sentences": sentences.SQL, "op8_rules": rules_sql.SQL, "op11_ball_tree": balltree.sql(**CLUSTERS), "op12_windows": windows.SQL, "op13_warc": warc.SQL}
