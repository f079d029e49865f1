"""The corpus pipeline: raw documents in, packed training windows out.

Every stage works on all that the one before kept, and its decisions take
effect. Stages but the last return the columns of ``documents``, whatever their
names; each is written to the shared folder and read again by the next.

In every stage a null text counts as empty, rows that repeat an id are judged
each for itself, a null id is a row like any other, a very long text is read
whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitemill.llm import gam, nearcopies, packing, rules, suffixarray
from sitemill.llm.common import materialize
from sitemill.llm.queries import GOOD, PASSAGE, table, tokenizer_file
from sitemill.storage import discard


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fitted classifier gives under ``GOOD``; one
    that scores just ``GOOD`` stays. Without labels all score alike."""
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.score(docs, model, docs.columns).where(F.col("score") >= GOOD).select("kept.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or a proved cutoff; null and very
    short texts fail the base, a null language is that of the empty text. Counts
    are taken twice, for the cutoffs and for the verdicts, so that texts aren't
    shuffled."""
    stats = rules.count_texts(docs.select("doc_id", "lang", "text"), ["doc_id"]).select("kept.doc_id", "stratum", *rules.COUNTS)
    cutoffs = rules.calibrate(stats, table(spark, sf_dir, "labels"))
    return rules.count_texts(docs, docs.columns).where(rules.verdict(cutoffs)).select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the least id, or
    of rows without one the least text digest. Rows that agree in id and text
    are one document; of them the one stays whose other columns come first as
    JSON. Fingerprints of runs of five words link at four bits; sets of those
    runs also at a similarity of 0.8. Texts without words are copies."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.md5(F.encode(text, "UTF-8")).alias("digest"))
    keyed = docs.select(F.struct(*docs.columns).alias("held"), key.alias("key"), "text")  # in a struct no name can clash
    groups = nearcopies.near_copies(keyed, "key")
    chosen = groups.where(F.col("key").eqNullSafe(F.col("component_key"))).select(F.col("key").alias("chosen")).distinct()
    kept = keyed.select("held", "key").join(chosen, F.col("key").eqNullSafe(F.col("chosen")), "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias("none"), *[F.col(f"held.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]))
    return kept.withColumn("nth", F.row_number().over(W.Window.partitionBy("key").orderBy(others))).where("nth = 1").select("held.*")


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of ``PASSAGE`` bytes that is found elsewhere too out
    of all texts that hold it. A document may be left empty."""
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("held"))
    cut = suffixarray.remove_repeats(held, result="text", length=PASSAGE, keep=["held"])
    changed = {"text": "kept_text", "n_chars": "char_length(kept_text)"}
    return cut.select(*[(F.when(F.col("n_removed") > 0, F.expr(changed[c])).otherwise(F.col(f"held.`{c}`")) if c in changed else F.col(f"held.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2,048 tokens; an emptied text is its
    end id alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_array),
    ("packing", pack),
]

#: Fingerprints, suffix arrays and tokenizers are beyond SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is removed once the next
    one's is written; the last one's input stays, as its result reads it."""
    docs, written = table(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            if written is not None:
                discard(written)
            written = docs
    return docs
