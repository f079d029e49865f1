"""Quality rules whose cutoffs bound the share of good documents rejected.

A rule rejects a document whose measure is at or over a cutoff. For each
stratum (a language) and rule, cutoffs are tried from the mildest on: a cutoff
stands if, were the true rate of rejected good documents above ``ALPHA`` over
the number of rules, so few rejections among the stratum's labelled good
documents would come with a chance of at most ``DELTA`` over the number of
strata and rules (an exact binomial tail, Bonferroni's correction). The first
that falls ends the row (a fixed sequence needs no correction of its own). So
with a chance of 1 - ``DELTA``, no stratum loses more than ``ALPHA`` of those
of its good documents that pass the base to all rules together; what the base
itself rejects is the contract's and not bounded. Strata with too few labels to
prove that for any cutoff get no rule: with six rules each needs some 1,430
labelled good documents.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TextChunk, materialize
from .texts import BASE, base_counts, map_texts, upper_count

ALPHA, DELTA, STEPS = 0.02, 0.05, 200
COUNTS = (*BASE, "n_upper", "n_bangs", "n_distinct", "n_lines")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _counts(chunk: TextChunk) -> list[pa.Array]:
    rows = []
    for raw in chunk.rows():
        words = raw.split()
        rows.append((*base_counts(raw, words), upper_count(raw), raw.count(b"!"), len(set(words)), sum(1 for x in raw.split(b"\n") if x.strip())))
    return [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]


def measures() -> dict[str, Column]:
    """Each rule's measure from 0 to 1, as a step of ``STEPS``; more is worse."""

    def share(a: Column, b: str) -> Column:
        return F.least(F.lit(STEPS), F.floor(a * STEPS / F.greatest(F.col(b), F.lit(1)))).cast("int")

    return {
        "symbols": share(F.col("n_symbols"), "word_chars"),
        "dup_lines": share(F.col("n_dup_lines"), "n_lines"),
        "repeats": share(F.col("n_repeat_words"), "n_words"),
        "upper": share(F.col("n_upper"), "word_chars"),
        "bangs": share(F.col("n_bangs"), "n_words"),
        "same_words": share(F.col("n_words") - F.col("n_distinct"), "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """The chance of at most k of n, each of chance p."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def cutoff(histogram: dict[int, int], n: int, alpha: float, delta: float) -> int | None:
    """The lowest proved cutoff of a rule, from good documents by step."""
    best, rejected = None, 0
    for step in range(STEPS, 0, -1):
        rejected += histogram.get(step, 0)
        if tail(rejected, n, alpha) > delta:
            break
        best = step
    return best


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Cutoffs by (stratum, rule) from all labelled good documents.

    ``stats`` has ``doc_id, stratum`` and the counts. Only strata with enough
    labels to prove anything reach the driver, ``STEPS`` + 1 numbers a rule at
    most; labels number their own share of that bound.
    """
    rules = measures()
    own, level = alpha / len(rules), delta / len(rules)
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("label_id")).distinct()
    held = stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("label_id"), "left_semi")
    steps = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), m.alias("step")) for r, m in rules.items()])).alias("x"))
    counts = steps.groupBy("stratum", "x.rule", "x.step").count()
    sizes = counts.groupBy("stratum", "rule").agg(F.sum("count").alias("n"))
    least = int(log(level) / log1p(-own))  # fewer can't prove a rate even with none rejected
    enough = sizes.where(F.col("n") >= least).groupBy("stratum").agg(F.max("n").alias("n")).select(F.col("stratum").alias("s"), "n")
    rows = materialize(counts.join(enough, F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "rule", "step", "count", "n"), "steps").collect()
    strata = {r["stratum"]: r["n"] for r in rows}
    out = {}
    for s, n in strata.items():
        for rule in rules:
            histogram = {r["step"]: r["count"] for r in rows if r["stratum"] == s and r["rule"] == rule}
            cut = cutoff(histogram, n, own, level / len(strata))
            if cut is not None:
                out[s, rule] = cut
    return out


def verdict(cutoffs: dict[tuple[str, str], int]) -> Column:
    """Whether a row of counts with its stratum passes base and rules."""
    passed = ~base_failed()
    for rule, measure in measures().items():
        own = {s: c for (s, r), c in cutoffs.items() if r == rule}
        if own:
            table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
            passed = passed & (measure < F.coalesce(F.element_at(table, F.col("stratum")), F.lit(STEPS + 1)))
    return passed


def count_texts(docs: DataFrame, keep: list[str], stratum_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``kept, stratum`` and the counts of every whole text. A null stratum is
    that of the empty text."""
    marked = docs.withColumn("stratum of rules", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    found = map_texts(marked, [*keep, "stratum of rules"], SCHEMA, _counts, text_col)
    return found.select(F.struct(*[F.col(f"kept.`{c}`").alias(c) for c in keep]).alias("kept"), F.col("kept.`stratum of rules`").alias("stratum"), *COUNTS)


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document.

    Texts are read once; the slim counts are written and joined with the
    labels by id. A null text has no words and so fails the base; a null
    stratum is that of the empty text; rows that repeat an id each count. A long text
    is counted whole; texts of the same measures share a step, so ties are
    rejected or kept together. An empty table gives none. Only the id, stratum
    and text are read, so no name can clash.
    """
    stats = materialize(count_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text")), ["doc_id"], "stratum", "text").select("kept.doc_id", "stratum", *COUNTS), "counts")
    cutoffs = calibrate(stats, labels)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(cutoffs).alias("kept"))
