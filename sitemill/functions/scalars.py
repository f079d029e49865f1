"""Column functions on labels, responses, paths, keys and token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import IGNORED_TOKEN, UNPARSED, UNPARSED_LABEL, VOCABULARY, Vocabulary


def alt_label(label: Column) -> Column:
    """``X: description`` as ``(X) description``; only the first ``: `` counts."""
    parts = F.split(label, ": ", 2)
    return F.concat(F.lit("("), F.get(parts, F.lit(0)), F.lit(") "), F.get(parts, F.lit(1)))


def label_name_or(label_name: Column, canonical: Column) -> Column:
    """The name, or the class's own label where it is null or empty."""
    return F.coalesce(F.nullif(label_name, F.lit("")), canonical)


def parse_label(response: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """The lowest class whose label or alternative is a part of the response
    (by class, not by place in the text), case-sensitive; -1 if none is."""
    hits = [F.when(F.contains(response, F.lit(a)) | F.contains(response, F.lit(b)), F.lit(i)) for i, (a, b) in enumerate(zip(vocabulary.labels, vocabulary.alternatives, strict=True))]
    return F.coalesce(*hits, F.lit(UNPARSED))


def label_of(pred: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    names = F.array(*[F.lit(x) for x in vocabulary.labels])
    return F.when(pred >= 0, F.get(names, pred)).otherwise(F.lit(UNPARSED_LABEL))


def chat(label_name: Column | None = None, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Messages of a training example, or of an inference example without a label."""

    def part(kind: str, text: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    def turn(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    user = turn("user", part("image"), part("text", F.lit(vocabulary.prompt)))
    return F.array(user) if label_name is None else F.array(user, turn("assistant", part("text", label_name)))


def messages_text(messages: Column) -> Column:
    """Messages in one line for comparison: role, then parts, all delimited."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("["), F.array_join(F.transform(m["content"], lambda c: F.concat(c["type"], F.lit("="), F.coalesce(c["text"], F.lit("")))), ","), F.lit("]"))), ";")


def strip_space(path: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces alone)."""
    return F.regexp_replace(path, r"^\s+|\s+$", "")


def resolve_path(path: Column, root: str) -> Column:
    """The path itself if absolute, else under ``root`` with ``.`` and ``..``
    segments resolved."""
    bare = strip_space(path)
    parts = F.filter(F.split(F.concat(F.lit(root.rstrip("/") + "/"), bare), "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), F.array_join(stack, "/")))


def is_unsafe_member(path: Column) -> Column:
    """Whether an archive member would land outside its output folder."""
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")),
        lambda s: s["least"],
    )
    return F.startswith(path, F.lit("/")) | (depth < 0)


def factor_kind(key: Column) -> Column:
    """``A``, ``B`` or null, by what an adapter key holds."""
    return F.when(F.contains(key, F.lit(".lora_A.")), "A").when(F.contains(key, F.lit(".lora_B.")), "B")


def base_key(key: Column) -> Column:
    """An adapter key without its factor mark: the first ``A`` mark, else the
    first ``B`` mark, becomes a dot; null if there is none."""
    for_a, for_b = F.split(key, r"\.lora_A\.", 2), F.split(key, r"\.lora_B\.", 2)
    return F.when(F.size(for_a) > 1, F.array_join(for_a, ".")).when(F.size(for_b) > 1, F.array_join(for_b, "."))


def strip_model_prefix(key: Column) -> Column:
    return F.regexp_replace(key, r"^model\.", "")


def add_model_prefix(key: Column) -> Column:
    return F.concat(F.lit("model."), key)


def preview(response: Column, most: int = 240) -> Column:
    return F.when(F.length(response) > most, F.concat(F.substring(response, 1, most), F.lit("..."))).otherwise(response)


def bracket_groups(text: Column) -> Column:
    """All ``[...]`` groups, brackets included."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]"), F.lit(0))


def parse_ranks(text: Column) -> Column:
    """Whole numbers of a comma-separated list; blanks are skipped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: strip_space(x)), lambda x: x != ""), lambda x: x.cast("int"))


def mask_tokens(ids: Column, ignored: list[int]) -> Column:
    return F.transform(ids, lambda x: F.when(x.isin(ignored), F.lit(IGNORED_TOKEN)).otherwise(x))


def pad_tokens(ids: Column, length: Column, pad: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def hash_order(key: Column, seed: int) -> Column:
    """The text by which rows are put in a random order that every engine and
    every partitioning gives alike. A null key counts as an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
