"""Batched prediction: a model as a function on batches of records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import label_of, parse_label
from ..vocab import UNPARSED, UNPARSED_LABEL, VOCABULARY, Vocabulary

#: Makes a predictor once in each Python worker; it maps inputs to responses.
Factory = Callable[[], Callable[[list], list[str]]]


def generate(records: DataFrame, factory: Factory, input_col: str, batch: int = 4) -> DataFrame:
    """Adds ``response``: the model's answer to each input, ``batch`` at a time."""
    if batch < 1:
        raise ValueError("a batch has a row at least")
    schema = T.StructType([*records.schema.fields, T.StructField("response", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            model = model or factory()
            inputs = rows.column(rows.schema.get_field_index(input_col)).to_pylist()
            answers = [a for lo in range(0, len(inputs), batch) for a in model(inputs[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], names=[*rows.schema.names, "response"])

    return records.mapInArrow(run, schema)


def respond(factory: Factory, item: object) -> str:
    """The answer to one input: a batch of one, on the driver."""
    return factory()([item])[0]


def label_of_one(factory: Factory, item: object, vocabulary: Vocabulary = VOCABULARY) -> tuple[str, int, str]:
    """(response, class, label) of one input, parsed as ``predictions`` does."""
    response = respond(factory, item)
    found = [i for i, names in enumerate(zip(vocabulary.labels, vocabulary.alternatives, strict=True)) if any(n in response for n in names)]
    return (response, found[0], vocabulary.labels[found[0]]) if found else (response, UNPARSED, UNPARSED_LABEL)


def predictions(responses: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Adds ``pred`` and ``pred_label`` parsed from ``response``."""
    return responses.withColumn("pred", parse_label(F.col("response"), vocabulary)).withColumn("pred_label", label_of(F.col("pred"), vocabulary))


def evaluate(records: DataFrame, models: dict[str, Factory], input_col: str, batch: int = 4, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Every model's predictions on the same records, with a column ``model``."""
    out = None
    for name, factory in models.items():
        one = predictions(generate(records, factory, input_col, batch), vocabulary).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there must be a model")
    return out
