"""The class vocabulary, the question, and schemas of records.

The vocabulary is data: every function that needs one takes it as a parameter
and defaults to this one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Class codes, labels, file suffixes, question and token
# ids that results depend on.
CODES = ("ADI", "BACK", "DEB", "LYM", "MUC", "MUS", "NORM", "STR", "TUM")
LABELS = (
    "A: adipose",
    "B: background",
    "C: debris",
    "D: lymphocytes",
    "E: mucus",
    "F: smooth muscle",
    "G: normal colon mucosa",
    "H: cancer-associated stroma",
    "I: colorectal adenocarcinoma epithelium",
)
SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
QUESTION = "What is the most likely tissue type shown in the histopathology image?"
UNPARSED = -1
UNPARSED_LABEL = "<unparsed>"
IGNORED_TOKEN = -100


@dataclass(frozen=True)
class Vocabulary:
    codes: tuple[str, ...] = CODES
    labels: tuple[str, ...] = LABELS

    @property
    def alternatives(self) -> tuple[str, ...]:
        """``(X) description`` for each ``X: description``."""
        return tuple("({}) {}".format(*label.split(": ", 1)) for label in self.labels)

    @property
    def prompt(self) -> str:
        return "\n".join((QUESTION, *self.labels))

    def table(self, spark: SparkSession) -> DataFrame:
        """``code, idx, canonical, alt``: a row a class."""
        rows = [(c, i, a, b) for i, (c, a, b) in enumerate(zip(self.codes, self.labels, self.alternatives, strict=True))]
        return spark.createDataFrame(rows, "code string, idx int, canonical string, alt string")


VOCABULARY = Vocabulary()

RECORD_DDL = "image string, label int, label_name string, raw_label string"
UPDATE_DDL = "round int, client string, params_type string, metrics map<string,double>, meta map<string,double>"
