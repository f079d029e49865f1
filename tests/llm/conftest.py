import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard string, fp string, row string, cid string, `key of row` string"


def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties,
    repeated ids and repeated rows."""
    rng = random.Random(5)
    words = ["the", "of", "Ándale", "straße", "noël.", "Being,", "x", "über###", "(a|b)", "42", "don't", "😀", "中文"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", ". "]) for _ in range(n))

    passage = text(120)
    texts = [None, "", " ", "\n\n", "a", "word " * 9000, text(20_000), passage, passage, passage + text(50), text(80) + passage, "x" * 5000, "Short one.", "Short one.", "\x00\x01▁ \t tab", "  two  spaces ", *[text(rng.randint(1, 400)) for _ in range(30)]]
    texts.append(texts[-1].replace("the", "The", 1))
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "https://x"][i % 4], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (3, text(30), "en", "a", 7), (None, text(60), "en", None, None), (None, None, None, None, None), (None, passage, "en", "b", 1)]
    return [(*r, "k", "s", "h", "f", "r", "c", "y") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 7 != 0), None) for i in range(60)] + [(None, 1, 0), (3, None, 0), (3, 0, 1), (4, 5, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
