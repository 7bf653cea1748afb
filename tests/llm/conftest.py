import random

import pytest

SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
    # names that the operators use themselves
    "tag LONG, id STRING, row_tag STRING, body STRING, block STRING, size STRING, target STRING, copies STRING, digest STRING, position STRING, label STRING"
)


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 7, *["x"] * 10)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n"), row(4, "one two three"), row(5, "one two three", "de", None), row(6, "ONE two  three", None),
        row(7, passage), row(7, passage), row(8, passage + " and a bit"), row(None, passage), row(None, None, None, None),
        row(9, " ".join(rng.choices(words, k=60_000))), row(10, "x" * 300_000), row(11, "a" * 250), row(-3, "été 東京 🙂 \x1c straße"),
        row(2**62, "ties here"), row(2**62 + 1, "ties here"),
    ]
    rows += [row(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for k in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
