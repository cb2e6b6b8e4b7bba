import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that operators use inside; a table may have columns of the same names.
CLASHING = ("rank", "cell", "id", "component", "of", "spans", "rest", "text_hash", "count", "label", "draw", "sequence_id", "bits", "host", "kept", "size", "block")
DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in CLASHING),
    ]
)
PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()), StructField("payload", StringType()), StructField("run", StringType())])


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abdeghklmnoprstuvw") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def documents(spark, rows):
    """A table of ``(doc_id, text[, lang[, source]])`` with further columns of clashing names."""
    full = [((*r, None, None)[:4]) for r in rows]
    rows = [(*r, None if r[1] is None else len(r[1]), *("x" for _ in CLASHING)) for r in full]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared ids, copies and near copies."""
    base, other = words(1, 120), words(2, 90)
    near = [*base[:60], "changed", *base[61:]]
    return [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "en", "b"),
        (4, " ".join(other) + "\n" + " ".join(base[:40]), "de", None), (5, None, None, "a"), (6, "", "en", None),
        (7, "   \n\t ", "en", "b"), (8, " ".join(other), "de", "b"), (8, " ".join(other), "de", "b"), (9, "Two words", "en", "b"),
        (9, " ".join(words(3, 70)), "en", "b"), (None, " ".join(base[20:90]), None, "b"), (None, None, None, None),
        (10, "é" * 300 + " " + "é" * 300, "fr", "a"), (11, "x" * 30_000, "en", "a"), (12, " ".join(words(4, 25_000)), "en", "a"),
        (13, "A b. " * 60, "en", "a"), (14, "12 34 ## %%", "en", "a"), (15, "ΑΣ <|endoftext|> 中文 ﬁ　x", "el", "c"), (-3, " ".join(other[:50]), "de", "c"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return documents(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
