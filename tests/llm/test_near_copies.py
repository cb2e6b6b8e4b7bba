import random

import pytest
from pyspark.sql import functions as F

from hushlake.llm.components import keep_rows, text_hash
from hushlake.llm.paragraphs import drop_repeated_paragraphs
from hushlake.llm.simhash import drop_near_duplicates
from tests.llm.conftest import documents, words


def shingles(parts):
    return {tuple(parts[k : k + 5]) for k in range(len(parts) - 4)}


def edited(parts, low, high, seed):
    """A copy with single words replaced until its Jaccard similarity is from ``low`` to ``high``."""
    rng, copy = random.Random(seed), list(parts)
    while True:
        copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        a, b = shingles(parts), shingles(copy)
        likeness = len(a & b) / len(a | b)
        if likeness <= high:
            return copy if likeness >= low else edited(parts, low, high, seed + 1000)


def test_planted_near_copies_go_and_less_alike_texts_stay(spark):
    rows = []
    for n in range(60):
        base = words(n, 150 + 10 * n)
        low, high = [(0.8, 0.84), (0.84, 0.9), (0.9, 0.97), (0.6, 0.75)][n % 4]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(edited(base, low, high, n)))]
    kept = sorted(r.doc_id for r in drop_near_duplicates(documents(spark, rows)).collect())
    assert kept == [i for i, _ in rows if i % 2 == 0 or i // 2 % 4 == 3]


@pytest.mark.parametrize("block", [1024, 3])
def test_chains_of_edits_and_short_texts(spark, monkeypatch, block):
    monkeypatch.setattr("hushlake.llm.components.BLOCK", block)
    base = words(7, 100)
    rows = [(n, " ".join([*words(8, n), *base[n:]])) for n in range(20)]  # one more word each
    rows += [(30, "One two"), (31, "one  TWO"), (32, "one three"), (33, "a b c d"), (34, "a b c d e"), (35, ""), (36, None)]
    kept = sorted(r.doc_id for r in drop_near_duplicates(documents(spark, rows)).collect())
    assert kept == [0, 30, 32, 33, 34, 35]


def test_one_row_of_each_class_whatever_its_id(spark):
    a, b, c, d = (" ".join(words(n, 80)) for n in (1, 2, 3, 4))
    # 1 names two classes; copies without an id go, also those of a named document
    rows = [(1, a), (1, b), (2, max(a, b)), (3, min(a, b)), (None, a), (None, c), (None, c), (None, c.upper()), (5, d), (5, d)]
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, min(c, c.upper())), (5, d)], key=str)


def test_columns_of_any_name_are_kept(spark):
    names = ("_class", "_kept_id", "_Kept_Hash", "_copy", "_gone", "_of", "__of")
    text = " ".join(words(5, 80))
    docs = documents(spark, [(1, text), (2, text), (3, "another text of five words")])
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    for drop in (drop_near_duplicates, drop_repeated_paragraphs, lambda d: keep_rows(d, d.select("doc_id", text_hash(d["text"]).alias("text_hash")))):
        out = drop(docs)
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {("own",) * len(names)}
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [1, 3]
