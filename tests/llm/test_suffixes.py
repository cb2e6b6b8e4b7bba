import random

import numpy as np
import pytest

from hushlake.llm.suffixes import SPAN, drop_repeats, ranks, repeated_spans, samples, without_repeats
from tests.llm.conftest import documents, words


def slow(rows):
    """Removed bytes of each distinct document, by looking every string up among all that start earlier."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    texts = list(dict.fromkeys((i, t) for i, t, *_ in rows))
    frame = SparkSession.getActiveSession().createDataFrame(texts, "doc_id long, text string")
    twins = {(r.doc_id, r.text): r.twin for r in frame.select("*", F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int").alias("twin")).collect()}
    seen, out = set(), {}
    for doc_id, text in sorted(texts, key=lambda d: (d[0] is not None, d[0] or 0, twins[d])):
        blob = (text or "").encode()
        gone = bytearray(len(blob))
        for start in range(len(blob) - SPAN + 1):
            string = blob[start : start + SPAN]
            if string in seen:
                gone[start : start + SPAN] = b"\1" * SPAN
            seen.add(string)
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out[doc_id, text] = (len(blob), sum(gone), runs, bytes(b for b, g in zip(blob, gone, strict=True) if not g))
    return out


def check(spark, rows):
    want = slow(rows)
    got = without_repeats(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (str(i), *want[i, t]) for i, t, *_ in rows
    )


def test_odd_documents(spark, odd_rows):
    check(spark, [r for r in odd_rows if r[0] != 12])


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_shared_passages_with_edits(spark, monkeypatch, crowd):
    monkeypatch.setattr("hushlake.llm.suffixes.CROWD", crowd)
    rng = random.Random(9)
    passages = [" ".join(words(n, 60)) for n in range(4)]
    rows = []
    for n in range(60):
        parts = []
        for _ in range(3):
            passage = rng.choice(passages)
            a = rng.randint(0, len(passage) // 2)
            piece = passage[a : a + rng.randint(60, 300)]
            if rng.random() < 0.5:
                at = rng.randint(0, len(piece) - 1)
                piece = piece[:at] + "É" + piece[at + 1 :]
            parts += [piece, " ".join(words(1000 + n, rng.randint(0, 8)))]
        rows.append((n, "".join(parts)))
    check(spark, rows)


def test_samples_are_the_first_minima():
    rank = np.random.default_rng(1).integers(0, 40, 400, dtype=np.uint64)
    assert samples(rank).tolist() == [i + int(np.argmin(rank[i : i + 51])) for i in range(350)]
    text = np.frombuffer(("ab" * 80 + "c" * 70).encode(), np.uint8)
    named = ranks(text)
    for i in range(0, len(named), 7):
        for j in range(len(named)):
            assert (named[i] == named[j]) == (text[i : i + 50].tobytes() == text[j : j + 50].tobytes())


def test_texts_after_the_cut(spark, odd_documents, no_documents):
    cut = {(r.doc_id, r.n_chars): r.text for r in drop_repeats(odd_documents).collect()}
    assert cut[2, 0] == "" and cut[5, None] is None and drop_repeats(odd_documents).columns == odd_documents.columns
    assert drop_repeats(odd_documents).count() == odd_documents.count()
    assert drop_repeats(no_documents).count() == repeated_spans(no_documents).count() == 0
    # a cut through the two bytes of a letter leaves neither half
    docs = documents(spark, [(1, "ab" * 50 + "ÀÀ"), (2, "ab" * 50 + "Áx")])
    assert drop_repeats(docs).filter("doc_id = 2").first().text in ("Áx", "x")
