import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest

import hushlake.llm.crc as crc
from hushlake.llm.radix import radix_ranked
from hushlake.llm.resampling import importance_ranks, resampled
from hushlake.plans.storage import materialize
from tests.llm.conftest import documents, words


def runs(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(found), [crc32(" ".join(found[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def slow(docs, targets, per_cent):
    """Rows by the rule: doc_id, n_features, weight, score, rank."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(c % 10_000 for c in runs(text)[1])
    for text in targets:
        t.update(c % 10_000 for c in runs(text)[1])
    s_all, t_all = s.total() + 10_000, t.total() + 10_000
    rows = []
    for doc_id, text in docs:
        n, found = runs(text)
        weight = sum(math.floor(1000 * math.log((t[c % 10_000] + 1) * s_all / ((s[c % 10_000] + 1) * t_all))) for c in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * per_cent // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def ranked(docs, target, **settings):
    return importance_ranks(docs, target, **settings).select("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("span", [1, 7, 40, 1 << 20])
def test_checksums_of_runs(monkeypatch, span):
    monkeypatch.setattr(crc, "SPAN", span)
    rng = random.Random(span)
    texts = [None, "", "Ab-c é", "x" * 300 + " Y " + "z" * 600, "ab", "cd", "-ab", "cd\x00ef"]
    texts += ["".join(rng.choice("abAZ09 \n.-_é中ß[`{") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    got, single = [Counter() for _ in texts], [0] * len(texts)
    for text, one, sums in crc.run_checksums(pa.array(texts).slice(0)):
        for at, alone, c in zip(text.tolist(), one.tolist(), sums.tolist(), strict=True):
            got[at][c] += 1
            single[at] += alone
    for text, found, n in zip(texts, got, single, strict=True):
        assert (n, found) == (runs(text)[0], Counter(runs(text)[1]))


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_equals_brute_force(spark, odd_rows, chunk):
    docs = [(r[0], r[1]) for r in odd_rows]
    targets = [" ".join(words(1, 120)[10:60]), None, "", " ".join(words(4, 300))]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    for per_cent in (0, 5, 50, 100):
        got = Counter(map(tuple, ranked(documents(spark, odd_rows), target, per_cent=per_cent, chunk=chunk).collect()))
        assert got == slow(docs, targets, per_cent)


def test_drawn_rows_and_empty_tables(spark, odd_documents, no_documents):
    target = odd_documents.filter("doc_id = 1")
    drawn = resampled(odd_documents, target, per_cent=50)
    assert drawn.columns == odd_documents.columns
    ids = {r.doc_id for r in ranked(odd_documents, target, per_cent=50).collect() if r.rank}
    assert {r.doc_id for r in drawn.collect()} == ids and 1 in ids
    assert ranked(no_documents, target).count() == 0
    assert all(r.rank is None for r in ranked(odd_documents, no_documents, per_cent=0).collect())


@pytest.mark.parametrize("size", [1, 3, 64])
def test_radix_order(spark, size):
    rng = random.Random(size)
    extremes = [-(2**63), 2**63 - 1, 0, -1]
    rows = [(i, rng.choice([*extremes, *range(5)]), rng.randrange(-3000, 3000)) for i in range(150)]
    frame = materialize(spark.createDataFrame(rows, "id long, a long, b long").coalesce(1), "radix")
    got = {r.row: r.rank for r in radix_ranked(frame, "id", [("a", True), ("b", False)], size=size).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    place = {r[0]: i for i, r in enumerate(want, 1)}
    same = {(r[1], r[2]) for r in rows if sum((r[1], r[2]) == (q[1], q[2]) for q in rows) > 1}
    assert sorted(got.values()) == list(range(1, 151))
    assert all(got[r[0]] == place[r[0]] for r in rows if (r[1], r[2]) not in same)
    # rows that are equal keep the order of the table
    order = [r for r in sorted(rows, key=lambda r: got[r[0]])]
    assert order == want


def test_radix_of_equal_rows_and_top(spark):
    frame = materialize(spark.range(10).selectExpr("id", "7L AS a").coalesce(1), "radix")
    assert sorted(map(tuple, radix_ranked(frame, "id", [("a", True)], size=4).collect())) == [(i, i + 1) for i in range(10)]
    assert sorted(map(tuple, radix_ranked(frame, "id", [("id", True)], 3, 4).collect())) == [(7, 3), (8, 2), (9, 1)]
    assert radix_ranked(frame.filter("id < 0"), "id", [("a", True)]).count() == 0
