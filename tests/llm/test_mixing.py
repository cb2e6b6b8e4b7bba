import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hushlake.llm.mixing import mixed, mixture, numbered, water_filled
from tests.llm.conftest import documents, words


def filled(sizes, weights, most=3):
    """Targets by clamping and sharing again until nobody is above."""
    total, clamped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        targets = [most * s if i in clamped else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        above = {i for i in range(len(sizes)) if i not in clamped and targets[i] > most * sizes[i]}
        if not above:
            return targets
        clamped |= above


@pytest.mark.parametrize("sizes", [[5], [0, 0], [100, 1, 1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 10_000], [7, 0, 900, 3, 3, 3, 50, 1]])
def test_water_filling(spark, sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    frame = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "i long, source_size long, weight long")
    got = [r.target for r in water_filled(frame).orderBy("i").collect()]
    assert got == pytest.approx(filled(sizes, weights))
    assert sum(got) == pytest.approx(sum(sizes))


def slow(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for doc_id, text, _, source in rows:
        u = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16)
        by[source].append((u, doc_id, size(text)))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[2] for d in by[n]) for n in names]
    out = []
    for name, all_, target in zip(names, sizes, filled(sizes, [i % 3 + 1 for i in range(len(names))]), strict=True):
        wanted = min(3 * all_, int(target + 0.5))
        whole, left = divmod(wanted, all_) if all_ else (0, 0)
        for u in sorted({d[0] for d in by[name]}):
            peers = [d for d in by[name] if d[0] == u]
            together = sum(d[2] for d in peers)
            for _, doc_id, n in peers:
                extra = n if together <= left else n * left // together if left else 0
                out.append((doc_id, n, all_, target, whole * n + extra))
            left = max(0, left - together)
    return sorted(out, key=repr)


def got(docs):
    rows = mixture(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(map(tuple, rows), key=repr)


def test_equals_brute_force(spark, odd_rows):
    rows = [(*r, None, None)[:4] for r in odd_rows]
    rows += [(100 + i, " ".join(words(i, 3 + i)), "en", f"s{i % 7}") for i in range(60)]
    rows += [(500, "same row here", "en", "hot")] * 40 + [(None, "no id at all", "en", "hot")] * 10 + [(600, "Zz " * 5, "en", "é"), (601, "z", "en", "Z")]
    frame, want = got(documents(spark, rows)), slow(rows)
    assert [(r[0], r[1], r[2], r[4]) for r in frame] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in frame] == pytest.approx([r[3] for r in want])
    assert all(r[4] <= 3 * r[1] for r in frame)
    assert frame == got(documents(spark, rows[::-1]))


def test_taken_words_meet_the_target(spark, sf_dir):
    found = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 1


def test_the_mix_has_the_taken_words(spark):
    rows = [(i, " ".join(words(i, 30)) + "\n", "en", "abcdef"[i * i % 6]) for i in range(30)]
    docs = documents(spark, rows).withColumn("mix_id", F.lit("x")).withColumn("mix_copy", F.lit("y"))
    taken = {r.doc_id: r.taken for r in mixture(docs).collect() if r.taken}
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    mix = mixed(docs)
    assert sorted(mix.columns) == sorted(docs.columns)
    assert {r.doc_id: r.n for r in mix.groupBy("doc_id").agg(F.sum(size).alias("n")).collect()} == taken


def test_empty_and_wordless(spark, no_documents):
    assert mixture(no_documents).count() == 0
    rows = mixture(documents(spark, [(1, None, None, "a"), (2, " \n", None, None)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in rows} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_numbers_follow_code_points(spark):
    names = ["b", "a", None, "Z", "", "é", "中", "a b", "𝄞", "￮"]
    rows = numbered(spark.createDataFrame([(n,) for n in names], "s string"), [F.col("s").asc_nulls_last()]).collect()
    want = [*sorted(n for n in names if n is not None), None]
    assert [r.s for r in sorted(rows, key=lambda r: r.nth)] == want
