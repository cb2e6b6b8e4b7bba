import math

import numpy as np
import pytest

from hushlake.llm.onebit import codes_of, nearest, rotation

SCHEMA = "vec_id long, embedding array<float>, rank string, block string, ids string"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # sum() would add more precisely
        total += x * y
    return total


def slow(rows, every=20, k=20):
    known = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known.append((i, [float(np.float32(x)) for x in v]))
    out = []
    for at, (q, x) in enumerate(known):
        if q % every == 0:
            found = [(i, product(x, v)) for n, (i, v) in enumerate(known) if n != at and len(v) == len(x)]
            found.sort(key=lambda x: (-x[1], x[0]))
            out += [(q, n + 1, i, s) for n, (i, s) in enumerate(found[:k])]
    return sorted(out)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(n, rng.normal(size=12).tolist()) for n in range(90)]
    odd = [(100, None), (101, []), (102, [0.0] * 12), (103, [None] + [1.0] * 11), (104, [math.nan] * 12), (105, [math.inf] * 12), (None, [1.0] * 12)]
    odd += [(120, [1.0, 2.0]), (121, [3.0, 1.0]), (122, [3.0, 1.0]), (-20, [2.0, 2.0]), (140, [5.0])]
    odd += [(n, vectors[7][1]) for n in range(200, 260)] + [(60, [9.0] * 12), (3, vectors[3][1])]
    rows = [(*r, "x", "y", "z") for r in [*vectors, *odd]]
    got = sorted(map(tuple, nearest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    assert got == slow(rows)
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(20, [1.0], "", "", "")], SCHEMA)).count() == 0


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(20, [1.0, 0.0]), (5, [3.0, 1.0]), (5, [2.0, 9.0]), (20, [4.0, 0.0])]
    got = sorted(map(tuple, nearest(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()))
    assert got == [(20, 1, 5, 12.0), (20, 1, 20, 4.0), (20, 2, 5, 3.0), (20, 2, 5, 8.0), (20, 3, 5, 2.0), (20, 3, 20, 4.0)]


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr("hushlake.llm.onebit.BLOCK", 300)
    monkeypatch.setattr("hushlake.llm.onebit.TOGETHER", 2)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 48))
    if clusters:
        data += 3 * rng.normal(size=(clusters, 48))[rng.integers(0, clusters, 3000)]
    rows = [(n, v.tolist(), "", "", "") for n, v in enumerate(data.astype(np.float32))]
    got = {tuple(r)[:3] for r in nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {r[:3] for r in slow(rows)}
    assert len(got & want) / len(want) > 0.99


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(5)
    data, asked = rng.normal(size=(500, 64)), rng.normal(size=(50, 64))
    codes, factors = codes_of(data)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    guess = (asked @ rotation(64)) @ signs.T / 8 * factors[:, 0]
    error = np.abs(guess - asked @ data.T) / (np.linalg.norm(asked, axis=1)[:, None] * factors[:, 1])
    assert np.allclose(rotation(64) @ rotation(64).T, np.eye(64)) and (error > 3).mean() < 0.005 and abs((guess - asked @ data.T).mean()) < 0.05
