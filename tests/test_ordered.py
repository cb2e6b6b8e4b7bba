"""Chunked ordered columns equal plain windows, whatever the chunk size."""

import bisect
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushlake.operators import history as H
from hushlake.operators.ordered import even_chunk, ordered, place_among, seq_chunk, time_chunk


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_equals_window(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([1, 1, 1, 2, 3]), s, rng.choice([None, "a", "b"]), rng.randrange(9)) for s in rng.sample(range(-40, 300), 150)]
    df = spark.createDataFrame(rows, "k int, seq long, v string, n int")
    got = ordered(
        df, ["k"], ["seq"], seq_chunk(F.col("seq"), width), number="row", lag={"before": F.col("v")}, lead={"after": F.col("v")},
        last={"seen": F.col("v")}, total={"sum": F.col("n")},
    )
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select(
        "*",
        F.row_number().over(w).cast("long").alias("row"),
        F.lag("v").over(w).alias("before"),
        F.lead("v").over(w).alias("after"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("seen"),
        F.sum("n").over(w).alias("sum"),
    )
    key = lambda r: (r.k, r.seq)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert key


def test_time_chunks_cover_the_range(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    chunks = events.select(time_chunk(events, "ts", rows=100).alias("c")).groupBy("c").count().collect()
    assert 5 <= len(chunks) <= 11
    assert sum(r["count"] for r in chunks) == events.count()


def shapes(rng):
    """Orders that even slices of the range or of the number cut badly."""
    micros = 1_700_000_000_000_000
    return {
        "a stray of 1970": [0, *range(micros, micros + 999)],
        "sparse numbers": [(n << 22) + rng.randrange(1 << 22) for n in range(1000)],
        "a burst": [*range(0, 10**9, 10**7), *range(5 * 10**8 + 1, 5 * 10**8 + 901)],
        "far apart": [*range(-(2**62), 2**62, 2**53)][:1000],
        "dense": list(range(1000)),
    }


@pytest.mark.parametrize("shape", sorted(shapes(random.Random(1))))
def test_even_chunks_of_a_hot_key(spark, shape):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.9 else rng.choice([2, None]), s, rng.choice([None, "a", "b"]), rng.randrange(9)) for s in shapes(rng)[shape]]
    rows += [(2, None, "c", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, seq long, v string, n int")
    chunk = even_chunk(df, ["k"], ["seq"], 100)
    sizes = [r["count"] for r in df.groupBy(chunk.alias("c")).count().collect()]
    assert max(sizes) <= 200 and len(sizes) <= 13
    got = ordered(df, ["k"], ["seq"], chunk, number="row", lag={"before": F.col("v")}, last={"seen": F.col("v")}, total={"sum": F.col("n")})
    w = Window.partitionBy("k").orderBy("seq")
    seen = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = df.select("*", F.row_number().over(w).cast("long").alias("row"), F.lag("v").over(w).alias("before"), seen.alias("seen"), F.sum("n").over(w).alias("sum"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_value_with_most_rows_is_cut_by_the_next_column(spark):
    rng = random.Random(2)
    rows = [(1, 5, n) for n in range(600)] + [(1, None, n) for n in range(250)] + [(rng.choice([1, 2]), rng.randrange(10), 1000 + n) for n in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, ts long, id long")
    chunk = even_chunk(df, ["k"], ["ts", "id"], 50)
    assert max(r["count"] for r in df.groupBy("k", chunk.alias("c")).count().collect()) <= 110
    got = ordered(df, ["k"], ["ts", "id"], chunk, number="row")
    want = df.withColumn("row", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).cast("long"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_place_is_found_among_many_cuts(spark):
    cuts = sorted({random.Random(4).uniform(-1e18, 1e18) for _ in range(5000)})
    values = [None, float("nan"), float("-inf"), float("inf"), 0.0, *cuts[::500], *(c + 1e4 for c in cuts[::700])]
    got = {repr(r.v): r.n for r in spark.createDataFrame([(v,) for v in values], "v double").withColumn("n", place_among(F.col("v"), cuts)).collect()}
    for v in values:
        assert got[repr(v)] == (None if v is None else len(cuts) if v != v else bisect.bisect_right(cuts, v))


def test_times_and_dates_are_ordered_columns(spark):
    df = spark.range(1000).selectExpr("timestamp_seconds(id * id * 1000) AS ts", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS day", "CAST(id AS STRING) AS s")
    for name in ("ts", "day"):
        sizes = [r["count"] for r in df.groupBy(even_chunk(df, [], [name], 100).alias("c")).count().collect()]
        assert max(sizes) <= 200
    with pytest.raises(ValueError, match="string"):
        even_chunk(df, [], ["s"], 100)


def test_latency_sketches_merge_within_their_error(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, None]), rng.random() < 0.5, n * 37, rng.choice([rng.randrange(300), int(rng.expovariate(1e-4)), 2**45, -5, None])) for n in range(4000)]
    frames = spark.createDataFrame(rows, "session_id int, reused boolean, second long, latency_ms long").withColumn("ts", F.timestamp_seconds("second"))
    hours = H.latency_slices(frames)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {(r.session_id, r.reused): r for r in H.latency_of(hours, ["session_id", "reused"], shares).collect()}
    direct = H.latency_slices(frames, size="1000 days")
    assert {tuple(r) for r in H.latency_of(direct, ["session_id", "reused"], shares).collect()} == {tuple(r) for r in got.values()}
    for key, r in got.items():
        times = sorted(max(0, ms) for s, reused, _, ms in rows if (s, reused) == key and ms is not None)
        assert (r.frames, r.total_ms, r.max_ms) == (len(times), sum(times), times[-1])
        for name, share in shares.items():
            exact = times[math.ceil(len(times) * share) - 1]
            assert exact - exact / 128 <= r[name] <= exact and (exact >= 256 or r[name] == exact)
