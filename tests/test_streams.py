"""Streams fed in several micro-batches equal the batch operators."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushlake.operators.history import frame_reuse, history_retention
from hushlake.operators.vault import vault_build
from hushlake.plans import fixtures as X
from hushlake.plans.storage import work_dir
from hushlake.streaming import stores as W
from hushlake.streaming.keyed import KeyedTable
from hushlake.streaming.runner import run_batches, table_stream


def stream_of(spark, df, folder, parts, order):
    """Write ``df`` as ordered files and read one file per micro-batch."""
    ranked = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(order)))
    ranked = ranked.persist()
    for n in range(1, parts + 1):
        ranked.filter(F.col("_p") == n).drop("_p").coalesce(1).write.mode("append").parquet(str(folder))
    ranked.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_vault_over_batches(spark, sf_dir, tmp_path):
    seen = X.sightings(spark, sf_dir)
    path = work_dir(spark, "vault")
    stream = W.first_sightings(stream_of(spark, seen, tmp_path / "in", 4, "seq"))
    run_batches(stream, W.vault_writer(path, rows=50), path, "update")
    assert len(list(Path(path).glob("batch=*"))) == 4
    cols = ["session_id", "kind", "value", "token", "first_seq", "blocked"]
    assert as_set(W.read_vault(spark, path).select(*cols)) == as_set(vault_build(seen).select(*cols))


def test_frame_changes_over_batches(spark, sf_dir, tmp_path):
    obs = X.observations(spark, sf_dir).filter(F.col("status") == "ready")
    rows = obs.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "frame_hash")
    path = work_dir(spark, "frames")
    run_batches(stream_of(spark, rows, tmp_path / "in", 3, "event_id"), W.frame_change_writer(path), path)
    got = spark.read.parquet(path).select("session_id", "event_id")
    want = frame_reuse(obs).filter(~F.col("reused")).select("session_id", "event_id")
    assert as_set(got) == as_set(want)


def test_history_over_batches(spark, sf_dir, tmp_path):
    obs = X.observations(spark, sf_dir).filter(F.col("status") == "ready")
    rows = obs.select(F.lit(1).cast("long").alias("session_id"), F.col("event_id").alias("seq"), "frame_hash", "n_bytes")
    schema = "session_id BIGINT, seq BIGINT, frame_hash STRING, n_bytes BIGINT"
    path = work_dir(spark, "history")
    run_batches(stream_of(spark, rows, tmp_path / "in", 3, "seq"), W.history_writer(path, schema), path)
    want = history_retention(rows).select("session_id", "seq", "frame_hash", "n_bytes")
    assert as_set(W.history_table(path, schema).read(spark)) == as_set(want)


@pytest.mark.parametrize("limits", [(128, 64 << 20), (3, 64 << 20), (128, 5), (128, 0)])
def test_retention_limits(spark, limits):
    """The kept suffix is the longest one that fits both limits."""
    sizes = {"a": 2, "b": 3, "c": 1}
    hashes = "abacbbaacb"
    rows = [(1, n, h, sizes[h]) for n, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "session_id int, seq int, frame_hash string, n_bytes int")
    got = sorted(r.seq for r in history_retention(df, *limits).collect())
    best = max(k for k in range(len(hashes) + 1) if k <= limits[0] and sum(sizes[h] for h in set(hashes[len(hashes) - k :])) <= limits[1])
    assert got == list(range(len(hashes) - best, len(hashes)))


def test_rows_without_an_order_enter_the_stream(spark, tmp_path):
    at = [None, float("nan"), float("-inf"), float("inf"), *map(float, range(20)), None]
    spark.createDataFrame([(n, a) for n, a in enumerate(at)], "n long, at double").write.parquet(str(tmp_path / "t.parquet"))
    path = work_dir(spark, "rows")
    run_batches(table_stream(spark, str(tmp_path), "t", F.col("at")), lambda rows, n: rows.write.parquet(f"{path}/batch={n}"), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(len(at)))


def fed(spark, folder, frames, writer, path, mode="append", of=lambda s: s):
    """One file and one run of the query for each frame: the stream is stopped and restarted in between."""
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        run_batches(of(stream), writer(), path, mode)


def test_vault_continues_after_restarts_and_blocks_later(spark, tmp_path):
    rng = random.Random(6)
    kinds = ["NAME", "EMAIL", "SECRET"]
    # a session with most of the values, one without a name, values seen in many batches and again as secrets
    rows = [(rng.choice([1, 1, 1, 2, None]), n, rng.choice(kinds), f"v{rng.randrange(60)}") for n in range(300)]
    schema = "session_id int, seq long, kind string, value string"
    frames = [spark.createDataFrame(rows[at : at + 60], schema) for at in range(0, 300, 60)]
    path = work_dir(spark, "vault")
    fed(spark, tmp_path / "in", frames, lambda: W.vault_writer(path, rows=20), path, "update", W.first_sightings)
    number, first, blocked = {}, {}, set()
    for session, seq, kind, value in rows:
        at = (session, kind, value)
        if at not in first:
            first[at] = seq
            number[at] = sum(k[:2] == at[:2] for k in first)
        if kind == "SECRET":
            blocked.add((session, value))
    want = {(s, k, v, f"[{k}_{number[s, k, v]}]", first[s, k, v], (s, v) in blocked) for s, k, v in first}
    assert as_set(W.read_vault(spark, path)) == want


def test_frames_over_restarts_null_sessions_and_expiry(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), f"h{rng.randrange(2)}", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n * n), n) for n in range(90)]
    frames = [spark.createDataFrame(rows[at : at + 18], W.TAILS) for at in range(0, 90, 18)]

    def kept(expiry):
        last, out = {}, set()
        for session, shown, ts, event in rows:
            old = last.get(session)
            if old is None or old[0] != shown or expiry and ts > old[1] + expiry:
                out.add(event)
            last[session] = (shown, ts)
        return out

    for name, expiry, span in (("plain", None, None), ("expiring", "100 minutes", datetime.timedelta(minutes=100))):
        path = work_dir(spark, name)
        fed(spark, tmp_path / name, frames, lambda e=expiry, p=path: W.frame_change_writer(p, e), path)
        assert {r.event_id for r in spark.read.parquet(path).collect()} == kept(span)


KEYED = "k BIGINT, v STRING, at STRUCT<n: BIGINT, s: STRING>"


def keyed_rows(spark, rows):
    return spark.createDataFrame([(k, v, (n, "s")) for n, (k, v) in enumerate(rows)], KEYED)


def content(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


def test_a_keyed_table_replaces_the_rows_of_its_keys(spark, tmp_path):
    t = KeyedTable(str(tmp_path / "t"), KEYED, ("k",), buckets=4, fold=3)
    assert content(t.read(spark)) == []
    want = {}
    for batch in range(11):
        rows = [(k, f"{batch}-{i}") for k in (None, batch % 3, 7 + batch) for i in range(1 + batch % 2)]
        t.write(keyed_rows(spark, rows), batch)
        for k, _ in rows:
            want[k] = [v for q, v in rows if q == k]
        assert content(t.read(spark)) == sorted(((k, v) for k, vs in want.items() for v in vs), key=repr)
        assert len(t.folders(spark)) <= 1 + t.fold
    some = spark.createDataFrame([(1,), (None,)], "k long")
    assert {r.k for r in t.read(spark, of=some).collect()} >= {1, None}
    # what no manifest needs any more is gone
    names = {p.name for p in Path(t.path).iterdir() if p.name.startswith(("base-", "changes-", "manifest-"))}
    assert len(names) <= 2 * (2 + t.fold) and len([n for n in names if n.startswith("manifest")]) == 2


def test_a_replayed_batch_and_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    t = KeyedTable(str(tmp_path / "t"), KEYED, ("k",), buckets=2, fold=2)
    for batch in range(2):
        t.write(keyed_rows(spark, [(batch, "a"), (9, f"b{batch}")]), batch)
    t.write(keyed_rows(spark, [(9, "b2")]), 2)  # folds into a base
    after = content(t.read(spark))
    t.write(keyed_rows(spark, [(9, "b2")]), 2)
    assert content(t.read(spark)) == after == [(0, "a"), (1, "a"), (9, "b2")]
    assert content(t.read(spark, before=2)) == [(0, "a"), (1, "a"), (9, "b1")]
    for batch in (3, 4):
        t.write(keyed_rows(spark, [(9, f"b{batch}")]), batch)
    monkeypatch.setattr(KeyedTable, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):  # changes and new base are written, the manifest is not
        t.write(keyed_rows(spark, [(9, "b5"), (5, "new")]), 5)
    assert (tmp_path / "t" / "base-5").exists()
    assert content(t.read(spark)) == [(0, "a"), (1, "a"), (9, "b4")]
    monkeypatch.undo()
    t.write(keyed_rows(spark, [(9, "b5"), (5, "new")]), 5)
    assert content(t.read(spark)) == [(0, "a"), (1, "a"), (5, "new"), (9, "b5")]


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    schema = "session_id BIGINT, seq BIGINT, frame_hash STRING, n_bytes BIGINT"
    path = str(tmp_path / "history")
    write, table = W.history_writer(path, schema), W.history_table(path, schema)
    big = spark.range(3000).selectExpr("id AS session_id", "id AS seq", "sha2(CAST(id AS STRING), 256) AS frame_hash", "1L AS n_bytes")
    write(big, 0)
    first = size(f"{path}/changes-0")
    for batch in range(1, 8):
        write(big.filter("session_id < 5").withColumn("seq", F.col("seq") + 10_000 * batch), batch)
        assert size(f"{path}/changes-{batch}") < first / 10
    assert table.read(spark).count() == 3000 + 7 * 5
    before = as_set(table.read(spark))
    write(big.filter("session_id < 5").withColumn("seq", F.col("seq") + 70_000), 7)  # a replay
    assert as_set(table.read(spark)) == before


def test_status_opens_a_bounded_number_of_folders(spark, tmp_path):
    path = str(tmp_path / "status")
    write = W.status_writer(path)
    start = datetime.datetime(2024, 1, 1)
    for batch in range(20):
        rows = [(f"r{batch}", start, "prepared"), (f"r{batch - 1}", start + datetime.timedelta(1), "responded"), ("r0", start, "failed"), (None, start, "prepared")]
        write(spark.createDataFrame(rows, "request_id string, ts timestamp, status string"), batch)
    assert len(W.status_table(path).folders(spark)) <= 1 + W.status_table(path).fold
    got = dict(map(tuple, W.read_status(spark, path).collect()))
    assert got == {"r0": "responded", "r19": "prepared", "r-1": "responded", None: "prepared", **{f"r{n}": "responded" for n in range(1, 19)}}


def test_vault_batches_cost_the_same(spark, tmp_path):
    """What the state of the numbers costs does not grow with the values that were issued."""
    path = work_dir(spark, "vault")
    write = W.vault_writer(path)
    stamp = "timestamp_seconds(1)"
    for batch in range(20):
        values = spark.range(300).selectExpr("1 AS session_id", "'NAME' AS kind", f"concat('v', {batch}, '-', id) AS value", f"id + {batch} * 1000 AS first_seq", f"{stamp} AS since", f"{stamp} AS now")
        write(values, batch)
        table = W._numbers(path)
        assert sum(size(f"{table.path}/{f}") for f in table.folders(spark)) < 30_000
    numbers = [int(r.token[6:-1]) for r in W.read_vault(spark, path).collect()]
    assert sorted(numbers) == list(range(1, 6001))
