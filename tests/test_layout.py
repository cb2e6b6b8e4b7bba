"""Tables laid out by frame: same rows, and plans without an exchange; tasks that follow the regions."""

import re

import pytest

from hushlake.operators import findings as D
from hushlake.operators import joins as J
from hushlake.operators import pairing as G
from hushlake.plans.region_queries import frame_counts, frame_layout
from hushlake.sources.layout import lay_out

SCHEMA = "session_id long, frame_id long, region_id long, text string, x int, y int, width int, height int, bucket string"


@pytest.fixture
def regions(spark):
    texts = ["Password:", "hunter22x", "a.b@mail.example", "a.b@mail.example", "Name: Ines Okafor", "plain"]
    rows = [(s, f, n, t, 10, 10 + 25 * n, 170, 18, "x") for s in (1, 2, None) for f in (0, 1, None) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def found_in(regions):
    cleaned = G.clean(regions)
    return D.line_findings(cleaned).unionByName(D.label_findings(cleaned))


def plan_of(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_those_of_the_input(spark, regions):
    laid = lay_out(regions.unionByName(regions), 4)
    assert laid.columns == regions.columns
    assert sorted(map(str, laid.collect())) == sorted(map(str, regions.collect() * 2))
    assert lay_out(regions.limit(0), 4).collect() == []


def test_chain_of_operators_moves_no_rows(spark, regions):
    found = found_in(regions).unionByName(found_in(regions))
    laid, laid_found = lay_out(regions, 4), lay_out(found, 4)
    expected = frame_counts(regions, found)
    counts = frame_counts(laid, laid_found)
    assert sorted(map(str, counts.collect())) == sorted(map(str, expected.collect()))
    assert counts.count() == counts.filter("regions = 6 and raw = 2 * kept and kinds = 3").count() == 4
    assert "Exchange" not in plan_of(spark, counts)
    assert "Exchange" in plan_of(spark, expected)


def test_a_taken_name_fails(spark, regions):
    lay_out(regions, 4, "layout_taken")
    with pytest.raises(Exception, match="layout_taken"):
        lay_out(regions, 4, "layout_taken")
    spark.sql("DROP TABLE layout_taken")


def strings(df):
    return sorted(map(str, df.collect()))


def test_buckets_and_tasks_follow_the_regions(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name").write.parquet(str(tmp_path / "customer.parquet"))
    expected = strings(frame_layout(spark, str(tmp_path)))
    monkeypatch.setattr(J, "ROWS_A_TASK", 190)
    counts = frame_layout(spark, str(tmp_path))  # 5,700 regions
    assert strings(counts) == expected and len(expected) == 600
    assert set(re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan_of(spark, counts))) == {("30", "30")}
    assert "Exchange" not in plan_of(spark, counts)


def test_few_regions_leave_the_number_to_spark(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_A_TASK", 100)
    cores = spark.sparkContext.defaultParallelism
    assert J.tasks_for(spark.range(0)) == J.tasks_for(spark.range(100 * cores)) == 0
    assert J.tasks_for(spark.range(100 * cores + 1)) == cores + 1


def test_dealt_pairing_finds_the_same(spark, regions):
    texts = ["Shipping address", "Ines Okafor", "47 Harbor Lane", "Dover, DE 19901", "Password", "Forgot password?", "••••••", "12 Old Mill Road"]
    rows = [(s, f, n, t, 17 + 200 * (n % 2), y * 90 + 12 * n, 90, h, "x") for s in (1, None) for f in (0, None) for y in range(4) for n, (t, h) in enumerate(zip(texts, (18, 18, 18, 400, 18, 18, 18, 18)))]
    rows = [(s, f, 10 * k + n, *more) for k, (s, f, n, *more) in enumerate(rows)] + [(3, 1, 5, "Name", None, 10, None, 18, "x"), (3, None, None, "Email", 10, 10, 50, None, "x"), (None, 1, None, "Name", 1, None, 2, 3, "x")]
    many = G.clean(spark.createDataFrame(rows, SCHEMA).unionByName(regions))
    assert strings(G.label_blocks(many, 13)) == strings(G.label_blocks(many, 0))
    found = lambda tasks: D.finding_dedup(D.line_findings(many).unionByName(D.label_findings(many, tasks)), tasks)
    assert strings(found(13)) == strings(found(0)) and found(0).filter("kind = 'ADDRESS'").count() > 0


def test_exchanges_of_dealt_pairing(spark, regions):
    many = G.clean(regions)
    plan = plan_of(spark, D.finding_dedup(D.label_findings(many, 13), 13))
    moves = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", plan)
    # twice the extents of frames are first added up by Spark's own number of tasks; whatever else moves goes to 13
    own = [re.sub(r"#\d+L?", "", keys) for keys, n, _ in moves if n != "13"]
    assert own == ["session_id, frame_id"] * 2
    assert len(moves) == 13 and all(why == "REPARTITION_BY_NUM" for _, n, why in moves if n == "13")
