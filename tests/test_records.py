"""Audit checks: good records pass, each mutation raises exactly its reason."""

import pytest
from pyspark.sql import functions as F

from hushlake.functions import records as R
from hushlake.operators import evidence as E

SCHEMA = (
    "run_id long, step long, request_id string, status string, response_id string, previous_response_id string, result_call_id string, "
    "input_tokens long, frame_hash string, image_hash string, images array<string>, response_model string, payload string, "
    "transmitted boolean, http_status int, source string, model string, calls array<struct<call_id:string,type:string>>, "
    "results array<struct<call_id:string,type:string>>"
)


def run(**changes):
    """Four linked records without fault; ``changes`` go into the third."""
    rows = []
    for n in range(4):
        row = dict(
            run_id=1, step=n, request_id=f"q{n}", status="responded", response_id=f"r{n}", previous_response_id=f"r{n-1}" if n else None,
            result_call_id=f"c{n-1}" if n else None, input_tokens=5, frame_hash=f"h{n}", image_hash=f"h{n}", images=[f"h{n}"],
            response_model="m-1", payload="{}", transmitted=True, http_status=201, source="web", model="m",
            calls=[(f"c{n}", "computer_call")], results=[(f"c{n-1}", "computer_call_output")] if n else [],
        )
        if n == 2:
            row |= changes
        rows.append(row)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def verdict(spark, rows, text="clean"):
    strings = spark.createDataFrame([(1, 0, 0, text)], "run_id long, step long, pos int, text string")
    private = spark.createDataFrame([(1, "hidden value")], "run_id long, value string")
    return E.audit_verdict(frame(spark, rows), strings, private, "m").first()


@pytest.mark.parametrize(
    "change, issue",
    [
        ({}, ""), (dict(input_tokens=None), "missing_usage"), (dict(request_id=None), "missing_request_id"), (dict(response_model=""), "missing_model"),
        (dict(payload=None), "missing_payload"), (dict(images=[]), "missing_payload_image"), (dict(images=None), "missing_payload_image"),
        (dict(images=["other"]), "additional_image,image_mismatch"), (dict(images=["h2", "h9"]), "additional_image"), (dict(frame_hash="h9"), "frame_hash_mismatch"),
        (dict(image_hash=None), "additional_image,missing_image"), (dict(request_id="q1"), "duplicate_request"), (dict(status="sent"), "missing_response,unsuccessful_record"),
        (dict(status="failed"), "unsuccessful_record"), (dict(previous_response_id="r0"), "broken_link"), (dict(previous_response_id=None), "broken_link"), (dict(previous_response_id=""), "broken_link"),
        (dict(results=None), "results_differ"), (dict(results=[]), "results_differ"), (dict(calls=None), "no_preceding_calls"), (dict(transmitted=None), "not_transmitted"),
        (dict(http_status=None), "bad_http_status"), (dict(http_status=302), "bad_http_status"), (dict(source=None), "other_source"), (dict(model="n"), "unexpected_model"),
        (dict(response_id=""), "broken_link,missing_response_id"), (dict(response_id="r0"), "broken_link,duplicate_response"),
    ],
)
def test_verdict(spark, change, issue):
    got = verdict(spark, run(**change))
    assert (got.reasons, got.passed) == (issue, issue == "")


def test_fresh_frames_and_clean_strings_are_required(spark):
    rows = [r | dict(frame_hash="same", image_hash="same", images=["same"]) for r in run()]
    assert verdict(spark, rows).reasons == "insufficient_frames"
    assert verdict(spark, run()[:1]).reasons == "insufficient_frames,insufficient_sent"
    assert verdict(spark, run(), "has a hidden value in it").reasons == "private_value"


@pytest.mark.parametrize("size", [10, 5_000_000])
def test_image_strings_of_any_size_are_blanked(spark, size):
    body = ("A\\/b\\\\" * (size // 6)) + "=="
    text = '{"image_url": "data:image/png;base64,' + body + '", "image_base64":"' + body + '", "note":"x\\"y"}'
    got = spark.createDataFrame([(text,)], "t string").select(R.redact_images(F.col("t"))).first()[0]
    assert got == f'{{"image_url": "{R.IMAGE_MARKER}", "image_base64":"{R.IMAGE_MARKER}", "note":"x\\"y"}}'


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, "ok"), (dict(results=[("c9", "computer_call_output")]), "results_differ"), (dict(results=[]), "results_differ"),
        (dict(results=[("", "computer_call_output")]), "result_identity_missing"),
        (dict(results=[("c1", "function_call_output")]), "results_differ"),
        (dict(results=[("c1", "computer_call_output")] * 2), "results_differ"),
    ],
)
def test_tool_results(spark, change, reason):
    got = {r.step: r.reason for r in E.tool_result_match(frame(spark, run(**change))).collect()}
    assert got == {0: "ok", 1: "ok", 2: reason, 3: "ok"}


def test_tool_result_order_does_not_matter(spark):
    rows = run(results=[("b", "computer_call_output"), ("a", "function_call_output")])
    rows[1]["calls"] = [("a", "function_call"), ("b", "computer_call")]
    assert {r.step: r.reason for r in E.tool_result_match(frame(spark, rows)).collect()}[2] == "ok"
    rows[1]["calls"] = [("a", "function_call")] * 2
    assert {r.step: r.reason for r in E.tool_result_match(frame(spark, rows)).collect()}[2] == "duplicate_calls"


def test_nested_strings(spark):
    schema = "v struct<a:string,b:array<struct<c:string,n:int>>,m:map<string,string>>"
    df = spark.createDataFrame([(("x", [("y", 1), (None, 2)], {"k": "z"}),)], schema)
    kind = df.schema["v"].dataType
    assert df.select(R.strings_of(F.col("v"), kind)).first()[0] == ["a", "x", "b", "c", "y", "n", "n", "m", "k", "z"]
    up = df.select(R.map_strings(F.col("v"), kind, F.upper).alias("v")).first().v
    assert (up.a, [i.c for i in up.b], up.m) == ("X", ["Y", None], {"k": "Z"})


def test_strict_base64(spark):
    png = "iVBORw0KGgo="
    rows = [(png,), ("data:image/png;base64," + png,), (png[:-1],), (png + " ",), ("aGVsbG8=",), ("",)]
    got = [r.s for r in spark.createDataFrame(rows, "v string").select(R.decoded_png(F.col("v"))["status"].alias("s")).collect()]
    assert got == ["ok", "ok", "invalid_base64", "invalid_base64", "not_png", "not_png"]


def test_images_are_redacted(spark):
    text = '{"image_url":"data:image/png;base64,AA\\"A","x":{"image_base64":"BB"},"image_url2":"k","image_url":"https://a"}'
    got = spark.createDataFrame([(text,)], "v string").select(R.redact_images(F.col("v"))).first()[0]
    m = R.IMAGE_MARKER
    assert got == f'{{"image_url":"{m}","x":{{"image_base64":"{m}"}},"image_url2":"k","image_url":"https://a"}}'
