"""Checks over request records: receipt chains, tool results, images, leaks, totals.

Each check reports every failure as a fixed reason code.  The preceding record of
a run comes from ``ordered``, so a run with a huge share of the records is not
pulled into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.operators.contains import present_values
from hushlake.operators.ordered import ROWS_PER_CHUNK, even_chunk, ordered, seq_chunk
from hushlake.plans.storage import materialize

TURN_LIMIT = 35  # fixed value
MINIMUM_FRAMES = 2  # fixed value


def with_previous(requests: DataFrame, columns: list[str], width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``previous`` (struct of ``columns`` of the preceding record of the run, NULL at the root)."""
    chunk = seq_chunk(F.col("step"), width)
    return ordered(requests, ["run_id"], ["step"], chunk, lag={"previous": F.struct(*columns)})


def chain_reason() -> Column:
    """Whether a record continues the receipt of ``previous``; an empty name is none."""
    root = F.col("previous").isNull()
    named = F.nullif(F.col("previous_response_id"), F.lit(""))
    before = F.nullif(F.col("previous.response_id"), F.lit(""))
    return (
        F.when(root & named.isNotNull(), "unaudited_history")
        .when(root & F.col("result_call_id").isNotNull(), "root_has_results")
        .when(~root & (named.isNull() | ~named.eqNullSafe(before)), "broken_link")
        .otherwise("ok")
    )


def tool_reason() -> Column:
    """Whether ``results`` are exactly the calls of ``previous``; a NULL array or entry of a follow-up is never ``ok``."""
    expected = F.transform(
        F.col("previous.calls"), lambda c: F.struct(c["call_id"].alias("call_id"), F.concat(c["type"], F.lit("_output")).alias("type"))
    )
    actual = F.col("results")
    nameless = lambda arr: F.exists(arr, lambda c: F.coalesce(c["call_id"], F.lit("")) == "")
    return (
        F.when(F.col("previous").isNull(), F.when(F.size(actual) > 0, "root_has_results").otherwise("ok"))
        .when(expected.isNull() | (F.size(expected) == 0), "no_preceding_calls")
        .when(actual.isNull(), "results_differ")
        .when(nameless(expected), "call_identity_missing")
        .when(nameless(actual), "result_identity_missing")
        .when(F.size(F.array_distinct(expected)) < F.size(expected), "duplicate_calls")
        .when(~F.sort_array(expected).eqNullSafe(F.sort_array(actual)), "results_differ")
        .otherwise("ok")
    )


def chain_link(requests: DataFrame) -> DataFrame:
    """Each follow-up must name the receipt just before it; a root must name none."""
    return with_previous(requests, ["response_id"]).withColumn("reason", chain_reason())


def tool_result_match(requests: DataFrame) -> DataFrame:
    """Results of a follow-up must be exactly the calls of the record before it.

    ``calls`` and ``results`` are arrays of ``(call_id, type)``.
    """
    return with_previous(requests, ["calls"]).withColumn("reason", tool_reason())


def frame_changed(requests: DataFrame) -> DataFrame:
    """Follow-ups with what was proposed before them and whether the frame changed."""
    linked = with_previous(requests, ["response_id", "frame_hash", "call_type"]).filter(F.col("previous").isNotNull())
    return linked.select(
        "run_id",
        "step",
        F.col("previous.response_id").alias("after_response_id"),
        (F.col("frame_hash") != F.col("previous.frame_hash")).alias("frame_changed"),
        F.col("previous.call_type").alias("proposed"),
    )


def image_match(recorded: Column, images: Column) -> Column:
    """Recorded frame against the payload's images."""
    return (
        F.when(images.isNull() | (F.size(images) == 0), "no_payload_image")
        .when(recorded.isNull(), "no_recorded_image")
        .when(~F.coalesce(F.array_contains(images, recorded), F.lit(False)), "recorded_not_sent")
        .when(F.size(unaudited_images(recorded, images)) > 0, "additional_image")
        .otherwise("ok")
    )


def unaudited_images(recorded: Column, images: Column) -> Column:
    """Distinct payload images other than the recorded one."""
    return F.array_except(images, F.array(recorded))


def leak_scan(strings: DataFrame, private: DataFrame) -> DataFrame:
    """Exported strings that contain a private value of their run; no rows means no leak.

    ``strings(run_id, step, pos, text)`` without the images, ``private(run_id, value)``.
    """
    return present_values(strings, private, ["run_id"], ["step", "pos"])


def duplicate_ids(requests: DataFrame) -> DataFrame:
    """Request or response ids used more than once in a run."""
    ids = requests.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit("request_id").alias("field"), F.col("request_id").alias("id")),
                F.struct(F.lit("response_id").alias("field"), F.col("response_id").alias("id")),
            )
        ),
    ).filter(F.col("id").isNotNull())
    return ids.groupBy("run_id", "field", "id").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > 1)


def distinct_frames(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("status").isin("sent", "responded")).select("run_id", "frame_hash").distinct()


SENT = ("sent", "responded")


def record_codes() -> Column:
    """What one sent record lacks, as an array of codes.

    ``images`` are the digests of the payload's images, ``image_hash`` that of the recorded image as decoded,
    ``frame_hash`` the recorded digest.
    """
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    shown, sent = F.col("images"), F.col("image_hash")
    none = shown.isNull() | (F.size(shown) == 0)
    codes = {
        "missing_response": F.col("status") != "responded",
        "missing_request_id": blank("request_id"),
        "missing_response_id": blank("response_id"),
        "missing_model": blank("response_model"),
        "missing_usage": F.col("input_tokens").isNull(),
        "missing_payload": F.col("payload").isNull(),
        "missing_payload_image": none,
        "missing_image": sent.isNull(),
        "image_mismatch": ~none & sent.isNotNull() & ~F.coalesce(F.array_contains(shown, sent), F.lit(False)),
        "frame_hash_mismatch": sent.isNotNull() & ~sent.eqNullSafe(F.col("frame_hash")),
    }
    return F.array_compact(F.array(*[F.when(F.col("status").isin(*SENT) & wrong, code) for code, wrong in codes.items()]))


def evidence_summary(requests: DataFrame, minimum_frames: int = MINIMUM_FRAMES) -> DataFrame:
    """Per run: what was answered, how many different frames were demonstrably sent, and what is missing.

    Needs the columns of :func:`record_codes`.
    """
    sent = F.col("status").isin(*SENT)
    proven = sent & F.array_contains("images", F.col("image_hash")) & (F.col("image_hash") == F.col("frame_hash"))
    named = F.when(sent, F.nullif(F.col("request_id"), F.lit("")))
    totals = requests.withColumn("_codes", record_codes()).groupBy("run_id").agg(
        F.count_if(sent).alias("responded"),
        F.count_distinct(F.when(proven, F.col("image_hash"))).alias("distinct_frames"),
        F.array_distinct(F.flatten(F.collect_set("_codes"))).alias("_codes"),  # as many sets as there are kinds of faults
        (F.count(named) - F.count_distinct(named)).alias("duplicate_requests"),
    )
    of_run = F.array(
        F.when(F.col("responded") < minimum_frames, "insufficient_sent"),
        F.when(F.col("distinct_frames") < minimum_frames, "insufficient_frames"),
        F.when(F.col("duplicate_requests") > 0, "duplicate_request"),
    )
    issues = F.array_join(F.array_sort(F.concat("_codes", F.array_compact(of_run))), ",")
    return totals.withColumn("issues", issues).drop("_codes")


def usage_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("run_id", "model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("requests"),
    )


def turn_limit(requests: DataFrame, limit: int = TURN_LIMIT) -> DataFrame:
    """The first ``limit`` turns of a run; ``limit_reached`` marks runs that used them all unfinished.

    ``finished`` is a boolean column of the requests.
    """
    turns = Window.partitionBy("run_id").orderBy("step")
    first = requests.select("run_id", "step", "finished").withColumn("turn", F.row_number().over(turns)).filter(F.col("turn") <= limit)
    # At most ``limit`` rows per run are left.
    runs = first.groupBy("run_id").agg(((F.count(F.lit(1)) >= limit) & ~F.bool_or("finished")).alias("limit_reached"))
    return first.join(runs, "run_id").select("run_id", "step", "turn", "limit_reached")


#: What the verdict reads of a record; of the payload only whether there is one.
AUDITED = (
    "run_id", "step", "status", "request_id", "response_id", "response_model", "input_tokens", "payload", "images", "image_hash", "frame_hash",
    "previous_response_id", "result_call_id", "calls", "results", "transmitted", "http_status", "source", "model",
)


def audit_verdict(requests: DataFrame, strings: DataFrame, private: DataFrame, model: str, source: str = "web") -> DataFrame:
    """One row per run with every reason code of its records, links, tool results, images, transport and strings.

    ``requests`` needs the columns of :func:`record_codes`, ``previous_response_id, result_call_id, calls, results,
    transmitted, http_status, source, model``; ``strings`` and ``private`` are those of :func:`leak_scan`.
    """
    requests = materialize(requests.select(*AUDITED).withColumn("payload", F.when(F.col("payload").isNotNull(), "")), "audit")  # read four times
    linked = ordered(requests, ["run_id"], ["step"], even_chunk(requests, ["run_id"], ["step"]), lag={"previous": F.struct("response_id", "calls")})
    good = lambda column: F.coalesce(column, F.lit(False))
    extra = F.size(F.array_except("images", F.array("image_hash"))) > 0
    codes = [
        F.nullif(chain_reason(), F.lit("ok")),
        F.nullif(tool_reason(), F.lit("ok")),
        F.when(~good(F.col("status") == "responded"), "unsuccessful_record"),
        F.when(~good(F.col("source") == source), "other_source"),
        F.when(~good(F.col("transmitted")), "not_transmitted"),
        F.when(~good(F.col("http_status").between(200, 299)), "bad_http_status"),
        F.when(~good(F.col("model") == model), "unexpected_model"),
        F.when(good(extra), "additional_image"),
    ]
    found = linked.select("run_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))
    twice = duplicate_ids(requests).filter("field = 'response_id' AND id <> ''").select("run_id", F.lit("duplicate_response").alias("code"))
    leaks = leak_scan(strings, private).select("run_id", F.lit("private_value").alias("code"))
    every = found.unionByName(twice).unionByName(leaks).groupBy("run_id").agg(F.collect_set("code").alias("_codes"))
    summary = evidence_summary(requests).join(every, "run_id", "left")
    own = F.filter(F.split("issues", ","), lambda c: c != "")
    reasons = F.array_join(F.array_sort(F.array_union(own, F.coalesce("_codes", F.array().cast("array<string>")))), ",")
    return summary.select("run_id", "responded", "distinct_frames", reasons.alias("reasons"), (reasons == "").alias("passed"))
