"""Recorded workflows: links between events, evidence, frames, parameters and validation.

All joins are keyed by ``(recording, event)`` or ``(recording, role)``; nothing is
gathered per recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REC = "recording_id"


def expected_values(receipts: DataFrame, expected: str = "expected", receipt: str = "receipt") -> DataFrame:
    """Whether every expected value occurs among the values of the receipt map."""
    missing = F.array_except(F.col(expected), F.coalesce(F.map_values(receipt), F.array().cast("array<string>")))
    return receipts.withColumn("missing", missing).withColumn("verified", F.size("missing") == 0)


def action_links(events: DataFrame) -> DataFrame:
    """Actions with the types of the events before and after them, NULL where the evidence is absent."""
    at = lambda name: events.select(
        F.col(REC), F.col("event_id").alias(f"{name}_event_id"), F.col("type").alias(f"{name}_type")
    )
    actions = events.filter(F.col("type") == "action")
    return actions.join(at("before"), [REC, "before_event_id"], "left").join(at("after"), [REC, "after_event_id"], "left")


def action_status_counts(events: DataFrame) -> DataFrame:
    """Proposed, executed, failed and blocked actions per recording."""
    actions = events.filter(F.col("type") == "action")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return actions.groupBy(REC).agg(*[count(s) for s in ("proposed", "executed", "failed", "blocked")])


def missing_evidence(events: DataFrame, frames: DataFrame) -> DataFrame:
    """References that point at nothing in their own recording: ``(recording_id, event_id, reference, target)``.

    ``frames(recording_id, frame_id)``: a frame of another recording with the same id is no evidence.
    """
    ref = lambda name, col: F.struct(F.lit(name).alias("reference"), F.col(col).alias("target"))
    refs = events.select(REC, "event_id", F.inline(F.array(ref("before", "before_event_id"), ref("after", "after_event_id"))))
    refs = refs.filter(F.col("target").isNotNull())
    known = events.select(REC, F.col("event_id").alias("target"))
    lost_events = refs.join(known, [REC, "target"], "left_anti").withColumn("target", F.col("target").cast("string"))
    shown = events.select(REC, "event_id", F.lit("frame").alias("reference"), F.col("frame_id").alias("target"))
    lost_frames = shown.join(frames.select(REC, F.col("frame_id").alias("target")), [REC, "target"], "left_anti")
    return lost_events.unionByName(lost_frames)


def frame_hashes(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest hashes against the files: ``ok``, ``mismatch``, ``missing_file`` or ``unlisted``.

    Both sides are ``(recording_id, path, sha256)``; paths are relative to their recording.
    """
    both = listed.select(REC, "path", F.col("sha256").alias("_want"), F.lit(True).alias("_listed")).join(
        files.select(REC, "path", F.col("sha256").alias("_have"), F.lit(True).alias("_found")), [REC, "path"], "full_outer"
    )
    status = (
        F.when(F.col("_listed").isNull(), "unlisted")
        .when(F.col("_found").isNull(), "missing_file")
        .when(~F.col("_want").eqNullSafe(F.col("_have")), "mismatch")
        .otherwise("ok")
    )
    return both.select(REC, "path", status.alias("status"))


def bind_parameters(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Recorded tokens to role variables to fresh tokens.

    ``uses(recording_id, token, role_hint)``, ``bindings(recording_id, role, fresh_token)``.
    A token with several roles is ambiguous, a role without a binding needs input, a role
    with several is an ambiguous binding, and a binding that reuses a recorded token is
    stale; none of them is guessed.
    """
    roles = uses.groupBy(REC, "token").agg(F.count_distinct("role_hint").alias("_roles"), F.min("role_hint").alias("role"))
    recorded = uses.select(REC, F.col("token").alias("fresh_token")).distinct().withColumn("_old", F.lit(True))
    fresh = bindings.join(recorded, [REC, "fresh_token"], "left").groupBy(REC, "role").agg(
        F.count_distinct("fresh_token").alias("_given"), F.min("fresh_token").alias("fresh_token"), F.bool_or("_old").alias("_old")
    )
    bound = roles.join(fresh, [REC, "role"], "left")
    status = (
        F.when(F.col("_roles") > 1, "ambiguous_role")
        .when(F.col("fresh_token").isNull(), "missing_binding")
        .when(F.col("_given") > 1, "ambiguous_binding")
        .when(F.col("_old"), "stale_token")
        .otherwise("bound")
    )
    known = F.col("_roles") == 1
    return bound.select(
        REC,
        "token",
        F.when(known, F.col("role")).alias("role"),
        F.when(status == "bound", F.col("fresh_token")).alias("fresh_token"),
        status.alias("status"),
    )


def overlap_windows(events: DataFrame, size: int, overlap: int) -> DataFrame:
    """Events of bounded windows that share ``overlap`` events; one event can be in several."""
    stride = size - overlap
    s = F.col("sequence")
    first = F.greatest(F.lit(0), F.ceil((s - size) / stride)).cast("long")
    last = F.floor((s - 1) / stride).cast("long")
    rows = events.select("*", F.explode(F.sequence(first, last)).alias("window_no"))
    return rows.withColumn("window_id", F.concat_ws("-", REC, "window_no"))


def skill_validation(events: DataFrame, missing: DataFrame, reviews: DataFrame) -> DataFrame:
    """Four separate statuses per recording; none is derived from another.

    ``reviews(recording_id, reviewed, rerun)``.
    """
    lost = missing.groupBy(REC).agg(F.count(F.lit(1)).alias("_lost"))
    check = F.col("type") == "check"
    outcome = events.groupBy(REC).agg(
        F.count_if(check).alias("_checks"), F.count_if(check & (F.col("status") == "failed")).alias("_failed")
    )
    joined = outcome.join(lost, REC, "left").join(reviews, REC, "left")
    return joined.select(
        REC,
        F.when(F.coalesce("_lost", F.lit(0)) > 0, "invalid").otherwise("valid").alias("structure"),
        F.when(F.col("_checks") == 0, "unknown").when(F.col("_failed") > 0, "failed").otherwise("supported").alias("outcome"),
        F.when(F.coalesce("reviewed", F.lit(False)), "reviewed").otherwise("candidate").alias("review"),
        F.when(F.coalesce("rerun", F.lit(False)), "validated_on_fixture").otherwise("not_run").alias("rerun"),
    )


def manifest_reason(m: Column) -> Column:
    """Why a recording manifest is refused; ``ok`` when it may be imported."""
    inside = lambda f: ~F.coalesce(f["path"], F.lit("")).rlike(r"^(/|[A-Za-z]:|\\)|(^|[/\\])\.\.([/\\]|$)|^$")
    return (
        F.when(m["recording_id"].isNull(), "malformed")
        .when(~F.coalesce(m["schema_version"] == "1.0", F.lit(False)), "unsupported_schema")
        .when(~F.coalesce(m["provenance"]["data_class"].isin("synthetic", "sanitized"), F.lit(False)), "unapproved_source")
        .when(~F.coalesce(m["capture_mode"].isin("screenshots_only", "enriched"), F.lit(False)), "unknown_capture_mode")
        .when(~F.coalesce(m["outcome"]["status"].isin("unknown", "passed", "failed", "cancelled"), F.lit(False)), "unknown_outcome")
        .when(F.size(F.coalesce(m["frames"], F.array())) == 0, "no_frames")
        .when(~F.forall(m["frames"], inside), "path_outside_bundle")
        .otherwise("ok")
    )


def bundle_reasons(manifests: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests with a ``reason`` that also covers what they list: events, frame files and their hashes.

    ``files(recording_id, path, sha256)`` are the frame files found; events need ``recording_id``.
    """
    listed = manifests.select(REC, F.inline("frames")).select(REC, "path", "sha256")
    found = frame_hashes(listed, files).groupBy(REC).agg(
        F.bool_or(F.col("status") == "missing_file").alias("_lost"), F.bool_or(F.col("status") == "mismatch").alias("_altered")
    )
    timed = events.select(REC).distinct().withColumn("_timed", F.lit(True))
    joined = manifests.join(found, REC, "left").join(timed, REC, "left")
    reason = (
        F.when(F.col("reason") != "ok", F.col("reason"))
        .when(F.col("_timed").isNull(), "no_events")
        .when(F.coalesce("_lost", F.lit(False)), "missing_frame")
        .when(F.coalesce("_altered", F.lit(False)), "altered_frame")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).select(*manifests.columns)
