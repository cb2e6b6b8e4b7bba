"""The token vault: issue tokens, scrub texts, resolve tokens, re-find known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import patterns as P
from hushlake.operators.contains import candidate_values, present_values
from hushlake.operators.joins import dealt
from hushlake.operators.ordered import ROWS_PER_CHUNK, ordered, seq_chunk
from hushlake.plans.storage import materialize


def vault_build(sightings: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """One row per distinct ``(session, kind, value)`` with a stable ``[KIND_n]`` token.

    Numbers follow first-seen order inside ``(session, kind)``.  A value is blocked
    when it is a secret or was ever classified as one.  Sightings are folded to one
    row per ``(session, value)`` by partial aggregation before anything is ordered.
    ``width`` is the span of ``seq`` one numbering task handles.
    """
    kinds = list(P.KINDS)
    firsts = [F.min(F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in kinds]
    per_value = sightings.groupBy("session_id", "value").agg(*firsts)
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("first_seq")) for k in kinds]),
        lambda e: e["first_seq"].isNotNull(),
    )
    first = per_value.select("session_id", "value", F.col("SECRET").isNotNull().alias("blocked"), F.inline(entries))
    numbered = ordered(
        first, ["session_id", "kind"], ["first_seq"], seq_chunk(F.col("first_seq"), width), number="number"
    )
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    return numbered.select(
        "session_id", "kind", "value", token.alias("token"), "number", "first_seq", "blocked"
    )


def scrub_names(vault: DataFrame) -> DataFrame:
    """The token each value is shown as: its SECRET token, else the first one issued."""
    secret = (F.col("kind") == "SECRET").cast("int")
    return vault.groupBy("session_id", "value").agg(
        F.min_by("token", F.struct((1 - secret).alias("rank"), F.col("first_seq"))).alias("token")
    )


def quoted(value: Column) -> Column:
    """A regular expression that matches exactly this value."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def interleave(text: Column, pattern: Column, replacement: Column) -> Column:
    """Replace every match of ``pattern`` by its entry in the ``replacement`` map, in one pass."""
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, pattern, -1)
    filled = F.concat(
        F.transform(matched, lambda m: F.coalesce(F.try_element_at(replacement, m), m)), F.array(F.lit(""))
    )
    return F.array_join(F.zip_with(parts, filled, lambda a, b: F.concat(a, b)), "")


def vault_scrub(texts: DataFrame, vault: DataFrame, row_id: str = "text_id", text: str = "text") -> DataFrame:
    """Replace known values by their tokens: longest value first, leftmost, never overlapping.

    Adds ``scrubbed`` and ``hits`` (number of distinct known values found).  Only the
    values present in a text travel to it, so the vault may be larger than any task.
    """
    names = materialize(scrub_names(vault), "names")
    found = candidate_values(texts, names, ["session_id"], [row_id], text=text).join(dealt(names), ["session_id", "value"])
    entry = F.struct((-F.length("value")).alias("n"), "value", "token")
    per_text = found.groupBy("session_id", row_id).agg(F.array_sort(F.collect_list(entry)).alias("_known"))
    joined = (
        texts.join(dealt(per_text), ["session_id", row_id], "left")
        .withColumn("_known", F.filter("_known", lambda k: F.contains(F.col(text), k["value"])))
        .withColumn("hits", F.coalesce(F.size("_known"), F.lit(0)))
    )
    known = F.col("_known")
    pattern = F.array_join(F.transform(known, lambda k: quoted(k["value"])), "|")
    names_map = F.map_from_entries(F.transform(known, lambda k: F.struct(k["value"], k["token"])))
    replaced = F.when(F.col("hits") > 0, interleave(F.col(text), pattern, names_map)).otherwise(F.col(text))
    return joined.select(*[F.col(c) for c in texts.columns], replaced.alias("scrubbed"), "hits")


def full_scrub(texts: DataFrame, vault: DataFrame, row_id: str = "text_id", text: str = "text", extra=()) -> DataFrame:
    """Known values first, then patterns and labelled values."""
    out = vault_scrub(texts, vault, row_id, text)
    return out.withColumn("scrubbed", P.pattern_scrub(F.col("scrubbed"), extra=extra))


def resolve_tokens(texts: DataFrame, vault: DataFrame, row_id: str = "text_id", text: str = "text") -> DataFrame:
    """Put issued values back in place of tokens; one blocked or unknown token fails the whole text.

    Adds ``resolved`` (NULL on failure), ``reason`` (of the first failing token) and ``tokens``.
    """
    uses = texts.select("session_id", row_id, F.posexplode(P.tokens_in(F.col(text))).alias("pos", "token"))
    issued = vault.select("session_id", "token", "value", "blocked")
    looked = uses.join(issued, ["session_id", "token"], "left")
    reason = F.when(F.col("blocked"), "blocked_token").when(F.col("value").isNull(), "unknown_token")
    per_text = looked.groupBy("session_id", row_id).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.min(F.when(reason.isNotNull(), F.struct("pos", reason.alias("reason"))))["reason"].alias("reason"),
        F.collect_set(F.when(reason.isNull(), F.struct("token", "value"))).alias("_map"),
    )
    joined = texts.join(per_text, ["session_id", row_id], "left")
    filled = interleave(F.col(text), F.lit(P.TOKEN), F.map_from_entries("_map"))
    return joined.select(
        *[F.col(c) for c in texts.columns],
        F.when(F.col("tokens").isNull(), F.col(text)).when(F.col("reason").isNull(), filled).alias("resolved"),
        F.coalesce("reason", F.lit("ok")).alias("reason"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def known_kind(findings: DataFrame, by: str = "seq", extra: Sequence[Column] = ()) -> DataFrame:
    """Per session and value: the kind it is known as, whether it is an explicit secret, and ``extra`` aggregates.

    The last non-secret kind wins, SECRET is sticky.
    """
    explicit = F.col("explicit_secret") if "explicit_secret" in findings.columns else F.lit(False)
    secret = F.col("kind") == "SECRET"
    return findings.groupBy("session_id", "value").agg(
        F.when(F.bool_or(secret), "SECRET").otherwise(F.max_by("kind", by)).alias("kind"),
        F.bool_or(explicit).alias("explicit_secret"),
        *extra,
    )


def blocked_as_of(sightings: DataFrame) -> DataFrame:
    """Whether a value was already classified as a secret when it was sighted."""
    since = (
        sightings.filter(F.col("kind") == "SECRET")
        .groupBy("session_id", "value")
        .agg(F.min("seq").alias("_secret_from"))
    )
    blocked = F.coalesce(F.col("seq") >= F.col("_secret_from"), F.lit(False))
    return sightings.join(since, ["session_id", "value"], "left").withColumn("blocked", blocked).drop("_secret_from")


def vault_rematch(regions: DataFrame, known: DataFrame, min_fragment: int = 4) -> DataFrame:
    """Regions whose re-flowed text contains a known value, or one of its lines of ``min_fragment``+ characters.

    ``known(session_id, kind, value, explicit_secret)``.  Helper phrases known as
    secrets are skipped unless they were explicitly labelled.  Where ``known`` has a
    frame ``since``, only later frames count.
    """
    since = ["since"] if "since" in known.columns else []
    usable = known.filter(~((F.col("kind") == "SECRET") & P.is_helper(F.col("value")) & ~F.col("explicit_secret")))
    lines = F.filter(
        F.transform(F.split("value", P.LINE_END, -1), P.strip), lambda v: F.length(v) >= min_fragment
    )
    fragments = usable.select(
        "session_id",
        "kind",
        F.col("value").alias("_known"),
        *since,
        F.explode(F.array_distinct(F.concat(F.array("value"), lines))).alias("_fragment"),
    ).withColumn("_fragment", P.compact_key(F.col("_fragment")))
    fragments = materialize(fragments, "fragments")
    compact = regions.select(
        "session_id", "frame_id", "region_id", P.compact_key(P.strip(F.col("text"))).alias("_compact")
    )
    found = present_values(
        compact, fragments, ["session_id"], ["frame_id", "region_id"], text="_compact", value="_fragment"
    )
    met = found.join(dealt(fragments), ["session_id", "_fragment"])
    hits = (
        (met.filter(F.col("frame_id") > F.col("since")) if since else met)
        .select("session_id", "frame_id", "region_id", "kind", F.col("_known").alias("value"))
        .distinct()
    )
    return regions.join(dealt(hits), ["session_id", "frame_id", "region_id"])


def frame_manifest(masks: DataFrame) -> DataFrame:
    """Distinct tokens of a frame in first-mask order with their generic label.

    ``masks(session_id, frame_id, pos, token, kind)``; a frame's tokens are folded
    before they are ordered.
    """
    first = masks.groupBy("session_id", "frame_id", "token", "kind").agg(F.min("pos").alias("pos"))
    item = F.struct("pos", "token", "kind", P.kind_title(F.col("kind")).alias("label"))
    per_frame = first.groupBy("session_id", "frame_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    public = F.transform("_items", lambda i: F.struct(i["token"].alias("token"), i["kind"].alias("kind"), i["label"].alias("label")))
    return per_frame.select("session_id", "frame_id", public.alias("manifest"))


def private_sort(items: DataFrame, max_items: int = 40, max_chars: int = 500) -> DataFrame:
    """Order a request's tokens by their hidden values; only tokens and ranks come out.

    ``items(request_id, token, value)``.  A request over the limits, or with values
    that do not map to one token each, is denied and returns no tokens.
    """
    checks = items.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("token").alias("tokens"),
        F.count_distinct("value").alias("values"),
        F.max(F.length("value")).alias("chars"),
    )
    reason = (
        F.when(F.col("n") > max_items, "too_many_items")
        .when(F.col("chars") > max_chars, "value_too_long")
        .when((F.col("tokens") < F.col("n")) | (F.col("values") < F.col("n")), "ambiguous_items")
        .otherwise("completed")
    )
    verdict = checks.select("request_id", reason.alias("reason"))
    allowed = verdict.filter(F.col("reason") == "completed")
    # At most ``max_items`` rows per allowed request reach the sort.
    sorted_tokens = (
        items.join(allowed, "request_id")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("value", "token"))).alias("_items"))
        .select("request_id", F.posexplode("_items").alias("pos", "item"))
        .select("request_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("item.token").alias("token"))
    )
    return verdict.join(sorted_tokens, "request_id", "left")


def private_select(items: DataFrame, count: int, max_items: int = 40, max_chars: int = 500) -> DataFrame:
    """First ``count`` tokens of the hidden order; a count above the items is denied."""
    ranked = private_sort(items, max_items, max_chars)
    sizes = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    denied = (F.col("reason") == "completed") & (F.col("_n") < count)
    kept = ranked.join(sizes, "request_id").filter(denied | F.col("rank").isNull() | (F.col("rank") <= count))
    return kept.select(
        "request_id",
        F.when(denied, "count_too_large").otherwise(F.col("reason")).alias("reason"),
        F.when(~denied, F.col("rank")).alias("rank"),
        F.when(~denied, F.col("token")).alias("token"),
    ).distinct()


def compute_result_check(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Tokens an answer invents, repeats or leaves out, per request.

    Both inputs are ``(request_id, token)``; an exact permutation yields no rows.
    """
    left = asked.groupBy("request_id", "token").agg(F.count(F.lit(1)).alias("asked"))
    right = answered.groupBy("request_id", "token").agg(F.count(F.lit(1)).alias("answered"))
    both = left.join(right, ["request_id", "token"], "full_outer").fillna(0, ["asked", "answered"])
    problem = (
        F.when(F.col("asked") == 0, "unknown")
        .when(F.col("answered") == 0, "missing")
        .when(F.col("answered") > F.col("asked"), "duplicate")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("request_id", "token", "problem")
