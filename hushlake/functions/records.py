"""Columns over request records and nested JSON-like values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
PNG_SIGNATURE = "89504E470D0A1A0A"
DATA_URL = "data:image/png;base64,"
IMAGE_MARKER = "[protected frame displayed above]"
API_KEY_MARKER = "[API_KEY_REDACTED]"
LABELS = {
    "rehearsal": "Fixture rehearsal · no model call",
    "prepared": "Prepared locally · not sent",
    "sent": "Sent · awaiting provider response",
    "receipt": "Responded · provider receipt recorded",
    "no_receipt": "Responded status · provider receipt missing",
    "failed": "Failed · inspect the recorded error",
    "legacy": "Legacy record · transmission and provider receipt unverified",
}
# -----------------------------------------------------------------------------


def audit_label(mode: Column, status: Column, response_id: Column) -> Column:
    """What an operator is told about a request record."""
    has_receipt = F.coalesce(response_id != "", F.lit(False))
    return (
        F.when(F.coalesce(mode == "rehearsal", F.lit(False)), LABELS["rehearsal"])
        .when(status == "prepared", LABELS["prepared"])
        .when(status == "sent", LABELS["sent"])
        .when((status == "responded") & has_receipt, LABELS["receipt"])
        .when(status == "responded", LABELS["no_receipt"])
        .when(status == "failed", LABELS["failed"])
        .otherwise(LABELS["legacy"])
    )


def audit_sent(mode: Column, status: Column, transmitted: Column) -> Column:
    """Whether the record proves that something left the machine."""
    sent = status.isin("sent", "responded") | ((status == "failed") & F.coalesce(transmitted, F.lit(False)))
    return F.coalesce(sent & ~F.coalesce(mode == "rehearsal", F.lit(False)), F.lit(False))


def receipt_status(transport_error: Column, http_status: Column, body_is_json: Column, body_id: Column, model: Column) -> Column:
    """Outcome of one transmission, as a fixed code."""
    complete = F.coalesce((body_id != "") & (model != ""), F.lit(False))
    return (
        F.when(F.coalesce(transport_error, F.lit(False)), "network_error")
        .when(F.coalesce(~http_status.between(200, 299), F.lit(True)), "api_error")
        .when(~F.coalesce(body_is_json, F.lit(False)), "invalid_response")
        .when(~complete, "invalid_response")
        .otherwise("responded")
    )


def actions_of(output: Column) -> Column:
    """Proposed actions of a response: every screen action, and function calls with their four keys.

    ``output`` items have ``type, call_id, name, arguments, actions, action``.
    """
    item = lambda kind, call, name, args: F.struct(
        kind.alias("type"), call.alias("call_id"), name.alias("name"), args.alias("arguments")
    )
    nothing = F.lit(None).cast("string")

    def expand(o):
        single = F.when(o["action"].isNotNull(), F.array(o["action"]))
        steps = F.coalesce(o["actions"], single)
        return F.when(
            o["type"] == "computer_call", F.transform(steps, lambda a: item(a["type"], nothing, nothing, nothing))
        ).when(o["type"] == "function_call", F.array(item(o["type"], o["call_id"], o["name"], o["arguments"])))

    return F.flatten(F.filter(F.transform(output, expand), lambda a: a.isNotNull()))


def answer_text(output: Column, scrub, default: str) -> Column:
    """Text parts of message items, one per line, scrubbed; a default when there are none."""
    messages = F.filter(output, lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda o: F.filter(o["content"], lambda p: p["type"] == "output_text")))
    text = scrub(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))
    return F.when(text != "", text).otherwise(default)


def redact_images(json_text: Column) -> Column:
    """JSON text whose image strings are replaced by a marker. Possessive, so the matcher's stack does not grow with them."""
    body = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    out = F.regexp_replace(json_text, rf'("image_url"\s*:\s*)"data:image/{body}"', f'$1"{IMAGE_MARKER}"')
    return F.regexp_replace(out, rf'("image_base64"\s*:\s*)"{body}"', f'$1"{IMAGE_MARKER}"')


def decoded_png(encoded: Column) -> Column:
    """``(status, sha256)`` of a strictly base64-encoded PNG, with or without the data-URL prefix."""
    body = F.when(encoded.startswith(DATA_URL), F.substring(encoded, len(DATA_URL) + 1, 1 << 30)).otherwise(encoded)
    strict = body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0)
    raw = F.when(strict, F.try_to_binary(body, F.lit("base64")))
    png = F.hex(F.substring(raw, 1, 8)) == PNG_SIGNATURE
    return F.struct(
        F.when(raw.isNull(), "invalid_base64").when(~png, "not_png").otherwise("ok").alias("status"),
        F.when(png, F.sha2(raw, 256)).alias("sha256"),
    )


def map_strings(value: Column, dtype: T.DataType, fn) -> Column:
    """Apply ``fn`` to every string inside a nested value; keys are left as they are."""
    if isinstance(dtype, T.StringType):
        return fn(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: map_strings(x, dtype.elementType, fn))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, v: map_strings(v, dtype.valueType, fn))
    if isinstance(dtype, T.StructType):
        fields = [map_strings(value[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def strings_of(value: Column, dtype: T.DataType) -> Column:
    """All strings inside a nested value, keys included; absent members contribute nothing."""
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(dtype, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x: strings_of(x, dtype.elementType)))
        return F.coalesce(inner, none)
    if isinstance(dtype, T.MapType):
        inner = F.flatten(F.transform(F.map_values(value), lambda x: strings_of(x, dtype.valueType)))
        return F.coalesce(F.concat(F.map_keys(value), inner), none)
    if isinstance(dtype, T.StructType):
        parts = [
            F.when(value[f.name].isNotNull(), F.concat(F.array(F.lit(f.name)), strings_of(value[f.name], f.dataType))).otherwise(none)
            for f in dtype.fields
        ]
        return F.concat(*parts)
    return none


def scrub_leaves(value: Column, dtype: T.DataType, scrub, api_key: str | None = None) -> Column:
    """Scrub every string of a nested value; an API key is removed first."""

    def clean(text):
        if api_key:
            text = F.replace(text, F.lit(api_key), F.lit(API_KEY_MARKER))
        return scrub(text)

    return map_strings(value, dtype, clean)
