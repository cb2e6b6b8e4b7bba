"""Policy gates as columns: URLs, keys, actions, token destinations, approvals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions import patterns as P

# ---- fixed values -----------------------------------------------------------
LOOPBACK = ("localhost", "127.0.0.1", "::1")
MODIFIERS = ("CTRL", "CONTROL", "CMD", "COMMAND", "META", "ALT", "SUPER", "WIN")
SELECT_ALL = ("CTRL", "CONTROL", "CMD", "META")
ALLOWED_KEYS = (
    "ENTER", "TAB", "BACKSPACE", "ESC", "ESCAPE", "SPACE", "ARROWDOWN", "ARROWUP", "ARROWLEFT", "ARROWRIGHT",
    "DELETE", "HOME", "END", "PAGEUP", "PAGEDOWN", "SHIFT",
)
KEY_NAMES = {
    "CTRL": "Control", "CONTROL": "Control", "CMD": "Meta", "META": "Meta", "ESC": "Esc", "ENTER": "Enter", "TAB": "Tab",
    "BACKSPACE": "Backspace", "ESCAPE": "Escape", "SPACE": "Space", "ARROWDOWN": "ArrowDown", "ARROWUP": "ArrowUp",
    "ARROWLEFT": "ArrowLeft", "ARROWRIGHT": "ArrowRight", "DELETE": "Delete", "HOME": "Home", "END": "End",
    "PAGEUP": "PageUp", "PAGEDOWN": "PageDown", "SHIFT": "Shift",
}
BUTTONS = ("left", "middle", "right")
UNSAFE_TYPES = ("search", "url", "password", "hidden")
SEARCH_WORDS = r"search|query|\bq\b|url|website"
AUTOCOMPLETE = {
    "email": "EMAIL", "tel": "PHONE", "tel-national": "PHONE", "name": "NAME", "given-name": "NAME",
    "family-name": "NAME", "additional-name": "NAME", "street-address": "ADDRESS", "address-line1": "ADDRESS",
    "address-line2": "ADDRESS", "address-line3": "ADDRESS",
}
TYPE_CLASS = {"email": "EMAIL", "tel": "PHONE"}
# -----------------------------------------------------------------------------


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, NULL when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, user info, host and port text of a URL, all by position."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(netloc, r"^(.*)@", 1)
    place = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = place.startswith("[")
    host = F.when(bracketed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    port = F.when(bracketed, F.regexp_extract(place, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(
        F.regexp_extract(place, r"^[^:]*:(.*)$", 1)
    )
    return {
        "scheme": scheme,
        "has_user": netloc.contains("@"),
        "user": user,
        "host": F.lower(host),
        "bracketed": bracketed,
        "port": port,
    }


def _port_ok(port: Column) -> Column:
    number = F.when(port.rlike(r"^[0-9]{1,9}$"), port.cast("int"))
    return (port == "") | F.coalesce(number <= 65535, F.lit(False))


def _host_ok(host: Column) -> Column:
    """Host labels of 1 to 63 ASCII characters; anything else is refused rather than guessed at."""
    return host.rlike(r"^[\x21-\x7e]+$") & ~host.rlike(r"(^|\.)\.|^\.|[^.]{64,}") | host.contains(":")


def url_reason(url: Column, allow_loopback: bool = False) -> Column:
    """Why a URL may not be opened; ``ok`` for an ordinary HTTPS address."""
    u = url_parts(url)
    scheme = u["scheme"] == "https"
    if allow_loopback:
        scheme = scheme | ((u["scheme"] == "http") & u["host"].isin(*LOOPBACK))
    return (
        F.when(url.isNull() | url.rlike(r"[\x00-\x20]") | url.contains("\\"), "bad_characters")
        .when(~scheme, "not_https")
        .when(u["host"] == "", "no_host")
        .when(u["has_user"], "credentials")
        .when(~_port_ok(u["port"]) | ~_host_ok(u["host"]), "bad_host_or_port")
        .otherwise("ok")
    )


def url_origin(url: Column) -> Column:
    """Canonical origin: lower case, default port dropped, IPv6 bracketed; NULL when malformed."""
    u = url_parts(url)
    number = F.when(u["port"].rlike(r"^[0-9]{1,9}$"), u["port"].cast("int"))
    default = ((u["scheme"] == "https") & (number == 443)) | ((u["scheme"] == "http") & (number == 80))
    host = F.when(u["host"].contains(":"), F.concat(F.lit("["), u["host"], F.lit("]"))).otherwise(u["host"])
    suffix = F.when((u["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    good = _port_ok(u["port"]) & ((u["host"] == "") | _host_ok(u["host"]))
    return F.when(good, F.concat(u["scheme"], F.lit("://"), host, suffix))


def key_chord(keys: Column) -> Column:
    """``(allowed, normalized)`` of a key chord given as an array."""
    upper = F.transform(keys, lambda k: F.upper(k))
    edit = (F.size(upper) == 2) & F.get(upper, 0).isin(*SELECT_ALL) & (F.get(upper, 1) == "A")
    plain = F.forall(upper, lambda k: k.isin(*ALLOWED_KEYS) & ~k.isin(*MODIFIERS))
    valid = keys.isNotNull() & (F.size(keys) > 0) & F.forall(keys, lambda k: k.isNotNull())
    allowed = F.coalesce(valid & (edit | plain), F.lit(False))
    names = F.array_join(F.transform(upper, lambda k: F.coalesce(lookup(KEY_NAMES, k), k)), "+")
    return F.struct(allowed.alias("allowed"), F.when(allowed, names).alias("normalized"))


def _number(action: Column, name: str, required: bool) -> Column:
    """Argument is a finite JSON number (booleans and strings are not)."""
    value = F.try_variant_get(action, f"$.{name}", "variant")
    shape = F.schema_of_variant(value)
    numeric = shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    return F.coalesce(numeric, F.lit(not required))


def action_reason(action: Column) -> Column:
    """Reason code of one proposed action, a JSON object read as VARIANT.

    Token destinations and known values in URLs need the vault and are separate checks.
    """
    text = lambda name: F.when(
        F.schema_of_variant(F.try_variant_get(action, f"$.{name}", "variant")) == "STRING",
        F.try_variant_get(action, f"$.{name}", "string"),
    )
    kind, url, typed = text("type"), text("url"), text("text")
    keys = F.coalesce(F.try_variant_get(action, "$.keys", "array<string>"), F.split(text("keys"), r"\+"))
    button = F.coalesce(F.try_variant_get(action, "$.button", "string"), F.lit("left"))
    point = _number(action, "x", True) & _number(action, "y", True)
    scroll = F.lit(True)
    for name in ("x", "y", "scroll_x", "scroll_y"):
        scroll = scroll & _number(action, name, False)
    private = url.rlike(P.TOKEN) | (P.pattern_scrub(url) != url)
    return (
        F.when(
            kind.isin("navigate", "open", "goto"),
            F.when(url.isNull() | private, "private_url").otherwise(url_reason(url)),
        )
        .when(kind.isin("back", "forward", "reload", "select_tab", "wait", "screenshot"), "ok")
        .when(
            kind == "type",
            F.when(typed.isNull(), "invalid_typing").when(typed.contains("[SECRET_") & typed.rlike(r"\[SECRET_[A-Z_]*\d+\]"), "blocked_secret").otherwise("ok"),
        )
        .when(kind.isin("keypress", "key"), F.when(key_chord(keys)["allowed"], "ok").otherwise("shortcut"))
        .when(kind == "move", F.when(point, "ok").otherwise("invalid_coordinates"))
        .when(
            kind.isin("click", "double_click"),
            F.when(~point, "invalid_coordinates").when(~button.isin(*BUTTONS), "invalid_button").otherwise("ok"),
        )
        .when(kind == "scroll", F.when(scroll, "ok").otherwise("invalid_coordinates"))
        .otherwise("unsupported")
    )


def token_class(token: Column) -> Column:
    """Kind a token was issued for."""
    return F.regexp_extract(token, r"^\[(.*)_[^_]*$", 1)


def destination_reason(field: dict[str, Column], tokens: Column, authorized: Column) -> Column:
    """Why tokens may not be typed into a field; ``ok`` when every check passes.

    ``field`` needs ``origin, visible, focused, editable, type, autocomplete, name, id,
    role, label, search, form_origin, form_method``.
    """
    text = lambda name: F.coalesce(field[name].cast("string"), F.lit(""))
    yes = lambda name: F.coalesce(field[name], F.lit(False))
    identity = F.lower(F.concat_ws(" ", text("name"), text("id"), text("role"), text("label")))
    unsafe = (
        text("type").isin(*UNSAFE_TYPES)
        | yes("search")
        | identity.rlike(SEARCH_WORDS)
        | (text("form_method") == "get")
        | field["form_origin"].isNull()
        | ((text("form_origin") != "") & (text("form_origin") != field["origin"]))
    )
    words = F.filter(F.split(F.lower(text("autocomplete")), r"\s+"), lambda w: w != "")
    permitted = lookup(AUTOCOMPLETE, F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    typed = lookup(TYPE_CLASS, text("type"))
    wanted = F.coalesce(permitted, typed)
    wrong = wanted.isNull() | F.exists(tokens, lambda t: token_class(t) != wanted)
    return (
        F.when(~F.coalesce(authorized, F.lit(False)), "not_authorized")
        .when(~(yes("visible") & yes("focused") & yes("editable")), "not_a_focused_field")
        .when(unsafe, "unsafe_destination")
        .when(typed.isNotNull() & permitted.isNotNull() & (typed != permitted), "ambiguous_field")
        .when(F.coalesce(wrong, F.lit(True)), "class_mismatch")
        .otherwise("ok")
    )


def fixture_reason(url: Column, field_kind: Column, tokens: Column, netloc: Column, path_prefix: str) -> Column:
    """Simpler gate of a sample site: one host, one path, tokens of the field's own kind."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = F.forall(tokens, lambda t: t.startswith(F.concat(F.lit("["), field_kind, F.lit("_"))))
    return (
        F.when((place != netloc) | ~path.startswith(path_prefix), "outside_application")
        .when((F.size(tokens) > 0) & (F.coalesce(field_kind == "", F.lit(True)) | ~own), "token_field_mismatch")
        .otherwise("ok")
    )


def approval(p: dict[str, Column]) -> Column:
    """Decision on a private-value use: ``(decision, reason_code, ttl_seconds, max_uses)``.

    ``p`` needs ``verified, policy_id, origin, field_id, allowed_origins, allowed_fields,
    allowed_classes, pii_class, ttl_seconds, uses, max_ttl_seconds, max_uses``.  The scope
    never exceeds what was asked for or what the policy allows.
    """
    has = lambda arr, v: F.coalesce(F.array_contains(arr, v), F.lit(False))
    reason = (
        F.when(p["policy_id"].isNull(), "MISSING_POLICY")
        .when(~F.coalesce(p["verified"], F.lit(False)), "UNVERIFIED_DESTINATION")
        .when(~has(p["allowed_origins"], p["origin"]), "ORIGIN_NOT_ALLOWED")
        .when(~has(p["allowed_fields"], p["field_id"]), "FIELD_NOT_ALLOWED")
        .when(~has(p["allowed_classes"], p["pii_class"]), "CLASS_NOT_ALLOWED")
        .otherwise("POLICY_MATCH")
    )
    match = reason == "POLICY_MATCH"
    return F.struct(
        F.when(match, "approve").otherwise("deny").alias("decision"),
        reason.alias("reason_code"),
        F.when(match, F.least(p["ttl_seconds"], p["max_ttl_seconds"])).alias("ttl_seconds"),
        F.when(match, F.least(p["uses"], p["max_uses"])).alias("max_uses"),
    )
