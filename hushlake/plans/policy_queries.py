"""Policy gates evaluated in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import boxes as B
from hushlake.functions import gates as G
from hushlake.operators import policy as O
from hushlake.operators import vault as V
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans.registry import query
from hushlake.plans.text_queries import scrub_sql
from hushlake.sources.tables import table

FLD = S.with_ctes(S.FIELDS)

# Every page URL in several spellings, so that each rule is exercised.
SPELLED = r"""spelled AS (
  SELECT page_id, CASE page_id % 10
    WHEN 1 THEN regexp_replace(url, '^https?://', 'https://User@') WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\1:8443')
    WHEN 3 THEN regexp_replace(url, '^https?://([^/]+)', 'HTTPS://\1:443') WHEN 4 THEN url || chr(10) WHEN 5 THEN regexp_replace(url, '^(https?://[^/]+)', '\1:bad')
    WHEN 6 THEN 'https://[2001:DB8::1]:8443/' || page_id WHEN 7 THEN 'http://127.0.0.1:9/' || page_id WHEN 8 THEN replace(url, '/', '\') ELSE url END AS url FROM pages)"""
PARTS = r"""parts AS (
  SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM spelled),
  places AS (SELECT *, split_part(netloc, '@', -1) AS place FROM parts),
  hosts AS (SELECT *, lower(CASE WHEN starts_with(place, '[') THEN split_part(place[2:], ']', 1) ELSE split_part(place, ':', 1) END) AS host,
    CASE WHEN starts_with(place, '[') THEN split_part(place, ']:', 2) ELSE split_part(place, ':', 2) END AS port FROM places)"""


def _spelled(spark, sf):
    u, k = F.col("url"), F.col("page_id")
    start = r"^(https?://[^/]+)"
    url = X.pick(
        k % 10,
        {
            1: F.regexp_replace(u, r"^https?://", "https://User@"),
            2: F.regexp_replace(u, start, "$1:8443"),
            3: F.regexp_replace(u, r"^https?://([^/]+)", "HTTPS://$1:443"),
            4: F.concat(u, F.lit("\n")),
            5: F.regexp_replace(u, start, "$1:bad"),
            6: F.concat(F.lit("https://[2001:DB8::1]:8443/"), X.text(k)),
            7: F.concat(F.lit("http://127.0.0.1:9/"), X.text(k)),
            8: F.replace(u, F.lit("/"), F.lit("\\")),
        },
        u,
    )
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query(
    "url_validate",
    S.with_ctes(SPELLED, PARTS)
    + r"""SELECT page_id, CASE WHEN regexp_matches(url, '[\x00-\x20]') OR contains(url, '\') THEN 'bad_characters' WHEN scheme <> 'https' THEN 'not_https'
      WHEN host = '' THEN 'no_host' WHEN contains(netloc, '@') THEN 'credentials' WHEN port <> '' AND NOT coalesce(try_cast(port AS INT) BETWEEN 0 AND 65535, false) THEN 'bad_host_or_port' ELSE 'ok' END AS reason,
      CASE WHEN regexp_matches(url, '[\x00-\x20]') OR contains(url, '\') THEN 'bad_characters' WHEN scheme <> 'https' AND NOT (scheme = 'http' AND host IN ('localhost','127.0.0.1','::1')) THEN 'not_https'
      WHEN host = '' THEN 'no_host' WHEN contains(netloc, '@') THEN 'credentials' WHEN port <> '' AND NOT coalesce(try_cast(port AS INT) BETWEEN 0 AND 65535, false) THEN 'bad_host_or_port' ELSE 'ok' END AS loopback_reason FROM hosts""",
)
def url_validate(spark, sf):
    u = F.col("url")
    return _spelled(spark, sf).select(
        "page_id", G.url_reason(u).alias("reason"), G.url_reason(u, allow_loopback=True).alias("loopback_reason")
    )


ORIGIN = """scheme || '://' || CASE WHEN contains(host, ':') THEN '[' || host || ']' ELSE host END ||
  CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END"""


@query(
    "url_origin",
    S.with_ctes(SPELLED, PARTS) + f"SELECT page_id, CASE WHEN port = '' OR try_cast(port AS INT) BETWEEN 0 AND 65535 THEN {ORIGIN} END AS origin FROM hosts",
)
def url_origin(spark, sf):
    return _spelled(spark, sf).select("page_id", G.url_origin(F.col("url")).alias("origin"))


VISITS = """visits AS (
  SELECT (page_id % 25)::INT AS session_id, page_id AS url_id, CASE page_id % 6 WHEN 1 THEN url || '&to=[EMAIL_1]' WHEN 2 THEN url || '&mail=c' || page_id || '@example.net'
    WHEN 3 THEN url || '&segment=BUILDING' WHEN 4 THEN url || '&k=pw-' || (page_id % 30) ELSE url END AS url FROM pages)"""


@query(
    "private_url_block",
    S.with_ctes(S.SIGHTINGS, S.VAULT, VISITS)
    + f"""SELECT session_id, url_id, CASE WHEN regexp_matches(url, '\\[[A-Z][A-Z_]*_\\d+\\]') THEN 'token'
      WHEN EXISTS (SELECT 1 FROM vault v WHERE v.session_id = visits.session_id AND contains(visits.url, v.value)) THEN 'known_value'
      WHEN {scrub_sql('url')} <> url THEN 'pattern' ELSE 'ok' END AS reason FROM visits""",
)
def private_url_block(spark, sf):
    k, u = F.col("page_id"), F.col("url")
    url = X.pick(
        k % 6,
        {
            1: F.concat(u, F.lit("&to=[EMAIL_1]")),
            2: F.concat(u, F.lit("&mail=c"), X.text(k), F.lit("@example.net")),
            3: F.concat(u, F.lit("&segment=BUILDING")),
            4: F.concat(u, F.lit("&k=pw-"), X.text(k % 30)),
        },
        u,
    )
    visits = table(spark, sf, "pages").select((k % 25).cast("int").alias("session_id"), k.alias("url_id"), url.alias("url"))
    return O.private_url_block(visits, V.vault_build(X.sightings(spark, sf))).select("session_id", "url_id", "reason")


CHORDS = {
    0: "CTRL+A", 1: "ctrl+l", 2: "Enter", 3: "ALT+D", 4: "F6", 5: "Meta+a", 6: "shift+tab", 7: "CTRL+SHIFT+I", 8: "cmd+A",
    9: "ArrowDown", 10: "esc", 11: "PageUp", 12: "", 13: "CONTROL+C",
}
NORMAL = {
    0: "Control+A", 2: "Enter", 5: "Meta+A", 6: "Shift+Tab", 8: "Meta+A", 9: "ArrowDown", 10: "Esc", 11: "PageUp",
}


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


@query(
    "key_chord_gate",
    f"SELECT page_id, {_case('page_id % 14', CHORDS)} AS chord, {_case('page_id % 14', NORMAL)} IS NOT NULL AS allowed, {_case('page_id % 14', NORMAL)} AS normalized FROM pages",
)
def key_chord_gate(spark, sf):
    chord = X.pick(F.col("page_id") % 14, CHORDS, None)
    rows = table(spark, sf, "pages").select("page_id", chord.alias("chord"))
    return rows.select("page_id", "chord", G.key_chord(F.split("chord", r"\+", -1)).alias("k")).select("page_id", "chord", "k.*")


ACTIONS = {
    0: ('{"type":"click","x":5,"y":7}', "ok"),
    1: ('{"type":"click","x":true,"y":7}', "invalid_coordinates"),
    2: ('{"type":"double_click","x":5.5,"y":7,"button":"other"}', "invalid_button"),
    3: ('{"type":"move","x":1}', "invalid_coordinates"),
    4: ('{"type":"scroll","scroll_y":120}', "ok"),
    5: ('{"type":"scroll","x":"5"}', "invalid_coordinates"),
    6: ('{"type":"keypress","keys":["CTRL","A"]}', "ok"),
    7: ('{"type":"keypress","keys":["CTRL","V"]}', "shortcut"),
    8: ('{"type":"key","keys":"enter"}', "ok"),
    9: ('{"type":"type","text":"hello [NAME_1]"}', "ok"),
    10: ('{"type":"type","text":"[SECRET_2]"}', "blocked_secret"),
    11: ('{"type":"type","text":4}', "invalid_typing"),
    12: ('{"type":"navigate","url":"https://example.org/?q=[EMAIL_1]"}', "private_url"),
    13: ('{"type":"goto","url":"https://example.org/?m=a@example.org"}', "private_url"),
    14: ('{"type":"open","url":"http://example.org/"}', "not_https"),
    15: ('{"type":"back"}', "ok"),
    16: ('{"type":"drag"}', "unsupported"),
    17: ('{"type":"click","x":5,"y":7,"button":"right"}', "ok"),
}


@query("action_gate", f"SELECT page_id, {_case('page_id % 18', {k: v[1] for k, v in ACTIONS.items()})} AS reason FROM pages")
def action_gate(spark, sf):
    body = X.pick(F.col("page_id") % 18, {k: v[0] for k, v in ACTIONS.items()}, None)
    rows = table(spark, sf, "pages").select("page_id", F.parse_json(body).alias("action"))
    return rows.select("page_id", G.action_reason(F.col("action")).alias("reason"))


GATE = r"""gate AS (
  SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM fields),
  granted AS (SELECT DISTINCT origin FROM gate WHERE origin_authorized)"""


def _gate_fields(spark, sf):
    f = X.fields(spark, sf).withColumn("origin", G.url_origin(F.col("url")))
    return f.withColumn("tokens", F.array("token"))


@query(
    "destination_gate",
    S.with_ctes(S.FIELDS, GATE)
    + r"""SELECT page_id, CASE WHEN NOT EXISTS (SELECT 1 FROM granted g WHERE g.origin = gate.origin) THEN 'not_authorized'
      WHEN NOT (visible AND focused AND editable) THEN 'not_a_focused_field'
      WHEN type IN ('search','url','password','hidden') OR search OR name = 'q' OR form_method = 'get' OR form_origin IS NULL OR (form_origin <> '' AND form_origin <> origin) THEN 'unsafe_destination'
      WHEN type IN ('email', 'tel') AND autocomplete <> '' AND type <> autocomplete THEN 'ambiguous_field'
      WHEN token <> CASE WHEN autocomplete = 'email' OR (autocomplete = '' AND type = 'email') THEN '[EMAIL_1]' WHEN autocomplete = 'section-a name' THEN '[NAME_2]' ELSE '[PHONE]' END THEN 'class_mismatch'
      ELSE 'ok' END AS reason FROM gate""",
)
def destination_gate(spark, sf):
    fields = _gate_fields(spark, sf)
    granted = fields.filter("origin_authorized").select("origin")
    return O.destination_gate(fields, granted).select("page_id", "reason")


@query(
    "fixture_gate",
    FLD
    + r"""SELECT page_id, CASE WHEN page_id % 4 = 0 OR NOT regexp_matches(url, '^https?://[^/]+/en/') THEN 'outside_application'
      WHEN page_id % 5 = 0 THEN 'token_field_mismatch' WHEN page_id % 3 <> 0 THEN 'token_field_mismatch' ELSE 'ok' END AS reason FROM fields""",
)
def fixture_gate(spark, sf):
    f = X.fields(spark, sf)
    place = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    netloc = F.when(F.col("page_id") % 4 == 0, "localhost:1").otherwise(place)
    kind = F.when(F.col("page_id") % 5 == 0, "").otherwise("EMAIL")
    return f.select("page_id", G.fixture_reason(F.col("url"), kind, F.array("token"), netloc, "/en/").alias("reason"))


@query(
    "approve_policy",
    S.with_ctes(S.FIELDS, GATE)
    + r""", a AS (SELECT *, CASE WHEN page_id % 23 = 22 THEN 'MISSING_POLICY' WHEN NOT visible THEN 'UNVERIFIED_DESTINATION' WHEN NOT origin_authorized THEN 'ORIGIN_NOT_ALLOWED'
      WHEN name <> 'contact' THEN 'FIELD_NOT_ALLOWED' WHEN page_id % 3 = 2 THEN 'CLASS_NOT_ALLOWED' ELSE 'POLICY_MATCH' END AS reason_code FROM gate)
    SELECT page_id, CASE WHEN reason_code = 'POLICY_MATCH' THEN 'approve' ELSE 'deny' END AS decision, reason_code,
      CASE WHEN reason_code = 'POLICY_MATCH' THEN least(page_id % 90, 60) END AS ttl_seconds, CASE WHEN reason_code = 'POLICY_MATCH' THEN least(1 + page_id % 3, 2) END AS max_uses FROM a""",
)
def approve_policy(spark, sf):
    f, k = _gate_fields(spark, sf), F.col("page_id")
    other = F.lit("https://service.example")
    p = {
        "verified": F.col("visible"),
        "policy_id": F.when(k % 23 != 22, "policy-1"),
        "origin": F.col("origin"),
        "field_id": F.col("name"),
        "allowed_origins": F.when(F.col("origin_authorized"), F.array(other, F.col("origin"))).otherwise(F.array(other)),
        "allowed_fields": F.array(F.lit("contact")),
        "allowed_classes": F.array(F.lit("EMAIL"), F.lit("NAME")),
        "pii_class": G.token_class(F.col("token")),
        "ttl_seconds": k % 90,
        "uses": 1 + k % 3,
        "max_ttl_seconds": F.lit(60),
        "max_uses": F.lit(2),
    }
    return f.select("page_id", G.approval(p).alias("a")).select("page_id", "a.*")


@query(
    "private_field_scan",
    FLD
    + """, c AS (SELECT page_id, greatest(0, x) AS x, greatest(0, y) AS y, least(1200, x + width) - greatest(0, x) AS width, least(900, y + height) - greatest(0, y) AS height, token FROM fields)
    SELECT page_id, x, y, width, height FROM c WHERE width > 0 AND height > 0 AND token <> '[SECRET_1]'""",
)
def private_field_scan(spark, sf):
    from hushlake.sources.fields import private_field_scan as scan

    f = X.fields(spark, sf).withColumn("value", F.when(F.col("token") == "[SECRET_1]", "").otherwise(F.col("token")))
    return scan(f, 1200, 900).select("page_id", "x", "y", "width", "height")


@query(
    "css_to_pixel_box",
    FLD
    + """, r AS (SELECT *, CASE WHEN page_id % 31 = 30 THEN 0 ELSE 1200 END AS vw FROM fields),
    q AS (SELECT *, CASE WHEN vw <= 0 THEN 'missing_viewport' WHEN width <= 0 OR height <= 0 THEN 'invalid_geometry'
      WHEN x < 0 OR y < 0 OR x + width > vw OR y + height > 900 THEN 'partly_outside' ELSE 'ok' END AS reason FROM r)
    SELECT page_id, CASE WHEN reason = 'ok' THEN floor(x * 2)::BIGINT END AS left, CASE WHEN reason = 'ok' THEN floor(y * 2)::BIGINT END AS top,
      CASE WHEN reason = 'ok' THEN ceil((x + width) * 2)::BIGINT END AS right, CASE WHEN reason = 'ok' THEN ceil((y + height) * 2)::BIGINT END AS bottom, reason FROM q""",
)
def css_to_pixel_box(spark, sf):
    view = F.when(F.col("page_id") % 31 == 30, 0).otherwise(1200)
    box = B.css_to_pixels(F.lit(2400), F.lit(1800), view, F.lit(900))
    return X.fields(spark, sf).select("page_id", box.alias("b")).select("page_id", "b.*")


@query(
    "field_visibility",
    FLD
    + """SELECT page_id, CASE WHEN page_id % 37 = 36 THEN 'missing_measurements' WHEN page_id % 29 = 28 THEN 'nonfinite_measurements'
      WHEN width > 0 AND height > 0 AND (page_id % 200) > 0 AND (page_id % 200) <= width AND 14 <= height AND page_id % 7 <> 6 THEN 'fits' ELSE 'clipped_or_scrolled' END AS reason FROM fields""",
)
def field_visibility(spark, sf):
    k = F.col("page_id")
    metrics = {
        "content_width": F.col("width"),
        "content_height": F.col("height"),
        "text_width": F.when(k % 29 == 28, float("inf")).otherwise(k % 200),
        "text_height": F.when(k % 37 != 36, 14.0),
        "scroll_left": F.when(k % 7 == 6, 3.0).otherwise(0.0),
        "scroll_top": F.lit(0.0),
    }
    return X.fields(spark, sf).select("page_id", B.field_visibility(metrics).alias("reason"))


@query(
    "manifest_allowlist",
    FLD + "SELECT page_id, i AS pos, CASE i WHEN 0 THEN token ELSE '[EMAIL_9]' END AS token, CASE i WHEN 0 THEN 'A' ELSE 'EMAIL' END AS kind, CASE i WHEN 0 THEN name ELSE 'Email' END AS label FROM fields, (VALUES (0), (1)) v(i)",
)
def manifest_allowlist(spark, sf):
    from hushlake.functions.manifests import public_manifest

    raw = lambda token, kind, label: F.struct(
        token.alias("token"), kind.alias("kind"), F.col("url").alias("value"), label.alias("label"), F.col("x").alias("x")
    )
    items = F.array(
        raw(F.col("token"), F.lit("A"), F.col("name")), raw(F.lit("[EMAIL_9]"), F.lit("EMAIL"), F.lit("Email"))
    )
    out = X.fields(spark, sf).select("page_id", F.posexplode(public_manifest(items)).alias("pos", "item"))
    return out.select("page_id", "pos", "item.*")
