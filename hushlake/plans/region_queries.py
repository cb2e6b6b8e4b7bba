"""Regions, label pairing and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import boxes as B
from hushlake.functions import patterns as P
from hushlake.operators import findings as D
from hushlake.operators.joins import dealt, tasks_for
from hushlake.operators import pairing as G
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans import text_queries as T
from hushlake.plans.registry import query

K = ["session_id", "frame_id", "region_id"]

_LAB = f"regexp_extract(text, '{T.LABEL_FULL}', 1)"


def scan_sql(source: str) -> str:
    return f"""scanned AS MATERIALIZED (
  SELECT session_id, frame_id, region_id, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS text, x, y, width, height, confidence,
    {_LAB} AS label, regexp_extract(text, '{T.LABEL_FULL}', 2) AS val, {_LAB} <> '' AS is_label,
    CASE WHEN {_LAB} <> '' THEN {T.kind_sql(_LAB)} END AS label_kind,
    regexp_matches(text, '{T.LABEL}\\s*[:：]') AS explicit, regexp_matches(text, '{T.HELPER}') AS helper,
    regexp_matches(replace(text, ' ', ''), '^[•●·*▪]{{3,}}$') AS masked, regexp_matches(text, '{T.POSTAL}') AS postal,
    regexp_matches(text, '(?i)^(?:apt|suite|unit|#)\\s*[{T.W}]') AS unit, regexp_matches(text, '{T.STREET_IN}') AS street
  FROM (SELECT * REPLACE (trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS text) FROM {source}) WHERE text <> ''),
anchors AS MATERIALIZED (SELECT * FROM scanned WHERE (is_label OR street) AND NOT coalesce(label_kind = 'SECRET' AND NOT explicit AND helper, false)),
candb AS MATERIALIZED (
  SELECT a.session_id, a.frame_id, a.region_id AS aid, greatest(36, a.height * 2.8) AS gap, n.region_id, n.x, n.y, n.width, n.height,
    n.text, n.is_label, n.helper, n.masked, n.postal, n.unit,
    row_number() OVER (PARTITION BY a.session_id, a.frame_id, a.region_id ORDER BY n.y, n.x, n.region_id) AS k
  FROM scanned a JOIN scanned n ON a.session_id = n.session_id AND a.frame_id = n.frame_id AND n.region_id <> a.region_id
    AND n.y >= a.y + a.height * 0.5 AND abs(n.x - a.x) <= greatest(32, a.height * 2)
  QUALIFY k <= 5),
chain AS (
  SELECT session_id, frame_id, region_id AS aid, 0::BIGINT AS k, (y + height)::DOUBLE AS edge FROM scanned
  UNION ALL
  SELECT c.session_id, c.frame_id, c.aid, b.k, (b.y + b.height)::DOUBLE FROM chain c JOIN candb b
    ON c.session_id = b.session_id AND c.frame_id = b.frame_id AND c.aid = b.aid AND b.k = c.k + 1
  WHERE NOT b.is_label AND b.y - c.edge <= b.gap),
below AS MATERIALIZED (SELECT b.* FROM candb b JOIN chain c USING (session_id, frame_id, aid, k)),
rights AS MATERIALIZED (
  SELECT a.session_id, a.frame_id, a.region_id AS aid, n.region_id, n.x, n.y, n.width, n.height, n.text, n.masked,
    row_number() OVER (PARTITION BY a.session_id, a.frame_id, a.region_id ORDER BY n.x, n.y, n.region_id) AS k,
    row_number() OVER (PARTITION BY a.session_id, a.frame_id, a.region_id, n.masked ORDER BY n.y, n.x, n.region_id) AS km
  FROM anchors a JOIN scanned n ON a.session_id = n.session_id AND a.frame_id = n.frame_id AND n.region_id <> a.region_id
    AND n.x >= a.x + a.width AND abs(n.y - a.y) <= greatest(a.height, n.height) * 0.5 AND n.x - a.x - a.width <= 240
    AND NOT n.is_label AND NOT coalesce(a.label_kind = 'SECRET' AND n.helper, false)),
belowf AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.session_id, b.frame_id, b.aid ORDER BY b.k) AS kf FROM below b
    JOIN anchors a ON a.session_id = b.session_id AND a.frame_id = b.frame_id AND a.region_id = b.aid
  WHERE NOT coalesce(a.label_kind = 'SECRET' AND b.helper, false)),
maskedb AS (SELECT session_id, frame_id, aid, arg_min(region_id, k) AS rid FROM belowf WHERE masked GROUP BY ALL),
selected AS MATERIALIZED (
  SELECT a.session_id, a.frame_id, a.region_id AS aid,
    CASE WHEN a.val <> '' THEN a.region_id
      WHEN a.label_kind = 'SECRET' THEN coalesce(rm.region_id, mb.rid, r.region_id, b1.region_id)
      ELSE coalesce(r.region_id, b1.region_id) END AS rid
  FROM anchors a
  LEFT JOIN rights r ON r.session_id = a.session_id AND r.frame_id = a.frame_id AND r.aid = a.region_id AND r.k = 1
  LEFT JOIN rights rm ON rm.session_id = a.session_id AND rm.frame_id = a.frame_id AND rm.aid = a.region_id AND rm.masked AND rm.km = 1
  LEFT JOIN maskedb mb ON mb.session_id = a.session_id AND mb.frame_id = a.frame_id AND mb.aid = a.region_id
  LEFT JOIN belowf b1 ON b1.session_id = a.session_id AND b1.frame_id = a.frame_id AND b1.aid = a.region_id AND b1.kf = 1
  WHERE a.is_label),
addr_start AS MATERIALIZED (
  SELECT s.session_id, s.frame_id, s.aid, s.rid, CASE WHEN a.val <> '' THEN a.val ELSE n.text END AS value
  FROM selected s JOIN anchors a ON a.session_id = s.session_id AND a.frame_id = s.frame_id AND a.region_id = s.aid
  JOIN scanned n ON n.session_id = s.session_id AND n.frame_id = s.frame_id AND n.region_id = s.rid
  WHERE a.label_kind = 'ADDRESS'),
addr AS (
  SELECT session_id, frame_id, aid, rid, 0::BIGINT AS k, value FROM addr_start
  UNION ALL
  SELECT d.session_id, d.frame_id, d.aid, d.rid, b.k, d.value || chr(10) || b.text FROM addr d JOIN below b
    ON b.session_id = d.session_id AND b.frame_id = d.frame_id AND b.aid = d.rid AND b.k = d.k + 1
  WHERE b.k <= 4 AND NOT regexp_matches(d.value, '{T.POSTAL}') AND len(string_split(d.value, chr(10))) < 4),
addr_end AS MATERIALIZED (SELECT session_id, frame_id, aid, rid, max(k) AS k, arg_max(value, k) AS value FROM addr GROUP BY ALL),
street_run AS (
  SELECT session_id, frame_id, region_id AS aid, 0::BIGINT AS k, text AS value FROM anchors WHERE street
  UNION ALL
  SELECT d.session_id, d.frame_id, d.aid, b.k, d.value || chr(10) || b.text FROM street_run d JOIN below b
    ON b.session_id = d.session_id AND b.frame_id = d.frame_id AND b.aid = d.aid AND b.k = d.k + 1
  WHERE b.k <= 2 AND (b.postal OR b.unit)),
street_end AS MATERIALIZED (SELECT session_id, frame_id, aid, max(k) AS k, arg_max(value, k) AS value FROM street_run GROUP BY ALL)"""


FOUND = f"""parts AS (
  SELECT e.session_id, e.frame_id, e.aid, 3 AS s, n.x, n.y, n.width, n.height, n.confidence FROM addr_end e JOIN scanned n
    ON n.session_id = e.session_id AND n.frame_id = e.frame_id AND n.region_id = e.rid
  UNION ALL SELECT e.session_id, e.frame_id, e.aid, 3, b.x, b.y, b.width, b.height, sc.confidence FROM addr_end e JOIN below b
    ON b.session_id = e.session_id AND b.frame_id = e.frame_id AND b.aid = e.rid AND b.k <= e.k
    JOIN scanned sc ON sc.session_id = b.session_id AND sc.frame_id = b.frame_id AND sc.region_id = b.region_id
  UNION ALL SELECT e.session_id, e.frame_id, e.aid, 4, n.x, n.y, n.width, n.height, n.confidence FROM street_end e JOIN scanned n
    ON n.session_id = e.session_id AND n.frame_id = e.frame_id AND n.region_id = e.aid
  UNION ALL SELECT e.session_id, e.frame_id, e.aid, 4, b.x, b.y, b.width, b.height, sc.confidence FROM street_end e JOIN below b
    ON b.session_id = e.session_id AND b.frame_id = e.frame_id AND b.aid = e.aid AND b.k <= e.k
    JOIN scanned sc ON sc.session_id = b.session_id AND sc.frame_id = b.frame_id AND sc.region_id = b.region_id),
boxes AS (
  SELECT session_id, frame_id, aid, s, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height,
    min(confidence) AS confidence FROM parts GROUP BY ALL),
hits AS (
  SELECT session_id, frame_id, region_id AS aid, 0 AS s, 1 AS n0, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '{T.EMAIL}')) AS value,
    'local-pattern' AS source, x, y, width, height, confidence, false AS explicit FROM scanned
  UNION ALL SELECT session_id, frame_id, region_id, 0, 2, 'PHONE', unnest(regexp_extract_all(text, '{T.PHONE_IN}', 2)), 'local-pattern', x, y, width, height, confidence, false FROM scanned
  UNION ALL SELECT session_id, frame_id, region_id, 0, 3, 'SECRET', unnest(regexp_extract_all(text, '{T.SECRET_IN}', 2)), 'local-pattern', x, y, width, height, confidence, false FROM scanned
  UNION ALL SELECT session_id, frame_id, region_id, 2, 0, 'NAME', regexp_extract(text, '{T.GREETING}', 1), 'visible-greeting', x, y, width, height, confidence, false FROM scanned
    WHERE regexp_matches(text, '{T.GREETING}') AND lower(regexp_extract(text, '{T.GREETING}', 1)) NOT IN ('there','guest','sign in')
  UNION ALL SELECT a.session_id, a.frame_id, a.region_id, 3, 0, a.label_kind, CASE WHEN a.val <> '' THEN a.val ELSE n.text END, 'visible-label',
      n.x, n.y, n.width, n.height, n.confidence, a.label_kind = 'SECRET' AND a.explicit
    FROM selected s JOIN anchors a ON a.session_id = s.session_id AND a.frame_id = s.frame_id AND a.region_id = s.aid
    JOIN scanned n ON n.session_id = s.session_id AND n.frame_id = s.frame_id AND n.region_id = s.rid WHERE a.label_kind <> 'ADDRESS'
  UNION ALL SELECT e.session_id, e.frame_id, e.aid, 3, 0, 'ADDRESS', e.value, 'visible-label', b.x, b.y, b.width, b.height, b.confidence, false
    FROM addr_end e JOIN boxes b ON b.session_id = e.session_id AND b.frame_id = e.frame_id AND b.aid = e.aid AND b.s = 3
  UNION ALL SELECT e.session_id, e.frame_id, e.aid, 4, 0, 'ADDRESS', e.value, 'local-street-pattern', b.x, b.y, b.width, b.height, b.confidence, false
    FROM street_end e JOIN boxes b ON b.session_id = e.session_id AND b.frame_id = e.frame_id AND b.aid = e.aid AND b.s = 4),
ordered_hits AS (
  SELECT h.* REPLACE (trim(h.value, ' :：' || chr(9) || chr(10)) AS value), a.y AS oy, a.x AS ox FROM hits h
    JOIN scanned a ON a.session_id = h.session_id AND a.frame_id = h.frame_id AND a.region_id = h.aid),
flagged AS (
  SELECT *, coalesce(max(CASE WHEN explicit THEN oy * 1e12 + ox * 1e6 + aid * 10 + s END) OVER (PARTITION BY session_id, frame_id, kind, value)
      >= oy * 1e12 + ox * 1e6 + aid * 10 + s, false) AS explicit_secret,
    row_number() OVER (PARTITION BY session_id, frame_id, kind, value, x, y, width, height ORDER BY oy, ox, aid, s, n0) AS pick
  FROM ordered_hits WHERE value <> ''),
findings AS (
  SELECT f.session_id, f.frame_id, f.kind, f.value, f.x, f.y, f.width, f.height, f.confidence, f.source,
    bool_or(f.explicit_secret) OVER (PARTITION BY session_id, frame_id, kind, value, x, y, width, height) AS explicit_secret, pick
  FROM flagged f)"""

CARD_SCAN = S.with_ctes(S.CARDS, scan_sql("cards"))
CARD_FOUND = S.with_ctes(S.CARDS, scan_sql("cards"), FOUND)
FINDING_COLS = ["session_id", "frame_id", "kind", "value", "x", "y", "width", "height", "confidence", "source", "explicit_secret"]


@query(
    "region_scan",
    S.with_ctes(S.DOC_REGIONS)
    + """SELECT frame_id, region_id, sha256(t) AS text_hash, CASE WHEN length(t) % 101 = 100 THEN 'empty_region' WHEN length(t) % 97 = 96 THEN 'not_finite' ELSE 'ok' END AS status
      FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM doc_regions) WHERE t <> ''""",
)
def region_scan(spark, sf):
    """Document lines as regions; some get impossible geometry so that the error codes show."""
    size = F.length(P.strip(F.col("text")))
    r = X.doc_regions(spark, sf)
    r = r.withColumn("x", F.when(size % 97 == 96, float("nan")).otherwise(F.col("x")))
    r = r.withColumn("height", F.when(size % 101 == 100, 0).otherwise(F.col("height")))
    r = r.withColumn("x", F.when(size % 101 == 100, 17.0).otherwise(F.col("x")))
    return D.region_scan(r).select("frame_id", "region_id", F.sha2("text", 256).alias("text_hash"), "status")


@query(
    "fail_closed",
    S.with_ctes(S.DOC_REGIONS)
    + """, s AS (SELECT *, length(trim(text)) % 101 = 100 AS bad FROM doc_regions WHERE trim(text) <> '')
      SELECT frame_id, count(*) AS regions FROM s WHERE frame_id NOT IN (SELECT frame_id FROM s WHERE bad) GROUP BY 1""",
)
def fail_closed(spark, sf):
    """One impossible region withholds its whole frame."""
    r = X.doc_regions(spark, sf)
    r = r.withColumn("height", F.when(F.length(P.strip(F.col("text"))) % 101 == 100, 0).otherwise(F.col("height")))
    return D.fail_closed(D.region_scan(r)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("regions"))


@query(
    "reading_order",
    S.with_ctes(S.CARDS)
    + "SELECT session_id, frame_id, region_id, row_number() OVER (PARTITION BY session_id, frame_id ORDER BY y, x, region_id) AS position FROM cards",
)
def reading_order(spark, sf):
    return D.reading_order(X.contact_cards(spark, sf)).select(*K, "position")


def _paired(spark, sf):
    return G.pair_labels(G.clean(X.contact_cards(spark, sf)))


@query(
    "pair_right",
    CARD_SCAN + "SELECT r.session_id, r.frame_id, r.aid AS region_id, r.region_id AS right_id, r.text FROM rights r WHERE k = 1",
)
def pair_right(spark, sf):
    paired = _paired(spark, sf)
    found = paired.filter(F.col("right").isNotNull())
    return found.select(*K, F.col("right.region_id").alias("right_id"), F.col("right.text").alias("text"))


@query(
    "pair_below",
    CARD_SCAN
    + """SELECT b.session_id, b.frame_id, b.aid AS region_id, b.k AS position, b.region_id AS below_id FROM below b
      JOIN anchors a ON a.session_id = b.session_id AND a.frame_id = b.frame_id AND a.region_id = b.aid""",
)
def pair_below(spark, sf):
    paired = _paired(spark, sf)
    out = paired.select(*K, F.posexplode("below").alias("pos", "b"))
    return out.select(*K, (F.col("pos") + 1).alias("position"), F.col("b.region_id").alias("below_id"))


@query(
    "masked_secret_pair",
    CARD_SCAN
    + """SELECT s.session_id, s.frame_id, s.aid AS region_id, s.rid AS value_id, n.text, n.masked FROM selected s
      JOIN anchors a ON a.session_id = s.session_id AND a.frame_id = s.frame_id AND a.region_id = s.aid
      JOIN scanned n ON n.session_id = s.session_id AND n.frame_id = s.frame_id AND n.region_id = s.rid WHERE a.label_kind = 'SECRET'""",
)
def masked_secret_pair(spark, sf):
    paired = _paired(spark, sf)
    found = paired.filter((F.col("label_kind") == "SECRET") & F.col("selected").isNotNull())
    value = F.col("selected.text")
    return found.select(*K, F.col("selected.region_id").alias("value_id"), value.alias("text"), P.is_masked(value).alias("masked"))


@query(
    "address_block",
    CARD_SCAN + "SELECT session_id, frame_id, aid AS region_id, value, k + 1 AS lines FROM addr_end",
)
def address_block(spark, sf):
    out = G.label_blocks(G.clean(X.contact_cards(spark, sf))).filter(F.col("address_block").isNotNull())
    return out.select(*K, F.col("address_block.value").alias("value"), F.size("address_block.items").alias("lines"))


@query(
    "street_block",
    CARD_SCAN + "SELECT session_id, frame_id, aid AS region_id, value, k + 1 AS lines FROM street_end",
)
def street_block(spark, sf):
    out = _paired(spark, sf).withColumn("block", G.street_block()).filter(F.col("block").isNotNull())
    return out.select(*K, F.col("block.value").alias("value"), F.size("block.items").alias("lines"))


@query(
    "finding_merge",
    S.with_ctes(S.CARDS)
    + """SELECT session_id, frame_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height,
      min(confidence) AS confidence FROM cards GROUP BY ALL""",
)
def finding_merge(spark, sf):
    return D.finding_merge(X.contact_cards(spark, sf), ["session_id", "frame_id"])


@query(
    "finding_dedup",
    CARD_FOUND
    + """SELECT session_id, frame_id, kind, value, x, y, width, height, count(*) FILTER (pick = 1) AS kept, count(*) AS raw FROM findings GROUP BY ALL""",
)
def finding_dedup(spark, sf):
    """How many raw findings fold into each kept one."""
    cleaned = G.clean(X.contact_cards(spark, sf))
    tasks = tasks_for(cleaned)
    raw = D.line_findings(cleaned).unionByName(D.label_findings(cleaned, tasks))
    box = ["session_id", "frame_id", "kind", "value", "x", "y", "width", "height"]
    counts = raw.groupBy(*box).agg(F.count(F.lit(1)).alias("raw"))
    kept = D.finding_dedup(raw, tasks).groupBy(*box).agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(dealt(counts), box).select(*box, "kept", "raw")


@query("classify_frames", CARD_FOUND + f"SELECT {', '.join(FINDING_COLS)} FROM findings WHERE pick = 1")
def classify_frames(spark, sf):
    """Flagship: every finding of every frame of every session."""
    return D.classify_frames(X.contact_cards(spark, sf)).select(*FINDING_COLS)


@query(
    "classify_documents",
    S.with_ctes(S.DOC_REGIONS, scan_sql("doc_regions"), FOUND)
    + f"SELECT {', '.join(c for c in FINDING_COLS if c != 'value')}, sha256(value) AS value_hash FROM findings WHERE pick = 1",
)
def classify_documents(spark, sf):
    found = D.classify_frames(X.doc_regions(spark, sf))
    return found.select(*[c for c in FINDING_COLS if c != "value"], F.sha2("value", 256).alias("value_hash"))


AGAIN = """known AS (
  SELECT session_id, value, CASE WHEN bool_or(kind = 'SECRET') THEN 'SECRET' ELSE arg_max(kind, frame_id * 1e18 + oy * 1e12 + ox * 1e6 + aid * 10 + s) END AS kind,
    bool_or(explicit_secret) AS explicit_secret, min(frame_id) AS since FROM flagged WHERE pick = 1 GROUP BY ALL),
fragments AS (
  SELECT session_id, kind, value, since, unnest([value] || list_filter(list_transform(string_split(value, chr(10)), lambda v: trim(v)), lambda v: length(v) >= 4)) AS fragment
  FROM known WHERE NOT (kind = 'SECRET' AND NOT explicit_secret AND regexp_matches(trim(value), '""" + T.HELPER + """'))),
again AS (
  SELECT DISTINCT c.session_id, c.frame_id, f.kind, f.value, c.x, c.y, c.width, c.height, c.confidence, 'local-vault' AS source, false AS explicit_secret,
    c.y AS oy, c.x AS ox, c.region_id AS aid, 1 AS s, 0 AS n0
  FROM scanned c JOIN fragments f ON f.session_id = c.session_id AND c.frame_id > f.since
    AND contains(lower(regexp_replace(c.text, '\\s+', '', 'g')), lower(regexp_replace(f.fragment, '\\s+', '', 'g')))),
every AS (
  SELECT session_id, frame_id, kind, value, x, y, width, height, confidence, source, explicit_secret, oy, ox, aid, s, n0 FROM flagged WHERE pick = 1
  UNION ALL SELECT * FROM again),
sessions AS (
  SELECT * REPLACE (bool_or(explicit_secret) OVER (PARTITION BY session_id, frame_id, kind, value, x, y, width, height) AS explicit_secret),
    row_number() OVER (PARTITION BY session_id, frame_id, kind, value, x, y, width, height ORDER BY oy, ox, aid, s, n0) AS first FROM every)"""


@query(
    "detect_sessions",
    S.with_ctes(S.CARDS, scan_sql("cards"), FOUND, AGAIN) + f"SELECT {', '.join(FINDING_COLS)} FROM sessions WHERE first = 1",
)
def detect_sessions(spark, sf):
    """Findings with values of earlier frames re-found in later ones."""
    return D.detect_sessions(X.contact_cards(spark, sf)).select(*FINDING_COLS)


TRUTH = """truth AS (
  SELECT c_custkey AS session_id, unnest([
    {'kind': 'NAME', 'value': c_name}, {'kind': 'EMAIL', 'value': concat('c', c_custkey, '@example.net')},
    {'kind': 'PHONE', 'value': concat('+1 (', 200 + c_custkey % 700, ') 555-', lpad((c_custkey % 10000)::VARCHAR, 4, '0'))},
    {'kind': 'SECRET', 'value': concat('pw-', c_custkey)}, {'kind': 'NAME', 'value': 'Ines Okafor'}]) AS t FROM customer),
expected AS (SELECT DISTINCT session_id, t.kind AS kind, replace(t.value, ' ', '') AS value FROM truth),
got AS (SELECT DISTINCT session_id, kind, regexp_replace(value, '\\s+', '', 'g') AS value FROM findings WHERE pick = 1)"""


@query(
    "detector_quality",
    (S.with_ctes(S.CARDS, scan_sql("cards"), FOUND, TRUTH))
    + """SELECT kind, count(*) FILTER (e AND g) AS hits, count(*) FILTER (e AND NOT g) AS misses, count(*) FILTER (NOT e AND g) AS extras FROM (
      SELECT kind, a.session_id IS NOT NULL AS e, b.session_id IS NOT NULL AS g FROM expected a FULL JOIN got b USING (session_id, kind, value)) GROUP BY kind""",
)
def detector_quality(spark, sf):
    """Exact-value hits, misses and extras per kind against the known card values."""
    cards = X.contact_cards(spark, sf)
    key = X.text(F.col("c_custkey"))
    phone = F.concat(
        F.lit("+1 ("), X.text(200 + F.col("c_custkey") % 700), F.lit(") 555-"),
        F.lpad(X.text(F.col("c_custkey") % 10000), 4, "0"),
    )
    truth = [
        ("NAME", F.col("c_name")), ("EMAIL", F.concat(F.lit("c"), key, F.lit("@example.net"))), ("PHONE", phone),
        ("SECRET", F.concat(F.lit("pw-"), key)), ("NAME", F.lit("Ines Okafor")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in truth])
    expected = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.inline(rows))
    return D.detector_quality(D.classify_frames(cards), expected)


BOXED = """boxed AS (
  SELECT concat(session_id, '/', frame_id, '/', region_id) AS box_id,
    CASE region_id % 7 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'NAME' WHEN 2 THEN 'ADDRESS' WHEN 3 THEN 'PHONE' WHEN 4 THEN 'SECRET' WHEN 5 THEN 'NAME' ELSE 'OTHER' END AS kind,
    CASE WHEN session_id % 23 = 0 THEN '' ELSE text END AS value,
    CASE WHEN session_id % 29 = 0 THEN 'NaN'::DOUBLE WHEN session_id % 37 = 1 THEN 1e16::DOUBLE WHEN session_id % 41 = 1 THEN -1e300::DOUBLE ELSE x + (session_id % 1300) - 60.5::DOUBLE END AS x,
    y + (session_id % 700) * 1.25::DOUBLE - 40.25::DOUBLE AS y,
    CASE WHEN session_id % 31 = 0 THEN 0.0::DOUBLE ELSE width + 0.5::DOUBLE END AS width, height * 1.5::DOUBLE AS height FROM cards)"""


def _boxed(spark, sf):
    """Card regions as findings with shifted, fractional and sometimes invalid boxes."""
    s = F.col("session_id")
    return X.contact_cards(spark, sf).select(
        F.concat_ws("/", *K).alias("box_id"),
        X.pick(F.col("region_id") % 7, {0: "EMAIL", 1: "NAME", 2: "ADDRESS", 3: "PHONE", 4: "SECRET", 5: "NAME"}, "OTHER").alias("kind"),
        F.when(s % 23 == 0, "").otherwise(F.col("text")).alias("value"),
        F.when(s % 29 == 0, float("nan")).when(s % 37 == 1, 1e16).when(s % 41 == 1, -1e300).otherwise(F.col("x") + s % 1300 - 60.5).alias("x"),
        (F.col("y") + (s % 700) * 1.25 - 40.25).alias("y"),
        F.when(s % 31 == 0, 0.0).otherwise(F.col("width") + 0.5).alias("width"),
        (F.col("height") * 1.5).alias("height"),
    )


CLIP = """clip AS (
  SELECT *, greatest(0, floor(x)) AS l, greatest(0, floor(y)) AS t, least(1200, ceil(x + width)) AS r, least(900, ceil(y + height)) AS b FROM boxed)"""
BOX_REASON = """CASE WHEN kind = 'OTHER' OR value = '' THEN 'invalid_finding' WHEN isnan(x) THEN 'invalid_coordinates'
  WHEN width <= 0 OR height <= 0 THEN 'invalid_dimensions' WHEN l >= r OR t >= b THEN 'outside_frame' ELSE 'ok' END"""


@query("box_validate", S.with_ctes(S.CARDS, BOXED, CLIP) + f"SELECT box_id, {BOX_REASON} AS reason FROM clip")
def box_validate(spark, sf):
    return _boxed(spark, sf).select("box_id", B.box_reason("kind", "value", 1200, 900).alias("reason"))


@query(
    "box_round_clip",
    S.with_ctes(S.CARDS, BOXED, CLIP)
    + f"SELECT box_id, l::BIGINT AS x, t::BIGINT AS y, (r - l)::BIGINT AS width, (b - t)::BIGINT AS height FROM clip WHERE {BOX_REASON} = 'ok'",
)
def box_round_clip(spark, sf):
    good = _boxed(spark, sf).filter(B.box_reason("kind", "value", 1200, 900) == "ok")
    return good.select("box_id", B.round_clip(1200, 900).alias("m")).select("box_id", "m.*")


POLY = """poly AS (
  SELECT box_id, [x, x + width, x + width + 1.25::DOUBLE, x - 0.75::DOUBLE] AS xs, [y - 0.5::DOUBLE, y, y + height, y + height + 0.25::DOUBLE] AS ys
  FROM boxed WHERE NOT isnan(x)),
pad AS (
  SELECT box_id, greatest(0, least(1200, floor(list_min(xs)) - 3)) AS l, greatest(0, least(900, floor(list_min(ys)) - 3)) AS t,
    list_max(xs) AS mx, list_max(ys) AS my FROM poly),
padded AS (SELECT box_id, l, t, greatest(l, least(1200, ceil(mx) + 3)) AS r, greatest(t, least(900, ceil(my) + 3)) AS b FROM pad)"""


@query(
    "ocr_pad_box",
    S.with_ctes(S.CARDS, BOXED, POLY)
    + "SELECT box_id, l::BIGINT AS x, t::BIGINT AS y, (r - l)::BIGINT AS width, (b - t)::BIGINT AS height, CASE WHEN r <= l OR b <= t THEN 'empty_region' ELSE 'ok' END AS status FROM padded",
)
def ocr_pad_box(spark, sf):
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    points = F.array(
        *[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y - 0.5), (x + w, y), (x + w + 1.25, y + h), (x - 0.75, y + h + 0.25))]
    )
    rows = _boxed(spark, sf).filter(~F.isnan("x")).select("box_id", points.alias("points"))
    return rows.select("box_id", B.pad_polygon(F.col("points"), 1200, 900).alias("m")).select("box_id", "m.*")


@query(
    "protected_sink",
    CARD_FOUND
    + """, good AS (SELECT *, min(oy * 1e12 + ox * 1e6 + aid * 10 + s) OVER (PARTITION BY session_id, frame_id, kind, value, x, y, width, height) AS ord FROM flagged),
    shown AS (SELECT session_id, frame_id FROM cards UNION SELECT session_id, frame_id + 100 FROM cards WHERE frame_id = 0 AND session_id % 3 = 1),
    masks AS (SELECT * FROM good WHERE pick = 1),
    firsts AS (SELECT session_id, kind, value, min(frame_id * 1e18 + ord * 10 + n0) AS f FROM masks GROUP BY ALL),
    numbered AS (SELECT *, concat('[', kind, '_', row_number() OVER (PARTITION BY session_id, kind ORDER BY f), ']') AS token FROM firsts),
    drawn AS (SELECT * FROM masks JOIN numbered USING (session_id, kind, value))
    SELECT fr.session_id, fr.frame_id, count(token) AS masks, count(DISTINCT token) AS manifest_size, 'ok' AS status
    FROM (SELECT DISTINCT session_id, frame_id FROM shown) fr LEFT JOIN drawn d ON d.session_id = fr.session_id AND d.frame_id = fr.frame_id GROUP BY 1, 2""",
)
def protected_sink(spark, sf):
    """Protected observations written by session and read back: masks and manifest, no raw value. Some frames show nothing private."""
    from hushlake.sources.sinks import protect_frames, read_protected, write_protected

    cards = X.contact_cards(spark, sf)
    plain = cards.filter("frame_id = 0 AND session_id % 3 = 1").select("session_id", (F.col("frame_id") + 100).alias("frame_id"))
    frames = cards.select("session_id", "frame_id").unionByName(plain)
    folder = write_protected(protect_frames(D.classify_frames(cards), frames, 1200, 900), spark)
    out = read_protected(spark, folder)
    return out.select("session_id", "frame_id", F.col("count").alias("masks"), F.size("manifest").alias("manifest_size"), "status")


@query(
    "frame_layout",
    CARD_FOUND
    + """, seen AS (SELECT session_id, frame_id, count(*) AS regions FROM cards GROUP BY 1, 2),
    raw AS (SELECT session_id, frame_id, count(*) AS raw, count(*) FILTER (pick = 1) AS kept, count(DISTINCT kind) AS kinds FROM findings GROUP BY 1, 2)
    SELECT session_id, frame_id, regions, coalesce(raw, 0) AS raw, coalesce(kept, 0) AS kept, coalesce(kinds, 0) AS kinds
    FROM seen LEFT JOIN raw USING (session_id, frame_id)""",
)
def frame_layout(spark, sf):
    """Regions and findings laid out by frame once; folding, counting and joining them moves no rows."""
    from hushlake.sources.layout import lay_out

    cards = X.contact_cards(spark, sf)
    # a bucket is read by one task, so their number follows the regions
    tasks = tasks_for(cards)
    buckets = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    regions = lay_out(cards, buckets)
    cleaned = G.clean(regions)
    found = lay_out(D.line_findings(cleaned).unionByName(D.label_findings(cleaned, tasks)), buckets)
    return frame_counts(regions, found)


def frame_counts(regions, found):
    """Regions, raw findings, kept findings and kinds of every frame; rows without a session or a frame are of none."""
    key = ["session_id", "frame_id"]
    one = F.count(F.lit(1))
    regions, found = (r.filter("session_id is not null and frame_id is not null") for r in (regions, found))
    raw = found.groupBy(*key).agg(one.alias("raw"))
    kept = D.finding_dedup(found).groupBy(*key, "kind").agg(one.alias("n"))
    kept = kept.groupBy(*key).agg(F.sum("n").alias("kept"), one.alias("kinds"))
    out = regions.groupBy(*key).agg(one.alias("regions")).join(raw, key, "left").join(kept, key, "left")
    return out.select(*key, "regions", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "kept", "kinds")])
