"""Token vault: issue, scrub, resolve, revoke, re-find."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.operators import vault as V
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans.registry import query
from hushlake.plans.text_queries import scrub_sql

VAULT = S.with_ctes(S.SIGHTINGS, S.VAULT)


@query("vault_build", VAULT + "SELECT session_id, kind, value, token, first_seq, blocked FROM vault")
def vault_build(spark, sf):
    return V.vault_build(X.sightings(spark, sf)).drop("number")


@query("token_number", VAULT + "SELECT session_id, token, row_number() OVER (PARTITION BY session_id, kind ORDER BY first_seq) AS number FROM vault")
def token_number(spark, sf):
    return V.vault_build(X.sightings(spark, sf)).select("session_id", "token", "number")


@query(
    "blocked_as_of",
    S.with_ctes(S.SIGHTINGS)
    + """SELECT session_id, seq, kind, value, max(CASE WHEN kind = 'SECRET' THEN 1 ELSE 0 END) OVER
      (PARTITION BY session_id, value ORDER BY seq) = 1 AS blocked FROM sightings""",
)
def blocked_as_of(spark, sf):
    return V.blocked_as_of(X.sightings(spark, sf)).select("session_id", "seq", "kind", "value", "blocked")


@query(
    "known_kind",
    S.with_ctes(S.SIGHTINGS)
    + """SELECT session_id, value, CASE WHEN bool_or(kind = 'SECRET') THEN 'SECRET' ELSE arg_max(kind, seq) END AS kind
      FROM sightings GROUP BY session_id, value""",
)
def known_kind(spark, sf):
    return V.known_kind(X.sightings(spark, sf)).select("session_id", "value", "kind")


NAMES = """names AS (
  SELECT session_id, value, arg_min(token, (CASE WHEN kind = 'SECRET' THEN 0 ELSE 1 END) * 1000000000000 + first_seq) AS token
  FROM vault GROUP BY session_id, value),
known AS (
  SELECT session_id, list(struct_pack(v := value, t := token) ORDER BY length(value) DESC, value) AS ks FROM names GROUP BY session_id)"""
SCRUBBED = """scrubbed AS (
  SELECT m.session_id, m.text_id, list_reduce(list_prepend(m.text, list_transform(ks, lambda k: k.v || chr(1) || k.t)),
      lambda a, kv: replace(a, split_part(kv, chr(1), 1), split_part(kv, chr(1), 2))) AS scrubbed,
    len(list_filter(ks, lambda k: contains(m.text, k.v))) AS hits
  FROM messages m JOIN known USING (session_id))"""


@query("vault_scrub", S.with_ctes(S.SIGHTINGS, S.MESSAGES, S.VAULT, NAMES, SCRUBBED) + "SELECT session_id, text_id, scrubbed, hits FROM scrubbed")
def vault_scrub(spark, sf):
    out = V.vault_scrub(X.messages(spark, sf), V.vault_build(X.sightings(spark, sf)))
    return out.select("session_id", "text_id", "scrubbed", "hits")


@query("full_scrub", S.with_ctes(S.SIGHTINGS, S.MESSAGES, S.VAULT, NAMES, SCRUBBED) + f"SELECT session_id, text_id, {scrub_sql('scrubbed')} AS scrubbed FROM scrubbed")
def full_scrub(spark, sf):
    out = V.full_scrub(X.messages(spark, sf), V.vault_build(X.sightings(spark, sf)))
    return out.select("session_id", "text_id", "scrubbed")


TYPED = """typed AS (
  SELECT c_nationkey AS session_id, c_custkey AS text_id,
    concat('To [NAME_', 1 + c_custkey % 90, '] via [EMAIL_', 1 + c_custkey % 45, ']',
      CASE WHEN c_custkey % 5 = 0 THEN concat(' pw [SECRET_', 1 + c_custkey % 30, ']') ELSE ' [EMAIL_REDACTED]' END) AS text
  FROM customer)"""


def _typed(spark, sf):
    """Texts an agent wants to type, with tokens of its session."""
    m = X.messages(spark, sf).select("session_id", "text_id")
    k = F.col("text_id")
    body = F.concat(
        F.lit("To [NAME_"), X.text(1 + k % 90), F.lit("] via [EMAIL_"), X.text(1 + k % 45), F.lit("]"),
        F.when(k % 5 == 0, F.concat(F.lit(" pw [SECRET_"), X.text(1 + k % 30), F.lit("]"))).otherwise(" [EMAIL_REDACTED]"),
    )
    return m.withColumn("text", body)


@query(
    "token_extract",
    S.with_ctes(TYPED)
    + r"""SELECT text_id, pos - 1 AS pos, m[pos] AS token FROM (SELECT text_id, m, unnest(range(1, len(m) + 1)) AS pos
      FROM (SELECT text_id, regexp_extract_all(text, '\[[A-Z][A-Z_]*_\d+\]') AS m FROM typed))""",
)
def token_extract(spark, sf):
    from hushlake.functions.patterns import tokens_in

    return _typed(spark, sf).select("text_id", F.posexplode(tokens_in(F.col("text"))).alias("pos", "token"))


@query(
    "resolve_tokens",
    S.with_ctes(S.SIGHTINGS, S.VAULT, TYPED)
    + r""", uses AS (
      SELECT session_id, text_id, text, pos, m[pos] AS token FROM (SELECT *, unnest(range(1, len(m) + 1)) AS pos
        FROM (SELECT *, regexp_extract_all(text, '\[[A-Z][A-Z_]*_\d+\]') AS m FROM typed))),
    looked AS (
      SELECT u.*, v.value, CASE WHEN v.blocked THEN 'blocked_token' WHEN v.value IS NULL THEN 'unknown_token' END AS why
      FROM uses u LEFT JOIN vault v USING (session_id, token)),
    folded AS (
      SELECT session_id, text_id, any_value(text) AS text, coalesce(arg_min(why, pos) FILTER (why IS NOT NULL), 'ok') AS reason,
        count(*) AS tokens, list(token || chr(1) || coalesce(value, '') ORDER BY pos) AS kv
      FROM looked GROUP BY session_id, text_id)
    SELECT session_id, text_id, reason, tokens, CASE WHEN reason = 'ok' THEN
      list_reduce(list_prepend(text, kv), lambda a, p: replace(a, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) END AS resolved
    FROM folded""",
)
def resolve_tokens(spark, sf):
    out = V.resolve_tokens(_typed(spark, sf), V.vault_build(X.sightings(spark, sf)))
    return out.select("session_id", "text_id", "reason", "tokens", "resolved")


@query(
    "frame_manifest",
    S.with_ctes(S.SIGHTINGS, S.VAULT)
    + """, masks AS (SELECT s.session_id, s.seq // 2000 AS frame_id, s.seq AS pos, v.token, v.kind
      FROM sightings s JOIN vault v USING (session_id, kind, value)),
    firsts AS (SELECT session_id, frame_id, token, kind, min(pos) AS pos FROM masks GROUP BY ALL)
    SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id, frame_id ORDER BY pos) AS position, token, kind,
      upper(kind[1]) || lower(kind[2:]) AS label FROM firsts""",
)
def frame_manifest(spark, sf):
    seen = X.sightings(spark, sf)
    vault = V.vault_build(seen).select("session_id", "kind", "value", "token")
    masks = seen.join(vault, ["session_id", "kind", "value"]).select(
        "session_id", F.floor(F.col("seq") / 2000).alias("frame_id"), F.col("seq").alias("pos"), "token", "kind"
    )
    out = V.frame_manifest(masks).select("session_id", "frame_id", F.posexplode("manifest").alias("pos", "item"))
    return out.select("session_id", "frame_id", (F.col("pos") + 1).alias("position"), "item.*")


ITEMS = """items AS (
  SELECT concat(session_id, '/', first_seq // (CASE WHEN session_id % 3 = 0 THEN 6000 ELSE 1000 END)) AS request_id, token, value
  FROM vault WHERE kind = 'NAME')"""


def _items(spark, sf):
    """Compute requests over the NAME tokens of a session, some above the size limit."""
    v = V.vault_build(X.sightings(spark, sf)).filter(F.col("kind") == "NAME")
    part = F.floor(F.col("first_seq") / F.when(F.col("session_id") % 3 == 0, 6000).otherwise(1000))
    return v.select(F.concat_ws("/", "session_id", part).alias("request_id"), "token", "value")


ITEM_CTES = S.with_ctes(S.SIGHTINGS, S.VAULT, ITEMS)
SORTED = """, sized AS (SELECT request_id, count(*) AS n FROM items GROUP BY 1),
  ranked AS (SELECT request_id, n, CASE WHEN n > 40 THEN 'too_many_items' ELSE 'completed' END AS reason, token, value,
     row_number() OVER (PARTITION BY request_id ORDER BY value) AS rank FROM items JOIN sized USING (request_id))"""


@query(
    "private_sort",
    ITEM_CTES
    + SORTED
    + """ SELECT request_id, reason, rank, token FROM ranked WHERE n <= 40
      UNION ALL SELECT request_id, 'too_many_items', NULL, NULL FROM sized WHERE n > 40""",
)
def private_sort(spark, sf):
    return V.private_sort(_items(spark, sf))


@query(
    "private_select",
    ITEM_CTES
    + SORTED
    + """ SELECT request_id, reason, rank, token FROM ranked WHERE n BETWEEN 3 AND 40 AND rank <= 3
      UNION ALL SELECT request_id, CASE WHEN n > 40 THEN 'too_many_items' ELSE 'count_too_large' END, NULL, NULL
      FROM sized WHERE n > 40 OR n < 3""",
)
def private_select(spark, sf):
    return V.private_select(_items(spark, sf), 3)


ANSWERS = """, answers AS (
  SELECT request_id, CASE WHEN length(value) % 7 = 1 THEN token || 'x' ELSE token END AS token FROM items
    WHERE CAST(regexp_extract(token, '[0-9]+') AS INT) % 5 <> 1
  UNION ALL SELECT request_id, token FROM items WHERE CAST(regexp_extract(token, '[0-9]+') AS INT) % 5 = 2)"""


@query(
    "compute_result_check",
    ITEM_CTES
    + ANSWERS
    + """, a AS (SELECT request_id, token, count(*) AS n FROM items GROUP BY ALL),
    b AS (SELECT request_id, token, count(*) AS n FROM answers GROUP BY ALL)
    SELECT * FROM (SELECT request_id, token, CASE WHEN a.n IS NULL THEN 'unknown' WHEN b.n IS NULL THEN 'missing'
      WHEN b.n > a.n THEN 'duplicate' END AS problem FROM a FULL JOIN b USING (request_id, token)) WHERE problem IS NOT NULL""",
)
def compute_result_check(spark, sf):
    items = _items(spark, sf)
    number = F.regexp_extract("token", "[0-9]+", 0).cast("int")
    altered = F.when(F.length("value") % 7 == 1, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    answers = items.filter(number % 5 != 1).select("request_id", altered.alias("token")).unionAll(
        items.filter(number % 5 == 2).select("request_id", "token")
    )
    return V.compute_result_check(items, answers)


REMATCH = """, known AS (
  SELECT session_id, 'NAME' AS kind, text AS value FROM cards WHERE region_id = 5
  UNION ALL SELECT session_id, 'EMAIL', concat('c', session_id, '@example.net') FROM cards WHERE region_id = 2
  UNION ALL SELECT session_id, 'ADDRESS', max(text) FILTER (region_id = 6) || chr(10) || max(text) FILTER (region_id = 7) FROM cards GROUP BY session_id)
  SELECT DISTINCT c.session_id, c.frame_id, c.region_id, k.kind, k.value FROM cards c JOIN known k USING (session_id)
  WHERE contains(lower(regexp_replace(c.text, '\\s+', '', 'g')), lower(regexp_replace(k.value, '\\s+', '', 'g')))
    OR len(list_filter(string_split(k.value, chr(10)), lambda v: length(trim(v)) >= 4
         AND contains(lower(regexp_replace(c.text, '\\s+', '', 'g')), lower(regexp_replace(v, '\\s+', '', 'g'))))) > 0"""


@query("vault_rematch", S.with_ctes(S.CARDS) + REMATCH.replace("\\\\", "\\"))
def vault_rematch(spark, sf):
    """Known values of a session found again anywhere in its frames."""
    cards = X.contact_cards(spark, sf)
    key, line = F.col("session_id"), F.col("region_id")
    at = lambda n: F.max(F.when(line == n, F.col("text")))
    per = cards.groupBy("session_id").agg(at(5).alias("name"), F.concat_ws("\n", at(6), at(7)).alias("address"))
    values = F.array(
        F.struct(F.lit("NAME").alias("kind"), F.col("name").alias("value")),
        F.struct(F.lit("EMAIL").alias("kind"), F.concat(F.lit("c"), X.text(key), F.lit("@example.net")).alias("value")),
        F.struct(F.lit("ADDRESS").alias("kind"), F.col("address").alias("value")),
    )
    known = per.select("session_id", F.inline(values)).withColumn("explicit_secret", F.lit(False))
    return V.vault_rematch(cards, known).select("session_id", "frame_id", "region_id", "kind", "value")
