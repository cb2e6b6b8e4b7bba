"""Pattern extraction, labels and scrubbing over whole documents, pages and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import patterns as P
from hushlake.plans import fixtures as X
from hushlake.plans import fixture_sql as S
from hushlake.plans.registry import query
from hushlake.plans.inputs import spread
from hushlake.sources.tables import table

# RE2 spellings of the patterns: no look-around, so boundaries are consumed.
W = r"\p{L}\p{N}_"
EMAIL = r"[" + W + r".!#$%&''*+/=?^`{|}~-]+@[" + W + r".-]+\.[A-Za-z]{2,}"
PHONE = (
    r"(?:\+\p{Nd}{1,3}[ .-]?)?(?:\(\p{Nd}{2,4}\)|\p{Nd}{3})[ .-]\p{Nd}{3}[ .-]\p{Nd}{4}|\+\p{Nd}{10,15}"
)
PHONE_IN = r"(^|[^" + W + r"])(" + PHONE + r")($|\P{Nd})"
SECRET = (
    r"(?:sk[-_]|gh[pousr]_|github_pat_|AKIA|AIza)[A-Za-z0-9_-]{8,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
SECRET_IN = r"(^|[^" + W + r"])(" + SECRET + r")($|[^" + W + r"])"
STREET = (
    r"\p{Nd}{1,6}\s+[" + W + r" .''-]+\s(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd"
    r"|court|ct|way|place|pl|terrace|trail|parkway|pkwy)"
)
STREET_IN = r"(?i)(^|[^" + W + r"])(" + STREET + r")($|[^" + W + r"])"
POSTAL = (
    r"(?i)(?:\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b|\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b|\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b)"
)
LABEL = (
    r"(?i)^((?:full |first |last |customer |recipient |account holder )?name|recipient|contact name"
    r"|(?:shipping |billing |delivery |home |street )?address|deliver to|ship to|password|passcode|api key"
    r"|access token|secret|email(?: address)?|phone(?: number)?|mobile(?: number)?|tel(?:ephone)?)"
)
LABEL_FULL = LABEL + r"(?:$|[:：\s]\s*[:：]?\s*(.*)$)"
HELPER = (
    r"(?i)^(?:(?:forgot|reset|change|show|hide|recover)\s+(?:your\s+)?password"
    r"|password\s+(?:requirements?|strength|policy|help)|use\s+at\s+least\s+\d+\s+characters)[?.!:]*$"
)
GREETING = r"(?i)^(?:hello|hi|welcome(?: back)?)[,!]?\s+([" + W + r"''’.-]+(?:\s+[" + W + r"''’.-]+){0,3})$"
BREAKS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}"
PIECE = f"[^{BREAKS}]*(?:\\r\\n|[{BREAKS}])|[^{BREAKS}]+"


def kind_sql(label: str) -> str:
    return f"""CASE WHEN lower({label}) IN ('password','passcode','api key','access token','secret') THEN 'SECRET'
      WHEN (contains(lower({label}), 'address') AND NOT contains(lower({label}), 'email')) OR lower({label}) IN ('deliver to','ship to') THEN 'ADDRESS'
      WHEN contains(lower({label}), 'email') THEN 'EMAIL'
      WHEN regexp_matches(lower({label}), '^(phone|mobile|tel)') THEN 'PHONE' ELSE 'NAME' END"""


def scrub_sql(text: str) -> str:
    """SQL for pattern redaction followed by the line rules."""
    red = f"regexp_replace({text}, '{EMAIL}', '[EMAIL_REDACTED]', 'g')"
    red = f"regexp_replace({red}, '{PHONE_IN}', '\\1[PHONE_REDACTED]\\3', 'g')"
    red = f"regexp_replace({red}, '{SECRET_IN}', '\\1[SECRET_REDACTED]\\3', 'g')"
    lab = f"regexp_extract(trim(p, ' ' || chr(9) || chr(10) || chr(13)), '{LABEL_FULL}', 1)"
    val = f"regexp_extract(trim(p, ' ' || chr(9) || chr(10) || chr(13)), '{LABEL_FULL}', 2)"
    return f"""array_to_string(list_transform(regexp_extract_all({red}, '{PIECE}'), lambda p:
      CASE WHEN {val} <> '' AND NOT regexp_matches({val}, '^\\[[A-Z_]+(?:_\\d+)?\\]$')
        THEN {lab} || ': [' || {kind_sql(lab)} || '_REDACTED]' || CASE WHEN ends_with(p, chr(10)) THEN chr(10) ELSE '' END
        ELSE regexp_replace(p, '{STREET_IN}', '\\1[ADDRESS_REDACTED]\\3', 'g') END), '')"""


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _extract(df, key, text, pattern):
    return df.select(key, F.posexplode(P.matches(F.col(text), pattern)).alias("pos", "value"))


def extract_sql(source, key, text, pattern, group):
    return f"""SELECT {key}, pos - 1 AS pos, m[pos] AS value FROM (SELECT {key}, m, unnest(range(1, len(m) + 1)) AS pos
      FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}', {group}) AS m FROM {source}))"""


@query("email_extract", extract_sql("documents", "doc_id", "text", EMAIL, 0))
def email_extract(spark, sf):
    return _extract(_documents(spark, sf), "doc_id", "text", P.EMAIL)


@query("phone_extract", extract_sql("documents", "doc_id", "text", PHONE_IN, 2))
def phone_extract(spark, sf):
    return _extract(_documents(spark, sf), "doc_id", "text", P.PHONE)


@query("email_extract_pages", extract_sql("pages", "page_id", "html", EMAIL, 0))
def email_extract_pages(spark, sf):
    return _extract(spread(table(spark, sf, "pages").select("page_id", "html")), "page_id", "html", P.EMAIL)


@query("phone_extract_pages", extract_sql("pages", "page_id", "html", PHONE_IN, 2))
def phone_extract_pages(spark, sf):
    return _extract(spread(table(spark, sf, "pages").select("page_id", "html")), "page_id", "html", P.PHONE)


_KEYED = "concat(session_id, '/', frame_id, '/', region_id)"


def _cards(spark, sf):
    return X.contact_cards(spark, sf).withColumn("region", F.concat_ws("/", "session_id", "frame_id", "region_id"))


def cards_sql(body: str) -> str:
    return S.with_ctes(S.CARDS, f"c AS (SELECT {_KEYED} AS region, trim(text) AS text FROM cards)") + body


@query("secret_extract", cards_sql(extract_sql("c", "region", "text", SECRET_IN, 2)))
def secret_extract(spark, sf):
    return _extract(_cards(spark, sf), "region", "text", P.SECRET)


@query("secret_extract_documents", extract_sql("documents", "doc_id", "text", SECRET_IN, 2))
def secret_extract_documents(spark, sf):
    return _extract(_documents(spark, sf), "doc_id", "text", P.SECRET)


@query("street_extract", extract_sql("documents", "doc_id", "text", STREET_IN, 2))
def street_extract(spark, sf):
    return _extract(_documents(spark, sf), "doc_id", "text", P.STREET)


@query("street_extract_cards", cards_sql(extract_sql("c", "region", "text", STREET_IN, 2)))
def street_extract_cards(spark, sf):
    return _extract(_cards(spark, sf), "region", "text", P.STREET)


@query("postal_match", cards_sql(f"SELECT region, regexp_matches(text, '{POSTAL}') AS postal FROM c"))
def postal_match(spark, sf):
    return _cards(spark, sf).select("region", F.col("text").rlike(P.CITY_POSTAL).alias("postal"))


@query(
    "greeting_name",
    cards_sql(f"""SELECT region, regexp_extract(text, '{GREETING}', 1) AS name FROM c
      WHERE regexp_matches(text, '{GREETING}') AND lower(regexp_extract(text, '{GREETING}', 1)) NOT IN ('there','guest','sign in')"""),
)
def greeting_name(spark, sf):
    named = _cards(spark, sf).select("region", P.greeting_name(P.strip(F.col("text"))).alias("name"))
    return named.filter(F.col("name").isNotNull())


@query(
    "label_parse",
    cards_sql(f"""SELECT region, regexp_extract(text, '{LABEL_FULL}', 1) AS label, regexp_extract(text, '{LABEL_FULL}', 2) AS value
      FROM c WHERE regexp_matches(text, '{LABEL_FULL}')"""),
)
def label_parse(spark, sf):
    line = P.strip(F.col("text"))
    parsed = _cards(spark, sf).select("region", P.label_of(line).alias("label"), P.label_value(line).alias("value"))
    return parsed.filter(F.col("label") != "")


@query(
    "label_kind",
    cards_sql(f"""SELECT label, {kind_sql('label')} AS kind, count(*) AS n FROM
      (SELECT regexp_extract(text, '{LABEL_FULL}', 1) AS label FROM c) WHERE label <> '' GROUP BY ALL"""),
)
def label_kind(spark, sf):
    label = P.label_of(P.strip(F.col("text"))).alias("label")
    labels = _cards(spark, sf).select(label).filter(F.col("label") != "")
    return labels.groupBy("label", P.kind_of_label(F.col("label")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "explicit_secret",
    cards_sql(f"""SELECT region, regexp_matches(text, '{LABEL}\\s*[:：]') AS explicit_secret,
        regexp_matches(text, '{HELPER}') AS helper
      FROM c WHERE {kind_sql(f"regexp_extract(text, '{LABEL_FULL}', 1)")} = 'SECRET' OR regexp_matches(text, '{HELPER}')"""),
)
def explicit_secret(spark, sf):
    line = P.strip(F.col("text"))
    label = P.label_of(line)
    rows = _cards(spark, sf).filter(((label != "") & (P.kind_of_label(label) == "SECRET")) | P.is_helper(line))
    return rows.select("region", P.is_explicit(line).alias("explicit_secret"), P.is_helper(line).alias("helper"))


@query("pattern_scrub", f"SELECT doc_id, sha256({scrub_sql('text')}) AS scrubbed_hash, text <> {scrub_sql('text')} AS changed FROM documents")
def pattern_scrub(spark, sf):
    out = _documents(spark, sf).withColumn("scrubbed", P.pattern_scrub(F.col("text")))
    return out.select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed_hash"), (F.col("scrubbed") != F.col("text")).alias("changed"))


@query("pattern_scrub_cards", S.with_ctes(S.CARDS) + f"SELECT {_KEYED} AS region, {scrub_sql('text')} AS scrubbed FROM cards")
def pattern_scrub_cards(spark, sf):
    return _cards(spark, sf).select("region", P.pattern_scrub(F.col("text")).alias("scrubbed"))


@query(
    "compact_key",
    f"SELECT doc_id, sha256(replace(lower(regexp_replace(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', '', 'g')), 'ß', 'ss')) AS compact_hash FROM documents",
)
def compact_key(spark, sf):
    return _documents(spark, sf).select("doc_id", F.sha2(P.compact_key(F.col("text")), 256).alias("compact_hash"))


ORDER_REF = r"\b(?:Brand|Customer)#\d+\b"


@query(
    "pattern_registry",
    """SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '\\b(?:Brand|Customer)#\\d+\\b', '[REFERENCE_REDACTED]', 'g') AS redacted FROM part""",
)
def pattern_registry(spark, sf):
    """A new kind is one more registry entry."""
    registry = (*P.REGISTRY, ("REFERENCE", ORDER_REF))
    line = F.concat_ws(" ", "p_brand", "p_name")
    return table(spark, sf, "part").select("p_partkey", P.redact(line, registry).alias("redacted"))


@query(
    "scrub_hook",
    cards_sql(f"SELECT region, regexp_replace({scrub_sql('text')}, '[0-9]{{5,}}', '#', 'g') AS scrubbed FROM c"),
)
def scrub_hook(spark, sf):
    """Extra scrub stages run after the built-in ones."""
    stage = lambda text: F.regexp_replace(text, "[0-9]{5,}", "#")
    return _cards(spark, sf).select("region", P.pattern_scrub(P.strip(F.col("text")), extra=[stage]).alias("scrubbed"))
