"""Patterns and word lists that decide what counts as private text.

Everything in the first block is a fixed value: results are only right if the
patterns match exactly the same characters.  They are written for
``java.util.regex``: ``(?U)`` makes ``\\d \\s \\b`` Unicode-aware, ``(?d)`` keeps
``\\n`` as the only line end, and a word character is spelled ``\\p{L}\\p{N}_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
EMAIL_NAME = r"[\p{L}\p{N}_.!#$%&'*+/=?^`{|}~-]"
EMAIL_PLACE = r"@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
PHONE = (
    r"(?U)(?<![\p{L}\p{N}_])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}_])\+\d{10,15}(?!\d)"
)
SECRET = (
    r"(?U)\b(?:sk[-_]|gh[pousr]_|github_pat_|AKIA|AIza)[A-Za-z0-9_-]{8,}\b"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
)
LABEL = (
    r"(?dUi)^(?<label>(?:full |first |last |customer |recipient |account holder )?name"
    r"|recipient|contact name|(?:shipping |billing |delivery |home |street )?address"
    r"|deliver to|ship to|password|passcode|api key|access token|secret"
    r"|email(?: address)?|phone(?: number)?|mobile(?: number)?|tel(?:ephone)?)"
    r"(?=[:：\s]|$)\s*[:：]?\s*(?<value>.*)$"
)
# Words a label can start with, at the start of any line of a text.
LABEL_WORDS = (
    r"full name|first name|last name|customer name|recipient|account holder name|name|contact name"
    r"|shipping address|billing address|delivery address|home address|street address|address"
    r"|deliver to|ship to|password|passcode|api key|access token|secret|email|phone|mobile|tel"
)
STREET = (
    r"(?Ui)\b\d{1,6}\s+[\p{L}\p{N}_ .'-]+\s(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr"
    r"|boulevard|blvd|court|ct|way|place|pl|terrace|trail|parkway|pkwy)\b"
)
CITY_POSTAL = (
    r"(?Ui)(?:\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b|\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"
    r"|\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b)"
)
UNIT_LINE = r"(?Ui)^(?:apt|suite|unit|#)\s*[\p{L}\p{N}_]"
GREETING = (
    r"(?dUi)^(?:hello|hi|welcome(?: back)?)[,!]?\s+"
    r"([\p{L}\p{N}_'’.-]+(?:\s+[\p{L}\p{N}_'’.-]+){0,3})$"
)
GREETING_STOP = ("there", "guest", "sign in")
SECRET_HELPER = (
    r"(?Ui)^(?:(?:forgot|reset|change|show|hide|recover)\s+(?:your\s+)?password"
    r"|password\s+(?:requirements?|strength|policy|help)"
    r"|use\s+at\s+least\s+\d+\s+characters)[?.!:]*$"
)
MASKED_SECRET = r"^[•●·*▪]{3,}$"
GLYPH_PROSE = r"(?U)^[•●·*▪\s]{3,}$"
PASSWORD_LABEL = r"(?Ui)^(?:password|passcode)\s*[:：]?$"
TOKEN = r"\[[A-Z][A-Z_]*_\d+\]"
REDACTED = r"^\[[A-Z_]+(?:_\d+)?\]$"
SECRET_LABELS = ("password", "passcode", "api key", "access token", "secret")
DELIVERY_LABELS = ("deliver to", "ship to")
PHONE_PREFIXES = ("phone", "mobile", "tel")
KINDS = ("EMAIL", "NAME", "ADDRESS", "PHONE", "SECRET")
VALUE_TRIM = " :：\t\n"
# White space that is stripped from both ends of a text.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line ends of a text: the universal set, with CR LF counted once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_PIECE = (
    r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    r"|[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+"
)
# ---- end of fixed values ----------------------------------------------------

# EMAIL_NAME+ EMAIL_PLACE, tried once for each run of name characters: at its first one, or where the last match ended.
# The name is a whole run, as no name character is an @, so nothing is gained by starting later or giving some back.
EMAIL = rf"(?:\G|(?<!{EMAIL_NAME})){EMAIL_NAME}++{EMAIL_PLACE}"

# Cheap necessary conditions: a text without them cannot match the costly pattern.
LABEL_HINT = r"(?Ui)(?:^|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])[\s\x1c-\x1f]*(?:" + LABEL_WORDS + ")"
DIGITS = r"(?U)\d{3}"
HOUSE_NUMBER = r"(?U)\d\s"
KEY_PREFIX = r"sk[-_]|gh[pousr]_|github_pat_|AKIA|AIza|eyJ"

GUARDED = (EMAIL, PHONE, SECRET, STREET)

# Ordered kind -> pattern registry; redaction runs in this order.
REGISTRY = (("EMAIL", EMAIL), ("PHONE", PHONE), ("SECRET", SECRET))


def strip(text: Column) -> Column:
    """Unicode-aware trim on both ends."""
    return F.trim(text, F.lit(SPACE))


def may_match(text: Column, pattern: str) -> Column:
    """False only for texts in which a costly pattern cannot occur."""
    if pattern == EMAIL:
        return text.contains("@")
    hints = {PHONE: DIGITS, SECRET: KEY_PREFIX, STREET: HOUSE_NUMBER}
    return text.rlike(hints[pattern]) if pattern in hints else text.isNotNull()


def has_street(text: Column) -> Column:
    return may_match(text, STREET) & text.rlike(STREET)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if pattern in GUARDED:
        return F.when(may_match(text, pattern), found).otherwise(F.array().cast("array<string>"))
    return found


def label_of(line: Column) -> Column:
    """Label part of a trimmed line; empty when the line has no label."""
    return F.regexp_extract(line, LABEL, 1)


def label_value(line: Column) -> Column:
    """Value part after the label; may be empty."""
    return F.regexp_extract(line, LABEL, 2)


def kind_of_label(label: Column) -> Column:
    """Private kind a label announces."""
    low = F.lower(label)
    address = low.contains("address") & ~low.contains("email")
    phone = F.lit(False)
    for prefix in PHONE_PREFIXES:
        phone = phone | low.startswith(prefix)
    return (
        F.when(low.isin(*SECRET_LABELS), "SECRET")
        .when(address | low.isin(*DELIVERY_LABELS), "ADDRESS")
        .when(low.contains("email"), "EMAIL")
        .when(phone, "PHONE")
        .otherwise("NAME")
    )


def is_explicit(line: Column) -> Column:
    """True when the label is directly followed by a colon."""
    rest = F.substring(line, F.length(label_of(line)) + 1, F.length(line))
    return (label_of(line) != "") & rest.rlike(r"(?U)^\s*[:：]")


def is_helper(text: Column) -> Column:
    """UI help around a password field, not a secret itself."""
    return strip(text).rlike(SECRET_HELPER)


def is_masked(text: Column) -> Column:
    """A run of masking glyphs, spaces ignored."""
    return F.replace(text, F.lit(" "), F.lit("")).rlike(MASKED_SECRET)


def greeting_name(line: Column) -> Column:
    """Name in a whole-line greeting, NULL for no greeting or a stop word."""
    name = F.regexp_extract(line, GREETING, 1)
    return F.when((name != "") & ~F.lower(name).isin(*GREETING_STOP), name)


def compact_key(text: Column) -> Column:
    """White space removed and case folded, for containment across re-flowed text."""
    return F.replace(F.lower(F.regexp_replace(text, r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))


def tokens_in(text: Column) -> Column:
    """All issued-token shapes in a text."""
    return matches(text, TOKEN)


def kind_title(kind: Column) -> Column:
    """Generic public label of a kind."""
    return F.initcap(F.lower(kind))


def redact(text: Column, registry=REGISTRY) -> Column:
    """Replace every registered pattern by its ``[KIND_REDACTED]`` marker, in order."""
    for kind, pattern in registry:
        clean = F.regexp_replace(text, pattern, f"[{kind}_REDACTED]")
        text = F.when(may_match(text, pattern), clean).otherwise(text) if pattern in GUARDED else clean
    return text


def _clean_line(piece: Column) -> Column:
    line = strip(piece)
    value = label_value(line)
    labelled = (value != "") & ~value.rlike(REDACTED)
    marker = F.concat(
        label_of(line),
        F.lit(": ["),
        kind_of_label(label_of(line)),
        F.lit("_REDACTED]"),
        F.when(piece.endswith("\n"), "\n").otherwise(""),
    )
    return F.when(labelled, marker).otherwise(F.regexp_replace(piece, STREET, "[ADDRESS_REDACTED]"))


def pattern_scrub(text: Column, registry=REGISTRY, extra=()) -> Column:
    """Redact patterns, then labelled values and street lines, line by line.

    ``extra`` is a list of ``Column -> Column`` stages applied afterwards.
    """
    plain = redact(text, registry)
    lines = F.array_join(F.transform(matches(plain, LINE_PIECE), _clean_line), "")
    out = F.when(plain.rlike(LABEL_HINT) | has_street(plain), lines).otherwise(plain)
    for stage in extra:
        out = stage(out)
    return out
