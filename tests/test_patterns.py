"""Known texts and their expected readings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.functions import patterns as P


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("nobody@mail.example sk-abcdef2468", "[EMAIL_REDACTED] [SECRET_REDACTED]"),
        ("Password: quiet-lantern-88", "Password: [SECRET_REDACTED]"),
        ("Password: [SECRET_1]", "Password: [SECRET_1]"),
        ("Email: [EMAIL_REDACTED]\r\nok", "Email: [EMAIL_REDACTED]\r\nok"),
        ("  Full name: Rosa\r\nnext", "Full name: [NAME_REDACTED]\nnext"),
        ("Name\x0bPhone: x Secret y", "Name\x0bPhone: [PHONE_REDACTED]Secret: [SECRET_REDACTED]"),
        ("go to 47 Harbor Lane now", "go to [ADDRESS_REDACTED] now"),
        ("call +1 (402) 555-0163, or 555-123-4567", "call [PHONE_REDACTED], or [PHONE_REDACTED]"),
        ("josé@example.org", "[EMAIL_REDACTED]"),
        ("x1555-123-4567", "x1555-123-4567"),
        ("Namesake and Addressed parcels", "Namesake and Addressed parcels"),
        ("API key： abc", "API key: [SECRET_REDACTED]"),
        ("", ""),
    ],
)
def test_pattern_scrub(spark, text, want):
    assert one(spark, text, P.pattern_scrub) == want


@pytest.mark.parametrize(
    "label, kind",
    [
        ("Password", "SECRET"), ("api key", "SECRET"), ("Email address", "EMAIL"), ("Shipping Address", "ADDRESS"),
        ("Ship to", "ADDRESS"), ("Telephone", "PHONE"), ("mobile number", "PHONE"), ("Recipient", "NAME"), ("Full name", "NAME"),
    ],
)
def test_label_kind(spark, label, kind):
    assert one(spark, label, P.kind_of_label) == kind
    assert one(spark, label, P.label_of) == label


def test_labels_need_a_boundary(spark):
    assert one(spark, "Namesake", P.label_of) == ""
    assert one(spark, "Name", P.label_value) == ""
    assert one(spark, "Name：Cora", P.label_value) == "Cora"
    assert one(spark, "Name Ines Okafor", P.label_value) == "Ines Okafor"


def test_greetings(spark):
    assert one(spark, "Hello, Mira Talbot", P.greeting_name) == "Mira Talbot"
    assert one(spark, "Welcome back Zoë", P.greeting_name) == "Zoë"
    assert one(spark, "Hi there", P.greeting_name) is None
    assert one(spark, "Hello Rosa, how are you today", P.greeting_name) is None


def test_secret_rules(spark):
    assert one(spark, "Forgot password?", P.is_helper)
    assert not one(spark, "Password hunter2", P.is_helper)
    assert one(spark, "Password: x", P.is_explicit)
    assert not one(spark, "Password x", P.is_explicit)
    assert one(spark, "• • •", P.is_masked)
    assert not one(spark, "••", P.is_masked)


def test_tokens(spark):
    assert one(spark, "a [EMAIL_1] [EMAIL_REDACTED] [A_B_12]", P.tokens_in) == ["[EMAIL_1]", "[A_B_12]"]


def test_compact_key(spark):
    assert one(spark, "Straße   12\n B", P.compact_key) == "strasse12b"


def test_email_matches_as_if_tried_at_every_character(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "B", "é", ".", "-", "@", "@", " ", "com", ".org", "+", ",", "1"]) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    plain = f"{P.EMAIL_NAME}+{P.EMAIL_PLACE}"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", plain), ("b", P.EMAIL))))
    assert both.filter("a <> b").collect() == []
    assert both.filter("size(a) > 1").count() > 10
    cleaned = df.select(*(F.regexp_replace("t", p, "<>").alias(n) for n, p in (("a", plain), ("b", P.EMAIL))))
    assert cleaned.filter("a <> b").count() == 0


def test_email_is_linear_in_a_run_without_blanks(spark):
    start = time.perf_counter()
    text = "x" * 1_000_000 + "@ " + "y" * 1_000_000 + "@example.org"
    assert len(one(spark, text, lambda t: P.matches(t, P.EMAIL))[0]) == 1_000_012
    assert time.perf_counter() - start < 20
