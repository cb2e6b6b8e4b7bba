"""Policy gates on the known good and bad cases."""

import pytest
from pyspark.sql import functions as F

from hushlake.functions import gates as G
from hushlake.operators.policy import destination_gate

HOME = "https://forms.hushlake.test"
FIELD = {
    "origin": HOME, "focused": True, "visible": True, "editable": True, "type": "tel", "autocomplete": "tel", "name": "line_two",
    "id": "f7", "role": "textbox", "label": "Daytime line", "search": False, "form_origin": HOME, "form_method": "post", "tokens": ["[PHONE_4]"],
}
#: Changes that break one rule each, in the order in which rules are applied.
BROKEN = {
    "not_authorized": [{"origin": "https://forms.hushlake.test:444"}, {"origin": None}],
    "not_a_focused_field": [{flag: value} for flag in ("visible", "focused", "editable") for value in (False, None)],
    "unsafe_destination": [
        *({"type": t} for t in G.UNSAFE_TYPES), *({c: "find by website"} for c in ("name", "id", "role", "label")), {"id": "Q"},
        {"search": True}, {"form_method": "get"}, {"form_origin": "http://forms.hushlake.test"}, {"form_origin": None},
    ],
    "ambiguous_field": [{"autocomplete": "work email"}],
    "class_mismatch": [{"tokens": ["[PHONE_4]", "[ADDRESS_1]"]}, {"type": "number", "autocomplete": "one-time-code"}],
}


def reasons(spark, fields):
    schema = (
        "n int, origin string, focused boolean, visible boolean, editable boolean, type string, autocomplete string, name string, "
        "id string, role string, label string, search boolean, form_origin string, form_method string, tokens array<string>"
    )
    rows = [(n, *[field[c] for c in FIELD]) for n, field in enumerate(fields)]
    authorized = spark.createDataFrame([(HOME,)], "origin string")
    got = {r.n: r.reason for r in destination_gate(spark.createDataFrame(rows, schema), authorized).collect()}
    return [got[n] for n in range(len(fields))]


def test_each_rule_of_a_destination(spark):
    cases = [(FIELD | change, reason) for reason, changes in BROKEN.items() for change in changes]
    cases += [(FIELD, "ok"), (FIELD | {"form_origin": ""}, "ok")]
    cases += [(FIELD | {"type": "text", "autocomplete": "section-b family-name", "tokens": ["[NAME_2]", "[NAME_9]"]}, "ok")]
    assert reasons(spark, [field for field, _ in cases]) == [reason for _, reason in cases]


def test_earlier_rules_of_a_destination_win(spark):
    order = list(BROKEN)
    pairs = [(first, second) for n, first in enumerate(order) for second in order[n + 1 :]]
    fields = [FIELD | BROKEN[second][0] | BROKEN[first][0] for first, second in pairs]
    assert reasons(spark, fields) == [first for first, _ in pairs]


def scalar(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


#: What may be wrong with an address, each thing alone.
REFUSED = {
    "bad_characters": ["https://shop.hushlake.test/\tcart", " https://shop.hushlake.test", "https://shop.hushlake.test\\@mail.test", None],
    "not_https": ["http://shop.hushlake.test", "ftp://shop.hushlake.test/list", "mailto:desk@hushlake.test", "shop.hushlake.test", "blob:https://x", ""],
    "no_host": ["https:///list", "https://?a=1"],
    "credentials": ["https://desk@shop.hushlake.test", "https://:pw@shop.hushlake.test"],
    "bad_host_or_port": ["https://shop.hushlake.test:70000", "https://shop.hushlake.test:8x", "https://shop..test", f"https://{'a' * 64}.test"],
}


@pytest.mark.parametrize("reason", REFUSED)
def test_refused_urls(spark, reason):
    assert [scalar(spark, url, G.url_reason) for url in REFUSED[reason]] == [reason] * len(REFUSED[reason])


def test_allowed_urls_and_origins(spark):
    assert scalar(spark, "https://shop.hushlake.test/list?page=3#top", G.url_reason) == "ok"
    origins = {"https://Shop.Hushlake.TEST:443/x": "https://shop.hushlake.test", "https://shop.hushlake.test:444": "https://shop.hushlake.test:444"}
    assert {u: scalar(spark, u, G.url_origin) for u in origins} == origins
    loopback = lambda u: G.url_reason(u, allow_loopback=True)
    assert [scalar(spark, u, loopback) for u in ("http://localhost:81/", "http://[::1]/", "http://10.0.0.7/")] == ["ok", "ok", "not_https"]


@pytest.mark.parametrize("key", G.ALLOWED_KEYS)
def test_every_allowed_key_is_named(spark, key):
    got = scalar(spark, [key.lower()], G.key_chord, "array<string>")
    assert got.allowed and got.normalized == G.KEY_NAMES[key]


def test_chords(spark):
    said = lambda keys: scalar(spark, keys, G.key_chord, "array<string>").normalized
    assert {m: said([m.lower(), "a"]) for m in G.SELECT_ALL} == {"CTRL": "Control+A", "CONTROL": "Control+A", "CMD": "Meta+A", "META": "Meta+A"}
    refused = [[m, "TAB"] for m in G.MODIFIERS] + [[m, "Z"] for m in G.SELECT_ALL] + [["CTRL", "A", "A"], ["SHIFT", "A"], ["F2"], [None], [], None]
    assert [said(keys) for keys in refused] == [None] * len(refused)
    assert said(["shift", "home"]) == "Shift+Home" and said(["esc"]) == "Esc"
