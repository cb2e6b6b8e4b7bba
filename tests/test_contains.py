"""Substring search against brute force."""

import random

from hushlake.operators.contains import FEW, candidate_values, present_values
from hushlake.operators.vault import full_scrub, resolve_tokens, vault_build, vault_scrub


def test_present_values_equals_brute_force(spark):
    rng = random.Random(5)
    alphabet = "abé \n"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(s, i, word(rng.randrange(0, 60))) for s in (1, 2) for i in range(60)] + [(1, 999, "prefix-shared-0001 prefix-shared-0002")]
    values = [(rng.choice([1, 2, 3]), word(rng.randrange(1, 12))) for _ in range(120)]
    values += [(1, f"prefix-shared-{i:04d}") for i in range(50)]
    got = present_values(
        spark.createDataFrame(texts, "k int, id int, text string"), spark.createDataFrame(values, "k int, value string"), ["k"], ["id"]
    )
    want = {(k, i, v) for k, i, t in texts for kk, v in values if k == kk and v in t}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == want


def vault_of(spark, rows):
    df = spark.createDataFrame([(1, n, k, v) for n, (k, v) in enumerate(rows)], "session_id int, seq long, kind string, value string")
    return vault_build(df, width=2)


def texts_of(spark, *texts):
    return spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "session_id int, text_id int, text string")


def test_longest_value_first(spark):
    vault = vault_of(spark, [("NAME", "Alice"), ("NAME", "Alice Smith")])
    assert vault_scrub(texts_of(spark, "Alice Smith and Alice"), vault).first().scrubbed == "[NAME_2] and [NAME_1]"


def test_replacement_is_one_pass_and_literal(spark):
    vault = vault_of(spark, [("NAME", "NAME"), ("SECRET", "a.b\\E$1"), ("EMAIL", "1")])
    out = vault_scrub(texts_of(spark, "NAME 1 a.b\\E$1 axb", "none"), vault).orderBy("text_id").collect()
    assert out[0].scrubbed == "[NAME_1] [EMAIL_1] [SECRET_1] axb"
    assert (out[1].scrubbed, out[1].hits) == ("none", 0)


def test_secret_token_wins_and_blocks(spark):
    vault = vault_of(spark, [("NAME", "hidden"), ("SECRET", "hidden"), ("NAME", "open")])
    state = {(r.kind, r.value): (r.token, r.blocked) for r in vault.collect()}
    assert state[("NAME", "hidden")] == ("[NAME_1]", True)
    assert state[("SECRET", "hidden")] == ("[SECRET_1]", True)
    assert state[("NAME", "open")] == ("[NAME_2]", False)
    assert vault_scrub(texts_of(spark, "hidden"), vault).first().scrubbed == "[SECRET_1]"


def test_full_scrub(spark):
    vault = vault_of(spark, [("NAME", "Mira Talbot")])
    out = full_scrub(texts_of(spark, "Mira Talbot <mt@mail.example>\nPassword: x"), vault).first()
    assert out.scrubbed == "[NAME_1] <[EMAIL_REDACTED]>\nPassword: [SECRET_REDACTED]"


def test_resolve(spark):
    vault = vault_of(spark, [("NAME", "Cora"), ("SECRET", "pw"), ("EMAIL", "a@b.example")])
    texts = texts_of(spark, "To [NAME_1] at [EMAIL_1].", "x [SECRET_1] [NAME_9]", "[NAME_9]", "plain [EMAIL_REDACTED]")
    out = {r.text_id: (r.resolved, r.reason) for r in resolve_tokens(texts, vault).collect()}
    assert out == {
        0: ("To Cora at a@b.example.", "ok"),
        1: (None, "blocked_token"),
        2: (None, "unknown_token"),
        3: ("plain [EMAIL_REDACTED]", "ok"),
    }


def test_scrub_random_texts(spark):
    rng = random.Random(11)
    values = list({"".join(rng.choice("ab1-") for _ in range(rng.randrange(2, 14))) for _ in range(40)})
    vault = vault_of(spark, [("NAME", v) for v in values])
    texts = ["".join(rng.choice("ab1- ") for _ in range(80)) for _ in range(40)]
    names = {r.value: r.token for r in vault.collect()}
    longest = sorted(values, key=len, reverse=True)

    def brute(text):
        out, at = [], 0
        while at < len(text):
            hit = next((v for v in longest if text.startswith(v, at)), None)
            out.append(names[hit] if hit else text[at])
            at += len(hit) if hit else 1
        return "".join(out)

    got = {r.text_id: r.scrubbed for r in vault_scrub(texts_of(spark, *texts), vault).collect()}
    assert got == {n: brute(t) for n, t in enumerate(texts)}


def test_values_of_few_travel_as_lists_and_no_text_is_cut_into_grams(spark):
    texts = [(s, i, f"call Ann-{s} or Bob-{i} now") for s in (1, 2, None) for i in (0, 1, None)] + [(1, 0, "Ann-1 again"), (1, 5, None)]
    values = [(s, f"{name}-{n}") for s in (1, 2, None) for name in ("Ann", "Bob") for n in range(3)] + [(1, ""), (1, None)]
    frame = lambda rows, what: spark.createDataFrame(rows, f"k int, id int, {what} string")
    named = spark.createDataFrame(values, "k int, value string")
    got = present_values(frame(texts, "text"), named, ["k"], ["id"])
    assert "_gram" not in got._jdf.queryExecution().toString()
    want = sorted((k, i, v) for k, i, t in texts for kk, v in values if None not in (k, i, t, v) and v and k == kk and v in t)
    assert sorted(map(tuple, got.collect())) == want
    many = named.unionByName(spark.range(FEW + 1).selectExpr("2 AS k", "concat('Bob-', id) AS value")).distinct()
    got = present_values(frame(texts, "text"), many, ["k"], ["id"])
    assert "_gram" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == want
    found = candidate_values(frame(texts, "text"), many, ["k"], ["id"]).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} >= set(want)
    assert present_values(frame(texts, "text"), named.filter("value = ''"), ["k"], ["id"]).count() == 0
