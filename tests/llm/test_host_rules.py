import re

import pytest
from pyspark.sql import functions as F

from hushlake.llm.host_rules import MOST_FAILING, ORDER, drop_low_quality, host_verdicts, quality
from tests.llm.conftest import documents, words


def slow_rules(text):
    text = text or ""
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(parts[i : i + 8]) for i in range(len(parts) - 7)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 2000 else dict.fromkeys(windows, 1)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(parts), sum(map(len, parts)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


EXTRA = [
    (20, "same line here\nsame line here\n \n \nsame line here", "en", "a"),
    (21, " ".join(words(8, 9) * 6), "en", "c"), (22, " ".join([*words(8, 30), *words(9, 3), *words(8, 30)]), "en", "c"),
    (23, "# * $ % & | < > " * 4, "en", "c"), (24, "w " * 20, "en", None), (25, " ".join(words(10, 19)), "en", "a"), (26, "\x0b".join(words(11, 20)), "en", "a"),
]


def test_rules_equal_brute_force(spark, odd_rows):
    rows = [*odd_rows, *EXTRA]
    got = quality(documents(spark, rows)).collect()
    want = sorted((str(i), *slow_rules(t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), *(r[c] for c in ORDER)) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed and r.host_ok) for r in got)


def test_hosts_are_shrunk(spark):
    counts = {"good": (0, 200), "bad": (190, 200), "few": (1, 1), "mid": (40, 100), None: (3, 10)}
    rows = [(h, n < bad) for h, (bad, all_) in counts.items() for n in range(all_)]
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    rates = [bad / n for bad, n in counts.values()]
    mean = sum(rates) / len(rates)
    spread = sum((r - mean) ** 2 for r in rates) / len(rates)
    size = max(mean * (1 - mean) / spread - 1, 0)
    for host, (bad, n) in counts.items():
        rate = (bad + mean * size) / (n + size)
        assert got[host].host_rate == pytest.approx(rate) and got[host].host_ok == (rate <= MOST_FAILING)
    assert not got["bad"].host_ok and got["good"].host_ok


def test_refused_hosts_lose_all_and_others_keep(spark):
    rows = [(n, "junk", "en", "bad") for n in range(60)] + [(n, " ".join(words(n, 30)), "en", "bad" if n == 60 else "good") for n in range(60, 100)]
    kept = drop_low_quality(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(range(61, 100))


def test_empty_and_extra_columns(odd_documents, no_documents):
    assert quality(no_documents).count() == drop_low_quality(no_documents).count() == 0
    kept = drop_low_quality(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.filter(F.col("doc_id") == 8).count() == 2 and kept.filter("text is null").count() == 0
