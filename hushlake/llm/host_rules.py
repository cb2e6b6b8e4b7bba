"""Quality rules of documents, and verdicts on their hosts by shrunken failure rates. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.components import keep_rows, text_hash
from hushlake.plans.storage import materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_FAILING = 0.7  # shrunken rate above which a host is refused
ORDER = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is read inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(windows: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes in order."""
    sorted_ = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            return before | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        # each start covers the words up to the next start, its window at most
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = _let(sorted_, lambda s: _let(twice(s), covered))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))


def _windows(hashes: Column) -> Column:
    n = F.size(hashes)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))


def text_rules(text: Column) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long); a null text has no word."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    hashes = _let(words, lambda ws: F.transform(ws, lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    numbers = _let(
        hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _let(_windows(h), _repeated).alias("n_repeat_words"))
    )
    doubled = _let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))
    return _let(
        numbers,
        lambda n: F.struct(
            n["n_words"].alias("n_words"),
            F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            doubled.alias("n_dup_lines"),
            n["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def host_verdicts(judged: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """``host, n_docs, n_failed, host_rate, host_ok`` from rows of ``host, base_failed``.

    The rate of a host is shrunk towards all hosts: a beta prior is fitted to the hosts' rates by their mean and
    variance. Where hosts do not differ (or there is one) the prior decides alone. Null is a host of its own.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rates = hosts.select((F.col("n_failed") / F.col("n_docs")).alias("rate"))
    prior = rates.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread")).first()
    mean, spread = prior["mean"], prior["spread"]
    if mean is None or not spread or not 0 < mean < 1:
        rate = F.lit(mean or 0.0)
    else:
        size = max(mean * (1 - mean) / spread - 1, 0.0)  # pseudo-documents of the prior
        rate = (F.col("n_failed") + F.lit(mean * size)) / (F.col("n_docs") + F.lit(size))
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= most)


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, host``, the rules, ``base_failed, host_rate, host_ok, kept`` for every row of ``docs``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. A document that passes is kept
    unless its host (``source``) is refused. Null and empty texts fail. Repeated rows count each; windows are compared
    by 64-bit hashes within a text. One map over the texts; what is shuffled afterwards has no text.
    """
    rules = docs.select(
        "doc_id", text_hash(docs["text"]).alias("text_hash"), docs["source"].alias("host"), text_rules(docs["text"]).alias("r")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rules.select("doc_id", "text_hash", "host", *(F.col(f"r.{n}").alias(n) for n in ORDER))
    judged = materialize(rows.withColumn("base_failed", failed), "rules")
    verdicts = host_verdicts(judged).select(F.col("host").alias("named"), "host_rate", "host_ok")
    joined = judged.join(verdicts, judged["host"].eqNullSafe(verdicts["named"]))
    return joined.drop("named").withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept."""
    return keep_rows(docs, quality(docs).filter("kept"))
