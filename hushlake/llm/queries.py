"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.best_fit import matrices
from hushlake.llm.bpe import digests
from hushlake.llm.cost_packing import packed
from hushlake.llm.host_rules import MOST_FAILING, ORDER, quality
from hushlake.llm.language import identify
from hushlake.llm.mixing import mixture
from hushlake.llm.onebit import nearest
from hushlake.llm.paragraphs import repeated_paragraphs
from hushlake.llm.prefix_trie import conversation_trie
from hushlake.llm.resampling import importance_ranks
from hushlake.llm.simhash import simhash_components
from hushlake.llm.suffixes import without_repeats
from hushlake.llm.warc import archive
from hushlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_simhash_components")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i+7], ' ')) AS seen
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM numbered WHERE len(words) >= 8)
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM win WHERE seen > 1) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), base AS (
  SELECT n.doc_id, n.source AS host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM numbered n LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM judged GROUP BY host
), prior AS (SELECT avg(bad / n) AS mu, var_pop(bad / n) AS v FROM hosts),
verdict AS (
  SELECT host, CASE WHEN v = 0 OR mu <= 0 OR mu >= 1 THEN mu
    ELSE (bad + mu * greatest(mu * (1 - mu) / v - 1, 0)) / (n + greatest(mu * (1 - mu) / v - 1, 0)) END <= {MOST_FAILING} AS ok
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ok) AS kept
FROM judged j JOIN verdict v ON j.host IS NOT DISTINCT FROM v.host
"""


@query("op4_host_rules", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents")).select("doc_id", *ORDER, "base_failed", "kept")


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (  -- parts of 256 starts: cutting every window out of a whole text takes time with the square of its length
  SELECT doc_id, k, substr(h, 2 * k + 1, 710) AS h
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 256)) AS k FROM d WHERE length(h) >= 200)
), pos AS (
  SELECT doc_id, k + j AS i, substr(h, 2 * j - 1, 200) AS s
  FROM (SELECT *, unnest(range(1, least(256, length(h) // 2 - 99) + 1)) AS j FROM part)
),
dup AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS nth FROM pos
  ) WHERE nth > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM dup
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS begin FROM runs
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
    string_agg(substr(h, 2 * begin - 1, 2 * (a - begin)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op6_suffix_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_cost_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packed(table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op2_best_fit_matrices")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return matrices(table(spark, folder, "documents"))


@query("op5_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, coalesce(html, '') AS payload FROM pages
), first AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, payload_bytes, base32 AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN first USING (payload) JOIN (
  SELECT payload, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', digit + 1, 1), '' ORDER BY nth) AS base32
  FROM (
    SELECT payload, nth,
      CAST(((CAST('0x' || substr(sha1(payload), 5 * (nth // 4) + 1, 5) AS BIGINT)) >> (15 - 5 * (nth % 4))) & 31 AS INTEGER) AS digit
    FROM first, range(32) AS r(nth)
  ) GROUP BY payload
) USING (payload)
"""


@query("op7_warc", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return archive(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


@query("op10_onebit_search", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


@query("op1_repeated_paragraphs")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_paragraphs(table(spark, folder, "documents"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a SQL string's UTF-8 bytes, bit by bit, the lowest bit of a byte first."""
    digits = f"hex(encode({text}))"
    # digits of a byte are written high to low: digit j is at place j + 2 - 2 * (j % 2)
    digit = f"(instr('0123456789ABCDEF', substr({digits}, i // 4 + 2 - 2 * ((i // 4) % 2), 1)) - 1)"
    bits = f"list_transform(range(4 * length({digits})), lambda i: ({digit} >> (i % 4)) & 1)"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), runs AS (
  SELECT r, array_to_string(words[i:i + k], ' ') AS run, count(*) AS n
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT r, words FROM d UNION ALL SELECT 0, words FROM b)), range(3) AS x(k)
  WHERE i + k <= len(words) GROUP BY 1, 2
), hashed AS (
  SELECT run, {crc32_sql("run")} % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs)
), counts AS (
  SELECT r, bucket, sum(n) AS n FROM runs JOIN hashed USING (run) GROUP BY r, bucket
), sums AS (
  SELECT bucket, CAST(sum(n) FILTER (r > 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (r = 0) AS DOUBLE) AS t FROM counts GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM sums) + 10000)
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, sum(n * gain) AS weight, sum(n) AS n_features FROM counts JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS BIGINT) AS score, len(words) >= 20 AS able
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 5 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    ranks = importance_ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'told': length(role) || ':' || role || text, 'size': strlen(text)}}
    ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM t GROUP BY conv_id
), paths AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS path
  FROM own c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5
), nodes AS (
  SELECT path[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(path)), '')) AS ends
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths) GROUP BY 1, 2
), parents AS (
  SELECT c.node, c.depth, c.conv_id, c.n, c.ends, p.conv_id AS parent_conv_id, (c.n - 1) * coalesce(c.node[c.depth].size, 0) AS saved,
    (SELECT count(*) FROM nodes k WHERE k.depth = c.depth + 1 AND k.node[1:c.depth] = c.node) AS n_children
  FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.node[1:c.depth - 1] AND c.depth > 0
), above AS (
  SELECT node[1:d] AS node, d AS depth, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM parents)
), below AS (
  SELECT node, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY node, depth
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM parents JOIN below USING (node, depth)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), steps AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY fit, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY fit, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM (SELECT *, source_size * (6 // weight) AS fit FROM s)
), level AS (
  SELECT rest, open FROM steps WHERE 3 * source_size * open >= rest * weight ORDER BY fit, source LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN 3 * source_size * open < rest * weight THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(rest AS DOUBLE) * weight / open END AS target FROM s, level
), plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS whole,
    words - CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END * source_size AS part
  FROM (SELECT *, least(3 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS words FROM targets)
), places AS (
  SELECT source, u, peers, coalesce(sum(peers) OVER (PARTITION BY source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, u, sum(size) AS peers FROM d GROUP BY source, u)
)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(p.whole * d.size + CASE WHEN e.before + e.peers <= p.part THEN d.size
    WHEN e.before < p.part THEN d.size * (p.part - e.before) // e.peers ELSE 0 END AS BIGINT) AS taken
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source JOIN places e ON d.source IS NOT DISTINCT FROM e.source AND d.u = e.u
"""


@query("op13_source_mixture", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
