"""WARC archives written and read by Spark's text files, and capture histories merged from locally sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.plans.storage import materialize, work_dir

LEAST_REVISIT = 0  # bytes of a payload from which on a repetition is a revisit
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01; a page without a time of its own is captured page_id seconds later
RUN_ROWS = 4096  # captures that are sorted in memory as one run
BUCKET_ROWS = 200_000  # captures of a range bucket, about
FAN_IN = 64  # runs that one pass merges
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CDX = "url_key string, captured long, page_id long, record_type string, refers_to long, payload_digest string"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base 32 of a hexadecimal SHA-1, by groups of five digits."""
    digits = [
        F.lpad(F.conv(F.substring(hex_digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels from the last to the first, then path and query, lower-cased; null is ''."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_extract(plain, r"^(?:[^/?@]*@)?([^/?]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.regexp_replace(plain, r"^[^/?]*", ""))


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, captured, payload, payload_bytes, payload_digest, record_type, refers_to`` of every row.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest page_id is a response, the others
    revisit it. Null payloads are empty. Rows that share the smallest page_id are all responses; a null page_id is
    a revisit unless all of the payload are null. The digests alone are grouped, partially first.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    found = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"], payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "utf-8")).alias("sha1"),
    )
    first = found.filter(F.col("payload_bytes") >= least).groupBy(F.col("sha1").alias("same")).agg(F.min("page_id").alias("first"))
    joined = found.join(first, found["sha1"] == first["same"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", (F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))).alias("captured"), "payload", "payload_bytes",
        base32(F.col("sha1")).alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _boundary(info: str) -> str:
    """What starts every record of one archive; its random name cannot occur in a payload."""
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{info}>\r\n"


def write_archives(rows: DataFrame, folder: str, info: str) -> None:
    """Writes :func:`records` as gzipped WARC files under ``folder``.

    A response holds an HTTP head and the payload, a revisit the head alone; the head's Content-Length is of the full
    payload. All records name the same warcinfo, which is how :func:`read_archives` finds where they start.
    """
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    text = F.concat(
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        field("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))),
        field("WARC-Profile", F.when(revisit, PROFILE)),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),  # the writer ends the record with another
    )
    writer = rows.select(F.concat(F.lit(_boundary(info)), text).alias("value")).write
    writer.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def read_archives(spark: SparkSession, folder: str, info: str) -> DataFrame:
    """``page_id, url, captured, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record."""
    parts = spark.read.option("lineSep", _boundary(info)).text(folder).filter("value <> ''")
    split = parts.select(
        F.expr("left(value, instr(value, '\\r\\n\\r\\n') + 1)").alias("head"),
        F.expr("substr(value, instr(value, '\\r\\n\\r\\n') + 4)").alias("rest"),
    )
    header = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))
    block = F.expr("cast(substr(cast(rest as binary), 1, size) as string)")
    split = split.withColumn("size", header("Content-Length").cast("int")).withColumn("block", block)
    body = F.expr("substr(block, instr(block, '\\r\\n\\r\\n') + 4)")
    page = lambda name: F.regexp_extract(header(name), "<urn:page:(.*)>", 1).try_cast("long")
    return split.select(
        page("WARC-Record-ID").alias("page_id"), header("WARC-Target-URI").alias("url"),
        F.unix_timestamp(header("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), body.alias("payload"),
        F.regexp_extract("block", r"Content-Length: (\d+)", 1).cast("long").alias("payload_bytes"),
        F.regexp_extract(header("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"),
        header("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


class LoserTree:
    """Merges sorted iterators: inner nodes keep the losers of their matches, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self._runs = runs
        self._heads: list[tuple | None] = [next(run, None) for run in runs]
        self._losers = [-1] * max(len(runs), 1)
        for n in range(len(runs)):
            self._play(n)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, n: int) -> None:
        """Sends run ``n`` up from its leaf; at an empty node (only while the tree is filled) it waits for its match."""
        node = (n + len(self._runs)) // 2
        while node:
            other = self._losers[node]
            if other < 0:
                self._losers[node] = n
                return
            if self._wins(other, n):
                self._losers[node], n = n, other
            node //= 2
        self._losers[0] = n

    def __iter__(self) -> Iterator[tuple]:
        while self._runs and (head := self._heads[n := self._losers[0]]) is not None:
            yield head
            self._heads[n] = next(self._runs[n], None)
            self._play(n)


def histories(captures: DataFrame) -> DataFrame:
    """``captures`` (columns of ``CDX``) in order of URL key, time and page_id, with ``run`` and a global ``bucket``.

    Tasks sort what they read in runs of at most ``RUN_ROWS`` rows. Range buckets of (key, time, page_id), which a hot key
    cannot fill alone, gather their part of every run, and each bucket merges its runs. Rows of ``bucket`` n come before
    those of n + 1; within it they stand in order of ``nth``. Null keys and times sort first.
    """
    names = [f.split()[0] for f in CDX.split(", ")]

    def sort_key(row: tuple) -> tuple:
        return tuple((v is not None, v) for v in row[:3])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                piece = batch.slice(at, RUN_ROWS)
                order = sorted(range(piece.num_rows), key=list(map(sort_key, zip(*(piece.column(c).to_pylist() for c in names[:3])))).__getitem__)
                piece = piece.take(pa.array(order, pa.int64()))
                columns = [piece.column(c) for c in names] + [pa.array([part] * len(order), pa.int64()), pa.array(range(len(order)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "run", "place"])
                part += 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        arrived: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "run"]), strict=True):
                arrived.setdefault(row[-1], []).append(row)
        level = [[(sort_key(row), row) for row in rows] for _, rows in sorted(arrived.items())]
        while len(level) > FAN_IN:
            level = [list(LoserTree([iter(r) for r in level[n : n + FAN_IN]])) for n in range(0, len(level), FAN_IN)]
        out, nth = [], 0
        for _, row in LoserTree([iter(r) for r in level]):
            out.append((*row[:-1], bucket, nth := nth + 1))
            if len(out) == 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64()}
        types = [*(kinds[f.split()[1]] for f in CDX.split(", ")), pa.int32(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [*names, "bucket", "nth"])

    sorted_runs = captures.select(*names).mapInArrow(runs, f"{CDX}, run long, place int")
    n = max(1, -(-captures.count() // BUCKET_ROWS))
    buckets = sorted_runs.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("run", "place")
    return buckets.mapInArrow(merge, f"{CDX}, bucket int, nth long")


def verified(read: DataFrame) -> DataFrame:
    """:func:`read_archives` without payloads; size and digest are those of the payload as it was read.

    A response's payload is measured and hashed again. A revisit has what the response it refers to has: the one of its
    page_id whose payload, as read, has the revisit's digest. A record that differs from its headers, or a revisit without
    such a response, fails the job.
    """
    payload = F.coalesce("payload", F.lit(""))
    size, digest = F.octet_length(payload).cast("long"), base32(F.sha1(F.encode(payload, "utf-8")))
    revisit = F.col("record_type").eqNullSafe("revisit")
    sound = size.eqNullSafe(F.col("payload_bytes")) & digest.eqNullSafe(F.col("payload_digest")) & F.col("record_type").eqNullSafe("response")
    name = F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))
    found = read.select(
        "url", "captured", "page_id", "record_type", "refers_to",
        F.when(revisit, F.col("payload_digest")).when(sound, digest).otherwise(F.raise_error(name)).alias("payload_digest"),
        F.when(~revisit, size).alias("payload_bytes"),
    )
    found = materialize(found, "read")
    responses = found.filter("record_type = 'response'").select(
        F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes")
    ).distinct()
    again = found.filter("record_type = 'revisit'")
    met = again.join(responses, (F.col("refers_to") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    met = met.withColumn("payload_bytes", F.when(F.col("of_bytes").isNotNull(), F.col("of_bytes")).otherwise(F.raise_error(name)))
    return found.filter("record_type = 'response'").unionByName(met.select(*found.columns))


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to WARC files in the shared folder, reads them back and returns their merged capture histories
    with the payload's size and digest as read (:func:`verified`): one row for each row of ``pages``. Null payloads are empty, repeated
    rows are records of their own, and null ids and URLs sort first."""
    spark, info = pages.sparkSession, str(uuid.uuid4())
    folder = work_dir(spark, "warc")
    write_archives(records(pages), folder, info)
    read = verified(read_archives(spark, folder, info))
    index = materialize(
        read.select(
            url_key(F.col("url")).alias("url_key"), "captured", "page_id", "record_type", "refers_to",
            F.concat_ws(" ", "payload_digest", "payload_bytes").alias("payload_digest"),
        ), "cdx",
    )
    merged = histories(index)
    both = F.split("payload_digest", " ")
    return merged.withColumn("payload_bytes", both[1].cast("long")).withColumn("payload_digest", both[0])
