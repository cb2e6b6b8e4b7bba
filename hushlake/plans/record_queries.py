"""Request records: labels, receipts, chains, images, leaks, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import patterns as P
from hushlake.functions import records as R
from hushlake.operators import evidence as E
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans.registry import query
from hushlake.plans.text_queries import scrub_sql

MODEL = "'model-' || (run_id % 3)"
REQ = S.with_ctes(S.REQUESTS)
K = ["run_id", "step"]

RECORDS = """records AS (
  SELECT *, CASE WHEN (run_id + step) % 17 = 16 THEN 'rehearsal' ELSE 'live' END AS mode,
    CASE status WHEN 'responded' THEN true WHEN 'failed' THEN CASE WHEN step % 2 = 0 THEN NULL ELSE true END ELSE false END AS transmitted,
    CASE WHEN status = 'responded' AND input_tokens IS NOT NULL THEN response_id END AS receipt_id,
    CASE WHEN (run_id + step) % 41 = 40 THEN 'odd' WHEN (run_id + step) % 43 = 42 THEN 'sent' ELSE status END AS shown_status,
    CASE WHEN step % 4 = 0 THEN output_tokens END AS processing_ms, CASE WHEN step % 4 = 1 THEN output_tokens + 1 END AS latency_ms,
    CASE WHEN step % 4 = 2 THEN output_tokens + 2 END AS detector_ms
  FROM requests)"""
REC = S.with_ctes(S.REQUESTS, RECORDS)


def _records(spark, sf):
    r = X.requests(spark, sf)
    mixed, step = F.col("run_id") + F.col("step"), F.col("step")
    part = lambda n: F.when(step % 4 == n, F.col("output_tokens") + n)
    return r.select(
        "*",
        F.when(mixed % 17 == 16, "rehearsal").otherwise("live").alias("mode"),
        F.when(F.col("status") == "responded", True)
        .when(F.col("status") == "failed", F.when(step % 2 != 0, True))
        .otherwise(False)
        .alias("transmitted"),
        F.when((F.col("status") == "responded") & F.col("input_tokens").isNotNull(), F.col("response_id")).alias("receipt_id"),
        F.when(mixed % 41 == 40, "odd").when(mixed % 43 == 42, "sent").otherwise(F.col("status")).alias("shown_status"),
        part(0).alias("processing_ms"),
        part(1).alias("latency_ms"),
        part(2).alias("detector_ms"),
    )


@query(
    "audit_label",
    REC
    + f"""SELECT run_id, step, CASE WHEN mode = 'rehearsal' THEN '{R.LABELS['rehearsal']}' ELSE CASE shown_status WHEN 'prepared' THEN '{R.LABELS['prepared']}'
      WHEN 'sent' THEN '{R.LABELS['sent']}' WHEN 'responded' THEN CASE WHEN receipt_id IS NULL THEN '{R.LABELS['no_receipt']}' ELSE '{R.LABELS['receipt']}' END
      WHEN 'failed' THEN '{R.LABELS['failed']}' ELSE '{R.LABELS['legacy']}' END END AS label,
      mode <> 'rehearsal' AND (shown_status IN ('sent', 'responded') OR (shown_status = 'failed' AND coalesce(transmitted, false))) AS sent FROM records""",
)
def audit_label(spark, sf):
    mode, status = F.col("mode"), F.col("shown_status")
    return _records(spark, sf).select(
        *K,
        R.audit_label(mode, status, F.col("receipt_id")).alias("label"),
        R.audit_sent(mode, status, F.col("transmitted")).alias("sent"),
    )


@query(
    "audit_facts",
    REC
    + "SELECT run_id, step, coalesce(processing_ms, latency_ms, detector_ms) AS processing, CASE WHEN step % 5 = 4 THEN output_tokens % 7 ELSE step % 3 END AS masked FROM records",
)
def audit_facts(spark, sf):
    """Processing time from whichever field has it; mask count from the manifest, else the plain count."""
    manifest = F.when(F.col("step") % 5 != 4, F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("step") % 3).cast("int")))
    return _records(spark, sf).select(
        *K,
        F.coalesce("processing_ms", "latency_ms", "detector_ms").alias("processing"),
        F.when(manifest.isNull(), F.col("output_tokens") % 7).otherwise(F.size(manifest)).alias("masked"),
    )


@query(
    "receipt_classify",
    REC
    + """SELECT run_id, step, CASE WHEN status = 'failed' AND transmitted IS NULL THEN 'network_error' WHEN http_status IS NULL OR http_status NOT BETWEEN 200 AND 299 THEN 'api_error'
      WHEN step % 7 = 6 THEN 'invalid_response' WHEN receipt_id IS NULL THEN 'invalid_response' ELSE 'responded' END AS outcome FROM records""",
)
def receipt_classify(spark, sf):
    lost = (F.col("status") == "failed") & F.col("transmitted").isNull()
    outcome = R.receipt_status(lost, F.col("http_status"), F.col("step") % 7 != 6, F.col("receipt_id"), F.lit("m"))
    return _records(spark, sf).select(*K, outcome.alias("outcome"))


OUTPUT_SCHEMA = (
    "array<struct<type:string,call_id:string,name:string,arguments:string,"
    "actions:array<struct<type:string>>,action:struct<type:string>,content:array<struct<type:string,text:string>>>>"
)


def _outputs(spark, sf):
    """Provider output as JSON text, read with a fixed schema."""
    step = F.col("step")
    q = lambda s: F.lit(s)
    call = F.concat(
        q('{"type":"computer_call","call_id":"'), "call_id", q('",'),
        F.when(step % 2 == 1, '"actions":[{"type":"click"},{"type":"type"}]').otherwise('"action":{"type":"scroll"}'), q("}"),
    )
    func = F.concat(q('{"type":"function_call","call_id":"'), "call_id", q('","name":"navigate","arguments":"{}"}'))
    note = F.concat(
        q('{"type":"message","content":[{"type":"output_text","text":"'), "payload_text",
        q('"},{"type":"refusal","text":"no"},{"type":"output_text","text":"Password: '), "call_id", q('"}]}'),
    )
    text = F.concat(
        q("["), F.when(F.col("call_type") == "function_call", func).otherwise(call), F.when(step % 3 == 0, F.concat(q(","), note)).otherwise(""), q("]")
    )
    return X.requests(spark, sf).withColumn("output", F.from_json(text, OUTPUT_SCHEMA))


@query(
    "action_extract",
    REQ
    + """SELECT run_id, step, pos, type, CASE WHEN type = 'function_call' THEN call_id END AS call_id, CASE WHEN type = 'function_call' THEN 'navigate' END AS name FROM (
      SELECT run_id, step, call_id, unnest(CASE WHEN call_type = 'function_call' THEN ['function_call'] WHEN step % 2 = 1 THEN ['click', 'type'] ELSE ['scroll'] END) AS type,
        unnest(range(2)[1:CASE WHEN call_type <> 'function_call' AND step % 2 = 1 THEN 2 ELSE 1 END]) AS pos FROM requests)""",
)
def action_extract(spark, sf):
    out = _outputs(spark, sf).select(*K, F.posexplode(R.actions_of(F.col("output"))).alias("pos", "a"))
    return out.select(*K, "pos", "a.type", "a.call_id", "a.name")


@query(
    "answer_text",
    REQ
    + f"""SELECT run_id, step, CASE WHEN step % 3 = 0 THEN {scrub_sql("payload_text || chr(10) || 'Password: ' || call_id")} ELSE 'The task ended.' END AS answer FROM requests""",
)
def answer_text(spark, sf):
    return _outputs(spark, sf).select(*K, R.answer_text(F.col("output"), P.pattern_scrub, "The task ended.").alias("answer"))


IMAGE_SQL = "base64(from_hex('89504E470D0A1A0A') || from_hex({h}))"


def _image(hash_col: str):
    return F.base64(F.unhex(F.concat(F.lit(R.PNG_SIGNATURE), F.col(hash_col))))


@query(
    "payload_redact",
    REQ
    + """SELECT run_id, step, '{"text":"' || payload_text || '","image_url":"[protected frame displayed above]","link":"https://example.net/a","image_base64":"[protected frame displayed above]"}' AS view FROM requests""",
)
def payload_redact(spark, sf):
    q = lambda s: F.lit(s)
    text = F.concat(
        q('{"text":"'), "payload_text", q('","image_url":"data:image/png;base64,'), _image("payload_hash"),
        q('","link":"https://example.net/a","image_base64":"'), _image("frame_hash"), q('"}'),
    )
    return X.requests(spark, sf).select(*K, R.redact_images(text).alias("view"))


@query(
    "data_url_hash",
    REQ
    + f"""SELECT run_id, step, CASE WHEN (run_id + step) % 9 = 8 THEN 'invalid_base64' WHEN (run_id + step) % 9 = 7 THEN 'not_png' ELSE 'ok' END AS status,
      CASE WHEN (run_id + step) % 9 < 7 THEN sha256(from_hex('89504E470D0A1A0A') || from_hex(frame_hash)) END AS sha256 FROM requests""",
)
def data_url_hash(spark, sf):
    mixed = (F.col("run_id") + F.col("step")) % 9
    good = _image("frame_hash")
    encoded = (
        F.when(mixed == 8, F.concat(F.lit(R.DATA_URL), good, F.lit("*")))
        .when(mixed == 7, F.base64(F.unhex("frame_hash")))
        .when(mixed % 2 == 0, F.concat(F.lit(R.DATA_URL), good))
        .otherwise(good)
    )
    return X.requests(spark, sf).select(*K, R.decoded_png(encoded).alias("d")).select(*K, "d.*")


def _payloads(spark, sf):
    """Requests with their outgoing payload as a nested value."""
    text = F.concat("payload_text", F.when(F.col("step") % 3 == 0, " key-test-123456").otherwise(""))
    image = F.concat(F.lit(R.DATA_URL), _image("payload_hash"))
    content = F.array(
        F.struct(F.lit("input_text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url")),
        F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image_url")),
    )
    payload = F.struct(
        F.lit("model-a").alias("model"),
        F.col("previous_response_id").alias("previous_response_id"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("input"),
    )
    return X.requests(spark, sf).withColumn("payload", payload)


@query(
    "json_leaf_scrub",
    REQ
    + f"""SELECT run_id, step, {scrub_sql("payload_text || CASE WHEN step % 3 = 0 THEN ' [API_KEY_REDACTED]' ELSE '' END")} AS text, previous_response_id FROM requests""",
)
def json_leaf_scrub(spark, sf):
    df = _payloads(spark, sf)
    clean = R.scrub_leaves(F.col("payload"), df.schema["payload"].dataType, P.pattern_scrub, api_key="key-test-123456")
    out = df.select(*K, clean.alias("p"))
    return out.select(*K, F.col("p.input")[0]["content"][0]["text"].alias("text"), F.col("p.previous_response_id"))


def _strings(spark, sf):
    """Every exported string of a request except its images."""
    df = _payloads(spark, sf)
    found = R.strings_of(F.col("payload"), df.schema["payload"].dataType)
    out = df.select(*K, F.posexplode(found).alias("pos", "text"))
    return out.filter(~F.col("text").startswith("data:image/"))


@query(
    "json_strings",
    REQ
    + f"""SELECT run_id, step, unnest(['model', 'model-a'] || CASE WHEN previous_response_id IS NULL THEN [] ELSE ['previous_response_id', previous_response_id] END
      || ['input', 'role', 'user', 'content', 'type', 'input_text', 'text', payload_text || CASE WHEN step % 3 = 0 THEN ' key-test-123456' ELSE '' END, 'type', 'input_image', 'image_url']) AS text FROM requests""",
)
def json_strings(spark, sf):
    return _strings(spark, sf).select(*K, "text")


@query(
    "leak_scan",
    REQ + "SELECT run_id, step, concat('c', run_id, '@example.net') AS value FROM requests WHERE contains(payload_text, concat('c', run_id, '@example.net'))",
)
def leak_scan(spark, sf):
    return E.leak_scan(_strings(spark, sf), _private(spark, sf)).select(*K, "value")


def _private(spark, sf):
    value = F.concat(F.lit("c"), F.col("run_id").cast("string"), F.lit("@example.net")).alias("value")
    return X.requests(spark, sf).select("run_id", value).distinct()


@query(
    "chain_link",
    REQ
    + """, l AS (SELECT *, lag(response_id) OVER (PARTITION BY run_id ORDER BY step) AS prev FROM requests)
    SELECT run_id, step, CASE WHEN prev IS NULL AND previous_response_id IS NOT NULL THEN 'unaudited_history' WHEN prev IS NULL AND result_call_id IS NOT NULL THEN 'root_has_results'
      WHEN prev IS NOT NULL AND previous_response_id IS DISTINCT FROM prev THEN 'broken_link' ELSE 'ok' END AS reason FROM l""",
)
def chain_link(spark, sf):
    return E.chain_link(X.requests(spark, sf)).select(*K, "reason")


@query(
    "tool_result_match",
    REQ
    + """, c AS (SELECT *, lag(call_id) OVER w AS pc, lag(call_type) OVER w AS pt, lag(step) OVER w AS ps FROM requests WINDOW w AS (PARTITION BY run_id ORDER BY step))
    SELECT run_id, step, CASE WHEN pc IS NULL THEN 'ok' WHEN (run_id + ps) % 41 = 3 THEN 'no_preceding_calls' WHEN (run_id + step) % 43 = 2 THEN 'results_differ' WHEN (run_id + step) % 37 = 5 THEN 'result_identity_missing' WHEN ps % 6 = 5 THEN 'duplicate_calls'
      WHEN result_call_id = pc AND (ps % 4 = 1) = ((run_id + step) % 5 <> 0 AND ps % 4 = 1) THEN 'ok' ELSE 'results_differ' END AS reason FROM c""",
)
def tool_result_match(spark, sf):
    """Some records hold two calls, some repeat one, some results lack an id, are incomplete or missing."""
    return E.tool_result_match(_with_calls(X.requests(spark, sf))).select(*K, "reason")


def _with_calls(requests):
    step, mixed = F.col("step"), F.col("run_id") + F.col("step")
    call = F.struct("call_id", F.col("call_type").alias("type"))
    second = F.struct(F.concat("call_id", F.lit("-b")).alias("call_id"), F.col("call_type").alias("type"))
    calls = F.when(step % 6 == 5, F.array(call, call)).when(step % 4 == 1, F.array(call, second)).otherwise(F.array(call))
    prev_type = F.when((step - 1) % 3 == 0, "function_call_output").otherwise("computer_call_output")
    result = F.struct(F.col("result_call_id").alias("call_id"), prev_type.alias("type"))
    other = F.struct(F.concat("result_call_id", F.lit("-b")).alias("call_id"), prev_type.alias("type"))
    blank = F.struct(F.lit("").alias("call_id"), prev_type.alias("type"))
    results = (
        F.when(step == 0, F.array().cast("array<struct<call_id:string,type:string>>"))
        .when(mixed % 37 == 5, F.array(blank))
        .when(((step - 1) % 4 == 1) & (mixed % 5 != 0), F.array(other, result))
        .otherwise(F.array(result))
    )
    return requests.withColumn("calls", F.when(mixed % 41 != 3, calls)).withColumn("results", F.when(mixed % 43 != 2, results))


@query(
    "frame_changed",
    REQ
    + """SELECT * FROM (SELECT run_id, step, lag(response_id) OVER w AS after_response_id, frame_hash <> lag(frame_hash) OVER w AS frame_changed, lag(call_type) OVER w AS proposed
      FROM requests WINDOW w AS (PARTITION BY run_id ORDER BY step)) WHERE after_response_id IS NOT NULL""",
)
def frame_changed(spark, sf):
    return E.frame_changed(X.requests(spark, sf))


def _images():
    both = F.array("frame_hash", "payload_hash")
    given = F.when(F.col("step") % 5 == 4, both).otherwise(F.array("payload_hash"))
    return F.when((F.col("run_id") + F.col("step")) % 29 != 7, given)  # some records have no list of images


@query(
    "payload_image_match",
    REQ
    + """SELECT run_id, step, CASE WHEN (run_id + step) % 29 = 7 THEN 'no_payload_image' WHEN frame_hash = payload_hash THEN 'ok' WHEN step % 5 = 4 THEN 'additional_image' ELSE 'recorded_not_sent' END AS reason FROM requests""",
)
def payload_image_match(spark, sf):
    return X.requests(spark, sf).select(*K, E.image_match(F.col("frame_hash"), _images()).alias("reason"))


@query("unaudited_images", REQ + "SELECT run_id, step, payload_hash AS image FROM requests WHERE payload_hash <> frame_hash AND (run_id + step) % 29 <> 7")
def unaudited_images(spark, sf):
    extra = E.unaudited_images(F.col("frame_hash"), _images())
    return X.requests(spark, sf).select(*K, F.explode(extra).alias("image"))


@query(
    "duplicate_ids",
    REQ
    + """SELECT run_id, 'request_id' AS field, request_id AS id, count(*) AS uses FROM requests GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT run_id, 'response_id', response_id, count(*) FROM requests GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf):
    return E.duplicate_ids(X.requests(spark, sf))


@query("distinct_frames", REQ + "SELECT DISTINCT run_id, frame_hash FROM requests WHERE status IN ('sent', 'responded')")
def distinct_frames(spark, sf):
    return E.distinct_frames(X.requests(spark, sf))


TOOL = """CASE WHEN pc IS NULL THEN 'ok' WHEN (run_id + ps) % 41 = 3 THEN 'no_preceding_calls' WHEN (run_id + step) % 43 = 2 THEN 'results_differ'
      WHEN (run_id + step) % 37 = 5 THEN 'result_identity_missing' WHEN ps % 6 = 5 THEN 'duplicate_calls'
      WHEN result_call_id = pc AND (ps % 4 = 1) = ((run_id + step) % 5 <> 0 AND ps % 4 = 1) THEN 'ok' ELSE 'results_differ' END"""
AUDITED = """m AS (SELECT *, run_id + step AS mixed FROM requests),
  audited AS (SELECT run_id, step, mixed, status, frame_hash, input_tokens, http_status, previous_response_id, result_call_id, call_id,
    CASE WHEN mixed % 53 <> 7 THEN request_id END AS request_id,
    CASE WHEN mixed % 59 = 8 THEN '' WHEN mixed % 71 = 13 AND step > 0 THEN concat('resp-', run_id, '-', step - 1) ELSE response_id END AS response_id,
    CASE WHEN mixed % 47 <> 5 THEN 'model-a' END AS response_model, CASE WHEN mixed % 61 <> 9 THEN payload_text END AS payload,
    CASE WHEN mixed % 29 = 7 THEN NULL WHEN step % 5 = 4 THEN [frame_hash, payload_hash] ELSE [payload_hash] END AS images,
    CASE WHEN mixed % 67 = 11 THEN NULL WHEN mixed % 73 = 17 THEN payload_hash || 'x' ELSE frame_hash END AS image_hash,
    status = 'responded' AND mixed % 79 <> 3 AS transmitted, CASE WHEN mixed % 83 = 5 THEN 'file' ELSE 'web' END AS source,
    CASE WHEN mixed % 89 = 6 THEN 'model-b' ELSE 'model-a' END AS model FROM m)"""
SUMMARY = """sent AS (SELECT *, images IS NULL AS bare, coalesce(list_contains(images, image_hash), false) AS shown FROM audited WHERE status IN ('sent', 'responded')),
  flaws AS (
    SELECT run_id, 'missing_request_id' AS code FROM sent WHERE request_id IS NULL UNION SELECT run_id, 'missing_response_id' FROM sent WHERE response_id = ''
    UNION SELECT run_id, 'missing_model' FROM sent WHERE response_model IS NULL UNION SELECT run_id, 'missing_usage' FROM sent WHERE input_tokens IS NULL
    UNION SELECT run_id, 'missing_payload' FROM sent WHERE payload IS NULL UNION SELECT run_id, 'missing_payload_image' FROM sent WHERE bare
    UNION SELECT run_id, 'missing_image' FROM sent WHERE image_hash IS NULL UNION SELECT run_id, 'image_mismatch' FROM sent WHERE NOT bare AND image_hash IS NOT NULL AND NOT shown
    UNION SELECT run_id, 'frame_hash_mismatch' FROM sent WHERE image_hash <> frame_hash
    UNION SELECT run_id, 'missing_response' FROM sent WHERE status <> 'responded'),
  totals AS (SELECT r.run_id, count(s.step) AS responded, count(DISTINCT s.image_hash) FILTER (s.shown AND s.image_hash = s.frame_hash) AS distinct_frames,
    count(s.request_id) - count(DISTINCT s.request_id) AS duplicate_requests FROM (SELECT DISTINCT run_id FROM requests) r LEFT JOIN sent s ON s.run_id = r.run_id GROUP BY 1),
  issued AS (SELECT * FROM flaws UNION SELECT run_id, 'insufficient_sent' FROM totals WHERE responded < 2 UNION SELECT run_id, 'insufficient_frames' FROM totals WHERE distinct_frames < 2
    UNION SELECT run_id, 'duplicate_request' FROM totals WHERE duplicate_requests > 0)"""


def _audited(spark, sf):
    """Requests with one fault for each rule of the audit, in different records."""
    mixed, step = F.col("run_id") + F.col("step"), F.col("step")
    again = F.concat(F.lit("resp-"), X.text(F.col("run_id")), F.lit("-"), X.text(step - 1))
    r = _with_calls(X.requests(spark, sf))
    return r.select(
        *K, "status", "frame_hash", "input_tokens", "http_status", "previous_response_id", "result_call_id", "calls", "results",
        F.when(mixed % 53 != 7, F.col("request_id")).alias("request_id"),
        F.when(mixed % 59 == 8, "").when((mixed % 71 == 13) & (step > 0), again).otherwise(F.col("response_id")).alias("response_id"),
        F.when(mixed % 47 != 5, "model-a").alias("response_model"),
        F.when(mixed % 61 != 9, F.col("payload_text")).alias("payload"),
        _images().alias("images"),
        F.when(mixed % 73 == 17, F.concat("payload_hash", F.lit("x"))).otherwise(F.col("frame_hash")).alias("image_hash"),
        ((F.col("status") == "responded") & (mixed % 79 != 3)).alias("transmitted"),
        F.when(mixed % 83 == 5, "file").otherwise("web").alias("source"),
        F.when(mixed % 89 == 6, "model-b").otherwise("model-a").alias("model"),
    ).withColumn("image_hash", F.when(mixed % 67 != 11, F.col("image_hash")))


@query(
    "evidence_summary",
    S.with_ctes(S.REQUESTS, AUDITED, SUMMARY)
    + """SELECT t.*, coalesce(issues, '') AS issues FROM totals t LEFT JOIN (SELECT run_id, string_agg(code, ',' ORDER BY code) AS issues FROM issued GROUP BY 1) i USING (run_id)""",
)
def evidence_summary(spark, sf):
    return E.evidence_summary(_audited(spark, sf))


@query(
    "audit_verdict",
    S.with_ctes(S.REQUESTS, AUDITED, SUMMARY)
    + f""", l AS (SELECT *, lag(step) OVER w AS ps, lag(call_id) OVER w AS pc, nullif(lag(response_id) OVER w, '') AS prev FROM audited WINDOW w AS (PARTITION BY run_id ORDER BY step)),
    faults AS (SELECT * FROM issued UNION
      SELECT run_id, CASE WHEN ps IS NULL AND previous_response_id IS NOT NULL THEN 'unaudited_history' WHEN ps IS NULL AND result_call_id IS NOT NULL THEN 'root_has_results'
        WHEN ps IS NOT NULL AND (previous_response_id IS NULL OR previous_response_id IS DISTINCT FROM prev) THEN 'broken_link' END FROM l
      UNION SELECT run_id, {TOOL} FROM l UNION SELECT run_id, 'unsuccessful_record' FROM l WHERE status <> 'responded' UNION SELECT run_id, 'other_source' FROM l WHERE source <> 'web'
      UNION SELECT run_id, 'not_transmitted' FROM l WHERE NOT transmitted UNION SELECT run_id, 'bad_http_status' FROM l WHERE http_status IS NULL OR http_status NOT BETWEEN 200 AND 299
      UNION SELECT run_id, 'unexpected_model' FROM l WHERE model <> 'model-a'
      UNION SELECT run_id, 'additional_image' FROM l WHERE len(list_filter(images, lambda i: i IS DISTINCT FROM image_hash)) > 0
      UNION SELECT run_id, 'duplicate_response' FROM l WHERE response_id <> '' GROUP BY run_id, response_id HAVING count(*) > 1
      UNION SELECT run_id, 'private_value' FROM requests WHERE contains(payload_text, concat('c', run_id, '@example.net'))),
    said AS (SELECT run_id, string_agg(code, ',' ORDER BY code) AS reasons FROM faults WHERE code IS NOT NULL AND code <> 'ok' GROUP BY 1)
    SELECT run_id, responded, distinct_frames, coalesce(reasons, '') AS reasons, reasons IS NULL AS passed FROM totals LEFT JOIN said USING (run_id)""",
)
def audit_verdict(spark, sf):
    return E.audit_verdict(_audited(spark, sf), _strings(spark, sf), _private(spark, sf), "model-a")


@query(
    "usage_totals",
    REQ + f"SELECT run_id, {MODEL} AS model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS requests FROM requests GROUP BY ALL",
)
def usage_totals(spark, sf):
    model = F.concat(F.lit("model-"), (F.col("run_id") % 3).cast("string"))
    return E.usage_totals(X.requests(spark, sf).withColumn("model", model))


@query(
    "turn_limit",
    REQ
    + """, t AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) AS turn, step % 7 = 6 AS finished FROM requests QUALIFY turn <= 5)
    SELECT run_id, step, turn, count(*) OVER (PARTITION BY run_id) >= 5 AND NOT bool_or(finished) OVER (PARTITION BY run_id) AS limit_reached FROM t""",
)
def turn_limit(spark, sf):
    return E.turn_limit(X.requests(spark, sf).withColumn("finished", F.col("step") % 7 == 6), 5)


@query("audit_newest_first", REQ + "SELECT run_id, step, request_id, true AS listed FROM requests")
def audit_newest_first(spark, sf):
    """Records newest first: a range-partitioned sort, not a single-task one."""
    newest = X.requests(spark, sf).orderBy(F.desc("run_id"), F.desc("step"))
    return newest.select("run_id", "step", "request_id", F.lit(True).alias("listed"))


@query(
    "audit_scan",
    REQ + "SELECT run_id, step, status, request_id, payload_text AS text, 'model-a' AS model, len(['input_text', 'input_image']) AS parts FROM requests",
)
def audit_scan(spark, sf):
    """Records written as JSON lines and read back: fixed columns plus a dynamic payload."""
    from hushlake.sources.audit import read_requests, write_requests

    folder = write_requests(_payloads(spark, sf), spark)
    r = read_requests(spark, folder)
    get = lambda path, kind="string": F.variant_get("payload", path, kind)
    return r.select(
        *K,
        "status",
        "request_id",
        F.regexp_replace(get("$.input[0].content[0].text"), " key-test-123456$", "").alias("text"),
        get("$.model").alias("model"),
        F.size(get("$.input[0].content", "array<variant>")).alias("parts"),
    )


@query(
    "evidence_export",
    S.with_ctes(S.REQUESTS)
    + """SELECT run_id, 'header' AS part, 0::BIGINT AS pos, '{"schema":"evidence.v1","run_id":' || run_id || ',"requests":' || count(*) || '}' AS json FROM requests GROUP BY run_id
      UNION ALL SELECT run_id, 'request', step + 1, '{"request_id":"' || request_id || '","status":"' || status || '","frame_hash":"' || frame_hash || '"}' FROM requests
      UNION ALL SELECT run_id, 'event', step + 1, '{"kind":"' || call_type || '","message":"' || payload_text_clean || '"}' FROM (SELECT *, """
    + scrub_sql("payload_text")
    + " AS payload_text_clean FROM requests)",
)
def evidence_export(spark, sf):
    """Evidence bundles as JSON lines: one header per run, then its requests and scrubbed events in order."""
    from hushlake.sources.audit import evidence_lines

    r = X.requests(spark, sf)
    events = r.select("run_id", "step", F.col("call_type").alias("kind"), F.col("payload_text").alias("message"))
    return evidence_lines(r.select("run_id", "step", "request_id", "status", "frame_hash"), events)
