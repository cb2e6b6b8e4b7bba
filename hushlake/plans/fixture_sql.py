"""The same derived relations as CTEs for the SQL engine that checks the results."""

DOC_REGIONS = r"""doc_regions AS (
  SELECT source AS session_id, doc_id AS frame_id, CAST(pos - 1 AS BIGINT) AS region_id, parts[pos] AS text,
    17 AS x, 10 + 25 * (pos - 1) AS y, 170 AS width, 18 AS height, 0.91::DOUBLE AS confidence
  FROM (SELECT *, string_split(text, chr(10)) AS parts,
          unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents) d)"""

CARDS = r"""cards AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS session_id, l.frame_no::BIGINT AS frame_id, l.line_no::BIGINT AS region_id,
  CASE l.line_no
    WHEN 0 THEN 'Account contact'
    WHEN 1 THEN concat('Full name: ', c.c_name)
    WHEN 2 THEN concat('Email: c', CAST(c.c_custkey AS STRING), '@example.net')
    WHEN 3 THEN concat('+1 (', CAST(200 + c.c_custkey % 700 AS STRING), ') 555-', lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0'))
    WHEN 4 THEN 'Shipping address'
    WHEN 5 THEN c.c_name
    WHEN 6 THEN concat(CAST(1000 + c.c_custkey % 8000 AS STRING), ' Cedar Lane')
    WHEN 7 THEN concat('Albany, NY ', CAST(10000 + c.c_custkey % 89999 AS STRING))
    WHEN 8 THEN 'Continue'
    WHEN 9 THEN 'Password'
    WHEN 10 THEN 'Forgot password?'
    WHEN 11 THEN CASE WHEN c.c_custkey % 2 = 0 THEN '••••••' ELSE concat('pw-', CAST(c.c_custkey AS STRING)) END
    WHEN 12 THEN concat('API key: sk-demo', lpad(CAST(c.c_custkey AS STRING), 10, '0'))
    WHEN 13 THEN 'Hello, Mira Talbot'
    WHEN 14 THEN 'Name'
    WHEN 15 THEN 'Ines Okafor'
    WHEN 20 THEN c.c_name
    WHEN 21 THEN concat('c', CAST(c.c_custkey AS STRING), ' @example.net')
    ELSE 'Order summary' END AS text,
  l.x, l.y, l.width, l.height, 0.91::DOUBLE AS confidence
  FROM customer c CROSS JOIN (VALUES
  (0,0,17,10,170,18),(0,1,17,35,170,18),(0,2,17,60,170,18),(0,3,17,85,170,18),(0,4,17,110,170,18),
  (0,5,17,135,170,18),(0,6,17,160,170,18),(0,7,17,185,170,18),(0,8,17,210,170,18),(0,9,17,300,90,18),
  (0,10,400,300,120,18),(0,11,17,325,60,10),(0,12,17,400,200,18),(0,13,17,450,170,18),
  (0,14,17,500,60,20),(0,15,130,500,130,20),
  (1,20,390,210,170,18),(1,21,390,240,170,18),(1,22,390,270,170,18)
  ) AS l(frame_no, line_no, x, y, width, height))"""

OBSERVATIONS = r"""observations AS (
  SELECT session_id, seq, event_id, ts, event_type, reason, status, raw_key, sha256(raw_key) AS frame_hash, n_bytes, latency_ms FROM (
  SELECT CAST(user_id % 50 AS BIGINT) AS session_id,
    CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS BIGINT) AS seq,
    event_id, ts, event_type,
    CASE event_type WHEN 'click' THEN 'navigate' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'agent' WHEN 'signup' THEN 'open' ELSE 'error' END AS reason,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ready' END AS status,
    concat(event_type, '-', CAST(CAST(floor(abs(value)) AS BIGINT) % 3 AS STRING)) AS raw_key,
    3000000 * (1 + CAST(floor(abs(value)) AS BIGINT) % 3) + 1000 * CAST(length(event_type) AS BIGINT) AS n_bytes,
    CAST(floor(abs(value) * 100) AS BIGINT) AS latency_ms
  FROM events) t)"""

REQUESTS = r"""requests AS (
  SELECT conv_id AS run_id, turn AS step, concat('req-', CAST(conv_id AS STRING), '-', CAST(CASE WHEN (conv_id + turn) % 29 = 28 AND turn > 0 THEN turn - 1 ELSE turn END AS STRING)) AS request_id,
  CASE WHEN (conv_id + turn) % 13 = 12 THEN 'failed' WHEN (conv_id + turn) % 11 = 10 THEN 'prepared' ELSE 'responded' END AS status,
  CASE WHEN (conv_id + turn) % 13 = 12 THEN 401 WHEN (conv_id + turn) % 11 = 10 THEN NULL ELSE 200 END AS http_status,
  concat('resp-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS response_id,
  CASE WHEN turn = 0 THEN NULL WHEN (conv_id * 31 + turn) % 17 = 0 THEN 'resp-unknown'
       ELSE concat('resp-', CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS previous_response_id,
  CASE WHEN (conv_id + turn) % 19 = 18 THEN NULL ELSE CAST(length(text) AS BIGINT) END AS input_tokens,
  CAST(length(text) % 97 AS BIGINT) AS output_tokens,
  sha256(concat(CAST(conv_id AS STRING), '/', CAST(CAST(floor(turn / 2.0) AS BIGINT) AS STRING))) AS frame_hash,
  sha256(concat(CAST(conv_id AS STRING), '/', CAST(CAST(floor((CASE WHEN (conv_id + turn) % 23 = 22 THEN turn + 2 ELSE turn END) / 2.0) AS BIGINT) AS STRING))) AS payload_hash,
  concat('call-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS call_id,
  CASE WHEN turn = 0 THEN NULL WHEN (conv_id + turn) % 31 = 30 THEN 'call-wrong'
       ELSE concat('call-', CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS result_call_id,
  CASE WHEN turn % 3 = 0 THEN 'function_call' ELSE 'computer_call' END AS call_type,
  CASE WHEN (conv_id + turn) % 37 = 36 THEN concat('Enter c', CAST(conv_id AS STRING), '@example.net') ELSE 'Enter [EMAIL_1]' END AS payload_text
  FROM conversations)"""

FIELDS = r"""fields AS (
  SELECT page_id, url,
  CASE page_id % 11 WHEN 1 THEN 'search' WHEN 2 THEN 'password' WHEN 3 THEN 'text' WHEN 4 THEN 'tel' ELSE 'email' END AS type,
  CASE page_id % 11 WHEN 3 THEN 'section-a name' WHEN 4 THEN 'tel' WHEN 5 THEN 'tel' WHEN 6 THEN '' ELSE 'email' END AS autocomplete,
  CASE page_id % 11 WHEN 7 THEN 'q' ELSE 'contact' END AS name,
  page_id % 13 <> 12 AS focused, page_id % 17 <> 16 AS visible, page_id % 19 <> 18 AS editable, page_id % 11 = 8 AS search,
  CASE page_id % 11 WHEN 9 THEN 'get' ELSE 'post' END AS form_method,
  CASE page_id % 11 WHEN 10 THEN 'https://other.example' WHEN 9 THEN NULL ELSE '' END AS form_origin,
  page_id % 5 <> 4 AS origin_authorized,
  CASE page_id % 3 WHEN 0 THEN '[EMAIL_1]' WHEN 1 THEN '[NAME_2]' ELSE '[SECRET_1]' END AS token,
  CAST((page_id * 7) % 1400 AS DOUBLE) - 100.0::DOUBLE AS x, CAST((page_id * 13) % 1000 AS DOUBLE) - 50.0::DOUBLE AS y,
  CAST(20 + page_id % 300 AS DOUBLE) + 0.25::DOUBLE AS width, CAST(page_id % 40 AS DOUBLE) AS height
  FROM pages)"""

PIXELS = r"""pixels AS (
  SELECT p.p_partkey AS frame_id, gx.v AS x, gy.v AS y, 16777215 AS empty_rgb,
  CASE WHEN g.hit THEN 0 ELSE 16777215 END AS entered_rgb,
  CASE WHEN gx.v BETWEEN 4 AND m.right_edge AND gy.v BETWEEN 4 AND 23 AND NOT (p.p_partkey % 100 = 0 AND gx.v = 4) THEN 1582133
       WHEN g.hit THEN 0 ELSE 16777215 END AS protected_rgb,
  4 AS mask_x, 4 AS mask_y, m.right_edge - 3 AS mask_width, 20 AS mask_height, 'EMAIL' AS mask_kind
  FROM part p
  CROSS JOIN (SELECT unnest(range(40))::INT AS v) gx
  CROSS JOIN (SELECT unnest(range(40))::INT AS v) gy
  CROSS JOIN LATERAL (SELECT CASE WHEN p.p_partkey % 60 = 0 THEN 22 ELSE 23 END AS right_edge) m
  CROSS JOIN LATERAL (SELECT (gx.v BETWEEN 4 AND 23 AND gy.v BETWEEN 4 AND 23 AND (gx.v * 7 + gy.v * 11 + p.p_partkey) % 5 = 0) AS hit) g)"""

CAPTURES = r"""captures AS (
  SELECT frame_id, x, y, empty_rgb, entered_rgb, CASE WHEN frame_id % 50 = 9 AND x = 5 THEN NULL ELSE protected_rgb END AS protected_rgb,
    CASE WHEN frame_id % 13 = 5 AND x = 4 AND y = 4 THEN 1 ELSE empty_rgb END AS stable_rgb FROM pixels)"""

MASKS = r"""masks AS (
  SELECT p_partkey AS frame_id, CASE WHEN n = 1 AND p_partkey % 21 = 5 THEN 'PHONE' WHEN n = 2 THEN 'NAME' ELSE 'EMAIL' END AS kind,
    CASE n WHEN 2 THEN 0 WHEN 3 THEN 10 ELSE 4 END AS x, CASE n WHEN 0 THEN 4 WHEN 1 THEN 12 WHEN 2 THEN 0 ELSE -5 END AS y,
    CASE WHEN n = 2 THEN 40 WHEN n = 3 THEN 4 WHEN n = 1 AND p_partkey % 33 = 8 THEN NULL WHEN p_partkey % 60 = 0 THEN 19 ELSE 20 END AS width,
    CASE n WHEN 2 THEN 40 WHEN 3 THEN 1000000 ELSE 12 END AS height
  FROM part, range(4) AS r(n)
  WHERE p_partkey % 15 <> 7 AND (n < 2 OR n = 2 AND p_partkey % 4 = 1 OR n = 3 AND p_partkey % 6 = 2))"""

ENTERED_FIELDS = r"""fields AS (
  SELECT p_partkey AS frame_id, 0 AS field_id, 'EMAIL' AS kind, 4 AS l, 4 AS t, 24 AS r, 24 AS b FROM part
  UNION ALL SELECT p_partkey, 1, 'NAME', 0, 0, 40, 40 FROM part WHERE p_partkey % 10 = 3)"""

SIGHTINGS = r"""sightings AS (
  SELECT c_nationkey AS session_id, CAST(c_custkey * 4 + k.ord AS BIGINT) AS seq, k.kind,
  CASE k.ord WHEN 0 THEN c_name WHEN 1 THEN concat('c', CAST(c_custkey % 40 AS STRING), '@example.net')
             WHEN 2 THEN c_mktsegment ELSE CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE concat('pw-', CAST(c_custkey % 25 AS STRING)) END END AS value
  FROM customer CROSS JOIN (VALUES (0,'NAME'),(1,'EMAIL'),(2,'NAME'),(3,'SECRET')) AS k(ord, kind))"""

MESSAGES = r"""messages AS (
  SELECT c_nationkey AS session_id, c_custkey AS text_id,
    concat('Write to ', c_name, ' at c', c_custkey % 40, '@example.net about ', c_mktsegment, ' with pw-', c_custkey % 25,
           ' or pw-', c_custkey % 250, '.', chr(10), 'Email: other', c_custkey, '@example.org', chr(10), 'Address: ', c_custkey % 900,
           ' Cedar Lane', chr(10), 'Meet at ', 1 + c_custkey % 900, ' Old Mill Road today') AS text
  FROM customer)"""

VAULT = r"""first_seen AS (
  SELECT session_id, kind, value, min(seq) AS first_seq FROM sightings GROUP BY ALL),
vault AS (
  SELECT session_id, kind, value, first_seq,
    concat('[', kind, '_', row_number() OVER (PARTITION BY session_id, kind ORDER BY first_seq), ']') AS token,
    bool_or(kind = 'SECRET') OVER (PARTITION BY session_id, value) AS blocked
  FROM first_seen)"""

BUNDLE = r"""bundle AS (
  SELECT recording_id, sequence, event_id, type, status,
  CASE WHEN event_id % 41 = 40 THEN event_id + 100000000 ELSE prev_event_id END AS before_event_id, next_event_id AS after_event_id,
  concat('frame-', CAST(event_id % 200 AS STRING)) AS frame_id,
  concat('ADDRESS_', CAST(event_id % 10 AS STRING)) AS token,
  CASE WHEN event_id % 10 = 3 AND event_id % 20 >= 10 THEN 'billing_address' ELSE concat('role_', CAST(event_id % 10 AS STRING)) END AS role_hint
  FROM (
  SELECT user_id AS recording_id, event_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence,
    CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'check' ELSE 'correction' END AS type,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'passed' END
         WHEN event_type = 'purchase' THEN 'blocked' WHEN event_type = 'click' THEN 'executed' ELSE NULL END AS status,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id
  FROM events) t)"""

COMPONENTS = r"""components AS (
  SELECT s.s_suppkey AS frame_id, d.n AS component_id,
  CAST(30 + 5 * d.n + CASE WHEN s.s_suppkey % 5 = 0 THEN (d.n % 2) * 4 ELSE 0 END AS INT) AS x, 75 AS y, 4 AS w, 4 AS h, 12 AS area,
  1.0::DOUBLE AS fill_center, 25 AS label_x, 20 AS label_y, 100 AS label_width, 25 AS label_height, s.s_suppkey % 7 = 0 AS prose_over
  FROM supplier s CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS d(n)
  WHERE d.n < s.s_suppkey % 12)"""


def with_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
