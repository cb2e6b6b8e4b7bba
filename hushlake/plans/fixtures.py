"""Relations derived from the input tables: the data model the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.ordered import ordered, time_chunk
from hushlake.plans.inputs import spread
from hushlake.sources.tables import table

# Geometry of a contact card: (frame, line, x, y, width, height).
CARD_LINES = (
    (0, 0, 17, 10, 170, 18), (0, 1, 17, 35, 170, 18), (0, 2, 17, 60, 170, 18),
    (0, 3, 17, 85, 170, 18), (0, 4, 17, 110, 170, 18), (0, 5, 17, 135, 170, 18),
    (0, 6, 17, 160, 170, 18), (0, 7, 17, 185, 170, 18), (0, 8, 17, 210, 170, 18),
    (0, 9, 17, 300, 90, 18), (0, 10, 400, 300, 120, 18), (0, 11, 17, 325, 60, 10),
    (0, 12, 17, 400, 200, 18), (0, 13, 17, 450, 170, 18), (0, 14, 17, 500, 60, 20),
    (0, 15, 130, 500, 130, 20), (1, 20, 390, 210, 170, 18), (1, 21, 390, 240, 170, 18),
    (1, 22, 390, 270, 170, 18),
)


def text(col: Column) -> Column:
    return col.cast("string")


def pick(key: Column, cases: dict, default) -> Column:
    """``CASE key WHEN ... END`` with literal branches."""
    out = None
    for value, result in cases.items():
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(key == value, result) if out is None else out.when(key == value, result)
    return out.otherwise(default)


def doc_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document as a screen region; session = source, frame = document."""
    return regions_of(spread(table(spark, sf, "documents")))


def regions_of(documents: DataFrame) -> DataFrame:
    lines = documents.select(
        F.col("source").alias("session_id"),
        F.col("doc_id").alias("frame_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"),
    )
    return lines.select(
        "session_id",
        "frame_id",
        F.col("pos").cast("long").alias("region_id"),
        "text",
        F.lit(17).alias("x"),
        (10 + 25 * F.col("pos")).alias("y"),
        F.lit(170).alias("width"),
        F.lit(18).alias("height"),
        F.lit(0.91).alias("confidence"),
    )


def contact_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled cards per customer (frame 0) and the bare values moved (frame 1)."""
    key, name, num = F.col("c_custkey"), F.col("c_name"), text(F.col("c_custkey"))
    bodies = {
        0: F.lit("Account contact"),
        1: F.concat(F.lit("Full name: "), name),
        2: F.concat(F.lit("Email: c"), num, F.lit("@example.net")),
        3: F.concat(F.lit("+1 ("), text(200 + key % 700), F.lit(") 555-"), F.lpad(text(key % 10000), 4, "0")),
        4: F.lit("Shipping address"),
        5: name,
        6: F.concat(text(1000 + key % 8000), F.lit(" Cedar Lane")),
        7: F.concat(F.lit("Albany, NY "), text(10000 + key % 89999)),
        8: F.lit("Continue"),
        9: F.lit("Password"),
        10: F.lit("Forgot password?"),
        11: F.when(key % 2 == 0, "••••••").otherwise(F.concat(F.lit("pw-"), num)),
        12: F.concat(F.lit("API key: sk-demo"), F.lpad(num, 10, "0")),
        13: F.lit("Hello, Mira Talbot"),
        14: F.lit("Name"),
        15: F.lit("Ines Okafor"),
        20: name,
        21: F.concat(F.lit("c"), num, F.lit(" @example.net")),
        22: F.lit("Order summary"),
    }
    lines = [
        F.struct(
            F.lit(frame).cast("long").alias("frame_id"),
            F.lit(line).cast("long").alias("region_id"),
            bodies[line].alias("text"),
            *[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), box)],
        )
        for frame, line, *box in CARD_LINES
    ]
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_name"))
    return customers.select(
        key.cast("long").alias("session_id"), F.inline(F.array(*lines)), F.lit(0.91).alias("confidence")
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Captured frames of 50 sessions in time order."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = events.withColumn("session_id", (F.col("user_id") % 50).cast("long"))
    seq = ordered(base, ["session_id"], ["ts", "event_id"], time_chunk(events, "ts"), number="seq")
    return observed(seq, "seq")


def observed(events: DataFrame, *extra: str) -> DataFrame:
    size = F.floor(F.abs("value")).cast("long")
    reason = pick(
        F.col("event_type"), {"click": "navigate", "view": "idle", "purchase": "agent", "signup": "open"}, "error"
    )
    out = events.select(
        (F.col("user_id") % 50).cast("long").alias("session_id"),
        *extra,
        "event_id",
        "ts",
        "event_type",
        reason.alias("reason"),
        F.when(F.col("event_type") == "error", "error").otherwise("ready").alias("status"),
        F.concat("event_type", F.lit("-"), text(size % 3)).alias("raw_key"),
        (3000000 * (1 + size % 3) + 1000 * F.length("event_type")).cast("long").alias("n_bytes"),
        F.floor(F.abs("value") * 100).cast("long").alias("latency_ms"),
    )
    return out.withColumn("frame_hash", F.sha2("raw_key", 256))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One audited request per conversation turn, with known faults."""
    return requests_of(spread(table(spark, sf, "conversations")))


def requests_of(conversations: DataFrame) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    mixed = conv + turn
    ids = lambda prefix, step: F.concat(F.lit(prefix), text(conv), F.lit("-"), text(step))
    failed, prepared = mixed % 13 == 12, mixed % 11 == 10
    half = lambda t: F.floor(t / 2.0).cast("long")
    shot = lambda t: F.sha2(F.concat(text(conv), F.lit("/"), text(half(t))), 256)
    return conversations.select(
        conv.alias("run_id"),
        turn.alias("step"),
        ids("req-", F.when((mixed % 29 == 28) & (turn > 0), turn - 1).otherwise(turn)).alias("request_id"),
        F.when(failed, "failed").when(prepared, "prepared").otherwise("responded").alias("status"),
        F.when(failed, 401).when(prepared, None).otherwise(200).alias("http_status"),
        ids("resp-", turn).alias("response_id"),
        F.when(turn == 0, None)
        .when((conv * 31 + turn) % 17 == 0, "resp-unknown")
        .otherwise(ids("resp-", turn - 1))
        .alias("previous_response_id"),
        F.when(mixed % 19 == 18, None).otherwise(F.length("text").cast("long")).alias("input_tokens"),
        (F.length("text") % 97).cast("long").alias("output_tokens"),
        shot(turn).alias("frame_hash"),
        shot(F.when(mixed % 23 == 22, turn + 2).otherwise(turn)).alias("payload_hash"),
        ids("call-", turn).alias("call_id"),
        F.when(turn == 0, None)
        .when(mixed % 31 == 30, "call-wrong")
        .otherwise(ids("call-", turn - 1))
        .alias("result_call_id"),
        F.when(turn % 3 == 0, "function_call").otherwise("computer_call").alias("call_type"),
        F.when(mixed % 37 == 36, F.concat(F.lit("Enter c"), text(conv), F.lit("@example.net")))
        .otherwise("Enter [EMAIL_1]")
        .alias("payload_text"),
    )


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of the form field a token would be typed into, one per page."""
    k = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id",
        "url",
        pick(k % 11, {1: "search", 2: "password", 3: "text", 4: "tel"}, "email").alias("type"),
        pick(k % 11, {3: "section-a name", 4: "tel", 5: "tel", 6: ""}, "email").alias("autocomplete"),
        F.when(k % 11 == 7, "q").otherwise("contact").alias("name"),
        (k % 13 != 12).alias("focused"),
        (k % 17 != 16).alias("visible"),
        (k % 19 != 18).alias("editable"),
        (k % 11 == 8).alias("search"),
        F.when(k % 11 == 9, "get").otherwise("post").alias("form_method"),
        F.when(k % 11 == 10, "https://other.example").when(k % 11 != 9, "").alias("form_origin"),
        (k % 5 != 4).alias("origin_authorized"),
        pick(k % 3, {0: "[EMAIL_1]", 1: "[NAME_2]"}, "[SECRET_1]").alias("token"),
        ((k * 7) % 1400).cast("double").__sub__(100.0).alias("x"),
        ((k * 13) % 1000).cast("double").__sub__(50.0).alias("y"),
        ((20 + k % 300).cast("double") + 0.25).alias("width"),
        (k % 40).cast("double").alias("height"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """40x40 frames, one per part: empty, entered and protected colour of every pixel."""
    k = F.col("frame_id")
    grid = (
        spread(table(spark, sf, "part").select(F.col("p_partkey").alias("frame_id")))
        .withColumn("right_edge", F.when(k % 60 == 0, 22).otherwise(23))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39))))
    )
    x, y = F.col("x"), F.col("y")
    hit = x.between(4, 23) & y.between(4, 23) & ((x * 7 + y * 11 + k) % 5 == 0)
    covered = x.between(4, F.col("right_edge")) & y.between(4, 23) & ~((k % 100 == 0) & (x == 4))
    return grid.select(
        "frame_id",
        "x",
        "y",
        F.lit(16777215).alias("empty_rgb"),
        F.when(hit, 0).otherwise(16777215).alias("entered_rgb"),
        F.when(covered, 1582133).when(hit, 0).otherwise(16777215).alias("protected_rgb"),
        F.lit(4).alias("mask_x"),
        F.lit(4).alias("mask_y"),
        (F.col("right_edge") - 3).alias("mask_width"),
        F.lit(20).alias("mask_height"),
        F.lit("EMAIL").alias("mask_kind"),
    )


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel rows with a second empty capture (``stable_rgb``); some empty fields flicker, some protected pixels are missing."""
    k, x, y = F.col("frame_id"), F.col("x"), F.col("y")
    rows = pixels(spark, sf).select("frame_id", "x", "y", "empty_rgb", "entered_rgb", "protected_rgb")
    rows = rows.withColumn("stable_rgb", F.when((k % 13 == 5) & (x == 4) & (y == 4), 1).otherwise(F.col("empty_rgb")))
    return rows.withColumn("protected_rgb", F.when((k % 50 == 9) & (x == 5), None).otherwise(F.col("protected_rgb")))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """Several masks a frame: overlapping ones, other kinds, one far beyond the frame, one of unknown width; some frames have none."""
    k = F.col("frame_id")
    width = F.when(k % 60 == 0, 19).otherwise(20)
    mask = lambda kind, x, y, w, h, there: F.when(there, F.struct(
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.lit(x).alias("x"), F.lit(y).alias("y"),
        (F.lit(w) if isinstance(w, int) else w).alias("width"), F.lit(h).alias("height"),
    ))
    rows = F.array(
        mask("EMAIL", 4, 4, width, 12, F.lit(True)),
        mask(F.when(k % 21 == 5, "PHONE").otherwise("EMAIL"), 4, 12, F.when(k % 33 != 8, width), 12, F.lit(True)),
        mask("NAME", 0, 0, 40, 40, k % 4 == 1),
        mask("EMAIL", 10, -5, 4, 1_000_000, k % 6 == 2),
    )
    frames = table(spark, sf, "part").select(F.col("p_partkey").alias("frame_id")).filter(k % 15 != 7)
    return frames.select("frame_id", F.explode(F.array_compact(rows)).alias("m")).select("frame_id", "m.*")


def entered_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The entered field of every frame; some have a second one, of another kind, over the whole frame."""
    field = lambda n, kind, a, b: F.struct(F.lit(n).alias("field_id"), F.lit(kind).alias("kind"), *(F.lit(v).alias(s) for s, v in (("left", a), ("top", a), ("right", b), ("bottom", b))))
    k = F.col("frame_id")
    rows = F.array_compact(F.array(field(0, "EMAIL", 4, 24), F.when(k % 10 == 3, field(1, "NAME", 0, 40))))
    frames = table(spark, sf, "part").select(F.col("p_partkey").alias("frame_id"))
    return frames.select("frame_id", F.explode(rows).alias("f")).select("frame_id", "f.*")


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Private values as they are seen, four per customer; session = nation."""
    return sightings_of(spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))


def sightings_of(customers: DataFrame) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    kinds = F.array(
        *[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("kind")) for o, n in enumerate(("NAME", "EMAIL", "NAME", "SECRET"))]
    )
    rows = customers.select("*", F.inline(kinds))
    value = pick(
        F.col("ord"),
        {
            0: name,
            1: F.concat(F.lit("c"), text(key % 40), F.lit("@example.net")),
            2: F.col("c_mktsegment"),
        },
        F.when(key % 7 == 0, name).otherwise(F.concat(F.lit("pw-"), text(key % 25))),
    )
    return rows.select(
        F.col("c_nationkey").alias("session_id"), (key * 4 + F.col("ord")).cast("long").alias("seq"), "kind", value.alias("value")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Free text that quotes values of the same session, plus redactable ones."""
    key = F.col("c_custkey")
    body = F.concat(
        F.lit("Write to "), F.col("c_name"), F.lit(" at c"), text(key % 40), F.lit("@example.net about "),
        F.col("c_mktsegment"), F.lit(" with pw-"), text(key % 25), F.lit(" or pw-"), text(key % 250),
        F.lit(".\nEmail: other"), text(key), F.lit("@example.org\nAddress: "), text(key % 900), F.lit(" Cedar Lane\nMeet at "),
        text(1 + key % 900), F.lit(" Old Mill Road today"),
    )
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).select(
        F.col("c_nationkey").alias("session_id"), key.alias("text_id"), body.alias("text")
    )


def bundle_events(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded timeline events; recording = user."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    eid = F.col("event_id")
    rows = ordered(
        events,
        ["user_id"],
        ["ts", "event_id"],
        time_chunk(events, "ts"),
        number="sequence",
        lag={"prev_event_id": eid},
        lead={"next_event_id": eid},
    )
    kind = pick(
        F.col("event_type"), {"view": "observation", "click": "action", "purchase": "action", "signup": "check"}, "correction"
    )
    status = pick(
        F.col("event_type"),
        {"signup": F.when(eid % 7 == 0, "failed").otherwise("passed"), "purchase": "blocked", "click": "executed"},
        F.lit(None),
    )
    role = F.concat(F.lit("role_"), text(eid % 10))
    return rows.select(
        F.col("user_id").alias("recording_id"),
        "sequence",
        "event_id",
        kind.alias("type"),
        status.alias("status"),
        F.when(eid % 41 == 40, eid + 100000000).otherwise(F.col("prev_event_id")).alias("before_event_id"),
        F.col("next_event_id").alias("after_event_id"),
        F.concat(F.lit("frame-"), text(eid % 200)).alias("frame_id"),
        F.concat(F.lit("ADDRESS_"), text(eid % 10)).alias("token"),
        F.when((eid % 10 == 3) & (eid % 20 >= 10), "billing_address").otherwise(role).alias("role_hint"),
    )


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Dark blobs near a password label, one frame per supplier."""
    k, n = F.col("s_suppkey"), F.col("component_id")
    dots = (
        table(spark, sf, "supplier")
        .select("s_suppkey")
        .filter(k % 12 > 0)
        .withColumn("component_id", F.explode(F.sequence(F.lit(0), (k % 12 - 1).cast("int"))))
    )
    return dots.select(
        k.alias("frame_id"),
        n,
        (30 + 5 * n + F.when(k % 5 == 0, (n % 2) * 4).otherwise(0)).cast("int").alias("x"),
        F.lit(75).alias("y"),
        F.lit(4).alias("w"),
        F.lit(4).alias("h"),
        F.lit(12).alias("area"),
        F.lit(1.0).alias("fill_center"),
        F.lit(25).alias("label_x"),
        F.lit(20).alias("label_y"),
        F.lit(100).alias("label_width"),
        F.lit(25).alias("label_height"),
        (k % 7 == 0).alias("prose_over"),
    )
