"""Joins do not gather rows whose number Spark underestimates (``explode``, ``inline``) in the driver."""

import re

from pyspark.sql import functions as F

from hushlake.operators import findings as D
from hushlake.operators import pairing as G
from hushlake.operators import policy as O
from hushlake.operators import vault as V
from hushlake.sources.sinks import protect_frames

SECRETS = [(1, "NAME", "Ines Okafor", False), (1, "EMAIL", "ines@example.net", False)]


def regions(spark, n=20):
    """``n`` sessions with a label and its value, made by ``inline``: Spark sizes them as their source."""
    line = lambda k, text: F.struct(F.lit(0).cast("long").alias("frame_id"), F.lit(k).cast("long").alias("region_id"), F.lit(text).alias("text"), F.lit(17).alias("x"), F.lit(10 + 25 * k).alias("y"), F.lit(170).alias("width"), F.lit(18).alias("height"))
    lines = F.inline(F.array(line(0, "Name"), line(1, "Ines Okafor"), line(2, "Shipping address"), line(3, "47 Harbor Lane"), line(4, "Dover, DE 19901")))
    return spark.range(n).select(F.col("id").alias("session_id"), lines, F.lit(0.91).alias("confidence"))


def broadcasts(df):
    """Broadcast joins of the plan but those with the bucket set of ``contains``, whose size is fixed."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Broadcast(?:Hash|NestedLoop)Join[^\n]*", plan) if "_bucket" not in x]


def test_pairing_and_classifier(spark):
    rows = regions(spark)
    for out in (G.pair_labels(G.clean(rows)), G.label_blocks(G.clean(rows)), D.classify_frames(rows), D.detect_sessions(rows)):
        assert not broadcasts(out)
    assert D.classify_frames(rows).filter("kind = 'NAME'").count() == 20


def test_vault(spark):
    rows = regions(spark).withColumn("text_id", F.col("region_id"))
    known = spark.createDataFrame(SECRETS, "session_id long, kind string, value string, explicit_secret boolean")
    vault = V.vault_build(known.withColumn("seq", F.monotonically_increasing_id()))
    again = V.vault_rematch(rows, known)
    scrubbed = V.vault_scrub(rows.select("session_id", "text_id", "text"), vault)
    denied = O.private_url_block(rows.select("session_id", F.col("region_id").alias("url_id"), F.col("text").alias("url")), vault)
    for out in (again, scrubbed, denied):
        names = broadcasts(out)
        assert not [x for x in names if "_part" not in x], names  # _part: the chunks of an ordered table
    assert [r.value for r in again.collect()] == ["Ines Okafor"]
    assert scrubbed.filter("hits = 1").count() == 1


def test_protected_frames(spark):
    rows = regions(spark)
    out = protect_frames(D.classify_frames(rows), rows.select("session_id", "frame_id"), 1200, 900)
    assert not [x for x in broadcasts(out) if "_part" not in x]
    assert out.filter("count = 0").count() == 0
