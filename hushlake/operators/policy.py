"""Gates that need other tables: authorized origins and the vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions import gates as G
from hushlake.functions import patterns as P
from hushlake.operators.contains import present_values
from hushlake.operators.joins import dealt


def destination_gate(fields: DataFrame, authorized: DataFrame) -> DataFrame:
    """Decide per field whether its tokens may be typed there.

    ``fields`` has the metadata columns, ``origin`` and ``tokens``; ``authorized(origin)``
    is whatever size it is: the join strategy is left to the optimizer, and a hot
    origin is split by adaptive execution because the authorized side is unique.
    """
    allowed = authorized.select("origin").distinct().withColumn("_allowed", F.lit(True))
    names = ("origin", "visible", "focused", "editable", "type", "autocomplete", "name", "search", "form_origin", "form_method")
    field = {n: F.col(n) for n in names}
    field |= {n: F.col(n) if n in fields.columns else F.lit("") for n in ("id", "role", "label")}
    joined = fields.join(allowed, "origin", "left")
    return joined.withColumn("reason", G.destination_reason(field, F.col("tokens"), F.col("_allowed"))).drop("_allowed")


def private_url_block(urls: DataFrame, vault: DataFrame) -> DataFrame:
    """URLs that carry a token, a known value or redactable text are denied.

    ``urls(session_id, url_id, url)``; adds ``reason``.
    """
    known = present_values(urls, vault.select("session_id", "value").distinct(), ["session_id"], ["url_id"], text="url")
    hit = known.select("session_id", "url_id").distinct().withColumn("_known", F.lit(True))
    url = F.col("url")
    reason = (
        F.when(url.rlike(P.TOKEN), "token")
        .when(F.col("_known").isNotNull(), "known_value")
        .when(P.pattern_scrub(url) != url, "pattern")
        .otherwise("ok")
    )
    return urls.join(dealt(hit), ["session_id", "url_id"], "left").withColumn("reason", reason).drop("_known")
