"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.components import text_hash
from hushlake.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 42
BITS = 48  # of the seeded number that orders a source's documents
LEVELS = (36, 24, 0)  # bits that are left out at each step of the search for a source's last document


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded number of a document, 0 to 2^48 - 1; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``nth`` (from 0) along ``order``, numbered in ranges: no task sees more than one range."""
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order)
    return ranged.join(first, "part").withColumn("nth", F.col("first") + F.row_number().over(inside) - 1).drop("part", "first")


def water_filled(sources: DataFrame, most: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """``sources`` (``source_size`` and ``weight`` long) with ``target`` in words.

    ``share`` of all sizes is given out by weight. What a source would get above ``most`` times its size is clamped, and
    the rest goes to the others by weight, until nobody is above. A round is one aggregate that brings two sums to the driver; the
    level only rises, so each round clamps at least one source more, mostly many.
    """
    cap = (F.col("source_size") * most).cast("decimal(38,0)")
    size, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = int((size or 0) * share)
    left, open_weight = total, int(weight or 0)
    while True:
        # cap < left / open_weight * weight, in whole numbers
        clamped = cap * F.lit(open_weight).cast("decimal(18,0)") < F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
        given, rest = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        state = (total - int(given or 0), int(rest or 0))
        if state == (left, open_weight):
            break
        left, open_weight = state
    even = F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(even))


def _last_documents(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """``nth, edge, inside, peers``: where along ``u`` the fractional repetition of a source ends.

    Documents with ``u < edge`` lie in it whole; those at the edge (one, or rows that share an id) have ``inside`` of
    their ``peers`` words in it. Found by descending through ranges of ``u``: a source has at most 4,096 sums a step,
    and about a 16-millionth of its documents is left for the last.
    """
    at, above = planned.select("nth", "left"), None
    for shift in LEVELS:
        rows = sized
        if above is not None:
            found = at.select(F.col("nth").alias("of"), F.col("range").alias("at"))
            rows = rows.join(found, (F.col("nth") == F.col("of")) & (F.shiftright("u", above) == F.col("at"))).drop("of", "at")
        sums = rows.groupBy("nth", F.shiftright("u", shift).alias("range")).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("nth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        hit = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))
        at = sums.join(at.select("nth", "left"), "nth").filter(hit)
        at = materialize(at.select("nth", "range", (F.col("left") - F.col("before")).alias("left"), "words"), "edges")
        above = shift
    return at.select("nth", F.col("range").alias("edge"), F.col("left").alias("inside"), F.col("words").alias("peers"))


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, copies, part, taken`` for every row of ``docs``.

    ``size``: words of the text (null: 0). Sources, by code point and null last, have the ``weights`` in turn and share
    ``share`` of all words; targets are water-filled under ``most`` times a source's size. A source's words are its
    target rounded: every document comes whole as often as the source fits in, and the fractional rest takes documents
    whole along a seeded order (``copies`` counts these), the last one in part (``part`` words). So the taken words
    of a source miss its target by a word, and no document exceeds ``most`` times its size.

    Rows of one id stand at one place of the order; those at its end share what is left in proportion to their sizes,
    rounded down. Null is a source of its own, a null id an id, repeated rows count each. Texts are read once; only
    sizes are moved, and no group of a hot source comes together.
    """
    words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(
        docs.select("doc_id", "source", text_hash(docs["text"]).alias("text_hash"), words.alias("size"), draw(docs["doc_id"], seed).alias("u")),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", turn.cast("long")), "sources")
    size = F.col("source_size")
    planned = water_filled(sources, most, share)
    planned = planned.withColumn("words", F.least(size * most, F.floor(F.col("target") + 0.5).cast("long")))
    planned = planned.withColumn("whole", F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    planned = planned.withColumn("left", F.col("words") - F.col("whole") * size)
    planned = materialize(planned.select(F.col("source").alias("named"), "nth", "source_size", "target", "whole", "left"), "plan")

    rows = sized.join(planned.select("named", "nth"), sized["source"].eqNullSafe(planned["named"])).drop("named")
    rows = materialize(rows, "placed")
    edges = _last_documents(rows.select("nth", "u", "size"), planned)
    rows = rows.join(planned.drop("named", "left").join(edges, "nth", "left"), "nth")
    at_edge = F.expr("size * cast(inside as decimal(20,0)) div peers")
    part = F.when(F.col("u") == F.col("edge"), at_edge).otherwise(F.lit(0).cast("long"))
    copies = F.col("whole") + F.when(F.col("u") < F.col("edge"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies).withColumn("part", part)
    rows = rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", "part", "taken")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``docs`` once for each repetition, with ``mix_copy`` (from 1) and the text of that repetition.

    A repetition in part holds the first words of the text, joined by one space. Documents of no word come as often as
    their source is taken whole. Columns ``mix_copy`` of the input are replaced. A copy is chosen by id, source and text, so rows that
    are equal in these are repeated alike.
    """
    keys = {"doc_id": "mix_id", "source": "mix_source", "text_hash": "mix_hash"}
    plan = mixture(docs, **settings).select(*(F.col(k).alias(v) for k, v in keys.items()), "copies", "part").distinct()
    plan = plan.select(*keys.values(), F.col("copies").alias("mix_whole"), F.col("part").alias("mix_part"))
    times = F.col("mix_whole") + F.when(F.col("mix_part") > 0, 1).otherwise(0)
    plan = plan.filter(times > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    same = docs["doc_id"].eqNullSafe(plan["mix_id"]) & docs["source"].eqNullSafe(plan["mix_source"])
    same = same & (text_hash(docs["text"]) == plan["mix_hash"])
    cut = plan["mix_copy"] > plan["mix_whole"]
    some = F.slice(F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0)), F.lit(1), plan["mix_part"].cast("int"))
    text = F.when(cut, F.array_join(some, " ")).otherwise(docs["text"])
    rest = [docs[c] for c in docs.columns if c not in ("text", "mix_copy")]
    return docs.join(plan, same).select(*rest, text.alias("text"), plan["mix_copy"])
