"""Mixing sources to target weights with hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE, packed
from trackloom.session import lookup, materialised

#: Places of a document in the order of its source: 36 bits, read as three levels of 4,096 buckets.
LEVEL, LEVELS = 12, 3


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def place(id: Column, text: Column) -> Column:
    """36 hash bits of a document. They depend on nothing but its id and text, so that reruns agree."""
    whole = F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``, ``copies`` (whole passes) and ``left`` (tokens of the last pass).

    Sources in code point order, null last, take the weights in turn. Together they get ``total`` times all tokens, by
    weight; no target exceeds ``most`` times its source, and the excess goes to the others by weight. That is one level of
    tokens per weight for all sources below their limit: filled in order of limit per weight, the level that the sources
    not yet full would share grows until the first that stays below its limit, and falls after it. Its maximum is the level.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    own = sizes.select("source", "source_size", w.alias("w")).withColumn("limit", most * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    share = (total * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    level = own.withColumn("share", share).withColumn("level", F.max("share").over(every))
    target = F.round(F.least("limit", F.col("w") * F.col("level")), 6)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (level.withColumn("target", target).withColumn("copies", copies.cast("long"))
            .select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("left")))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0, id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Which documents to take how often: ``row`` (the document), ``doc_id``, ``size``, ``source_size``, ``target``, ``times``.

    A source's documents have their places in its order by a hash. It is passed through ``copies`` times; of a last, partial
    pass it gets the documents below a threshold, so that a smaller budget's documents are among a larger one's. Tokens are
    summed by source and bucket of the hash; the bucket that holds the budget's end is cut into finer ones, twice. Nothing is
    sorted; the finest bucket (a 2^-36 share of the source) goes where it leaves the smaller error.

    Null source is a source of its own. Documents without words have size 0 and go with their place. Repeated rows share
    their place, so all or none of them are taken. An empty table gives an empty result.
    """
    rows = packed(docs, doc_id=F.col(f"`{id}`"), source=F.col(f"`{source}`").cast("string"), size=words(F.col(f"`{text}`").cast("string")),
                  place=place(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")))
    return chosen(rows, weights, total, most)


def chosen(rows: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    light = materialised(rows.select("source", "size", "place"), "sizes")  # texts are read again at the end, not written
    plan = lookup(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most), "targets")
    # done: the place below which all is taken so far; left: tokens still to take within the boundary bucket
    edge = plan.select("source", "left", F.lit(0).cast("long").alias("done"))
    for level in range(LEVELS):
        shift = LEVEL * (LEVELS - 1 - level)
        inside = light.join(edge.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        if level:
            inside = inside.where(F.shiftright("place", shift + LEVEL) == F.shiftright("done", shift + LEVEL))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket"), "left").agg(F.sum("size").alias("tokens"))
        end = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        cut = sums.withColumn("start", end - F.col("tokens")).where((F.col("start") < F.col("left")) & (F.col("start") + F.col("tokens") >= F.col("left")))
        edge = lookup(cut.select("source", (F.col("left") - F.col("start")).alias("left"), "tokens",
                                 F.shiftleft("bucket", shift).alias("done")), "boundary")
    below = edge.select("source", (F.col("done") + (2 * F.col("left") >= F.col("tokens")).cast("long")).alias("below"))
    final = lookup(plan.join(below.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
                   .select(F.col("source").alias("of"), "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below")), "thresholds")
    return (rows.join(final, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("times", F.col("copies") + (F.col("place") < F.col("below")).cast("long"))
            .drop("of", "copies", "below", "place", "source"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns only."""
    taken = mix(docs, **settings).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass")).select("row.*")
