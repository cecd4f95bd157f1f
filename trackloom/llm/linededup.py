"""Removal of lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE, packed
from trackloom.session import lookup, many_rows, materialised

#: log2 of the registers of a sketch; the standard error is 1.04 / sqrt(2^LG_K), 1.6 %.
LG_K = 12
#: Share of the threshold, either way, within which sites are counted exactly: six standard errors.
NEAR = 0.1


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``line`` (hash), ``site``, ``nil``, ``doc_id``, ``print``, ``at`` -> ``line``, ``first`` of the lines on at least ``min_sites`` sites.

    ``first`` is the place of the occurrence in the smallest document. A line that occurs fewer times than ``min_sites``
    has no sketch made; the others' sketches are merged by aggregation, and only lines whose estimate is near the threshold
    get their distinct sites counted. A null site is none.
    """
    often = lookup(lines.groupBy("line").count().where(F.col("count") >= min_sites).select("line"), "often")
    some = lines.join(often, "line", "left_semi")
    sketched = lookup(some.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")), "sites")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    near = sketched.where(F.col("sites").between(low, high)).select("line")
    exact = some.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    spread = lookup(sketched.where(F.col("sites") > high).select("line").unionByName(exact.select("line")), "spread")
    firsts = some.join(spread, "line", "left_semi").groupBy("line").agg(F.min(F.struct("nil", "doc_id", "print", "at")).alias("first"))
    return lookup(firsts, "spread-lines")


def without_spread_lines(docs: DataFrame, min_sites: int = 8, id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Every document with its text but for repeats of lines found on ``min_sites`` sites or more.

    Gives ``row`` (the document as it was), ``doc_id``, ``text``, ``n_lines``, ``n_removed``. Lines end with a line feed and
    are compared without the spaces around them; lines without a word are neither counted nor removed. The first occurrence
    of a line, in the document with the smallest id (null ids last, then by text hash), stays; so one whole document is left of
    any group of copies. Null text stays null and has no lines; repeated rows have the same result.

    Only line hashes and places are shuffled to find the lines. Then each document that loses some gets their places as one
    array, no longer than its own lines. For that documents are shuffled once, at every size: documents that lose lines are
    a share of all, so their number has no bound and they are not broadcast.
    """
    rows = packed(docs, doc_id=F.col(f"`{id}`").cast("long"), text=F.col(f"`{text}`").cast("string"), site=F.col(f"`{site}`").cast("string"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    all_lines = F.split("text", "\n")
    light = rows.select("doc_id", "print", "site", F.posexplode(all_lines).alias("at", "words")).where(F.col("words").rlike(f"[^{SPACE[1:]}"))
    light = materialised(light.select(F.col("doc_id").isNull().alias("nil"), "doc_id", "print", "site", "at",
                                      F.xxhash64(F.trim("words")).alias("line")), "lines")
    spread = spread_lines(light, min_sites)
    place = F.struct("nil", "doc_id", "print", "at")
    gone = light.join(spread, "line").where(place != F.col("first")).groupBy("doc_id", "print").agg(F.collect_set("at").alias("gone"))
    gone = materialised(gone.select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "gone"), "gone")
    both = rows.join(many_rows(gone), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    # the outer transform names the split text, so that it is split once and not for each line
    left = F.transform(F.array(all_lines), lambda own: F.array_join(F.transform(stay, lambda k: F.get(own, k)), "\n"))[0]
    return both.select("row", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
                       F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"),
                       F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))
