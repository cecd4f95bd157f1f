"""Hard negatives of anchors, mined by a secondary sort.

Scores are packed into keys (anchor, score from the highest, positive before negative, id) that sort as bytes. After one
shuffle that sorts within partitions, an anchor's rows pass by in order: a positive opens a window of scores, negatives are
given out to the open windows, and a window closes when it is full or its lower end is passed. No anchor's rows are held.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.topk import pack, product, quantised
from trackloom.session import materialised

#: Rows of a stripe and anchors of a group at most: the two sides of one task's score matrix; and anchors scored at once.
STRIPE, GROUP, SLICE = 32768, 8192, 64
#: Anchor id, its row, score, positive (0) or negative (1), id: unsigned and big-endian, so bytes order as the numbers do.
KEY = ">QQQBQ"
ANCHOR = 16
BIAS = 1 << 63


def key(anchor: int, row: int, score: int, negative: int, id: int) -> bytes:
    return struct.pack(KEY, anchor + BIAS, row, BIAS - 1 - score, negative, id + BIAS)


def mined(keys: Iterable[tuple[bytes, None]], positives: int, negatives: int, low: tuple[int, int]) -> Iterator[tuple[int, ...]]:
    """anchor id, positive id, rank, negative id, positive score, negative score from sorted keys.

    Of each anchor only the open windows are held: positive id, its score, and how many negatives it has so far.
    """
    now, opened, windows = b"", 0, []
    for raw, _ in keys:
        if raw[:ANCHOR] != now:
            now, opened, windows = raw[:ANCHOR], 0, []
        anchor, _, less, negative, id = struct.unpack(KEY, raw)
        score, id = BIAS - 1 - less, id - BIAS
        if not negative:
            if opened < positives:
                windows.append([id, score, 0])
                opened += 1
            continue
        windows = [w for w in windows if w[2] < negatives and low[1] * score >= low[0] * w[1]]
        for w in windows:
            w[2] += 1
            yield anchor - BIAS, w[0], w[2], id, w[1], score


def highest(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores where ``among``, ties to the smaller id."""
    at = np.flatnonzero(among)
    if len(at) > n:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5),
                   scale: float = 256.0, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    An anchor's positives are its ``positives`` best other rows of the same label by the integer inner product of
    floor(scale * x), ties to the smaller id; for each of them the ``negatives`` best rows of another label count whose score
    is at most the positive's and at least ``low`` (a fraction) of it, so a positive below zero has none.

    Rows with a null id, label or vector, and vectors that are empty or hold null or non-finite components, take no part;
    a vector shorter than others is zero beyond its end. Rows with the anchor's own id are no other rows; repeated rows count
    each, as anchors, positives and negatives. Without anchors or rows the result is empty. Sums of products that might
    exceed 64 bits are an error, never a wrong score.

    Anchors, a stated query set, meet all rows in blocks: groups of anchors and stripes of rows, each pair of blocks a task's
    work, whatever the sizes of labels. A block gives its best positives of each anchor; of these the anchor's windows follow,
    and in a second pass a block gives the best negatives of each window. So the sorted shuffle gets a bounded number of keys
    from each block and anchor and not all pairs, and still loses nothing: what is not among a block's best is not among
    the best of all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))

    def terms(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, t = quantised(b.column("v"), scale)
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in ("uid", "vec_id", "label", "asks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([pack(x) for x in t], pa.binary()), pa.array([t.shape[1]] * len(at), pa.int32())],
                                             names=["uid", "vec_id", "label", "asks", "terms", "dims"])

    rows = rows.where("vec_id is not null and label is not null and v is not null")
    rows = materialised(rows.mapInArrow(terms, "uid long, vec_id long, label string, asks boolean, terms binary, dims int"), "terms")
    total, asked, dims = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("dims"), F.lit(1))).first()
    groups = max(1, -(-asked // GROUP))
    stripes = max(1, -(-total // STRIPE), min(-(-total // 1024), spark.sparkContext.defaultParallelism))
    part = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    others = rows.select("uid", "vec_id", "label", "terms", part(stripes).alias("stripe"), every(groups).alias("group"))
    anchors = rows.where("asks").select(*[F.col(c).alias(f"of_{c}") for c in ("uid", "vec_id", "label", "terms")], part(groups).alias("of_group"))

    def met(asking: DataFrame, choose) -> DataFrame:
        """The best rows of each pair of blocks: what ``choose(anchor, scores, ids, same label)`` says for each anchor."""
        def of_block(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[list[int]] = [[], [], [], []]
            if a.num_rows and b.num_rows:
                x, y = (np.frombuffer(b"".join([r.ljust(8 * dims, b"\0") for r in t.column(c).to_pylist()]), "<i8").reshape(-1, dims)
                        for t, c in ((a, "of_terms"), (b, "terms")))
                asked_by, ids = a.drop_columns(["of_terms"]).to_pylist(), b.column("vec_id").to_numpy()
                coded = b.column("label").combine_chunks().dictionary_encode()
                code = {name: k for k, name in enumerate(coded.dictionary.to_pylist())}
                for k in range(0, len(x), SLICE):
                    for one, scores in zip(asked_by[k : k + SLICE], product(x[k : k + SLICE], y)):
                        same = coded.indices.to_numpy() == code.get(one["of_label"], -1)
                        at = choose(one, scores, ids, same)
                        for column, more in zip(out, ([one["of_uid"]] * len(at), [one["of_vec_id"]] * len(at), scores[at].tolist(), ids[at].tolist())):
                            column += more
            return pa.table([pa.array(c, pa.int64()) for c in out], names=["uid", "anchor_id", "score", "vec_id"])

        spread = asking.withColumn("of_stripe", every(stripes))
        return spread.groupBy("of_group", "of_stripe").cogroup(others.groupBy("group", "stripe")).applyInArrow(
            of_block, "uid long, anchor_id long, score long, vec_id long")

    def best_positives(one: dict, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> np.ndarray:
        return highest(scores, ids, same & (ids != one["of_vec_id"]), positives)

    def best_negatives(one: dict, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> np.ndarray:
        inside = [~same & (scores <= top) & (scores >= -(-low[0] * top // low[1])) for top in one["tops"]]
        return np.unique(np.concatenate([highest(scores, ids, w, negatives) for w in inside]))

    found = met(anchors, best_positives)
    place = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    best = materialised(found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives).drop("place"), "positives")
    windows = best.groupBy(F.col("uid").alias("of_uid")).agg(F.collect_set("score").alias("tops"))
    wanted = met(anchors.join(windows, "of_uid"), best_negatives)
    both = best.withColumn("negative", F.lit(0)).unionByName(wanted.withColumn("negative", F.lit(1)))
    packed = both.select("anchor_id", "uid", "score", "negative", "vec_id").rdd.map(lambda r: (key(*r), None))
    ordered = packed.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda k: zlib.crc32(k[:ANCHOR]))
    given = ordered.mapPartitions(lambda keys: mined(keys, positives, negatives, low))
    return spark.createDataFrame(given, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
