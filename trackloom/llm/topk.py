"""Exact top-k search by inner product, block at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import materialised

#: Vectors of a block, blocks of a shard (the unit that is sent to queries), and queries of a group.
BLOCK, SHARD, GROUP = 512, 16, 1024


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def quantised(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their terms floor(scale * x)."""
    size = np.array([len(v) if v is not None else 0 for v in column.to_pylist()]) if column.null_count else np.diff(column.offsets.to_numpy())
    dims = int(size.max(initial=0))
    values = np.full((len(column), dims), np.nan)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values[np.arange(dims) < size[:, None]] = flat
    values[(np.arange(dims) >= size[:, None]) & (size > 0)[:, None]] = 0.0  # shorter vectors are zero beyond their end
    good = np.isfinite(values).all(axis=1) & (size > 0)
    with np.errstate(over="ignore"):
        terms = np.floor(scale * values[good])
    if np.abs(terms).max(initial=0) >= 2.0**63:
        raise OverflowError("a scaled component needs more than 64 bits")
    return np.flatnonzero(good), terms.astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in doubles where all sums stay below 2^53, in whole numbers below 2^63, else an error."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2.0**63:
        raise OverflowError("a sum of products may need more than 64 bits")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that any vector between ``low`` and ``high`` can score: each query term takes the better end."""
    return product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)


def search(asking: dict[str, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, k: int) -> pa.Table:
    """What can be in the top ``k`` of each asking row (``uid``, ``id``, ``terms``, ``kth``: a k-th score from elsewhere).

    Blocks go in order of their bounds, per query, until these fall below the k-th score so far.
    """
    bound = bounds(asking["terms"], low, high)
    order = np.argsort(-bound, axis=1, kind="stable")
    kth, n = asking["kth"].copy(), len(asking["uid"])
    scores, vectors = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
    alive = np.arange(n)
    for turn in range(order.shape[1]):
        alive = alive[bound[alive, order[alive, turn]] >= kth[alive]]
        for b in np.unique(order[alive, turn]):
            own = alive[order[alive, turn] == b]
            ids, terms = blocks[b]
            for q, s in zip(own.tolist(), product(asking["terms"][own], terms)):
                hit = np.flatnonzero((s >= kth[q]) & (ids != asking["id"][q]))
                if len(hit):
                    s, v = np.concatenate([scores[q], s[hit]]), np.concatenate([vectors[q], ids[hit]])
                    first = np.lexsort((v, -s))[:k]
                    scores[q], vectors[q] = s[first], v[first]
                    if len(first) == k:
                        kth[q] = max(kth[q], int(s[first[-1]]))
    times = [len(x) for x in scores]
    none = [np.zeros(0, np.int64)]
    return pa.table([np.repeat(asking["uid"], times), np.repeat(asking["id"], times), np.concatenate(none + vectors), np.concatenate(none + scores)],
                    names=["uid", "query_id", "vec_id", "score"])


FOUND = "uid long, query_id long, vec_id long, score long"
ASKING = "uids binary, ids binary, terms binary, kth binary, home binary"
NONE = int(np.iinfo(np.int64).min)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best other rows by the integer inner
    product of floor(scale * x), ties to the smaller id; fewer rows give all.

    ``is_query`` marks the query rows (a condition on the columns of ``vectors``). Rows with a null id or vector, and vectors
    that are empty or hold null or non-finite components, take no part; a vector shorter than others is zero beyond its end;
    rows with a query's own id are no candidates of its; repeated rows are each a candidate, and each a query of its own.
    Where a scaled component or a sum of products might exceed 64 bits the search ends with an OverflowError: no score is wrong.

    Vectors are ordered by their two strongest terms, so that those in a block of ``BLOCK`` resemble each other, and blocks
    keep the least and largest value of each term. A query is first searched for in the shard (``SHARD`` blocks) that it is
    part of, which gives a k-th score. Then groups of queries meet the summaries of the other shards, and a shard is only
    searched for the queries that its bound leaves a chance.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").cast("long").alias("vec_id"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def terms(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, t = quantised(b.column("v"), scale)
            strong = np.argsort(-np.abs(t), axis=1, kind="stable")[:, :2]
            key = np.zeros(len(t), np.int64)
            for column in strong.T:
                key = key * 2**30 + 2 * column + (t[np.arange(len(t)), column] < 0)
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in ("uid", "vec_id", "asks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(key), pa.array([pack(x) for x in t], pa.binary()), pa.array([t.shape[1]] * len(at), pa.int32())],
                                             names=["uid", "vec_id", "asks", "key", "terms", "dims"])

    quant = rows.where("vec_id is not null and v is not null").mapInArrow(terms, "uid long, vec_id long, asks boolean, key long, terms binary, dims int")
    quant = materialised(quant, "terms")
    total, asked, dims = quant.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("dims"), F.lit(1))).first()

    def matrix(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([x.ljust(8 * dims, b"\0") for x in raw]), "<i8").reshape(-1, dims)

    def numbers(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), "<i8")

    def index(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        count = 0

        def block(t: pa.Table) -> pa.RecordBatch:
            x, asks = matrix(t.column("terms").to_pylist()), t.column("asks").to_numpy()
            uid, ids = (t.column(c).to_numpy() for c in ("uid", "vec_id"))
            shard = TaskContext.get().partitionId() + (count // SHARD) * 2**20  # a range of equal keys may hold several shards
            own = (ids, x, x.min(axis=0), x.max(axis=0), uid[asks], ids[asks], x[asks])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *[pa.array([pack(c)], pa.binary()) for c in own]],
                                              names=["shard", "vec_ids", "vectors", "low", "high", "uids", "ids", "terms"])

        for b in it:
            rest = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            while rest.num_rows >= BLOCK:
                yield block(rest.slice(0, BLOCK))
                rest = rest.slice(BLOCK)
                count += 1
        if rest is not None and rest.num_rows:
            yield block(rest)

    ordered = quant.repartitionByRange(max(1, -(-total // (BLOCK * SHARD))), "key", "uid").sortWithinPartitions("key", "uid")
    blocks = ordered.mapInArrow(index, "shard long, vec_ids binary, vectors binary, low binary, high binary, uids binary, ids binary, terms binary")
    blocks = materialised(blocks, "blocks")

    def opened(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        own = [(numbers([i]), matrix_of(v)) for i, v in zip(t.column("vec_ids").to_pylist(), t.column("vectors").to_pylist())]
        return own, matrix_of(b"".join(t.column("low").to_pylist())), matrix_of(b"".join(t.column("high").to_pylist()))

    def matrix_of(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<i8").reshape(-1, dims)

    def at_home(t: pa.Table) -> pa.Table:
        uid = numbers(t.column("uids").to_pylist())
        asking = {"uid": uid, "id": numbers(t.column("ids").to_pylist()), "terms": matrix_of(b"".join(t.column("terms").to_pylist())),
                  "kth": np.full(len(uid), NONE)}
        found = search(asking, *opened(t), k)
        return found.append_column("home", pa.array([t.column("shard")[0].as_py()] * found.num_rows, pa.int64()))

    home = materialised(blocks.groupBy("shard").applyInArrow(at_home, FOUND + ", home long"), "home")
    reached = home.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"), F.min("home").alias("home"))
    asking = quant.where("asks").join(reached, "uid", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE))).withColumn(
        "home", F.coalesce("home", F.lit(-1))).withColumn("asker", F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-asked // GROUP)))))

    def grouped(t: pa.Table) -> pa.Table:
        raw = [pack(t.column(c).to_numpy()) for c in ("uid", "vec_id")] + [pack(matrix(t.column("terms").to_pylist()))] + [
            pack(t.column(c).to_numpy()) for c in ("kth", "home")]
        return pa.table([t.column("asker").slice(0, 1), *[pa.array([r], pa.binary()) for r in raw]], names=["asker", "uids", "ids", "terms", "kth", "home"])

    askers = materialised(asking.groupBy("asker").applyInArrow(grouped, f"asker long, {ASKING}"), "askers")

    def summary(t: pa.Table) -> pa.Table:
        _, low, high = opened(t)
        return pa.table([t.column("shard").slice(0, 1), pa.array([pack(low.min(axis=0))], pa.binary()), pa.array([pack(high.max(axis=0))], pa.binary())],
                        names=["shard", "low", "high"])

    summaries = materialised(blocks.groupBy("shard").applyInArrow(summary, "shard long, low binary, high binary"), "summaries")
    every = materialised(summaries.agg(F.collect_list("shard").alias("shards")), "shards")
    meet = askers.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").withColumn("shard", F.explode("shards")).drop("shards", "one")

    def chances(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                t, kth, home_shard = matrix_of(r["terms"]), numbers([r["kth"]]), numbers([r["home"]])
                left = (bounds(t, matrix_of(r["low"]), matrix_of(r["high"]))[:, 0] >= kth) & (home_shard != r["shard"])
                if left.any():
                    raw = [pack(x[left]) for x in (numbers([r["uids"]]), numbers([r["ids"]]), t, kth, home_shard)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["asker"]], pa.int64()), pa.array([r["shard"]], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]],
                                                     names=["asker", "shard", "uids", "ids", "terms", "kth", "home"])

    pairs = meet.join(summaries, "shard").mapInArrow(chances, f"asker long, shard long, {ASKING}")
    pairs = materialised(pairs, "pairs")
    sent = blocks.select("shard", "vec_ids", "vectors", "low", "high").join(pairs.select(F.col("asker").alias("to"), F.col("shard").alias("at")), F.col("shard") == F.col("at"))

    def answers(pair: pa.Table, own: pa.Table) -> pa.Table:
        r = pair.to_pylist()[0]
        return search({"uid": numbers([r["uids"]]), "id": numbers([r["ids"]]), "terms": matrix_of(r["terms"]), "kth": numbers([r["kth"]])}, *opened(own), k)

    others = pairs.groupBy("asker", "shard").cogroup(sent.groupBy("to", "at")).applyInArrow(answers, FOUND)
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    both = home.drop("home").unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
