"""Grouping poses and describing the groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trackloom.operators.ordered import percentiles
from trackloom.operators.select import first_n, hash_order, quotas
from trackloom.operators.tracks import zscore
from trackloom.schema import cols
from trackloom.session import lookup, materialised


def melt(df: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, feature, value"""
    rows = F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.feature", "_r.value")


# Describing clusters.

def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows and share (%) per cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def cluster_centroids(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])


def cluster_profiles(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """cluster, feature, mean, std (population) of the z-scored features, and n."""
    long = melt(zscore(df, features), features, [cluster])
    return long.groupBy(cluster, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                                F.count(F.lit(1)).alias("n"))


def robust_deviations(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """cluster, feature, deviation: (cluster median - overall median) / overall interquartile range.

    A range of zero counts as 1e-6.
    """
    long = melt(df, features, [cluster])
    whole = percentiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    own = percentiles(long, [cluster, "feature"], "value", {"median": 0.5}).drop("n")
    width = F.col("q75") - F.col("q25")
    width = F.when(width == 0, F.lit(1e-6)).otherwise(width)
    return own.join(whole, "feature").select(cluster, "feature", ((F.col("median") - F.col("q50")) / width).alias("deviation"))


def name_clusters(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """cluster, name: readable names from the robust deviations of the paw features."""
    dev = F.round("deviation", 9)

    def largest(parts: Sequence[str]) -> Column:
        named = [f for f in features if any(p in f for p in parts)]
        return F.max(F.when(F.col("feature").isin(*named), dev))

    def mean(part: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("feature").isin(*[f for f in features if part in f]), dev)), F.lit(0.0))

    def one(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("feature") == name, dev)), F.lit(0.0))

    d = robust_deviations(df, features, cluster).groupBy(cluster).agg(
        largest(("speed", "acc")).alias("moving"), largest(("acc",)).alias("acc"), F.round(mean("vy"), 9).alias("vy"),
        F.round(mean("vz"), 9).alias("vz"), one("pawL_speed").alias("left"), one("pawR_speed").alias("right"))
    vertical = (F.col("vz") > 2) & (F.col("vz") > F.col("vy"))
    running = ~vertical & (F.col("vy") > 2)
    left = F.col("left") > F.col("right") + 1.5
    right = F.col("right") > F.col("left") + 1.5
    both = (F.col("left") > 1.5) & (F.col("right") > 1.5) & ~running & ~vertical
    traits = F.concat_ws("+", F.when(F.col("acc") > 3, "High_Acceleration"),
                         F.when(vertical, "Vertical_Movement").when(running, "Running"),
                         F.when(left, "Left_Paw_Dominant").when(right, "Right_Paw_Dominant").when(both, "Bilateral_Active"))
    name = F.when(F.col("moving") < 1, "Stationary").when(traits != "", traits).otherwise("Unclassified_Active")
    return d.select(cluster, F.concat(F.lit("C"), F.col(cluster).cast("string"), F.lit("_"), name).alias("name"))


def paw_moving_clusters(df: DataFrame, share: float = 0.75, cluster: str = "cluster") -> DataFrame:
    """Clusters whose mean left or right paw speed is above that percentile of all rows."""
    cut = percentiles(melt(df, ["pawL_speed", "pawR_speed"], []), ["feature"], "value", {"cut": share})
    cuts = {p: cut.where(F.col("feature") == f"paw{p}_speed").select("cut").scalar() for p in "LR"}
    means = df.groupBy(cluster).agg(F.avg("pawL_speed").alias("left"), F.avg("pawR_speed").alias("right"))
    fast = (F.round(F.col("left") - cuts["L"], 9) > 0) | (F.round(F.col("right") - cuts["R"], 9) > 0)
    return means.where(fast).select(cluster)


# Finding clusters.

def nearest_to_center(df: DataFrame, centers: DataFrame, keys: Sequence[str], by: Sequence[str] = ("cluster",),
                      vector: str = "v") -> DataFrame:
    """Per cluster the member nearest to its centre (ties by key), its distance and the size of the cluster.

    ``centers`` holds ``by`` and an array ``center``. One hash aggregate; members are not sorted.
    """
    both = df.join(centers.select(*by, "center"), list(by))
    square = F.aggregate(F.zip_with(vector, "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    both = both.withColumn("_d", F.sqrt(square))
    best = F.min_by(F.struct(*cols(keys), "_d"), F.struct(F.round("_d", 9), *cols(keys)))
    out = both.groupBy(*by).agg(best.alias("_b"), F.count(F.lit(1)).alias("cluster_size"))
    return out.select(*by, *[F.col(f"_b.{k}").alias(k) for k in keys], F.col("_b._d").alias("distance"), "cluster_size")


def center_rows(df: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """The centres of a fitted model (k x D numbers) as rows (cluster, center)."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return df.sparkSession.createDataFrame(rows, "cluster int, center array<double>")


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    whole = ~F.exists(vector, lambda x: x.isNull())
    return df.where(F.col(vector).isNotNull() & whole).withColumn("_vec", array_to_vector(F.col(vector)))


def closest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For rows ``v`` (n x D) and centres (... x k x D): the nearest centre of each row, (... x n), by one matrix product.

    Rows are taken relative to the middle of the centres, which keeps the digits of small distances.
    """
    flat = centers.reshape(-1, centers.shape[-1])
    middle = flat.mean(axis=0)
    flat = flat - middle
    far = (flat * flat).sum(axis=1) - 2 * (v - middle) @ flat.T
    return np.moveaxis(far.reshape(len(v), *centers.shape[:-1]).argmin(axis=-1), 0, -1)


def drawn_starts(sample: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    """starts x k x D: centres picked from the sample, each with a chance in proportion to its squared distance to those before."""
    out = []
    for n in range(starts):
        draw = np.random.default_rng([seed, n])
        picked = [int(draw.integers(len(sample)))]
        far = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < min(k, len(sample)):
            picked.append(int(draw.choice(len(sample), p=far / far.sum())))
            far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
        out.append(sample[picked])
    return np.array(out)


def kmeans(df: DataFrame, k: int, seed: int, vector: str = "v", iterations: int = 300, starts: int = 10, moved: float = 1e-9,
           oversampling: int = 10) -> tuple[DataFrame, DataFrame, float]:
    """Rows with ``cluster``, the centres and the sum of squared distances: the best of ``starts`` models, fitted in the same passes.

    Rows whose vector is null or has a null take no part; without any there are no centres. Starts are drawn from
    ``oversampling * k`` distinct vectors, chosen by a hash. A pass over the rows updates the centres of all models that still
    move; a model is settled when no centre moves by more than ``moved`` of the sample's extent. A centre that loses its members
    goes to the vector farthest from its centre. With fewer distinct vectors than ``k`` there are fewer clusters.
    Tasks give one sum per centre, so ``starts * k`` rows a pass reach the driver.
    """
    rows = materialised(df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())), "vectors")
    distinct = rows.groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.lit(0).alias("_z"))
    sample = distinct.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(oversampling * k).select("v").collect()
    if not sample:
        return rows.withColumn("cluster", F.lit(None).cast("int")), center_rows(df, []), 0.0
    drawn = np.array([r.v for r in sample], float)
    centers = drawn_starts(drawn, k, seed, starts)
    enough = moved * max(1.0, float(np.abs(drawn - drawn.mean(axis=0)).max()))

    def passed(current: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members and sums of each centre, cost and farthest row of each model."""
        size, dims = current.shape[1:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(current.shape[:2], np.int64), np.zeros(current.shape)
            cost, most, worst = np.zeros(len(current)), np.full(len(current), -1.0), np.zeros((len(current), dims))
            for v in numbers(batches, vector):
                for m, own in enumerate(closest(v, current)):
                    far = ((v - current[m][own]) ** 2).sum(axis=1)
                    n[m] += np.bincount(own, minlength=size)
                    np.add.at(sums[m], own, v)
                    cost[m] += far.sum()
                    if far.max() > most[m]:
                        most[m], worst[m] = far.max(), v[far.argmax()]
            if n.any():
                at = [(m, c) for m in range(len(current)) for c in [-1, *np.flatnonzero(n[m]).tolist()]]
                parts = [[m for m, _ in at], [c for _, c in at], [0 if c < 0 else int(n[m, c]) for m, c in at],
                         [(worst[m] if c < 0 else sums[m, c]).tolist() for m, c in at], [cost[m] if c < 0 else 0.0 for m, c in at], [most[m] for m, _ in at]]
                kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, kinds)], names=["model", "cluster", "n", "s", "cost", "far"])

        out = rows.select(vector).mapInArrow(run, "model int, cluster int, n long, s array<double>, cost double, far double")
        total = out.groupBy("model", "cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(dims)]).alias("s"),
                                                    F.sum("cost").alias("cost"), F.max_by("s", "far").alias("worst"))
        n, sums, cost, worst = np.zeros(current.shape[:2], np.int64), np.zeros(current.shape), np.zeros(len(current)), np.zeros((len(current), dims))
        for r in total.collect():
            if r.cluster < 0:
                cost[r.model], worst[r.model] = r.cost, r.worst
            else:
                n[r.model, r.cluster], sums[r.model, r.cluster] = r.n, r.s
        return n, sums, cost, worst

    moving = np.arange(starts)
    for _ in range(iterations):
        before = centers[moving]
        n, sums, _, worst = passed(before)
        after = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], before)
        for m in np.flatnonzero((n == 0).any(axis=1)):
            after[m, np.flatnonzero(n[m] == 0)[0]] = worst[m]  # one in a pass; the others follow
        centers[moving] = after
        moving = moving[np.abs(after - before).max(axis=(1, 2)) > enough]
        if not len(moving):
            break
    cost = passed(centers)[2]
    best = centers[cost.argmin()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [closest(v, best) for v in numbers([b], vector)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0, int), *own]).astype(np.int32))], names=[*b.schema.names, "cluster"])

    rest = rows.drop("cluster")
    found = rest.mapInArrow(assign, StructType([*rest.schema.fields, StructField("cluster", IntegerType())]))
    return found, center_rows(df, best.tolist()), float(cost.min())


def numbers(batches: Iterable[pa.RecordBatch], vector: str, rows: int = 2048) -> Iterator[np.ndarray]:
    """The vectors of the batches, some rows at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield np.array(b.column(vector).slice(k, rows).to_pylist(), float)


def kmeans_select(df: DataFrame, k: int, seed: int, keys: Sequence[str], vector: str = "v") -> DataFrame:
    """One frame per cluster of poses: the one nearest to the centre. Incomplete poses are left out."""
    found, centers, _ = kmeans(df, k, seed, vector)
    return nearest_to_center(found, centers, keys, vector=vector)


def pose_hierarchy(df: DataFrame, k: int, seed: int, vector: str = "v") -> DataFrame:
    """Rows with ``cluster`` by repeated splitting of groups, from one group to ``k`` (fits a model)."""
    rows = _vectors(df, vector)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_vec")


def embed_2d(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add e1, e2: the first two principal components of the standardised features (fits a model).

    The sign of a component is the one that makes its largest weight positive.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_std", outputCol="_pc").fit(scaled)
    weights = model.pc.toArray()
    sign = [1.0 if weights[abs(weights[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    out = model.transform(scaled).withColumn("_a", vector_to_array("_pc"))
    return out.withColumns({f"e{i + 1}": F.col("_a")[i] * F.lit(sign[i]) for i in range(2)}).drop("_raw", "_std", "_pc", "_a")


def kmeans_per_session(df: DataFrame, total: int, seed: int, keys: Sequence[str] = ("session", "frame"), vector: str = "v",
                       rounds: int = 100, moved: float = 1e-6) -> DataFrame:
    """``total`` frames over all sessions: each session gets its share of clusters and gives the frame nearest to each
    centre; a session with fewer frames than its share gives all.

    All sessions are clustered in the same jobs. Starts are distinct poses, drawn by seed; rounds go on until no centre moves
    by more than ``moved``, ``rounds`` at most. A cluster that loses its members starts anew at the pose that is farthest from its
    centre. Where a session has fewer distinct poses than its share, frames drawn by seed fill it up (their cluster is NULL).
    The centres, ``total`` of them, are held by the driver; tasks send it one sum per cluster and batch.
    """
    keys = list(keys)
    poses = materialised(df.where(~F.exists(vector, lambda x: x.isNull())).select(*keys, vector), "poses")
    share = {r.session: r.quota for r in quotas(poses, total).where("quota > 0").collect()}
    order = hash_order(seed, keys)
    distinct = poses.groupBy("session", vector).agg(F.min(order).alias("_h"))
    starts: dict[str, list] = {}
    for r in first_n(distinct, ["session"], [F.col("_h")], max(share.values(), default=1), "_rn").collect():
        if r["_rn"] <= share.get(r["session"], 0):
            starts.setdefault(r["session"], []).append((r["_rn"], list(r[vector])))
    centers = {s: np.array([v for _, v in sorted(rows)]) for s, rows in starts.items()}

    def nearest(batch: pa.RecordBatch, current: dict) -> Iterator[tuple]:
        """session, places in the batch, vectors, cluster and squared distance"""
        sessions = np.array(batch.column("session").to_pylist(), object)
        vectors = np.array(batch.column(vector).to_pylist(), float)
        for s in set(sessions) & current.keys():
            at = np.flatnonzero(sessions == s)
            v = vectors[at]
            own = closest(v, current[s])
            yield s, at, v, own, ((v - current[s][own]) ** 2).sum(axis=1)

    def sums(current: dict) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (piece for whole in batches for piece in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048))):
                rows: list[tuple] = []
                for s, _, v, own, far in nearest(b, current):
                    for c in np.unique(own):
                        rows.append((s, int(c), int((own == c).sum()), v[own == c].sum(axis=0).tolist(), None))
                    worst = int(far.argmax())
                    rows.append((s, -1, 0, v[worst].tolist(), float(far[worst])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()))], names=["session", "cluster", "n", "s", "far"])

        out = poses.select("session", vector).mapInArrow(run, "session string, cluster int, n long, s array<double>, far double")
        size = len(next(iter(current.values()))[0])
        plain = out.where("cluster >= 0").groupBy("session", "cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(size)]).alias("s"))
        worst = out.where("cluster < 0").groupBy("session").agg(F.max_by("s", "far").alias("s"))
        return plain.unionByName(worst.select("session", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("n"), "s")).collect()

    for _ in range(rounds if centers else 0):
        after = {s: c.copy() for s, c in centers.items()}
        seen: dict[str, set] = {s: set() for s in centers}
        worst = {}
        for r in sums(centers):
            if r.cluster < 0:
                worst[r.session] = np.array(r.s)
            else:
                after[r.session][r.cluster] = np.array(r.s) / r.n
                seen[r.session].add(r.cluster)
        for s, found in seen.items():
            lost = sorted(set(range(len(after[s]))) - found)
            if lost and s in worst:
                after[s][lost[0]] = worst[s]  # one in a round; the others follow
        step = max((float(np.abs(after[s] - centers[s]).max()) for s in centers), default=0.0)
        centers = after
        if step <= moved:
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
            for _, at, _, own, far in nearest(b, centers):
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], pa.array(own.astype(np.int32)), pa.array(np.sqrt(far))],
                                                 names=[*keys, "cluster", "distance"])

    schema = poses.select(*keys).schema.add("cluster", "integer").add("distance", "double")
    found = poses.mapInArrow(assign, schema)
    best = F.min_by(F.struct(*cols(keys[1:]), "distance"), F.struct(F.round("distance", 9), *cols(keys[1:]))).alias("_b")
    picked = found.groupBy("session", "cluster").agg(best, F.count(F.lit(1)).alias("cluster_size"))
    picked = materialised(picked.select("session", "cluster", *[F.col(f"_b.{k}").alias(k) for k in keys[1:]], F.col("_b.distance").alias("distance"),
                                        "cluster_size"), "picked")
    short = {s: n - share[s] for s, n in ((r.session, r["count"]) for r in picked.groupBy("session").count().collect()) if n < share[s]}
    if not short:
        return picked
    open_places = df.sparkSession.createDataFrame([(s, -n) for s, n in short.items()], "session string, _open long")
    rest = poses.select(*keys).join(open_places, "session").join(picked.select(*keys), keys, "left_anti")
    rest = first_n(rest, ["session"], [hash_order(seed, keys), *cols(keys)], max(-n for n in short.values()), "_rn").where("_rn <= _open")
    return picked.unionByName(rest.select(*keys), allowMissingColumns=True)
