"""Low-rank models of views and poses.

A fit reduces the table to D x D sums inside Spark and brings only those to the driver; applying a model is row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trackloom.operators.select import worst_frames
from trackloom.operators.tracks import cumulative_share
from trackloom.session import materialised

EPS = 1e-6  # fixed value: added to every variance before it is inverted


@dataclass(frozen=True)
class LatentModel:
    """components: L rows of D; mean: D; variance: L (used for whitening)."""

    components: tuple[tuple[float, ...], ...]
    mean: tuple[float, ...]
    variance: tuple[float, ...] = ()

    @property
    def loading(self) -> np.ndarray:
        return np.asarray(self.components, dtype=float).T

    @property
    def mu(self) -> np.ndarray:
        return np.asarray(self.mean, dtype=float)

    def first(self, n: int) -> "LatentModel":
        return LatentModel(self.components[:n], self.mean, self.variance[:n])


def view_vectors(pred: DataFrame, views: Sequence[str], keys: Sequence[str], **values: Sequence[str]) -> DataFrame:
    """One row per key with ``v`` = [x, y of the first view, x, y of the second, ...]; missing entries are NULL.

    Other arrays are named with their columns, e.g. ``var=("x_ens_var", "y_ens_var")``.
    """
    values = values or {"v": ("x", "y")}
    made = {n: [F.max(F.when(F.col("view") == v, F.col(c))) for v in views for c in cs] for n, cs in values.items()}
    return pred.groupBy(*keys).agg(*[F.array(*m).alias(n) for n, m in made.items()])


def pose_vectors(points: DataFrame, keypoints: Sequence[str], keys: Sequence[str], name: str = "v") -> DataFrame:
    """One row per pose with ``name`` = [X, Y, Z of the first keypoint, ...]."""
    made = [F.max(F.when(F.col("keypoint") == k, F.col(c))) for k in keypoints for c in "XYZ"]
    return points.groupBy(*keys).agg(F.array(*made).alias(name))


def complete(column: str) -> Column:
    return ~F.exists(column, lambda x: x.isNull())


def flat_columns(column: str, size: int) -> list[Column]:
    """The entries of an array column as plain columns, which reach Python much faster than arrays."""
    return [F.get(column, i).alias(f"_{column}_{i}") for i in range(size)]


def flat_matrix(pdf: pd.DataFrame, column: str, size: int) -> np.ndarray:
    """(n, size) with NaN for missing entries."""
    return pdf[[f"_{column}_{i}" for i in range(size)]].to_numpy(dtype=float, na_value=np.nan)


def _gram(df: DataFrame, column: str, mean: Sequence[float]) -> DataFrame:
    """i, j, product, n: sums of products of centred entries over the rows that have both.

    Each task adds up its batches and emits one D x D block.
    """
    mu, d = np.asarray(mean, dtype=float), len(mean)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((d, d)), np.zeros((d, d))
        for pdf in batches:
            x = flat_matrix(pdf, column, d) - mu
            there = np.isfinite(x).astype(float)
            x = np.where(there > 0, x, 0.0)
            total += x.T @ x
            count += there.T @ there
        i, j = np.indices((d, d))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "product": total.ravel(), "n": count.ravel().astype("int64")})

    parts = df.select(*flat_columns(column, d)).mapInPandas(block, "i long, j long, product double, n long")
    return parts.groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("n").alias("n"))


def _eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors as rows; the largest entry of each is positive."""
    val, vec = np.linalg.eigh(cov)
    val, vec = np.clip(val[::-1], 0, None), vec[:, ::-1].T
    top = np.take_along_axis(vec, np.abs(vec).argmax(axis=1)[:, None], axis=1)
    return val, vec * np.where(top < 0, -1.0, 1.0)


def _moments(df: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each entry, and each pair's covariance over the rows that have both, in one pass over ``df``.

    A task takes its sums around the mean of its own first rows and emits one D x D block of each; the driver moves these, as many as
    there are tasks, to one centre.
    """
    names = [*[f"c{i}" for i in range(size)], *[f"{k}{i}" for k in "nsp" for i in range(size * size)]]

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, sums = None, np.zeros((3, size, size))
        for pdf in batches:
            x = flat_matrix(pdf, column, size)
            there = np.isfinite(x).astype(float)
            if centre is None:
                if not there.any():
                    continue
                known = there.sum(axis=0)
                centre = np.where(known > 0, np.where(there > 0, x, 0.0).sum(axis=0) / np.maximum(known, 1), 0.0)
            x = np.where(there > 0, x - centre, 0.0)
            sums += [there.T @ there, x.T @ there, x.T @ x]
        if centre is not None:
            yield pd.DataFrame([[*centre, *sums.ravel()]], columns=names)

    blocks = df.select(*flat_columns(column, size)).mapInPandas(block, ", ".join(f"{n} double" for n in names)).collect()
    flat = np.array([list(b) for b in blocks], float).reshape(-1, len(names))
    centre, (n, s, p) = flat[:, :size], np.moveaxis(flat[:, size:].reshape(-1, 3, size, size), 1, 0)
    known = np.einsum("bii->bi", n)
    mean = ((centre * known + np.einsum("bii->bi", s)).sum(axis=0)) / np.maximum(known.sum(axis=0), 1)
    d = centre - mean
    p = p + d[:, :, None] * np.swapaxes(s, 1, 2) + s * d[:, None, :] + n * d[:, :, None] * d[:, None, :]
    return np.where(known.sum(axis=0) > 0, mean, np.nan), p.sum(axis=0) / np.maximum(n.sum(axis=0) - 1, 1)


def fit_pca(df: DataFrame, column: str, size: int, n: int | None = None, missing: bool = False) -> LatentModel:
    """Principal components of an array column of ``size`` entries (one pass; a few D x D numbers of each task are collected).

    Without ``missing`` only complete rows count; with it each entry of the covariance uses the rows that have both
    values.
    """
    mean, cov = _moments(df if missing else df.where(complete(column)), column, size)
    val, vec = _eigen(cov)
    n = n or size
    return LatentModel(tuple(map(tuple, vec[:n].tolist())), tuple(None if np.isnan(m) else m for m in mean.tolist()), tuple(val[:n].tolist()))


def singular_spectrum(df: DataFrame, column: str, size: int) -> DataFrame:
    """component, singular_value, share (%), cumulative (%), needed_95, needed_99 of the centred complete rows."""
    rows = df.where(complete(column))
    mean = rows.agg(F.array(*[F.avg(F.get(column, i)) for i in range(size)]).alias("m")).first()["m"]
    block = _gram(rows, column, mean).agg(F.sort_array(F.collect_list(F.struct("i", "j", "product"))).alias("g"))
    block = block.select(F.col("g.product").alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["g"]:
                val, _ = _eigen(np.asarray(g, dtype=float).reshape(size, size))
                yield pd.DataFrame({"component": np.arange(1, size + 1), "singular_value": np.sqrt(val),
                                    "share": val / val.sum() * 100})

    parts = block.mapInPandas(solve, "component long, singular_value double, share double")
    parts = cumulative_share(parts, [])
    whole = Window.partitionBy(F.lit(0))
    reached = [F.min(F.when(F.round("cumulative", 9) >= p, F.col("component"))).over(whole).alias(f"needed_{p}")
               for p in (95, 99)]
    return parts.select("component", "singular_value", "share", "cumulative", *reached)


# Applying a model.

def _lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _centred(column: str, model: LatentModel) -> Column:
    return F.zip_with(column, _lit(model.mean), lambda x, m: x - m)


def _dot(a: Column | str, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def latent_transform(df: DataFrame, column: str, model: LatentModel, name: str = "z") -> DataFrame:
    """Latent coordinates of complete rows, NULL for others."""
    moved = df.withColumn("_c", _centred(column, model))
    z = F.array(*[_dot("_c", _lit(w)) for w in model.components])
    return moved.withColumn(name, F.when(complete(column), z)).drop("_c")


def latent_inverse(df: DataFrame, column: str, model: LatentModel, name: str) -> DataFrame:
    """Entries back from latent coordinates."""
    made = [_dot(column, _lit([w[d] for w in model.components])) + F.lit(float(m)) for d, m in enumerate(model.mean)]
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.array(*made)))


def view_errors(df: DataFrame, observed: str, rebuilt: str, views: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, view, error: distance of the rebuilt to the observed point in each view."""
    def at(column: str, i: int) -> Column:
        return F.get(column, i)

    rows = F.array(*[F.struct(F.lit(v).alias("view"), F.sqrt(
        F.pow(at(observed, 2 * i) - at(rebuilt, 2 * i), 2) + F.pow(at(observed, 2 * i + 1) - at(rebuilt, 2 * i + 1), 2)
    ).alias("error")) for i, v in enumerate(views)])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.view", "_r.error")


def _apply(df: DataFrame, arrays: dict[str, int], results: dict[str, int], make) -> DataFrame:
    """``df`` with new array columns ``results`` (name: size) from ``make(pdf)``, which reads ``arrays`` (name: size).

    Entries travel as plain columns both ways; a result whose first entry is missing becomes NULL.
    """
    rest = [c for c in df.columns if c not in arrays]
    sent = df.select(*rest, *[c for name, size in arrays.items() for c in flat_columns(name, size)])
    names = {n: [f"_{n}_{i}" for i in range(size)] for n, size in results.items()}
    schema = T.StructType([*sent.schema.fields, *[T.StructField(c, T.DoubleType()) for cs in names.values() for c in cs]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                made = make(pdf)
                yield pd.concat([pdf, *[pd.DataFrame(made[n], columns=cs, index=pdf.index) for n, cs in names.items()]], axis=1)

    done = sent.mapInPandas(run, schema)
    back = [F.array(*[f"_{name}_{i}" for i in range(size)]).alias(name) for name, size in arrays.items()]
    return done.select(*rest, *back, *[F.when(F.col(cs[0]).isNotNull(), F.array(*cs)).alias(n) for n, cs in names.items()])


DOUBLES = T.ArrayType(T.DoubleType())


def _blanked(values: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.where(ok[:, None], values, np.nan)


def nan_latent_transform(df: DataFrame, column: str, model: LatentModel, whiten: bool = False, name: str = "z") -> DataFrame:
    """Least-squares latent coordinates from the entries that are there; zeros when none is, or too few."""
    w, mu = model.loading, model.mu
    scale = np.sqrt(np.asarray(model.variance)) if whiten else 1.0

    def make(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x = flat_matrix(pdf, column, len(mu)) - mu
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        a = np.einsum("nd,dk,dl->nkl", there.astype(float), w, w)
        b = x @ w
        ok = np.linalg.eigvalsh(a)[:, 0] > 1e-12
        a[~ok] = np.eye(w.shape[1])
        z = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        z[~ok] = 0.0
        return {name: z / scale}

    return _apply(df, {column: len(mu)}, {name: w.shape[1]}, make)


def _posterior(x: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent mean (n, L) and covariance (n, L, L) of centred rows with variances v."""
    inv = 1.0 / (v + EPS)
    b = np.linalg.inv(np.einsum("nd,dk,dl->nkl", inv, w, w))
    return np.einsum("nkl,nl->nk", b, (x * inv) @ w), b


def fa_transform(df: DataFrame, column: str, variance: str, model: LatentModel) -> DataFrame:
    """Add z, its covariance zcov (L x L, flat), the rebuilt entries and their covariance cov (D x D, flat).

    Rows with a missing entry or variance get NULL.
    """
    w, mu = model.loading, model.mu
    d, n_latent = w.shape

    def make(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x, v = flat_matrix(pdf, column, d) - mu, flat_matrix(pdf, variance, d)
        ok = np.isfinite(x).all(axis=1) & np.isfinite(v).all(axis=1)
        z, b = _posterior(np.where(ok[:, None], x, 0.0), np.where(ok[:, None], v, 1.0), w)
        cov = np.einsum("dk,nkl,el->nde", w, b, w).reshape(len(x), -1)
        made = {"z": z, "zcov": b.reshape(len(x), n_latent * n_latent), "rebuilt": z @ w.T + mu, "cov": cov}
        return {n: _blanked(a, ok) for n, a in made.items()}

    return _apply(df, {column: d, variance: d}, {"z": n_latent, "zcov": n_latent * n_latent, "rebuilt": d, "cov": d * d}, make)


def mahalanobis(df: DataFrame, column: str, variance: str, model: LatentModel, views: Sequence[str], keys: Sequence[str]
                ) -> DataFrame:
    """Per view: distance of the observed point to its reconstruction in units of its covariance, the rebuilt x, y and
    their posterior variances."""
    w, mu = model.loading, model.mu
    first, second = w[0::2], w[1::2]

    def make(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x, v = flat_matrix(pdf, column, len(mu)) - mu, flat_matrix(pdf, variance, len(mu))
        ok = np.isfinite(x).all(axis=1) & np.isfinite(v).all(axis=1)
        z, b = _posterior(np.where(ok[:, None], x, 0.0), np.where(ok[:, None], v, 1.0), w)
        made = {"rebuilt": z @ w.T + mu, "_xx": np.einsum("vk,nkl,vl->nv", first, b, first),
                "_yy": np.einsum("vk,nkl,vl->nv", second, b, second), "_xy": np.einsum("vk,nkl,vl->nv", first, b, second)}
        return {n: _blanked(a, ok) for n, a in made.items()}

    full = _apply(df.select(*keys, column, variance), {column: len(mu), variance: len(mu)},
                  {"rebuilt": len(mu), **{n: len(views) for n in ("_xx", "_yy", "_xy")}}, make)

    def rows(i: int) -> Column:
        return F.struct(
            F.lit(views[i]).alias("view"), F.get("rebuilt", 2 * i).alias("x"), F.get("rebuilt", 2 * i + 1).alias("y"),
            F.get("_xx", i).alias("x_posterior_var"), F.get("_yy", i).alias("y_posterior_var"), F.get("_xy", i).alias("_xy"),
            (F.get(column, 2 * i) - F.get("rebuilt", 2 * i)).alias("_dx"),
            (F.get(column, 2 * i + 1) - F.get("rebuilt", 2 * i + 1)).alias("_dy"),
            (F.get("_xx", i) + F.get(variance, 2 * i) + EPS).alias("_a"),
            (F.get("_yy", i) + F.get(variance, 2 * i + 1) + EPS).alias("_b"))

    flat = full.select(*keys, F.explode(F.array(*[rows(i) for i in range(len(views))])).alias("_r")).select(*keys, "_r.*")
    # The inverse of a symmetric 2 x 2 matrix, written out.
    det = F.col("_a") * F.col("_b") - F.col("_xy") * F.col("_xy")
    form = (F.col("_b") * F.col("_dx") * F.col("_dx") - 2 * F.col("_xy") * F.col("_dx") * F.col("_dy")
            + F.col("_a") * F.col("_dy") * F.col("_dy")) / F.nullif(det, F.lit(0.0))
    return flat.select(*keys, "view", F.when(form.isNotNull(), F.sqrt(F.greatest(form, F.lit(0.0)))).alias("mahalanobis"), "x", "y",
                       "x_posterior_var", "y_posterior_var")


def inflate_variances(df: DataFrame, column: str, variance: str, model: LatentModel, limit: float = 5.0, factor: float = 2.0,
                      rounds: int = 64) -> DataFrame:
    """``df`` with ``variance`` enlarged where a view contradicts the others, and ``times`` (per view: how often).

    As long as a view lies more than ``limit`` from its reconstruction (``mahalanobis``), the variance of the view that is
    farthest off, of equals the first, is multiplied by ``factor`` and the frame is solved again. Entries that are missing
    say nothing and their views are left alone; a frame whose views cannot fix the latent position stays as it is. A view's
    weight falls by half each time, so a frame settles; after ``rounds`` it is left with what it has. Each frame is by itself:
    tasks go on with those that have not settled.
    """
    w, mu = model.loading, model.mu
    d, views = len(mu), len(mu) // 2

    def distances(x: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
        inv = there / (v + EPS)
        info = np.einsum("nd,dk,dl->nkl", inv, w, w)
        fixed = np.linalg.eigvalsh(info)[:, 0] > 1e-12
        info[~fixed] = np.eye(w.shape[1])
        b = np.linalg.inv(info)
        off = x - np.einsum("nkl,nl->nk", b, (x * inv) @ w) @ w.T
        out = np.zeros((len(x), views))
        for i in range(views):
            own = w[2 * i : 2 * i + 2]
            cov = np.einsum("dk,nkl,el->nde", own, b, own) + np.einsum("nd,de->nde", v[:, 2 * i : 2 * i + 2] + EPS, np.eye(2))
            out[:, i] = np.sqrt(np.einsum("nd,nde,ne->n", off[:, 2 * i : 2 * i + 2], np.linalg.inv(cov), off[:, 2 * i : 2 * i + 2]).clip(0))
        seen = there.reshape(-1, views, 2).all(axis=2)
        return np.where(seen & fixed[:, None], out, 0.0)

    def make(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x, v = flat_matrix(pdf, column, d) - mu, flat_matrix(pdf, variance, d)
        there = np.isfinite(x) & np.isfinite(v)
        x, grown = np.where(there, x, 0.0), np.where(there, v, 1.0)
        times = np.zeros((len(x), views))
        left = np.arange(len(x))
        for _ in range(rounds):
            off = distances(x[left], grown[left], there[left].astype(float))
            bad = off.max(axis=1, initial=0.0) > limit
            left, worst = left[bad], off[bad].argmax(axis=1)
            if not len(left):
                break
            for axis in (0, 1):
                grown[left, 2 * worst + axis] *= factor
            times[left, worst] += 1
        return {"_g": np.hstack([times, there, np.where(there, grown, 0.0)])}

    done = _apply(df, {column: d, variance: d}, {"_g": views + 2 * d}, make)
    grown = F.array(*[F.when(F.get("_g", views + i) > 0, F.get("_g", views + d + i)).otherwise(F.get(variance, i)) for i in range(d)])
    return done.withColumn(variance, grown).withColumn("times", F.slice("_g", 1, views).cast("array<int>")).drop("_g")


def fit_factors(df: DataFrame, column: str, size: int, n: int, rounds: int = 50, moved: float = 1e-7) -> tuple[LatentModel, list[float]]:
    """A factor model of an array column, and the log-likelihood before each round.

    Entries are mean + loading x latent + noise of their own variance (``LatentModel.variance``); missing entries are left
    out of the likelihood, so rows count with what they have. Expectation-maximisation from principal components; the
    likelihood never falls, and rounds end when it rises by less than ``moved`` of itself.

    Rows are reduced once to sums for each pattern of missing entries, map-side, and written. A round is one pass over the
    patterns; size x (n + 1)^2 numbers of it reach the driver. Rows without any entry are left out.
    """
    rows = df.where(F.exists(column, lambda x: x.isNotNull()))
    start = fit_pca(rows, column, size, size, missing=True)
    mu0 = start.mu

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[bytes, list[np.ndarray]] = {}
        for pdf in batches:
            x = flat_matrix(pdf, column, size) - mu0
            there = np.isfinite(x)
            for key in np.unique(there, axis=0):
                own = np.where(key, x, 0.0)[(there == key).all(axis=1)]
                more = [np.array([len(own)], float), own.sum(axis=0), (own.T @ own).ravel()]
                sums[key.tobytes()] = [a + b for a, b in zip(sums[key.tobytes()], more)] if key.tobytes() in sums else more
            if len(sums) >= 1024:  # so many patterns are added up by the shuffle
                yield pd.DataFrame([(k.hex(), *np.concatenate(v)) for k, v in sums.items()], columns=names)
                sums = {}
        if sums:
            yield pd.DataFrame([(k.hex(), *np.concatenate(v)) for k, v in sums.items()], columns=names)

    numbers = [f"_{i}" for i in range(1 + size + size * size)]
    names = ["pattern", *numbers]
    parts = rows.select(*flat_columns(column, size)).mapInPandas(reduce, ", ".join(["pattern string", *[f"{c} double" for c in numbers]]))
    stats = materialised(parts.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in numbers]), "missing-patterns")

    values = np.asarray(start.variance)
    w = start.loading[:, :n] * np.sqrt(np.maximum(values[:n] - values[n:].mean() if n < size else values[:n], 1e-9))
    mu, psi = np.zeros(size), np.maximum((start.loading**2 @ values) - (w * w).sum(axis=1), 1e-3 * values.sum() / size + 1e-12)
    width = (n + 1) ** 2
    made = [f"o{i}" for i in range(size * (width + n + 1) + 2 * size + 1)]

    def round_of(w: np.ndarray, mu: np.ndarray, psi: np.ndarray) -> np.ndarray:
        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(made))
            for pdf in batches:
                flat = pdf[numbers].to_numpy(dtype=float)
                for key, one in zip(pdf["pattern"], flat):
                    o = np.flatnonzero(np.frombuffer(bytes.fromhex(key), bool))
                    count, s = one[0], one[1 : 1 + size][o]
                    scatter = one[1 + size :].reshape(size, size)[np.ix_(o, o)]
                    wo, m, p = w[o], mu[o], psi[o]
                    inner = np.linalg.inv(np.eye(n) + (wo / p[:, None]).T @ wo)
                    beta = inner @ (wo / p[:, None]).T
                    centred = scatter - np.outer(s, m) - np.outer(m, s) + count * np.outer(m, m)
                    z = beta @ (s - count * m)
                    zz = count * inner + beta @ centred @ beta.T
                    both = np.block([[zz, z[:, None]], [z[None], np.full((1, 1), count)]])
                    cross = np.vstack([beta @ (scatter - np.outer(m, s)), s])
                    sigma = wo @ wo.T + np.diag(p)
                    told = -(count * (len(o) * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1]) + np.trace(np.linalg.solve(sigma, centred))) / 2
                    for place, entry in enumerate(o):
                        total[entry * width : (entry + 1) * width] += both.ravel()
                        total[size * width + entry * (n + 1) : size * width + (entry + 1) * (n + 1)] += cross[:, place]
                        total[size * (width + n + 1) + entry] += scatter[place, place]
                        total[size * (width + n + 2) + entry] += count
                    total[-1] += told
            yield pd.DataFrame([total], columns=made)

        sums = stats.mapInPandas(expect, ", ".join(f"{c} double" for c in made)).agg(*[F.sum(c).alias(c) for c in made]).first()
        return np.array([v or 0.0 for v in sums])

    history: list[float] = []
    for _ in range(rounds):
        total = round_of(w, mu, psi)
        history.append(float(total[-1]))
        if len(history) > 1 and history[-1] - history[-2] < moved * abs(history[-2]):
            break
        both = total[: size * width].reshape(size, n + 1, n + 1)
        cross = total[size * width : size * (width + n + 1)].reshape(size, n + 1)
        square, count = total[size * (width + n + 1) : -1].reshape(2, size)
        ok = count > 0
        both[~ok] = np.eye(n + 1)
        line = np.linalg.solve(both, cross[:, :, None])[:, :, 0]
        w, mu = line[:, :n], line[:, n]
        psi = np.where(ok, np.maximum((square - (line * cross).sum(axis=1)) / np.maximum(count, 1), 1e-12), 1.0)
    components = w.T
    return LatentModel(tuple(map(tuple, components.tolist())), tuple((mu + mu0).tolist()), tuple(psi.tolist())), history


def frame_vaf(df: DataFrame, column: str, model: LatentModel, ranks: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """Add vaf_<k>: share of a pose's squared distance from the mean kept by the first k components.

    The components must be orthonormal. NULL for incomplete poses.
    """
    moved = df.withColumn("_c", _centred(column, model))
    moved = moved.withColumn("_t", _dot("_c", F.col("_c")))
    moved = moved.withColumn("_p", F.array(*[F.pow(_dot("_c", _lit(w)), 2) for w in model.components[:max(ranks)]]))

    def kept(k: int) -> Column:
        return F.aggregate(F.slice("_p", 1, k), F.lit(0.0), lambda s, x: s + x)

    made = {f"vaf_{k}": F.when(complete(column), 1 - (F.col("_t") - kept(k)) / (F.col("_t") + 1e-12)) for k in ranks}
    return moved.withColumns(made).drop("_c", "_t", "_p")


def worst_rebuilt(vaf: DataFrame, rank: int, n: int) -> DataFrame:
    """The ``n`` frames rebuilt worst at a rank."""
    scored = vaf.where(F.col(f"vaf_{rank}").isNotNull()).withColumn("score", 1 - F.col(f"vaf_{rank}"))
    return worst_frames(scored.select("session", "frame", "score"), n)


def pca_denoise(pred: DataFrame, views: Sequence[str], keys: Sequence[str], n: int = 3) -> DataFrame:
    """keys, view, x, y, error: 2-D points rebuilt from ``n`` components over the views of each point.

    The components are fitted to all rows, each covariance entry from the rows that have both values. The vectors are written
    once, as both the fit and the result read them.
    """
    vec = materialised(view_vectors(pred, views, keys), "vectors")
    size = 2 * len(views)
    model = fit_pca(vec, "v", size, min(n, size), missing=True)
    made = latent_inverse(nan_latent_transform(vec, "v", model), "z", model, "rebuilt")
    rows = F.array(*[F.struct(F.lit(v).alias("view"), F.get("rebuilt", 2 * i).alias("x"), F.get("rebuilt", 2 * i + 1).alias("y"),
                              F.sqrt(F.pow(F.get("v", 2 * i) - F.get("rebuilt", 2 * i), 2) +
                                     F.pow(F.get("v", 2 * i + 1) - F.get("rebuilt", 2 * i + 1), 2)).alias("error"))
                     for i, v in enumerate(views)])
    return made.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
