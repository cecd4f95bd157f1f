"""Fits and searches against slow versions: process variances, inflated variances, factor models, clusters, Ward's hierarchy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from check import compare
from trackloom.operators import cluster as C, hierarchy as H, latent as M, smooth as S

VIEWS = ["a", "b", "c", "d"]


def slow_log_likelihood(rows, s, prior):
    """One filter step per frame; each row is a list of (direction, value, variance) seen of the state."""
    size = len(rows[0][1])
    mean, cov, total = np.zeros(size), np.eye(size) * prior, 0.0
    for seen in rows[1:]:
        cov = cov + s * np.eye(size)
        for w, value, variance in seen:
            spread = w @ cov @ w + variance
            off = value - w @ mean
            total -= (math.log(2 * math.pi * spread) + off * off / spread) / 2
            gain = cov @ w / spread
            mean, cov = mean + gain * off, cov - np.outer(gain, w @ cov)
    return total


@pytest.fixture(scope="module")
def tracks(spark):
    """Random walks of known step seen with noise, with gaps; two tracks per keypoint, one of them longer than a range."""
    draw = np.random.default_rng(9)
    rows = []
    for keypoint, step in (("still", 0.05), ("quick", 3.0)):
        for session, frames in (("S0", 600), ("S1", 40)):
            at = np.array([100.0, 50.0])
            for frame in range(frames):
                at = at + step * draw.normal(size=2)
                if frame % 17 == 5:
                    rows.append((session, "a", keypoint, frame, None, float(at[1] + draw.normal()), 1.0, 1.0))
                else:
                    x, y = (at + draw.normal(size=2)).tolist()
                    rows.append((session, "a", keypoint, frame, x, y, 1.0, 1.0))
    df = spark.createDataFrame(rows, "session string, view string, keypoint string, frame long, x double, y double, x_ens_var double, y_ens_var double")
    return rows, df


GRID = (0.0025, 0.1, 1.0, 9.0, 100.0)


def test_likelihoods_are_those_of_a_filter_by_frames(spark, tracks):
    rows, df = tracks
    keys = ["session", "view", "keypoint"]
    got = S.track_likelihood(S.single_view_information(df, keys), keys, 2, GRID, 1e6).collect()
    assert len(got) == 4 * len(GRID)
    for r in got:
        own = [x for x in rows if (x[0], x[2]) == (r.session, r.keypoint)]
        seen = [[(np.eye(2)[k], x[4 + k], x[6 + k]) for k in range(2) if x[4 + k] is not None] for x in own]
        assert r.n == len(own)
        assert r.log_likelihood == pytest.approx(slow_log_likelihood([(None, np.zeros(2)), *seen], r.process_variance, 1e6), rel=1e-6, abs=1e-4)


def test_the_true_step_is_chosen_per_keypoint(spark, tracks):
    _, df = tracks
    chosen = {r.keypoint: r.process_variance for r in S.tuned(df, GRID).select("keypoint", "process_variance").distinct().collect()}
    assert chosen == {"still": 0.0025, "quick": 9.0}
    tuned = S.smooth_single_view(S.tuned(df, GRID), "process_variance").toPandas()
    for keypoint, s in chosen.items():
        alone = S.smooth_single_view(df.where(F.col("keypoint") == keypoint), s).toPandas()
        assert compare(tuned[tuned.keypoint == keypoint].round(6), alone.round(6)) == ""


def test_multi_view_likelihood_is_that_of_a_filter_by_frames(spark):
    draw = np.random.default_rng(5)
    w = draw.normal(size=(8, 3))
    model = M.LatentModel(tuple(map(tuple, w.T.tolist())), tuple(draw.normal(size=8).tolist()))
    z, rows, seen = np.zeros(3), [], []
    for frame in range(300):
        z = z + 0.5 * draw.normal(size=3)
        v = w @ z + model.mu + 0.1 * draw.normal(size=8)
        here = [i for i in range(4) if (frame + i) % 5]
        rows += [("S", "k", frame, VIEWS[i], *v[2 * i : 2 * i + 2].tolist(), 0.01, 0.02) for i in here]
        seen.append([(w[2 * i + k], v[2 * i + k] - model.mu[2 * i + k], (0.01, 0.02)[k]) for i in here for k in range(2)])
    df = spark.createDataFrame(rows, "session string, keypoint string, frame long, view string, x double, y double, x_ens_var double, y_ens_var double")
    keys = ["session", "keypoint"]
    got = {r.process_variance: r.log_likelihood for r in S.track_likelihood(S.multi_view_information(df, model, VIEWS, keys), keys, 3, (0.01, 0.25, 6.0), 100.0).collect()}
    for s, value in got.items():
        assert value == pytest.approx(slow_log_likelihood([(None, np.zeros(3)), *seen], s, 100.0), rel=1e-6)
    assert max(got, key=got.get) == 0.25
    tuned = S.tuned_multi_view(df, model, VIEWS, (0.01, 0.25, 6.0))
    own = S.smooth_multi_view(tuned, model, VIEWS, "process_variance").toPandas().round(6)
    assert compare(own, S.smooth_multi_view(df, model, VIEWS, 0.25).toPandas().round(6)) == ""


# Inflated variances

def slow_inflation(x, v, w, mu, limit, rounds=64):
    v, times = list(v), [0] * (len(x) // 2)
    for _ in range(rounds):
        o = [d for d in range(len(x)) if x[d] is not None and v[d] is not None]
        info = sum((np.outer(w[d], w[d]) / (v[d] + 1e-6) for d in o), np.zeros((w.shape[1],) * 2))
        if not o or np.linalg.eigvalsh(info)[0] <= 1e-12:
            break
        b = np.linalg.inv(info)
        z = b @ sum(w[d] * (x[d] - mu[d]) / (v[d] + 1e-6) for d in o)
        far = []
        for i in range(len(times)):
            pair = [2 * i, 2 * i + 1]
            if not set(pair) <= set(o):
                far.append(0.0)
                continue
            off = np.array([x[d] - mu[d] - w[d] @ z for d in pair])
            cov = w[pair] @ b @ w[pair].T + np.diag([v[d] + 1e-6 for d in pair])
            far.append(math.sqrt(max(0.0, off @ np.linalg.solve(cov, off))))
        if max(far) <= limit:
            break
        worst = far.index(max(far))
        times[worst] += 1
        for d in (2 * worst, 2 * worst + 1):
            v[d] *= 2
    return v, times


def test_bad_views_lose_their_weight(spark):
    draw = np.random.default_rng(3)
    w = draw.normal(size=(8, 3))
    model = M.LatentModel(tuple(map(tuple, w.T.tolist())), tuple(draw.normal(size=8).tolist()))
    rows, bad = [], {}
    for k in range(300):
        x = (w @ draw.normal(size=3) + model.mu + 0.05 * draw.normal(size=8)).tolist()
        v = draw.uniform(0.002, 0.004, 8).tolist()
        if k % 3 == 0:
            bad[k] = k % 4
            x[2 * bad[k]] += 4.0
        if k % 5 == 0:
            gone = (k % 4 + 1) % 4
            x[2 * gone] = None if k % 2 else x[2 * gone]
            v[2 * gone + 1] = None if k % 10 == 0 else v[2 * gone + 1]
        rows.append((k, x, v, "kept"))
    rows += [(900, [None] * 8, [1.0] * 8, "kept"), (901, [1.0, 2.0] + [None] * 6, [1e-3] * 8, "kept")]
    df = spark.createDataFrame(rows, "id long, v array<double>, var array<double>, times string").drop("times").withColumn("other", F.lit(1))
    got = {r.id: r for r in M.inflate_variances(df, "v", "var", model, 5.0).collect()}
    caught = 0
    for k, x, v, _ in rows:
        want_v, want_times = slow_inflation(x, v, w, model.mu, 5.0)
        assert got[k].times == want_times and got[k].v == x
        assert [a is None for a in got[k]["var"]] == [a is None for a in want_v]
        assert [a for a in got[k]["var"] if a is not None] == pytest.approx([a for a in want_v if a is not None])
        caught += k in bad and want_times[bad[k]] == max(want_times) > 0
    assert caught > 0.5 * len(bad) and sum(sum(got[k].times) == 0 for k in range(300) if k not in bad) > 150


# Factor models

def dense_em(x, w, mu, psi, rounds):
    """Expectation-maximisation on full data, by the book."""
    told = []
    for _ in range(rounds + 1):
        sigma = w @ w.T + np.diag(psi)
        c = x - mu
        told.append(-0.5 * (len(x) * (x.shape[1] * math.log(2 * math.pi) + np.linalg.slogdet(sigma)[1]) + np.trace(np.linalg.solve(sigma, c.T @ c))))
        beta = w.T @ np.linalg.inv(sigma)
        z = c @ beta.T
        zz = len(x) * (np.eye(w.shape[1]) - beta @ w) + z.T @ z
        both = np.block([[zz, z.sum(axis=0)[:, None]], [z.sum(axis=0)[None], np.array([[len(x)]])]])
        cross = np.vstack([z.T @ x, x.sum(axis=0)])
        line = np.linalg.solve(both, cross).T
        w, mu = line[:, :-1], line[:, -1]
        psi = ((x * x).sum(axis=0) - (line * cross.T).sum(axis=1)) / len(x)
    return told, w, mu, psi


def test_factors_of_full_data_equal_a_dense_fit(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 2)) @ draw.normal(size=(2, 6)) + draw.normal(size=(400, 6)) * np.array([0.1, 0.3, 0.5, 0.2, 0.4, 0.6]) + 10
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    model, history = M.fit_factors(df, "v", 6, 2, rounds=12, moved=0.0)
    start = M.fit_pca(df, "v", 6, 6, missing=True)
    values = np.asarray(start.variance)
    w = start.loading[:, :2] * np.sqrt(values[:2] - values[2:].mean())
    told, w, mu, psi = dense_em(x - start.mu, w, np.zeros(6), start.loading**2 @ values - (w * w).sum(axis=1), 11)
    assert history == pytest.approx(told, rel=1e-9)
    assert all(b >= a for a, b in zip(history, history[1:]))
    assert np.allclose(model.loading @ model.loading.T + np.diag(model.variance), w @ w.T + np.diag(psi), atol=1e-6) and np.allclose(model.mu, mu + start.mu)


def test_factors_with_missing_entries(spark):
    draw = np.random.default_rng(2)
    load, noise = draw.normal(size=(2, 6)), np.array([0.1, 0.3, 0.2, 0.2, 0.4, 0.3])
    x = draw.normal(size=(6000, 2)) @ load + draw.normal(size=(6000, 6)) * noise + 5
    gone = draw.random((6000, 6)) < 0.2
    rows = [([None if g else v for v, g in zip(a.tolist(), b)],) for a, b in zip(x, gone)] + [([None] * 6,)]
    model, history = M.fit_factors(spark.createDataFrame(rows, "v array<double>"), "v", 6, 2, rounds=40)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(history, history[1:]))
    made = model.loading @ model.loading.T + np.diag(model.variance)
    true = load.T @ load + np.diag(noise**2)
    assert np.abs(made - true).max() < 0.08 * np.abs(true).max() and np.abs(model.mu - 5).max() < 0.1


# Ward's hierarchy

def slow_ward(x, n):
    """All pairs of groups at each step."""
    groups = {k: (n[k], x[k]) for k in range(len(x))}
    out = []
    while len(groups) > 1:
        ids = sorted(groups)
        best = min(((2 * groups[a][0] * groups[b][0] / (groups[a][0] + groups[b][0]) * ((groups[a][1] - groups[b][1]) ** 2).sum(), a, b)
                    for i, a in enumerate(ids) for b in ids[i + 1 :]))
        (na, ca), (nb, cb) = groups.pop(best[1]), groups.pop(best[2])
        groups[len(x) + len(out)] = na + nb, (na * ca + nb * cb) / (na + nb)
        out.append((best[1], best[2], math.sqrt(best[0]), na + nb))
    return out


def test_merges_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(70, 3)), 3)
    n = draw.integers(1, 4, 70)
    rows = [(x[k].tolist(),) for k in range(70) for _ in range(n[k])] + [([None, 1.0, 2.0],), (None,)]
    tree = H.ward(spark.createDataFrame(rows, "v array<double>"), "v", 3)
    order = sorted(range(70), key=lambda k: (n[k], n[k] * (x[k] ** 2).sum(), *(n[k] * x[k])))
    assert sorted(map(tuple, tree.centres.round(9).tolist())) == sorted(map(tuple, x.tolist())) and tree.errors.max() < 1e-9
    want = slow_ward(tree.centres, tree.rows)
    assert len(order) == len(tree.rows)
    for got, (a, b, height, size) in zip(tree.merges.tolist(), want):
        assert got[:2] == [a, b] and got[2] == pytest.approx(height) and got[3] == size
    for k in (1, 2, 5, 70):
        assert len(set(tree.labels(k).tolist())) == k
    total = np.repeat(x, n, axis=0)
    assert (tree.merges[:, 2] ** 2).sum() / 2 == pytest.approx(((total - total.mean(axis=0)) ** 2).sum())


def test_summaries_of_many_rows(spark):
    """More poses than leaves: what is summed up stays whole, and clusters far apart are told apart."""
    draw = np.random.default_rng(6)
    middles = draw.normal(size=(5, 4)) * 20
    x = np.vstack([m + draw.normal(size=(900, 4)) for m in middles])
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(6)
    tree = H.ward(df, "v", 4, leaves=60)
    assert len(tree.rows) <= 60 and tree.rows.sum() == len(x) and tree.merges[-1, 3] == len(x) and (np.diff(tree.merges[:, 2]) >= -1e-9).all()
    error = tree.errors.sum() + (tree.merges[:, 2] ** 2).sum() / 2
    assert error == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    found = H.ward_clusters(df, "v", 4, 5, leaves=60).toPandas().sort_values("id")
    assert len(found) == len(x) and all(found.cluster[found.id // 900 == g].nunique() == 1 for g in range(5)) and found.cluster.nunique() == 5


def test_small_and_empty_tables(spark):
    one = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "v array<double>")
    assert len(H.ward(one, "v", 2).merges) == 0 and H.ward(one, "v", 2).rows.tolist() == [2.0]
    none = H.ward(one.limit(0), "v", 2)
    assert len(none.rows) == 0 and len(none.merges) == 0 and H.ward_clusters(one.limit(0), "v", 2, 3).count() == 0


# The comparison itself

def test_comparison_sees_missing_values():
    def differ(a, b, kind):
        return compare(pd.DataFrame({"a": pd.array(a, kind)}), pd.DataFrame({"a": pd.array(b, kind)})) != ""

    for kind in ("Int64", "Float64", "object"):
        assert differ([0, 5], [None, 5], kind) and differ([None, 5], [0, 5], kind) and differ([1, 2], [1, 3], kind)
        assert not differ([None, 5], [5, None], kind) and not differ([0, 5], [5, 0], kind)


# Clusters of vectors

def vectors(spark, values):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in enumerate(values)], "frame long, v array<double>")


def test_all_starts_are_fitted_in_the_same_passes(spark):
    draw = np.random.default_rng(5)
    places = np.concatenate([draw.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0), (4, 4, 0), (2, 2, 5))]) + 1e4
    found, centers, cost = C.kmeans(vectors(spark, places.tolist()), 5, 3)
    rows = found.orderBy("frame").collect()
    own, middle = np.array([r.cluster for r in rows]), np.array([c.center for c in centers.orderBy("cluster").collect()])
    far = ((places[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == own).all() and abs(far.min(axis=1).sum() - cost) < 1e-6
    assert np.allclose(middle, [places[own == k].mean(axis=0) for k in range(5)], atol=1e-6)
    assert sorted(np.bincount(own)) == [60] * 5
    single = [C.kmeans(vectors(spark, places.tolist()), 5, 3, starts=1)[2], cost]
    assert min(single) == pytest.approx(cost, abs=1e-6)


def test_starts_of_few_or_no_vectors(spark):
    found, centers, cost = C.kmeans(vectors(spark, [(1, 2), (1, 2), (5, 6), None, (None, 1)]), 4, 0)
    assert found.count() == 3 and centers.count() == 2 and cost == 0
    found, centers, cost = C.kmeans(vectors(spark, [None]), 3, 0)
    assert found.columns == ["frame", "v", "cluster"] and found.count() == centers.count() == 0 == cost


def test_nearest_centre_by_a_product():
    draw = np.random.default_rng(2)
    v, c = draw.normal(1e6, 1, (200, 4)), draw.normal(1e6, 1, (3, 7, 4))
    want = ((v[None, :, None, :] - c[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    assert (C.closest(v, c) == want).all() and (C.closest(v, c[0]) == want[0]).all()
