"""Points smoothed through cameras, against one dense solver over the whole track."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.catalog import fixtures as X
from trackloom.operators import geometry as G, latent as M, rig as R, smooth as S

VIEWS = ["a", "b", "c"]
CAMERAS = "session string, view string, k array<double>, dist array<double>, rvec array<double>, tvec array<double>"
ENS = "session string, keypoint string, frame long, view string, x double, y double, x_ens_var double, y_ens_var double"
S2 = 0.01


def cameras_of(sessions=("S0", "S1")):
    k = [400.0, 0.0, 320.0, 0.0, 420.0, 240.0, 0.0, 0.0, 1.0]
    turns = {"a": [0.0, 0.0, 0.0], "b": [0.1, 0.7, 0.0], "c": [-0.2, -0.8, 0.1]}
    return [(s, v, k, [-0.05, 0.01, 0.0, 0.0, 0.0], r, [0.1, -0.1, 5.0]) for s in sessions for v, r in turns.items()]


@pytest.fixture(scope="module")
def cams(spark):
    return spark.createDataFrame(cameras_of(), CAMERAS)


@pytest.fixture(scope="module")
def rig(spark, cams):
    got = R.rigs(cams, VIEWS).where("session = 'S0'").first().rig
    return np.array(got).reshape(1, len(VIEWS), -1)


def track(rig, frames, seed, noise=1.0):
    draw = np.random.default_rng(seed)
    at = np.cumsum(0.1 * draw.normal(size=(frames, 3)), axis=0)
    seen = R.pixels(at, np.repeat(rig, frames, axis=0))[0]
    return at, seen + noise * draw.normal(size=seen.shape)


def rows_of(session, keypoint, seen, missing=lambda f, v: False):
    return [(session, keypoint, f, VIEWS[v], *([None, None] if missing(f, v) else seen[f, v].tolist()), 1.0, 2.0)
            for f in range(len(seen)) for v in range(len(VIEWS))]


def few(f, v):
    return f % 7 == 3 and v > 0 or f % 7 == 5


def dense(rig, seen, missing, start, s, prior, rounds=50):
    """Gauss-Newton over all points at once, slopes by differences."""
    n, x = len(seen), start.copy()
    walk = np.zeros((3 * n, 3 * n))
    for f in range(n):
        for i in range(3):
            walk[3 * f + i, 3 * f + i] += 1 / (prior + s) if f == 0 else 1 / s
            if f:
                walk[3 * f - 3 + i, 3 * f - 3 + i] += 1 / s
                walk[3 * f + i, 3 * f - 3 + i] -= 1 / s
                walk[3 * f - 3 + i, 3 * f + i] -= 1 / s
    for _ in range(rounds):
        a, b = walk.copy(), -walk @ x.ravel()
        for f in range(n):
            here = R.pixels(x[f][None], rig)[0][0]
            for v in range(len(VIEWS)):
                if missing(f, v):
                    continue
                slope = np.stack([(R.pixels((x[f] + 1e-6 * e)[None], rig)[0][0, v] - here[v]) / 1e-6 for e in np.eye(3)], axis=1)
                w = np.diag([1.0, 0.5])
                a[3 * f:3 * f + 3, 3 * f:3 * f + 3] += slope.T @ w @ slope
                b[3 * f:3 * f + 3] += slope.T @ w @ (seen[f, v] - here[v])
        move = np.linalg.solve(a, b).reshape(n, 3)
        x += move
        if np.abs(move).max() < 1e-9:
            break
    return x


def test_pixels_are_those_of_project(spark, cams, rig):
    points = np.random.default_rng(1).normal(size=(20, 3))
    got, slopes = R.pixels(points, np.repeat(rig, 20, axis=0))
    df = spark.createDataFrame([("S0", i, *p) for i, p in enumerate(points.tolist())], "session string, i long, X double, Y double, Z double")
    for r in G.project(df, cams).collect():
        assert got[r.i, VIEWS.index(r.view)] == pytest.approx([r.px, r.py])
    for i, e in enumerate(np.eye(3)):
        up, down = (R.pixels(points + d * e, np.repeat(rig, 20, axis=0))[0] for d in (1e-5, -1e-5))
        assert slopes[..., i] == pytest.approx((up - down) / 2e-5, rel=1e-5, abs=1e-5)


def test_the_track_is_that_of_a_dense_solver(spark, cams, rig):
    at, seen = track(rig, 300, 2)
    other, seen_2 = track(rig, 40, 3)
    df = spark.createDataFrame(rows_of("S0", "k", seen, few) + rows_of("S1", "k", seen_2), ENS)
    out = R.smooth_through_cameras(df, cams, VIEWS, S2, tolerance=1e-5).toPandas()
    assert len(out) == 3 * 340 and out.step.max() <= 1e-5
    for session, start, pix, gone in (("S0", at, seen, few), ("S1", other, seen_2, lambda f, v: False)):
        want = dense(rig, pix, gone, start, S2, S.LATENT_PRIOR)
        one = out[(out.session == session) & (out.view == "b")].sort_values("frame")
        assert one[["at_x", "at_y", "at_z"]].to_numpy() == pytest.approx(want, abs=1e-5)
        assert one[["x", "y"]].to_numpy() == pytest.approx(R.pixels(want, np.repeat(rig, len(want), axis=0))[0][:, 1], abs=1e-3)
    gone = out[(out.session == "S0") & (out.frame % 7 == 5)]
    assert len(gone) and gone.x_ens_median.isna().all() and gone.x.notna().all()
    near = out[(out.session == "S0") & (out.frame % 7 == 1)]
    assert gone.x_posterior_var.mean() > near.x_posterior_var.mean()


def test_the_true_step_is_chosen(spark, cams, rig):
    _, seen = track(rig, 400, 4)
    df = spark.createDataFrame(rows_of("S0", "k", seen, few), ENS)
    got = R.tuned_through_cameras(df, cams, VIEWS, (1e-4, 0.01, 1.0))
    assert {r.process_variance for r in got.select("process_variance").distinct().collect()} == {0.01}
    own = R.smooth_through_cameras(got, cams, VIEWS, "process_variance").toPandas()
    plain = R.smooth_through_cameras(df, cams, VIEWS, 0.01).toPandas()
    by = ["frame", "view"]
    assert own.sort_values(by).x.to_numpy() == pytest.approx(plain.sort_values(by).x.to_numpy(), abs=1e-6, nan_ok=True)  # the walk passes behind a camera


def test_lower_error_than_the_linear_form(spark, cams, rig):
    at, seen = track(rig, 200, 5)
    true = R.pixels(at, np.repeat(rig, 200, axis=0))[0]
    df = spark.createDataFrame(rows_of("S0", "k", seen), ENS)
    keys = ["session", "frame", "keypoint"]
    model = M.fit_pca(M.view_vectors(df, VIEWS, keys), "v", 2 * len(VIEWS), 3)
    spread = float(np.var(np.diff(true.reshape(200, -1), axis=0)))
    linear = S.smooth_multi_view(df, model, VIEWS, spread).toPandas()
    own = R.smooth_through_cameras(df, cams, VIEWS, S2).toPandas()

    def error(out):
        want = np.stack([true[f, VIEWS.index(v)] for f, v in zip(out.frame, out.view)])
        return float(np.sqrt(((out[["x", "y"]].to_numpy() - want) ** 2).sum(axis=1)).mean())

    raw = float(np.sqrt(((seen - true) ** 2).sum(axis=2)).mean())
    assert error(own) < error(linear) and error(own) < raw


def test_odd_rows(spark, cams, rig):
    _, seen = track(rig, 30, 6)
    none = spark.createDataFrame([], ENS)
    assert R.smooth_through_cameras(none, cams, VIEWS, S2).collect() == []
    rows = rows_of("S0", "k", seen) + rows_of("S9", "k", seen) + rows_of(None, "k", seen) + rows_of("S1", "k", seen, lambda f, v: True)
    out = R.smooth_through_cameras(spark.createDataFrame(rows, ENS), cams.where("view <> 'c'"), VIEWS, S2).toPandas()
    assert set(out.session) == {"S0", "S1"}
    assert out[out.view == "c"].x.isna().all() and out[(out.session == "S0") & (out.view != "c")].x.notna().all()
    with pytest.raises(ValueError):
        R.smooth_through_cameras(none, cams, VIEWS, S2, keys=["keypoint"])


def test_noise_free_views_give_the_true_points(spark, sf):
    from trackloom.catalog import geometry as CG
    ens = CG.noise_free(spark, sf).withColumns({c: F.lit(1e-4) for c in ("x_ens_var", "y_ens_var")})
    out = R.smooth_through_cameras(ens, X.cameras(spark, sf), X.VIEWS, 1.0).select("session", "keypoint", "frame", "at_x", "at_y", "at_z").distinct()
    both = out.join(X.world(spark, sf).selectExpr("session", "keypoint", "frame", "X AS tx", "Y AS ty", "Z AS tz"), ["session", "keypoint", "frame"])
    far = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*[F.abs(F.col(f"at_{a}") - F.col(f"t{a}")) for a in "xyz"])).alias("far")).first()
    assert far.n == X.world(spark, sf).count() and far.far < 1e-5
