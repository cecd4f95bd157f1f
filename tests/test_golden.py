"""Edge cases with results worked out by hand, and invariants of the solvers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions import names as N
from trackloom.functions import space as S
from trackloom.operators import behaviour as B
from trackloom.operators import cluster as C
from trackloom.operators import ensemble as E
from trackloom.operators import evaluate as V
from trackloom.operators import geometry as G
from trackloom.operators import joins as J
from trackloom.operators import latent as M
from trackloom.operators import select as P
from trackloom.operators import smooth as Z
from trackloom.operators import tracks as K


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


@pytest.mark.parametrize("name, session, view", [
    ("20231031_B20_chew_bl_000_TL_08-38-25.csv", "20231031_B20_chew_bl_000_08-38-25", "TL"),
    ("a_L_b_TL.csv", "a_L_b", "TL"), ("nothing_here.csv", "nothing", "here")])
def test_longest_view_first(spark, name, session, view):
    row = one(spark, n=name).select(N.session_info(F.col("n"), ["L", "TL"]).alias("i")).first()["i"]
    assert (row["session"], row["view"]) == (session, view)


def test_sequence_and_paths(spark):
    views = ["leftCamera", "Cam-A", "lBack"]
    rows = {"_iblrig_leftCamera.downsampled.u1": "_iblrig.downsampled.u1", "PRL43_1_lBack.short": "PRL43_1",
            "fly_R2C14_Cam-A_str-ccw-0.72_sec": "fly_R2C14_str-ccw-0.72_sec"}
    for name, want in rows.items():
        assert one(spark, n=name).select(N.sequence_name(F.col("n"), views)).first()[0] == want
    made = one(spark, s="fly_R2C14_str-ccw-0.72_sec", v="Cam-A", f=12).select(
        N.image_path(F.col("s"), F.col("v"), F.col("f"))).first()[0]
    assert made == "labeled_data/fly_R2C14_Cam-A_str-ccw-0.72_sec/img00000012.png"
    long = one(spark, s="a", v="b", f=123456789).select(N.image_path(F.col("s"), F.col("v"), F.col("f"))).first()[0]
    assert long.endswith("img123456789.png")


def test_box_of_size_zero(spark):
    df = one(spark, x=5.0, y=6.0, box_x=1.0, box_y=1.0, box_w=0.0, box_h=10.0)
    assert S.remap_guarded(df).first()["x"] == 5.0
    assert S.crop_or_null(df).first()["x"] is None
    assert S.full_to_crop(df).first()["x"] is None


def test_crop_and_back(spark):
    df = one(spark, x=51.5, y=62.25, box_x=10.0, box_y=20.0, box_w=200.0, box_h=180.0)
    row = S.crop_to_full(S.full_to_crop(df)).first()
    assert row["x"] == pytest.approx(51.5) and row["y"] == pytest.approx(62.25)


def trace(spark, speeds, dt=0.005):
    """A trace whose fast frames are those listed; a frame is fast when both its neighbours are a jump apart."""
    yaw = np.cumsum([0.0, *speeds])
    return spark.createDataFrame([("m", "s", i, float(v)) for i, v in enumerate(yaw)], "model string, session string, frame long, yaw double")


def by_hand(speeds, dt=0.005, threshold=500, min_frames=2, merge=4):
    yaw = np.cumsum([0.0, *speeds])
    fast = np.abs(np.gradient(yaw, dt)) >= threshold
    runs, start = [], None
    for i, f in enumerate([*fast, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            runs.append([start, i])
            start = None
    merged = runs[:1]
    for s, e in runs[1:]:
        if s - merged[-1][1] <= merge:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    return [(s, e, yaw[min(e, len(yaw) - 1)] - yaw[s]) for s, e in merged if e - s >= min_frames]


@pytest.mark.parametrize("gap", [3, 4, 5, 6, 7, 8])
def test_saccades_at_the_merge_border(spark, gap):
    speeds = [0] * 9 + [8, 8, 8] + [0] * gap + [-8, -8] + [0] * 12 + [9, 9, 9]
    got = sorted((r.onset, r.offset, r.amplitude_deg) for r in B.detect_saccades(trace(spark, speeds), 0.005).collect())
    want = by_hand(speeds)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert got[-1][1] == len(speeds) + 1  # the last run ends with the trace


def test_snippets_of_even_length_are_skipped(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(4)], "part string, frame long")
    assert [tuple(r) for r in K.center_frame(df, ["part"]).collect()] == [("a", 2)]


def test_positions_serve_where_no_frame_number_matches(spark):
    lab = spark.createDataFrame([("s", "v", 100), ("s", "v", 50), ("t", "v", 1), ("t", "v", 77)], "session string, view string, frame long")
    pred = spark.createDataFrame([(s, "v", f, float(f)) for s in "st" for f in range(4)], "session string, view string, frame long, x double")
    got = {(r.session, r.label_frame): r.frame for r in J.frames_for_labels(lab, pred).collect()}
    assert got == {("s", 50): 0, ("s", 100): 1, ("t", 1): 1}


def test_constant_axis_becomes_zero(spark):
    df = spark.createDataFrame([("m", "s", float(i), 3.0, None if i else 2.0) for i in range(3)],
                               "model string, session string, X double, Y double, Z double")
    rows = K.minmax_normalise(df).orderBy("X").collect()
    assert [r.X for r in rows] == [-1.0, 0.0, 1.0] and {r.Y for r in rows} == {0.0} and [r.Z for r in rows] == [0.0, None, None]


def test_unknown_modes_are_errors(spark):
    df = one(spark, model="m", session="s", view="v", frame=1, keypoint="k", seed=0, x=1.0, y=1.0, likelihood=1.0)
    with pytest.raises(ValueError):
        E.ensemble(df, "mode")
    with pytest.raises(ValueError):
        S.valid_observations(df, 1, "some")


def test_median_with_and_without_the_seed_list(spark):
    rows = [("m", "s", "v", f, "k", s, None if (f + s) % 4 == 0 else float(f * s), 1.0 * s, 0.5) for f in range(8) for s in range(4)]
    df = spark.createDataFrame(rows, "model string, session string, view string, frame long, keypoint string, seed long,"
                                     " x double, y double, likelihood double")
    a = E.ensemble(df, "median").orderBy("frame").toPandas()
    b = E.ensemble(df, "median", seeds=[0, 1, 2, 3]).orderBy("frame").toPandas()
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])


def test_all_keypoints_count_when_none_is_active(spark):
    rows = [("s", v, f, k, 0.2) for v in "ab" for f in range(3) for k in "xy"]
    df = spark.createDataFrame(rows, "session string, view string, frame long, keypoint string, likelihood double")
    assert E.confident_frames(df, 0.5, 2).count() == 0
    assert E.confident_frames(df, 0.1, 2).count() == 3


def test_missing_variance_makes_a_score_unknown(spark):
    rows = [("s", 0, 1.0, 2.0), ("s", 0, 3.0, None), ("s", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "session string, frame long, x_ens_var double, y_ens_var double")
    got = {r.frame: r.score for r in E.frame_variance_score(df).collect()}
    assert got == {0: None, 1: 2.0}


def test_cluster_with_no_spread(spark):
    df = spark.createDataFrame([(c, *[1.0] * 11) for c in (0, 1)], ["cluster", *B.FEATURES])
    assert {r.name for r in C.name_clusters(df, B.FEATURES).collect()} == {"C0_Stationary", "C1_Stationary"}


def test_r2_of_constant_labels_is_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 2.0)] * 3, "k string, lx double, ly double, x double, y double")
    assert V.r2_pooled(df, ["k"]).first()["r2"] is None


# Cameras.

@pytest.fixture(scope="module")
def rig(spark):
    cams = [("s", f"v{i}", i, [800.0, 0.0, 300.0, 0.0, 810.0, 200.0, 0.0, 0.0, 1.0], [-0.1, 0.02], [0.1 * i, 0.4 * i - 0.8, 0.05], [0.1, -0.2, 5.0])
            for i in range(5)]
    cams = spark.createDataFrame(cams, "session string, view string, cam_idx long, k array<double>, dist array<double>, rvec array<double>, tvec array<double>")
    rng = np.random.default_rng(3)
    pts = [("s", f, k, *map(float, rng.uniform(-1, 1, 3))) for f in range(20) for k in ("a", "b")]
    pts = spark.createDataFrame(pts, "session string, frame long, keypoint string, X double, Y double, Z double")
    obs = G.project(pts, cams).select("session", "frame", "keypoint", "view", F.col("px").alias("x"), F.col("py").alias("y"))
    return cams, pts, obs


def test_rotation_matrices_are_rotations(rig):
    for r in G.prepared(rig[0]).collect():
        m = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


@pytest.mark.parametrize("how", [G.triangulate, G.triangulate_pairs])
def test_projected_points_come_back(rig, how):
    cams, pts, obs = rig
    got = how(obs, cams).toPandas().merge(pts.toPandas(), on=["session", "frame", "keypoint"])
    for c in "XYZ":
        assert np.abs(got[f"{c}_x"] - got[f"{c}_y"]).max() < 1e-6


def test_points_need_two_views(rig):
    cams, _, obs = rig
    assert G.triangulate(obs.where("view = 'v1'"), cams).count() == 0
    few = obs.withColumn("x", F.when((F.col("frame") > 4) | (F.col("view") < "v2"), F.col("x")))
    assert G.triangulate(few, cams).where("n_views = 2").count() == 10


def test_held_out_views_of_exact_points_have_no_error(rig):
    cams, _, obs = rig
    errors = G.leave_one_out(obs, cams).toPandas()
    assert len(errors) == 200 and errors["error"].max() < 1e-4


def test_alignment_is_a_rotation_that_never_hurts(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = a @ q.T + rng.normal(scale=0.01, size=a.shape)
    rows = [(m, "s", i, *map(float, v), *map(float, v)) for m, x in (("a", a), ("b", b)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "model string, session string, frame long, fx double, fy double, fz double, lx double, ly double, lz double")
    r = np.array(B.best_rotations(df, "b").first()["rotation"]).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    done = B.align_to_reference(df, "b").where("model = 'a'").orderBy("frame").select("fx", "fy", "fz").toPandas().to_numpy()
    assert np.linalg.norm(done - b) < 0.2 < np.linalg.norm(a - b)


def test_angles_of_a_missing_head_are_unknown(spark):
    rows = [("m", "s", f, k, None if f else float(i), 1.0 * i * i, 0.5 * i) for f in range(2)
            for i, k in enumerate(["topBeak", "botBeak", "leftEye", "rightEye"])]
    df = spark.createDataFrame(rows, "model string, session string, frame long, keypoint string, X double, Y double, Z double")
    got = {r.frame: r for r in B.angles(B.head_vectors(df)).collect()}
    assert got[0].yaw is not None and got[1].yaw is None and got[1].roll is None


def test_pitch_of_a_missing_head_is_unknown(spark):
    df = spark.createDataFrame([("m", "s", 0, *[None] * 6)], "model string, session string, frame long, fx double, fy double,"
                                                            " fz double, lx double, ly double, lz double")
    row = B.angles(df).first()
    assert row.yaw is None and row.pitch is None and row.roll is None


# Latent models and smoothing.

@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.default_rng(7)
    w = rng.normal(size=(8, 3))
    x = rng.normal(size=(60, 3)) @ w.T + 5 + rng.normal(scale=0.05, size=(60, 8))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[7], x[8, 2:] = np.nan, np.nan
    v = rng.uniform(0.1, 1, x.shape)
    rows = [("s", i, [None if np.isnan(q) else float(q) for q in r], [float(q) for q in u]) for i, (r, u) in enumerate(zip(x, v))]
    return spark.createDataFrame(rows, "session string, frame long, v array<double>, var array<double>"), x, v


def test_fit_and_partial_transform(views):
    df, x, _ = views
    model = M.fit_pca(df, "v", 8, 3, missing=True)
    w, mu = model.loading, model.mu
    assert np.allclose(w.T @ w, np.eye(3)) and np.allclose(mu, np.nanmean(x, axis=0))
    got = M.nan_latent_transform(df, "v", model).orderBy("frame").toPandas()["z"]
    for z, row in zip(got, x):
        there = ~np.isnan(row)
        want = np.linalg.lstsq(w[there], (row - mu)[there], rcond=None)[0] if there.sum() >= 3 else np.zeros(3)
        assert np.allclose(z, want, atol=1e-6)


def test_share_kept_grows_with_rank(views):
    df, x, _ = views
    model = M.fit_pca(df, "v", 8)
    out = M.frame_vaf(df, "v", model, (1, 3, 8)).dropna(subset=["vaf_1"]).toPandas()
    assert len(out) == (~np.isnan(x).any(axis=1)).sum()
    assert (out.vaf_1 <= out.vaf_3 + 1e-9).all() and (out.vaf_1 >= -1e-9).all() and np.allclose(out.vaf_8, 1)


def test_spectrum_matches_svd(views):
    df, x, _ = views
    full = x[~np.isnan(x).any(axis=1)]
    s = np.linalg.svd(full - full.mean(axis=0), compute_uv=False)
    got = M.singular_spectrum(df, "v", 8).orderBy("component").toPandas()
    assert np.allclose(got["singular_value"], s) and got["cumulative"].iloc[-1] == pytest.approx(100)
    share = np.cumsum(s ** 2) / (s ** 2).sum() * 100
    assert got["needed_95"].iloc[0] == np.argmax(share >= 95) + 1


def test_weighted_transform_and_distance(views):
    df, x, v = views
    model = M.fit_pca(df, "v", 8, 3, missing=True)
    w, mu = model.loading, model.mu
    got = M.mahalanobis(df, "v", "var", model, ["a", "b", "c", "d"], ["frame"]).toPandas().set_index(["frame", "view"])
    for i, (row, var) in enumerate(zip(x, v)):
        if np.isnan(row).any():
            assert np.isnan(got.loc[(i, "a"), "mahalanobis"])
            continue
        inv = np.diag(1 / (var + 1e-6))
        b = np.linalg.inv(w.T @ inv @ w)
        back = w @ b @ w.T @ inv @ (row - mu) + mu
        for k, view in enumerate("abcd"):
            r = (row - back)[2 * k:2 * k + 2]
            cov = np.diag(var[2 * k:2 * k + 2] + 1e-6) + (w @ b @ w.T)[2 * k:2 * k + 2, 2 * k:2 * k + 2]
            assert got.loc[(i, view), "mahalanobis"] == pytest.approx(np.sqrt(r @ np.linalg.inv(cov) @ r))


def walk_directly(j, h, s, prior):
    """Smoothed means and covariances from the joint normal of the whole track."""
    n, size = h.shape
    p = np.zeros((n * size, n * size))
    for t in range(n):
        a = slice(t * size, (t + 1) * size)
        p[a, a] += j[t]
        if t == 0:
            p[a, a] += np.eye(size) / (prior + s)
        else:
            b = slice((t - 1) * size, t * size)
            p[a, a] += np.eye(size) / s
            p[b, b] += np.eye(size) / s
            p[a, b] -= np.eye(size) / s
            p[b, a] -= np.eye(size) / s
    cov = np.linalg.inv(p)
    mean = (cov @ h.ravel()).reshape(n, size)
    return mean, np.stack([cov[t * size:(t + 1) * size, t * size:(t + 1) * size] for t in range(n)])


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("step", [2, 5, 64])
def test_smoothing_in_ranges_equals_one_pass(spark, size, step, monkeypatch):
    monkeypatch.setattr(Z, "RANGE", step)
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for track, n in (("a", 45), ("b", 9)):
        j = np.stack([q @ q.T for q in rng.normal(size=(n, size, size))])
        j[rng.random(n) < 0.3] = 0
        h = np.einsum("tij,tj->ti", j, rng.normal(size=(n, size)))
        frames = np.sort(rng.choice(3 * n, n, replace=False))
        want[track] = walk_directly(j, h, 0.7, 50.0)
        rows += [(track, int(f), [float(q) for q in a.ravel()], [float(q) for q in b]) for f, a, b in zip(frames, j, h)]
    df = spark.createDataFrame(rows, "track string, frame long, J array<double>, h array<double>").repartition(5)
    got = Z.smooth_information(df, ["track"], size, 0.7, 50.0).toPandas().sort_values(["track", "frame"])
    for track, (mean, cov) in want.items():
        part = got[got.track == track]
        assert np.allclose(part[[f"mean_{i}" for i in range(size)]], mean, atol=1e-7)
        assert np.allclose(part[[f"cov_{i}" for i in range(size * size)]].to_numpy().reshape(-1, size, size), cov, atol=1e-7)


def test_smoothing_views_fills_a_hidden_view(spark, views):
    df, x, _ = views
    model = M.fit_pca(df, "v", 8, 3, missing=True)
    names = ["a", "b", "c", "d"]
    rows = [("s", "k", i, v, None if np.isnan(r[2 * k]) else float(r[2 * k]), None if np.isnan(r[2 * k + 1]) else float(r[2 * k + 1]), 0.01, 0.01)
            for i, r in enumerate(x) for k, v in enumerate(names)]
    ens = spark.createDataFrame(rows, "session string, keypoint string, frame long, view string, x double, y double, x_ens_var double, y_ens_var double")
    out = Z.smooth_multi_view(ens, model, names, 1e4).toPandas().set_index(["frame", "view"])
    assert len(out) == 240 and out[["x", "y"]].notna().all().all()
    assert np.allclose(out.xs("b", level="view")["x"][:5], x[:5, 2], atol=0.5, equal_nan=True) or np.isnan(x[:5, 2]).any()
    seen, hidden = out.loc[(0, "a"), "x_posterior_var"], out.loc[(7, "a"), "x_posterior_var"]
    assert hidden > 100 * seen


# Clusters.

def test_clusters_beat_the_start(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(scale=10, size=(4, 3))
    pts = np.concatenate([c + rng.normal(scale=0.3, size=(30, 3)) for c in centres])
    df = spark.createDataFrame([("s" if i % 3 else "t", i, [float(q) for q in p]) for i, p in enumerate(pts)],
                               "session string, frame long, v array<double>")
    found, _, cost = C.kmeans(df, 4, 1)
    assert found.select("cluster").distinct().count() == 4 and cost < 200
    picked = C.kmeans_select(df, 4, 1, ["session", "frame"])
    assert picked.agg(F.sum("cluster_size")).first()[0] == 120 and picked.count() == 4
    even = C.kmeans_per_session(df, 8, 1).groupBy("session").count().collect()
    assert {r["session"] for r in even} == {"s", "t"} and all(r["count"] <= 4 for r in even)


def test_sessions_with_few_poses_give_all(spark):
    df = spark.createDataFrame([("s", i, [float(i)]) for i in range(3)] + [("t", i, [float(i % 7)]) for i in range(40)],
                               "session string, frame long, v array<double>")
    got = C.kmeans_per_session(df, 10, 0)
    assert sorted(r.frame for r in got.where("session = 's'").collect()) == [0, 1, 2]


def test_quotas_give_the_rest_to_the_first(spark):
    df = spark.createDataFrame([(s, i) for s in "cab" for i in range(9)], "session string, frame long")
    assert {r.session: r.quota for r in P.quotas(df, 8).collect()} == {"a": 3, "b": 3, "c": 2}
    assert P.balanced(df, 8, [F.col("frame")]).count() == 8


# Cases of the review.

def test_a_view_counts_once_in_the_likelihood_filter(spark):
    rows = [("s", f, v, "k", seed, 0.9 if v == "v0" else low) for f, low in ((0, 0.1), (1, 0.95)) for v in ("v0", "v1") for seed in (0, 1)]
    rows += [("s", 2, v, "k", 0, 0.95) for v in ("v0", "v1")]
    pred = spark.createDataFrame(rows, "session string, frame long, view string, keypoint string, seed long, likelihood double")
    assert sorted(r.frame for r in E.confident_frames(pred, 0.5, 2).collect()) == [1, 2]


def test_grid_values_without_points_compete(spark):
    rows = [("m", "v", 0.5, 1.0)] * 80 + [("m", "v", 1.5, 1.0)] * 20
    df = spark.createDataFrame(rows, "model string, view string, ens_std double, error double")
    swept = V.threshold_sweep(df, [0.0, 1.0, 2.0, 3.0], ["model"]).orderBy("threshold").collect()
    assert [(r.n_points, r.mean_error) for r in swept] == [(100, 1.0), (20, 1.0), (0, None), (0, None)]
    best = V.sweep_percentiles(df, [0.0, 1.0, 2.0, 3.0], [5, 20]).collect()
    assert {r.share: r.threshold for r in best} == {5.0: 2.0, 20.0: 1.0}


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",nose,tail,set\nimg1,3,4,train\n")
    (tmp_path / "b.csv").write_text(',tail,"nose"\n"img,2",3,4\n')
    from trackloom.sources.markers import read_pixel_errors

    got = {(r["index"], r.keypoint): (r.error, r.set) for r in read_pixel_errors(spark, str(tmp_path), ["nose", "tail"]).collect()}
    assert got == {("img1", "nose"): (3.0, "train"), ("img1", "tail"): (4.0, "train"), ("img,2", "nose"): (4.0, None), ("img,2", "tail"): (3.0, None)}


def test_labelled_frames_are_png(spark):
    df = spark.createDataFrame([("labeled-data/s_L/img00000007.png",), ("labeled-data/s_L/img00000007.jpg",)], "p string")
    assert [r.i and tuple(r.i) for r in df.select(N.labelled_frame(F.col("p"), ["L"]).alias("i")).collect()] == [("s", 7), None]


def test_equal_poses_still_fill_the_share(spark):
    df = spark.createDataFrame([("s", i, [float(i % 3)]) for i in range(50)] + [("t", i, [float(i)]) for i in range(50)],
                               "session string, frame long, v array<double>")
    got = C.kmeans_per_session(df, 60, 3).collect()
    assert len({(r["session"], r.frame) for r in got}) == len(got) == 60


def test_checked_join_raises(spark):
    lab = spark.createDataFrame([("s", "v", 1, "k"), ("s", "v", 2, "k")], "session string, view string, frame long, keypoint string")
    with pytest.raises(ValueError):
        J.labels_with_predictions(lab, lab.where("frame = 1"), checked=True)
    assert J.labels_with_predictions(lab, lab, checked=True).count() == 2


def test_pairs_of_models_without_a_match_have_zero(spark):
    ev = spark.createDataFrame([("s", "a", 10), ("s", "b", 100)], "session string, model string, onset long")
    assert {(r.model, r.other): r.matched for r in B.saccade_agreement(ev).collect()} == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 0, ("b", "b"): 1}


def test_distortion_without_inverse_gives_null(spark, sf):
    from trackloom.catalog import fixtures as X
    from trackloom.catalog.geometry import noise_free

    mild, strong = (G.undistort(noise_free(spark, sf), X.cameras(spark, sf, bend)).where("x is not null") for bend in ((-0.05, 0.01), (-40.0, 0.0)))
    assert mild.where("ux is null").count() == 0
    left = strong.where("ux is not null")
    assert strong.where("ux is null").count() > 0
    back = F.abs(F.col("ux") * (1 - 40.0 * (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))) * F.col("fx") + F.col("cx") - F.col("x"))
    assert (left.agg(F.max(back)).first()[0] or 0.0) < 0.1
