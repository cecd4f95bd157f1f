"""What reaches the driver and the shuffle as the tables grow."""

import gzip

import numpy as np
import pytest

from pyspark.sql import functions as F

from trackloom.catalog import entries, fixtures as X
from trackloom.functions.space import prefer_full_space, remap_guarded
from trackloom.operators import geometry as G, latent as M, ordered as O, smooth as S
from trackloom.operators.joins import labelled_only
from trackloom.session import scope
from trackloom.sources import markers as K

ALL = entries()


def broadcast_parts(df) -> list[str]:
    """The plan below each broadcast, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.parametrize("name", ["confident_view_errors", "reprojection_error", "prefer_full_space", "valid_observations", "smooth_through_cameras",
                                  "labels_with_predictions", "pixel_error", "error_by_model_seed", "reprojection_score", "method_errors",
                                  "error_table", "crop_to_full", "remap_guarded", "triangulation_error"])
def test_rows_of_frames_are_not_broadcast(spark, sf, name):
    """Tables that explode or a task made have more rows than the files behind them tell."""
    with scope(spark):
        for part in broadcast_parts(ALL[name].build(spark, sf)):
            assert "Generate" not in part and "InPandas" not in part


def test_labelled_frames_are_told_by_bits(spark):
    frames = [-1, 0, 6, 7, 8, 9, 32767, 32768, 32769, 5_000_000_000]
    pred = spark.createDataFrame([(s, f, k) for s in ("a", "b", None) for f in [*frames, None] for k in (1, 2)], "session string, frame long, k int")
    lab = spark.createDataFrame([("a", f) for f in frames[::2]] * 2 + [("b", 7), (None, 7), ("b", None)], "session string, frame long")
    with scope(spark):
        few = labelled_only(pred, lab)
        assert few.columns == pred.columns
        got = sorted((r.session, r.frame, r.k) for r in few.collect())
    assert got == sorted([("a", f, k) for f in frames[::2] for k in (1, 2)] + [("b", 7, 1), ("b", 7, 2)])


def test_predictions_are_not_shuffled_to_ask_for_labels(spark, sf):
    with scope(spark):
        plan = ALL["labels_with_predictions"].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") == 1


def test_views_are_gathered_by_one_narrow_shuffle(spark, sf):
    """The ten sums of an observation are made after the shuffle."""
    with scope(spark):
        plan = ALL["leave_one_view_out_error"].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    head, _, below = plan.partition("REPARTITION_BY_COL")
    assert " AS s9#" in head and " AS s9#" not in below and "collect_list" in head


def test_snippets_are_packed_and_have_their_own_header(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 4)
    df = spark.createDataFrame([(s, f, "a", f + 0.5, None) for s in ("s", "t") for f in range(10)], "session string, frame long, keypoint string, x double, y double")
    K.write_markers(df, str(tmp_path / "tracks"), ["a"], ["x", "y"], ["session"])
    files = sorted((tmp_path / "tracks").rglob("part-*"))
    assert len(files) == 6 and all(f.name.endswith(".txt.gz") for f in files)
    for f in files:
        lines = gzip.open(f, "rt").read().splitlines()
        part = int(f.parent.name.removeprefix("part="))
        assert lines[:3] == ["scorer,trackloom,trackloom", "bodyparts,a,a", "coords,x,y"]
        assert lines[3:] == [f"{n},{n}.5," for n in range(4 * part, min(4 * part + 4, 10))]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distortion_is_inverted_once_a_row(spark, sf):
    seen = X.predictions(spark, sf).select("session", "view", "frame", "keypoint", "x", "y")
    with scope(spark):
        assert plan_of(G.undistort(seen, X.cameras(spark, sf, (-0.05, 0.01))).where("ux is not null")).count("aggregate(") == 1


def test_tasks_get_no_more_of_a_larger_table(spark, sf, monkeypatch):
    whole = X.table(spark, sf, "orders")
    monkeypatch.setattr(X, "SPLIT", 1024)
    cut = X.table(spark, sf, "orders")
    assert cut.rdd.getNumPartitions() > 2 * whole.rdd.getNumPartitions()
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


def test_components_are_fitted_in_one_pass(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 4)) @ draw.normal(size=(4, 4)) + [1e4, -5, 0, 300]
    x[draw.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in row],) for row in x], "v array<double>").repartition(7).localCheckpoint()
    spark.sparkContext.setJobGroup("one pass", "fit")
    model = M.fit_pca(df, "v", 4, missing=True)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one pass")) == 1
    there, off = np.isfinite(x).astype(float), np.nan_to_num(x - np.nanmean(x, axis=0))
    cov = off.T @ off / (there.T @ there - 1)
    assert np.allclose(model.mean, np.nanmean(x, axis=0), rtol=1e-12) and np.allclose(model.variance, np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None))


def test_tracks_are_shuffled_without_arrays(spark):
    ens = spark.range(9).selectExpr("'s' AS session", "'v' AS view", "'k' AS keypoint", "id AS frame", "id * 1D AS x", "id * 2D AS y",
                                    "1D AS x_ens_var", "1D AS y_ens_var")
    plan = plan_of(S.smooth_single_view(ens, 1.0))
    assert "struct(frame, frame" in plan and "_J00" in plan and "flatten(_o#" not in plan


def test_seeds_are_combined_once(spark, sf):
    with scope(spark):
        assert "o_orderkey" not in plan_of(ALL["smooth_tuned_single_view"].build(spark, sf))


@pytest.mark.parametrize("name, others", [("valid_observations", 1), ("prefer_full_space", 1), ("triangulate_valid", 0), ("pose_from_views", 1),
                                          ("leave_one_view_out_error", 3)])
def test_frames_are_shuffled_once_for_all_steps(spark, sf, name, others):
    """Windows, joins and groups on more keys find their rows where ``together`` put them: only groups of fewer keys are shuffled again."""
    with scope(spark):
        plan = plan_of(ALL[name].build(spark, sf))
    assert plan.count("REPARTITION_BY_COL") >= 1 and plan.count("ENSURE_REQUIREMENTS") == others


def test_steps_in_place_keep_rows_with_repeated_and_null_keys(spark):
    rows = [(s, "v", f, k, n, float(i), None if i % 5 == 0 else 1.0) for i, (s, f, k, n) in enumerate(
        [(s, f, k, n) for s in ("a", "b", None) for f in (1, 2, None) for k in ("p", "q", None) for n in (0, 1)] * 2)]
    df = spark.createDataFrame(rows, "session string, view string, frame long, keypoint string, seed long, x double, y double")
    keys = ["seed", "session", "view", "frame", "keypoint"]
    box = df.select("session", "view", "frame").distinct().where("session <> 'b'").selectExpr("*", "1D AS box_x", "2D AS box_y", "3D AS box_w", "4D AS box_h")
    u = df.where("x < 40").withColumn("x", F.col("x") + 0.5)
    got = sorted(map(str, prefer_full_space(df, u, box, keys).collect()))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    plain = u.select(*keys, F.col("x").alias("ux"), F.col("y").alias("uy"), F.lit(True).alias("_u"))
    both = remap_guarded(df.join(plain, keys, "left").join(box, ["session", "view", "frame"], "left"))
    taken = F.col("_u").isNotNull() & F.col("box_x").isNotNull()
    want = both.withColumns({"x": F.when(taken, F.col("ux")).otherwise(F.col("x")), "y": F.when(taken, F.col("uy")).otherwise(F.col("y"))}).select(*df.columns)
    assert got == sorted(map(str, want.collect()))


def test_frames_of_held_out_views_are_counted_by_bits(spark):
    rows = [(n, s, f, v, k, float(i)) for i, (n, s, f, v, k) in enumerate((n, s, f, v, k) for n in (0, 1) for s in ("a", "b", None)
            for f in (-3, 0, 5, 32768, 32769, 10**9, None) for v in ("v0", "v1") for k in ("nose", "paw") if (n, s) != (1, "b"))]
    df = spark.createDataFrame(rows, "seed long, session string, frame long, view string, keypoint string, error double")
    got = {r.seed: (r.head_px, r.all_px, r.n_frames) for r in G.leave_one_out_summary(df, ["nose"], ["seed"]).collect()}
    one = df.toPandas()
    for seed, part in one.groupby("seed"):
        means = part.groupby(["session", "frame", "view"], dropna=False).agg(a=("error", "mean"))
        heads = part[part.keypoint == "nose"].groupby(["session", "frame", "view"], dropna=False).agg(a=("error", "mean"))
        assert np.allclose(got[seed][:2], (heads.a.mean(), means.a.mean()))
        assert got[seed][2] == (12 if seed == 0 else 6)
    assert G.leave_one_out_summary(df.where("1 = 0"), ["nose"]).collect()[0].n_frames == 0


def test_tracks_are_shuffled_once_for_ensemble_and_smoother(spark, sf):
    with scope(spark):
        for name in ("smooth_single_view", "smoothing_likelihood", "smoothing_choice"):
            plan = plan_of(ALL[name].build(spark, sf))
            scans = plan.count("Scan parquet")
            assert plan.count("REPARTITION_BY_COL") >= 1 and scans == plan.count("REPARTITION_BY_COL")
            assert "partial_avg" not in plan.split("REPARTITION_BY_COL")[1].split("Scan parquet")[0]


def test_neighbours_are_shuffled_without_structs(spark):
    df = spark.createDataFrame([("a", f, float(f * f) if f % 3 else None) for f in range(10)], "k string, frame long, x double")
    out = O.neighbours(df, ["k"], "frame", ["x"], ahead=True, chunk=4)
    below = plan_of(out).split("Exchange")[-1]
    assert "struct" not in below
    at = lambda f: (float(f * f) if f % 3 else None) if 0 <= f < 10 else None
    for r in out.collect():
        assert (r.has_prev, r.prev_x, r.has_next, r.next_x) == (r.frame > 0, at(r.frame - 1), r.frame < 9, at(r.frame + 1))


def test_points_are_shuffled_before_their_sums_are_made(spark, sf):
    """After an ensemble, the views of a point come from many tasks: ten sums of each would be shuffled."""
    with scope(spark):
        for name in ("triangulate", "triangulate_bent"):
            head, _, below = plan_of(ALL[name].build(spark, sf)).partition("REPARTITION_BY_COL")
            assert "partial_sum(s9" not in below.split("Scan")[0]


def test_projection_is_not_repeated_in_filters(spark, sf):
    with scope(spark):
        plan = G.project(X.world(spark, sf), X.cameras(spark, sf, (-0.05, 0.01))).where("px is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull((" not in plan and all("r00" not in line for line in plan.split("\n") if line.strip(" :+-").startswith("Filter"))


def test_keypoints_of_a_frame_move_together(spark, sf):
    with scope(spark):
        plan = plan_of(ALL["motion_energy"].build(spark, sf))
    assert plan.count("REPARTITION_BY_COL") == 2 and "_w0" not in plan.split("REPARTITION_BY_COL")[1]  # read for the ranges and for their ends


def test_index_of_a_snippet_is_not_shuffled_twice(spark, tmp_path):
    df = spark.createDataFrame([("s", f, k, f + 0.5) for f in (3, 1, 2) for k in ("a", "b")], "session string, frame long, keypoint string, x double")
    K.write_markers(df, str(tmp_path / "t"), ["a", "b"], ["x"], ["session"])
    (file,) = (tmp_path / "t").rglob("part-*")
    assert gzip.open(file, "rt").read().splitlines()[3:] == ["1,1.5,1.5", "2,2.5,2.5", "3,3.5,3.5"]


def test_ingested_rows_are_not_shuffled_by_session(spark, sf):
    with scope(spark):
        plan = plan_of(ALL["ingest_new_predictions"].build(spark, sf))
    assert "SortMergeJoin" not in plan and "LeftSemi, BuildRight" in plan
