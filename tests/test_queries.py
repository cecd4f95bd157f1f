"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

from check import compare
from trackloom.session import scope, shared_dir
from trackloom.catalog import entries

ALL = entries()
# Comparisons of sessions need a hundred values per group, more than the smallest data have.
MAY_BE_EMPTY = {"session_difference", "session_pairs", "axis_consistency", "most_different_sessions"}


@pytest.mark.parametrize("name", [n for n, e in ALL.items() if e.sql])
def test_matches_sql(spark, sf, duck, name):
    with scope(spark):
        got = ALL[name].build(spark, sf).toPandas()
    assert compare(got, duck.execute(ALL[name].sql).df()) == ""
    assert len(got) > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", [n for n, e in ALL.items() if not e.sql])
def test_gives_rows(spark, sf, name):
    with scope(spark):
        assert ALL[name].build(spark, sf).count() > 0


def test_a_job_leaves_its_folder_empty(spark, sf):
    import os

    before = set(os.listdir(shared_dir(spark)))
    with scope(spark) as folder:
        assert ALL["error_table"].build(spark, sf).count() > 0
        assert os.listdir(folder)
    assert set(os.listdir(shared_dir(spark))) == before


# Solvers and file readers run numpy inside tasks; everything else stays in generated code.
IN_PYTHON = {"align_to_reference", "triangulate", "triangulate_bent", "triangulate_pairs", "triangulation_error",
             "triangulate_valid", "reproject_confident", "confident_view_errors", "leave_one_view_out", "leave_one_view_out_error", "pose_from_views",
             "nan_latent_transform", "fa_transform", "mahalanobis", "singular_spectrum", "spectrum_total", "pca_denoise",
             "smooth_static", "smooth_single_view", "smooth_multi_view", "frames_to_label_smoothed", "read_cameras", "head_saccades",
             "smoothing_likelihood", "smoothing_choice", "smooth_tuned_single_view", "smooth_tuned_multi_view", "inflated_variances"}
WRITES = {"kmeans_select", "kmeans_total", "kmeans_per_session", "kmeans_session_counts", "pose_hierarchy", "embed_2d", "pseudo_labels", "pose_clusters", "read_markers",
          "ingest_new_predictions", "read_predictions", "read_labels", "read_boxes", "read_cameras", "read_timings", "read_pixel_errors",
          "factor_fit", "smooth_camera_points", "smooth_through_cameras", "ward_merges", "ward_total", "ward_clusters"}


@pytest.mark.parametrize("name", [n for n in ALL if n not in WRITES])
def test_plan_has_no_loop_join(spark, sf, name):
    plan = ALL[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name not in IN_PYTHON:
        assert "InPandas" not in plan and "EvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = ALL["error_by_model_seed"].build(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    assert "o_totalprice" not in plan


def test_one_scan_for_neighbours(spark, sf):
    """The rows at the borders of time ranges reuse the shuffle of all rows."""
    qe = ALL["velocity"].build(spark, sf)._jdf.queryExecution()
    qe.toRdd().count()
    final = qe.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
