"""Whole jobs with their options."""

import pytest
from pyspark.sql import functions as F

from trackloom.catalog import fixtures as X
from trackloom.plans import distill, score


@pytest.fixture(scope="module")
def inputs(spark, sf):
    whole = X.boxes(spark, sf).select("session", "view", "frame", *[
        F.lit(v).alias(f"box_{c}") for c, v in zip("xywh", (0.0, 0.0, 320.0, 320.0))])
    return X.predictions(spark, sf), whole, X.labels(spark, sf), X.cameras(spark, sf)


def settings(**more):
    return distill.Settings(**{"views": X.VIEWS, "keypoints": X.KEYPOINTS, "frames_per_video": 30, "min_frames": 5, "clusters": 14,
                               "threshold": 0.5, "seed": 1, "seeds": X.SEEDS, **more})


@pytest.mark.parametrize("more, cameras", [({}, True), ({"method": "random"}, False), ({"per_session": True}, True)])
def test_pseudo_labels(inputs, more, cameras):
    pred, boxes, labels, cams = inputs
    kept, made = distill.pseudo_labels(pred, boxes, labels, cams if cameras else None, settings(**more))
    taken = {(r.session, r.frame) for r in kept.collect()}
    assert 7 <= len(taken) <= 14
    assert taken.isdisjoint({(r.session, r.frame) for r in labels.select("session", "frame").distinct().collect()})
    rows = made.collect()
    assert {(r.session, r.frame) for r in rows} == taken and len(rows) == 12 * len(taken)
    if cameras:  # reprojected labels stay close to the true points
        true = X.seen(pred.sparkSession, "/root/testdata/sf0.001").select("session", "view", "frame", "keypoint", "u", "w")
        far = made.join(true, ["session", "view", "frame", "keypoint"]).agg(F.max(F.abs(F.col("lx") - F.col("u")))).first()[0]
        assert far < 3
    both = distill.training_set(labels, made)
    assert both.count() == labels.count() + made.count()


def test_smoothed_tracks_choose_from_the_same_frames(inputs):
    pred, _, labels, _ = inputs
    plain = {(r.session, r.frame) for r in distill.candidates(pred, labels, settings(frames_per_video=1000)).collect()}
    chosen = {(r.session, r.frame) for r in distill.candidates(pred, labels, settings(frames_per_video=10, process_variance=25.0)).collect()}
    assert chosen and len(chosen) <= 10 * 7 and not chosen & {(r.session, r.frame) for r in labels.select("session", "frame").distinct().collect()}
    assert plain


def test_unknown_method(inputs):
    with pytest.raises(ValueError):
        distill.candidates(inputs[0], inputs[2], settings(method="best"))


def test_combining_seeds_lowers_the_error(inputs):
    table = {r.method: r["mean"] for r in score.method_errors(inputs[0], inputs[2], seeds=X.SEEDS).collect()}
    assert table["ensemble_mean"] < min(v for k, v in table.items() if k.startswith("seed_"))
