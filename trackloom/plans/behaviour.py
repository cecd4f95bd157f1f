"""From 2-D predictions to named pose clusters, and from 3-D heads to saccades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackloom.operators import behaviour as B
from trackloom.operators import cluster as C
from trackloom.operators.geometry import triangulate
from trackloom.operators.joins import common_frames
from trackloom.operators.tracks import minmax_normalise
from trackloom.session import materialised


def pose_clusters(pred: DataFrame, cameras: DataFrame, clusters: int, seed: int, dt: float = 1 / 60,
                  n_keypoints: int | None = None) -> DataFrame:
    """model, session, frame, the pose features, cluster and its name. With ``n_keypoints``, frames in which a view misses
    any of its keypoints are left out whole. The points are written once, as their range is needed first."""
    points = triangulate(pred, cameras, ["model", "session", "frame", "keypoint"], validity="frame" if n_keypoints else None,
                         n_keypoints=n_keypoints)
    points = materialised(points, "points")
    table = B.pose_features(minmax_normalise(points), dt)
    table = materialised(table.dropna(subset=list(B.FEATURES)), "features")
    found = C.pose_hierarchy(table.withColumn("v", F.array(*B.FEATURES)), clusters, seed).drop("v")
    return found.join(C.name_clusters(found, B.FEATURES), "cluster")


def head_saccades(points: DataFrame, reference: str, dt: float, n_models: int, tolerance: int = 3
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Angles of all models in the frame of the reference, saccades of the yaw, and their share in the consensus."""
    vectors = B.align_to_reference(materialised(B.head_vectors(points), "head-vectors"), reference)
    traces = materialised(B.align_yaw(B.angles(vectors), reference), "angles")
    events = materialised(B.detect_saccades(traces, dt), "saccades")
    return traces, events, B.consensus_share(events, B.saccade_consensus(events, n_models, tolerance), tolerance)


def aligned_models(points: DataFrame, models: Sequence[str]) -> DataFrame:
    """Points of the frames that all models have."""
    return common_frames(points.where(F.col("model").isin(*models)), "model", len(models))
