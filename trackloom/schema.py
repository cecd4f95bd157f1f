"""Canonical long-table keys and schemas.

Missing is always NULL: NaN and +-inf become NULL at ingest, so SQL aggregates skip them. Coordinates are pixels in
2-D and scene units in 3-D; frames are zero-based integers; rows are always matched by (session, frame), never by
their position in a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

RUN = ["model", "seed"]
POINT = ["session", "frame", "keypoint"]
OBS = ["session", "view", "frame", "keypoint"]
TRACK = ["session", "view", "keypoint"]

PRED = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("seed", T.LongType()),
    T.StructField("session", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("frame", T.LongType()),
    T.StructField("keypoint", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("likelihood", T.DoubleType()),
])

CAMERA = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("cam_idx", T.LongType()),
    T.StructField("k", T.ArrayType(T.DoubleType())),
    T.StructField("dist", T.ArrayType(T.DoubleType())),
    T.StructField("rvec", T.ArrayType(T.DoubleType())),
    T.StructField("tvec", T.ArrayType(T.DoubleType())),
])


def finite(c: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    inf = float("inf")
    return F.when(~F.isnan(c) & (c != inf) & (c != -inf), c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
