"""Crop and full-image coordinates as Column expressions.

A box is ``box_x, box_y, box_w, box_h`` in full-image pixels; a crop is scaled to ``width`` x ``height``. x goes with box_w, y with box_h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.schema import finite
from trackloom.session import many_rows, together

SIDE = 320  # fixed value: default width and height of a crop


def to_full(v: Column, offset: Column, extent: Column, side: int | None = SIDE) -> Column:
    """Crop pixel → full-image pixel; unscaled when ``side`` is None."""
    return (v / F.lit(float(side)) * extent if side else v) + offset


def to_crop(v: Column, offset: Column, extent: Column, side: int | None = SIDE) -> Column:
    """Full-image pixel → crop pixel; NULL for a box of size zero."""
    moved = v - offset
    return finite(moved / F.nullif(extent, F.lit(0.0)) * F.lit(float(side))) if side else moved


def valid_box() -> Column:
    ok = (F.col("box_w") > 0) & (F.col("box_h") > 0)
    for c in ("box_x", "box_y", "box_w", "box_h"):
        ok = ok & finite(F.col(c)).isNotNull()
    return F.coalesce(ok, F.lit(False))


def crop_to_full(df: DataFrame, width: int | None = SIDE, height: int | None = SIDE) -> DataFrame:
    return df.withColumns({"x": to_full(F.col("x"), F.col("box_x"), F.col("box_w"), width),
                           "y": to_full(F.col("y"), F.col("box_y"), F.col("box_h"), height)})


def full_to_crop(df: DataFrame, width: int | None = SIDE, height: int | None = SIDE) -> DataFrame:
    return df.withColumns({"x": to_crop(F.col("x"), F.col("box_x"), F.col("box_w"), width),
                           "y": to_crop(F.col("y"), F.col("box_y"), F.col("box_h"), height)})


def remap_guarded(df: DataFrame, width: int = SIDE, height: int = SIDE) -> DataFrame:
    """To full-image pixels; points stay as they are where the box is missing or unusable."""
    ok = valid_box()
    return df.withColumns({
        "x": F.when(ok, to_full(F.col("x"), F.col("box_x"), F.col("box_w"), width)).otherwise(F.col("x")),
        "y": F.when(ok, to_full(F.col("y"), F.col("box_y"), F.col("box_h"), height)).otherwise(F.col("y"))})


def crop_or_null(df: DataFrame, width: int = SIDE, height: int = SIDE) -> DataFrame:
    """To crop pixels; NULL where the box is missing or unusable."""
    ok = valid_box()
    return df.withColumns({"x": F.when(ok, to_crop(F.col("x"), F.col("box_x"), F.col("box_w"), width)),
                           "y": F.when(ok, to_crop(F.col("y"), F.col("box_y"), F.col("box_h"), height))})


def crop_labels(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Labels ``lx, ly`` to crop pixels of ``size`` (width, height); NULL for a box of size zero."""
    return df.withColumns({"lx": to_crop(F.col("lx"), F.col("box_x"), F.col("box_w"), size[0]),
                           "ly": to_crop(F.col("ly"), F.col("box_y"), F.col("box_h"), size[1])})


def prefer_full_space(cropped: DataFrame, uncropped: DataFrame, boxes: DataFrame, keys: list[str],
                      width: int = SIDE, height: int = SIDE) -> DataFrame:
    """x, y in full-image pixels: the uncropped track where it and a box exist, else the crop remapped."""
    one = ["session", "view", "frame"]
    u = uncropped.select(*keys, F.col("x").alias("ux"), F.col("y").alias("uy"))
    at = one if set(one) <= set(keys) else keys
    both = together(cropped, at).join(many_rows(together(u, at).withColumn("_u", F.lit(True))), keys, "left").join(many_rows(together(boxes, one)), one, "left")
    mapped = remap_guarded(both, width, height)
    taken = F.col("_u").isNotNull() & F.col("box_x").isNotNull()
    return mapped.withColumns({"x": F.when(taken, F.col("ux")).otherwise(F.col("x")),
                               "y": F.when(taken, F.col("uy")).otherwise(F.col("y"))}).select(*cropped.columns)


def prefer_median(df: DataFrame) -> DataFrame:
    """x, y from the seed median where there is one."""
    return df.withColumns({"x": F.coalesce("x_ens_median", "x"), "y": F.coalesce("y_ens_median", "y")})


def boxes_from_keypoints(df: DataFrame, scales: DataFrame, half_size: float, fallback: DataFrame | None = None
                         ) -> DataFrame:
    """Square boxes around the keypoint centroid: corners truncated toward zero.

    ``scales`` holds session, view, frame, scale; ``fallback`` (session, frame, use_frame) names the frame whose
    centroid and scale serve a frame without any keypoint.
    """
    key = ["session", "view", "frame"]
    centre = df.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).join(scales, key, "left")
    if fallback is not None:
        other = centre.select("session", "view", F.col("frame").alias("use_frame"), F.col("cx").alias("fx"),
                              F.col("cy").alias("fy"), F.col("scale").alias("fs"))
        centre = centre.join(fallback, ["session", "frame"], "left").join(other, ["session", "view", "use_frame"], "left")
        gone = F.col("cx").isNull() & F.col("cy").isNull()
        centre = centre.select(*key, F.when(gone, F.col("fx")).otherwise(F.col("cx")).alias("cx"),
                               F.when(gone, F.col("fy")).otherwise(F.col("cy")).alias("cy"),
                               F.when(gone, F.col("fs")).otherwise(F.col("scale")).alias("scale"))
    reach = F.lit(float(half_size)) * F.col("scale")

    def corner(c: str, sign: int) -> Column:
        return (F.col(c) + F.lit(float(sign)) * reach).cast("bigint")

    return centre.select(*key, corner("cx", -1).alias("box_x"), corner("cy", -1).alias("box_y"),
                         (corner("cx", 1) - corner("cx", -1)).alias("box_w"),
                         (corner("cy", 1) - corner("cy", -1)).alias("box_h"))


def valid_observations(df: DataFrame, n_keypoints: int, mode: str = "all",
                       keys: tuple[str, ...] = ("session", "frame", "view")) -> DataFrame:
    """x, y become NULL in a view and frame whose keypoints are not all ("all") or not mostly ("most") present, or in the
    whole frame if any view of it misses one ("frame")."""
    n = F.count(F.col("x") + F.col("y")).over(Window.partitionBy(*keys))
    if mode == "all":
        ok = n == n_keypoints
    elif mode == "most":
        ok = n > n_keypoints / 2
    elif mode == "frame":
        df = df.withColumn("_n", n)
        ok = F.min("_n").over(Window.partitionBy(*[k for k in keys if k != "view"])) == n_keypoints
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.withColumn("_ok", ok).withColumns(
        {"x": F.when(F.col("_ok"), F.col("x")), "y": F.when(F.col("_ok"), F.col("y"))}).drop("_ok", "_n")
