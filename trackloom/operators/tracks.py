"""Order-dependent work on tracks: derivatives, snippets, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.operators.ordered import chunked, neighbours, running_total
from trackloom.operators.select import mask_low_likelihood
from trackloom.schema import cols
from trackloom.session import lookup, together


def _drop_helpers(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.drop("has_prev", "has_next", *[f"prev_{v}" for v in values], *[f"next_{v}" for v in values])


def velocity(df: DataFrame, keys: Sequence[str], values: Sequence[str], dt: float, prefix: str = "v_") -> DataFrame:
    """Add the first difference of each value per second; 0 in the first frame, NULL next to a missing value."""
    near = neighbours(df, keys, "frame", values)
    made = {f"{prefix}{v}": F.when(F.col("has_prev"), (F.col(v) - F.col(f"prev_{v}")) / F.lit(dt)).otherwise(F.lit(0.0))
            for v in values}
    return _drop_helpers(near.withColumns(made), values)


def acceleration(df: DataFrame, keys: Sequence[str], values: Sequence[str], dt: float) -> DataFrame:
    """Add velocity (v_*) and its own first difference (a_*)."""
    moved = velocity(df, keys, values, dt)
    speeds = [f"v_{v}" for v in values]
    out = velocity(moved, keys, speeds, dt, prefix="_a_")
    return out.withColumnsRenamed({f"_a_v_{v}": f"a_{v}" for v in values})


def gradient(df: DataFrame, keys: Sequence[str], value: str, dt: float, name: str, keep_next: bool = False) -> DataFrame:
    """Add the central difference of ``value`` per second, one-sided at both ends; NULL for a single frame."""
    near = neighbours(df, keys, "frame", [value], ahead=True)
    here, before, after = F.col(value), F.col(f"prev_{value}"), F.col(f"next_{value}")
    made = (F.when(F.col("has_prev") & F.col("has_next"), (after - before) / (2 * F.lit(dt)))
            .when(F.col("has_next"), (after - here) / F.lit(dt)).when(F.col("has_prev"), (here - before) / F.lit(dt)))
    out = near.withColumn(name, made)
    if keep_next:
        out = out.withColumn(f"after_{value}", F.when(F.col("has_next"), after).otherwise(here))
    return _drop_helpers(out, [value])


def center_frame(snippets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The middle row of each snippet with an odd number of frames; others are skipped.

    ``keys`` name one snippet (and keypoint), some tens of rows.
    """
    w = Window.partitionBy(*keys)
    placed = snippets.withColumn("_rn", F.row_number().over(w.orderBy("frame")) - 1)
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where((F.col("_n") % 2 == 1) & (F.col("_rn") == F.floor(F.col("_n") / 2))).drop("_rn", "_n")


def concat_offsets(snippets: DataFrame, keys: Sequence[str], part: str = "part") -> DataFrame:
    """Add ``index``: the frame number after appending the snippets of a track in the order of ``part``.

    Frames count from zero inside a snippet.
    """
    sizes = snippets.groupBy(*keys, part).agg((F.max("frame") + 1).alias("_n"))
    sizes = running_total(sizes, keys, part, F.col("_n"), "_end")
    sizes = sizes.select(*keys, part, (F.col("_end") - F.col("_n")).alias("_start"))
    out = snippets.join(sizes, [*keys, part])
    return out.withColumn("index", F.col("_start") + F.col("frame")).drop("_start")


def center_of_concat(tracks: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a concatenated track (``index``) in the middle of each of its equally long snippets, with ``part``.

    ``files`` holds the number of snippets ``n_files`` per track; the snippet length is total / n_files.
    """
    size = tracks.groupBy(*keys).agg((F.max("index") + 1).alias("_total")).join(files, list(keys))
    size = size.withColumn("_len", F.floor(F.col("_total") / F.col("n_files")))
    placed = tracks.join(size, list(keys)).withColumn("part", F.floor(F.col("index") / F.col("_len")))
    middle = F.col("part") * F.col("_len") + F.floor(F.col("_len") / 2)
    return placed.where((F.col("index") == middle) & (F.col("part") < F.col("n_files"))).drop("_total", "_len", "n_files")


def motion_energy(pred: DataFrame, threshold: float, keys: Sequence[str] = ("session", "view")) -> DataFrame:
    """Mean displacement over keypoints between successive frames after masking low likelihood; 0 in the first frame."""
    seen = chunked(mask_low_likelihood(pred, threshold).select(*keys, "keypoint", "frame", "x", "y"), "frame")
    seen = together(seen, [*keys, "_chunk"])  # all keypoints of a frame in one place
    near = neighbours(seen, [*keys, "keypoint"], "frame", ["x", "y"])
    moved = F.sqrt(F.pow(F.col("x") - F.col("prev_x"), 2) + F.pow(F.col("y") - F.col("prev_y"), 2))
    per = near.groupBy(*keys, "frame").agg(F.avg(moved).alias("_m"), F.max("has_prev").alias("_p"))
    return per.select(*keys, "frame", F.when(F.col("_p"), F.col("_m")).otherwise(F.lit(0.0)).alias("motion_energy"))


def minmax_normalise(points: DataFrame, keys: Sequence[str] = ("model", "session")) -> DataFrame:
    """X, Y, Z scaled to [-1, 1] per session and axis over all keypoints; a constant axis becomes 0."""
    ends = [f(c).alias(f"_{n}_{c}") for c in "XYZ" for n, f in (("lo", F.min), ("hi", F.max))]
    span = lookup(points.groupBy(*keys).agg(*ends), "spans")

    def scaled(c: str) -> Column:
        lo, width = F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(width > 1e-8, 2 * (F.col(c) - lo) / width - 1).when(F.col(c).isNotNull(), F.lit(0.0))

    out = points.join(span, list(keys))
    return out.withColumns({c: scaled(c) for c in "XYZ"}).select(*points.columns)


def zscore(df: DataFrame, values: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Each value minus its mean over its population std (+ eps), over the whole table."""
    stats = df.agg(F.struct(*[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(v) for v in values])).scalar()
    out = df.withColumn("_z", stats)
    made = {v: (F.col(v) - F.col(f"_z.{v}.m")) / (F.col(f"_z.{v}.s") + F.lit(eps)) for v in values}
    return out.withColumns(made).drop("_z")


def cumulative_share(components: DataFrame, keys: Sequence[str], share: str = "share", name: str = "cumulative") -> DataFrame:
    """Running sum of ``share`` over ``component``: one row per component, so groups are short."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("component")
    return components.withColumn(name, F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def pivot_points(points: DataFrame, keys: Sequence[str], keypoints: Sequence[str], values: Sequence[str] = ("X", "Y", "Z")
                 ) -> DataFrame:
    """One row per key with ``<keypoint>_<value>`` columns."""
    made = [F.max(F.when(F.col("keypoint") == k, F.col(v))).alias(f"{k}_{v}") for k in keypoints for v in values]
    return points.where(F.col("keypoint").isin(*keypoints)).groupBy(*keys).agg(*made).select(
        *cols(keys), *[f"{k}_{v}" for k in keypoints for v in values])
