"""From predictions of several seeds and labels to error tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackloom.operators.ensemble import ensemble
from trackloom.operators.evaluate import error_summary, pixel_error
from trackloom.operators.joins import labelled_only

POINT = ("session", "view", "frame", "keypoint")


def method_errors(pred: DataFrame, labels: DataFrame, modes: Sequence[str] = ("mean", "median"),
                  seeds: Sequence[int] | None = None) -> DataFrame:
    """Error summary per model and method: each seed by itself, and the seeds combined in the given ways."""
    few = labelled_only(pred, labels)
    lab = labels.select(*POINT, "lx", "ly")
    parts = [few.select("model", F.concat(F.lit("seed_"), "seed").alias("method"), *POINT, "x", "y")]
    for mode in modes:
        made = ensemble(few, mode, seeds=seeds)
        parts.append(made.select("model", F.lit(f"ensemble_{mode}").alias("method"), *POINT, "x", "y"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return error_summary(pixel_error(lab, table), ["model", "method"])
