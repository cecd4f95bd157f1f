"""Building blocks against plain computations, for every way of cutting the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import ordered as O
from trackloom.operators import select as P


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    frames = np.sort(rng.choice(4000, 700, replace=False))
    hot = pd.DataFrame({"g": "hot", "frame": frames, "x": rng.integers(0, 9, 700).astype(float)})
    cold = pd.DataFrame({"g": "cold", "frame": [0, 3, 900], "x": [1.0, 2.5, 2.5]})
    return pd.concat([hot, cold], ignore_index=True)


@pytest.mark.parametrize("chunk", [1, 7, 100, 100000])
def test_neighbours(spark, rows, chunk):
    df = spark.createDataFrame(rows).repartition(5)
    got = O.neighbours(df, ["g"], "frame", ["x"], ahead=True, chunk=chunk).toPandas().sort_values(["g", "frame"])
    want = rows.sort_values(["g", "frame"])
    for shift, name in ((1, "prev"), (-1, "next")):
        side = want.groupby("g")["x"].shift(shift)
        assert np.array_equal(got[f"{name}_x"].to_numpy(float), side.to_numpy(float), equal_nan=True)
        assert (got[f"has_{name}"].to_numpy() == side.notna().to_numpy()).all()


@pytest.mark.parametrize("chunk", [1, 7, 100, 100000])
def test_running_total(spark, rows, chunk):
    got = O.running_total(spark.createDataFrame(rows), ["g"], "frame", F.col("x"), "s", chunk=chunk).toPandas()
    got = got.sort_values(["g", "frame"])
    want = rows.sort_values(["g", "frame"]).groupby("g")["x"].cumsum()
    assert np.allclose(got["s"], want)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact(spark, rows, accuracy, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", accuracy)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = O.percentiles(spark.createDataFrame(rows).repartition(3), ["g"], "x", probs).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        for n, p in probs.items():
            assert got.loc[g, n] == pytest.approx(np.percentile(part["x"], 100 * p))
    whole = O.percentiles(spark.createDataFrame(rows), [], "x", probs).first()
    assert whole["d"] == pytest.approx(np.percentile(rows["x"], 90))


def test_percentiles_of_one_repeated_value(spark, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", 50)
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    row = O.percentiles(df, [], "x", {"p50": 0.5, "p90": 0.9}).first()
    values = np.where(np.arange(3000) < 2500, 7.0, np.arange(3000))
    assert row["p50"] == 7.0 and row["p90"] == pytest.approx(np.percentile(values, 90))


def test_approximate_percentiles_stay_within_their_bound(spark, rows):
    got = O.approx_percentiles(spark.createDataFrame(rows), ["g"], "x", {"m": 0.5}).toPandas().set_index("g")
    assert abs(got.loc["hot", "m"] - rows[rows.g == "hot"]["x"].median()) <= 1


def test_cumulative_counts_and_rank(spark, rows):
    got = O.strict_rank_share(spark.createDataFrame(rows), ["g"], "x", "share").toPandas()
    for _, r in got.iterrows():
        part = rows[rows.g == r.g]["x"]
        assert r.share == pytest.approx((part < r.x).mean())


def test_remove_worst_share_matches_sorting(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"session": np.repeat(["b", "a", "c"], 60), "frame": np.tile(np.arange(60), 3),
                        "score": rng.integers(0, 4, 180).astype(float)})
    pdf.loc[::9, "score"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("score", F.nanvl("score", F.lit(None)))
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        kept = {(r.session, r.frame) for r in P.remove_worst_share(df, share).collect()}
        order = pdf.assign(s=pdf["score"].fillna(-1)).sort_values(["s", "session", "frame"], ascending=[False, True, True])
        want = order.iloc[int(np.round(len(pdf) * share)):]
        assert kept == set(zip(want["session"], want["frame"])), share


def test_remove_worst_share_without_scores_keeps_all(spark):
    df = spark.range(10).select(F.lit("a").alias("session"), F.col("id").alias("frame"), F.lit(None).cast("double").alias("score"))
    assert P.remove_worst_share(df, 0.5).count() == 10


@pytest.mark.parametrize("parts", [1, 64])
def test_draws_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("session"), F.col("id").alias("frame")).repartition(parts)
    drawn = sorted(map(tuple, P.random_frames(df, 20, 4).collect()))
    split = sorted(map(tuple, P.train_val_split(df, 0.8, 4).collect()))
    base = df.coalesce(1)
    assert drawn == sorted(map(tuple, P.random_frames(base, 20, 4).collect())) and len(drawn) == 60
    assert split == sorted(map(tuple, P.train_val_split(base, 0.8, 4).collect()))
    assert sum(1 for r in split if r[2] == "train") == 400
    assert drawn != sorted(map(tuple, P.random_frames(df, 20, 5).collect()))


@pytest.mark.parametrize("trimmed", [5, 1000])
def test_first_n_in_parts(spark, rows, trimmed, monkeypatch):
    monkeypatch.setattr(O, "TRIMMED", trimmed)
    got = O.first_n(spark.createDataFrame(rows), ["g"], [F.col("x").desc(), F.col("frame")], 30).toPandas()
    want = rows.sort_values(["g", "x", "frame"], ascending=[True, False, True]).groupby("g").head(30)
    assert set(zip(got.g, got.frame)) == set(zip(want.g, want.frame)) and len(got) == len(want)
