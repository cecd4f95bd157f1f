"""Keypoint tables derived from the given tables, once in Spark and once as SQL text.

Session S0 holds a third of all frames; the sessions grow with the data. Everything is computed row by row from
``orders`` (and ``lineitem``, ``events``, ``embeddings`` where named), so building a table needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.session import lookup

KEYPOINTS = ["pawL", "pawR", "nose"]
HEAD = ["topBeak", "botBeak", "topHead", "backHead", "leftEye", "rightEye"]
VIEWS = ["v0", "v1", "v2", "v3"]
SEEDS = [0, 1, 2]
TURN = [(1.0, 0.0), (0.8, 0.6), (0.6, 0.8), (0.8, -0.6)]  # cosine and sine of the view direction


SPLIT = 2 * 2**20  # bytes of a given table that one task turns into keypoint rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. One that arrives in fewer splits than there are cores, or in larger ones than ``SPLIT``, is spread, since
    a row becomes up to 36 rows below: what a task holds of them does not grow with the table."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(spark.sparkContext.defaultParallelism, -(-size // SPLIT))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _items(rows: list[str]) -> str:
    return "explode(array(" + ", ".join(rows) + "))"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """session, sid, frame, ok, prio, status"""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ok",
        "CASE WHEN o_orderkey % 9 < 3 THEN 0 ELSE o_orderkey % 9 - 2 END AS sid",
        "CASE WHEN o_orderkey % 9 < 3 THEN (o_orderkey div 9) * 3 + o_orderkey % 9 ELSE o_orderkey div 9 END AS frame",
        "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS prio", "o_orderstatus AS status",
    ).selectExpr("concat('S', sid) AS session", "sid", "frame", "ok", "prio", "status")


def points(df: DataFrame, names: list[str]) -> DataFrame:
    """Each frame with every keypoint and its 3-D position."""
    made = _items([f"named_struct('kp', {i}L, 'keypoint', '{n}')" for i, n in enumerate(names)])
    return df.selectExpr("*", f"{made} AS _k").selectExpr(
        "session", "sid", "frame", "ok", "prio", "status", "_k.kp AS kp", "_k.keypoint AS keypoint",
        "abs((7 * frame + 13 * _k.kp + sid) % 40 - 20) / 20D AS X",
        "abs((3 * frame + 29 * _k.kp) % 60 - 30) / 30D AS Y",
        "abs((5 * frame + 11 * _k.kp + 2 * sid) % 48 - 24) / 24D AS Z")


def world(spark: SparkSession, sf: str) -> DataFrame:
    """session, sid, frame, ok, kp, keypoint, X, Y, Z"""
    return points(frames(spark, sf), KEYPOINTS)


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """``world`` seen by every camera without noise: + vi, view, c, n, u, w"""
    made = _items([f"named_struct('vi', {i}L, 'view', '{v}', 'c', {c}D, 'n', {n}D)"
                   for i, (v, (c, n)) in enumerate(zip(VIEWS, TURN))])
    return world(spark, sf).selectExpr("*", f"{made} AS _v").selectExpr(
        "session", "sid", "frame", "ok", "prio", "status", "kp", "keypoint", "X", "Y", "Z", "_v.vi AS vi", "_v.view AS view",
        "400D * (_v.c * X + _v.n * Z) / (-_v.n * X + _v.c * Z + 6D) + 320D AS u",
        "400D * Y / (-_v.n * X + _v.c * Z + 6D) + 240D AS w")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """model, seed, session, sid, view, vi, frame, ok, kp, keypoint, x, y, likelihood, u, w"""
    return seen(spark, sf).selectExpr("*", "explode(array(0L, 1L, 2L)) AS seed").selectExpr(
        "'m0' AS model", "seed", "session", "sid", "view", "vi", "frame", "ok", "prio", "status", "kp", "keypoint",
        "u + ((31 * ok + 17 * kp + 11 * vi + 7 * seed) % 97 - 48) / 48D AS x",
        "w + ((13 * ok + 5 * kp + 19 * vi + 23 * seed) % 89 - 44) / 44D AS y",
        "0.02D + 0.98D * ((7 * ok + 3 * kp + 5 * vi + 11 * seed) % 100) / 99D AS likelihood", "u", "w")


def holes(spark: SparkSession, sf: str) -> DataFrame:
    """``predictions`` with x, y NULL in places."""
    gap = F.expr("(ok + kp + vi) % 53 = 0")
    return predictions(spark, sf).withColumn("x", F.when(~gap, F.col("x"))).withColumn("y", F.when(~gap, F.col("y")))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders are the labelled frames: session, sid, view, vi, frame, ok, status, kp, keypoint, lx, ly,
    image_path, split, set"""
    return seen(spark, sf).where("prio = 1").selectExpr(
        "session", "sid", "view", "vi", "frame", "ok", "status", "kp", "keypoint", "u AS lx", "w AS ly",
        "concat('labeled-data/', session, '_', view, '/img', format_string('%08d', frame), '.png')"
        " AS image_path",
        "CASE WHEN sid >= 4 THEN 'OOD' ELSE 'InD' END AS split",
        "CASE status WHEN 'P' THEN 'test' WHEN 'O' THEN 'validation' ELSE 'train' END AS set")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """session, view, frame, box_x, box_y, box_w, box_h; one in 97 frames has width zero"""
    made = _items([f"named_struct('vi', {i}L, 'view', '{v}')" for i, v in enumerate(VIEWS)])
    return frames(spark, sf).selectExpr("*", f"{made} AS _v").selectExpr(
        "session", "_v.view AS view", "frame", "prio", "status",
        "CAST(100 + (3 * frame + 7 * _v.vi) % 50 AS DOUBLE) AS box_x",
        "CAST(80 + (5 * frame + _v.vi) % 40 AS DOUBLE) AS box_y",
        "CAST(CASE WHEN frame % 97 = 0 THEN 0 ELSE 200 + (frame + _v.vi) % 60 END AS DOUBLE) AS box_w",
        "CAST(180 + (2 * frame + _v.vi) % 70 AS DOUBLE) AS box_h")


def cameras(spark: SparkSession, sf: str, dist: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The camera table (session, view, cam_idx, k, dist, rvec, tvec) of every session in ``orders``."""
    made = _items([f"named_struct('vi', {i}L, 'view', '{v}', 'c', {c}D, 'n', {n}D)"
                   for i, (v, (c, n)) in enumerate(zip(VIEWS, TURN))])
    cams = frames(spark, sf).select("session").distinct().selectExpr("session", f"{made} AS _v").selectExpr(
        "session", "_v.view AS view", "_v.vi AS cam_idx",
        "array(400D, 0D, 320D, 0D, 400D, 240D, 0D, 0D, 1D) AS k",
        f"array({dist[0]}D, {dist[1]}D, 0D, 0D, 0D) AS dist",
        "array(0D, atan2(_v.n, _v.c), 0D) AS rvec", "array(0D, 0D, 6D) AS tvec")
    return lookup(cams, "cameras")


def angles(spark: SparkSession, sf: str) -> DataFrame:
    """model, m, session, sid, frame, yaw: fixations of 14 frames and jumps of 3"""
    def target(block: str) -> str:
        return f"(((({block}) + 7) * 53 + 3 * m) % 120 - 60)"

    b = "(frame + sid) div 17"
    return frames(spark, sf).selectExpr("*", "explode(array(0L, 1L, 2L)) AS m").selectExpr(
        "concat('m', m) AS model", "m", "session", "sid", "frame",
        f"{target(b)} + ({target(b + ' + 1')} - {target(b)}) * least((frame + sid) % 17, 3) / 3D AS yaw")


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """model, session, frame, kp, keypoint, X, Y, Z; each model rotated about z"""
    made = _items([f"named_struct('model', 'm{i}', 'c', {c}D, 'n', {n}D)" for i, (c, n) in enumerate(TURN[:3])])
    return points(frames(spark, sf), HEAD).selectExpr("*", f"{made} AS _m").selectExpr(
        "_m.model AS model", "session", "sid", "frame", "kp", "keypoint",
        "_m.c * X - _m.n * Y AS X", "_m.n * X + _m.c * Y AS Y", "Z")


def sweep_rows(spark: SparkSession, sf: str) -> DataFrame:
    """view, model, keypoint, ens_std, error from ``lineitem``"""
    return table(spark, sf, "lineitem").selectExpr(
        "concat('v', l_linenumber) AS view", "concat('m', l_returnflag) AS model",
        "concat('k', l_suppkey % 5) AS keypoint", "abs(l_extendedprice - 30000D) / 5000D AS ens_std",
        "l_quantity AS error")


def values(spark: SparkSession, sf: str) -> DataFrame:
    """session, sid, keypoint, axis, value from ``orders``"""
    return frames(spark, sf).join(
        table(spark, sf, "orders").selectExpr("o_orderkey AS ok", "o_totalprice AS value"), "ok").selectExpr(
        "concat('bird.', session, 'abcdefgh') AS session",
        "CASE status WHEN 'P' THEN 'nose' ELSE 'pawL' END AS keypoint", "CASE WHEN prio <= 2 THEN 'x' ELSE 'y' END AS axis",
        "value * (1D + sid / 10D) AS value")


FEATURES = ["pawL_vx", "pawL_vy", "pawL_vz", "pawR_vx", "pawR_vy", "pawR_vz", "pawL_speed", "pawR_speed",
            "pawL_acc_mag", "pawR_acc_mag", "paw_dist"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """model, session, frame, cluster and eleven feature columns from ``embeddings``"""
    return table(spark, sf, "embeddings").selectExpr(
        "concat('m', vec_id % 2) AS model", "concat('S', vec_id % 5) AS session", "vec_id AS frame",
        "CAST(label AS BIGINT) AS cluster",
        *[f"CAST(embedding[{i}] AS DOUBLE) * {1 + 9 * (i % 3)} + label * {i % 4}D AS {n}"
          for i, n in enumerate(FEATURES)])


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """scenario, mode, batch_size, time_per_batch from ``events``"""
    return table(spark, sf, "events").selectExpr(
        "concat(CASE event_id % 5 WHEN 0 THEN 'vits' WHEN 1 THEN 'vitb' WHEN 2 THEN 'SV_vits' WHEN 3 THEN 'SV_vitb'"
        " ELSE 'other' END, CASE user_id % 3 WHEN 0 THEN '_no_loss' WHEN 1 THEN '_3dreproj' ELSE '_3dreproj_patch' END,"
        " CASE WHEN event_type = 'click' THEN '_patch' ELSE '_no_patch' END,"
        " CASE WHEN event_id % 2 = 0 THEN '_train' ELSE '_inference' END,"
        " '_batch', 8 * (1 + user_id % 4)) AS scenario",
        "CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'inference' END AS mode", "event_id AS batch_idx",
        "8 * (1 + user_id % 4) AS batch_size", "0.001D + value / 1000D AS time_per_batch")


# The same tables as SQL common table expressions.

def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {r}" for r in rows)


_VIEW_ROWS = _union([f"CAST({i} AS BIGINT) AS vi, '{v}' AS view, CAST({c} AS DOUBLE) AS c, CAST({n} AS DOUBLE) AS n"
                     for i, (v, (c, n)) in enumerate(zip(VIEWS, TURN))])
_KP_ROWS = _union([f"CAST({i} AS BIGINT) AS kp, '{n}' AS keypoint" for i, n in enumerate(KEYPOINTS)])
_HEAD_ROWS = _union([f"CAST({i} AS BIGINT) AS kp, '{n}' AS keypoint" for i, n in enumerate(HEAD)])
_XYZ = """CAST(abs((7*frame + 13*kp + sid) % 40 - 20) AS DOUBLE) / 20 AS X,
  CAST(abs((3*frame + 29*kp) % 60 - 30) AS DOUBLE) / 30 AS Y,
  CAST(abs((5*frame + 11*kp + 2*sid) % 48 - 24) AS DOUBLE) / 24 AS Z"""


def _target(block: str) -> str:
    return f"(((({block}) + 7) * 53 + 3 * m) % 120 - 60)"


_B = "(frame + sid) // 17"

CTES = {
    "fx_frame": ([], """SELECT 'S' || sid AS session, sid, frame, ok, prio, status FROM (
  SELECT o_orderkey AS ok, CASE WHEN o_orderkey % 9 < 3 THEN 0 ELSE o_orderkey % 9 - 2 END AS sid,
  CASE WHEN o_orderkey % 9 < 3 THEN (o_orderkey // 9) * 3 + o_orderkey % 9 ELSE o_orderkey // 9 END AS frame,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS prio, o_orderstatus AS status FROM orders)"""),
    "fx_view": ([], _VIEW_ROWS),
    "fx_kp": ([], _KP_ROWS),
    "fx_headkp": ([], _HEAD_ROWS),
    "fx_world": (["fx_frame", "fx_kp"], f"SELECT session, sid, frame, ok, prio, status, kp, keypoint, {_XYZ}\n  FROM fx_frame, fx_kp"),
    "fx_seen": (["fx_world", "fx_view"], """SELECT w.*, vi, view,
  400 * (c * X + n * Z) / (-n * X + c * Z + 6) + 320 AS u, 400 * Y / (-n * X + c * Z + 6) + 240 AS w
  FROM fx_world w, fx_view"""),
    "fx_pred": (["fx_seen"], """SELECT 'm0' AS model, seed, session, sid, view, vi, frame, ok, prio, status, kp, keypoint,
  u + CAST((31*ok + 17*kp + 11*vi + 7*seed) % 97 - 48 AS DOUBLE) / 48 AS x,
  w + CAST((13*ok + 5*kp + 19*vi + 23*seed) % 89 - 44 AS DOUBLE) / 44 AS y,
  CAST(0.02 AS DOUBLE) + CAST(0.98 AS DOUBLE) * ((7*ok + 3*kp + 5*vi + 11*seed) % 100) / 99 AS likelihood, u, w
  FROM fx_seen, (SELECT unnest([0, 1, 2])::BIGINT AS seed)"""),
    "fx_holes": (["fx_pred"], """SELECT * REPLACE (CASE WHEN (ok + kp + vi) % 53 <> 0 THEN x END AS x,
  CASE WHEN (ok + kp + vi) % 53 <> 0 THEN y END AS y) FROM fx_pred"""),
    "fx_label": (["fx_seen"], """SELECT session, sid, view, vi, frame, ok, status, kp, keypoint, u AS lx, w AS ly,
  'labeled-data/' || session || '_' || view || '/img' || printf('%08d', frame) || '.png' AS image_path,
  CASE WHEN sid >= 4 THEN 'OOD' ELSE 'InD' END AS split,
  CASE status WHEN 'P' THEN 'test' WHEN 'O' THEN 'validation' ELSE 'train' END AS set
  FROM fx_seen WHERE prio = 1"""),
    "fx_bbox": (["fx_frame", "fx_view"], """SELECT session, view, frame, prio, status,
  CAST(100 + (3*frame + 7*vi) % 50 AS DOUBLE) AS box_x, CAST(80 + (5*frame + vi) % 40 AS DOUBLE) AS box_y,
  CAST(CASE WHEN frame % 97 = 0 THEN 0 ELSE 200 + (frame + vi) % 60 END AS DOUBLE) AS box_w,
  CAST(180 + (2*frame + vi) % 70 AS DOUBLE) AS box_h FROM fx_frame, fx_view"""),
    "fx_angle": (["fx_frame"], f"""SELECT 'm' || m AS model, m, session, sid, frame,
  {_target(_B)} + CAST(({_target(_B + ' + 1')} - {_target(_B)}) * least((frame + sid) % 17, 3) AS DOUBLE) / 3 AS yaw
  FROM fx_frame, (SELECT unnest([0, 1, 2])::BIGINT AS m)"""),
    "fx_head": (["fx_frame", "fx_headkp", "fx_view"], f"""SELECT 'm' || vi AS model, session, sid, frame, kp, keypoint,
  c * X - n * Y AS X, n * X + c * Y AS Y, Z FROM (SELECT *, {_XYZ} FROM fx_frame, fx_headkp), fx_view WHERE vi < 3"""),
    "fx_sweep": ([], """SELECT 'v' || l_linenumber AS view, 'm' || l_returnflag AS model,
  'k' || (l_suppkey % 5) AS keypoint, abs(l_extendedprice - 30000) / 5000 AS ens_std, l_quantity AS error
  FROM lineitem"""),
    "fx_value": (["fx_frame"], """SELECT 'bird.' || session || 'abcdefgh' AS session,
  CASE status WHEN 'P' THEN 'nose' ELSE 'pawL' END AS keypoint, CASE WHEN prio <= 2 THEN 'x' ELSE 'y' END AS axis,
  o_totalprice * (CAST(1 AS DOUBLE) + CAST(sid AS DOUBLE) / 10) AS value
  FROM fx_frame JOIN orders ON o_orderkey = ok"""),
    "fx_feature": ([], "SELECT 'm' || (vec_id % 2) AS model, 'S' || (vec_id % 5) AS session, vec_id AS frame,\n"
                       "  CAST(label AS BIGINT) AS cluster,\n  " + ",\n  ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) * {1 + 9 * (i % 3)} + label * CAST({i % 4} AS DOUBLE) AS {n}"
        for i, n in enumerate(FEATURES)) + " FROM embeddings"),
    "fx_timing": ([], """SELECT CASE event_id % 5 WHEN 0 THEN 'vits' WHEN 1 THEN 'vitb' WHEN 2 THEN 'SV_vits' WHEN 3 THEN 'SV_vitb'
  ELSE 'other' END || CASE user_id % 3 WHEN 0 THEN '_no_loss' WHEN 1 THEN '_3dreproj' ELSE '_3dreproj_patch' END ||
  CASE WHEN event_type = 'click' THEN '_patch' ELSE '_no_patch' END ||
  CASE WHEN event_id % 2 = 0 THEN '_train' ELSE '_inference' END || '_batch' || (8 * (1 + user_id % 4)) AS scenario,
  CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'inference' END AS mode, event_id AS batch_idx,
  8 * (1 + user_id % 4) AS batch_size, CAST(0.001 AS DOUBLE) + value / 1000 AS time_per_batch FROM events"""),
}


def with_tables(names: str, body: str) -> str:
    """``body`` (a SELECT, or further ``x AS (...)`` parts followed by one) on top of the named tables."""
    needed: list[str] = []

    def need(name: str) -> None:
        for base in CTES[name][0]:
            need(base)
        if name not in needed:
            needed.append(name)

    for n in names.split():
        need(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in needed)
    text = body.strip()
    joint = "\n" if text[:6].upper() == "SELECT" else ",\n"
    return f"WITH {head}{joint}{text}"
