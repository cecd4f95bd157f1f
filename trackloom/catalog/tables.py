"""Listings of files, and label, box, calibration and extraction tables; what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog import fixtures as X
from trackloom.catalog.fixtures import VIEWS, with_tables
from trackloom.catalog.registry import register
from trackloom.catalog.scoring import r
from trackloom.operators.select import dedupe_first
from trackloom.session import fresh_path
from trackloom.sources import listing as L
from trackloom.sources import tables as T


@register("first_calibration", "S5", with_tables("fx_label", """m AS (SELECT session, ok * 4 + vi AS line, 'calibrations/' || session || '_' || (ok % 3)
 || '.toml' AS toml FROM fx_label WHERE keypoint = 'nose')
SELECT session, arg_min(toml, line) AS toml FROM m GROUP BY 1"""))
def first_calibration(spark: SparkSession, sf: str) -> DataFrame:
    m = X.labels(spark, sf).where("keypoint = 'nose'").selectExpr(
        "ok * 4 + vi AS line", "image_path", "concat('calibrations/', session, '_', ok % 3, '.toml') AS toml")
    return T.first_calibration(m, VIEWS)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One recording per order, seen by as many views as its priority number, each file with an uncropped copy and a
    file of a view that is not asked for: session, view, model, video_dir, path."""
    made = X._items([f"named_struct('vi', {i}L, 'view', '{v}')" for i, v in enumerate([*VIEWS, "z9"])])
    f = X.frames(spark, sf).selectExpr(
        "concat('B', ok, '_rec') AS session", "prio", "concat('net', ok % 2) AS model",
        "CASE WHEN status = 'P' THEN 'videos_reprojected' ELSE 'videos' END AS video_dir", f"{made} AS _v")
    f = f.where("_v.vi < prio OR _v.vi = 4").selectExpr(
        "session", "_v.view AS view", "model", "video_dir", "explode(array('', '_uncropped')) AS copy")
    return f.selectExpr("session", "view", "model", "video_dir",
                        "concat('/out/', model, '/', video_dir, '/', session, '_', view, copy, '.csv') AS path")


FILES = """fl AS (SELECT 'B' || ok || '_rec' AS session, view, 'net' || (ok % 2) AS model,
 CASE WHEN status = 'P' THEN 'videos_reprojected' ELSE 'videos' END AS video_dir FROM fx_frame, (SELECT vi, view FROM fx_view
 UNION ALL SELECT 4, 'z9') WHERE vi < prio OR vi = 4)"""


@register("discover_predictions", "S6", with_tables("fx_frame fx_view", FILES + """, k AS (SELECT * FROM fl WHERE view <> 'z9'),
g AS (SELECT session FROM k GROUP BY 1 HAVING count(DISTINCT view) >= 2)
SELECT session, view, CASE WHEN video_dir = 'videos_reprojected' THEN model || '_anipose' ELSE model END AS model,
 '/out/' || model || '/' || video_dir || '/' || session || '_' || view || '.csv' AS path FROM k SEMI JOIN g USING (session)"""))
def discover_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return L.discover_predictions(files(spark, sf).drop("session", "view"), VIEWS)


@register("index_by_sequence", "S7", with_tables("fx_frame fx_view", FILES + """ SELECT session AS sequence, string_agg(view || '=' || session || '_' ||
 view, ',' ORDER BY view) AS folders FROM (SELECT DISTINCT session, view FROM fl WHERE view <> 'z9') GROUP BY 1"""))
def index_by_sequence(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf).where("view <> 'z9'").select(F.concat_ws("_", "session", "view").alias("folder")).distinct()
    entries = F.transform(F.array_sort(F.map_entries("folders")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return L.index_by_sequence(f, VIEWS).select("sequence", F.array_join(entries, ",").alias("folders"))


@register("seed_files", "S8", with_tables("fx_frame", """SELECT '/seed' || (ok % 3) || '/' || session || '/img' || printf('%04d', frame) || '.csv' AS path,
 frame AS "order" FROM fx_frame"""))
def seed_files(spark: SparkSession, sf: str) -> DataFrame:
    f = X.frames(spark, sf).selectExpr("concat('/seed', ok % 3, '/', session, '/img', format_string('%04d', frame)) AS stem")
    paths = f.select("stem", F.explode(F.array(*[F.lit(e) for e in (".csv", "_uncropped.csv", ".txt")])).alias("e"))
    return L.seed_files(paths.select(F.concat("stem", "e").alias("path")))


WIDE = ", ".join(f"round(max(CASE WHEN keypoint = '{k}' THEN l{c} END), 6) + 0.0::DOUBLE AS {k}_{c}" for k in X.KEYPOINTS for c in "xy")


@register("label_table", "S9", with_tables("fx_label", f"""w AS (SELECT view, image_path, {WIDE} FROM fx_label WHERE status <> 'P' GROUP BY 1, 2)
SELECT 'CollectedData_' || i.view || '_new' AS file, i.image_path, w.* EXCLUDE (view, image_path)
FROM (SELECT DISTINCT view, image_path FROM fx_label) i LEFT JOIN w USING (view, image_path)"""))
def label_table(spark: SparkSession, sf: str) -> DataFrame:
    lab, path = X.labels(spark, sf), fresh_path(spark, "labels")
    images = lab.select("view", "image_path").distinct()
    T.write_labels(T.label_table(lab.where("status <> 'P'"), X.KEYPOINTS, images), path, "_new")
    return r(spark.read.parquet(path), *[f"{k}_{c}" for k in X.KEYPOINTS for c in "xy"])


@register("merged_boxes", "S10 A38", with_tables("fx_bbox", """i AS (SELECT *, session || '/' || frame AS image_path FROM fx_bbox),
e AS (SELECT view, image_path, box_x, box_w FROM i WHERE prio <= 2), p AS (SELECT view, image_path, box_x + 1 AS box_x, box_w FROM i WHERE status <> 'F')
SELECT view, image_path, coalesce(e.box_x, p.box_x) AS box_x, coalesce(e.box_w, p.box_w) AS box_w FROM e FULL JOIN p USING (view, image_path)"""))
def merged_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = X.boxes(spark, sf).withColumn("image_path", F.concat("session", F.lit("/"), "frame"))
    keep = ["view", "image_path", "box_x", "box_w"]
    e = b.where("prio <= 2").select(*keep)
    p = b.where("status <> 'F'").withColumn("box_x", F.col("box_x") + 1).select(*keep)
    path = fresh_path(spark, "boxes")
    out = T.merged_boxes(e, p)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


@register("extraction_info", "S11 U4", with_tables("fx_label fx_frame", """a AS (SELECT DISTINCT 'existing' AS data_type, session, frame FROM fx_label WHERE view = 'v0'
 AND split = 'InD' UNION ALL SELECT DISTINCT 'new_csv', session, frame FROM fx_label WHERE view = 'v0' AND split = 'OOD'
 UNION ALL SELECT 'pseudo_labeled', session, frame FROM fx_frame WHERE prio = 2)
SELECT data_type || '/' || session || '/' || frame AS id, session, frame, 'img' || printf('%08d', frame) || '.png' AS img_filename, data_type FROM a"""))
def extraction_info(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf).where("view = 'v0'").select("image_path", "split").distinct()
    pseudo = X.frames(spark, sf).where("prio = 2").select("session", "frame")
    out = T.extraction_info(lab.where("split = 'InD'"), lab.where("split = 'OOD'"), pseudo, VIEWS)
    path = fresh_path(spark, "extraction")
    T.write_json(out, path)
    return spark.read.schema(out.schema).json(path)


@register("calibration_map", "S12 J11", with_tables("fx_label", """SELECT DISTINCT image_path, 'calibrations/' || session || '.toml' AS file FROM fx_label WHERE sid <> 3"""))
def calibration_map(spark: SparkSession, sf: str) -> DataFrame:
    lab = X.labels(spark, sf)
    known = lab.where("sid <> 3").select("session").distinct().withColumn(
        "toml", F.concat(F.lit("calibrations/"), "session", F.lit(".toml")))
    out = T.calibration_map(lab, known, VIEWS)
    path = fresh_path(spark, "calibrations")
    T.write_csv(out, path)
    return spark.read.schema(out.schema).option("header", "true").csv(path)


@register("unfinished_sessions", "S13", with_tables("fx_frame fx_view", FILES + """, i AS (SELECT DISTINCT session, view FROM fl WHERE view <> 'z9'),
o AS (SELECT * FROM i WHERE NOT (view = 'v1' AND session LIKE '%7_rec')), m AS (SELECT DISTINCT session FROM i ANTI JOIN o USING (session, view))
SELECT session, view FROM i SEMI JOIN m USING (session)"""))
def unfinished_sessions(spark: SparkSession, sf: str) -> DataFrame:
    i = dedupe_first(files(spark, sf).where("view <> 'z9'").select("session", "view", "path"), ["session", "view"], ["path"])
    done = i.where("NOT (view = 'v1' AND session LIKE '%7_rec')")
    return L.unfinished(i, done).select("session", "view")
