"""Name rules over names built from every row of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.catalog.fixtures import table, timings, with_tables
from trackloom.catalog.registry import register
from trackloom.functions import names as N

VIEWS = ["L", "TL", "Cam-A", "leftCamera", "lBack"]
LONGEST = sorted(VIEWS, key=len, reverse=True)


def names(spark: SparkSession, sf: str) -> DataFrame:
    """id, view, session, name, path: six naming styles, some with overlapping views, one without any"""
    view = "CASE (o_orderkey div 6) % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VIEWS)) + " END"
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{view} AS view",
                                                "o_orderstatus AS status").selectExpr(
        "id", "view", "status",
        "CASE id % 6 WHEN 0 THEN concat('_iblrig.downsampled.u', id)"
        " WHEN 1 THEN concat('05272019_fly', id % 8, '_0_R2C14_str-ccw-0.72_sec')"
        " WHEN 2 THEN concat('PRL43_200617_', id, '.short')"
        " WHEN 3 THEN concat('20231031_B', id % 9, '_chew_bl_000_08-38-25')"
        " WHEN 4 THEN concat('CSDS-Day1-A_', id, '-Defeat') ELSE concat('plain_T_', id) END AS session",
        "CASE id % 6 WHEN 0 THEN concat('_iblrig_', view, '.downsampled.u', id)"
        " WHEN 1 THEN concat('05272019_fly', id % 8, '_0_R2C14_', view, '_str-ccw-0.72_sec')"
        " WHEN 2 THEN concat('PRL43_200617_', id, '_', view, '.short')"
        " WHEN 3 THEN concat('20231031_B', id % 9, '_chew_bl_000_', view, '_08-38-25')"
        " WHEN 4 THEN concat('CSDS-Day1-A_', id, '-Defeat_', view) ELSE concat('plain_T_', id, '_Z') END AS name",
    ).selectExpr("*", "concat('labeled-data/', name, CASE WHEN id % 11 = 0 THEN '/frame' ELSE"
                 " concat('/img', format_string('%08d', id)) END,"
                 " CASE id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '.txt' END) AS path")


_VIEW = "CASE (o_orderkey // 6) % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VIEWS)) + " END"
NAMES = f"""WITH b AS (SELECT o_orderkey AS id, {_VIEW} AS view, o_orderstatus AS status FROM orders),
s AS (SELECT id, view, status,
 CASE id % 6 WHEN 0 THEN '_iblrig.downsampled.u' || id WHEN 1 THEN '05272019_fly' || (id % 8) || '_0_R2C14_str-ccw-0.72_sec'
 WHEN 2 THEN 'PRL43_200617_' || id || '.short' WHEN 3 THEN '20231031_B' || (id % 9) || '_chew_bl_000_08-38-25'
 WHEN 4 THEN 'CSDS-Day1-A_' || id || '-Defeat' ELSE 'plain_T_' || id END AS session,
 CASE id % 6 WHEN 0 THEN '_iblrig_' || view || '.downsampled.u' || id
 WHEN 1 THEN '05272019_fly' || (id % 8) || '_0_R2C14_' || view || '_str-ccw-0.72_sec'
 WHEN 2 THEN 'PRL43_200617_' || id || '_' || view || '.short'
 WHEN 3 THEN '20231031_B' || (id % 9) || '_chew_bl_000_' || view || '_08-38-25'
 WHEN 4 THEN 'CSDS-Day1-A_' || id || '-Defeat_' || view ELSE 'plain_T_' || id || '_Z' END AS name FROM b),
n AS (SELECT *, 'labeled-data/' || name || CASE WHEN id % 11 = 0 THEN '/frame' ELSE '/img' || printf('%08d', id) END ||
 CASE id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '.txt' END AS path FROM s)
"""

_VLIST = "(" + ", ".join(f"'{v}'" for v in VIEWS) + ")"


def view_case(col: str) -> str:
    return ("CASE " + " ".join(f"WHEN contains({col}, '_{v}_') OR ends_with({col}, '_{v}') THEN '{v}'" for v in LONGEST)
            + f" ELSE string_split({col}, '_')[-1] END")


def seq_sql(col: str) -> str:
    s = f"replace({col}, '.short', '')"
    return ("CASE " + " ".join(f"WHEN contains({s}, '_{v}.downsampled') THEN replace({s}, '_{v}.downsampled',"
                               " '.downsampled')" for v in VIEWS)
            + f" ELSE array_to_string(list_filter(string_split({s}, '_'), lambda t: t NOT IN {_VLIST}), '_') END")


FIRST_OUT = "CASE WHEN contains(name, '_' || v) THEN substr(name, 1, instr(name, '_' || v) - 1) || " \
            "substr(name, instr(name, '_' || v) + length(v) + 1) ELSE name END"
FRAME = r"CAST(nullif(regexp_extract(path, 'img(\d+)\.(png|jpg|jpeg)', 1), '') AS BIGINT)"


@register("name_session_view", "F1", NAMES + f"""SELECT id, {FIRST_OUT} AS session, v AS view
FROM (SELECT *, {view_case('name')} AS v FROM n)""")
def name_session_view(spark: SparkSession, sf: str) -> DataFrame:
    made = N.session_info(F.concat("name", F.lit(".csv")), VIEWS)
    return names(spark, sf).select("id", made.alias("i")).select("id", "i.session", "i.view")


@register("name_sequence", "F2", NAMES + f"SELECT id, {seq_sql('name')} AS sequence FROM n")
def name_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", N.sequence_name(F.col("name"), VIEWS).alias("sequence"))


@register("name_condition", "F3", NAMES + f""", q AS (SELECT id, {seq_sql('name')} AS q FROM n),
p AS (SELECT *, string_split(q, '_') AS parts FROM q),
a AS (SELECT *, list_position(list_transform(parts, lambda t: contains(t, 'str-') OR contains(t, 'rot-')
  OR contains(t, 'sec')), true) AS pos FROM p)
SELECT id, CASE WHEN pos IS NULL OR pos = 0 THEN q ELSE array_to_string(parts[1:pos - 1], '_') END AS base,
 CASE WHEN pos IS NULL OR pos = 0 THEN '' ELSE array_to_string(parts[pos:], '_') END AS condition FROM a""")
def name_condition(spark: SparkSession, sf: str) -> DataFrame:
    made = N.session_condition(F.col("name"), VIEWS)
    return names(spark, sf).select("id", made.alias("i")).select("id", "i.base", "i.condition")


@register("name_image_path", "F4", NAMES + r""", c AS (SELECT *, replace(session, '.short', '') AS s FROM n)
SELECT id, 'labeled-data/' || CASE
 WHEN contains(s, '.downsampled.') THEN replace(s, '.downsampled.', '_' || view || '.downsampled.')
 WHEN contains(s, '_str-') THEN replace(s, '_str-', '_' || view || '_str-')
 ELSE s || '_' || view END || '/img' || printf('%08d', id) || '.jpg' AS image_path FROM c""")
def name_image_path(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", N.image_path(F.col("session"), F.col("view"), F.col("id"), "labeled-data",
                                                      ".jpg").alias("image_path"))


@register("name_labelled_frame", "F5", NAMES + rf"""SELECT id,
 regexp_replace(name, '_({'|'.join(LONGEST)})(_|\.|$)', '\2') AS session, {FRAME} AS frame
FROM n WHERE {FRAME} IS NOT NULL AND ends_with(path, '.png')""")
def name_labelled_frame(spark: SparkSession, sf: str) -> DataFrame:
    made = N.labelled_frame(F.col("path"), VIEWS)
    return names(spark, sf).select("id", made.alias("i")).where("i is not null").select("id", "i.session", "i.frame")


@register("name_frame_info", "F6", NAMES + f"""SELECT id, {seq_sql('name')} AS session, {FRAME} AS frame,
 string_split(path, '/')[-1] AS file FROM n WHERE {FRAME} IS NOT NULL""")
def name_frame_info(spark: SparkSession, sf: str) -> DataFrame:
    made = N.frame_info(F.col("path"), VIEWS)
    return names(spark, sf).select("id", made.alias("i")).where("i is not null").select(
        "id", "i.session", "i.frame", "i.file")


@register("name_token", "F7", NAMES + "SELECT id, " + ", ".join(
    f"regexp_matches(name, '(^|[^0-9a-zA-Z]){v}($|[^0-9a-zA-Z])') AS has_{i}" for i, v in enumerate(VIEWS)) + " FROM n")
def name_token(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select(
        "id", *[N.has_token(F.col("name"), v).alias(f"has_{i}") for i, v in enumerate(VIEWS)])


@register("name_session_view_frame", "F8", NAMES + rf"""SELECT id, {view_case('name')} AS view,
 regexp_replace(name, '_({'|'.join(LONGEST)})$', '') AS session,
 coalesce(CAST(nullif(regexp_extract(path, 'img(\d+)', 1), '') AS BIGINT), -1) AS frame FROM n""")
def name_session_view_frame(spark: SparkSession, sf: str) -> DataFrame:
    made = N.session_view_frame(F.col("path"), VIEWS)
    return names(spark, sf).select("id", made.alias("i")).select("id", "i.session", "i.view", "i.frame")


@register("name_file_lookup", "F9", NAMES + r""", listing AS (SELECT DISTINCT name || '.csv' AS file FROM n),
c AS (SELECT id, view, 1 AS prio, regexp_replace(session, '_(\d{2}-\d{2}-\d{2})$', '_' || view || '_\1') || '.csv' AS file
 FROM n WHERE regexp_matches(session, '_\d{2}-\d{2}-\d{2}$')
 UNION ALL SELECT id, view, 2, session || '_' || view || '.csv' FROM n
 UNION ALL SELECT id, view, 3, regexp_replace(session, '_([^_]*)$', '_' || view || '_\1') || '.csv'
 FROM n WHERE contains(session, '_'))
SELECT id, view, arg_min(file, prio) AS file FROM c JOIN listing USING (file) GROUP BY id, view""")
def name_file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.sources.listing import lookup_files

    n = names(spark, sf)
    listing = n.select(F.concat("name", F.lit(".csv")).alias("file")).distinct()
    return lookup_files(n.select("id", "session", "view"), listing, ["id", "view"]).select("id", "view", "file")


@register("name_without_view", "F10", NAMES + """SELECT id, array_to_string(list_filter(string_split(name, '_'),
 lambda t: t <> view), '_') AS session, string_split(path, '/')[-1] AS image FROM n""")
def name_without_view(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", N.without_view(F.col("path"), F.col("view")).alias("key")).select("id", "key.*")


@register("name_box_file", "F11", NAMES + r"""SELECT id,
 regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') || '_bbox.csv' AS box_file FROM n""")
def name_box_file(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", N.box_file(F.col("path")).alias("box_file"))


@register("name_calibration", "F12 J11", NAMES + f""", c AS (SELECT id, name, CASE WHEN id % 2 = 0 THEN
 replace({FIRST_OUT}, '.short', '') ELSE {seq_sql('name')} END AS session FROM (SELECT *, {view_case('name')} AS v FROM n)),
t AS (SELECT DISTINCT replace(session, '.short', '') AS session FROM n WHERE status <> 'P')
SELECT id, c.session, CASE WHEN t.session IS NOT NULL THEN 'calibrations/' || t.session || '.toml' END AS toml
FROM c LEFT JOIN t ON c.session = t.session""")
def name_calibration(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.joins import calibration_lookup

    n = names(spark, sf)
    available = n.where("status <> 'P'").select(F.replace("session", F.lit(".short"), F.lit("")).alias("session")).distinct()
    available = available.withColumn("toml", F.concat(F.lit("calibrations/"), "session", F.lit(".toml")))
    asked = n.select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(".csv"))).otherwise(F.col("name"))
                     .alias("name"))
    return calibration_lookup(asked, available, VIEWS).select("id", "session", "toml")


@register("name_short_session", "F13", NAMES + "SELECT id, substr(string_split(session, '.')[-1], 1, 8) AS short FROM n")
def name_short_session(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", N.short_session(F.col("session")).alias("short"))


_MODEL = ("CASE id % 5 WHEN 0 THEN concat('sup_', view, '_mvt.', id % 5, '_x') WHEN 1 THEN"
          " concat('a_ensemble_median_', view, '.', id % 7) WHEN 2 THEN concat('m_ca_', id % 9, '_t_', id % 3)"
          " WHEN 3 THEN concat('net.v2.', id % 9) ELSE concat('a_b_', view, '_c_d') END")


@register("name_model", "F14", NAMES + f""", m AS (SELECT id, {_MODEL} AS model FROM n)
SELECT id, CASE WHEN regexp_matches(model, '\\.[0-4]') THEN regexp_replace(model, '\\.[^.]*$', '') ELSE model END AS base,
 CASE WHEN regexp_matches(model, 'ensemble_mean|ensemble_median|eks_singleview|eks_multiview') THEN model
 WHEN contains(model, '.') THEN regexp_replace(model, '\\.[^.]*$', '') ELSE '' END AS major,
 CASE WHEN contains(model, 'ca_') THEN regexp_replace(model, '_ca_\\d+_', '_', 'g')
 WHEN len(string_split(model, '_')) < 4 THEN model ELSE array_to_string(string_split(model, '_')[1:2] ||
 string_split(model, '_')[4:], '_') END AS normal FROM m""")
def name_model(spark: SparkSession, sf: str) -> DataFrame:
    m = names(spark, sf).selectExpr("id", f"{_MODEL} AS model")
    c = F.col("model")
    return m.select("id", N.base_model(c).alias("base"), N.major_model(c).alias("major"),
                    N.normal_model(c).alias("normal"))


_SEEDED = "CASE WHEN id % 3 = 0 THEN session ELSE concat(session, '_seed_', id % 4) END"


@register("name_model_seed", "F15", NAMES + f""", m AS (SELECT id, {_SEEDED} AS key FROM n)
SELECT id, string_split(key, '_seed_')[1] AS model, string_split(key, '_seed_')[2] AS seed FROM m
WHERE len(string_split(key, '_seed_')) = 2""")
def name_model_seed(spark: SparkSession, sf: str) -> DataFrame:
    m = names(spark, sf).selectExpr("id", f"{_SEEDED} AS key")
    return m.select("id", N.model_seed(F.col("key")).alias("i")).where("i is not null").select("id", "i.model", "i.seed")


@register("name_scenario", "F16", with_tables("fx_timing", r""", r AS (SELECT batch_idx AS id,
 regexp_extract(scenario, '^(SV_vits|SV_vitb|vits|vitb)_(no_loss|3dreproj|3dreproj_patch)_(no_patch|patch)_(train|inference)_batch(\d+)$',
 ['arch', 'loss', 'patch', 'mode', 'batch']) AS p FROM fx_timing)
SELECT id, p.arch AS arch, CASE WHEN starts_with(p.loss, '3dreproj') THEN '3d_reproj' ELSE p.loss END AS loss,
 p.patch AS patch, p.mode AS mode, CAST(p.batch AS BIGINT) AS batch,
 CASE p.arch WHEN 'vits' THEN 'ViT-S (MV)' WHEN 'vitb' THEN 'ViT-B (MV)' WHEN 'SV_vits' THEN 'ViT-S (SV)'
 ELSE 'ViT-B (SV)' END || ' (' || CASE WHEN starts_with(p.loss, '3dreproj') THEN '3D reproj' ELSE 'no reproj' END ||
 ', ' || CASE p.patch WHEN 'patch' THEN 'patch' ELSE 'no patch' END || ')' AS label
FROM r WHERE p.arch <> ''""".lstrip(", ")))
def name_scenario(spark: SparkSession, sf: str) -> DataFrame:
    made = timings(spark, sf).select(F.col("batch_idx").alias("id"), N.scenario(F.col("scenario")).alias("i"))
    return made.where("i is not null").select("id", "i.*")


_WORDS = "CASE WHEN id % 4 = 0 THEN concat('Fly ', view) ELSE concat('Fly ', id % 8, '  R1C24  rot-', id, ' sec') END"


@register("name_insert_token", "F17", NAMES + f""", w AS (SELECT id, {_WORDS} AS s FROM n),
p AS (SELECT id, list_filter(string_split(s, ' '), lambda t: t <> '') AS w FROM w)
SELECT id, CASE WHEN len(w) > 2 THEN array_to_string(w[1:2] || ['Cam-A'] || w[3:], ' ') END AS name FROM p""")
def name_insert_token(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).selectExpr("id", f"{_WORDS} AS s").select(
        "id", N.insert_token(F.col("s"), "Cam-A").alias("name"))


_INDEX = "CASE id % 8 WHEN 0 THEN 'bodyparts' WHEN 1 THEN 'coords' WHEN 2 THEN view WHEN 3 THEN NULL ELSE path END"


@register("name_image_index", "F18", NAMES + f""", i AS (SELECT {_INDEX} AS idx FROM n)
SELECT string_split(idx, '/')[2] AS folder, count(*) AS n FROM i WHERE contains(idx, '/')
 AND idx NOT IN ('bodyparts', 'coords') GROUP BY 1""")
def name_image_index(spark: SparkSession, sf: str) -> DataFrame:
    i = names(spark, sf).selectExpr(f"{_INDEX} AS idx").where(N.is_image_index(F.col("idx")))
    return i.groupBy(F.get(F.split("idx", "/"), 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
