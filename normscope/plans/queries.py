"""Registered queries and their SQL.

The test tables hold no images.  ``embeddings`` stands in for local descriptors:
ten consecutive vectors are one image (``image_id``), each a cell of it; images
take turns as reference, calibration and inspected ones, and every second
inspected image is stretched by a quarter, so that there are anomalies.
``documents`` stands in for uploads.  Computed doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import filename_or_default, image_format, upload_status
from ..functions.raster import blend, colour_bound, colour_level, jet, normalised, resize_axis, resize_grid
from ..functions.stats import linear_quantile, ordered_values
from ..functions.vectors import scaled
from ..operators import catalog
from ..operators.assembly import concat_grids
from ..operators.lazy_greedy import lazy_picks
from ..operators.neighbours import image_score, nearest_distance
from ..operators.pivots import nearest_by_pivots
from ..operators.ranks import exact_quantiles, numbered
from ..operators.scoring import is_anomaly, is_zero, threshold_of, verdicts
from ..operators.selection import farthest_points
from ..sources.network import Conv, max_pool, relu
from ..sources.scratch import scratch_path
from ..sources.store import StateStore
from ..streaming.ingest import add_uploads
from .detector import heat_images, partial_grid_rows
from .state import as_document, from_document

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(column):
    return F.round(column, 6)


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, image_id, cell, role (0 reference, 1 calibration, 2 inspected), descriptor."""
    image = F.expr("vec_id div 10")
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", image.alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("cell"), (image % 3).cast("int").alias("role"), scaled(F.col("embedding"), F.when(image % 6 == 2, 1.25).otherwise(1.0)).alias("descriptor")
    )


D = """WITH d AS (SELECT vec_id, vec_id // 10 AS image_id, CAST(vec_id % 10 AS INT) AS cell, (vec_id // 10) % 3 AS role,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * CASE WHEN (vec_id // 10) % 6 = 2 THEN 1.25 ELSE 1.0 END) AS v FROM embeddings),
bank AS (SELECT v FROM d WHERE role = 0),
n AS MATERIALIZED (SELECT d.vec_id, d.image_id, d.cell, d.role, min(list_distance(d.v, bank.v)) AS d FROM d, bank WHERE d.role > 0 GROUP BY ALL),
s AS (SELECT image_id, role, max(d) AS score FROM n GROUP BY image_id, role)"""


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descriptors(spark, sf_dir)
    return nearest_distance(d.where("role > 0"), d.where("role = 0").select("descriptor"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).groupBy("image_id", "role").agg(F.max("d").alias("score"))


@query(D + " SELECT vec_id, image_id, cell, round(d, 6) AS d FROM n")
def nn_distance(spark, sf_dir):
    return _local(spark, sf_dir).select("vec_id", "image_id", "cell", _r("d").alias("d"))


@query(D + " SELECT vec_id, image_id, cell, round(d, 6) AS d FROM n")
def nn_distance_pivots(spark, sf_dir):
    """The same distances by the way that banks beyond a broadcast take."""
    d = descriptors(spark, sf_dir)
    bank = d.where("role = 0").select(F.col("descriptor").alias("b"))
    return nearest_by_pivots(d.where("role > 0"), bank, "descriptor", "d").select("vec_id", "image_id", "cell", _r("d").alias("d"))


@query(D + " SELECT image_id, round(score, 6) AS score FROM s")
def image_scores(spark, sf_dir):
    return image_score(_local(spark, sf_dir)).select("image_id", _r("score").alias("score"))


@query(D + " SELECT round(quantile_cont(score, 0.95), 6) AS threshold, count(*) AS n_scores FROM s WHERE role = 1")
def calibration_threshold(spark, sf_dir):
    return _scores(spark, sf_dir).where("role = 1").agg(_r(linear_quantile("score", 0.95)).alias("threshold"), F.count("*").alias("n_scores"))


@query(D + " SELECT CAST(row_number() OVER (ORDER BY image_id) - 1 AS INT) AS pos, round(score, 6) AS score FROM s WHERE role = 1")
def calibration_scores(spark, sf_dir):
    """All calibration scores in upload order, as the detector's version keeps them."""
    scores = _scores(spark, sf_dir).where("role = 1").select("image_id", _r("score").alias("score"))
    return numbered(scores, ["image_id"], "pos").select(F.col("pos").cast("int").alias("pos"), "score")


def _verdict_sql(q: float) -> str:
    return D + f""", t AS (SELECT quantile_cont(score, {q}) AS threshold FROM s WHERE role = 1)
SELECT image_id, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_anomaly, coalesce(threshold = 0, false) AS threshold_is_zero FROM s, t WHERE role = 2"""


def _verdict(spark: SparkSession, sf_dir: str, q: float) -> DataFrame:
    scores = _scores(spark, sf_dir)
    out = verdicts(scores.where("role = 2"), threshold_of(scores.where("role = 1"), q))
    return out.select("image_id", _r("score").alias("score"), _r("threshold").alias("threshold"), "is_anomaly", "threshold_is_zero")


@query(_verdict_sql(0.95))
def inspect_verdict(spark, sf_dir):
    return _verdict(spark, sf_dir, 0.95)


@query(_verdict_sql(0.5))
def inspect_verdict_median(spark, sf_dir):
    return _verdict(spark, sf_dir, 0.5)


@query(
    """WITH d AS (SELECT vec_id // 10 AS image_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE (vec_id // 10) % 3 = 1),
n AS (SELECT a.image_id, min(list_distance(a.v, b.v)) AS d FROM d a, d b GROUP BY a.image_id, a.v),
t AS (SELECT quantile_cont(score, 0.95) AS threshold, max(score) AS largest FROM (SELECT image_id, max(d) AS score FROM n GROUP BY image_id))
SELECT threshold, threshold = 0 AS threshold_is_zero, CASE WHEN threshold > 0 THEN threshold * 2 WHEN largest > 0 THEN largest ELSE 1.0 END AS color_scale_vmax FROM t"""
)
def threshold_zero_flag(spark, sf_dir):
    own = descriptors(spark, sf_dir).where("role = 1")
    scores = image_score(nearest_distance(own, own.select("descriptor")))
    one = scores.agg(linear_quantile("score", 0.95).alias("threshold"), F.max("score").alias("largest"))
    return one.select("threshold", is_zero(F.col("threshold")).alias("threshold_is_zero"), colour_bound(F.col("threshold"), F.col("largest")).alias("color_scale_vmax"))


FPS = """p AS MATERIALIZED (SELECT list(v ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids FROM d WHERE role = 0),
f(k, pick, m, used) AS (
  SELECT 0, 1, list_transform(vs, lambda x: CAST('infinity' AS DOUBLE)), [1] FROM p
  UNION ALL
  SELECT k + 1, list_position(c, list_max(c)), m2, list_append(used, list_position(c, list_max(c))) FROM (
    SELECT k, used, m2, list_transform(range(1, len(m2) + 1), lambda i: CASE WHEN list_contains(used, i) THEN -1.0 ELSE m2[i] END) AS c
    FROM (SELECT k, used, list_transform(range(1, len(m) + 1), lambda i: least(m[i], list_distance(vs[i], vs[pick]))) AS m2 FROM f, p WHERE k < 15)))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(D) + ", " + FPS + " SELECT CAST(k AS INT) AS bank_pos, ids[pick] AS vec_id FROM f, p")
def farthest_points_16(spark, sf_dir):
    d = descriptors(spark, sf_dir).where("role = 0")
    return farthest_points(d, 16, ("vec_id",), keep_order=True).select("bank_pos", "vec_id")


@query(_recursive(D) + ", " + FPS + " SELECT CAST(k AS INT) AS bank_pos, ids[pick] AS vec_id FROM f, p")
def farthest_points_lazy(spark, sf_dir):
    """The same picks by the way that banks beyond one task take."""
    known = descriptors(spark, sf_dir).where("role = 0").select("vec_id", F.col("descriptor").alias("v"))
    picks = [(k, key[0]) for k, (key, _) in enumerate(lazy_picks(known, 16, ("vec_id",)))]
    return spark.createDataFrame(picks, "bank_pos int, vec_id long")


@query()
def farthest_points_256(spark, sf_dir):
    """The bank at its production size (``BANK_SIZE`` picks)."""
    return farthest_points(descriptors(spark, sf_dir).where("role = 0"), order=("vec_id",))


@query(
    _recursive(D)
    + ", "
    + FPS
    + """, fb AS (SELECT vs[pick] AS v FROM f, p),
fn AS (SELECT d.image_id, d.role, min(list_distance(d.v, fb.v)) AS d FROM d, fb WHERE d.role > 0 GROUP BY d.vec_id, d.image_id, d.role),
fs AS (SELECT image_id, role, max(d) AS score FROM fn GROUP BY image_id, role),
ft AS (SELECT quantile_cont(score, 0.95) AS threshold FROM fs WHERE role = 1)
SELECT image_id, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_anomaly FROM fs, ft WHERE role = 2"""
)
def bank_from_fps_verdict(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    bank = farthest_points(d.where("role = 0"), 16, ("vec_id",))
    scores = nearest_distance(d.where("role > 0"), bank).groupBy("image_id", "role").agg(F.max("d").alias("score"))
    out = verdicts(scores.where("role = 2"), threshold_of(scores.where("role = 1")))
    return out.select("image_id", _r("score").alias("score"), _r("threshold").alias("threshold"), "is_anomaly")


@query(D + " SELECT image_id, CAST(cell // 5 AS INT) AS gy, CAST(cell % 5 AS INT) AS gx, round(d, 6) AS d FROM n WHERE role = 2")
def distance_grid(spark, sf_dir):
    rows = _local(spark, sf_dir).where("role = 2").groupBy("image_id").agg(ordered_values("cell", "d").alias("grid"))
    cells = rows.select("image_id", F.posexplode("grid").alias("cell", "d"))
    return cells.select("image_id", F.expr("cast(cell div 5 as int)").alias("gy"), (F.col("cell") % 5).alias("gx"), _r("d").alias("d"))


UP = """, g AS (SELECT image_id, cell // 5 AS gy, cell % 5 AS gx, d FROM n WHERE role = 2),
wx AS (SELECT o, least(4, greatest(0, t)) AS s, sum(greatest(0, 1 - abs(t + 0.5 - (o + 0.5) * 0.5))) AS w FROM range(10) AS a(o), range(-2, 7) AS b(t) GROUP BY o, s HAVING w > 0),
wy AS (SELECT o, least(1, greatest(0, t)) AS s, sum(greatest(0, 1 - abs(t + 0.5 - (o + 0.5) * 0.5))) AS w FROM range(4) AS a(o), range(-2, 4) AS b(t) GROUP BY o, s HAVING w > 0),
u AS (SELECT image_id, CAST(wy.o AS INT) AS gy, CAST(wx.o AS INT) AS gx, sum(d * wx.w * wy.w) AS d FROM g JOIN wx ON gx = wx.s JOIN wy ON gy = wy.s GROUP BY image_id, wy.o, wx.o)"""


def _upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _local(spark, sf_dir).where("role = 2").select("image_id", F.expr("cast(cell div 5 as int)").alias("gy"), (F.col("cell") % 5).alias("gx"), "d")
    return resize_grid(grid, 2, 5, 4, 10)


@query(D + UP + " SELECT image_id, gy, gx, round(d, 6) AS d FROM u")
def upscale_bilinear(spark, sf_dir):
    return _upscaled(spark, sf_dir).select("image_id", "gy", "gx", _r("d").alias("d"))


JET_SQL = ", ".join(f"CAST(round_even(greatest(0, least(1, least(4 * x - {a}, {b} - 4 * x))) * 255, 0) AS INT) AS {c}" for c, a, b in (("r", 1.5, 4.5), ("g", 0.5, 3.5), ("b", "(-0.5)", 2.5)))


@query(f"SELECT DISTINCT l_discount, {JET_SQL} FROM (SELECT l_discount, CAST(l_discount * 10 AS DOUBLE) AS x FROM lineitem)")
def jet_colormap(spark, sf_dir):
    r, g, b = jet((F.col("l_discount") * 10).cast("double"))
    return _table(spark, sf_dir, "lineitem").select("l_discount", r.alias("r"), g.alias("g"), b.alias("b")).distinct()


QUERY_HEAT = (
    D
    + UP
    + f""", t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM s WHERE role = 1),
m AS (SELECT *, max(d) OVER (PARTITION BY image_id) AS largest FROM u),
x AS (SELECT image_id, gy, gx, greatest(0, least(1, round(d / CASE WHEN threshold > 0 THEN threshold * 2 WHEN largest > 0 THEN largest ELSE 1.0 END, 9))) AS x FROM m, t)
SELECT image_id, gy, gx, {JET_SQL} FROM x"""
)


@query(QUERY_HEAT)
def heatmap_pixels(spark, sf_dir):
    local = _local(spark, sf_dir)
    scores = local.groupBy("image_id", "role").agg(F.max("d").alias("score"))
    threshold = threshold_of(scores.where("role = 1")).select("threshold")
    large = _upscaled(spark, sf_dir)
    most = large.groupBy("image_id").agg(F.max("d").alias("largest"))
    level = colour_level(F.round(F.col("d") / colour_bound(F.col("threshold"), F.col("largest")), 9), F.lit(1.0))
    r, g, b = jet(F.col("level"))
    return large.join(most, "image_id").crossJoin(F.broadcast(threshold)).withColumn("level", level).select("image_id", "gy", "gx", r.alias("r"), g.alias("g"), b.alias("b"))


@query(QUERY_HEAT)
def heatmap_images(spark, sf_dir):
    """The same pictures, made a whole image at a time; pixels are told only to be compared."""
    local = _local(spark, sf_dir)
    threshold = threshold_of(local.groupBy("image_id", "role").agg(F.max("d").alias("score")).where("role = 1")).select("threshold")
    cells = local.where("role = 2").select("image_id", F.expr("cast(cell div 5 as int)").alias("gy"), (F.col("cell") % 5).alias("gx"), "d")
    grids = partial_grid_rows(cells, "image_id", 2, 5).crossJoin(F.broadcast(threshold)).select("image_id", "grid", "threshold", F.lit(10).alias("width"), F.lit(4).alias("height"))
    pixels = heat_images(grids, "image_id", 2, 5).select("image_id", "width", F.hex("reached").alias("reached"), F.posexplode(F.split(F.regexp_replace(F.hex("rgb"), "(......)", "$1 "), " ")).alias("place", "colour"))
    # An image that lacks cells has no pixels where none of its cells reaches.
    pixels = pixels.where("colour <> '' and substring(reached, 2 * place + 2, 1) = '1'")
    channel = {c: F.conv(F.substring("colour", k, 2), 16, 10).cast("int").alias(c) for c, k in (("r", 1), ("g", 3), ("b", 5))}
    return pixels.select("image_id", F.expr("cast(place div width as int)").alias("gy"), (F.col("place") % F.col("width")).alias("gx"), *channel.values())


@query("SELECT o_orderkey, CAST(floor((o_orderkey % 256) * (1.0 - a) + ((o_orderkey * 7) % 256) * a) AS INT) AS v FROM (SELECT o_orderkey, greatest(0.0, least(1.0, ((o_orderkey % 9) - 2) / 4.0::DOUBLE)) AS a FROM orders)")
def alpha_blend(spark, sf_dir):
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(key, blend((key % 256).cast("double"), ((key * 7) % 256).cast("double"), ((key % 9) - 2) / 4.0).alias("v"))


@query(
    """SELECT p_partkey, CAST(p_partkey % 3 AS INT) AS channel,
  round(((p_partkey % 256) / 255.0::DOUBLE - CASE p_partkey % 3 WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END) / CASE p_partkey % 3 WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END, 6) AS v FROM part"""
)
def normalize_channels(spark, sf_dir):
    key = F.col("p_partkey")
    channel = (key % 3).cast("int")
    return _table(spark, sf_dir, "part").select(key, channel.alias("channel"), _r(normalised((key % 256).cast("double"), channel)).alias("v"))


SAMPLES_SQL = """WITH u AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'reference' ELSE 'calibration' END AS grp, source AS filename, text,
  'resized224-' || substr(sha256(text), 1, 32) AS content_id, CAST(n_chars % 640 AS INT) AS width, CAST(n_chars % 480 AS INT) AS height FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY seq) AS rn FROM u)"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_uploads(_table(spark, sf_dir, "documents"))


def _as_uploads(documents: DataFrame) -> DataFrame:
    docs = documents.where(F.col("text").isNotNull())
    digest = F.concat(F.lit("resized224-"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    return docs.select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, "reference").otherwise("calibration").alias("group"), F.col("source").alias("filename"), F.col("text").cast("binary").alias("raw"), digest.alias("content_id"), (F.col("n_chars") % 640).cast("int").alias("width"), (F.col("n_chars") % 480).cast("int").alias("height")
    )


def _none(spark: SparkSession) -> DataFrame:
    from ..schema import SAMPLE

    return spark.createDataFrame([], SAMPLE)


@query(SAMPLES_SQL + """ SELECT upper(substr(grp, 1, 1)) || ':' || substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS tag, substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS sample_id, filename, content_id, width, height, seq FROM k WHERE rn = 1""")
def ingest_samples(spark, sf_dir):
    accepted, _ = catalog.ingest(_none(spark), _uploads(spark, sf_dir))
    return accepted.select(F.concat(F.upper(F.substring("group", 1, 1)), F.lit(":"), "sample_id").alias("tag"), "sample_id", "filename", "content_id", "width", "height", "seq")


@query(SAMPLES_SQL + " SELECT k.seq, 'identical image content is already in ' || f.grp AS reason FROM k JOIN (SELECT content_id, grp FROM k WHERE rn = 1) f USING (content_id) WHERE rn > 1")
def rejected_uploads(spark, sf_dir):
    _, rejected = catalog.ingest(_none(spark), _uploads(spark, sf_dir))
    return rejected.select("seq", "reason")


@query("SELECT 'resized224-' || substr(sha256(text), 1, 32) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark, sf_dir):
    return catalog.first_of_content(_uploads(spark, sf_dir).withColumnRenamed("seq", "doc_id"), "content_id", "doc_id")


@query(SAMPLES_SQL + " SELECT content_id FROM u WHERE grp = 'reference' INTERSECT SELECT content_id FROM u WHERE grp = 'calibration'")
def cross_group_overlap(spark, sf_dir):
    return catalog.overlap(_uploads(spark, sf_dir))


@query(SAMPLES_SQL + " SELECT seq, substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS sample_id, coalesce(nullif(filename, ''), 'upload') AS filename FROM u")
def sample_ids(spark, sf_dir):
    from ..functions.ids import sample_id

    return _uploads(spark, sf_dir).select("seq", sample_id(F.col("group"), F.col("raw")).alias("sample_id"), filename_or_default(F.col("filename")).alias("filename"))


@query("SELECT count(*) FILTER (doc_id % 2 = 0) AS reference_count, count(*) FILTER (doc_id % 2 = 1) AS calibration_count FROM documents WHERE text IS NOT NULL")
def group_counts(spark, sf_dir):
    return catalog.group_counts(_uploads(spark, sf_dir))


@query(D + """, t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM s WHERE role = 1)
SELECT (SELECT count(DISTINCT image_id) FROM d WHERE role = 0) AS reference_count, (SELECT count(DISTINCT image_id) FROM d WHERE role = 1) AS calibration_count, (SELECT count(*) FROM bank) AS memory_bank_items, round(threshold, 6) AS threshold, coalesce(threshold = 0, false) AS threshold_is_zero FROM t""")
def detector_status(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    counts = d.agg(F.count_distinct(F.when(F.col("role") == 0, F.col("image_id"))).alias("reference_count"), F.count_distinct(F.when(F.col("role") == 1, F.col("image_id"))).alias("calibration_count"), F.count_if(F.col("role") == 0).alias("memory_bank_items"))
    threshold = threshold_of(_scores(spark, sf_dir).where("role = 1"))
    return counts.crossJoin(F.broadcast(threshold)).select("reference_count", "calibration_count", "memory_bank_items", _r("threshold").alias("threshold"), is_zero(F.col("threshold")).alias("threshold_is_zero"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def orphan_filter(spark, sf_dir):
    return catalog.with_files(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_sample(spark, sf_dir):
    return catalog.delete(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query(SAMPLES_SQL + " SELECT substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS sample_id, filename, width, height FROM k WHERE rn = 1 AND grp = 'reference'")
def list_samples(spark, sf_dir):
    accepted, _ = catalog.ingest(_none(spark), _uploads(spark, sf_dir))
    return catalog.list_samples(accepted, "reference")


@query("SELECT a.vec_id, CAST(len(list_concat(a.embedding, b.embedding)) AS INT) AS dims, round(CAST(list_concat(a.embedding, b.embedding)[1] AS DOUBLE), 6) AS first, round(CAST(list_concat(a.embedding, b.embedding)[len(a.embedding) + 1] AS DOUBLE), 6) AS second FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def concat_features(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    both = e.join(following, "vec_id").select("vec_id", F.size("v").alias("n"), F.concat("v", "w").alias("v"))
    return both.select("vec_id", F.size("v").alias("dims"), _r(F.element_at("v", 1)).alias("first"), _r(F.element_at("v", F.col("n") + 1)).alias("second"))


@query(
    """SELECT page_id, CAST(CASE WHEN NOT grp IN ('reference', 'calibration') THEN 404 WHEN NOT lower(mime) IN ('image/png', 'image/jpeg', 'image/jpg') THEN 415 WHEN size > 10485760 THEN 413 WHEN page_id % 7 = 0 THEN 400 ELSE 200 END AS INT) AS status FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'calibration' ELSE 'other' END AS grp, CASE page_id % 5 WHEN 0 THEN 'IMAGE/PNG' WHEN 1 THEN 'image/gif' ELSE 'image/jpeg' END AS mime, strlen(html) * 2000 AS size FROM pages)"""
)
def validate_upload(spark, sf_dir):
    key = F.col("page_id")
    group = F.when(key % 3 == 0, "reference").when(key % 3 == 1, "calibration").otherwise("other")
    mime = F.when(key % 5 == 0, "IMAGE/PNG").when(key % 5 == 1, "image/gif").otherwise("image/jpeg")
    return _table(spark, sf_dir, "pages").select(key, upload_status(group, mime, F.octet_length("html") * 2000, key % 7 != 0).alias("status"))


@query(
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'PNG' WHEN page_id % 3 = 1 THEN 'JPEG' END AS format, base64(encode(substr(url, 1, 12))) AS head FROM pages"
)
def image_formats(spark, sf_dir):
    key = F.col("page_id")
    magic = F.when(key % 3 == 0, F.lit("89504E470D0A1A0A")).when(key % 3 == 1, F.lit("FFD8FFE0")).otherwise(F.hex(F.substring("html", 1, 8)))
    return _table(spark, sf_dir, "pages").select(key, image_format(F.unhex(magic)).alias("format"), F.base64(F.substring("url", 1, 12).cast("binary")).alias("head"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, n_chars DESC NULLS LAST, doc_id) + 99 AS place FROM documents")
def numbered_documents(spark, sf_dir):
    """Places in an order of the whole table, from counts of its ranges."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return numbered(docs, ["source", F.desc("n_chars"), "doc_id"], "place", 100).select("doc_id", "place")


def _taps_sql(name: str, source: int, target: int) -> str:
    """Integer weights of one axis as rows o, s, k."""
    step, wide = source / target, max(source / target, 1.0)
    return f"""{name}_w AS (SELECT o, s, greatest(0, 1 - abs((s - (o + 0.5) * {step}::DOUBLE + 0.5) / {wide}::DOUBLE)) AS w FROM range({target}) AS a(o), range({source}) AS b(s)),
{name} AS (SELECT o, s, CAST(floor(w / sum(w) OVER (PARTITION BY o) * 4194304 + 0.5) AS BIGINT) AS k FROM {name}_w)"""


@query(
    f"""WITH {_taps_sql("wx", 8, 5)}, {_taps_sql("wy", 8, 11)},
p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor(greatest(0, least(255, 128 + 300 * CAST(embedding[i] AS DOUBLE)))) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
h AS (SELECT vec_id, y, o AS x, greatest(0, least(255, (sum(v * k) + 2097152) // 4194304)) AS v FROM p JOIN wx ON x = s GROUP BY vec_id, y, o),
r AS (SELECT vec_id, o AS y, x, greatest(0, least(255, (sum(v * k) + 2097152) // 4194304)) AS v FROM h JOIN wy ON y = s GROUP BY vec_id, o, x)
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS INT) AS v FROM r"""
)
def resampled_bytes(spark, sf_dir):
    """Each vector as a picture of 8 x 8 bytes, resampled to 11 x 5 in fixed point."""
    level = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 300 + 128))).cast("int"))
    pictures = _table(spark, sf_dir, "embeddings").select("vec_id", level.alias("level"))

    def resize(frames):
        for f in frames:
            small = [resize_axis(resize_axis(np.array(v, dtype=np.uint8).reshape(8, 8, 1), 5, 1), 11, 0).ravel().astype(np.int32) for v in f["level"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "level": small})

    cells = pictures.mapInPandas(resize, "vec_id long, level array<int>").select("vec_id", F.posexplode("level").alias("place", "v"))
    return cells.select("vec_id", F.expr("cast(place div 5 as int)").alias("y"), (F.col("place") % 5).alias("x"), "v")


#: Weights of a stem of two channels, for the query below and its SQL.
STEM = {
    "conv1.weight": np.array([[[[0.5, -0.25, 1.0], [0.75, 2.0, -1.0], [0.25, -0.5, 0.125]]], [[[-1.0, 0.5, 0.25], [1.5, -0.75, 0.5], [1.0, 0.25, -2.0]]]]),
    "bn1.weight": np.array([1.5, 0.75]),
    "bn1.bias": np.array([0.125, -0.0625]),
    "bn1.running_mean": np.array([0.25, -0.5]),
    "bn1.running_var": np.array([2.0, 0.5]),
}


def _stem_sql() -> str:
    rows = ", ".join(f"({c}, {dy}, {dx}, {STEM['conv1.weight'][c, 0, dy, dx]})" for c in range(2) for dy in range(3) for dx in range(3))
    norms = ", ".join(f"({c}, " + ", ".join(str(STEM[f"bn1.{part}"][c]) for part in ("weight", "bias", "running_mean", "running_var")) + ")" for c in range(2))
    return f"""WITH p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
w(c, dy, dx, k) AS (VALUES {rows}), g(c, gain, shift, mean, var) AS (VALUES {norms}),
a AS (SELECT vec_id, c, oy, ox, sum(v * k) AS v FROM w, range(4) AS r(oy), range(4) AS q(ox), p WHERE p.y = 2 * oy + dy - 1 AND p.x = 2 * ox + dx - 1 GROUP BY ALL),
n AS (SELECT vec_id, c, oy, ox, greatest(0, (v - mean) / sqrt(var + 1e-5) * gain + shift) AS v FROM a JOIN g USING (c)),
m AS (SELECT vec_id, c, py, px, max(v) AS v FROM n, range(2) AS r(py), range(2) AS q(px) WHERE oy BETWEEN 2 * py - 1 AND 2 * py + 1 AND ox BETWEEN 2 * px - 1 AND 2 * px + 1 GROUP BY ALL)
SELECT vec_id, CAST(py AS INT) AS y, CAST(px AS INT) AS x, CAST(c AS INT) AS channel, round(v, 6) AS v FROM m"""


@query(_stem_sql())
def stem_features(spark, sf_dir):
    """Each vector as an 8 x 8 picture of one channel through a stem: convolution with its norm folded in, rectified, pooled."""
    pictures = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    handle = spark.sparkContext.broadcast(Conv.folded(STEM, "conv1", "bn1", 2, np.float64))

    def run(frames):
        for f in frames:
            maps = [max_pool(relu(handle.value(np.array(v, dtype=np.float64).reshape(8, 8, 1)))).ravel() for v in f["v"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": maps})

    cells = pictures.mapInPandas(run, "vec_id long, v array<double>").select("vec_id", F.posexplode("v").alias("place", "v"))
    place = F.col("place")
    return cells.select("vec_id", F.expr("cast(place div 4 as int)").alias("y"), F.expr("cast(place div 2 % 2 as int)").alias("x"), (place % 2).alias("channel"), _r("v").alias("v"))


@query(
    SAMPLES_SQL
    + """, one AS (SELECT * FROM u WHERE seq % 4 < 2 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY seq) = 1),
two AS (SELECT * FROM u WHERE seq % 4 >= 2 AND content_id NOT IN (SELECT content_id FROM one) QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY seq) = 1)
SELECT seq, grp AS "group", content_id FROM (FROM one UNION ALL FROM two)"""
)
def stored_by_two_writers(spark, sf_dir):
    """Half the uploads by each of two writers that have both read the empty store; what the second adds is compared with the state it finds."""
    root = scratch_path(spark, "store")
    uploads = _uploads(spark, sf_dir)
    writers = [StateStore(spark, root), StateStore(spark, root)]
    halves = [catalog.ingest(_none(spark), uploads.where(half))[0] for half in ("seq % 4 < 2", "seq % 4 >= 2")]
    for writer, own in zip(writers, halves, strict=True):
        writer.add(own, own.select("sample_id", F.lit(b"").alias("png")))
    return StateStore(spark, root).samples().select("seq", "group", "content_id")


@query(SAMPLES_SQL + " SELECT substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS sample_id, filename, content_id, width, height, seq FROM k WHERE rn = 1")
def streamed_samples(spark, sf_dir):
    """The uploads as a stream of files that have arrived, taken up in one batch, twice: the repeated batch adds nothing."""
    root = scratch_path(spark, "arrivals")
    store = StateStore(spark, root)
    # A pattern, as a stream takes a single file by no other name; it fits folders as well.
    arriving = spark.readStream.schema(_table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")

    def take(batch: DataFrame, number: int) -> None:
        uploads = _as_uploads(batch).withColumn("png", F.lit(b""))
        for _ in range(2):
            add_uploads(store, uploads, root, number)

    arriving.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.samples().select("sample_id", "filename", "content_id", "width", "height", "seq")


QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@query(" UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(n_chars, {q}), 6) AS n_chars FROM documents" for q in QUANTILES))
def exact_length_quantiles(spark, sf_dir):
    """Quantiles of a whole column by rounds of range counting."""
    values = exact_quantiles(_table(spark, sf_dir, "documents"), "n_chars", list(QUANTILES))
    return spark.createDataFrame([(q, v) for q, v in zip(QUANTILES, values, strict=True)], "q double, n_chars double").select("q", _r("n_chars").alias("n_chars"))


@query("SELECT source, round(quantile_cont(n_chars, 0.0), 6) AS q0, round(quantile_cont(n_chars, 0.95), 6) AS q95, round(quantile_cont(n_chars, 1.0), 6) AS q1 FROM documents GROUP BY source")
def quantile_by_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(*(_r(linear_quantile("n_chars", q)).alias(n) for n, q in (("q0", 0.0), ("q95", 0.95), ("q1", 1.0))))


@query(SAMPLES_SQL + """ SELECT seq, CAST(to_json({'sample_id': substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16), 'filename': coalesce(nullif(filename, ''), 'upload'), 'content_id': content_id, 'width': width, 'height': height, 'group': grp}) AS VARCHAR) AS sample FROM k WHERE rn = 1""")
def state_json(spark, sf_dir):
    """The state document, one sample a row."""
    accepted, _ = catalog.ingest(_none(spark), _uploads(spark, sf_dir))
    sample = F.struct("sample_id", "filename", "content_id", "width", "height", "group")
    return accepted.select("seq", F.to_json(sample, {"ignoreNullFields": "false"}).alias("sample"))


@query(
    SAMPLES_SQL
    + """, a AS (SELECT k.*, n_chars FROM k JOIN documents ON seq = doc_id WHERE rn = 1), t AS (SELECT round(quantile_cont(n_chars, 0.95), 6) AS threshold, count(*) AS n_scores FROM a WHERE grp = 'calibration')
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, substr(grp, 1, 1) || '-' || substr(sha256(text), 1, 16) AS sample_id, coalesce(nullif(filename, ''), 'upload') AS filename, content_id, width, height, grp AS "group", threshold, n_scores FROM a, t"""
)
def state_document_read(spark, sf_dir):
    """The whole state document, out as JSON and in again; the calibration documents' lengths serve as scores."""
    accepted, _ = catalog.ingest(_none(spark), _uploads(spark, sf_dir))
    lengths = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("n_chars").cast("double").alias("score"))
    scores = accepted.where(F.col("group") == "calibration").select("seq").join(lengths, "seq")
    detector = scores.agg(linear_quantile("score", 0.95).alias("threshold"), ordered_values("seq", "score").alias("calibration_scores"), F.lit("2001-02-03T04:05:06+00:00").alias("built_at"))
    samples, numbers = from_document(as_document(accepted, detector))
    told = numbers.select(_r("threshold").alias("threshold"), F.size("calibration_scores").cast("long").alias("n_scores"))
    return samples.crossJoin(F.broadcast(told))


@query(
    """WITH e AS (SELECT vec_id // 16 AS image_id, CAST(vec_id % 16 AS INT) AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT image_id, cell // 2 AS cy, cell % 2 AS cx, v FROM e WHERE cell < 4),
wx AS (SELECT o, least(1, greatest(0, t)) AS s, sum(greatest(0, 1 - abs(t + 0.5 - (o + 0.5) * 0.5))) AS w FROM range(4) AS a(o), range(-2, 4) AS b(t) GROUP BY o, s HAVING w > 0),
wy AS (SELECT * FROM wx),
u AS (SELECT image_id, CAST(wy.o * 4 + wx.o AS INT) AS cell, sum(v[1] * wx.w * wy.w) AS first, sum(v[-1] * wx.w * wy.w) AS last FROM c JOIN wx ON cx = wx.s JOIN wy ON cy = wy.s GROUP BY 1, 2)
SELECT e.image_id, e.cell, CAST(2 * len(e.v) AS INT) AS dims, round(e.v[1], 6) AS fine_first, round(u.first, 6) AS coarse_first, round(u.last, 6) AS coarse_last
FROM e JOIN u USING (image_id, cell) WHERE image_id IN (SELECT image_id FROM c GROUP BY image_id HAVING count(*) = 4)"""
)
def aligned_features(spark, sf_dir):
    """Sixteen vectors are an image's 4 x 4 grid; its first four serve as the coarser 2 x 2 grid."""
    e = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("image_id"), (F.col("vec_id") % 16).cast("int").alias("cell"), F.col("embedding").alias("descriptor"))
    whole = concat_grids(e, e.where("cell < 4"), (4, 4), (2, 2), "image_id").where("descriptor is not null")
    v, dims = F.col("descriptor"), F.size("descriptor")
    return whole.select("image_id", "cell", dims.alias("dims"), _r(F.element_at(v, 1)).alias("fine_first"), _r(F.element_at(v, F.expr("size(descriptor) div 2 + 1").cast("int"))).alias("coarse_first"), _r(F.element_at(v, -1)).alias("coarse_last"))
