import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.functions.ids import filename_or_default, image_format, upload_status
from normscope.functions.raster import axis_weights, colour_bound, encode_png, jet, resize_axis, resize_grid, triangle_resize
from normscope.functions.stats import linear_quantile, require_quantile
from normscope.functions.vectors import least_distances
from normscope.operators import catalog
from normscope.operators.assembly import concat_grids
from normscope.operators.neighbours import nearest_distance, nearest_distance_expr
from normscope.operators.scoring import is_anomaly, is_zero
from normscope.operators.selection import farthest_points, farthest_rows
from normscope.schema import SAMPLE


def test_quantile_interpolates_between_order_statistics(spark):
    values = spark.createDataFrame([(float(x),) for x in (8, 3, 5, 13, 2, 21, 1, 34)], "x double")
    assert require_quantile(values, "x", 0.95) == pytest.approx(21 + 0.65 * 13)
    assert require_quantile(values, "x", 0.0) == 1.0
    assert require_quantile(values, "x", 1.0) == 34.0
    assert require_quantile(values.where("x = 13"), "x", 0.95) == 13.0


def test_quantile_of_nothing_and_outside_the_unit_interval(spark):
    with pytest.raises(ValueError):
        require_quantile(spark.createDataFrame([], "x double"), "x", 0.5)
    for q in (-0.1, 1.1):
        with pytest.raises(ValueError):
            linear_quantile("x", q)


def _points(spark, rows):
    return spark.createDataFrame([(0, k, [float(x) for x in v] if v is not None else None) for k, v in enumerate(rows)], "seq long, cell int, descriptor array<double>")


def _picked(df):
    return [tuple(r["descriptor"]) for r in df.orderBy("bank_pos").collect()]


def test_farthest_points_start_at_the_first_row_and_take_the_first_of_ties(spark):
    points = _points(spark, [(1, 1), (1, 1), (7, 1), (1, 9), (-7, 1)])
    assert _picked(farthest_points(points, 4)) == [(1, 1), (1, 9), (-7, 1), (7, 1)]
    assert len(_picked(farthest_points(points, 9))) == 5


def test_farthest_points_edge_cases(spark):
    assert _picked(farthest_points(_points(spark, []), 3)) == []
    assert _picked(farthest_points(_points(spark, [(1, 1)] * 3), 2)) == [(1, 1), (1, 1)]
    assert _picked(farthest_points(_points(spark, [None, (2, 2)]), 2)) == [(2, 2)]


def test_farthest_points_by_passes_picks_the_same(spark):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 6, (60, 3)).tolist()
    points = _points(spark, rows)
    want = [tuple(map(float, rows[p])) for p in farthest_rows(np.array(rows, dtype=float), 9)]
    assert _picked(farthest_points(points, 9)) == want
    assert _picked(farthest_points(points, 9, one_task_numbers=10)) == want


@pytest.mark.parametrize("most", [4096, 7])
def test_nearest_distance_equals_brute_force(spark, most):
    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(50, 5)), rng.normal(size=(20, 5))
    b[0] = q[0]
    queries, bank = _points(spark, [*q, None]), _points(spark, b).select("descriptor")
    got = {r["cell"]: r["d"] for r in nearest_distance(queries, bank, broadcast_rows=most).collect()}
    want = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert got[50] is None and got[0] == 0.0
    assert np.allclose([got[k] for k in range(50)], want)
    if most > 7:
        expr = {r["cell"]: r["d"] for r in nearest_distance_expr(queries.where("cell < 50"), bank, ["cell"]).collect()}
        assert np.allclose([expr[k] for k in range(50)], want)


def test_nearest_distance_to_an_empty_bank_is_null(spark):
    queries = _points(spark, [(1, 2)])
    assert [r["d"] for r in nearest_distance(queries, queries.select("descriptor").limit(0)).collect()] == [None]


def test_verdict_is_strict_and_zero_flag_is_false_without_threshold(spark):
    row = spark.range(1).select(is_anomaly(F.lit(2.0), F.lit(2.0)).alias("a"), is_anomaly(F.lit(2.1), F.lit(2.0)).alias("b"), is_zero(F.lit(0.0)).alias("c"), is_zero(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == (False, True, True, False)


def test_colour_scale_and_map(spark):
    row = spark.range(1).select(*(c.alias(f"{k}{n}") for k, x in enumerate((0.0, 0.5, 1.0, 0.15)) for n, c in enumerate(jet(F.lit(x)))), colour_bound(F.lit(3.0), F.lit(9.0)).alias("t"), colour_bound(F.lit(0.0), F.lit(9.0)).alias("m"), colour_bound(F.lit(0.0), F.lit(0.0)).alias("o")).first()
    assert tuple(row)[:9] == (0, 0, 128, 128, 255, 128, 128, 0, 0)
    assert abs(row[10] - 26) <= 1 and row[11] == 255
    assert tuple(row)[12:] == (6.0, 9.0, 1.0)


def test_resizing_keeps_constants_and_matches_numpy(spark):
    flat = spark.createDataFrame([(1, y, x, 3.0) for y in range(4) for x in range(4)], "image_id int, gy int, gx int, d double")
    for size in (8, 3):
        rows = resize_grid(flat, 4, 4, size, size).collect()
        assert len(rows) == size * size and all(r["d"] == pytest.approx(3.0) for r in rows)
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert np.array_equal(triangle_resize(image, 4, 4), image)
    assert triangle_resize(image, 2, 8).shape == (2, 8, 3)


@pytest.mark.parametrize(
    "row, target, want",
    [
        # Shrinking to half: 3, 3 and 1 sevenths from a border: (3 * 100 + 200) / 7 and (100 + 3 * 200 + 3 * 50) / 7.
        ([0, 100, 200, 50], 2, [71, 121]),
        # Growing to double: three quarters and one quarter; half a byte is rounded up.
        ([10, 20], 4, [10, 13, 18, 20]),
        # From three to two: the outer place weighs 5/6, the middle one 1/2, so 3/8 of 255.
        ([0, 255, 0], 2, [96, 96]),
        ([7], 3, [7, 7, 7]),
        ([1, 2, 3], 3, [1, 2, 3]),
    ],
)
def test_resampled_bytes_equal_rows_by_hand(row, target, want):
    image = np.repeat(np.array(row, dtype=np.uint8)[None, :, None], 3, axis=2)
    assert resize_axis(image, target, 1)[0, :, 0].tolist() == want
    assert resize_axis(image.transpose(1, 0, 2), target, 0)[:, 0, 1].tolist() == want
    both = triangle_resize(np.repeat(image, 2, axis=0), 2, target)
    assert both.shape == (2, target, 3) and both[1, :, 2].tolist() == want


def test_resampling_rounds_between_the_passes():
    image = np.array([[[0], [1]], [[1], [1]], [[0], [0]], [[0], [1]]], dtype=np.uint8).repeat(3, axis=2)
    across = [[0.5], [1], [0], [0.5]]  # means of two, of which a half becomes 1
    assert resize_axis(image, 1, 1)[:, 0, 0].tolist() == [1, 1, 0, 1]
    assert triangle_resize(image, 2, 1)[:, 0, 0].tolist() == [1, 1] and np.mean(across) == 0.5
    wide = np.random.default_rng(0).integers(0, 256, (37, 91, 3)).astype(np.uint8)
    small = triangle_resize(wide, 11, 20)
    exact = np.einsum("hwc,oh,pw->opc", wide.astype(float), axis_weights(37, 11), axis_weights(91, 20))
    assert np.abs(small - exact).max() <= 1.01


def test_formats_and_upload_checks(spark):
    png = encode_png(np.zeros((2, 2, 3), dtype=np.uint8))
    rows = spark.createDataFrame([(png,), (b"\xff\xd8\xff\xe0",), (b"not an image",), (b"",), (None,)], "content binary")
    assert [r[0] for r in rows.select(image_format(F.col("content"))).collect()] == ["PNG", "JPEG", None, None, None]
    limit = 10 * 1024 * 1024
    checks = [("reference", "image/png", limit, True, 200), ("reference", "IMAGE/JPEG", limit + 1, True, 413), ("other", "image/png", 1, True, 404), (None, "image/png", 1, True, 404), ("calibration", "text/html", 1, True, 415), ("calibration", "image/jpg", 1, False, 400)]
    frame = spark.createDataFrame(checks, "g string, m string, n long, ok boolean, want int")
    assert all(r[0] == r[1] for r in frame.select(upload_status(F.col("g"), F.col("m"), F.col("n"), F.col("ok")), "want").collect())
    names = spark.createDataFrame([("a.png",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(filename_or_default(F.col("n"))).collect()] == ["a.png", "upload", "upload"]


def test_ingest_rejects_equal_content_in_either_group(spark):
    kind = "group string, filename string, raw binary, content_id string, width int, height int, seq long"
    uploads = spark.createDataFrame([("reference", "a", b"a", "A", 1, 1, 1), ("calibration", "b", b"b", "A", 1, 1, 2), ("calibration", None, b"c", "C", 1, 1, 3), ("nowhere", "d", b"d", "D", 1, 1, 4)], kind)
    accepted, rejected = catalog.ingest(spark.createDataFrame([], SAMPLE), uploads)
    assert {(r["content_id"], r["filename"]) for r in accepted.collect()} == {("A", "a"), ("C", "upload")}
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == {2: "identical image content is already in reference", 4: "unknown group"}
    again, refused = catalog.ingest(accepted, uploads.where("seq < 4"))
    assert again.count() == 0 and refused.count() == 3
    assert [r[0] for r in catalog.list_samples(accepted, "reference").select("filename").collect()] == ["a"]
    assert tuple(catalog.group_counts(accepted).first()) == (1, 1)
    assert catalog.overlap(accepted).count() == 0
    assert catalog.delete(accepted, accepted.select("sample_id").limit(1)).count() == 1


def test_a_large_bank_is_refused_by_the_expression_form_not_cut(spark, monkeypatch):
    from normscope.operators import neighbours

    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 10)
    asks = spark.createDataFrame([(1, [5.0])], "k int, descriptor array<double>")
    bank = spark.createDataFrame([([float(i)],) for i in range(11)], "descriptor array<double>")
    with pytest.raises(ValueError):
        neighbours.nearest_distance_expr(asks, bank, ["k"])
    assert neighbours.nearest_distance_expr(asks, bank.where("descriptor[0] <> 0"), ["k"]).first()["d"] == 0.0


def test_uploads_are_told_by_their_whole_path_and_large_ones_rejected(spark, tmp_path, monkeypatch):
    from normscope.functions.raster import encode_png
    from normscope.sources import images

    for folder, shade in (("a", 10), ("b", 200)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "0.png").write_bytes(encode_png(np.full((8, 8, 3), shade, dtype=np.uint8)))
    (tmp_path / "a" / "big.png").write_bytes(encode_png(np.random.default_rng(0).integers(0, 255, (64, 64, 3)).astype(np.uint8)))
    monkeypatch.setattr(images, "MOST_BYTES", 2_000)
    uploads, rejected = images.read_uploads(spark, str(tmp_path / "*"), "reference")
    assert sorted((r["filename"], r["pixels"][0]) for r in uploads.collect()) == [("0.png", 10), ("0.png", 200)]
    assert [(r["path"].split("/")[-1], "larger" in r["reason"]) for r in rejected.collect()] == [("big.png", True)]


def _stretched(grid, rows, cols):
    """Bilinear interpolation cell by cell, positions held within the grid."""
    h, w, _ = grid.shape
    out = np.empty((rows, cols, grid.shape[2]))
    for y in range(rows):
        for x in range(cols):
            v, u = max((y + 0.5) * h / rows - 0.5, 0.0), max((x + 0.5) * w / cols - 0.5, 0.0)
            a, b = int(v), int(u)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            top = grid[a, b] * (1 - u + b) + grid[a, d] * (u - b)
            low = grid[c, b] * (1 - u + b) + grid[c, d] * (u - b)
            out[y, x] = top * (1 - v + a) + low * (v - a)
    return out


def test_grids_are_aligned_and_concatenated(spark):
    rng = np.random.default_rng(8)
    fine, coarse = rng.normal(size=(6, 8, 3)), rng.normal(size=(3, 4, 2))
    kinds = "sample_id string, cell int, descriptor array<double>, extra int"
    left = [("a", k, v.tolist(), 1) for k, v in enumerate(fine.reshape(48, 3))] + [("b", 0, [1.0, 2.0, 3.0], 1), ("a", 48, [0.0] * 3, 1), ("a", 1, None, 1), (None, 0, [1.0] * 3, 1)]
    right = [("a", k, v.tolist(), 1) for k, v in enumerate(coarse.reshape(12, 2))] + [("b", k, [0.0, 0.0], 1) for k in range(11)] + [("c", 0, [0.0, 0.0], 1)]
    got = concat_grids(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), (6, 8), (3, 4)).collect()
    assert len(got) == len(left)
    whole = {r["cell"]: r["descriptor"] for r in got if r["descriptor"] is not None}
    want = np.concatenate([fine, _stretched(coarse, 6, 8)], axis=2).reshape(48, 5)
    assert sorted(whole) == list(range(48)) and np.allclose([whole[k] for k in range(48)], want)
    nothing = spark.createDataFrame([], kinds)
    assert concat_grids(nothing, nothing).count() == 0
    assert [r["descriptor"] for r in concat_grids(spark.createDataFrame(left[:1], kinds), nothing, (6, 8), (3, 4)).collect()] == [None]


def test_ingest_rejects_known_ids_and_missing_content(spark):
    kinds = "group string, filename string, raw binary, content_id string, width int, height int, seq long"
    uploads = spark.createDataFrame([("reference", "x", b"1", "c1", 1, 1, 0), ("reference", "y", b"1", "c2", 1, 1, 1), ("calibration", "z", b"2", None, 1, 1, 2), ("calibration", "z", b"3", None, 1, 1, 3)], kinds)
    accepted, rejected = catalog.ingest(spark.createDataFrame([], SAMPLE), uploads)
    assert [r["seq"] for r in accepted.collect()] == [0]
    reasons = {r["seq"]: r["reason"] for r in rejected.collect()}
    assert reasons == {1: "a sample of this name is already held", 2: "the image has no content", 3: "the image has no content"}
    third = spark.createDataFrame([("reference", "w", b"1", "c3", 1, 1, 4)], kinds)
    again, refused = catalog.ingest(accepted, third)
    assert again.count() == 0 and refused.first()["reason"] == "a sample of this name is already held"


def test_a_content_that_very_many_uploads_share(spark):
    kinds = "group string, filename string, raw binary, content_id string, width int, height int, seq long"
    rows = [("reference" if k % 3 else "calibration", f"{k}.png", str(k).encode(), "hot" if k % 2 else f"c{k % 40}", 1, 1, 1_000 - k) for k in range(600)]
    accepted, rejected = catalog.ingest(spark.createDataFrame([], SAMPLE), spark.createDataFrame(rows, kinds).repartition(4))
    firsts = {}
    for group, _, _, content, _, _, seq in rows:
        if content not in firsts or seq < firsts[content][0]:
            firsts[content] = (seq, group)
    assert {r["content_id"]: (r["seq"], r["group"]) for r in accepted.collect()} == firsts
    reasons = {r["seq"]: r["reason"] for r in rejected.collect()}
    assert reasons == {seq: f"identical image content is already in {firsts[content][1]}" for _, _, _, content, _, _, seq in rows if firsts[content][0] != seq}
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and accepted.count() == 21


def test_joins_with_counted_keys_split_hot_ones(spark):
    from normscope.operators.joins import join_counted

    rows = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 10 == 0 else f"k{k % 30}") for k in range(1_000)], "n int, key string")
    counts = rows.where("key is not null").groupBy("key").count().withColumn("said", F.concat("key", F.lit("!"))).where("key <> 'k2'")
    for share in (0.25, 1e9):
        got = {r["n"]: r["said"] for r in join_counted(rows, counts, "key", "count", 1_000, share).collect()}
        assert got == {k: "hot!" if k % 2 else f"k{k % 30}!" for k in range(1_000) if k % 2 or k % 10 and k % 30 != 2}
    empty = join_counted(rows.limit(0), counts.limit(0), "key", "count", 0)
    assert empty.count() == 0 and empty.columns == ["key", "n", "said"]


def test_least_distances_are_those_of_all_differences():
    rng = np.random.default_rng(2)
    q, b = rng.normal(size=(300, 9)) * 50 + 1e4, rng.normal(size=(500, 9)) * 50 + 1e4
    b[100:400] = b[7]
    q[:40], q[50] = b[7], b[450]
    want = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    got = least_distances(q, b, 64)
    assert np.allclose(got, want, rtol=1e-12, atol=0) and (got[:40] == 0).all() and got[50] == 0
    q[3, 2], b[5, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.isnan(least_distances(q, b[:5])[3]) and np.isfinite(least_distances(q, b)[4])
    assert np.isinf(least_distances(q, b[:0])).all() and len(least_distances(q[:0], b)) == 0
