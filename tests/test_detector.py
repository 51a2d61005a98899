import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.functions.raster import encode_png, jet
from normscope.operators import catalog
from normscope.plans import detector, state
from normscope.schema import PREPROCESS, SAMPLE
from normscope.sources.descriptors import PixelStatistics, describe
from normscope.sources.images import read_uploads
from normscope.sources.store import Conflict, StateStore
from normscope.streaming.scoring import score_stream


def _cloth(number: int) -> np.ndarray:
    """A woven pattern of 240 x 300 pixels with some grain, different for each number."""
    grain = np.random.default_rng([number, 77]).uniform(-9, 9, (240, 300, 3))
    y, x = np.mgrid[:240, :300]
    weave = 30 * ((x // 6 + y // 6) % 2) + 8 * np.sin(x / 31 + number)
    return (120 + weave[:, :, None] + grain).round().astype(np.uint8)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("detector")
    torn = _cloth(31)
    torn[60:90, 180:260] = (250, 20, 240)
    for group, images in {"reference": [_cloth(s) for s in range(4)], "calibration": [_cloth(s) for s in range(10, 14)], "inspected": [_cloth(30), torn]}.items():
        (root / group).mkdir()
        for k, image in enumerate(images):
            (root / group / f"{k}.png").write_bytes(encode_png(image))
    (root / "reference" / "broken.png").write_bytes(b"not an image")
    samples, cells = spark.createDataFrame([], SAMPLE), None
    for n, group in enumerate(("reference", "calibration")):
        uploads, rejected = read_uploads(spark, str(root / group), group, 10 * n)
        assert rejected.count() == (group == "reference")
        accepted, _ = catalog.ingest(samples, uploads)
        samples = samples.unionByName(accepted).cache()
        own = describe(accepted.join(uploads.select("seq", "pixels"), "seq"), PixelStatistics())
        cells = own if cells is None else cells.unionByName(own)
    cells = cells.cache()
    store = StateStore(spark, str(root / "store"))
    assert store.current() is None
    with pytest.raises(detector.NotBuilt):
        detector.inspect(store, cells)
    assert not detector.status(store, samples).first()["built"]
    version = detector.rebuild(store, samples, cells)
    inspected, _ = read_uploads(spark, str(root / "inspected"), "inspected")
    named = inspected.withColumn("sample_id", F.col("filename"))
    return store, samples, cells, version, describe(named, PixelStatistics()).cache()


def test_marked_image_scores_above_the_plain_one(built):
    store, _, _, _, inspected = built
    scored, grid = detector.inspect(store, inspected)
    found = {r["sample_id"]: r for r in scored.collect()}
    assert found["1.png"]["score"] > found["0.png"]["score"]
    assert found["1.png"]["is_anomaly"] == (found["1.png"]["score"] > found["1.png"]["threshold"])
    assert grid.count() == 2 * 784


def test_a_new_store_object_reads_what_was_published(built, spark):
    store, samples, _, version, _ = built
    again = StateStore(spark, store.root)
    assert again.current() == version and again.bank(version).count() == 256
    status = detector.status(again, samples).first()
    assert status["preprocess"].asDict() == PREPROCESS and status["built_at"].endswith("+00:00")
    scores = [r["score"] for r in again.scores(version).orderBy("pos").collect()]
    assert status["calibration_scores"] == scores and len(scores) == 4
    assert status["threshold"] == pytest.approx(np.quantile(scores, 0.95), rel=1e-12)
    assert (status["reference_count"], status["calibration_count"], status["built"], status["stale"]) == (4, 4, True, False)
    assert status["threshold"] >= 0


def test_failed_rebuild_keeps_the_current_version(built):
    store, samples, cells, version, _ = built
    lost = samples.where("group = 'reference'").orderBy("seq").first()["sample_id"]
    with pytest.raises(ValueError):
        detector.rebuild(store, samples, cells.where(F.col("sample_id") != lost))
    for group in ("reference", "calibration"):
        with pytest.raises(ValueError, match=group):
            detector.rebuild(store, samples.where(F.col("group") != group), cells)
    assert store.current() == version
    assert detector.status(store, samples.where(F.col("sample_id") != lost)).first()["stale"]


def test_heat_images_are_fixed_by_the_threshold(spark, built):
    rows = [(f"i{k}", y, x, 3.5 + k * (x % 2)) for k in range(2) for y in range(28) for x in range(28)] + [("lacking", 0, 0, 1.0), *(("twice", y, x, 1.0) for y in range(28) for x in range(28)), ("twice", 0, 0, 1.0)]
    grids = detector.grid_rows(spark.createDataFrame(rows, "sample_id string, gy int, gx int, d double"))
    sized = grids.select("*", F.lit(12.0).alias("threshold"), F.lit(70).alias("width"), F.lit(40).alias("height"))
    heat = {r["sample_id"]: r for r in detector.heat_images(sized).collect()}
    assert heat["lacking"]["png"] is None and heat["twice"]["rgb"] is None
    pictures = {k: np.frombuffer(heat[k]["rgb"], np.uint8).reshape(40, 70, 3) for k in ("i0", "i1")}
    level = spark.range(1).select(*(c for c in jet(F.lit(3.5 / 24)))).first()
    assert (pictures["i0"] == np.array(level, np.uint8)).all() and len(np.unique(pictures["i1"].reshape(-1, 3), axis=0)) > 1
    assert encode_png(pictures["i1"]) == heat["i1"]["png"]
    scored = detector.inspect(built[0], built[4])[0]
    originals = spark.createDataFrame([("i0", 300, 240, b"zero"), ("i1", 300, 240, b"one")], "sample_id string, width int, height int, png binary")
    pngs = detector.heat_images(sized.where("sample_id like 'i%'")).select("sample_id", "png")
    replies = detector.inspection_json(scored.withColumn("sample_id", F.concat(F.lit("i"), F.substring("sample_id", 1, 1))), pngs, originals).collect()
    assert len(replies) == 2
    for r in replies:
        reply = json.loads(r["reply"])
        assert list(reply) == ["score", "threshold", "is_anomaly", "threshold_is_zero", "color_scale_vmax", "width", "height", "original", "heatmap"]
        assert reply["color_scale_vmax"] == (2 * reply["threshold"] if reply["threshold"] else None)
        assert base64.b64decode(reply["original"]) == (b"zero" if r["sample_id"] == "i0" else b"one") and (reply["width"], reply["height"]) == (300, 240)


def test_heat_images_without_a_threshold_end_at_their_own_maximum(spark):
    rows = [(k, [float(k * (c == 5)) for c in range(6)], t, 3, 2) for k, t in ((0, 0.0), (4, 0.0), (8, None))]
    frame = spark.createDataFrame(rows, "sample_id int, grid array<double>, threshold double, width int, height int")
    found = {r["sample_id"]: np.frombuffer(r["rgb"], np.uint8).reshape(2, 3, 3) for r in detector.heat_images(frame, rows=2, cols=3).collect()}
    assert (found[0] == (0, 0, 128)).all() and found[4][1, 2].tolist() == found[8][1, 2].tolist() == [128, 0, 0]


def test_stream_scores_equal_batch_scores(spark, built, tmp_path):
    store, _, cells, version, inspected = built
    inspected.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(inspected.schema).parquet(str(tmp_path / "in"))
    query = score_stream(arriving, store.bank(version)).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    got = spark.table("scored").groupBy("sample_id").agg(F.max("d").alias("score"))
    want = detector.inspect(store, inspected)[0].select("sample_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_catalogue_outlives_its_store_object(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(encode_png(_cloth(50 + k)))
    store = StateStore(spark, str(tmp_path / "store"))
    assert store.samples().count() == 0
    with pytest.raises(KeyError):
        store.image("r-none")
    uploads, _ = read_uploads(spark, str(tmp_path / "in"), "reference")
    accepted, _ = catalog.ingest(store.samples(), uploads)
    named = accepted.join(uploads.select("seq", "png"), "seq")
    store.add(accepted.where("seq < 2"), named)
    again = StateStore(spark, store.root)
    rest, rejected = catalog.ingest(again.samples(), uploads)
    assert [r["seq"] for r in rest.collect()] == [2] and rejected.count() == 2
    again.add(rest, named)
    held = {r["seq"]: r["sample_id"] for r in StateStore(spark, store.root).samples().collect()}
    assert sorted(held) == [0, 1, 2]
    assert again.image(held[1]) == encode_png(_cloth(51))
    again.delete(held[1])
    for gone in (held[1], "unknown"):
        with pytest.raises(KeyError):
            store.delete(gone)
        with pytest.raises(KeyError):
            store.image(gone)
    again.vacuum()
    assert sorted(r["seq"] for r in store.samples().collect()) == [0, 2]
    assert store.image(held[2]) == encode_png(_cloth(52)) and store._images(store.state()[1]).count() == 2
    assert store.current() is None  # no detector was built


def _sample(k, group="reference"):
    return (f"r-{k}", f"{k}.png", f"content {k}", 3, 2, group, k)


def _images(spark, *ids):
    return spark.createDataFrame([(f"r-{k}", b"png") for k in ids], "sample_id string, png binary")


def test_two_writers_lose_no_change_and_add_nothing_twice(spark, tmp_path):
    one, two = StateStore(spark, str(tmp_path / "s")), StateStore(spark, str(tmp_path / "s"))
    one.add(spark.createDataFrame([_sample(0)], SAMPLE), _images(spark, 0))
    turns = []

    def late(old):
        turns.append(old["samples"])
        if len(turns) == 1:  # another writer comes first
            two.add(spark.createDataFrame([_sample(1)], SAMPLE), _images(spark, 1))
        return old | {"detector": "v"}

    one.change(late)
    assert len(turns) == 2 and turns[1][:1] == turns[0] and two.state()[1]["detector"] == "v"
    assert sorted(r["seq"] for r in one.samples().collect()) == [0, 1]
    rows = spark.createDataFrame([_sample(1), _sample(2), (*_sample(3)[:2], "content 0", 3, 2, "calibration", 3)], SAMPLE)
    two.add(rows, _images(spark, 1, 2, 3, 9))
    assert sorted(r["seq"] for r in one.samples().collect()) == [0, 1, 2] and one._images(one.state()[1]).count() == 3
    with pytest.raises(Conflict):
        StateStore(spark, one.root, tries=2).change(lambda old: two.change(lambda o: o | {"detector": None}) | {"detector": "x"})
    assert one.state()[1]["detector"] is None


def test_writers_in_parallel_each_get_their_turn(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        store = StateStore(spark, str(tmp_path / "s"), tries=50)
        return store.change(lambda old: old | {"batches": old["batches"] | {f"w{k}": k}})

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    number, last = StateStore(spark, str(tmp_path / "s")).state()
    assert number == 12 and last["batches"] == {f"w{k}": k for k in range(12)}


def test_a_damaged_bank_is_no_detector(spark, built, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    record = spark.createDataFrame([(1.0, 1, None, json.dumps(PREPROCESS), 0)], "threshold double, memory_bank_items long, built_at timestamp, preprocess string, samples_digest long")
    bank = spark.createDataFrame([(0, [1.0])], "bank_pos int, descriptor array<double>")
    scores = spark.createDataFrame([(0, 1.0)], "pos long, score double")
    version = store.publish(bank, record, scores)
    assert store.current() == version
    for file in (tmp_path / "s" / f"version={version}" / "bank").glob("*.parquet"):
        file.write_bytes(b"damaged file")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert store.current() is None and not detector.status(store, spark.createDataFrame([], SAMPLE)).first()["built"]
    other = store.publish(bank, record, scores)
    assert store.current() == other
    import shutil

    shutil.rmtree(tmp_path / "s" / f"version={other}")
    assert store.current() is None


def test_the_state_document_goes_out_and_in(spark, built, tmp_path):
    store, samples, _, version, _ = built
    own = StateStore(spark, str(tmp_path / "s"))
    own.add(samples, samples.select("sample_id", F.lit(b"png").alias("png")))
    own.publish(store.bank(version), store.record(version).drop("version"), store.scores(version))
    document = state.state_document(own)
    told = json.loads(document.first()["document"])
    assert list(told) == ["samples", "threshold", "calibration_scores", "built_at", "preprocess"] and told["preprocess"] == PREPROCESS
    assert [s["sample_id"] for s in told["samples"]] == [r["sample_id"] for r in samples.orderBy("seq").collect()]
    assert list(told["samples"][0]) == ["sample_id", "filename", "content_id", "width", "height", "group"]
    third = StateStore(spark, str(tmp_path / "t"))
    known = samples.where("group = 'reference'").select("sample_id", F.lit(b"png").alias("png"))
    back = state.restore(spark, third, document, known).first()
    assert third.samples().count() == known.count() and back["calibration_scores"] == told["calibration_scores"] and back["threshold"] == told["threshold"]
    assert [r["filename"] for r in third.samples().orderBy("seq").collect()] == [s["filename"] for s in told["samples"] if s["group"] == "reference"]
    empty = json.loads(state.state_document(StateStore(spark, str(tmp_path / "none"))).first()["document"])
    assert empty["samples"] == [] and empty["threshold"] is None and empty["calibration_scores"] == [] and empty["built_at"] is None
    samples, numbers = state.from_document(spark.createDataFrame([("{no document",), (None,)], "document string"))
    assert samples.count() == 0 and [r["threshold"] for r in numbers.collect()] == [None, None]


def test_jpeg_files_are_read_like_png(spark, tmp_path):
    """A smooth picture, written by the JVM's own encoder."""
    y, x = np.mgrid[:48, :64]
    picture = np.stack([2 * y + 60, x + 90, np.full_like(x, 120)], axis=2).astype(np.uint8)
    jvm = spark.sparkContext._jvm
    stored = jvm.java.awt.image.BufferedImage(64, 48, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for row in range(48):
        for col in range(64):
            r, g, b = (int(c) for c in picture[row, col])
            stored.setRGB(col, row, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(stored, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.png").write_bytes(encode_png(picture))
    (tmp_path / "c.gif").write_bytes(b"GIF89a no picture")
    uploads, rejected = read_uploads(spark, str(tmp_path), "reference")
    found = {r["filename"]: r for r in uploads.collect()}
    assert sorted(found) == ["a.jpg", "b.png"] and {(r["width"], r["height"]) for r in found.values()} == {(64, 48)}
    pixels = {k: np.frombuffer(r["pixels"], np.uint8).astype(int) for k, r in found.items()}
    assert np.abs(pixels["a.jpg"] - pixels["b.png"]).mean() < 3 and found["a.jpg"]["content_id"] != found["b.png"]["content_id"]
    assert [r["reason"] for r in rejected.collect()] == ["not a PNG or JPEG image"]


def test_building_evaluates_each_image_once(spark, tmp_path):
    """With a source that counts, and descriptors of a small network."""
    from test_network import random_weights

    from normscope.sources.network import Prefix

    counted = spark.sparkContext.accumulator(0)
    prefix = Prefix(random_weights((4, 6, 8), 1))

    def source(pixels):
        counted.add(1)
        return prefix(pixels)

    rows = [(f"{g[0]}-{k}", g, k, np.ascontiguousarray(_cloth(60 + k)[:224, :224]).tobytes()) for k, g in enumerate(["reference"] * 3 + ["calibration"] * 2)]
    uploads = spark.createDataFrame(rows, "sample_id string, group string, seq long, pixels binary")
    samples = uploads.select("sample_id", "group", "seq")
    store = StateStore(spark, str(tmp_path / "s"))
    version = detector.rebuild(store, samples, describe(uploads, source))
    assert counted.value == 5 and store.bank(version).count() == 256
    assert {len(r["descriptor"]) for r in store.bank(version).collect()} == {14}
    scored, grid = detector.inspect(store, describe(uploads, prefix))
    found = {r["sample_id"]: r["score"] for r in scored.collect()}
    told = [r["score"] for r in store.scores(version).orderBy("pos").collect()]
    assert [found["c-3"], found["c-4"]] == pytest.approx(told) and grid.count() == 5 * 784
