"""Made-up pictures, and files that keep arriving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.functions.raster import encode_png
from normscope.operators import catalog
from normscope.plans import detector
from normscope.schema import SAMPLE
from normscope.sources import textures
from normscope.sources.descriptors import PixelStatistics, describe
from normscope.sources.images import read_uploads, uploads_of_pixels
from normscope.sources.store import StateStore
from normscope.streaming.ingest import add_batch, ingest_stream


def made(spark, **options):
    textures.register(spark)
    return spark.read.format("textures").options(**{k: str(v) for k, v in options.items()}).load()


def test_pictures_follow_from_their_seed_whatever_the_partitions(spark):
    one = made(spark, first=3, count=5, size=64, kinds="plain,cut,speck")
    other = made(spark, first=5, count=1, size=64, kinds="speck", seedsPerPartition=1)
    assert one.count() == 15 and made(spark, first=3, count=5, size=64, seedsPerPartition=2).rdd.getNumPartitions() == 3
    rows = {(r["seed"], r["kind"]): bytes(r["rgb"]) for r in one.collect()}
    assert rows[5, "speck"] == bytes(other.first()["rgb"]) == textures.texture(5, "speck", 64).tobytes()
    assert len(set(rows.values())) == 15
    plain, cut, speck = (np.frombuffer(rows[4, k], np.uint8).reshape(64, 64, 3).astype(int) for k in textures.KINDS)
    for marked in (cut, speck):
        changed = np.abs(marked - plain).max(axis=2) > 25
        assert 0.002 < changed.mean() < 0.2 and (marked - plain).min() < -60
    assert (speck - plain).max() > 25 and 90 < plain.mean() < 200 and plain.std() > 3
    first = one.where("seed = 3 and kind = 'plain'").first()
    assert first["png"] == encode_png(textures.texture(3, "plain", 64)) and made(spark, count=0).count() == 0
    for bad in ({"kinds": "torn"}, {"size": 2}, {"count": -1}):
        with pytest.raises(Exception, match="textures take"):
            made(spark, **bad).count()


def test_a_detector_of_plain_pictures_finds_the_marked_ones(spark, tmp_path):
    samples = spark.createDataFrame([], SAMPLE)
    cells = None
    for group, first in (("reference", 0), ("calibration", 100)):
        pictures = made(spark, first=first, count=6, size=224).withColumn("filename", F.format_string("%05d.png", "seed"))
        uploads = uploads_of_pixels(pictures, group, ["seed"], first)
        accepted, rejected = catalog.ingest(samples, uploads)
        assert rejected.count() == 0 and [r["seq"] for r in accepted.orderBy("filename").collect()] == list(range(first, first + 6))
        samples = samples.unionByName(accepted)
        own = describe(accepted.join(uploads.select("seq", "pixels"), "seq"), PixelStatistics())
        cells = own if cells is None else cells.unionByName(own)
    store = StateStore(spark, str(tmp_path / "store"))
    detector.rebuild(store, samples, cells)
    seen = made(spark, first=200, count=3, size=224, kinds="plain,cut,speck").withColumn("filename", F.concat_ws("-", "kind", "seed"))
    inspected = uploads_of_pixels(seen, "reference", ["seed", "kind"]).withColumn("sample_id", F.col("filename"))
    scored, _ = detector.inspect(store, describe(inspected, PixelStatistics()))
    found = {r["sample_id"]: r for r in scored.collect()}
    for seed in (200, 201, 202):
        for kind in ("cut", "speck"):
            assert found[f"{kind}-{seed}"]["is_anomaly"] and found[f"{kind}-{seed}"]["score"] > found[f"plain-{seed}"]["score"]


def write(folder, name, seed, size=40):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(encode_png(textures.texture(seed, "plain", size)))


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "in", f"{k}.png", k)
    (tmp_path / "in" / "damaged.png").write_bytes(b"\x89PNG\r\n\x1a\n damaged")
    write(tmp_path / "in", "copy.png", 0)
    store = StateStore(spark, str(tmp_path / "store"))
    told = []
    paths = [str(p) for p in sorted((tmp_path / "in").iterdir())]
    keep = lambda rows, number: told.append((number, sorted(r["name"].split("/")[-1] for r in rows.collect())))
    add_batch(store, paths, "reference", "camera", 0, keep)
    assert store.samples().count() == 3 and told == [(0, ["copy.png", "damaged.png"])]
    before = store.state()
    for number in (0, -1):
        add_batch(store, paths, "reference", "camera", number, keep)
    assert store.state() == before and len(told) == 1
    # A writer that had read the store before the batch was added: the number is compared again with the change.
    uploads, _ = read_uploads(spark, paths[:1], "reference", 50)
    late = uploads.withColumn("sample_id", F.lit("r-late")).withColumn("content_id", F.lit("other"))
    store.add(late.select(*SAMPLE.names), late, batch=("camera", 0))
    assert store.state() == before
    store.add(late.select(*SAMPLE.names), late, batch=("camera", 1))
    assert store.samples().count() == 4 and store.last_batch("camera") == 1 and store.last_batch("none") == -1


def test_files_that_arrive_are_taken_up_once(spark, tmp_path):
    folder, store = tmp_path / "in", StateStore(spark, str(tmp_path / "store"))

    def run():
        query = ingest_stream(spark, store, str(folder), "calibration", str(tmp_path / "checkpoint"), files=2, availableNow=True)
        assert query.awaitTermination(300)

    for k in range(3):
        write(folder, f"{k}.png", k)
    run()
    assert sorted(r["seq"] for r in store.samples().collect()) == [0, 1, 2]
    write(folder, "again.png", 1)
    write(folder, "new.png", 9)
    run()
    run()
    held = store.samples().collect()
    assert len(held) == 4 and {r["group"] for r in held} == {"calibration"} and len({r["seq"] for r in held}) == 4
    assert store.last_batch(str(tmp_path / "checkpoint")) == 2
    # The checkpoint is lost: the same files come as a new source and are known by their content.
    query = ingest_stream(spark, store, str(folder), "reference", str(tmp_path / "other"), availableNow=True)
    assert query.awaitTermination(300) and store.samples().count() == 4
