"""Uploads that keep arriving as files, into the catalogue.

An addition of this library.  Each batch of new files is decoded, deduplicated against
the catalogue and added under its number; the store remembers the number with the change
itself, so a batch that runs again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..sources.images import read_uploads
from ..sources.scratch import materialise
from ..sources.store import StateStore

#: What Spark's reader of whole files gives; a stream has to be told.
FILES = "path string, modificationTime timestamp, length long, content binary"
Rejected = Callable[[DataFrame, int], None]


def add_uploads(store: StateStore, uploads: DataFrame, source: str, number: int, rejected: Rejected | None = None, unread: DataFrame | None = None) -> None:
    """Uploads of one batch (as the catalogue takes them, and ``png``) into the store; a number that the source has had before changes nothing.

    ``rejected`` is given the uploads that were not taken, after the ``unread`` files, as ``name`` and ``reason``, and the batch's number.
    """
    if number <= store.last_batch(source):
        return
    accepted, refused = catalog.ingest(store.samples(), uploads)
    accepted = materialise(accepted, "accepted")
    if rejected is not None:
        told = refused.select(F.col("filename").alias("name"), "reason")
        rejected(told if unread is None else unread.select(F.col("path").alias("name"), "reason").unionByName(told), number)
    store.add(accepted, accepted.select("sample_id", "seq").join(uploads.select("seq", "png"), "seq"), batch=(source, number))


def add_batch(store: StateStore, paths: list[str], group: str, source: str, number: int, rejected: Rejected | None = None) -> None:
    """Files of one batch into the store, numbered after the samples that are there; see :func:`add_uploads`."""
    if number <= store.last_batch(source) or not paths:
        return
    first = store.samples().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    uploads, unread = read_uploads(store.spark, paths, group, first)
    add_uploads(store, uploads, source, number, rejected, unread)


def ingest_stream(spark: SparkSession, store: StateStore, path: str, group: str, checkpoint: str, files: int = 1_000, rejected: Rejected | None = None, **trigger) -> StreamingQuery:
    """Watch a folder and add the images that arrive; ``trigger`` as of a stream's writer.

    A batch has at most ``files`` files, whose paths are known to the driver; their bytes are not.
    The checkpoint numbers the batches, so it names the source: a new checkpoint is a
    new source, whose files are known by their content.
    """
    arriving = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files).load(path).select("path")

    def take(batch: DataFrame, number: int) -> None:
        add_batch(store, [r["path"] for r in batch.collect()], group, checkpoint, number, rejected)

    writer = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
