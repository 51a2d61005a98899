"""The catalogue, the samples' images and detector versions on any file system that Spark writes.

All of it hangs on one state: a small document that names the folders in force.  States
are numbered files, written whole under another name and renamed into place, which
fails where the number is taken.  So a change is a compare-and-set: it is worked out on
the state it has read, and worked out anew where another writer came first.  Folders
are complete before a state names them; readers see the state before or the one after.

The rename is atomic where the file system's rename without overwriting is, as on HDFS.
On a local file system, where it is not, writers of one process take turns.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BANK, IMAGE, SAMPLE, SCORE, VERSION

#: What an empty store's state says.
NOTHING = {"samples": [], "images": [], "detector": None, "batches": {}}
#: Conditions under which a table is not there or not readable.
UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")
_turns = threading.Lock()


class Conflict(RuntimeError):
    """Other writers kept coming first."""


def _conditions(error: PySparkException | Py4JJavaError) -> list[str]:
    """The error conditions of an exception and of what caused it."""
    if isinstance(error, PySparkException):
        return [error.getCondition() or ""]
    found, cause = [], error.java_exception
    while cause is not None:
        if "getCondition" in dir(cause):
            found.append(cause.getCondition() or "")
        cause = cause.getCause()
    return found


class StateStore:
    def __init__(self, spark: SparkSession, root: str, tries: int = 16):
        self.spark, self.root, self.tries = spark, root.rstrip("/"), tries
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def state(self) -> tuple[int, dict]:
        """The number of the state in force, and what it says; 0 for an empty store."""
        folder = self._path(f"{self.root}/state")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return 0, NOTHING
        number = max(numbers)
        return number, NOTHING | json.loads(self.spark.read.text(f"{self.root}/state/{number:012d}.json", wholetext=True).first()[0])

    def _set(self, number: int, new: dict) -> bool:
        """Make ``new`` the state after ``number``; False where that one is there already."""
        fresh, target = self._path(f"{self.root}/state/.{uuid.uuid4().hex}"), self._path(f"{self.root}/state/{number + 1:012d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            with _turns:
                context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(target), options)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            self._fs.delete(fresh, False)
            return False
        return True

    def change(self, work: Callable[[dict], dict | None]) -> dict:
        """Replace the state by what ``work`` makes of it (None: leave it); ``work`` runs again where another writer came first."""
        for _ in range(self.tries):
            number, old = self.state()
            new = work(old)
            if new is None or self._set(number, new):
                return old if new is None else new
        raise Conflict("the state kept changing")

    # ---- samples and images

    def samples(self) -> DataFrame:
        """The current list; samples whose image is gone are left out."""
        state = self.state()[1]
        listed = self._listed(state)
        return listed.join(self._images(state).select("sample_id").distinct(), "sample_id", "left_semi").select(*SAMPLE.names)

    def _table(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _listed(self, state: dict) -> DataFrame:
        return self._table(state["samples"], SAMPLE)

    def _images(self, state: dict) -> DataFrame:
        return self._table(state["images"], IMAGE)

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def add(self, accepted: DataFrame, images: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Take accepted samples up; ``images`` holds ``sample_id`` and ``png``, of which only theirs are kept.

        Samples whose id or content another writer has added by then are left out, so
        neither is ever held twice.  ``batch`` names a source and the number of its batch: one that
        is no later than the last of that source changes nothing.
        """

        def work(old: dict) -> dict | None:
            if batch is not None and old["batches"].get(batch[0], -1) >= batch[1]:
                return None
            held = self._listed(old)
            fresh = accepted.select(*SAMPLE.names).join(held.select("sample_id"), "sample_id", "left_anti").join(held.select("content_id"), "content_id", "left_anti")
            listed = self._write(fresh.select(*SAMPLE.names), "samples")
            own = images.join(self._table([listed], SAMPLE).select("sample_id"), "sample_id", "left_semi").dropDuplicates(["sample_id"])
            new = old | {"samples": [*old["samples"], listed], "images": [*old["images"], self._write(own.select(*IMAGE.names), "images")]}
            return new if batch is None else new | {"batches": old["batches"] | {batch[0]: batch[1]}}

        self.change(work)

    def last_batch(self, source: str) -> int:
        """The number of the source's last batch that was added, or -1."""
        return self.state()[1]["batches"].get(source, -1)

    def delete(self, sample_id: str) -> None:
        """Take one sample and its image out; ``KeyError`` for an unknown one."""

        def work(old: dict) -> dict:
            listed = self._listed(old)
            if not listed.where(F.col("sample_id") == sample_id).limit(1).count():
                raise KeyError(sample_id)
            return old | {"samples": [self._write(listed.where(F.col("sample_id") != sample_id), "samples")]}

        self.change(work)

    def image(self, sample_id: str) -> bytes:
        """The stored PNG; the id is compared within the Parquet scan.  ``KeyError`` for an unknown one."""
        state = self.state()[1]
        one = self._listed(state).where(F.col("sample_id") == sample_id).limit(1).count() and self._images(state).where(F.col("sample_id") == sample_id).first()
        if not one:
            raise KeyError(sample_id)
        return bytes(one["png"])

    def vacuum(self) -> None:
        """One list of samples, one folder of the images it names; folders that the state names no more go."""
        before: list[str] = []

        def work(old: dict) -> dict:
            before[:] = [*old["samples"], *old["images"]]
            listed = self._write(self._listed(old), "samples")
            own = self._images(old).join(self._table([listed], SAMPLE).select("sample_id"), "sample_id", "left_semi").dropDuplicates(["sample_id"])
            return old | {"samples": [listed], "images": [self._write(own.select(*IMAGE.names), "images")]}

        self.change(work)
        for folder in before:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    # ---- detector versions

    def publish(self, bank: DataFrame, record: DataFrame, scores: DataFrame) -> str:
        """Write a version and make it current; ``record`` is one row without the version's name, ``scores`` the calibration scores by place."""
        version = uuid.uuid4().hex
        where = f"{self.root}/version={version}"
        bank.select(*BANK.names).write.parquet(f"{where}/bank")
        scores.select(*SCORE.names).write.parquet(f"{where}/scores")
        record.withColumn("version", F.lit(version)).select(*VERSION.names).coalesce(1).write.parquet(f"{where}/record")
        self.change(lambda old: old | {"detector": version})
        return version

    def current(self) -> str | None:
        """The current version; None where none is whole (none named, or its files do not read)."""
        version = self.state()[1]["detector"]
        if version is None:
            return None
        try:
            whole = self.bank(version).limit(1).count() == 1 and self.record(version).count() == 1
        except (PySparkException, Py4JJavaError) as e:
            if not any(c.startswith(UNREADABLE) for c in _conditions(e)):
                raise
            return None
        return version if whole else None

    def bank(self, version: str) -> DataFrame:
        return self.spark.read.schema(BANK).parquet(f"{self.root}/version={version}/bank")

    def record(self, version: str) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(f"{self.root}/version={version}/record")

    def scores(self, version: str) -> DataFrame:
        return self.spark.read.schema(SCORE).parquet(f"{self.root}/version={version}/scores")
