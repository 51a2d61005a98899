"""Tables between steps."""

import pytest

from normscope.sources import scratch


def test_a_written_table_is_read_back_and_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    rows = spark.range(10).selectExpr("id", "cast(null as string) as gone", "array(id) as list")
    stored = scratch.materialise(rows, "rows")
    assert stored.schema.simpleString() == rows.schema.simpleString() and sorted(stored.collect()) == sorted(rows.collect())
    assert scratch.materialise(rows.limit(0), "rows").count() == 0
    kept = tmp_path / "normscope" / spark.sparkContext.applicationId
    assert len(list(kept.iterdir())) == 2
    scratch.clear_scratch(spark)
    assert not kept.exists() and tmp_path.exists()


class _Cluster:
    """A session on a cluster."""

    settings: dict = {}

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return _Cluster.settings.get(name, default)

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_the_folder_is_the_one_the_cluster_names_and_none_is_an_error(monkeypatch):
    monkeypatch.setattr(_Cluster, "settings", {"spark.checkpoint.dir": "shared:/folder"})
    assert scratch.scratch_dir(_Cluster) == "shared:/folder"
    monkeypatch.setattr(_Cluster, "settings", {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(_Cluster)
