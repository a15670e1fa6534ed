"""Stored tables and the folder that they go to."""

import pytest

from tessera import storage


class Session:
    """What shared_folder() asks of a session, for one that is not there."""

    def __init__(self, master, settings, context=None):
        self.sparkContext, self.conf, self.context = self, self, context
        self.master, self.settings = master, settings

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


@pytest.fixture(autouse=True)
def context_folder(monkeypatch):
    monkeypatch.setattr(storage, "_context_folder", lambda spark: getattr(spark, "context", None))


def test_the_folder_that_is_set_comes_first():
    assert storage.shared_folder(Session("spark://x", {"spark.checkpoint.dir": "hdfs://a/b/"}, "hdfs://c")) == "hdfs://a/b"
    assert storage.shared_folder(Session("spark://x", {}, "hdfs://c/d")) == "hdfs://c/d"


def test_a_cluster_needs_a_shared_folder():
    assert storage.shared_folder(Session("spark://x", {"spark.sql.warehouse.dir": "s3a://w"})) == "s3a://w/_scratch"
    for local in ("file:/home/x/spark-warehouse", "/home/x/spark-warehouse"):
        with pytest.raises(ValueError):
            storage.shared_folder(Session("local-cluster[2,1,1024]", {"spark.sql.warehouse.dir": local}))
    assert storage.shared_folder(Session("local[2]", {})).startswith("file:///")


def test_kept_tables_stay_until_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
    one, two = (storage.keep(spark.range(100).repartition(8), what, files=files) for what, files in (("one", None), ("two", 2)))
    assert one.count() == two.count() == 100 and len(list(tmp_path.glob("tessera-two-*/*.parquet"))) == 2
    storage.delete(one, spark.range(3))
    storage.delete(one)
    assert [p.name[:11] for p in tmp_path.iterdir()] == ["tessera-two"] and two.count() == 100
