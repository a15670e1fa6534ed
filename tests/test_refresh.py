"""Tables are replaced whole, wherever a replacement stops."""

import pytest

from tessera.plans import refresh


def rows(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def write(spark, ids, path):
    spark.createDataFrame([(i,) for i in ids], "id long").write.mode("overwrite").parquet(path)


def test_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    refresh._replace(spark, spark.range(3), path)
    refresh._replace(spark, spark.read.parquet(path).union(spark.range(7, 9)), path)
    assert rows(spark, path) == [0, 1, 2, 7, 8] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


@pytest.mark.parametrize("moved, whole, want", [(False, True, [1]), (True, True, [2]), (True, False, [1]), (False, False, [1])])
def test_recovered_wherever_it_stopped(spark, tmp_path, moved, whole, want):
    path = f"file://{tmp_path}/t"
    write(spark, [1], path)
    write(spark, [2], f"{path}.new")
    if not whole:
        (tmp_path / "t.new" / "_SUCCESS").unlink()
    if moved:
        (tmp_path / "t").rename(tmp_path / "t.old")
    refresh.recovered(spark, path)
    assert rows(spark, path) == want and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    refresh.recovered(spark, path)
    assert rows(spark, path) == want


def test_nothing_to_recover(spark, tmp_path):
    refresh.recovered(spark, f"file://{tmp_path}/none")
    assert list(tmp_path.iterdir()) == []
