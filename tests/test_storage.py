import pytest

from veinmap import storage


def test_materialize_and_discard(spark):
    storage.discard(spark)
    df = storage.materialize(spark.range(5), "numbers")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    assert storage.discard(spark) == 1 and storage.discard(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_local_relations(spark):
    ddl = "a long, b array<struct<name:string,data_type:string>>, c array<string>, d boolean"
    rows = [(1, [("x", None), ("y", "int")], ["p", None], True), (None, None, [], None)]
    df = storage.local(spark, rows, ddl)
    assert [tuple(r) for r in df.collect()] == [(1, [("x", None), ("y", "int")], ["p", None], True), (None, None, [], None)]
    assert storage.local(spark, [], ddl).count() == 0 and storage.local(spark, [], ddl).schema == df.schema


def test_a_cluster_without_a_shared_folder_is_refused():
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        storage.shared_dir(Fake())
