import pytest

from inkwell import session as S


class _Conf:
    def __init__(self, **k):
        self.k = k

    def get(self, name, default=None):
        return self.k.get(name, default)


class _Spark:
    def __init__(self, **k):
        self.conf = _Conf(**k)


def test_shared_folder_must_be_named_on_a_cluster():
    assert S.shared_dir(_Spark(**{"spark.checkpoint.dir": "hdfs://x/y", "spark.master": "yarn"})) == "hdfs://x/y"
    assert S.shared_dir(_Spark(**{"spark.master": "local[4]"})).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            S.shared_dir(_Spark(**{"spark.master": master}))


def test_written_tables_are_removed(spark):
    import os

    a = S.written(spark.createDataFrame([(1, "x")], "k long, t string"))
    b = S.written(spark.createDataFrame([], "k long, t string"))
    at = [x._written.removeprefix("file://") for x in (a, b)]
    assert a.collect() == [(1, "x")] and b.collect() == [] and all(map(os.path.isdir, at))
    S.release(a)
    assert not os.path.exists(at[0]) and os.path.isdir(at[1])
    S.release(b)
    S.release(b)
    assert not os.path.exists(at[1])


def test_bounded_tables(spark):
    df = spark.range(5)
    assert len(S.bounded(df, 5, "it")) == 5
    with pytest.raises(ValueError):
        S.bounded(df, 4, "it")


def test_small_tables_are_spread_and_files_are_left(spark, tmp_path):
    spark.range(100).repartition(64).write.parquet(str(tmp_path / "many"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    one = S.spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert one.rdd.getNumPartitions() == cores and "Exchange" in plan(one)
    if cores <= 64:
        assert "Exchange" not in plan(S.spread(spark.read.parquet(str(tmp_path / "many")), "id"))
