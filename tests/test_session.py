import pytest

from framewright.session import checkpointed, ensure_checkpoint_dir, table


def test_checkpoints_cut_lineage(spark):
    df = checkpointed(spark.range(5).repartition(2))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_a_cluster_must_name_a_shared_folder():
    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Java:
        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Nothing()

    class Context:
        master, _jsc, named = "spark://x:7077", Java(), []

        def getConf(self):  # noqa: N802
            return {}

        def setCheckpointDir(self, d):  # noqa: N802
            self.named.append(d)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert ensure_checkpoint_dir(Session()) == "hdfs:///shared" and Context.named == ["hdfs:///shared"]


def test_tables_of_one_file_or_a_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert table(spark, f"{tmp_path}/", "t").count() == 3
