"""Reading tables and cutting lineage, the same way on a laptop and on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in which ``checkpoint()`` writes.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; only where that is unset and the
    master is local (as in tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="framewright-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut; lost executors cannot take it along."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, and its path for ``discard``.

    Like ``checkpointed`` it cuts the lineage, but the table is columnar and compressed, and can be given up early.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, str]:
    """``df`` as a table of ``parts`` buckets by ``key`` in the shared checkpoint folder, and its name for ``drop_bucketed``.

    Later joins and sums by ``key`` find the rows where they are and shuffle only their other side. ``df`` should be
    hash-partitioned by ``key`` into ``parts`` already, so that each task writes one file.
    """
    spark = df.sparkSession
    name = f"framewright_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.option("path", path).bucketBy(parts, key).sortBy(key).format("parquet").saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Drops a table of ``bucketed`` that nothing reads any more, with its files."""
    spark.sql(f"drop table if exists {name}")
    discard(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
