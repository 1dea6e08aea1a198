"""Points as rows: get, scroll, count, upsert, delete, payload changes, compaction, set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import spread_prefix_sum
from framewright.session import checkpointed


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """All rows of both tables, one for each key: the one with the largest version (ties: the new table's).

    A map-side maximum per key, so a key that comes many times moves once a task. Null keys are one key.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "__new"]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), "__new")).alias("r")).select(*key, "r.*")


def assign_ids(known: DataFrame, names: DataFrame, name: str, id_: str) -> DataFrame:
    """``known`` (id, name) with every new name given the next id, in order of the names; null names get none.

    The new names are cut into sampled ranges of equal size, whatever they begin with, and written once; each range
    numbers its own names from the count of those before it.
    """
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti").select(name)
    ranged = checkpointed(fresh.repartitionByRange(name).withColumn("__range", F.spark_partition_id()))
    numbered = spread_prefix_sum(ranged.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0)), ["__all"], F.col("__range"), [name], "__one", "__n")
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("__m"))
    return known.select(id_, name).unionByName(numbered.crossJoin(F.broadcast(top)).select((F.col("__n") + F.col("__m")).cast("long").alias(id_), name))  # top: one row


def hydrate(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` for the ids of a ranked list (key, rank), in its order; ids without a row are left out."""
    return ids.join(rows, key)


def scroll(df: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """The next ``size`` rows by key after a cursor."""
    left = df if after is None else df.where(F.col(key) > after)
    return left.orderBy(key).limit(size)


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Marks the rows whose key is in ``gone`` as deleted; nothing is rewritten until ``optimize``."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    return df.join(marks, key, "left").withColumn("deleted", F.coalesce("__gone", F.lit(False))).drop("__gone")


def optimize(df: DataFrame) -> DataFrame:
    """Only the live rows, without the mark."""
    return df.where(~F.col("deleted")).drop("deleted")


def set_payload(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Sets columns where a condition holds."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def in_both_or_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: 'both', 'left' or 'right' for each distinct non-null key; both sides are netted before one shuffle."""
    a, b = left.select(F.col(key), F.lit(1).alias("s")), right.select(F.col(key), F.lit(2).alias("s"))
    sides = a.unionByName(b).where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or("s").alias("s"))
    return sides.select(key, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left").otherwise("right").alias("side"))


def toggle(selected: DataFrame, clicked: DataFrame, key: str) -> DataFrame:
    """The keys that are in exactly one of the two."""
    return in_both_or_one(selected, clicked, key).where("side <> 'both'").select(key)


def shard_of(key: Column, shards: int, hashed: bool = True) -> Column:
    """Which of ``shards`` parts of the work a key belongs to: by its hash, or as it is if it is an even number already."""
    return F.pmod(F.xxhash64(key) if hashed else key, F.lit(shards))


def work_shard(df: DataFrame, key: Column, shards: int, shard: int, hashed: bool = True) -> DataFrame:
    """The rows of one of ``shards`` parts of the work."""
    if not 0 <= shard < shards:
        raise ValueError("shard must be in 0..shards-1")
    return df.where(shard_of(key, shards, hashed) == shard)
