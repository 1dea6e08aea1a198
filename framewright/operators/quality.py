"""Invariants of a snapshot as one report, latency figures, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.expr import l2_norm

NORM_TOLERANCE, SAMPLES = 1e-3, 4096


def norm_report(points: DataFrame, vector: str = "vector", dim: int = 64) -> DataFrame:
    """n, n_null, n_dim, n_nan, n_zero, n_off_norm, min_norm, max_norm over every row, none sampled (norms of usable rows)."""
    v = F.col(vector)
    sized = F.coalesce(F.size(v) == dim, F.lit(False))
    nan = F.exists(v, lambda x: F.isnan(x) | x.isNull())
    flat = points.select(v.isNull().alias("null"), (v.isNotNull() & ~sized).alias("dim"), (sized & nan).alias("nan"), F.when(sized & ~nan, l2_norm(v)).alias("norm"))
    good = F.when(F.col("norm") > 0, F.col("norm"))
    return flat.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("null").alias("n_null"),
        F.count_if("dim").alias("n_dim"),
        F.count_if("nan").alias("n_nan"),
        F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.count_if(F.abs(good - 1) > NORM_TOLERANCE).alias("n_off_norm"),
        F.round(F.min(good), 5).alias("min_norm"),
        F.round(F.max(good), 5).alias("max_norm"),
    )


def raise_if_failed(checks: DataFrame) -> None:
    """Raises on the first failed rows of a report (check, failed, detail)."""
    bad = checks.where("failed").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in bad))


def id_gaps(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """key, n, min_id, max_id, contiguous: whether the distinct ids of a key are 0..n-1."""
    got = rows.where(F.col(key).isNotNull() & F.col(id_).isNotNull()).groupBy(key).agg(F.countDistinct(id_).alias("n"), F.min(id_).alias("min_id"), F.max(id_).alias("max_id"))
    return got.withColumn("contiguous", (F.col("min_id") == 0) & (F.col("max_id") == F.col("n") - 1))


def latency_percentiles(samples: DataFrame, stage: str, at: Sequence[str], value: str, last: int = SAMPLES) -> DataFrame:
    """stage, n, p50, p95, p99 of the ``last`` samples of each stage (numpy's linear interpolation).

    A cheap range of time is cut first: samples are counted per day, and only days that can hold one of the last ones
    are ranked, so a stage with a third of all samples is not sorted in one task.
    """
    timed = samples.select(F.col(stage).alias("stage"), *at, F.col(value).alias("v")).where(F.col("v").isNotNull()).withColumn("__d", F.to_date(at[0]))
    days = timed.groupBy("stage", "__d").agg(F.count(F.lit(1)).alias("c"))
    later = Window.partitionBy("stage").orderBy(F.col("__d").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    needed = days.withColumn("__after", F.coalesce(F.sum("c").over(later), F.lit(0))).where(F.col("__after") < last)
    same = timed["stage"].eqNullSafe(needed["stage"]) & timed["__d"].eqNullSafe(needed["__d"])
    held = timed.join(needed.select("stage", "__d"), same, "left_semi")
    newest = Window.partitionBy("stage").orderBy(*[F.col(c).desc() for c in at])
    kept = held.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    p = F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return kept.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), p.alias("p")).select("stage", "n", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def counts(df: DataFrame, by: str) -> DataFrame:
    """by, n, share."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # total: one row


def timeline_check(pieces: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """key, last_piece, last_scene, plausible: whether transcripts end within 0.3..1.5 times the scenes."""
    a = pieces.groupBy(key).agg(F.max("end").alias("last_piece"))
    b = scenes.groupBy(key).agg(F.max("end_time").alias("last_scene"))
    ratio = F.try_divide("last_piece", "last_scene")
    return a.join(b, key, "full").withColumn("plausible", F.coalesce(ratio.between(0.3, 1.5), F.lit(False)))
