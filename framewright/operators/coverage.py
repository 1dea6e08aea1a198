"""Continuous periods and gaps of overlapping integer intervals, by a sweep line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import spread_prefix_sum
from framewright.session import checkpointed

BUCKET = 1 << 16


def periods_and_gaps(spans: DataFrame, key: str, start: str, end: str, bucket_width: int = BUCKET) -> DataFrame:
    """The maximal covered runs ('period') and the uncovered runs between them ('gap') of each ``key``.

    ``start`` and ``end`` are integers, both included. Every span becomes +1 at its start and -1 just after its end;
    the events are netted per position before any shuffle, prefix-summed bucket by bucket, and the running count's
    ways from and to zero bound the periods. Rows with a null key or bound, or with end before start, are left out;
    repeated rows change nothing; other columns are ignored. An empty table gives no rows.

    Columns: span_kind, ``key``, ``start``, ``end``.
    """
    clean = spans.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("k is not null and s <= e")
    events = (
        clean.select("k", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col("e") + 1).alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("x"))
        .groupBy("k", F.col("x.pos").alias("pos"))
        .agg(F.sum("x.d").alias("d"))
        .where("d <> 0")
    )
    bucket = F.floor(F.col("pos") / bucket_width)
    # each prefix sum reads its input twice (rows and bucket totals); what is written once is not computed twice
    active = spread_prefix_sum(checkpointed(events), ["k"], bucket, ["pos"], "d", "n")
    bounds = checkpointed(active.withColumn("was", F.col("n") - F.col("d")).where("(was = 0) <> (n = 0)").select("k", "pos", (F.col("was") == 0).cast("long").alias("opens")))
    numbered = spread_prefix_sum(bounds, ["k"], bucket, ["pos"], "opens", "i")
    pos, i, null = F.col("pos"), F.col("i"), F.lit(None).cast("long")
    part = lambda kind, i, s, e: F.struct(F.lit(kind).alias("span_kind"), i.alias("i"), s.alias("s"), e.alias("e"))
    opening = F.array(part("period", i, pos, null), part("gap", i - 1, null, pos - 1))
    closing = F.array(part("period", i, null, pos - 1), part("gap", i, pos, null))
    parts = numbered.select("k", F.explode(F.when(F.col("opens") == 1, opening).otherwise(closing)).alias("x")).select("k", "x.*")
    whole = parts.groupBy("span_kind", "k", "i").agg(F.max("s").alias("s"), F.max("e").alias("e")).where("s is not null and e is not null")
    return whole.select("span_kind", F.col("k").alias(key), F.col("s").alias(start), F.col("e").alias(end))


def scene_spans(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """video_name, start_frame, end_frame of each scene; a null bound is its time times the video's fps, rounded half up.

    The video is the one of the scene's video_id or, where that refers to none with a rate, the one of its video_name.
    Only scenes that lack a bound meet the videos, so the joins stay small. Scenes whose bound cannot be had (no video,
    no fps, no time, or a time that is not finite) keep a null there.
    """
    known = "start_frame is not null and end_frame is not null"
    rates = videos.where("fps > 0")
    first = lambda key, out: rates.where(f"{key} is not null").groupBy(key).agg(F.min_by("fps", F.struct("created_at", "fps")).alias(out))
    fps = F.coalesce("fps_of_id", "fps_of_name")
    bound = lambda frame, t: F.coalesce(frame, F.when(F.abs(F.col(t)) < 1e12, F.round(F.col(t) * fps).cast("long")))
    whole = scenes.where(known).select("video_name", "start_frame", "end_frame")
    rest = scenes.where(f"not ({known})").select("video_id", "video_name", "start_frame", "end_frame", "start_time", "end_time")
    rest = rest.join(first("video_id", "fps_of_id"), "video_id", "left").join(first("video_name", "fps_of_name"), "video_name", "left")
    filled = rest.select("video_name", bound("start_frame", "start_time").alias("start_frame"), bound("end_frame", "end_time").alias("end_frame"))
    return whole.unionByName(filled)
