"""Shots, keyframes, scenes and transcripts: sampling, islands, as-of and nearest matching, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ordered import spread_last, spread_prefix_sum

#: Frames of one bucket of a video; a video is spread over as many tasks as it has buckets.
BUCKET = 1 << 16


def frames_bucket(frame: str = "pos") -> Column:
    return F.floor(F.col(frame) / BUCKET)


def keyframe_indices(start: Column, end: Column, n: int = 3, inset: float = 0.12) -> Column:
    """``n`` frames spread evenly over a shot without its inset ends; a shot that the inset eats up gives its middle."""
    off = F.floor(F.greatest(end - start, F.lit(0)) * inset).cast("long")
    low, high = start + off, end - off
    middle = F.floor((start + end) / 2).cast("long")
    lo, hi = F.when(high < low, middle).otherwise(low), F.when(high < low, middle).otherwise(high)
    clip = lambda x: F.greatest(start, F.least(end, x))
    if n <= 1:
        return F.array(clip(F.floor((lo + hi) / 2).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: clip(F.floor(lo + (hi - lo) * i / (n - 1)).cast("long")))


def boundaries_to_scenes(shots: DataFrame, key: str, order: str, start: str, end: str, prob: str, threshold: float = 0.55, bucket: Column | None = None) -> DataFrame:
    """Scenes as runs of shots: a scene ends after a shot whose boundary probability is above ``threshold``.

    Columns: key, scene_id (from 0), start, end, n_shots, confidence (the probability at its end to 4 decimals; 1 for
    the last scene). A null probability is no boundary. ``order`` is unique within a key.
    """
    cut = shots.select(key, order, F.col(start).alias("start"), F.col(end).alias("end"), F.col(prob).alias("p"), F.coalesce((F.col(prob) > threshold).cast("long"), F.lit(0)).alias("__c"))
    closed = spread_prefix_sum(cut, [key], bucket if bucket is not None else F.floor(F.col(order) / BUCKET), [order], "__c", "__n")
    island = closed.withColumn("scene_id", F.col("__n") - F.col("__c"))
    runs = island.groupBy(key, "scene_id").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.count(F.lit(1)).alias("n_shots"), F.max(F.when(F.col("__c") == 1, F.round("p", 4))).alias("__p"))
    return runs.select(key, "scene_id", "start", "end", "n_shots", F.coalesce("__p", F.lit(1.0)).alias("confidence"))


def _order(scenes: DataFrame, key: str) -> DataFrame:
    """Scenes numbered by start and end within their video (n from 1), with the next one's fields; usable bounds only."""
    good = scenes.where(f"{key} is not null and start_frame is not null and end_frame is not null and start_frame <= end_frame").select(key, "scene_id", "start_frame", "end_frame", "start_time", "end_time", F.col("start_frame").alias("pos"), F.lit(1).cast("long").alias("__one"))
    return spread_prefix_sum(good, [key], frames_bucket(), ["pos", "end_frame", "scene_id"], "__one", "n").drop("__one", "pos")


def asof_scene(frames: DataFrame, scenes: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """Adds ``hit``: the last scene of the video that starts at or before the frame (ties: the later end, then id).

    ``hit`` has n, scene_id, start_frame, end_frame, start_time, end_time; null if no scene starts so early. A union of
    both sides and a carried last value: no pair of a frame and a scene is built, and a long video is spread over tasks.
    """
    ordered = _order(scenes, key)
    entry = F.struct("n", "scene_id", "start_frame", "end_frame", "start_time", "end_time")
    left = ordered.select(F.col(key).alias("k"), F.col("start_frame").alias("pos"), F.lit(0).alias("side"), F.col("n").alias("tie"), entry.alias("s"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in frames.dtypes) + ">").alias("f"))
    right = frames.select(F.col(key).alias("k"), F.col(frame).cast("long").alias("pos"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(left.schema["s"].dataType).alias("s"), F.struct(*frames.columns).alias("f"))
    both = spread_last(left.unionByName(right), ["k"], frames_bucket(), ["pos", "side", "tie"], F.col("s"), "hit")
    return both.where("side = 1").select("f.*", "hit")


def containing_scene(frames: DataFrame, scenes: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """``asof_scene`` where the scene still runs at the frame; else, and for negative frames, ``hit`` is null."""
    got = asof_scene(frames, scenes, key, frame)
    return got.withColumn("hit", F.when((F.col("hit.end_frame") >= F.col(frame)) & (F.col(frame) >= 0), F.col("hit")))


def match_scene(frames: DataFrame, scenes: DataFrame, key: str, frame: str = "frame", at: str = "keyframe_time") -> DataFrame:
    """Adds match_scene_id and match: 'frame', 'time', 'nearest' or 'none'.

    The scene i is the last to start by the frame. It matches by frame if it still runs; else i, then i + 1, if the
    time lies in it; else the nearer of i and i + 1 by frames (ties: i). Videos without usable scenes give 'none'.
    """
    ordered = _order(scenes, key)
    entry = F.struct("scene_id", "start_frame", "end_frame", "start_time", "end_time")
    by_n = ordered.select(F.col(key).alias("__k"), F.col("n").alias("__n"), entry.alias("next"))
    got = asof_scene(frames, scenes, key, frame).withColumn("__at", F.coalesce(F.col("hit.n"), F.lit(0)) + 1)
    pair = got.join(by_n, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__n")), "left")
    f = F.col(frame)
    gap = lambda s: F.when(f.between(F.col(f"{s}.start_frame"), F.col(f"{s}.end_frame")), 0).otherwise(F.least(F.abs(f - F.col(f"{s}.start_frame")), F.abs(f - F.col(f"{s}.end_frame"))))
    inside = lambda s: F.coalesce(F.col(at).between(F.col(f"{s}.start_time"), F.col(f"{s}.end_time")), F.lit(False))
    i, j = F.col("hit").isNotNull(), F.col("next").isNotNull()
    by_frame = i & (f <= F.col("hit.end_frame"))
    match = F.when(~i & ~j, "none").when(by_frame, "frame").when(inside("hit") | inside("next"), "time").otherwise("nearest")
    first = by_frame | inside("hit") | (~inside("next") & i & (~j | (gap("hit") <= gap("next"))))
    return pair.select(*frames.columns, F.when(first, F.col("hit.scene_id")).otherwise(F.col("next.scene_id")).alias("match_scene_id"), match.alias("match"))


def assign_scene(frames: DataFrame, scenes: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """Adds assigned_scene_id: the first scene, in order of its start, by whose end the frame has come; the last scene takes the rest.

    Ends are replaced by their running maximum, so scenes that nest do not take frames twice; then the rule is an as-of
    join backwards: the first scene with running end >= frame. Frames of videos without usable scenes get null.
    """
    ordered = _order(scenes, key)
    steps = ordered.select(key, "n", "scene_id", "end_frame")
    # a scene counts only if it reaches beyond all before it; others can never be the first to contain a frame
    run = steps.select(F.col(key).alias("k"), F.col("end_frame").alias("pos"), F.struct("n", "scene_id").alias("s"))
    first_at = run.groupBy("k", "pos").agg(F.min("s").alias("s")).withColumn("neg", -F.col("pos")).withColumn("side", F.lit(0))
    right = frames.select(F.col(key).alias("k"), F.col(frame).cast("long").alias("pos"), F.lit(None).cast(first_at.schema["s"].dataType).alias("s"), (-F.col(frame).cast("long")).alias("neg"), F.lit(1).alias("side"), F.struct(*frames.columns).alias("f"))
    left = first_at.withColumn("f", F.lit(None).cast(right.schema["f"].dataType))
    both = left.unionByName(right).withColumn("b", F.floor(F.col("neg") / BUCKET))
    # over falling position: the smallest n among the scenes that end at or after the frame
    w = Window.partitionBy("k", "b").orderBy("neg", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.groupBy("k", "b").agg(F.min("s").alias("m")).withColumn("before", F.min("m").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("k", "b", "before")
    got = both.withColumn("in_b", F.min("s").over(w)).join(carried, ["k", "b"]).withColumn("first", F.least("in_b", "before")).where("side = 1")
    last = ordered.groupBy(F.col(key).alias("k")).agg(F.max_by("scene_id", "n").alias("last_id"))
    return got.join(last, "k", "left").select("f.*", F.coalesce("first.scene_id", "last_id").alias("assigned_scene_id"))


def neighbours(frames: DataFrame, key: str, anchors: DataFrame, before: int = 25, after: int = 25, frame: str = "frame") -> DataFrame:
    """anchor_frame, key, frame, offset: the frames around each anchor (key, anchor_frame) in frame order, without itself.

    Frames are numbered once by spread ranks; each anchor then meets its own few numbers by an equi-join. An anchor that
    is no frame of its video gives no rows. Bounds are 0..200.
    """
    if not (0 <= before <= 200 and 0 <= after <= 200):
        raise ValueError("before and after must be in 0..200")
    distinct = frames.select(F.col(key).alias("k"), F.col(frame).cast("long").alias("pos"), F.lit(1).cast("long").alias("one")).where("k is not null and pos is not null").distinct()
    ranked = spread_prefix_sum(distinct, ["k"], frames_bucket(), ["pos"], "one", "rn").drop("one")
    at = anchors.select(F.col(key).alias("k"), F.col("anchor_frame").cast("long").alias("pos")).distinct().join(ranked, ["k", "pos"])
    near = at.select("k", F.col("pos").alias("anchor_frame"), F.col("rn").alias("__a"), F.explode(F.sequence(F.col("rn") - before, F.col("rn") + after)).alias("rn")).where("rn <> __a")
    return near.join(ranked, ["k", "rn"]).select(F.col("k").alias(key), "anchor_frame", F.col("pos").alias("frame"), (F.col("rn") - F.col("__a")).alias("offset"))


def assign_script(scenes: DataFrame, pieces: DataFrame, key: str, seconds: float = 60.0) -> DataFrame:
    """key, scene_id, script: the texts whose middle lies in the scene (both ends included), in order of ``seq``.

    ``scenes`` has start_time and end_time, ``pieces`` start, end, seq, text. Both meet by minute of the video, so the
    join is an equi-join whose buckets stay small. Scenes without texts have ''; scenes without times too.
    """
    spans = scenes.where("start_time <= end_time").select(key, "scene_id", "start_time", "end_time", F.explode(F.sequence(F.floor(F.col("start_time") / seconds), F.floor(F.col("end_time") / seconds))).alias("__b"))
    mids = pieces.select(key, "seq", "text", ((F.col("start") + F.col("end")) / 2).alias("mid")).withColumn("__b", F.floor(F.col("mid") / seconds))
    held = spans.join(mids, [key, "__b"]).where("mid between start_time and end_time")
    texts = held.groupBy(key, "scene_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")).alias("script"))
    return scenes.select(key, "scene_id").distinct().join(texts, [key, "scene_id"], "left").na.fill("", ["script"])


def frame_to_shot(shots: DataFrame, key: str) -> DataFrame:
    """key, frame, shot_id from shots with an array ``kf``; a frame of two shots belongs to the smaller id."""
    return shots.select(key, F.explode("kf").alias("frame"), "shot_id").groupBy(key, "frame").agg(F.min("shot_id").alias("shot_id"))
