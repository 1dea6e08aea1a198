"""Tags: the vocabulary, the three-hop look-up from keyframes to domains, histogram and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.expr import SENTINEL_TAG
from framewright.operators.domain import active_mappings
from framewright.operators.orphans import same_key


def tag_vocab(domains: DataFrame) -> DataFrame:
    """tag, name, description of the live domains; tags count from 0 in the order of their ids (a fixed, small list)."""
    live = domains.where("deleted_at is null and domain_id is not null").groupBy(same_key("domain_id", True).alias("name")).agg(F.min("domain_label").alias("description"))
    return live.select((F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("tag"), "name", "description")


def compute_tags(frames: DataFrame, mapped: DataFrame, vocab: DataFrame, scene: str = "scene_idx", strict: bool = False) -> DataFrame:
    """point_id, tag: keyframe -> (video, scene) -> domain of the active analysis -> tag; 65535 where a hop finds nothing.

    A keyframe that comes again has one tag. Domains that are not in the vocabulary give no tag, and ``unknown_domains``
    lists them; with ``strict`` they are an error, as in a build whose vocabulary must be complete.
    """
    if strict and (unknown := unknown_domains(mapped, vocab).orderBy("domain_key").limit(20).collect()):
        raise ValueError(f"domains that are not in the vocabulary: {[r.domain_key for r in unknown]}")
    active = active_mappings(mapped).select("video_key", F.col("scene_id").alias("__s"), "domain_key").where("__s is not null")
    one = active.join(vocab.select(F.col("name").alias("domain_key"), "tag"), "domain_key").groupBy("video_key", "__s").agg(F.min("tag").alias("tag"))
    keyed = frames.select("point_id", same_key("video_name", True).alias("video_key"), F.col(scene).alias("__s")).where("point_id is not null").distinct()
    tagged = keyed.join(one, ["video_key", "__s"], "left").groupBy("point_id").agg(F.min("tag").alias("tag"))
    return tagged.select("point_id", F.coalesce("tag", F.lit(SENTINEL_TAG)).alias("tag"))


def unknown_domains(mapped: DataFrame, vocab: DataFrame) -> DataFrame:
    """domain_key, n of the active mappings whose domain is not in the vocabulary."""
    return active_mappings(mapped).where("domain_key is not null").join(vocab.select(F.col("name").alias("domain_key")), "domain_key", "left_anti").groupBy("domain_key").agg(F.count(F.lit(1)).alias("n"))


def tag_histogram(tags: DataFrame) -> DataFrame:
    """tag, n, first_row: counts for each tag from 0 to the largest assigned one, and where its rows begin; unassigned last.

    There are at most 65,536 tags, so the running sum is over a short list.
    """
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("tag") != SENTINEL_TAG).agg(F.max("tag").alias("m"))
    dense = top.where("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("tag"))
    every = dense.unionByName(counts.where(F.col("tag") == SENTINEL_TAG).select("tag"))
    before = Window.orderBy("tag").rowsBetween(Window.unboundedPreceding, -1)
    filled = every.join(counts, "tag", "left").na.fill(0, ["n"])
    return filled.select("tag", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"))


def tag_coverage(tags: DataFrame) -> DataFrame:
    """tag, n, share of the tagged rows, covered and total: how the corpus is spread over the tags."""
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(F.coalesce(F.sum(F.when(F.col("tag") != SENTINEL_TAG, F.col("n"))), F.lit(0)).alias("covered"), F.sum("n").alias("total"))
    return counts.where(F.col("tag") != SENTINEL_TAG).crossJoin(F.broadcast(sums)).select("tag", "n", F.round(F.col("n") / F.col("covered"), 6).alias("share"), "covered", "total")  # sums: one row


def vocab_with_counts(vocab: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, name, description, n (0 where no row has it)."""
    return vocab.join(tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag", "left").na.fill(0, ["n"]).select("tag", "name", "description", "n")


def check_tags(wanted: list[int], assigned_max: int) -> list[int]:
    """The distinct wanted tags; a tag beyond the largest assigned one is an error."""
    bad = [t for t in wanted if t < 0 or t > assigned_max]
    if bad:
        raise ValueError(f"tags out of range: {bad}")
    return list(dict.fromkeys(wanted))
