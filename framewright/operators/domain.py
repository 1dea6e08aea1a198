"""Domain analyses of videos: validation, merging, roll-up, versions, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.expr import keyword_form, normalize_keywords
from framewright.operators.orphans import first_loaded, same_key


def segments_once(segments: DataFrame) -> DataFrame:
    """One row for each (analysis_id, segment_idx), as first loaded."""
    return first_loaded(segments, ["analysis_id", "segment_idx"], "loaded_at", segments.columns)


def coverage_check(segments: DataFrame) -> DataFrame:
    """analysis_id, segment_idx, problem: 'gap', 'overlap', 'inverted' or null for each segment, by the one before it.

    The first segment must begin at scene 0. An analysis has as many segments as a video has scenes at the most, so its
    window is small.
    """
    w = Window.partitionBy("analysis_id").orderBy("segment_idx")
    expected = F.coalesce(F.lag("end_scene_id").over(w) + 1, F.lit(0))
    start, end = F.col("start_scene_id"), F.col("end_scene_id")
    problem = F.when(end < start, "inverted").when(start > expected, "gap").when(start < expected, "overlap")
    return segments.select("analysis_id", "segment_idx", problem.alias("problem"))


def topic_check(segments: DataFrame, topics: DataFrame) -> DataFrame:
    """analysis_id, segment_idx of the segments whose topic is none of their domain's (null ones too)."""
    allowed = topics.select(same_key("domain_id", True).alias("__d"), same_key("topic_id", True).alias("__t")).distinct()
    keyed = segments.select("analysis_id", "segment_idx", same_key("domain_id", True).alias("__d"), same_key("topic_id", True).alias("__t"))
    return keyed.join(allowed, ["__d", "__t"], "left_anti").select("analysis_id", "segment_idx")


def _fold(old: Column, new: Column) -> Column:
    return F.when(F.coalesce(new, F.lit("")) == "", old).when(F.coalesce(old, F.lit("")) == "", new).when(F.contains(old, new), old).otherwise(F.concat_ws(" ", old, new))


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Neighbouring segments with one domain, topic and sub-domain (whatever its case) as one.

    Keywords are joined in order, each once, four at the most; a summary is added unless the one so far contains it.
    Columns: analysis_id, segment_idx (from 0), start_scene_id, end_scene_id, domain_id, topic_id, sub_domain, keywords,
    summary.
    """
    w = Window.partitionBy("analysis_id").orderBy("segment_idx")
    same = lambda c: F.coalesce(F.lag(c).over(w).eqNullSafe(c), F.lit(False))
    lowered = segments.withColumn("__s", F.lower("sub_domain")).withColumn("__n", F.row_number().over(w))
    flagged = lowered.withColumn("__new", F.when((F.col("__n") > 1) & same(F.col("domain_id")) & same(F.col("topic_id")) & same(F.col("__s")), 0).otherwise(1))
    island = flagged.withColumn("__i", F.sum("__new").over(w))
    rows = F.array_sort(F.collect_list(F.struct("segment_idx", "end_scene_id", "keywords", "summary", "domain_id", "topic_id", "sub_domain", "start_scene_id")))
    runs = island.groupBy("analysis_id", "__i").agg(rows.alias("r"))
    words = normalize_keywords(F.flatten(F.transform("r", lambda x: F.coalesce(x["keywords"], F.array().cast("array<string>")))))
    summary = F.aggregate(F.transform("r", lambda x: x["summary"]), F.lit("").cast("string"), _fold)
    first, last = F.col("r")[0], F.element_at("r", -1)
    return runs.select("analysis_id", (F.col("__i") - 1).alias("segment_idx"), first["start_scene_id"].alias("start_scene_id"), last["end_scene_id"].alias("end_scene_id"), first["domain_id"].alias("domain_id"), first["topic_id"].alias("topic_id"), first["sub_domain"].alias("sub_domain"), words.alias("keywords"), summary.alias("summary"))


def rollup(segments: DataFrame) -> DataFrame:
    """analysis_id, primary_domain, is_multi_domain, is_multi_topic, is_multi_segment.

    ``segments`` has start_time and end_time; a segment weighs its duration, 0.001 s at the least. Of domains of equal
    weight the one of the earliest segment is primary.
    """
    weight = F.greatest(F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0.0)), F.lit(0.001))
    per = segments.groupBy("analysis_id", "domain_id").agg(F.round(F.sum(weight), 6).alias("w"), F.min("segment_idx").alias("first"), F.collect_set(F.struct("topic_id")).alias("topics"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("analysis_id").agg(
        F.max_by("domain_id", F.struct("w", -F.col("first"))).alias("primary_domain"),
        (F.count(F.lit(1)) > 1).alias("is_multi_domain"),
        (F.sum(F.size("topics")) > 1).alias("is_multi_topic"),
        (F.sum("n") > 1).alias("is_multi_segment"),
    )


def active_versions(mapped: DataFrame) -> DataFrame:
    """video_key, analysis_id: the analysis of each video that was completed (last loaded) most recently.

    Repeated rows count as first loaded. The pointer is one map-side maximum per video.
    """
    once = mapped.groupBy("map_id").agg(F.min(F.struct("loaded_at", "external_video_id", "analysis_id")).alias("r")).select("r.*")
    keyed = once.select(same_key("external_video_id", True).alias("video_key"), "analysis_id", "loaded_at").where("video_key is not null and analysis_id is not null")
    done = keyed.groupBy("video_key", "analysis_id").agg(F.max("loaded_at").alias("done"))
    return done.groupBy("video_key").agg(F.max_by("analysis_id", F.struct("done", "analysis_id")).alias("analysis_id"))


def active_mappings(mapped: DataFrame) -> DataFrame:
    """The rows of the active analyses, once each, with video_key and the normalised domain_key."""
    once = first_loaded(mapped, ["map_id"], "loaded_at", mapped.columns)
    keyed = once.withColumn("video_key", same_key("external_video_id", True)).withColumn("domain_key", same_key("domain_id", True))
    return keyed.join(active_versions(mapped), ["video_key", "analysis_id"])


def find_by_keyword(active: DataFrame, keyword: str) -> DataFrame:
    """Active mappings with the keyword, compared after normalisation."""
    return active.where(F.array_contains(normalize_keywords(F.col("keywords"), 1_000_000), keyword_form(keyword)))


def find_by_topic(active: DataFrame, topic: str) -> DataFrame:
    """Active mappings of the topic."""
    return active.where(same_key("topic_id", True) == topic.strip().lower())


def is_active(jobs: DataFrame, wanted: DataFrame, force: bool = False) -> DataFrame:
    """source_id, up_to_date: whether the active version of a source has the wanted content hash and fingerprint."""
    hit = wanted.join(jobs.select("source_id", F.col("content_hash").alias("__c"), F.col("fingerprint").alias("__f")), "source_id", "left")
    same = F.coalesce((F.col("__c") == F.col("content_hash")) & (F.col("__f") == F.col("fingerprint")), F.lit(False))
    return hit.select("source_id", (same & F.lit(not force)).alias("up_to_date"))


def expand_segments(segments: DataFrame) -> DataFrame:
    """A row for each scene of each segment (inverted and null ranges give none)."""
    good = segments.where("start_scene_id <= end_scene_id")
    return good.withColumn("scene_id", F.explode(F.sequence("start_scene_id", "end_scene_id")))
