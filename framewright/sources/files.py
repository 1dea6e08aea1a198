"""Sources and sinks: embedding shards, scene and shot files, maps, vocabularies, object listings, documents.

Paths are Hadoop paths, so local and remote stores are read alike and in parallel on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 50_000
SCENES_SCHEMA = "scene_id int, script string, start_frame long, end_frame long, start_time double, end_time double, scene_url string"
SHOTS_SCHEMA = "shot_id int, start_frame long, end_frame long, start_ts double, end_ts double, kf0 long, kf1 long, kf2 long"
POINT_COLUMNS = {"point_id": "long", "video_id": "long", "video_name": "string", "group_name": "string", "frame": "long", "scene_idx": "int", "keyframe_time": "double", "start_sec": "double", "end_sec": "double", "objects": "array<string>", "has_ocr": "boolean", "has_speech": "boolean", "keyframe_key": "string", "clip_key": "string", "tier": "int", "dim": "int", "vector": "array<float>"}


def read_shards(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All embedding shards below ``root`` as one table: missing columns are null, others are cast to the contract.

    ``group`` is read as group_name. A column that only ever held nulls or empty lists takes its type from the contract.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mergeSchema", True).parquet(root)
    if "group" in raw.columns and "group_name" not in raw.columns:
        raw = raw.withColumnRenamed("group", "group_name")
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in POINT_COLUMNS.items()])


def write_shards(points: DataFrame, path: str, mode: str = "errorifexists", rows: int = SHARD_ROWS) -> None:
    """Shards of at most ``rows`` rows each."""
    points.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """scenes.json files (one array each) with group_name and video_name from the path; unknown fields are dropped."""
    raw = spark.read.schema(SCENES_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "scenes.json").json(path)
    parts = F.split(F.input_file_name(), "/")
    return raw.withColumn("video_name", F.element_at(parts, -2)).withColumn("group_name", F.regexp_replace(F.try_element_at(parts, F.lit(-4)), "^Keyscence_", ""))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """shots.csv files; the frames to extract become the array ``kf``."""
    raw = spark.read.schema(SHOTS_SCHEMA).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return raw.withColumn("kf", F.array_compact(F.array("kf0", "kf1", "kf2"))).drop("kf0", "kf1", "kf2")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """tag, name, description of a vocabulary file: {"0": "name"} or {"0": {"name": ..., "description": ...}}.

    A key that is no number, or a value of another kind, raises when the rows are read.
    """
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    tag = F.col("k").try_cast("int")
    obj = F.col("v").startswith("{")
    name = F.when(obj, F.get_json_object("v", "$.name")).otherwise(F.col("v"))
    bad = tag.isNull() | name.isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad vocabulary entry: "), F.col("k"))).cast("int")).otherwise(tag)
    return pairs.select(checked.alias("tag"), name.alias("name"), F.when(obj, F.get_json_object("v", "$.description")).otherwise(F.lit("")).alias("description"))


def read_keyframe_maps(spark: SparkSession, path: str, groups: Sequence[str] | None = None) -> DataFrame:
    """video_name, frame, scene_id of map files {groups, videos: {video: {keyframes: [{frame, scene_id}]}}}.

    ``groups`` keeps the files that share a group. Keyframes without a scene are left out; of two files with one
    (video, frame) the later path wins.
    """
    schema = "groups array<string>, videos map<string,struct<keyframes:array<struct<frame:long,scene_id:int>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__p", F.input_file_name())
    if groups is not None:
        docs = docs.where(F.arrays_overlap("groups", F.array(*[F.lit(g) for g in groups]).cast("array<string>")))
    rows = docs.select("__p", F.explode("videos").alias("video_name", "v")).select("__p", "video_name", F.explode("v.keyframes").alias("k")).where("k.scene_id is not null")
    return rows.groupBy("video_name", F.col("k.frame").alias("frame")).agg(F.max_by("k.scene_id", "__p").alias("scene_id"))


def list_objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of every object below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def discover_sources(objects: DataFrame, *, files: Sequence[str] | None = None, key: str | None = None, video: str | None = None, groups: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """The scenes.json objects in scope, with group_name and video_name, sorted by key.

    The narrowest scope given wins: a list of files, one key, a video, groups, a prefix, or everything. ``objects`` has
    ``key`` (the path within the store). A group that no object has is an error.
    """
    parts = F.split("key", "/")
    found = objects.where((F.size(parts) == 4) & (F.get(parts, F.lit(1)) == "keyscence") & (F.get(parts, F.lit(3)) == "scenes.json"))
    found = found.withColumn("group_name", F.regexp_replace(F.get(parts, F.lit(0)), "^Keyscence_", "")).withColumn("video_name", F.get(parts, F.lit(2)))
    if files is not None:
        found = found.where(F.col("key").isin(list(files)))
    elif key is not None:
        found = found.where(F.col("key") == key)
    elif video is not None:
        found = found.where(F.col("video_name").startswith(video))
    elif groups is not None:
        wanted = sorted({normalize_group(g) for g in groups})
        there = {r.group_name for r in found.where(F.col("group_name").isin(wanted)).select("group_name").distinct().collect()}
        if missing := [g for g in wanted if g not in there]:
            raise ValueError(f"unknown groups: {missing}")
        found = found.where(F.col("group_name").isin(wanted))
    elif prefix is not None:
        found = found.where(F.col("key").startswith(prefix))
    return found.dropDuplicates(["key"]).orderBy("key")


def normalize_group(name: str) -> str:
    """'L26_b' of ' Keyscence_L26_b/ '."""
    bare = name.strip().strip("/")
    if not bare:
        raise ValueError("empty group name")
    return bare.removeprefix("Keyscence_")


def parse_store_uri(uri: str) -> tuple[str, str]:
    """Bucket and key of 's3://bucket/key'."""
    scheme, _, rest = uri.partition("://")
    bucket, _, key = rest.partition("/")
    if scheme not in ("s3", "s3a") or not bucket:
        raise ValueError(f"not an object store address: {uri}")
    return bucket, key.strip("/")


def find_videos(objects: DataFrame) -> DataFrame:
    """The .mp4 objects in a folder named video, or all .mp4 objects if there is none; sorted."""
    clips = objects.where(F.col("path").endswith(".mp4")).withColumn("__v", F.col("path").rlike(r"/video/[^/]+\.mp4$"))
    any_v = clips.agg(F.coalesce(F.max("__v"), F.lit(False)).alias("__a"))
    return clips.crossJoin(F.broadcast(any_v)).where(F.col("__v") | ~F.col("__a")).drop("__v", "__a").orderBy("path")  # any_v: one row


def probe_fields(probe: DataFrame, column: str = "probe") -> DataFrame:
    """width, height, fps (numerator over denominator), n_frames (-1 if unknown) of probe output as JSON text."""
    s = lambda f: F.get_json_object(column, f"$.streams[0].{f}")
    rate = F.split(s("r_frame_rate"), "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return probe.withColumns({"width": s("width").try_cast("int"), "height": s("height").try_cast("int"), "fps": fps, "n_frames": F.coalesce(s("nb_frames").try_cast("long"), F.lit(-1).cast("long"))})


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and sha256 of every file below ``root``, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def group_documents(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """One JSON document for each group with header counts and its videos' keyframes and scenes.

    Videos are assembled first and groups from them, so the largest thing in a task is one group's document, as asked.
    """
    k = frames.groupBy("group_name", "video_name").agg(F.array_sort(F.collect_list(F.struct("frame", "scene_id"))).alias("keyframes"))
    s = scenes.groupBy("group_name", "video_name").agg(F.array_sort(F.collect_list(F.struct("scene_id", "start_frame", "end_frame"))).alias("scenes"))
    v = k.join(s, ["group_name", "video_name"], "full").select("group_name", F.struct("video_name", "keyframes", "scenes").alias("v"), F.coalesce(F.size("keyframes"), F.lit(0)).alias("nk"), F.coalesce(F.size("scenes"), F.lit(0)).alias("ns"))
    doc = v.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_videos"), F.sum("nk").alias("n_keyframes"), F.sum("ns").alias("n_scenes"), F.array_sort(F.collect_list("v")).alias("videos"))
    return doc.select("group_name", F.to_json(F.struct("n_videos", "n_keyframes", "n_scenes", "videos")).alias("document"))


def flat_map(frames: DataFrame, scenes: DataFrame, path: str | None = None) -> DataFrame:
    """Keyframes with their scenes' fields, one row each; written as CSV with a header if ``path`` is given."""
    s = scenes.select("video_name", F.col("scene_id"), F.col("start_frame").alias("scene_start_frame"), F.col("end_frame").alias("scene_end_frame"), F.col("start_time").alias("scene_start_time"), F.col("end_time").alias("scene_end_time"))
    out = frames.join(s, ["video_name", "scene_id"], "left").withColumn("keyframe_id", F.format_string("%s#%06d", "video_name", "frame"))
    if path:
        out.write.mode("overwrite").option("header", True).csv(path)
    return out


def payload_rows(frames: DataFrame, scenes: DataFrame, video_id: str = "video_id") -> DataFrame:
    """Payload of keyframes from their assigned scene: its interval, has_speech (a script that is not empty), ids, keys."""
    s = scenes.select("video_name", "scene_id", "start_time", "end_time", "script", "clip_key")
    joined = frames.join(s, ["video_name", "scene_id"], "left")
    return joined.select(F.shiftleft(F.col(video_id).cast("long"), 32).bitwiseOR(F.col("frame")).alias("point_id"), "video_name", "frame", F.col("scene_id").alias("scene_idx"), F.col("start_time").alias("start_sec"), F.col("end_time").alias("end_sec"), F.coalesce(F.length("script") > 0, F.lit(False)).alias("has_speech"), F.array().cast("array<string>").alias("objects"), F.lit(False).alias("has_ocr"), F.concat("video_name", F.lit("/keyframes/"), F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".webp")).alias("keyframe_key"), "clip_key")


