"""Queries over the sources, sinks, jobs, collections and streams, each with its SQL.

What a query writes goes to the shared checkpoint folder and is read back from there, as a service would read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import expr as X
from framewright.operators import jobs as J
from framewright.operators import points as P
from framewright.operators import quality as Q
from framewright.operators import scenes as C
from framewright.operators import search as S
from framewright.operators import tags as T
from framewright.plans.catalog import Catalog
from framewright.plans.reference_queries import ANCHOR, LISTS, PTS, SCENES, SCORED, SQ8, USABLE_SCENES, _anchor, _points, _scenes, _two_lists
from framewright.session import ensure_checkpoint_dir, table
from framewright.sources import files as FS
from framewright.sources.snapshot import load_snapshot, write_snapshot
from framewright.streaming import streams as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/service-{uuid.uuid4().hex}"


def _unit_points(spark: SparkSession, d: str) -> DataFrame:
    """The usable points, each once, with unit vectors."""
    once = X.usable(_points(spark, d)).groupBy("point_id").agg(F.max("video_name").alias("video_name"), F.max("video_id").alias("video_id"), F.max("frame").alias("frame"), F.first("vector").alias("v"))
    return once.select("point_id", "video_name", "video_id", "frame", X.l2_normalize(F.col("v")).cast("array<float>").alias("vector"))


# sources and sinks


@query("select point_id, video_name, frame, len(vector)::int n_values from keyframes")
def shard_round_trip(spark, d):
    """Embedding shards written and read back under the contract."""
    path = _folder(spark)
    FS.write_shards(table(spark, d, "keyframes"), path)
    return FS.read_shards(spark, path).select("point_id", "video_name", "frame", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("n_values"))


@query(f"with {PTS} select point_id, video_name, (select count(*) from pts) manifest_count from pts")
def snapshot_round_trip(spark, d):
    """A snapshot with its manifest and checksums, written, checked and loaded."""
    path = write_snapshot(_unit_points(spark, d), _folder(spark), 1, encoder="stand-in", dim=64)
    snap = load_snapshot(spark, path, dim=64, encoder="stand-in")
    return snap.points.select("point_id", "video_name", F.lit(snap.manifest["count"]).cast("long").alias("manifest_count"))


@query(f"with {PTS}, gone as (select distinct video_id from videos where deleted_at is not null and video_id is not null) select point_id, 3::bigint as version from pts where video_id is null or video_id not in (select video_id from gone)")
def collection_compacted(spark, d):
    """A collection's second version marks the points of deleted videos, its third lacks them; an alias serves it."""
    catalog, points = Catalog(spark, _folder(spark)), _unit_points(spark, d)
    gone = table(spark, d, "videos").where("deleted_at is not null and video_id is not null").select("video_id").distinct()
    catalog.add("frames", points, encoder="stand-in", dim=64)
    catalog.add("frames", P.delete(points, gone, "video_id"), encoder="stand-in", dim=64)
    version = catalog.optimize("frames")
    catalog.set_alias("current", "frames")
    return catalog.open("current", dim=64).points.select("point_id", F.lit(version).cast("long").alias("version"))


@query("with v as (select (row_number() over (order by name) - 1)::int tag, name, description from (select lower(trim(domain_id)) name, min(domain_label) description from domains where deleted_at is null and domain_id is not null group by 1)) select tag, name, coalesce(description, '') description from v")
def vocab_file(spark, d):
    """The vocabulary as one JSON file, written and read back."""
    path = _folder(spark)
    vocab = T.tag_vocab(table(spark, d, "domains"))
    entry = F.struct(F.col("tag").cast("string").alias("k"), F.struct("name", F.coalesce("description", F.lit("")).alias("description")).alias("v"))
    vocab.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")).coalesce(1).write.text(path)  # some dozens of entries
    return FS.read_vocab(spark, path).select("tag", "name", "description")


@query("select video_name, frame, max(scene_idx) scene_id from keyframes where video_name is not null and frame is not null and scene_idx is not null and group_name is not null group by 1, 2")
def keyframe_maps(spark, d):
    """Map files, one for each group, written and read back as rows."""
    path = _folder(spark)
    k = _points(spark, d).where("video_name is not null and frame is not null and scene_idx is not null and group_name is not null").groupBy("group_name", "video_name", "frame").agg(F.max("scene_idx").alias("scene_id"))
    v = k.groupBy("group_name", "video_name").agg(F.struct(F.collect_list(F.struct("frame", "scene_id")).alias("keyframes")).alias("v"))
    docs = v.groupBy("group_name").agg(F.map_from_entries(F.collect_list(F.struct("video_name", "v"))).alias("videos")).select(F.to_json(F.struct(F.array("group_name").alias("groups"), "videos")).alias("value"))
    docs.write.option("maxRecordsPerFile", 1).text(path)
    return FS.read_keyframe_maps(spark, path)


@query(f"with {SCENES}, k as (select distinct group_name, video_name, frame, scene_idx from keyframes where point_id is not null and group_name is not null), s as (select group_name, video_name, scene_id, start_frame, end_frame from sc where group_name is not null), a as (select group_name, count(*) n from k group by 1), b as (select group_name, count(*) n from s group by 1), v as (select group_name, count(distinct coalesce(video_name, '<null>')) n from (select group_name, video_name from k union select group_name, video_name from s) group by 1) select v.group_name, v.n n_videos, coalesce(a.n, 0) n_keyframes, coalesce(b.n, 0) n_scenes from v left join a using (group_name) left join b using (group_name)")
def group_documents(spark, d):
    """The header counts of each group's document."""
    frames = _points(spark, d).where("group_name is not null").select("group_name", F.coalesce("video_name", F.lit("<null>")).alias("video_name"), "frame", F.col("scene_idx").alias("scene_id")).distinct()
    scenes = _scenes(spark, d).where("group_name is not null").withColumn("video_name", F.coalesce("video_name", F.lit("<null>")))
    docs = FS.group_documents(frames, scenes)
    count = lambda c: F.get_json_object("document", f"$.{c}").cast("long").alias(c)
    return docs.select("group_name", count("n_videos"), count("n_keyframes"), count("n_scenes"))


MAP_ROWS = "sd as (select distinct video_name, scene_id, start_frame, end_frame, start_time, end_time, script, clip_key from sc where scene_id is not null), fk as (select distinct video_id, video_name, frame, scene_idx scene_id from keyframes where point_id is not null and video_name is not null and frame is not null)"


def _map_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    frames = _points(spark, d).where("video_name is not null and frame is not null").select("video_id", "video_name", "frame", F.col("scene_idx").alias("scene_id")).distinct()
    scenes = _scenes(spark, d).where("scene_id is not null").select("video_name", "scene_id", "start_frame", "end_frame", "start_time", "end_time", "script", "clip_key").distinct()
    return frames, scenes


@query(f"with {SCENES}, {MAP_ROWS} select printf('%s#%06d', f.video_name, f.frame) keyframe_id, f.video_name, f.frame, f.scene_id, s.start_frame scene_start_frame, s.end_frame scene_end_frame from fk f left join sd s on s.video_name = f.video_name and s.scene_id = f.scene_id")
def flat_map(spark, d):
    """Keyframes with their scenes, as the flat map has them."""
    frames, scenes = _map_rows(spark, d)
    return FS.flat_map(frames, scenes).select("keyframe_id", "video_name", "frame", "scene_id", "scene_start_frame", "scene_end_frame")


@query(f"with {SCENES}, {MAP_ROWS} select (f.video_id << 32) | f.frame point_id, f.frame, f.scene_id scene_idx, s.start_time start_sec, s.end_time end_sec, coalesce(length(s.script) > 0, false) has_speech, f.video_name || '/keyframes/' || lpad(f.frame::varchar, 6, '0') || '.webp' keyframe_key from fk f left join sd s on s.video_name = f.video_name and s.scene_id = f.scene_id")
def payload_projection(spark, d):
    """The payload of keyframes from their scenes."""
    frames, scenes = _map_rows(spark, d)
    return FS.payload_rows(frames, scenes).select("point_id", "frame", "scene_idx", "start_sec", "end_sec", "has_speech", "keyframe_key")


@query(r"select distinct source_id as key, regexp_replace(p[1], '^Keyscence_', '') group_name, p[3] video_name from (select source_id, string_split(source_id, '/') p from scene_domain_map) where len(p) = 4 and p[2] = 'keyscence' and p[4] = 'scenes.json'")
def source_discovery(spark, d):
    """The scene files in scope, of all objects."""
    return FS.discover_sources(table(spark, d, "scene_domain_map").select(F.col("source_id").alias("key")).distinct())


@query("select distinct video_id, (320 + video_id % 1600)::int width, (180 + video_id % 900)::int height, (24000 + 1000 * (video_id % 7)) / 1001.0::double fps, case when n_frames is null then -1 else n_frames end n_frames from videos where video_id is not null")
def probe_fields(spark, d):
    """Width, height, rate and length of videos out of a prober's JSON."""
    v = table(spark, d, "videos").where("video_id is not null").select("video_id", "n_frames").distinct()
    stream = F.struct((320 + F.col("video_id") % 1600).alias("width"), (180 + F.col("video_id") % 900).alias("height"), F.concat((24000 + 1000 * (F.col("video_id") % 7)).cast("string"), F.lit("/1001")).alias("r_frame_rate"), F.col("n_frames").cast("string").alias("nb_frames"))
    probed = v.select("video_id", F.to_json(F.struct(F.array(stream).alias("streams"))).alias("probe"))
    return FS.probe_fields(probed).select("video_id", "width", "height", "fps", "n_frames")


# jobs


@query("with a as (select distinct external_video_id source_id, analysis_id, ascii(right(analysis_id, 1)) % 2 = 0 good from domain_segments where external_video_id is not null and analysis_id is not null) select source_id, max(case when good then analysis_id end) active_analysis, case when bool_or(not good) then 'failed' else 'completed' end last_status, case when bool_or(not good) then 'no answer' end last_error, count(*) attempts from a group by 1")
def job_log(spark, d):
    """Attempts begun, promoted and failed; what is visible follows from the log."""
    s = table(spark, d, "domain_segments").where("external_video_id is not null and analysis_id is not null")
    s = s.select(F.col("external_video_id").alias("source_id"), "analysis_id", F.col("analysis_id").alias("content_hash"), F.lit("f").alias("fingerprint")).distinct()
    good = F.ascii(F.right("analysis_id", F.lit(1))) % 2 == 0
    log = J.begin(s, "2024-01-01").unionByName(J.promote(s.where(good), "2024-01-02")).unionByName(J.fail(s.where(~good), "2024-01-03", "no answer"))
    return J.jobs(log).select("source_id", F.col("active.analysis_id").alias("active_analysis"), "last_status", "last_error", "attempts")


# streams


@query("with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) before from events where ts is not null), n as (select *, sum(case when before is null or ts - before >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) s from e) select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) n from n group by user_id, s")
def session_windows(spark, d):
    """Sessions of each user that end after half an hour without an event."""
    got = ST.session_counts(table(spark, d, "events"), "ts", "user_id", "30 minutes")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select o_custkey, arg_max(o_totalprice, o_orderkey) o_totalprice, max(o_orderkey) o_orderkey from orders group by 1")
def stream_upsert(spark, d):
    """Orders read as a stream of files and upserted into a versioned table: the newest of each customer."""
    target, path = _folder(spark), f"{d}/orders.parquet"
    columns = ["o_custkey", "o_orderkey", "o_totalprice"]
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{path}*").select(*columns)
    ST.upsert_stream(stream, target, ["o_custkey"], "o_orderkey").awaitTermination()
    return ST.current_version(spark, target).select(*columns)


@query(f"with {PTS}, {ANCHOR}, {SQ8}, e as (select point_id, round(list_cosine_similarity(v, q), 6) score from codes order by 2 desc, 1 limit 20), c as (select point_id, code_score::double score from coarse order by 2 desc, 1 limit 20) select *, false is_final from c union all select *, true from e")
def search_two_phases(spark, d):
    """A streamed search: the coarse ranking first, then the exact one."""
    points = _points(spark, d)
    coarse, exact = ST.search_stream(points, _anchor(points)[2], 20)
    return coarse.unionByName(exact)


# points and hits


@query(f"with {PTS}, {ANCHOR}, {LISTS} select point_id, round(sum(p), 6) score from (select point_id, 0.7 * score p from l1 union all select point_id, 0.3 * score from l2) group by 1")
def weighted_parts(spark, d):
    """A query of two weighted parts."""
    a, b = _two_lists(spark, d)
    return S.weighted_sum([(a, 0.7), (b, 0.3)])


@query(f"with {PTS}, {ANCHOR}, {SCORED}, t as (select point_id, video_name, scene_idx, score from scored order by score desc, point_id limit 200), r as (select *, row_number() over (partition by video_name, scene_idx order by score desc, point_id) n from t) select point_id, score from r where n <= 1")
def max_per_shot(spark, d):
    """Of the best hits at most one of each shot of a video."""
    points = _points(spark, d)
    hits = S.exact_topk(points, _anchor(points)[2], 200, ("video_name", "scene_idx"))
    return S.cap_per_key(hits.withColumn("shot", F.struct("video_name", "scene_idx")), "shot", 1).select("point_id", "score")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'done' else o_orderpriority end o_orderpriority from orders")
def payload_set(spark, d):
    """A payload value set where a condition holds."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.set_payload(o, F.col("o_orderstatus") == "F", o_orderpriority=F.lit("done")).select("o_orderkey", "o_orderpriority")


@query(f"""with {USABLE_SCENES}, o as (select video_name, scene_id, start_frame s, end_frame e, floor((end_frame - start_frame) * 0.12)::bigint o from us where scene_id is not null), lh as (select *, case when e - o < s + o then (s + e) // 2 else s + o end lo, case when e - o < s + o then (s + e) // 2 else e - o end hi from o)
 select video_name, greatest(s, least(e, floor(lo + (hi - lo) * i / 2)::bigint)) frame, min(scene_id) shot_id from lh, (select unnest(range(0, 3)) i) group by 1, 2""")
def frame_to_shot(spark, d):
    """Three frames of each scene, and the shot that each of them belongs to."""
    good = _scenes(spark, d).where("video_name is not null and scene_id is not null and start_frame <= end_frame")
    shots = good.select("video_name", F.col("scene_id").alias("shot_id"), C.keyframe_indices(F.col("start_frame"), F.col("end_frame"), 3).alias("kf"))
    return C.frame_to_shot(shots, "video_name")


@query(f"with {SCENES}, a as (select video_name, max(keyframe_time) last_piece from keyframes where video_name is not null and point_id is not null group by 1), b as (select video_name, max(end_time) last_scene from sc where video_name is not null group by 1) select coalesce(a.video_name, b.video_name) video_name, last_piece, last_scene, coalesce(last_piece / nullif(last_scene, 0) between 0.3 and 1.5, false) plausible from a full join b on a.video_name = b.video_name")
def timeline_check(spark, d):
    """Whether the pieces of a video end about where its scenes do."""
    pieces = _points(spark, d).where("video_name is not null").select("video_name", F.col("keyframe_time").alias("end"))
    return Q.timeline_check(pieces, _scenes(spark, d).where("video_name is not null"), "video_name")


# scalars


@query("select k.point_id, round(k.frame / v.fps, 3) as seconds from (select distinct point_id, video_id, frame from keyframes where point_id is not null) k join (select video_id, max(fps) fps from videos group by 1) v on v.video_id = k.video_id where v.fps > 0")
def frame_seconds(spark, d):
    rates = table(spark, d, "videos").groupBy("video_id").agg(F.max("fps").alias("fps"))
    k = _points(spark, d).select("point_id", "video_id", "frame").distinct().join(rates, "video_id")
    return k.select("point_id", X.frame_seconds(F.col("frame"), F.col("fps")).alias("seconds")).where("seconds is not null")


@query("select o_orderkey, (round_even((640 + o_custkey % 1000) * 256 / (360 + o_orderkey % 700) / 2, 0) * 2)::int width from orders")
def even_widths(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.even_width(640 + F.col("o_custkey") % 1000, 360 + F.col("o_orderkey") % 700, F.lit(256)).alias("width"))


@query("select video_name, list_reduce(list_prepend(5381::bigint, list_transform(string_split(video_name, ''), lambda c: unicode(c)::bigint)), lambda h, c: xor(h * 33, c) & 4294967295) as hash from (select distinct video_name from videos where video_name is not null)")
def djb2_hash(spark, d):
    return table(spark, d, "videos").where("video_name is not null").select("video_name").distinct().select("video_name", X.djb2(F.col("video_name")).alias("hash"))


@query("select distinct video_name, frame, printf('%06d.webp', frame) file_name, 'https://media.example/' || video_name || '/' || printf('%06d.webp', frame) url from keyframes where video_name is not null and frame is not null")
def frame_addresses(spark, d):
    k = table(spark, d, "keyframes").where("video_name is not null and frame is not null").select("video_name", "frame").distinct()
    named = k.withColumn("file_name", X.file_name(F.col("frame"), 6, ".webp"))
    return named.withColumn("url", X.object_url(F.lit("https://media.example/"), F.col("video_name"), F.col("file_name")))


@query("select point_id, case when frame % 3 = 0 then 'trake' when frame % 3 = 1 then 'qa' end kind, case when frame % 3 < 2 then 'V' || (video_id % 97) end video, case when frame % 3 = 1 then 'yes' end answer, case when frame % 3 = 0 then [frame, frame + 40] when frame % 3 = 1 then [frame] end ms from (select distinct point_id, video_id, frame from keyframes where point_id is not null and video_id is not null and frame is not null)")
def prepared_answers(spark, d):
    """Submitted lines of both tasks, and rubbish, parsed."""
    k = _points(spark, d).where("video_id is not null and frame is not null").select("point_id", "video_id", "frame").distinct()
    video = F.concat(F.lit("V"), (F.col("video_id") % 97).cast("string"))
    line = F.when(F.col("frame") % 3 == 0, F.concat(F.lit("TR-"), video, F.lit("-"), "frame", F.lit(","), F.col("frame") + 40)).when(F.col("frame") % 3 == 1, F.concat(F.lit("QA-yes-"), video, F.lit("-"), "frame")).otherwise("nothing")
    return k.select("point_id", X.parse_answer(line).alias("a")).select("point_id", "a.kind", "a.video", "a.answer", "a.ms")


IOU = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_))"


@query(f"with b as (select o_orderkey, (o_custkey % 50)::double ax, (o_orderkey % 40)::double ay, (10 + o_custkey % 30)::double aw, (10 + o_orderkey % 20)::double ah, (o_orderkey % 45)::double bx, (o_custkey % 35)::double by_, (5 + o_orderkey % 25)::double bw, (5 + o_custkey % 15)::double bh from orders) select o_orderkey, round({IOU} / (aw * ah + bw * bh - {IOU}), 6) iou from b")
def region_iou(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    box = lambda x, y, w, h: F.struct(*[v.cast("double").alias(n) for n, v in zip("xywh", (x, y, w, h))])
    boxes = table(spark, d, "orders").select("o_orderkey", box(c % 50, o % 40, 10 + c % 30, 10 + o % 20).alias("a"), box(o % 45, c % 35, 5 + o % 25, 5 + c % 15).alias("b"))
    return boxes.select("o_orderkey", F.round(X.region_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(f"with {SCENES}, r as (select id, trim(script) t, start_time s, end_time e from sc where id is not null and start_time is not null and end_time is not null) select id, 0::bigint as pos, case when id % 3 = 0 then 0.0 else floor(s) end as start, case when id % 3 = 0 then 0.0 when id % 3 = 1 then floor(e) else floor(s) end as \"end\", t as text from r where t is not null and (id % 3 = 0 or t <> '')")
def speech_segments(spark, d):
    """Three forms of a recogniser's answer as one list: plain text, text with both times, and a text without an end."""
    s = _scenes(spark, d).where("id is not null and start_time is not null and end_time is not null")
    start, end = F.floor("start_time").cast("string").alias("start"), F.floor("end_time").cast("string").alias("end")
    both = F.to_json(F.array(F.struct(start, end, F.coalesce("script", F.lit("")).alias("text"))))
    begun = F.to_json(F.array(F.struct(start, F.coalesce("script", F.lit(" ")).alias("decode"))))
    answer = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, both).otherwise(begun)
    plain = F.when(F.col("id") % 3 == 0, F.col("script"))
    got = s.select("id", X.speech_segments(answer, plain).alias("x"))
    return got.select("id", F.posexplode("x").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), "x.start", "x.end", "x.text")


__all__ = ["QUERIES", "SQL"]
