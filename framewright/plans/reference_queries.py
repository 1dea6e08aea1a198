"""Queries of the retrieval and ingest operators over the project's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import expr as X
from framewright.operators import domain as D
from framewright.operators import points as P
from framewright.operators import quality as Q
from framewright.operators import scenes as C
from framewright.operators import search as S
from framewright.operators import tags as T
from framewright.operators.orphans import first_loaded
from framewright.operators.text import bm25
from framewright.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# shared relations

#: The characters that Python takes for white space, as a class of regular expressions.
BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

USABLE = "vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0"
PTS = f"""pts as (select point_id, any_value(vector)::double[] v, max(video_id) video_id, max(video_name) video_name, max(frame) frame, max(keyframe_time) keyframe_time, max(scene_idx) scene_idx
  from keyframes where {USABLE} and point_id is not null group by 1)"""
ANCHOR = "a1 as (select v q, video_name qv, point_id qid from pts order by point_id limit 1), a2 as (select v q, point_id qid from pts order by point_id desc limit 1)"
SCORED = "scored as (select p.*, round(list_cosine_similarity(v, q), 6) score from pts p, a1)"
ALIVE = "alive as (select * from scored where video_id is null or video_id not in (select video_id from videos where deleted_at is not null and video_id is not null))"
MAPPED = """once_map as (select *, lower(regexp_replace(external_video_id, '^\\s+|\\s+$', '', 'g')) video_key, lower(regexp_replace(domain_id, '^\\s+|\\s+$', '', 'g')) domain_key from
   (select *, row_number() over (partition by map_id order by loaded_at) rn from scene_domain_map) where rn = 1),
 done as (select video_key, analysis_id, max(loaded_at) done from once_map where video_key is not null and analysis_id is not null group by 1, 2),
 active_v as (select video_key, analysis_id from (select *, row_number() over (partition by video_key order by done desc, analysis_id desc) r from done) where r = 1),
 active as (select m.* from once_map m join active_v using (video_key, analysis_id)),
 vocab as (select (row_number() over (order by name) - 1)::int tag, name, description from (select lower(trim(domain_id)) name, min(domain_label) description from domains where deleted_at is null and domain_id is not null group by 1))"""
TAGGED = MAPPED + """, scene_tag as (select video_key, scene_id, min(tag) tag from active join vocab on domain_key = name where scene_id is not null group by 1, 2),
 tags as (select point_id, coalesce(min(tag), 65535)::int tag from (select distinct point_id, lower(regexp_replace(video_name, '^\\s+|\\s+$', '', 'g')) video_key, scene_idx from keyframes where point_id is not null) k
   left join scene_tag s on s.video_key = k.video_key and s.scene_id = k.scene_idx group by 1)"""
SEGMENTS = "segs as (select * exclude rn from (select *, row_number() over (partition by analysis_id, segment_idx order by loaded_at) rn from domain_segments) where rn = 1)"
SCENES = "sc as (select * exclude rn from (select *, row_number() over (partition by id order by loaded_at) rn from scenes) where rn = 1)"
USABLE_SCENES = SCENES + ", us as (select *, row_number() over (partition by video_name order by start_frame, end_frame, scene_id) n from sc where video_name is not null and start_frame <= end_frame)"
FRAMES = "fr as (select distinct point_id, video_name, frame, keyframe_time from keyframes where point_id is not null and video_name is not null and frame is not null)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keyframes").where("point_id is not null")


def _anchor(points: DataFrame, last: bool = False) -> tuple[int, str, np.ndarray]:
    """The usable vector of the smallest (or largest) point: one row."""
    order = F.col("point_id").desc() if last else F.col("point_id")
    row = X.usable(points).select("point_id", "video_name", "vector").orderBy(order).limit(1).collect()
    if not row:
        return -1, "", np.ones(64)
    return row[0].point_id, row[0].video_name, np.array(row[0].vector, float)


def _scored(points: DataFrame, q: np.ndarray, *payload: str) -> DataFrame:
    return X.cosine_to(points.select("point_id", *payload, "vector"), "vector", q)


def _deleted_videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").where("deleted_at is not null and video_id is not null").select("video_id").distinct()


def _alive(spark: SparkSession, d: str, q: np.ndarray, *payload: str) -> DataFrame:
    """Scored rows whose video is not deleted; scored before the join, so no vector is shuffled."""
    scored = _scored(_points(spark, d), q, "video_id", *payload)
    return scored.join(_deleted_videos(spark, d), "video_id", "left_anti").select("point_id", *payload, "score")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return T.compute_tags(_points(spark, d), table(spark, d, "scene_domain_map"), T.tag_vocab(table(spark, d, "domains")))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scenes")
    return first_loaded(s, ["id"], "loaded_at", s.columns)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return D.segments_once(table(spark, d, "domain_segments"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).where("video_name is not null and frame is not null").select("point_id", "video_name", "frame", "keyframe_time").distinct()


# search


@query(f"with {PTS}, {ANCHOR}, {SCORED}, {ALIVE} select point_id, video_name, frame, score, row_number() over (order by score desc, point_id) - 1 as rank from alive order by score desc, point_id limit 20")
def exact_topk(spark, d):
    """Flagship: the 20 live keyframes nearest to a query vector."""
    return S.distinct_topk(_alive(spark, d, _anchor(_points(spark, d))[2], "video_name", "frame"), 20)


@query(f"with {PTS}, {ANCHOR}, {SCORED}, {TAGGED} select point_id, score, row_number() over (order by score desc, point_id) - 1 as rank from scored join tags using (point_id) where tag in (1, 4, 7) order by score desc, point_id limit 20")
def tag_filtered_topk(spark, d):
    tags = _tags(spark, d).where(F.col("tag").isin(1, 4, 7))
    return S.distinct_topk(_scored(_points(spark, d), _anchor(_points(spark, d))[2]).join(tags.select("point_id"), "point_id", "left_semi"), 20)


@query(f"with {PTS}, {ANCHOR}, {SCORED}, cut as (select point_id, score, row_number() over (order by score desc, point_id) - 1 as rank from scored order by score desc, point_id limit 50) select * from cut where score >= 0.4")
def topk_min_score(spark, d):
    return S.exact_topk(_points(spark, d), _anchor(_points(spark, d))[2], 50, (), 0.4)


@query(f"with {TAGGED}, u as (select count(*) n from tags), h as (select tag, count(*) candidates from tags where tag <> 65535 group by 1) select tag, candidates, n as universe, case when candidates >= n or candidates > 20000 then 'pre' else 'exact' end strategy from h, u union all select -1, n, n, 'pre' from u")
def strategy_choice(spark, d):
    """The route for each tag, and (-1) for no filter; the planner's own rule is applied to the counts."""
    tags = _tags(spark, d)
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("candidates"))
    total = tags.agg(F.count(F.lit(1)).alias("universe"))
    route = S.strategy_of(F.col("candidates"), F.col("universe"))
    every = total.select(F.lit(-1).alias("tag"), F.col("universe").alias("candidates"), "universe")
    return counts.where(F.col("tag") != X.SENTINEL_TAG).crossJoin(F.broadcast(total)).unionByName(every).withColumn("strategy", route)


@query(f"""with {PTS}, {ANCHOR}, {SCORED}, {TAGGED},
 t as (select point_id, score from scored join tags using (point_id) where tag = 2 and score >= 0.35 order by score desc, point_id limit 40), w as (select point_id, score from scored where score >= 0.35 order by score desc, point_id limit 40),
 c as (select (select count(*) from t) < 40 and (select count(*) from w) > (select count(*) from t) wide)
 select t.*, false from_fallback from t, c where not wide union all select w.*, true from w, c where wide""")
def tag_fallback(spark, d):
    scored = _scored(_points(spark, d), _anchor(_points(spark, d))[2]).where("score >= 0.35")
    tagged = scored.join(_tags(spark, d).where("tag = 2").select("point_id"), "point_id", "left_semi")
    cut = lambda df: S.distinct_topk(df, 40).select("point_id", "score")
    return S.fallback_union(cut(tagged), cut(scored), 40)


SQ8 = """codes as (select point_id, v, q, list_transform(v, lambda x: least(127, greatest(-127, floor(x / sqrt(list_dot_product(v, v)) * 127 + 0.5)))) cv, list_transform(q, lambda x: least(127, greatest(-127, floor(x / sqrt(list_dot_product(q, q)) * 127 + 0.5)))) cq from pts, a1),
 coarse as (select point_id, list_dot_product(cv, cq)::bigint code_score from codes)"""


@query(f"with {PTS}, {ANCHOR}, {SQ8}, kept as (select point_id from coarse order by code_score desc, point_id limit 800), s as (select point_id, round(list_cosine_similarity(v, q), 6) score from codes join kept using (point_id)) select point_id, score, row_number() over (order by score desc, point_id) - 1 as rank from s order by score desc, point_id limit 50")
def two_tier_sq8(spark, d):
    return S.two_tier(_points(spark, d), _anchor(_points(spark, d))[2], 50)


@query(f"with {PTS}, {ANCHOR}, {SQ8}, e as (select point_id from (select point_id, round(list_cosine_similarity(v, q), 6) s from codes) order by s desc, point_id limit 10), c as (select point_id from coarse order by code_score desc, point_id limit 10) select (select count(*) from e join c using (point_id)) as n_common, (select count(*) from e) as n_exact")
def int8_overlap_at_10(spark, d):
    points, q = _points(spark, d), _anchor(_points(spark, d))[2]
    sides = P.in_both_or_one(S.exact_topk(points, q, 10), S.sq8_coarse(points, q, 10), "point_id")
    return sides.agg(F.count_if(F.col("side") == "both").alias("n_common"), F.count_if(F.col("side") != "right").alias("n_exact"))


@query(f"with {PTS}, x as (select a.point_id query_id, b.point_id, round(list_cosine_similarity(a.v, b.v), 6) score from pts a join pts b on a.point_id <> b.point_id where a.point_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by score desc, point_id) - 1 as rank from x) select * from r where rank < 10")
def batch_topk(spark, d):
    """The stated query set (every point whose id is divisible by 20) against all points, exactly."""
    points = _points(spark, d)
    return S.batch_topk(points, points.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector"), 10)


@query(f"with {PTS}, {ANCHOR}, {SCORED}, g as (select video_name, max(score) best_score from scored where video_name is not null group by 1 order by 2 desc, 1 limit 8), r as (select video_name, point_id, score, best_score, row_number() over (partition by video_name order by score desc, point_id) - 1 as rank_in_group from scored join g using (video_name)) select * from r where rank_in_group < 3")
def grouped_topk(spark, d):
    return S.grouped_topk(S.once(_scored(_points(spark, d), _anchor(_points(spark, d))[2], "video_name")), "video_name", 8, 3)


@query(f"with {PTS}, {ANCHOR}, {SCORED}, t as (select point_id, video_name, score from scored order by score desc, point_id limit 200), r as (select *, row_number() over (partition by video_name order by score desc, point_id) n from t) select point_id, video_name, score from r where n <= 2")
def diversify_per_video(spark, d):
    hits = S.distinct_topk(_scored(_points(spark, d), _anchor(_points(spark, d))[2], "video_name"), 200)
    return S.cap_per_key(hits, "video_name", 2).select("point_id", "video_name", "score")


def _top_with_vectors(spark, d, k: int) -> DataFrame:
    points = _points(spark, d)
    hits = S.distinct_topk(_scored(points, _anchor(points)[2], "video_name", "keyframe_time"), k)
    # at most k rows
    return points.select("point_id", "vector").join(F.broadcast(hits), "point_id").dropDuplicates(["point_id"])


TOP_ROWS = "top_rows as (select *, row_number() over (order by score desc, point_id) rn from (select point_id, v, video_name, keyframe_time, score from scored order by score desc, point_id limit {n}))"


@query(f"""with recursive {PTS}, {ANCHOR}, {SCORED}, {TOP_ROWS.format(n=300)},
 walk as (select 0::bigint step, []::struct(id bigint, v double[], name varchar, t double)[] kept
   union all select rn, case when len(kept) < 50 and len(list_filter(kept, lambda x: x.name is not distinct from video_name)) < 3 and len(list_filter(kept, lambda x: (x.name is not distinct from video_name and abs(x.t - keyframe_time) < 2.0) or list_cosine_similarity(x.v, h.v) >= 0.97)) = 0
     then list_append(kept, {{'id': point_id, 'v': h.v, 'name': video_name, 't': keyframe_time}}) else kept end from walk join top_rows h on h.rn = step + 1),
 final as (select unnest(kept).id as id, generate_subscripts(kept, 1) - 1 as pos from (select kept from walk order by step desc limit 1))
 select point_id, score, video_name, keyframe_time, pos as rank from final join top_rows on point_id = id""")
def diversify_greedy(spark, d):
    return S.diversify(_top_with_vectors(spark, d, 300), 50, max_per_video=3, min_gap=2.0, dedup=0.97)


@query(f"""with recursive {PTS}, {ANCHOR}, {SCORED}, {TOP_ROWS.format(n=200)},
 walk as (select 1::bigint step, [point_id] ids, [v] vs, round(0.7 * score, 6) mmr from top_rows where rn = 1
   union all select step + 1, list_append(ids, best.point_id), list_append(vs, best.v), round(best.gain, 6) from
     (select step, ids, vs, arg_max({{'point_id': h.point_id, 'v': h.v, 'gain': gain}}, (gain, -rn)) best from
       (select step, ids, vs, h.*, round(0.7 * h.score - 0.3 * list_max(list_transform(vs, lambda x: list_cosine_similarity(x, h.v))), 9) gain from walk, top_rows h where step < 30 and not list_contains(ids, h.point_id)) h group by step, ids, vs))
 select ids[-1] point_id, (select score from top_rows where point_id = ids[-1]) score, mmr, step - 1 as rank from walk""")
def mmr_topk(spark, d):
    return S.mmr(_top_with_vectors(spark, d, 200), 30, 0.7)


@query(f"with {PTS}, {ANCHOR}, {SCORED} select point_id, video_name, score, row_number() over (order by score desc, point_id) - 1 as rank from scored, a1 where video_name <> qv order by score desc, point_id limit 20")
def more_like_this(spark, d):
    _, video, q = _anchor(_points(spark, d))
    return S.distinct_topk(_scored(_points(spark, d).where(F.col("video_name") != video), q, "video_name"), 20)


@query(f"""with {PTS}, {ANCHOR}, liked as (select i, avg(x) m from (select unnest(v) x, generate_subscripts(v, 1) i from pts, a1 where video_name = qv) group by 1), second as (select video_name bv from pts order by point_id desc limit 1),
 bad as (select i, avg(x) m from (select unnest(v) x, generate_subscripts(v, 1) i from pts, second where video_name = bv) group by 1), q0 as (select unnest(q) x, generate_subscripts(q, 1) i from a1),
 moved as (select list(q0.x + 0.75 * liked.m - 0.15 * bad.m order by i) q from q0 join liked using (i) join bad using (i)), s as (select point_id, round(list_cosine_similarity(v, moved.q), 6) score from pts, moved)
 select point_id, score, row_number() over (order by score desc, point_id) - 1 as rank from s order by score desc, point_id limit 20""")
def rocchio_feedback(spark, d):
    points = _points(spark, d)
    _, video, q = _anchor(points)
    other = _anchor(points, last=True)[1]
    unique = lambda v: X.usable(points.where(F.col("video_name") == v)).groupBy("point_id").agg(F.first("vector").alias("vector"))
    return S.exact_topk(points, S.rocchio(q, unique(video), unique(other)), 20)


@query(f"""with {PTS}, c as (select video_name, scene_idx, i, avg(x) m from (select video_name, scene_idx, unnest(v) x, generate_subscripts(v, 1) i from pts where scene_idx is not null) group by 1, 2, 3), w as (select video_name, scene_idx, list(m order by i) v from c group by 1, 2)
 select video_name, scene_idx, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) as vector from w""")
def scene_mean_embedding(spark, d):
    unique = X.usable(_points(spark, d)).groupBy("point_id").agg(F.max("video_name").alias("video_name"), F.max("scene_idx").alias("scene_idx"), F.first("vector").alias("vector"))
    return X.mean_vector(unique.where("scene_idx is not null"), ["video_name", "scene_idx"], "vector")


LISTS = """s1 as (select point_id, round(list_cosine_similarity(v, q), 6) score from pts, a1), s2 as (select point_id, round(list_cosine_similarity(v, q), 6) score from pts, a2),
 l1 as (select *, row_number() over (order by score desc, point_id) - 1 r from s1 order by score desc, point_id limit 100), l2 as (select *, row_number() over (order by score desc, point_id) - 1 r from s2 order by score desc, point_id limit 100)"""


def _two_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    points = _points(spark, d)
    return S.exact_topk(points, _anchor(points)[2], 100), S.exact_topk(points, _anchor(points, last=True)[2], 100)


@query(f"with {PTS}, {ANCHOR}, {LISTS} select point_id, round(sum(p), 9) fused from (select point_id, 1.0::double / (60 + r + 1) p from l1 union all select point_id, 0.5::double / (60 + r + 1) from l2) group by 1")
def rrf_fusion(spark, d):
    a, b = _two_lists(spark, d)
    return S.rrf([(a, 1.0), (b, 0.5)])


@query(f"with {PTS}, {ANCHOR}, {LISTS} select point_id, max(score) max_score, round(avg(score), 6) mean_score, round(sum(score), 6) sum_score from (select * from l1 union all select * from l2) group by 1")
def score_fusion_max_mean_sum(spark, d):
    return S.fuse_scores(_two_lists(spark, d))


@query(f"with {PTS}, {ANCHOR}, {LISTS}, m1 as (select avg(score) m, stddev_samp(score) s from l1), m2 as (select avg(score) m, stddev_samp(score) s from l2) select point_id, round(sum(p), 6) fused from (select point_id, coalesce((score - (m - 3 * s)) / nullif(6 * s, 0), 0.5) p from l1, m1 union all select point_id, coalesce((score - (m - 3 * s)) / nullif(6 * s, 0), 0.5) from l2, m2) group by 1")
def dbsf_fusion(spark, d):
    return S.dbsf(_two_lists(spark, d))


@query(f"""with k as (select point_id, max(video_name) video_name, bool_or(has_ocr) has_ocr, bool_or(has_speech) has_speech, max(start_sec) start_sec, max(end_sec) end_sec, any_value(objects) objects from keyframes where point_id is not null group by 1)
 select point_id, video_name from k where coalesce(list_has_all(coalesce(objects, []), ['person']), false) and not coalesce(list_has_any(objects, ['food', 'boat']), false) and list_has_any(coalesce(objects, []), ['car', 'crowd', 'tree', 'building', 'screen text']) and has_speech and start_sec >= 1 and end_sec - start_sec <= 60 and coalesce(video_name not in ('L00_V001'), true)""")
def payload_filters(spark, d):
    f = S.Filters(exclude_videos=("L00_V001",), min_start=1.0, max_duration=60.0, require_objects=("person",), any_objects=("car", "crowd", "tree", "building", "screen text"), exclude_objects=("food", "boat"), require_speech=True)
    return _points(spark, d).where(S.filter_column(f)).select("point_id", "video_name").distinct()


@query("""with e as (select user_id, event_type, epoch_us(ts) / 1e6 as sec, coalesce(value, 0) score, event_id from events), a as (select * from e where event_type = 'view'), b as (select * from e where event_type = 'click'), c as (select * from e where event_type = 'purchase')
 select a.user_id, a.event_id id0, b.event_id id1, c.event_id id2, round(a.score + b.score + c.score, 6) total from a join b on a.user_id = b.user_id and b.sec - a.sec between 1 and 21600 join c on c.user_id = b.user_id and c.sec - b.sec between 1 and 21600 order by total desc, id0, id1, id2 limit 100""")
def temporal_chain(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.coalesce("value", F.lit(0.0)).alias("score"), "event_id")
    return S.temporal_chain(e, "user_id", ("view", "click", "purchase"), 1, 21600, 100)


# tags and quality


@query(f"with {TAGGED}, c as (select tag, count(*) n from tags group by 1), every as (select unnest(range(0, (select max(tag) from c where tag <> 65535) + 1))::int tag union all select tag from c where tag = 65535), f as (select tag, coalesce(n, 0) n from every left join c using (tag)) select tag, n, coalesce(sum(n) over (order by tag rows between unbounded preceding and 1 preceding), 0)::bigint first_row from f")
def tag_histogram(spark, d):
    return T.tag_histogram(_tags(spark, d))


@query(f"with {TAGGED}, c as (select tag, count(*) n from tags group by 1), s as (select sum(n) filter (tag <> 65535)::bigint covered, sum(n)::bigint total from c) select tag, n, round(n / covered, 6) share, covered, total from c, s where tag <> 65535")
def tag_coverage(spark, d):
    return T.tag_coverage(_tags(spark, d))


@query(f"with {TAGGED} select tag, name, description, (select count(*) from tags t where t.tag = vocab.tag) n from vocab")
def tag_vocab(spark, d):
    return T.vocab_with_counts(T.tag_vocab(table(spark, d, "domains")), _tags(spark, d))


@query(f"with {TAGGED} select point_id, tag from tags")
def three_hop_tag(spark, d):
    return _tags(spark, d)


@query(f"with {MAPPED} select domain_key, count(*) n from active where domain_key is not null and domain_key not in (select name from vocab) group by 1")
def unknown_domains(spark, d):
    return T.unknown_domains(table(spark, d, "scene_domain_map"), T.tag_vocab(table(spark, d, "domains")))


@query("""with f as (select vector is null nul, vector is not null and len(vector) <> 64 dimm, vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) > 0 na, case when len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 then sqrt(list_dot_product(vector::double[], vector::double[])) end norm from keyframes)
 select count(*) n, count(*) filter (nul) n_null, count(*) filter (dimm) n_dim, count(*) filter (na) n_nan, count(*) filter (norm = 0) n_zero, count(*) filter (norm > 0 and abs(norm - 1) > 1e-3) n_off_norm, round(min(norm) filter (norm > 0), 5) min_norm, round(max(norm) filter (norm > 0), 5) max_norm from f""")
def norm_check(spark, d):
    return Q.norm_report(table(spark, d, "keyframes"))


@query("select *, dim is not distinct from size as agrees from (select dim, len(vector)::int as size, count(*) n from keyframes group by 1, 2)")
def dim_check(spark, d):
    return table(spark, d, "keyframes").groupBy("dim", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("size")).agg(F.count(F.lit(1)).alias("n")).withColumn("agrees", F.col("dim").eqNullSafe(F.col("size")))


@query("select video_name, count(distinct scene_id) n, min(scene_id) min_id, max(scene_id) max_id, min(scene_id) = 0 and max(scene_id) = count(distinct scene_id) - 1 contiguous from scenes where video_name is not null and scene_id is not null group by 1")
def scene_id_gaps(spark, d):
    return Q.id_gaps(table(spark, d, "scenes"), "video_name", "scene_id")


@query("select video_id, ((video_id % 65536) >> (8 * (1 - (row_no // 8)::int)) >> (row_no % 8)) & 1 = 0 as clear from (select distinct video_id, video_id % 16 row_no from videos where video_id is not null)")
def tombstone_bits(spark, d):
    """Bit tests on two-byte sets, least significant bit first."""
    ids = table(spark, d, "videos").where("video_id is not null").select("video_id").distinct()
    bits = F.unhex(F.lpad(F.hex(F.col("video_id") % 65536), 4, "0"))
    return ids.select("video_id", X.bit_is_clear(bits, F.col("video_id") % 16).alias("clear"))


@query("select distinct point_id, (video_id << 32) | frame as packed, point_id = ((video_id << 32) | frame) as same from keyframes")
def point_id_pack(spark, d):
    packed = X.point_id(F.col("video_id"), F.col("frame"))
    return table(spark, d, "keyframes").select("point_id", packed.alias("packed"), (F.col("point_id") == packed).alias("same")).distinct()


# scenes and keyframes


@query("""with e as (select user_id, event_id, value - floor(value) p from events), c as (select *, coalesce((p > 0.55)::int, 0) cut from e), n as (select *, sum(cut) over (partition by user_id order by event_id rows unbounded preceding) - cut as scene_id from c)
 select user_id, scene_id::bigint scene_id, min(event_id) as start, max(event_id) as "end", count(*) n_shots, coalesce(round(max(case when cut = 1 then p end), 4), 1.0) confidence from n group by 1, 2""")
def boundary_to_scenes(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("s"), F.col("event_id").alias("e"), (F.col("value") - F.floor("value")).alias("p"))
    return C.boundaries_to_scenes(e, "user_id", "event_id", "s", "e", "p")


@query(f"with {USABLE_SCENES}, {FRAMES}, j as (select f.point_id, f.frame, us.*, row_number() over (partition by f.point_id order by us.n desc) r from fr f join us on f.video_name = us.video_name and us.start_frame <= f.frame), h as (select point_id, case when end_frame >= frame and frame >= 0 then scene_id end s from j where r = 1) select f.point_id, f.video_name, f.frame, h.s scene_id from fr f left join h using (point_id)")
def asof_scene_by_frame(spark, d):
    got = C.containing_scene(_frames(spark, d), _scenes(spark, d), "video_name")
    return got.select("point_id", "video_name", "frame", F.col("hit.scene_id").alias("scene_id"))


MATCH = f"""with {USABLE_SCENES}, {FRAMES}, i as (select f.point_id, max(us.n) n from fr f join us on f.video_name = us.video_name and us.start_frame <= f.frame group by 1),
 p as (select f.*, a.scene_id as_, a.start_frame a0, a.end_frame a1, a.start_time at0, a.end_time at1, b.scene_id bs, b.start_frame b0, b.end_frame b1, b.start_time bt0, b.end_time bt1 from fr f left join i using (point_id)
   left join us a on a.video_name = f.video_name and a.n = i.n left join us b on b.video_name = f.video_name and b.n = coalesce(i.n, 0) + 1),
 g as (select *, case when frame between a0 and a1 then 0 else least(abs(frame - a0), abs(frame - a1)) end ga, case when frame between b0 and b1 then 0 else least(abs(frame - b0), abs(frame - b1)) end gb, coalesce(keyframe_time between at0 and at1, false) ta, coalesce(keyframe_time between bt0 and bt1, false) tb from p),
 m as (select *, case when as_ is null and bs is null then 'none' when frame <= a1 then 'frame' when ta or tb then 'time' else 'nearest' end as "match" from g)"""


@query(MATCH + " select point_id, case when \"match\" = 'none' then null when \"match\" = 'frame' then as_ when \"match\" = 'time' then case when ta then as_ else bs end when as_ is null then bs when bs is null then as_ when ga <= gb then as_ else bs end as match_scene_id, \"match\" from m")
def match_scene_3tier(spark, d):
    return C.match_scene(_frames(spark, d), _scenes(spark, d), "video_name").select("point_id", "match_scene_id", "match")


@query(MATCH + ' select "match", count(*) n, round(count(*) / sum(count(*)) over (), 6) share from m group by 1')
def match_mode_counts(spark, d):
    return Q.counts(C.match_scene(_frames(spark, d), _scenes(spark, d), "video_name"), "match")


@query(f"with {USABLE_SCENES}, {FRAMES}, f1 as (select f.point_id, min(us.n) n from fr f join us on f.video_name = us.video_name and us.end_frame >= f.frame group by 1), l as (select video_name, max(n) n from us group by 1) select f.point_id, u.scene_id assigned_scene_id from fr f left join f1 using (point_id) left join l on l.video_name = f.video_name left join us u on u.video_name = f.video_name and u.n = coalesce(f1.n, l.n)")
def assign_scene_two_pointer(spark, d):
    return C.assign_scene(_frames(spark, d), _scenes(spark, d), "video_name").select("point_id", "assigned_scene_id")


@query(f"""with {USABLE_SCENES}, o as (select video_name, start_frame s, end_frame e, floor((end_frame - start_frame) * 0.12)::bigint o from us), lh as (select *, case when e - o < s + o then (s + e) // 2 else s + o end lo, case when e - o < s + o then (s + e) // 2 else e - o end hi from o)
 select distinct video_name, greatest(s, least(e, floor(lo + (hi - lo) * i / 6)::bigint)) frame from lh, (select unnest(range(0, 7)) i)""")
def keyframe_indices(spark, d):
    """The distinct frames to extract: seven for each scene, frames that scenes share once."""
    good = _scenes(spark, d).where("video_name is not null and start_frame <= end_frame")
    return good.select("video_name", F.explode(C.keyframe_indices(F.col("start_frame"), F.col("end_frame"), 7)).alias("frame")).distinct()


@query("""with f as (select video_name, frame, row_number() over (partition by video_name order by frame) rn from (select distinct video_name, frame from keyframes where video_name is not null and frame is not null)), a as (select f.* from f join (select distinct video_name, frame from keyframes where point_id % 20 = 0) k using (video_name, frame))
 select a.video_name, a.frame anchor_frame, f.frame, (f.rn - a.rn)::bigint as "offset" from a join f on f.video_name = a.video_name and f.rn between a.rn - 5 and a.rn + 5 and f.rn <> a.rn""")
def neighbors_window(spark, d):
    frames = _points(spark, d)
    return C.neighbours(frames, "video_name", frames.where("point_id % 20 = 0").select("video_name", F.col("frame").alias("anchor_frame")), 5, 5)


@query(f"with {SCENES}, p as (select id seq, video_name, (start_time + end_time) / 2 mid, script from sc), h as (select s.video_name, s.scene_id, trim(string_agg(p.script, ' ' order by seq)) script from (select distinct video_name, scene_id, start_time, end_time from sc where start_time <= end_time) s join p on p.video_name = s.video_name and p.mid between s.start_time and s.end_time where p.script is not null group by 1, 2) select distinct sc.video_name, sc.scene_id, coalesce(h.script, '') script from sc left join h on h.video_name = sc.video_name and h.scene_id = sc.scene_id where sc.video_name is not null and sc.scene_id is not null")
def script_assign(spark, d):
    s = _scenes(spark, d).where("video_name is not null and scene_id is not null")
    pieces = s.where("script is not null").select("video_name", F.col("id").alias("seq"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("script").alias("text"))
    return C.assign_script(s, pieces, "video_name")


@query(f"with {SCENES}, n as (select video_name, scene_id, count(distinct point_id) n, min(frame) first_frame from (select point_id, video_name, scene_idx scene_id, frame from keyframes) group by 1, 2) select sc.video_name, sc.scene_id, coalesce(max(n), 0) n_keyframes, max(first_frame) first_frame from sc left join n on n.video_name = sc.video_name and n.scene_id = sc.scene_id where sc.video_name is not null and sc.scene_id is not null group by 1, 2")
def keyframes_per_scene(spark, d):
    per = _points(spark, d).groupBy("video_name", F.col("scene_idx").alias("scene_id")).agg(F.countDistinct("point_id").alias("n"), F.min("frame").alias("first_frame"))
    s = _scenes(spark, d).where("video_name is not null and scene_id is not null").select("video_name", "scene_id").distinct()
    return s.join(per, ["video_name", "scene_id"], "left").select("video_name", "scene_id", F.coalesce("n", F.lit(0)).alias("n_keyframes"), "first_frame")


@query(f"with {USABLE_SCENES}, {FRAMES}, j as (select f.point_id, f.frame, us.*, row_number() over (partition by f.point_id order by us.n desc) r from fr f join us on f.video_name = us.video_name and us.start_frame <= f.frame), h as (select point_id, case when end_frame >= frame then scene_id end s from j where r = 1), k as (select distinct point_id, scene_idx from keyframes where point_id is not null and video_name is not null and frame is not null) select case when scene_idx is null and s is null then 'both null' when scene_idx is null then 'only map' when s is null then 'only index' when scene_idx = s then 'same' else 'different' end agreement, count(*) n from k left join h using (point_id) group by 1")
def scene_index_agreement(spark, d):
    """Whether the stored scene index agrees with the validated interval join."""
    got = C.containing_scene(_frames(spark, d), _scenes(spark, d), "video_name").select("point_id", F.col("hit.scene_id").alias("s"))
    k = _points(spark, d).where("video_name is not null and frame is not null").select("point_id", "scene_idx").distinct().join(got, "point_id", "left")
    i, s = F.col("scene_idx"), F.col("s")
    kind = F.when(i.isNull() & s.isNull(), "both null").when(i.isNull(), "only map").when(s.isNull(), "only index").when(i == s, "same").otherwise("different")
    return k.groupBy(kind.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


# domains and versions


@query(f"with {SEGMENTS}, l as (select *, coalesce(lag(end_scene_id) over (partition by analysis_id order by segment_idx) + 1, 0) x from segs) select analysis_id, segment_idx, case when end_scene_id < start_scene_id then 'inverted' when start_scene_id > x then 'gap' when start_scene_id < x then 'overlap' end problem from l")
def segment_coverage_check(spark, d):
    return D.coverage_check(_segments(spark, d))


@query(f"with {SEGMENTS}, t as (select distinct lower(trim(domain_id)) a, lower(trim(topic_id)) b from domain_topics) select analysis_id, segment_idx from segs where not exists (select 1 from t where t.a = lower(regexp_replace(domain_id, '^\\s+|\\s+$', '', 'g')) and t.b = lower(regexp_replace(topic_id, '^\\s+|\\s+$', '', 'g')))")
def topic_outside_domain(spark, d):
    return D.topic_check(_segments(spark, d), table(spark, d, "domain_topics"))


@query(f"""with {SEGMENTS}, f as (select *, row_number() over w n, case when row_number() over w > 1 and lag(domain_id) over w is not distinct from domain_id and lag(topic_id) over w is not distinct from topic_id and lag(lower(sub_domain)) over w is not distinct from lower(sub_domain) then 0 else 1 end new from segs window w as (partition by analysis_id order by segment_idx)),
 g as (select *, sum(new) over (partition by analysis_id order by segment_idx rows unbounded preceding) i from f), k as (select analysis_id, i, word, min((segment_idx, pos)) firstpos from (select analysis_id, i, segment_idx, unnest(keywords) kw, generate_subscripts(keywords, 1) pos from g), lateral (select lower(trim(regexp_replace(nfc_normalize(kw), '{BLANKS}', ' ', 'g'))) word) where word is not null and word <> '' group by 1, 2, 3),
 kk as (select analysis_id, i, list(word order by firstpos)[1:4] keywords from k group by 1, 2)
 select g.analysis_id, (g.i - 1)::bigint segment_idx, arg_min(start_scene_id, segment_idx) start_scene_id, arg_max(end_scene_id, segment_idx) end_scene_id, first(domain_id order by segment_idx) domain_id, first(topic_id order by segment_idx) topic_id, first(sub_domain order by segment_idx) sub_domain, coalesce(any_value(kk.keywords), []) keywords from g left join kk on kk.analysis_id is not distinct from g.analysis_id and kk.i = g.i group by g.analysis_id, g.i""")
def adjacent_segment_merge(spark, d):
    return D.merge_adjacent(_segments(spark, d)).drop("summary")


@query()
def merged_summaries(spark, d):
    """The ordered fold of the summaries of merged segments."""
    return D.merge_adjacent(_segments(spark, d)).select("analysis_id", "segment_idx", "summary")


TIMED = f"{SEGMENTS}, {SCENES}, tm as (select video_name, scene_id, min(start_time) s, max(end_time) e from sc group by 1, 2), ts as (select segs.*, a.s, b.e from segs left join tm a on a.video_name = external_video_id and a.scene_id = start_scene_id left join tm b on b.video_name = external_video_id and b.scene_id = end_scene_id)"


@query(f"with {TIMED}, p as (select analysis_id, domain_id, round(sum(greatest(coalesce(e - s, 0), 0.001)), 6) w, min(segment_idx) f, count(distinct coalesce(topic_id, '<null>')) t, count(*) n from ts group by 1, 2) select analysis_id, arg_max(domain_id, (w, -f)) primary_domain, count(*) > 1 is_multi_domain, sum(t) > 1 is_multi_topic, sum(n) > 1 is_multi_segment from p group by 1")
def primary_domain(spark, d):
    s = _scenes(spark, d).groupBy("video_name", "scene_id").agg(F.min("start_time").alias("s"), F.max("end_time").alias("e"))
    a = s.select(F.col("video_name").alias("external_video_id"), F.col("scene_id").alias("start_scene_id"), F.col("s").alias("start_time"))
    b = s.select(F.col("video_name").alias("external_video_id"), F.col("scene_id").alias("end_scene_id"), F.col("e").alias("end_time"))
    timed = _segments(spark, d).join(a, ["external_video_id", "start_scene_id"], "left").join(b, ["external_video_id", "end_scene_id"], "left")
    return D.rollup(timed)


@query(f"with {MAPPED} select map_id, analysis_id, video_key, scene_id, domain_key from active")
def active_version_join(spark, d):
    return D.active_mappings(table(spark, d, "scene_domain_map")).select("map_id", "analysis_id", "video_key", "scene_id", "domain_key")


@query(f"with {MAPPED} select map_id, scene_id, video_key from active where list_contains(list_transform(keywords, lambda k: lower(trim(regexp_replace(nfc_normalize(k), '{BLANKS}', ' ', 'g')))), 'bắt quả tang')")
def find_by_keyword(spark, d):
    return D.find_by_keyword(D.active_mappings(table(spark, d, "scene_domain_map")), "Bắt quả tang").select("map_id", "scene_id", "video_key")


@query(f"with {MAPPED} select map_id, scene_id, video_key from active where lower(regexp_replace(topic_id, '^\\s+|\\s+$', '', 'g')) = 'football'")
def find_by_topic(spark, d):
    return D.find_by_topic(D.active_mappings(table(spark, d, "scene_domain_map")), "football").select("map_id", "scene_id", "video_key")


@query(f"with {SEGMENTS} select analysis_id, segment_idx, unnest(range(start_scene_id, end_scene_id + 1))::int scene_id from segs where start_scene_id <= end_scene_id")
def segment_expand(spark, d):
    return D.expand_segments(_segments(spark, d)).select("analysis_id", "segment_idx", "scene_id")


# sets and points


@query("select coalesce(a.v, b.v) video_name, case when a.v is null then 'right' when b.v is null then 'left' else 'both' end side from (select distinct video_name v from videos where video_name is not null) a full join (select distinct video_name v from scenes where video_name is not null) b on a.v = b.v")
def missing_sets(spark, d):
    return P.in_both_or_one(table(spark, d, "videos"), table(spark, d, "scenes"), "video_name")


@query("select doc_id, external_video_id from documents where external_video_id is not null and external_video_id not in (select video_name from videos where video_name is not null)")
def skip_done(spark, d):
    done = table(spark, d, "videos").select(F.col("video_name").alias("external_video_id")).distinct()
    return table(spark, d, "documents").select("doc_id", "external_video_id").where("external_video_id is not null").join(done, "external_video_id", "left_anti")


@query("select o_custkey, o_orderkey, o_totalprice, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, (o_orderstatus = 'F')::int desc, o_orderkey desc) r from orders) where r = 1")
def upsert_latest(spark, d):
    """Orders of status F put over the others: the latest of each customer stays."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", F.struct("o_orderdate", (F.col("o_orderstatus") == "F").cast("int"), "o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("f"))
    return P.upsert(o.where("not coalesce(f, false)"), o.where("f"), ["o_custkey"], "version").drop("version", "f")


@query("with k as (select row_number() over (order by video_name) n, video_name from (select distinct video_name from scenes where video_name is not null and video_name not in (select video_name from videos where video_name is not null))), m as (select max(video_id) m from videos) select distinct video_id, video_name from videos where video_id is not null union all select n + m, video_name from k, m")
def get_or_create_ids(spark, d):
    known = table(spark, d, "videos").where("video_id is not null").select("video_id", "video_name").distinct()
    return P.assign_ids(known, table(spark, d, "scenes").select("video_name"), "video_name", "video_id")


@query(f"with {PTS}, {ANCHOR}, {SCORED}, t as (select point_id, row_number() over (order by score desc, point_id) - 1 as rank from scored order by score desc, point_id limit 30) select t.rank, p.point_id, p.video_name, p.frame from t join pts p using (point_id)")
def ordered_hydrate(spark, d):
    hits = S.exact_topk(_points(spark, d), _anchor(_points(spark, d))[2], 30).select("point_id", "rank")
    rows = X.usable(_points(spark, d)).groupBy("point_id").agg(F.max("video_name").alias("video_name"), F.max("frame").alias("frame"))
    return P.hydrate(rows, hits, "point_id").select("rank", "point_id", "video_name", "frame")


@query("select doc_id, lang, source from documents where doc_id > 100 order by doc_id limit 50")
def scroll_page(spark, d):
    return P.scroll(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", 100, 50)


@query("select group_name, count(distinct point_id) n_points, count(*) n_rows from keyframes group by 1")
def count_points(spark, d):
    return table(spark, d, "keyframes").groupBy("group_name").agg(F.countDistinct("point_id").alias("n_points"), F.count(F.lit(1)).alias("n_rows"))


@query("select distinct k.point_id, v.video_id is not null as deleted from keyframes k left join (select distinct video_id from videos where deleted_at is not null) v on k.video_id = v.video_id where k.point_id is not null")
def delete_points(spark, d):
    return P.delete(_points(spark, d).select("point_id", "video_id").distinct(), _deleted_videos(spark, d), "video_id").select("point_id", "deleted").distinct()


@query("select doc_id % 8 as shard, count(*) n from documents where doc_id is not null group by 1")
def work_shard(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    return docs.groupBy(P.shard_of(F.col("doc_id"), 8, hashed=False).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("select group_name, grouping(group_name)::int as is_total, count(distinct video_name) n_videos, count(distinct point_id) n_keyframes from keyframes group by rollup(group_name)")
def group_totals_rollup(spark, d):
    return table(spark, d, "keyframes").rollup("group_name").agg(F.grouping("group_name").cast("int").alias("is_total"), F.countDistinct("video_name").alias("n_videos"), F.countDistinct("point_id").alias("n_keyframes"))


@query("select event_type, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from events group by 1")
def status_counts(spark, d):
    return Q.counts(table(spark, d, "events"), "event_type")


@query("with a as (select distinct video_name from scenes where video_name is not null), b as (select distinct video_name from keyframes where video_name is not null) select coalesce(a.video_name, b.video_name) video_name from a full join b on a.video_name = b.video_name where a.video_name is null or b.video_name is null")
def selection_toggle(spark, d):
    return P.toggle(table(spark, d, "scenes"), table(spark, d, "keyframes"), "video_name")


@query("with r as (select event_type stage, value v, row_number() over (partition by event_type order by ts desc, event_id desc) n from events where value is not null) select stage, count(*) n, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.95), 6) p95, round(quantile_cont(v, 0.99), 6) p99 from r where n <= 4096 group by 1")
def latency_percentiles(spark, d):
    return Q.latency_percentiles(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")


# text and scalars


@query(r"select doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, '_', ' '), '[!-/:-@\[-`{-~]', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')) as canonical from documents")
def canonicalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.canonicalize(F.col("text")).alias("canonical"))


@query(f"with {SEGMENTS}, k as (select analysis_id, segment_idx, word, min(pos) firstpos from (select analysis_id, segment_idx, unnest(keywords) kw, generate_subscripts(keywords, 1) pos from segs), lateral (select lower(trim(regexp_replace(nfc_normalize(kw), '{BLANKS}', ' ', 'g'))) word) where word is not null and word <> '' group by 1, 2, 3), l as (select analysis_id, segment_idx, list(word order by firstpos)[1:4] keywords from k group by 1, 2) select s.analysis_id, s.segment_idx, case when s.keywords is null then null else coalesce(l.keywords, []) end keywords from segs s left join l on l.analysis_id is not distinct from s.analysis_id and l.segment_idx is not distinct from s.segment_idx")
def keyword_normalize(spark, d):
    return _segments(spark, d).select("analysis_id", "segment_idx", X.normalize_keywords(F.col("keywords")).alias("keywords"))


@query("select o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') as content_hash from orders")
def stable_hash(spark, d):
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", X.stable_hash({n: F.col(n) for n in names}).alias("content_hash"))


@query("""with s as (select event_id, event_id % 4 kind, (event_id % 24)::int h, (event_id % 60)::int m, (event_id * 7 % 60)::int s, (event_id * 13 % 1000)::int ms from events),
 t as (select *, case kind when 0 then printf('%02d:%02d:%02d:%03d', h, m, s, ms) when 1 then printf('%02d:%02d:%02d.%03d', h, m, s, ms) when 2 then printf('%d.%03d', s, ms) else 'n/a' end v from s) select event_id, v as raw, case when kind < 2 then round(h * 3600 + m * 60 + s + ms / 1000, 6) when kind = 2 then round(s + ms / 1000, 6) end as seconds from t""")
def time_parse(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 24).cast("int").alias("h"), (F.col("event_id") % 60).cast("int").alias("m"), (F.col("event_id") * 7 % 60).cast("int").alias("s"), (F.col("event_id") * 13 % 1000).cast("int").alias("ms"))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.format_string("%02d:%02d:%02d:%03d", "h", "m", "s", "ms")).when(kind == 1, F.format_string("%02d:%02d:%02d.%03d", "h", "m", "s", "ms")).when(kind == 2, F.format_string("%d.%03d", "s", "ms")).otherwise("n/a")
    return e.select("event_id", raw.alias("raw")).withColumn("seconds", F.round(X.to_seconds(F.col("raw")), 6))


@query("select distinct video_name, array_to_string(list_transform(regexp_extract_all(lower(video_name), '(\\d+|\\D+)'), lambda x: case when regexp_matches(x, '^\\d') then lpad(x, 12, '0') else x end), '') as sort_key from keyframes where video_name is not null")
def natural_sort_key(spark, d):
    return table(spark, d, "keyframes").where("video_name is not null").select("video_name").distinct().withColumn("sort_key", X.natural_key(F.col("video_name")))


@query("select distinct keyframe_key, case when regexp_matches(keyframe_key, '(\\d+)\\.webp$') then regexp_extract(keyframe_key, '(\\d+)\\.webp$', 1)::bigint end frame_no, case when starts_with(keyframe_key, video_name) then regexp_replace(substr(keyframe_key, length(video_name) + 1), '^/', '') else keyframe_key end rest from keyframes where keyframe_key is not null and video_name is not null")
def url_key_parse(spark, d):
    k = table(spark, d, "keyframes").where("keyframe_key is not null and video_name is not null").select("keyframe_key", "video_name").distinct()
    return k.select("keyframe_key", X.frame_of_key(F.col("keyframe_key")).alias("frame_no"), X.strip_prefix(F.col("keyframe_key"), F.col("video_name")).alias("rest"))


@query("select distinct source_id, case when good then regexp_replace(p[1], '^Keyscence_', '') end group_name, case when good then p[3] end video_name from (select source_id, string_split(source_id, '/') p, len(p) = 4 and p[2] = 'keyscence' and p[4] = 'scenes.json' good from scene_domain_map)")
def scene_source_parse(spark, d):
    m = table(spark, d, "scene_domain_map").select("source_id").distinct()
    return m.withColumn("p", X.scene_source_parts(F.col("source_id"))).select("source_id", "p.group_name", "p.video_name")


def _bm25_sql(k1: float, b: float, k: int) -> str:
    return f"""q as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) term from (select domain_id query_id, domain_label as text from domains)),
 dd as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') ts from (select doc_id, min(text) as text from documents where doc_id is not null group by 1) where text is not null), z as (select doc_id, ts, len(ts) dl from dd where len(ts) > 0), st as (select count(*) n, avg(dl) avgdl from z),
 tf as (select term, doc_id, dl, count(*) tf from (select doc_id, dl, unnest(ts) term from z) where term in (select term from q) group by 1, 2, 3), df as (select term, count(*) df from tf group by 1),
 h as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) score from q join df using (term) join tf using (term), st group by 1, 2),
 r as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from h), top{k} as (select * from r where rank < {k})"""


def _domain_queries(spark, d) -> DataFrame:
    return table(spark, d, "domains").select(F.col("domain_id").alias("query_id"), F.col("domain_label").alias("text"))


@query(f"with {_bm25_sql(1.2, 0.75, 10)} select * from top10")
def bm25_topk(spark, d):
    return bm25(table(spark, d, "documents").select("doc_id", "text"), _domain_queries(spark, d), 10)


@query(f"with a as (with {_bm25_sql(1.2, 0.75, 50)} select * from top50), b as (with {_bm25_sql(2.0, 0.3, 50)} select * from top50) select query_id, doc_id, round(sum(p), 9) fused from (select query_id, doc_id, 1.0::double / (60 + rank + 1) p from a union all select query_id, doc_id, 1.0::double / (60 + rank + 1) from b) group by 1, 2")
def hybrid_rrf(spark, d):
    """Two sparse rankings of every query, fused by reciprocal ranks."""
    docs, q = table(spark, d, "documents").select("doc_id", "text"), _domain_queries(spark, d)
    return S.rrf([(bm25(docs, q, 50), 1.0), (bm25(docs, q, 50, 2.0, 0.3), 1.0)], ["query_id", "doc_id"])


@query(f"with {PTS}, {ANCHOR}, {SCORED}, t as (select point_id, video_name, keyframe_time, score from scored order by score desc, point_id limit 100), v as (select video_name, string_agg(cast(round(keyframe_time * 1000) as bigint)::varchar, ',' order by score desc, point_id) ms from t where keyframe_time is not null group by 1) select video_name, '{{\"answerSets\":[{{\"answers\":[{{\"text\":\"TR-' || video_name || '-' || ms || '\"}}]}}]}}' as answer from v")
def submission_rows(spark, d):
    """One answer of the chain task for each video of the top 100."""
    hits = S.distinct_topk(_scored(_points(spark, d), _anchor(_points(spark, d))[2], "video_name", "keyframe_time"), 100).where("keyframe_time is not null and video_name is not null")
    ms = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "point_id", F.round(F.col("keyframe_time") * 1000).cast("long").cast("string").alias("ms")))), lambda x: x["ms"])
    per = hits.groupBy("video_name").agg(F.array_join(ms, ",").alias("ms"))
    text = F.concat(F.lit("TR-"), "video_name", F.lit("-"), "ms").alias("text")
    return per.select("video_name", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(text)).alias("answers"))).alias("answerSets"))).alias("answer"))


@query("""with e as (select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) k from events) select event_id, list_distinct_ordered as tags from (select event_id, case when k = 3 then [3] else [k, 3] end list_distinct_ordered from e)""")
def llm_json_parse(spark, d):
    """Integers out of an answer with text around its JSON, numbers as text, rubbish and repeats."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).cast("string")
    answer = F.concat(F.lit('Sure:\n```json\n{"tags": ['), k, F.lit(', "3", "x", '), k, F.lit("]}\n``` done"))
    return table(spark, d, "events").select("event_id", X.json_tags(answer).alias("tags"))


@query()
def blake2_point_id(spark, d):
    k = table(spark, d, "keyframes").select("video_name", "frame").distinct()
    return k.select("video_name", "frame", X.blake2_point_id("video_name", "frame").alias("hash_id"))


@query("select doc_id, trim(regexp_replace(nfc_normalize(text), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as normal from documents")
def nfc_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfc(F.col("text")).alias("normal"))


@query()
def text_encode_fake(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_encoder(32)(F.col("text")).alias("vector"))


@query("select date_trunc('day', ts) as day, event_type, count(*) n from events where ts is not null group by 1, 2")
def stream_event_counts(spark, d):
    """The events table read as a stream of files, counted in daily windows with a watermark."""
    from framewright.streaming.streams import windowed_counts_once

    return windowed_counts_once(spark, d, "events", "ts", "event_type", "1 day").withColumnRenamed("start", "day")


__all__ = ["QUERIES", "SQL"]
