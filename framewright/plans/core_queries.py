"""The pN_ queries of the general operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.coverage import periods_and_gaps, scene_spans
from framewright.operators.drift import consistent_records, schema_changes
from framewright.operators.orphans import orphan_references, orphan_report
from framewright.session import table

DRIFT_FIELDS = {"vector": "series", "dim": "number", "payload.shot_id": "number"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of each video."""
    return periods_and_gaps(scene_spans(table(spark, d, "scenes"), table(spark, d, "videos")), "video_name", "start_frame", "end_frame")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per video: periods, gaps, covered and uncovered frames."""
    return p1_found(spark, d).groupBy("video_name").agg(
        F.count_if(F.col("span_kind") == "period").alias("n_periods"),
        F.count_if(F.col("span_kind") == "gap").alias("n_gaps"),
        F.sum(F.when(F.col("span_kind") == "period", F.col("end_frame") - F.col("start_frame") + 1).otherwise(0)).alias("covered_frames"),
        F.sum(F.when(F.col("span_kind") == "gap", F.col("end_frame") - F.col("start_frame") + 1).otherwise(0)).alias("gap_frames"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the shard files' layout."""
    return schema_changes(table(spark, d, "shard_records"), DRIFT_FIELDS)


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """All shard records in one layout."""
    return consistent_records(table(spark, d, "shard_records"), DRIFT_FIELDS)


def _orphans(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    scenes, videos, clips, mapped, domains = (table(spark, d, t) for t in ("scenes", "videos", "clips", "scene_domain_map", "domains"))
    return [
        ("scenes.video_id", orphan_references(scenes, videos, {"video_id": "video_id"}, "id", "loaded_at", "created_at", "deleted_at")),
        ("scenes.clip_key", orphan_references(scenes, clips, {"clip_key": "clip_key"}, "id", "loaded_at", "stored_at", "deleted_at")),
        ("scene_domain_map.scene_id", orphan_references(mapped, scenes, {"external_video_id": "video_name", "scene_id": "scene_id"}, "map_id", "loaded_at", "loaded_at")),
        ("scene_domain_map.domain_id", orphan_references(mapped, domains, {"domain_id": "domain_id"}, "map_id", "loaded_at", "loaded_at", "deleted_at")),
    ]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a record that is missing, deleted or late."""
    out = None
    for field, rows in _orphans(spark, d):
        part = rows.select(F.lit(field).alias("ref_field"), "row_id", "orphan_kind", F.date_format("loaded", "yyyy-MM").alias("load_month"))
        out = part if out is None else out.unionByName(part)
    return out


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per reference, kind and month."""
    out = None
    for field, rows in _orphans(spark, d):
        part = orphan_report(rows, field)
        out = part if out is None else out.unionByName(part)
    return out


def p6_match_modes(spark: SparkSession, d: str) -> DataFrame:
    """Orphans among the composite references of mapped scenes, when a partly null key means something."""
    mapped, scenes = table(spark, d, "scene_domain_map"), table(spark, d, "scenes")
    out = None
    for mode in ("partial", "full"):
        rows = orphan_references(mapped, scenes, {"external_video_id": "video_name", "scene_id": "scene_id"}, "map_id", "loaded_at", "loaded_at", match=mode)
        part = rows.select(F.lit(mode).alias("match_mode"), "row_id", "orphan_kind")
        out = part if out is None else out.unionByName(part)
    return out


P1_SQL = """
with v as (select video_id, arg_min(fps, created_at) fps from videos where fps > 0 group by 1),
w as (select video_name, arg_min(fps, created_at) fps from videos where fps > 0 group by 1),
s as (select s.video_name, coalesce(s.start_frame, cast(round(s.start_time * coalesce(v.fps, w.fps)) as bigint)) a, coalesce(s.end_frame, cast(round(s.end_time * coalesce(v.fps, w.fps)) as bigint)) b
      from scenes s left join v using (video_id) left join w on w.video_name = s.video_name where s.video_name is not null),
o as (select video_name, a, b, max(b) over (partition by video_name order by a, b rows between unbounded preceding and 1 preceding) m from s where a <= b),
g as (select *, sum(case when m is null or a > m + 1 then 1 else 0 end) over (partition by video_name order by a, b rows unbounded preceding) k from o),
p as (select video_name, k, min(a) a, max(b) b from g group by 1, 2),
n as (select *, lead(a) over (partition by video_name order by k) c from p),
spans as (select 'period' span_kind, video_name, a start_frame, b end_frame from p union all select 'gap', video_name, b + 1, c - 1 from n where c is not null)
"""


def _refs_sql(field: str, refs: str, row: str, keys: list[tuple[str, str, bool]], target: str, arrived: str, gone: str) -> str:
    norm = lambda c, text: f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))" if text else c
    names = ", ".join(kk := [f"k{i}" for i in range(len(keys))])
    ours = ", ".join(f"{norm(f'x.{r}', text)} {k}" for (r, _, text), k in zip(keys, kk))
    theirs = ", ".join(f"{norm(f'y.{t}', text)} {k}" for (_, t, text), k in zip(keys, kk))
    held = " and ".join(f"{k} is not null" for k in kk)
    return f"""select '{field}' ref_field, row_id, kind orphan_kind, strftime(loaded, '%Y-%m') load_month from (
    select row_id, loaded, case when gone is null then 'missing' when gone then 'deleted' when since > loaded then 'late' end kind from
      (select * from (select x.{row} row_id, x.loaded_at loaded, {ours}, row_number() over (partition by x.{row} order by x.loaded_at) rn from {refs} x) where rn = 1 and {held}) r
      left join (select {names}, min(gone) gone, min(case when not gone then since end) since from (select {theirs}, {gone} gone, y.{arrived} since from {target} y) where {held} group by {names}) t using ({names}))
    where kind is not null"""


P6_SQL = " union all ".join(
    [
        _refs_sql("scenes.video_id", "scenes", "id", [("video_id", "video_id", False)], "videos", "created_at", "deleted_at is not null"),
        _refs_sql("scenes.clip_key", "scenes", "id", [("clip_key", "clip_key", True)], "clips", "stored_at", "deleted_at is not null"),
        _refs_sql("scene_domain_map.scene_id", "scene_domain_map", "map_id", [("external_video_id", "video_name", True), ("scene_id", "scene_id", False)], "scenes", "loaded_at", "false"),
        _refs_sql("scene_domain_map.domain_id", "scene_domain_map", "map_id", [("domain_id", "domain_id", True)], "domains", "loaded_at", "deleted_at is not null"),
    ]
)

def _mask_sql(mode: str, held: tuple[str, ...], absent: tuple[str, ...]) -> str:
    keys = ", ".join(held)
    there = " and ".join([*(f"{k} is not null" for k in held), *(f"{k} is null" for k in absent)])
    if absent and mode == "full":
        return f"select '{mode}' match_mode, row_id, 'missing' orphan_kind from refs where {there}"
    known = " and ".join(f"{k} is not null" for k in held)
    return f"""select '{mode}' match_mode, row_id, case when since is null then 'missing' else 'late' end orphan_kind from (select * from refs where {there}) r
      left join (select {keys}, min(since) since from targets where {known} group by {keys}) t using ({keys}) where since is null or since > loaded"""


P6_MODES_SQL = """with refs as (select map_id row_id, loaded_at loaded, lower(regexp_replace(external_video_id, '^\\s+|\\s+$', '', 'g')) k0, scene_id k1 from (select *, row_number() over (partition by map_id order by loaded_at) rn from scene_domain_map) where rn = 1),
 targets as (select lower(regexp_replace(video_name, '^\\s+|\\s+$', '', 'g')) k0, scene_id k1, loaded_at since from scenes) """ + " union all ".join(
    _mask_sql(mode, held, absent) for mode in ("partial", "full") for held, absent in ((("k0", "k1"), ()), (("k0",), ("k1",)), (("k1",), ("k0",)))
)

QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p2_found": p2_found, "p2_records": p2_records, "p6_found": p6_found, "p6_report": p6_report, "p6_match_modes": p6_match_modes}
SQL = {
    "p1_found": P1_SQL + "select * from spans",
    "p1_coverage": P1_SQL + """select video_name, sum((span_kind = 'period')::int)::bigint n_periods, sum((span_kind = 'gap')::int)::bigint n_gaps,
      sum(case when span_kind = 'period' then end_frame - start_frame + 1 else 0 end)::bigint covered_frames, sum(case when span_kind = 'gap' then end_frame - start_frame + 1 else 0 end)::bigint gap_frames from spans group by 1""",
    "p6_found": P6_SQL,
    "p6_match_modes": P6_MODES_SQL,
    "p6_report": f"select ref_field, orphan_kind, load_month, count(*) n from ({P6_SQL}) group by 1, 2, 3",
}
