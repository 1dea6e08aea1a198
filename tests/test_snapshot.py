import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.plans.engine import Engine, clamp_k
from framewright.sources import files as R
from framewright.sources import snapshot as S
from framewright.streaming import streams

DIM = 8


def points(spark, n=40, scale=1.0):
    v = np.random.default_rng(5).standard_normal((n, DIM))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * scale
    rows = [((i + 1) * 13, f"V{i % 3}", i, i * 0.5, i % 4 if i % 9 else None, i == 3, [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "point_id long, video_name string, frame long, keyframe_time double, tag int, deleted boolean, vector array<float>"), v


def vocab(spark, n=4):
    return spark.createDataFrame([(i, f"d{i}", "") for i in range(n)], "tag int, name string, description string")


@pytest.fixture()
def snap(spark, tmp_path):
    return S.write_snapshot(points(spark)[0], str(tmp_path / "s"), 1, encoder="fake", dim=DIM, expected=40, vocab=vocab(spark))


def edit(path, **k):
    m = json.load(open(f"{path}/manifest.json"))
    json.dump({**m, **k}, open(f"{path}/manifest.json", "w"))
    crc = f"{path}/.manifest.json.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_loads_and_serves(spark, snap):
    v = points(spark)[1]
    e = Engine(spark, lambda texts: np.stack([v[len(t) % 40] for t in texts]))
    assert e.health() == {"ready": False}
    with pytest.raises(ValueError):
        e.search("x")
    assert e.load(snap, dim=DIM, encoder="fake")["count"] == 40
    hits, meta = e.search("abc", top_k=5)
    rows = hits.collect()
    s = [(round(float(v[i] @ v[3]), 6), (i + 1) * 13) for i in range(40) if i != 3]
    assert [r.point_id for r in rows] == [p for _, p in sorted(s, key=lambda x: (-x[0], x[1]))[:5]] and meta["corpus"] == 40 and meta["strategy"] == "pre"
    hits, meta = e.search(vector=v[0], top_k=5, tags=[1, 1])
    assert meta["tags_used"] == [1, 1] and hits.count() == 5
    hits, _ = e.search(vector=v[0], top_k=10, max_per_video=1)
    assert hits.count() == 3
    for bad in ({"vector": [1.0]}, {"text": " "}, {"vector": v[0], "tags": [9]}):
        with pytest.raises(ValueError):
            e.search(**bad)
    assert e.similar(13, 4).count() == 4 and e.grouped(v[0], 2, 2).count() == 4 and {r.frame for r in e.neighbours("V0", 3, 1, 1).collect()} == {0, 6}
    with pytest.raises(KeyError):
        e.neighbours("V0", 1)
    assert e.stats()["queries"] == 3 and e.tags().count() == 4 and clamp_k(None) == 20 and clamp_k(1000) == 300

    def broken(*_):
        raise RuntimeError("down")

    e.choose_tags = broken
    assert e.search("abc", top_k=3)[1]["warnings"] == ["tags: down"]


def test_corruption_fails_closed(spark, snap, tmp_path):
    bad = [dict(dim=9), dict(encoder="other"), dict(count=41), dict(checksums={})]
    for k in bad:
        at = str(tmp_path / "bad")
        shutil.copytree(snap, at)
        edit(at, **k)
        with pytest.raises(S.SnapshotError):
            S.load_snapshot(spark, at, dim=DIM, encoder="fake")
        shutil.rmtree(at)
    at = str(tmp_path / "lost")
    shutil.copytree(snap, at)
    for f in os.listdir(f"{at}/points"):
        if f.endswith(".parquet"):
            os.remove(f"{at}/points/{f}")
            break
    with pytest.raises(S.SnapshotError):
        S.load_snapshot(spark, at)
    with pytest.raises(S.SnapshotError):
        S.load_snapshot(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("change", [lambda d: d.withColumn("vector", F.transform("vector", lambda x: x * 15)), lambda d: d.withColumn("vector", F.slice("vector", 1, 4)), lambda d: d.withColumn("point_id", F.lit(1).cast("long")), lambda d: d.withColumn("tag", F.lit(65535)), lambda d: d.withColumn("tag", F.lit(7)), lambda d: d.withColumn("point_id", F.lit(None).cast("long"))])
def test_broken_rows_fail(spark, tmp_path, change):
    p = S.write_snapshot(change(points(spark)[0]), str(tmp_path / "s"), 2, encoder="fake", dim=DIM, vocab=vocab(spark))
    with pytest.raises(S.SnapshotError):
        S.load_snapshot(spark, p)


def test_wrong_count_never_serves(spark, tmp_path):
    with pytest.raises(S.SnapshotError):
        S.write_snapshot(points(spark)[0], str(tmp_path / "s"), 1, encoder="f", dim=DIM, expected=1)
    assert not os.path.exists(tmp_path / "s/v=000000001/manifest.json")
    assert S.merge_checksums({"a": "1", "b": "2"}, {"b": "3"}) == {"a": "1", "b": "3"}


def test_missing_videos(spark, snap):
    want = spark.createDataFrame([("V0",), ("V9",)], "video_name string")
    assert [r.video_name for r in S.missing_videos(S.load_snapshot(spark, snap), want).collect()] == ["V9"]


def test_readers(spark, tmp_path):
    df = points(spark)[0]
    R.write_shards(df.where("frame < 20").withColumn("dim", F.lit(8)), str(tmp_path / "sh/a"), rows=7)
    R.write_shards(df.where("frame >= 20").withColumn("group", F.lit("g")).drop("keyframe_time"), str(tmp_path / "sh/b"))
    got = R.read_shards(spark, str(tmp_path / "sh"))
    assert got.count() == 40 and got.columns == list(R.POINT_COLUMNS) and got.where("group_name = 'g'").count() == 20
    d = tmp_path / "Keyscence_L26_b/keyscence/L26_V001"
    d.mkdir(parents=True)
    (d / "scenes.json").write_text(json.dumps([{"scene_id": 0, "script": "x", "start_frame": 0, "end_frame": 9, "start_time": 0.0, "end_time": 1.0, "more": 1}]))
    r = R.read_scenes(spark, str(tmp_path / "Keyscence_L26_b")).first()
    assert (r.video_name, r.group_name, r.end_frame) == ("L26_V001", "L26_b", 9)
    (tmp_path / "shots.csv").write_text("shot_id,start_frame,end_frame,start_ts,end_ts,kf0,kf1,kf2\n0,0,9,0.0,0.9,1,5,8\n")
    assert R.read_shots(spark, str(tmp_path / "shots.csv")).first().kf == [1, 5, 8]
    for i, text in enumerate(('{"0": "a", "2": "b"}', '{"0": {"name": "a", "description": "x"}, "2": {"name": "b"}}')):
        (tmp_path / f"v{i}.json").write_text(text)
        assert {(x.tag, x.name) for x in R.read_vocab(spark, str(tmp_path / f"v{i}.json")).collect()} == {(0, "a"), (2, "b")}
    (tmp_path / "vx.json").write_text('{"k": "a"}')
    with pytest.raises(Exception):
        R.read_vocab(spark, str(tmp_path / "vx.json")).collect()
    m = lambda g, s: json.dumps({"groups": [g], "videos": {"V": {"keyframes": [{"frame": 12, "scene_id": s}, {"frame": 3, "scene_id": None}]}}})
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/a.json").write_text(m("g1", 0))
    (tmp_path / "maps/b.json").write_text(m("g2", 1))
    assert [tuple(x) for x in R.read_keyframe_maps(spark, str(tmp_path / "maps")).collect()] == [("V", 12, 1)]
    assert [tuple(x) for x in R.read_keyframe_maps(spark, str(tmp_path / "maps"), ["g1"]).collect()] == [("V", 12, 0)]
    assert R.list_objects(spark, str(tmp_path / "maps"), "*.json").count() == 2 and len(R.file_hashes(spark, str(tmp_path / "maps"), "a.json").first().sha256) == 64


def test_discovery(spark):
    keys = [f"Keyscence_{g}/keyscence/{v}/scenes.json" for g, v in (("L26_b", "L26_V001"), ("L26_b", "L26_V002"), ("L26_c", "L26_V003"), ("L29_a", "L29_V001"))] + ["x/y.json"]
    o = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    names = lambda **k: [r.video_name for r in R.discover_sources(o, **k).collect()]
    assert len(names()) == 4 and names(groups=[" Keyscence_L26_b/ "], prefix="Keyscence_L29") == ["L26_V001", "L26_V002"]
    assert names(key=keys[3]) == ["L29_V001"] and names(video="L26_V00") == ["L26_V001", "L26_V002", "L26_V003"] and names(files=[keys[0]]) == ["L26_V001"] and names(prefix="Keyscence_L29") == ["L29_V001"]
    with pytest.raises(ValueError):
        names(groups=["nope"])
    assert R.parse_store_uri("s3://b/k/x/") == ("b", "k/x")
    for bad in ("http://b/k", "s3:///k"):
        with pytest.raises(ValueError):
            R.parse_store_uri(bad)
    v = spark.createDataFrame([("a/video/1.mp4",), ("a/2.mp4",), ("b.txt",)], "path string")
    assert [r.path for r in R.find_videos(v).collect()] == ["a/video/1.mp4"] and [r.path for r in R.find_videos(v.where("path not like '%video%'")).collect()] == ["a/2.mp4"]
    p = spark.createDataFrame([('{"streams": [{"width": 1920, "height": 1080, "r_frame_rate": "30000/1001"}]}',)], "probe string")
    r = R.probe_fields(p).first()
    assert (r.width, r.n_frames) == (1920, -1) and abs(r.fps - 29.97) < 0.001


def test_documents_and_payload(spark, tmp_path):
    f = spark.createDataFrame([("g", "v", 1, 5, 0), ("g", "v", 1, 2, None)], "group_name string, video_name string, video_id long, frame long, scene_id int")
    s = spark.createDataFrame([("g", "v", 0, 0, 9, 0.0, 1.0, "hi", "c")], "group_name string, video_name string, scene_id int, start_frame long, end_frame long, start_time double, end_time double, script string, clip_key string")
    doc = json.loads(R.group_documents(f, s).first().document)
    assert (doc["n_videos"], doc["n_keyframes"], doc["n_scenes"]) == (1, 2, 1)
    flat = {r.keyframe_id: r.scene_end_frame for r in R.flat_map(f, s.drop("group_name"), str(tmp_path / "csv")).collect()}
    assert flat == {"v#000005": 9, "v#000002": None} and os.path.isdir(tmp_path / "csv")
    pay = {r.frame: r for r in R.payload_rows(f, s).collect()}
    assert pay[5].point_id == (1 << 32) | 5 and pay[5].has_speech and pay[5].end_sec == 1.0 and not pay[2].has_speech and pay[2].clip_key is None and pay[5].keyframe_key == "v/keyframes/000005.webp"


def test_streams(spark, tmp_path):
    rows = [("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "b"), (None, "a")]
    df = spark.createDataFrame(rows, "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in/e.parquet"))
    got = {(str(r.start), r.k, r.n) for r in streams.windowed_counts_once(spark, str(tmp_path / "in"), "e", "t", "k", "1 hour").collect()}
    assert got == {("2026-01-01 00:00:00", "a", 2), ("2026-01-01 01:00:00", "b", 1)}
    assert streams.session_counts(df, "t", "k", "45 minutes").where("k = 'a'").first().n == 2
    p = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, ver int")
    p.coalesce(1).write.parquet(str(tmp_path / "up/1"))
    p.selectExpr("id", "'z' v", "2 ver").where("id = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "up/1"))
    read = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "up/1"))
    streams.upsert_stream(read, str(tmp_path / "t"), ["id"], "ver", str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in streams.current_version(spark, str(tmp_path / "t")).collect()} == {(1, "x", 1), (2, "z", 2)}
    pts, v = points(spark)
    coarse, final = streams.search_stream(pts, v[0], 5)
    assert not coarse.first().is_final and final.first().is_final and final.count() == 5
