import random

from pyspark.sql import functions as F

from framewright.operators import scenes as C


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "video_name string, frame long, keyframe_time double, hit string")


def scenes_of(spark, rows):
    return spark.createDataFrame(rows, "video_name string, scene_id int, start_frame long, end_frame long, start_time double, end_time double, script string, clip_key string")


def test_keyframe_indices(spark):
    shots = [(0, 5), (0, 7), (10, 11), (0, 100), (37, 41), (500, 1234), (7, 7), (0, 1)]
    df = spark.createDataFrame(shots, "s long, e long")
    for r in df.select("s", "e", C.keyframe_indices(F.col("s"), F.col("e"), 7).alias("k7"), C.keyframe_indices(F.col("s"), F.col("e"), 3).alias("k3"), C.keyframe_indices(F.col("s"), F.col("e"), 1).alias("k1")).collect():
        off = int((r.e - r.s) * 0.12)
        assert [r.k7[0], r.k7[3], r.k7[6]] == [r.s + off, (r.s + off + r.e - off) // 2, r.e - off]
        assert r.k3 == [r.k7[0], r.k7[3], r.k7[6]] and r.k1 == [r.k3[1]] and all(r.s <= x <= r.e for x in r.k7)


def test_islands(spark):
    def run(shots, probs):
        rows = [("v", i, a, b, p) for i, ((a, b), p) in enumerate(zip(shots, [*probs, None]))]
        df = spark.createDataFrame(rows, "k string, shot_id int, a long, b long, p double")
        return [(r.start, r.end, r.confidence) for r in C.boundaries_to_scenes(df, "k", "shot_id", "a", "b", "p").orderBy("scene_id").collect()]

    s = [(0, 30), (31, 60), (61, 90), (91, 120)]
    assert run(s[:1], []) == [(0, 30, 1.0)]
    assert run(s[:3], [0.1, 0.2]) == [(0, 90, 1.0)]
    assert run(s[:3], [0.9, 0.2]) == [(0, 30, 0.9), (31, 90, 1.0)]
    assert [x[:2] for x in run(s, [0.9, 0.1, 0.8])] == [(0, 30), (31, 90), (91, 120)]
    assert run(s[:2], [0.55]) == [(0, 60, 1.0)]


def plain_match(frame, at, scenes):
    """The three tiers by looking at every scene: each is graded, and the best grade wins."""
    started = sum(s[2] <= frame for s in scenes)
    graded = []
    for n, (_, scene, start, end, t0, t1, *_) in enumerate(scenes):
        last, following = n == started - 1, n == started
        if last and end >= frame:
            graded.append((0, 0, scene, "frame"))
        elif (last or following) and at is not None and t0 <= at <= t1:
            graded.append((1, n, scene, "time"))
        elif last or following:
            graded.append((2, max(start - frame, frame - end, 0), scene, "nearest"))
    return min(graded, key=lambda g: g[:2])[2:] if graded else (None, "none")


def test_matching_equals_the_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET", 16)
    rnd = random.Random(5)
    scenes, frames = [], []
    for v in ("a", "b", "long"):
        at = 0
        for i in range(4 if v != "long" else 40):
            at += rnd.randrange(0, 9)
            end = at + rnd.randrange(0, 12)
            scenes.append((v, i, at, end, at / 10, end / 10 + 0.05, "", None))
            at = max(at, end - rnd.randrange(0, 3))
    scenes += [("a", 99, None, 5, 0.0, 1.0, "", None), ("a", 98, 9, 3, 0.0, 1.0, "", None), (None, 97, 0, 500, 0.0, 9.0, "", None)]
    for v in ("a", "b", "long", "none"):
        frames += [(v, f, rnd.choice([f / 10, None, f / 10 + 0.04]), "x") for f in range(0, 160, 3)]
    f, s = frames_of(spark, frames), scenes_of(spark, scenes)
    usable = {v: sorted([x for x in scenes if x[0] == v and x[2] is not None and x[2] <= x[3]], key=lambda x: (x[2], x[3], x[1])) for v in ("a", "b", "long", "none")}
    got = {(r.video_name, r.frame): (r.match_scene_id, r.match) for r in C.match_scene(f.drop("hit"), s, "video_name").collect()}
    inside = {(r.video_name, r.frame): r.hit and r.hit.scene_id for r in C.containing_scene(f.drop("hit"), s, "video_name").collect()}
    assigned = {(r.video_name, r.frame): r.assigned_scene_id for r in C.assign_scene(f.drop("hit"), s, "video_name").collect()}
    for v, frame, at, _ in frames:
        own = usable[v]
        assert got[v, frame] == plain_match(frame, at, own), (v, frame)
        last = [x for x in own if x[2] <= frame][-1:]
        assert inside[v, frame] == (last[0][1] if last and last[0][3] >= frame else None)
        assert assigned[v, frame] == (next((x[1] for x in own if x[3] >= frame), own[-1][1]) if own else None)


def test_assignment_example(spark):
    s = scenes_of(spark, [("v", 0, 0, 100, 0.0, 4.0, "hello world", "u"), ("v", 1, 101, 200, 4.04, 8.0, "", None)])
    f = frames_of(spark, [("v", x, x / 25, "") for x in (0, 50, 150, 205)]).drop("hit")
    assert {r.frame: r.assigned_scene_id for r in C.assign_scene(f, s, "video_name").collect()} == {0: 0, 50: 0, 150: 1, 205: 1}
    assert C.assign_scene(f.limit(0), s, "video_name").count() == 0
    assert {r.match for r in C.match_scene(f, s.limit(0), "video_name").collect()} == {"none"}


def test_scripts(spark):
    s = spark.createDataFrame([("v", 0, 0.0, 3.0), ("v", 1, 3.0, 9.0), ("w", 0, 0.0, 500.0), ("v", 2, None, None)], "video_name string, scene_id int, start_time double, end_time double")
    p = spark.createDataFrame([("v", 1, 0.5, 1.5, "xin chào"), ("v", 3, 7.0, 8.0, "trời đẹp"), ("v", 2, 4.0, 5.0, "hôm nay"), ("w", 9, 130.0, 140.0, "b"), ("w", 8, 10.0, 11.0, "a"), ("v", 4, 2.5, 3.5, "!")], "video_name string, seq int, start double, end double, text string")
    got = {(r.video_name, r.scene_id): r.script for r in C.assign_script(s, p, "video_name").collect()}
    assert got == {("v", 0): "xin chào !", ("v", 1): "hôm nay trời đẹp !", ("w", 0): "a b", ("v", 2): ""}


def test_neighbours_and_shots(spark):
    f = frames_of(spark, [("v", x, None, "") for x in (5, 1, 9, 7, 7, 3)] + [(None, 1, None, "")])
    a = spark.createDataFrame([("v", 7), ("v", 8)], "video_name string, anchor_frame long")
    got = {(r.frame, r.offset) for r in C.neighbours(f, "video_name", a, 2, 5).collect()}
    assert got == {(3, -2), (5, -1), (9, 1)}
    shots = spark.createDataFrame([("v", 2, [1, 5]), ("v", 1, [5])], "video_name string, shot_id int, kf array<long>")
    assert {(r.frame, r.shot_id) for r in C.frame_to_shot(shots, "video_name").collect()} == {(1, 2), (5, 1)}
