import pytest
from pyspark.sql import functions as F

from framewright.functions import expr as X
from framewright.operators import domain as D
from framewright.operators import points as P
from framewright.operators import quality as Q
from framewright.operators import tags as T
from framewright.operators.text import bm25

SEGMENTS = "analysis_id string, segment_idx int, start_scene_id int, end_scene_id int, domain_id string, topic_id string, sub_domain string, keywords array<string>, summary string, loaded_at int"


def segs(spark, rows):
    return spark.createDataFrame(rows, SEGMENTS)


def test_merge(spark):
    s = segs(spark, [
        ("a", 0, 0, 1, "sports", "t", "Xe đạp", ["BMX", " xe  đạp", None, ""], "một", 1),
        ("a", 1, 2, 3, "sports", "t", "xe ĐẠP", ["giải đấu", "bmx", "olympic", "x"], "hai", 1),
        ("a", 2, 4, 4, "sports", "t", "xe đạp", None, "một", 1),
        ("a", 3, 5, 5, "health", "t", "xe đạp", ["k"], None, 1),
        ("a", 4, 6, 6, "sports", "t", "xe đạp", ["q"], "ba", 1),
        ("b", 0, 0, 0, None, None, None, None, None, 1),
    ])
    rows = D.merge_adjacent(s).orderBy("analysis_id", "segment_idx").collect()
    assert [(r.analysis_id, r.segment_idx, r.start_scene_id, r.end_scene_id, r.keywords, r.summary) for r in rows] == [
        ("a", 0, 0, 4, ["bmx", "xe đạp", "giải đấu", "olympic"], "một hai"),
        ("a", 1, 5, 5, ["k"], ""),
        ("a", 2, 6, 6, ["q"], "ba"),
        ("b", 0, 0, 0, [], ""),
    ]
    assert D.merge_adjacent(s.limit(0)).count() == 0


def test_coverage_and_topics(spark):
    s = segs(spark, [("a", 0, 0, 1, "d", "t", "", [], "", 1), ("a", 1, 3, 4, "D ", "x", "", [], "", 1), ("a", 2, 4, 2, "d", None, "", [], "", 1), ("b", 0, 1, 1, "d", "t", "", [], "", 1), ("b", 1, 1, 2, "d", "t", "", [], "", 1)])
    assert {(r.analysis_id, r.segment_idx): r.problem for r in D.coverage_check(s).collect()} == {("a", 0): None, ("a", 1): "gap", ("a", 2): "inverted", ("b", 0): "gap", ("b", 1): "overlap"}
    topics = spark.createDataFrame([("d", "t")], "domain_id string, topic_id string")
    assert {(r.analysis_id, r.segment_idx) for r in D.topic_check(s, topics).collect()} == {("a", 1), ("a", 2)}
    assert {(r.segment_idx, r.scene_id) for r in D.expand_segments(s.where("analysis_id = 'a'")).collect()} == {(0, 0), (0, 1), (1, 3), (1, 4)}


def test_rollup_ties_go_to_the_earlier_segment(spark):
    df = spark.createDataFrame([("a", 1, "y", "t", 0.0, 5.0), ("a", 0, "x", "t", 5.0, 10.0), ("b", 0, "x", "t", None, None)], "analysis_id string, segment_idx int, domain_id string, topic_id string, start_time double, end_time double")
    got = {r.analysis_id: (r.primary_domain, r.is_multi_domain, r.is_multi_topic, r.is_multi_segment) for r in D.rollup(df).collect()}
    assert got == {"a": ("x", True, True, True), "b": ("x", False, False, False)}


def mapped(spark):
    rows = [(1, "old", 0, "V1", "sports", "t", ["A b"], 1), (2, "new", 0, " v1", "health", "Football ", ["a  B"], 5), (2, "new", 0, " v1", "health", "Football ", ["a  B"], 9), (3, "new", 1, "V1", "nope", "t", None, 5), (4, "z", 0, None, "sports", "t", [], 5)]
    return spark.createDataFrame(rows, "map_id long, analysis_id string, scene_id int, external_video_id string, domain_id string, topic_id string, keywords array<string>, loaded_at int")


def test_only_the_active_version_is_read(spark):
    active = D.active_mappings(mapped(spark))
    assert {r.map_id for r in active.collect()} == {2, 3}
    assert {r.map_id for r in D.find_by_keyword(active, " A  b").collect()} == {2} and {r.map_id for r in D.find_by_topic(active, "football").collect()} == {2}
    jobs = spark.createDataFrame([("s", "c", "f")], "source_id string, content_hash string, fingerprint string")
    want = spark.createDataFrame([("s", "c", "f"), ("n", "c", "f")], "source_id string, content_hash string, fingerprint string")
    assert {tuple(r) for r in D.is_active(jobs, want).collect()} == {("s", True), ("n", False)}
    assert not any(r.up_to_date for r in D.is_active(jobs, want, force=True).collect())


def test_tags(spark):
    domains = spark.createDataFrame([("sports", "S", None), ("health", "H", None), ("gone", "G", 1)], "domain_id string, domain_label string, deleted_at int")
    vocab = T.tag_vocab(domains)
    assert {(r.tag, r.name) for r in vocab.collect()} == {(0, "health"), (1, "sports")}
    k = spark.createDataFrame([(1, "v1", 0), (1, "v1", 0), (2, "V1 ", 1), (3, None, 0), (4, "v1", None)], "point_id long, video_name string, scene_idx int")
    tags = T.compute_tags(k, mapped(spark), vocab)
    assert {(r.point_id, r.tag) for r in tags.collect()} == {(1, 0), (2, 65535), (3, 65535), (4, 65535)}
    assert {tuple(r) for r in T.unknown_domains(mapped(spark), vocab).collect()} == {("nope", 1)}
    assert {tuple(r) for r in T.tag_histogram(spark.createDataFrame([(2,), (2,), (0,), (65535,)], "tag int")).collect()} == {(0, 1, 0), (1, 0, 1), (2, 2, 1), (65535, 1, 3)}
    assert T.tag_coverage(tags).collect()[0].share == 1.0 and {r.n for r in T.vocab_with_counts(vocab, tags).collect()} == {0, 1}
    assert T.check_tags([1, 1, 0], 3) == [1, 0]
    with pytest.raises(ValueError):
        T.check_tags([4], 3)


def test_points(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, x string, v int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 1), (1, "old", 0)], "id long, x string, v int")
    assert {tuple(r) for r in P.upsert(old, new, ["id"], "v").collect()} == {(1, "a", 1), (2, "c", 5), (3, "d", 1)}
    names = spark.createDataFrame([("b",), ("zz",), ("aa",), ("zz",), (None,)], "x string")
    assert {tuple(r) for r in P.assign_ids(old.select("id", "x"), names, "x", "id").collect()} == {(1, "a"), (2, "b"), (3, "aa"), (4, "zz")}
    assert [r.id for r in P.scroll(old, "id", 1, 5).collect()] == [2]
    gone = P.delete(old, spark.createDataFrame([(2,), (2,), (None,)], "id long"), "id")
    assert [r.id for r in P.optimize(gone).collect()] == [1]
    assert {tuple(r) for r in P.in_both_or_one(old, new, "id").collect()} == {(1, "both"), (2, "both"), (3, "right")}
    assert [r.id for r in P.toggle(old, new, "id").collect()] == [3]
    assert {r.x for r in P.set_payload(old, F.col("id") == 1, x=F.lit("q")).collect()} == {"q", "b"}
    assert sum(P.work_shard(old, F.col("id"), 3, i).count() for i in range(3)) == 2


def test_quality(spark):
    v = spark.createDataFrame([([1.0, 0.0],), ([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "vector array<float>")
    r = Q.norm_report(v, dim=2).first()
    assert (r.n, r.n_null, r.n_dim, r.n_nan, r.n_zero, r.n_off_norm, r.min_norm, r.max_norm) == (6, 1, 1, 1, 1, 1, 1.0, 5.0)
    assert Q.norm_report(v.limit(0), dim=2).first().n == 0
    with pytest.raises(ValueError):
        Q.raise_if_failed(spark.createDataFrame([("c", True, "d")], "check string, failed boolean, detail string"))
    s = spark.createDataFrame([("a", f"2026-01-0{1 + i % 3}", i, float(i)) for i in range(30)] + [("a", "2026-01-01", 99, None)], "stage string, d string, i int, v double").withColumn("t", F.col("d").cast("timestamp"))
    r = Q.latency_percentiles(s, "stage", ["t", "i"], "v", last=15).first()
    last = sorted([(i % 3, i) for i in range(30)])[-15:]
    import numpy as np

    assert r.n == 15 and r.p50 == np.percentile([i for _, i in last], 50) and r.p99 == round(np.percentile([i for _, i in last], 99), 6)
    g = Q.id_gaps(spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), (None, 5)], "k string, i int"), "k", "i")
    assert {(r.k, r.contiguous) for r in g.collect()} == {("a", True), ("b", False)}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "xe đạp và xe máy"), (2, "Xe Đạp"), (3, None), (4, ""), (5, "khác"), (2, "Xe Đạp")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "XE đạp xe"), ("none", None)], "query_id string, text string")
    got = bm25(docs, q, 5).collect()
    assert {r.doc_id for r in got} == {1, 2} and [r.doc_id for r in sorted(got, key=lambda r: r["rank"])][0] == 2
    assert bm25(docs.limit(0), q, 5).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    s = F.lit
    assert [val(X.to_seconds(s(x))) for x in ("12.5", "00:00:05:250", "00:01:30.500", "7.0", "x", "1:2")] == [12.5, 5.25, 90.5, 7.0, None, None]
    assert val(X.canonicalize(s("  A_photo, of: (DOGS)!  x "))) == "a photo of dogs x"
    assert val(X.natural_key(s("V9a"))) < val(X.natural_key(s("v10a"))) and val(X.frame_of_key(s("a/000123.webp"))) == 123 and val(X.frame_of_key(s("a.jpg"))) is None
    assert val(X.point_id(s(1), s(5))) == (1 << 32) | 5 and val(X.strip_prefix(s("http://x/a/b"), s("http://x"))) == "a/b"
    h = 5381
    for c in "L21_V001/7":
        h = (h * 33) ^ ord(c)
    assert val(X.djb2(s("L21_V001/7"))) == h & 0xFFFFFFFF
    assert val(X.json_tags(s('x {"tags": [3, "4", "q", 3]} y'))) == [3, 4] and val(X.json_tags(s("no"))) == []
    assert val(X.prune_json(s('{"title": 1, "a": [{"default": 2, "b": 3}]}'))) == '{"a":[{"b":3}]}' and val(X.prune_json(s("{"))) is None
    assert val(X.scene_source_parts(s("Keyscence_L26_b/keyscence/L26_V001/scenes.json"))).video_name == "L26_V001" and val(X.scene_source_parts(s("a/b"))) is None
    assert [val(X.bit_is_clear(F.unhex(s("0580")), s(i))) for i in (0, 1, 2, 15, 16)] == [False, True, False, False, True]
    assert val(X.region_iou(F.struct(s(0.0).alias("x"), s(0.0).alias("y"), s(2.0).alias("w"), s(1.0).alias("h")), F.struct(s(1.0).alias("x"), s(0.0).alias("y"), s(2.0).alias("w"), s(1.0).alias("h")))) == pytest.approx(1 / 3)
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"a": 1, "b": "ă", "c": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert val(X.stable_hash({"b": s("ă"), "a": s(1), "c": s(None).cast("string")})) == want


def test_keywords_are_composed_and_folded(spark):
    import unicodedata

    from framewright.functions.expr import normalize_keywords
    from pyspark.sql import functions as F

    rows = [(1, [unicodedata.normalize("NFD", "Bắt  Quả Tang"), "bắt quả tang", None, " ", "STRASSE", "straße", "a", "b"]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id int, keywords array<string>")
    got = {r.id: r.k for r in df.select("id", normalize_keywords(F.col("keywords")).alias("k")).collect()}
    assert got == {1: ["bắt quả tang", "strasse", "a", "b"], 2: None, 3: []}


def test_a_strict_tag_build_refuses_unknown_domains(spark):
    from framewright.operators.tags import compute_tags

    frames = spark.createDataFrame([(1, "v", 0)], "point_id long, video_name string, scene_idx int")
    mapped = spark.createDataFrame([(1, "a", 0, "v", "odd", 1)], "map_id long, analysis_id string, scene_id int, external_video_id string, domain_id string, loaded_at int")
    vocab = spark.createDataFrame([(0, "known", "")], "tag int, name string, description string")
    assert compute_tags(frames, mapped, vocab).first().tag == 65535
    with pytest.raises(ValueError, match="odd"):
        compute_tags(frames, mapped, vocab, strict=True)
