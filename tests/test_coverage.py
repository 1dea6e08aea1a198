import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framewright.operators.coverage import periods_and_gaps, scene_spans
from framewright.operators.ordered import spread_lag, spread_last, spread_prefix_sum
from pyspark.sql import functions as F


def brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        frames = sorted({f for a, s, e in rows if a == k and s is not None and e is not None for f in range(s, e + 1)})
        runs = []
        for f in frames:
            if runs and runs[-1][1] == f - 1:
                runs[-1][1] = f
            else:
                runs.append([f, f])
        out |= {("period", k, a, b) for a, b in runs}
        out |= {("gap", k, a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])}
    return out


def run(spark, rows, width=7):
    df = spark.createDataFrame(rows, "video_name string, a long, b long, d int, pos int, k string")
    return {tuple(r) for r in periods_and_gaps(df, "video_name", "a", "b", width).collect()}


def test_random_spans_across_buckets(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"v{rnd.randrange(3)}", s := rnd.randrange(200), s + rnd.randrange(-2, 9)) for _ in range(150)]
    got = run(spark, [(*r, 1, 2, "x") for r in rows])
    assert got == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 30)), st.one_of(st.none(), st.integers(0, 30))), max_size=12))
def test_any_spans(spark, rows):
    assert run(spark, [(*r, None, None, None) for r in rows]) == brute([r for r in rows if r[1] is None or r[2] is None or r[1] <= r[2]])


def test_empty_touching_nested_repeated(spark):
    assert run(spark, []) == set()
    rows = [("v", 0, 9), ("v", 10, 12), ("v", 0, 9), ("v", 3, 4), ("v", 20, 20), (None, 1, 2), ("v", 8, 2)]
    assert run(spark, [(*r, 0, 0, "") for r in rows]) == {("period", "v", 0, 12), ("gap", "v", 13, 19), ("period", "v", 20, 20)}


def test_bounds_from_times(spark):
    scenes = spark.createDataFrame([(1, "v", None, 50, 1.0, 2.0), (2, "w", 5, None, 0.0, 2.0), (1, "v", None, None, None, 2.0), (9, "x", None, 5, 1.0, 1.0), (1, "v", None, 60, float("nan"), 2.0)], "video_id long, video_name string, start_frame long, end_frame long, start_time double, end_time double")
    videos = spark.createDataFrame([(1, "v", 25.0, 1), (1, "v", 25.0, 2), (2, "w", None, 1), (None, "x", 10.0, 1)], "video_id long, video_name string, fps double, created_at int")
    got = sorted(map(tuple, scene_spans(scenes, videos).collect()), key=str)
    # the id 9 refers to no video, the name "x" does
    assert got == sorted([("v", 25, 50), ("w", 5, None), ("v", None, 50), ("x", 10, 5), ("v", None, 60)], key=str)


def test_spread_helpers_equal_plain_windows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.choice([1, 2, None])) for i in rnd.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g string, p int, v int")
    sums = {(r.g, r.p): r.s for r in spread_prefix_sum(df, ["g"], F.floor(F.col("p") / 40), ["p"], "v", "s").collect()}
    lags = {(r.g, r.p): (r.prev_exists, r.prev_v) for r in spread_lag(df, ["g"], F.floor(F.col("p") / 40), ["p"], ["v"]).collect()}
    lasts = {(r.g, r.p): r.o for r in spread_last(df, ["g"], F.floor(F.col("p") / 40), ["p"], F.col("v"), "o").collect()}
    for g in ("a", "b", None):
        total, before, last = 0, None, None
        for _, p, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += v or 0
            last = v if v is not None else last
            assert sums[g, p] == total
            assert lags[g, p] == ((False, None) if before is None else (True, before[0]))
            assert lasts[g, p] == last
            before = (v,)


def test_bad_match_semantics(spark):
    from framewright.operators.orphans import orphan_references

    df = spark.createDataFrame([], "id long, k string, t int")
    with pytest.raises(ValueError):
        orphan_references(df, df, {"k": "k"}, "id", "t", "t", match="other")
