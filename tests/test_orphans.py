import random

import pytest

from framewright.operators.orphans import orphan_references, orphan_report


def brute(refs, targets, match):
    first = {}
    for r in refs:
        if r[0] not in first or (r[3], str(r)) < (first[r[0]][3], str(first[r[0]])):
            first[r[0]] = r
    norm = lambda k: k.strip().lower() if k is not None else None
    out = set()
    for i, a, b, t in first.values():
        key = (norm(a), b)
        if key == (None, None) or (None in key and match == "simple"):
            continue
        if None in key and match == "full":
            out.add((i, "missing"))
            continue
        hit = [x for x in targets if all(k is None or (y := norm(z) if isinstance(z, str) else z) == k and y is not None for k, z in zip(key, x[:2]))]
        hit = [x for x in hit if all(k is None or z is not None for k, z in zip(key, x[:2]))]
        if not hit:
            out.add((i, "missing"))
        elif all(x[3] for x in hit):
            out.add((i, "deleted"))
        elif min(x[2] for x in hit if not x[3]) > t:
            out.add((i, "late"))
    return out


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_composite_keys_with_nulls(spark, match):
    rnd = random.Random(7)
    names = ["A", " a", "b ", "B", "c", None, ""]
    refs = [(i, rnd.choice(names), rnd.choice([1, 2, 3, None]), rnd.randrange(20)) for i in range(80)]
    refs += [(i, a, b, t + 5) for i, a, b, t in refs[:20]]
    targets = [(rnd.choice(names), rnd.choice([1, 2, None]), rnd.randrange(20), rnd.choice([None, None, 1])) for _ in range(12)]
    r = spark.createDataFrame(refs, "id long, name string, n int, seen int")
    t = spark.createDataFrame(targets, "vid string, m int, born int, gone int")
    got = {(x.row_id, x.orphan_kind) for x in orphan_references(r, t, {"name": "vid", "n": "m"}, "id", "seen", "born", "gone", match).collect()}
    assert got == brute(refs, targets, match)


def test_hot_key_empty_tables_and_clashing_columns(spark):
    refs = spark.createDataFrame([(i, "x", i, "salt") for i in range(300)], "id long, k string, loaded int, salt string")
    none = spark.createDataFrame([], "k string, arrived int, deleted int, salt string")
    got = orphan_references(refs, none, {"k": "k"}, "id", "loaded", "arrived", "deleted")
    assert got.count() == 300 and {r.orphan_kind for r in got.collect()} == {"missing"}
    late = spark.createDataFrame([("X ", 100, None, "")], "k string, arrived int, deleted int, salt string")
    assert orphan_references(refs, late, {"k": "k"}, "id", "loaded", "arrived", "deleted").count() == 100
    assert orphan_references(refs.limit(0), late, {"k": "k"}, "id", "loaded", "arrived", "deleted").count() == 0


def test_report_by_month(spark):
    o = spark.createDataFrame([(1, "late", "2026-01-03"), (2, "late", "2026-01-09"), (3, "missing", None)], "row_id long, orphan_kind string, loaded string").selectExpr("row_id", "orphan_kind", "cast(loaded as timestamp) loaded")
    assert {tuple(r) for r in orphan_report(o, "t").collect()} == {("t", "late", "2026-01", 2), ("t", "missing", None, 1)}


def test_rows_without_an_id_each_count(spark):
    from framewright.operators.orphans import orphan_references

    refs = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (None, "y", 2), (1, "x", 1), (1, "x", 2)], "id long, k string, t int")
    targets = spark.createDataFrame([("y", 0)], "k string, t int")
    got = [(r.row_id, r.orphan_kind) for r in orphan_references(refs, targets, {"k": "k"}, "id", "t", "t").collect()]
    assert sorted(got, key=str) == [(1, "missing"), (None, "missing"), (None, "missing")]
