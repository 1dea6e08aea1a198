import json
from collections import Counter

import pytest

from framewright.operators import drift as D

FIELDS = {"vector": "series", "dim": "number", "payload.shot_id": "number"}
COLUMNS = "shard_id long, stream_key string, written_at timestamp, line_no int, received_at timestamp, raw_json string, n int, kind string"


def record(i, **k):
    return json.dumps({"point_id": i, "video_name": "v", "frame": i, "payload": {"keyframe_time": 0.5, "shot_len": 7, **k.pop("payload", {})}, **k})


def table(spark, shards):
    rows = []
    for s, (stream, lines) in enumerate(shards):
        rows += [(s, stream, f"2026-01-0{s + 1}", i, "2026-02-01", x, 0, "") for i, x in enumerate(lines)]
        rows += [(s, stream, f"2026-01-0{s + 1}", i, "2026-02-03", x, 0, "") for i, x in enumerate(lines[:1])]
    df = spark.createDataFrame(rows, COLUMNS.replace("timestamp", "string")) if rows else spark.createDataFrame([], COLUMNS)
    return df.withColumn("written_at", df.written_at.cast("timestamp")).withColumn("received_at", df.received_at.cast("timestamp"))


SHARDS = [
    ("s", [record(i, vector=[0.5, 0.25, i / 3], dim=3, payload={"shot_id": i}) for i in range(6)]),
    ("s", [record(i, embedding=[0.5, 0.25, i / 3], dim="3", payload={"shot_id": i}) for i in range(6)]),
    ("t", [record(i, vector=[0.5, 0.1, 0.2], dim=3, payload={"shot_id": i}) for i in range(4)]),
    ("s", [record(i, embedding=[1, 2, 3], meta={"dim": 3}) for i in range(5)] + ["{broken", None, "[]", '{"dim": NaN}']),
    ("s", ["{broken", None]),
    ("s", [record(i, feat="0.5,0.25,0.1", n_dim=3.0, shotId=i) for i in range(5)] + [record(9, feat=None)]),
]


def test_changes(spark):
    got = {tuple(r) for r in D.schema_changes(table(spark, SHARDS), FIELDS).collect()}
    assert got == {
        (1, "vector", "renamed"), (1, "dim", "type"),
        (3, "vector", "type"), (3, "dim", "renamed"), (3, "dim", "type"), (3, "payload.shot_id", "removed"),
        (4, "vector", "removed"), (4, "dim", "removed"),
        (5, "vector", "added"), (5, "dim", "added"), (5, "payload.shot_id", "added"),
    }


def test_records_come_out_alike(spark):
    rows = D.consistent_records(table(spark, SHARDS), FIELDS).collect()
    assert len(rows) == sum(len(x) for _, x in SHARDS)
    by = {(r.shard_id, r.line_no): r for r in rows}
    assert by[0, 2].vector == pytest.approx([0.5, 0.25, 2 / 3]) and by[5, 1].vector == [0.5, 0.25, 0.1] and by[3, 0].vector == [1, 2, 3]
    assert by[1, 0].dim == by[5, 0].dim == 3 and by[5, 3].shot_id == 3 and by[3, 0].shot_id is None
    assert not by[4, 0].valid and not by[4, 1].valid and by[0, 0].valid and not by[3, 8].valid


def test_odd_names_and_empty_objects(spark):
    odd = [("s", ['{}', '{"a\\tb": 1, "c\\nd": {"e": null}, "": 2}', record(1, vector=[1.5, 2.5], dim=2, payload={"shot_id": 4})]), ("s", ["{}"])]
    got = {tuple(r) for r in D.schema_changes(table(spark, odd), FIELDS).collect()}
    assert got == {(1, f, "removed") for f in FIELDS}
    assert D.consistent_records(table(spark, odd), FIELDS).where("valid").count() == 4


def test_empty_table(spark):
    assert D.schema_changes(table(spark, []), FIELDS).count() == 0
    assert D.consistent_records(table(spark, []), FIELDS).count() == 0


def test_kinds_and_shapes():
    k = lambda s: D.kind_of(json.loads(s))
    assert [k(x) for x in ("1", "1.0", "1e2", '"1"', "true", "[1, 2]", "[1, 2.5]", '["1"]', "[]", "[null, 1]")] == ["integer", "decimal", "decimal", "string", "boolean", "array<integer>", "array<decimal>", "array<string>", "array<none>", "array<integer>"]
    assert D.shape_of("1,2, 3", 0) == D.shape_of([1], 0) == "series" and D.shape_of("3", 3) == "length" and D.shape_of("x1", 0) == "text" and D.shape_of(True, 0) == "flag"
    assert D.parse_record('{"a": Infinity}') is None and D.parse_record("[" * 5000) is None


def test_decoys_are_no_fields():
    layouts = Counter()
    for name in ("vector", "emb", "vector.values"):
        layouts[f"dim\tinteger\tlength\ndim_reduced\tboolean\tflag\nvector_norm\tdecimal\tnumber\npayload.shot_score\tdecimal\tnumber\npayload.shot_id\tinteger\tnumber\n{name}\tarray<decimal>\tseries"] += 20
    got = D.correspondences(list(layouts.items()), FIELDS)
    assert got == {"vector": "vector", "dim": "dim", "payload.shot_id": "payload.shot_id", "emb": "vector", "vector.values": "vector"}


def test_too_many_paths_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_PATHS", 2)
    counts = spark.createDataFrame([("a\tinteger\tnumber\nb\tinteger\tnumber\nc\tinteger\tnumber", 1)], "layout string, n long")
    with pytest.raises(ValueError):
        D.match_fields(counts, FIELDS)


def test_counts_in_spark_match_as_those_of_whole_layouts(spark):
    layouts = [("dim\tinteger\tlength\nvector\tarray<decimal>\tseries", 9), ("embedding\tarray<decimal>\tseries\nn_dim\tinteger\tlength\npayload.shot_id\tinteger\tnumber", 4), ("dim\tstring\tlength\npayload.shot\tinteger\tnumber\nvec\tstring\tseries\nx\tstring\ttext", 5), ("", 2)]
    counts = spark.createDataFrame([(x, n) for x, n in layouts for _ in range(2)] + [(None, 3)], "layout string, n long")
    assert D.match_fields(counts, FIELDS) == D.correspondences([(x, 2 * n) for x, n in layouts], FIELDS)


def test_against_fixed_names(spark, data):
    """The whole report on real records, with the names told instead of found."""
    records = spark.read.parquet(f"{data}/shard_records.parquet")
    names = {"vector": {"vector", "embedding", "payload.vector", "feat", "vector.values", "vec", "emb"}, "dim": {"dim", "meta.dim", "n_dim", "payload.dim", "dimension", "vector_dim"}, "payload.shot_id": {"payload.shot_id", "payload.shot.id", "shot_id", "payload.shot", "payload.shot_no", "shotId", "payload.shotId"}}
    seen, shards = set(), {}
    for r in records.orderBy("received_at").collect():
        shards.setdefault((r.written_at, r.shard_id, r.stream_key), [])
        if (r.shard_id, r.line_no) not in seen:
            seen.add((r.shard_id, r.line_no))
            shards[r.written_at, r.shard_id, r.stream_key].append(D.layout_of(r.raw_json))
    want, before = set(), {}
    for _, shard, stream in sorted(shards):
        for f, alias in names.items():
            lines = [x.split("\t") for lo in shards[_, shard, stream] for x in (lo or "").split("\n") if x.split("\t")[0] in alias]
            most = lambda i: min((c := Counter(x[i] for x in lines)), key=lambda k: (-c[k], k))  # noqa: E731, B023
            now = (most(0), most(1)) if lines else None
            if (stream, f) in before:
                b = before[stream, f]
                want |= {(shard, f, k) for k, yes in (("added", now and not b), ("removed", b and not now), ("renamed", b and now and b[0] != now[0]), ("type", b and now and b[1] != now[1])) if yes}
            before[stream, f] = now
    assert {tuple(r) for r in D.schema_changes(records, FIELDS).collect()} == want


def test_no_value_is_lost(spark):
    """Every non-null leaf is in a column or in ``other``; fields come from the argument, not from literals."""
    lines = [record(1, vector=[0.5, 0.25], dim=2, tier="a", payload={"shot_id": 3, "has_ocr": True}), record(2, vector=["x", 1], dim=2.5, frame="?", extra=[{"k": 1}], payload={"shot_id": "s0007"}), "{broken"]
    asked = {**FIELDS, "tier": "text", "payload.has_ocr": "flag"}
    rows = {r.line_no: r for r in D.consistent_records(table(spark, [("s", lines)]), asked).collect()}
    assert rows[0].tier == "a" and rows[0].has_ocr is True and rows[0].raw_json is None
    assert rows[0].other == {"payload.keyframe_time": "0.5", "payload.shot_len": "7"}
    assert rows[1].shot_id == 7 and rows[1].other == {"payload.keyframe_time": "0.5", "payload.shot_len": "7", "vector": '["x", 1]', "dim": "2.5", "frame": '"?"', "extra": '[{"k": 1}]'}
    assert not rows[2].valid and rows[2].raw_json == "{broken" and rows[2].other == {}
    assert D.consistent_records(table(spark, [("s", lines)]), FIELDS).where("other['tier'] = '\"a\"'").count() == 1


def test_real_records_keep_every_path(spark, data):
    records = spark.read.parquet(f"{data}/shard_records.parquet")
    got = D.consistent_records(records, FIELDS)
    for path in ("payload.keyframe_time", "payload.scene_idx", "tier", "group", "vector_norm"):
        first = {(r.shard_id, r.line_no): r.raw_json for r in records.orderBy(records.received_at.desc()).collect()}
        want = sum(path in dict(D.leaves(D.parse_record(x) or {})) for x in first.values())
        assert want == got.where(got.other[path].isNotNull()).count()


def test_null_keys_lose_no_record(spark):
    """No line_no, no received_at, no written_at: the records and the changes are still there."""
    lines = [record(i, vector=[0.5, 0.25], dim=2, payload={"shot_id": i}) for i in range(4)]
    rows = [(0, "s", None, None, None, x, 0, "") for x in (*lines, lines[0])]
    rows += [(1, "s", None, i, None, record(i, embedding=[0.5, 0.25], dim=2, payload={"shot_id": i}), 0, "") for i in range(4)]
    rows += [(2, "s", "2026-01-02", i, "2026-02-01", record(i, vector=[0.5, 0.25], dim=2, payload={"shot_id": i}), 0, "") for i in range(4)]
    df = spark.createDataFrame(rows, COLUMNS.replace("timestamp", "string"))
    df = df.withColumn("written_at", df.written_at.cast("timestamp")).withColumn("received_at", df.received_at.cast("timestamp"))
    got = D.consistent_records(df, FIELDS).collect()
    assert sorted((r.shard_id, r.shot_id) for r in got) == [(s, i) for s in range(3) for i in range(4)] and all(r.valid for r in got)
    assert {tuple(r) for r in D.schema_changes(df, FIELDS).collect()} == {(1, "vector", "renamed"), (2, "vector", "renamed")}
    counts = D.shard_layouts(df).where("shard_id = 0").groupBy().sum("n").first()[0]
    assert counts == 4
