import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import expr as X
from framewright.functions import models as M
from framewright.operators import jobs as J
from framewright.plans.catalog import Catalog
from framewright.sources.snapshot import SnapshotError


def test_encoders_and_finders(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.v for r in df.select("id", M.encode(F.col("text"), factory, 1).alias("v")).collect()}
    assert got[2] is None and got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[3] == [0.0, 1.0]

    def shots():
        return lambda t: [(i, i + 1) for i in range(len(t))]

    found = M.expand(df, "id", shots, "start long, stop long", "text").collect()
    assert {tuple(r) for r in found} == {(1, 0, 1), (1, 1, 2), (1, 2, 3)}


def test_asking_again():
    heard = []

    def provider(q, said):
        heard.append(said)
        return len(heard)

    def validate(x):
        if x < 3:
            raise ValueError(f"bad {x}")
        return x

    assert M.ask_until_valid(provider, validate, "q") == 3 and heard == [None, "bad 1", "bad 2"]
    heard.clear()
    with pytest.raises(ValueError):
        M.ask_until_valid(provider, validate, "q", retries=1)
    assert M.valid_tags([3, "1", "x", 3, 9, None, 2], [1, 2, 3]) == [3, 1, 2] and M.valid_tags([1, 2, 3], [1, 2, 3], 2) == [1, 2]


def test_jobs(spark):
    s = spark.createDataFrame([("a", "v1", "c", "f"), ("b", "w1", "c", "f")], "source_id string, analysis_id string, content_hash string, fingerprint string")
    again = s.where("source_id = 'a'").withColumn("analysis_id", F.lit("v2"))
    log = J.begin(s, "2026-01-01").unionByName(J.promote(s, "2026-01-01")).unionByName(J.begin(again, "2026-01-02")).unionByName(J.fail(again, "2026-01-03", "boom"))
    got = {r.source_id: r for r in J.jobs(log).collect()}
    assert got["a"].active.analysis_id == "v1" and got["a"].last_status == "failed" and got["a"].last_error == "boom" and got["a"].attempts == 2
    assert got["b"].active.analysis_id == "w1" and got["b"].last_status == "completed" and J.exit_code(log) == 1
    assert J.jobs(log.limit(0)).count() == 0


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = [(i, [1.0, 0.0], i == 1) for i in range(3)]
    p = spark.createDataFrame(rows, "point_id long, vector array<float>, deleted boolean")
    assert c.add("k", p, encoder="e", dim=2) == 1 and c.collections() == ["k"]
    with pytest.raises(SnapshotError):
        c.set_alias("x", "none")
    c.set_alias("live", "k")
    assert c.open("live").points.count() == 3 and c.optimize("k") == 2 and c.open("live").points.count() == 2 and c.open("k", 1).points.count() == 3
    c.drop("k", keep=1)
    assert c.versions("k") == [2]
    with pytest.raises(SnapshotError):
        c.open("k", 1)
    c.drop("k")
    assert c.versions("k") == []


def test_addresses_and_answers(spark):
    val = lambda e: spark.range(1).select(e.alias("x")).first().x
    s = F.lit
    assert val(X.object_url(s("http://h/"), s("/a"), s("b/"))) == "http://h/a/b" and val(X.file_name(s(12), 6, ".webp")) == "000012.webp"
    assert val(X.frame_seconds(s(50), s(29.97))) == 1.668 and val(X.frame_seconds(s(1), s(0.0))) is None
    assert val(X.even_width(s(1920), s(1080), s(360))) == 640 and val(X.even_width(s(5), s(2), s(2))) == 4
    r = val(X.parse_answer(s("TR-L26_V001-10,20")))
    assert (r.kind, r.video, r.ms) == ("trake", "L26_V001", [10, 20])
    r = val(X.parse_answer(s("QA-a-b-L26_V001-10")))
    assert (r.kind, r.video, r.answer, r.ms) == ("qa", "L26_V001", "a-b", [10]) and val(X.parse_answer(s("x"))).kind is None
    df = spark.createDataFrame([("v", 7), (None, 1), ("v", None)], "n string, f long")
    want = int.from_bytes(hashlib.blake2b(b"v:7", digest_size=8).digest(), "big") & (2**63 - 1)
    assert [r.x for r in df.select(X.blake2_point_id("n", "f").alias("x")).collect()] == [want, None, None]
