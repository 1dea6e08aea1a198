import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import knn as K

D = 16


def clusters(n, seed=0, size=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // size + 1, D))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), size, axis=0)[:n] + 0.09 * rng.standard_normal((n, D))
    return x.astype(np.float32)


def table(spark, ids, x):
    rows = [(int(i), None if v is None else [None if y is None else float(y) for y in v], "x", 1) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "point_id long, vector array<float>, vec string, cell int")


def brute(ids, x, k=5):
    ids, x = np.array(ids), np.array(x, float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(ids)):
        others = [j for j in range(len(ids)) if ids[j] != ids[i]]
        for j in sorted(others, key=lambda j: (-s[i, j], ids[j]))[:k]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return {(int(a), int(b)) for a, b in out}


def pairs(df):
    return {tuple(r) for r in K.neighbour_pairs(df, 5, D).collect()}


def test_recall_over_many_cells(spark):
    x = clusters(1500)
    ids = np.random.default_rng(1).permutation(10_000)[:1500]
    got, want = pairs(table(spark, ids, x).repartition(6)), brute(ids, x)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_few_points_are_exact_with_ties_and_dirt(spark):
    x = [list(v) for v in clusters(40, 3)]
    ids = list(range(100, 140))
    x[3], x[5] = x[1], [2 * y for y in x[1]]  # equal and scaled: ties go to smaller ids
    dirty = [(200, None), (201, [1.0] * 3), (202, [float("nan")] + [1.0] * (D - 1)), (203, [0.0] * D), (204, [None] + [1.0] * (D - 1)), (205, [float("inf")] * D), (100, x[0]), (107, x[7])]
    df = table(spark, ids + [i for i, _ in dirty], x + [v for _, v in dirty]).unionByName(spark.createDataFrame([(None, [1.0] * D, "", 1)], "point_id long, vector array<float>, vec string, cell int"))
    assert pairs(df) == brute(ids, x)


def test_a_third_are_copies(spark):
    x = clusters(240, 5)
    x[:80] = x[0]
    ids = np.random.default_rng(2).permutation(1000)[:240]
    got, want = pairs(table(spark, ids, x).repartition(3)), brute(ids, x)
    hot = set(ids[:80].tolist())
    assert {p for p in got if p[0] in hot and p[1] in hot} == {p for p in want if p[0] in hot and p[1] in hot}
    assert len(got & want) >= 0.97 * len(want)


def test_empty_and_tiny(spark):
    assert pairs(table(spark, [], [])) == set()
    assert pairs(table(spark, [1], [[1.0] * D])) == set()
    assert pairs(table(spark, [1, 2], [[1.0] * D, [2.0] * D])) == {(1, 2)}
    assert pairs(table(spark, [1, 1], [[1.0] * D, [2.0] * D])) == set()


def recall(x, r, c, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    got = set(zip(r.tolist(), c.tolist()))
    return np.mean([(i, j) in got for i in range(len(x)) for j in best[i].tolist()])


def test_descent_within_a_region_makes_the_lists(monkeypatch):
    x = clusters(2000, 6, 20)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(K, "STARTS", 2)
    start, end = (recall(x, *K._descended(x, np.arange(2000), 1, rounds)) for rounds in (0, 30))
    assert end > 0.97 and end - start > 0.05


def test_rounds_across_regions_mend_the_borders(spark, monkeypatch):
    x = clusters(900, 8)
    df = table(spark, range(900), x)
    want = brute(range(900), x)
    monkeypatch.setattr(K, "BORDER", 0.02)
    got = []
    for rounds in (0, 30):
        g = K.with_copies(K.neighbour_graph(df, 5, D, rounds, 60), df, 5, D)
        got.append(len({(min(r.point_id, r.id), max(r.point_id, r.id)) for r in g.collect()} & want) / len(want))
    assert got[1] > got[0] and got[1] >= 0.95


def test_graph_search(spark):
    x = clusters(1200, 9)
    df = table(spark, range(1200), x)
    q = df.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    rows = K.graph_search(df, q, 5, D).collect()
    for i in range(0, 1200, 20):
        s = u @ u[i]
        s[i] = -2
        hit += len({r.point_id for r in rows if r.query_id == i} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 300 and all(r.query_id != r.point_id for r in rows)
    assert K.graph_search(df, q.limit(0), 5, D).count() == 0


@pytest.mark.parametrize(("n", "rows"), [(800, 900), (800, 100), (800_000, 100)])
def test_cells_keep_their_size_at_any_number_of_rows(n, rows):
    x = clusters(800, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = K.Cells(x, n, rows)
    home, other = c.assign(x)
    assert ((other == -1) | (other != home)).all() and max(home.max(), other.max()) < c.size and c.size >= n / rows / 2
    if not c.bits.any():
        assert (home == c.first[np.argmax(x @ c.fine.T, axis=1)]).mean() > 0.9
    largest = np.bincount(home).max() * n / 800
    assert largest <= max(8 * rows, n / 800 * 30)


def test_sample_is_never_empty(spark):
    df = table(spark, range(50), clusters(50))
    assert len(K._sample(df.select("point_id", "vector"), 10**13, D)) >= 1


def test_the_graph_is_a_coarse_cut_for_search(spark):
    from framewright.operators.search import exact_topk, two_tier

    x = clusters(600, 11)
    df = table(spark, range(600), x).select("point_id", "vector")
    want = {r.point_id for r in exact_topk(df, x[7], 10).collect()}
    got = [r.point_id for r in two_tier(df, x[7], 10, 40, K.graph_coarse(df, D)).orderBy("rank").collect()]
    assert len(want & set(got)) >= 9 and got[0] == 7
