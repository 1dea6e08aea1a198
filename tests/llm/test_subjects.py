import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import subjects as S


@pytest.fixture(scope="module")
def fitted(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    examples = t("subject_examples")
    return S.fit_tables(t("domains"), examples.where("example_id % 5 <> 0"), t("domain_segments"), t("documents")), examples.where("example_id % 5 = 0").collect()


def test_held_out_examples(fitted):
    """Single-subject texts the models never saw; some labels are wrong and some terms come only once."""
    model, held = fitted
    hits = [r.domain_id in model.label(r.text, None) for r in held]
    vi = [h for h, r in zip(hits, held) if r.lang == "vi"]
    assert np.mean(hits) > 0.5 and np.mean(vi) > 0.5  # of thirteen subjects, from some sixty segments


def test_composed_documents(fitted):
    """A fifth of the sentences is enough, less is not."""
    model, held = fitted
    sure = {}
    for r in held:
        p = model.pieces(S.plain(r.text))
        if r.domain_id in model.label(r.text, None) and len(p) == 1:
            sure.setdefault(r.domain_id, []).append(" ".join(p[0]))
    a, b = sorted(sure, key=lambda k: -len(sure[k]))[:2]
    two = ". ".join(([sure[a][i % len(sure[a])] for i in range(6)]) + ([sure[b][i % len(sure[b])] for i in range(4)])) + "."
    one = ". ".join([sure[a][i % len(sure[a])] for i in range(11)] + sure[b][:1]) + "."
    assert set(model.label(two, None)) == {a, b} and model.label(one, None) == [a]


def test_texts_without_words(spark, fitted):
    model, _ = fitted
    assert [model.label(t, None) for t in (None, "", " \n", "…!?")] == [[], [], [], []]
    text = next(r.text for r in fitted[1] if r.domain_id in model.label(r.text, None))
    df = spark.createDataFrame([(1, text, "s", "x"), (2, None, None, "x"), (2**60 + 1, text, None, "x"), (None, text, None, "x"), (1, text, "s", "x"), (5, text * 300, "s", "x")], "doc_id long, text string, source string, domain_id string")
    got = S.document_subjects(df.drop("domain_id"), model)
    assert {r.doc_id for r in got.collect()} == {1, 2**60 + 1, None, 5} and got.where("doc_id = 1").count() == got.where("doc_id = 1").distinct().count()
    assert S.document_subjects(df.limit(0).drop("domain_id"), model).count() == 0
    comp = S.subject_composition(got.where("doc_id is not null"), df)
    assert comp.where("share_of_documents > 1").count() == 0


def test_garbled_texts_keep_their_subjects(fitted):
    model, held = fitted
    same = [(model.label(r.text, None), model.label(r.text.encode().decode("latin-1"), None)) for r in held if r.lang == "vi"]
    assert np.mean([a == b for a, b in same]) > 0.9


def test_beam_search_equals_all_combinations():
    m, n = S.SubjectModel(), 4
    rng = np.random.default_rng(0)
    m.order, x = [2, 0, 3, 1], rng.standard_normal((n, 3))
    m.chain = [np.r_[rng.standard_normal(3), rng.standard_normal(n)] for _ in range(n)]

    def score(y):
        total = 0.0
        for step, j in enumerate(m.order):
            z = x[j] @ m.chain[j][:3] + sum(m.chain[j][3 + k] * y[m.order[k]] for k in range(step))
            total += -np.log1p(np.exp(-z if y[j] else z))
        return total

    best = max(range(2**n), key=lambda c: score([c >> j & 1 for j in range(n)]))
    assert sorted(m.decode(x)) == [j for j in range(n) if best >> j & 1]


def test_fits_without_any_rows():
    m = S.fit(["a", "b"], [], [], [])
    assert m.label("some words here", None) in ([], ["a"], ["b"], ["a", "b"])


def test_no_live_subjects(spark):
    none = spark.createDataFrame([], "domain_id string, deleted_at timestamp")
    ex = spark.createDataFrame([(1, "t", "en", "d")], "example_id long, text string, lang string, domain_id string")
    seg = spark.createDataFrame([], "analysis_id string, segment_idx int, domain_id string, summary string, keywords array<string>")
    docs = spark.createDataFrame([(1, "one two.", "s")], "doc_id long, text string, source string")
    assert S.document_subjects(docs, S.fit_tables(none, ex, seg, docs)).select(F.col("doc_id")).count() == 0


def test_corpus_is_counted_whole(spark, data, monkeypatch):
    """However few documents are drawn, greetings, source rates and fillers come from all of them."""
    monkeypatch.setattr(S, "MAX_MARKED", 10)
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    greeting = "welcome back to this channel dear friends."
    more = spark.createDataFrame([(10**6 + i, f"{greeting} number {i} is a text.", f"source{i}") for i in range(8)], "doc_id long, text string, source string")
    more = more.union(spark.createDataFrame([(10**7 + i, f"zzfiller and then number {i} zzfiller goes on without marks", "s") for i in range(60)], more.schema))
    documents = t("documents").select("doc_id", "text", "source").union(more)
    model = S.fit_tables(t("domains"), t("subject_examples"), t("domain_segments"), documents)
    texts = [(S.plain(r.text), r.source) for r in documents.collect() if r.text and r.text.strip()]
    kept = [(p, x, s) for x, s in texts if (p := S.sentences(x))]
    assert set(model.source_rate) == {s or "" for _, _, s in kept}
    times = {}
    for p, x, _ in kept:
        for ws in {" ".join(ws) for ws in p} if S._MARKED.search(x) else ():
            times[ws] = times.get(ws, 0) + 1
    assert model.greetings == {w for w, k in times.items() if k >= max(S.GREETING_TIMES, S.GREETING_SHARE * len(kept))} and greeting[:-1] in model.greetings
    assert "zzfiller" in model.fillers and "number" not in model.fillers


def test_scores_equal_the_plain_sums():
    rows = [["a", "b", "c"], ["b", "c", "a"], ["d", "a"], ["c", "c"]]
    fitted = S.Logistic.fit(map(S.terms, rows), [0, 1, 2, 1], [1.0] * 4, 3, lambda t: 1.0 if " " in t else 0.5)
    asked = [["a", "b", "x", "c", "a"], [], ["x"], ["c", "c", "c"], ["b"], ["c"]]
    want = []
    for ws in asked:
        ids = [fitted.index[t] for t in S.terms(ws) if t in fitted.index]
        v = fitted.value[ids]
        want.append((v[:, None] * fitted.weights[ids]).sum(axis=0) / np.sqrt((v * v).sum()) if ids else np.zeros(3))
    assert S.TermModel(fitted, 3).scores(asked) == pytest.approx(np.array(want), abs=1e-5)


def test_terms_that_stand_alone_are_fitted_as_rows_of_their_own(monkeypatch):
    monkeypatch.setattr(S, "ALONE", 2)
    rows, labels, each = [["a", "b", "c"], ["b", "c", "a"], ["d", "a"]], [0, 1, 2], 0.25
    names, counts = ["x", "x y", "z", "common", "q"], np.array([[3, 0, 1], [0, 2, 0], [5, 4, 2], [9, 0, 0], [0, 0, 4]])
    value = lambda t: 0.0 if t == "common" else 0.5 if " " in t else 1.0
    term, label = np.nonzero(counts)
    plain = S.Logistic.fit([*map(S.terms, rows), *([names[i]] for i in term)], labels + label.tolist(), [1.0] * 3 + (each * counts[term, label]).tolist(), 3, value)
    got = S.Logistic.fit(map(S.terms, rows), labels, [1.0] * 3, 3, value, alone=(names, np.float32(each) * counts))
    assert set(got.index) == set(plain.index)
    for t in plain.index:
        assert got.value[got.index[t]] == plain.value[plain.index[t]] and got.weights[got.index[t]] == pytest.approx(plain.weights[plain.index[t]], abs=1e-5)


def test_batches_change_no_score(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [[f"w{i}" for i in rng.integers(0, 30, n)] for n in (3, 0, 40, 1, 7, 16, 0)]
    fitted = S.Logistic.fit(map(S.terms, pieces), [0, 1, 2, 0, 1, 2, 0], [1.0] * 7, 3)
    gaps = S._fit_gaps([[ws for ws in pieces if ws]])
    long = [ws for ws in pieces if ws]
    whole = S.TermModel(fitted, 3).scores(pieces), gaps.margins(long)
    monkeypatch.setattr(S, "BATCH", 8)
    assert len(list(S._batches(pieces))) > 3
    assert (S.TermModel(fitted, 3).scores(pieces) == whole[0]).all() and (gaps.margins(long) == whole[1]).all()
    assert S.TermModel(fitted, 3).scores([]).shape == (0, 3)


def test_the_driver_holds_no_row_for_each_subject_of_a_taught_term(spark, monkeypatch):
    """Many terms, each taught for all subjects: what the fit takes on the driver follows the terms, and none is left out."""
    subjects, many = [f"s{j}" for j in range(13)], 20_000
    every = spark.range(many * 13).selectExpr(f"concat('term', id % {many}) as term", f"cast(id div {many} as int) as label", f"id div {many} + 1 as n")
    monkeypatch.setattr(S, "taught_terms", lambda texts, model, known: every)
    learned, fit = [], S.Logistic.fit

    def counted(*a, **k):
        fitted = fit(*a, **k)
        learned.append(sum(str(t).startswith("term") for t in fitted.index))
        return fitted

    monkeypatch.setattr(S.Logistic, "fit", counted)
    examples = [(f"alpha{j} beta{j} gamma{i}.", "en", j) for j in range(13) for i in range(5)]
    documents = spark.createDataFrame([(i, f"alpha{i} beta{i}. gamma{i} one two.", "s") for i in range(13)], "doc_id long, text string, source string")
    monkeypatch.setattr(S, "COMPOSED", 100)
    tracemalloc.start()
    S.fit(subjects, examples, [], documents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert learned.count(many) == 2
    assert peak < 60e6  # 260,000 rows of a term, a subject and a number took more
    monkeypatch.setattr(S, "MAX_TERMS", 7)
    more = every.union(spark.createDataFrame([("often", 3, 500), ("once", 0, 1)], every.schema))
    names, counts = S._commonest(more, 13)
    assert len(names) == 7 and names == sorted(names) and "often" in names and "once" not in names
    assert counts[names.index("often")].tolist() == [0] * 3 + [500] + [0] * 9 and counts[names.index("term0")].tolist() == list(range(1, 14))
    names, counts = S._commonest(every.limit(0), 13)
    assert names == [] and counts.shape == (0, 13)


def test_gaps_are_found_for_many_texts_at_once():
    rng = np.random.default_rng(0)
    sentence = lambda: ["then", *[f"w{i}" for i in rng.integers(0, 40, 8)], "end"]
    model = S.SubjectModel()
    model.gaps = S._fit_gaps([[sentence() for _ in range(4)] for _ in range(80)])
    texts = [[sentence() for _ in range(3)] for _ in range(20)]
    got = model.cut([[[w for s in text for w in s]] for text in texts])
    assert np.mean([g == t for g, t in zip(got, texts)]) > 0.9


def test_the_chain_uses_the_decisions_before():
    """Two subjects that are never together: the weaker one is dropped where the first is taken."""
    rng = np.random.default_rng(2)
    model = S.SubjectModel()
    model.subjects, model.order = ["a", "b"], [0, 1]
    first = rng.random(3000) < 0.5
    x = np.ones((3000, 2, 2))
    x[:, 0, 1], x[:, 1, 1] = np.where(first, 3, -3), rng.standard_normal(3000) + 1
    y = np.stack([first, ~first], axis=1).astype(float)
    model.chain = S.fit_chain(model, x, y)
    assert (model.decode_many(x) == y).mean() > 0.99
