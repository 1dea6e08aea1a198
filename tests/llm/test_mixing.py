from framewright.llm.bpe import TOKENIZERS, VOCABULARY, encoder
from framewright.llm.mixing import draw_mixes

DOCS = "doc_id long, text string, source string, tokens string, upto int"
MIX = "mix_name string, source string, weight double, max_repeats int"


def run(spark, docs, targets, **k):
    drawn, shares = draw_mixes(spark.createDataFrame([(*d, "", 0) for d in docs], DOCS), spark.createDataFrame(targets, MIX), **k)
    return drawn.collect(), {(r.mix_name, r.source): r for r in shares.collect()}


def test_budgets_are_met_to_the_document(spark):
    words = ["one two three", "four", "five six seven eight nine ten", "a b c d"]
    docs = [(i, " ".join(words[(i * 7 + j) % 4] for j in range(i % 5 + 1)), "big" if i % 3 else "hot") for i in range(300)]
    docs += [(1000 + i, "tiny text", "tiny") for i in range(3)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (1, docs[1][1], docs[1][2])]
    targets = [("m", "big", 1.0, 2), ("m", "hot", 2.0, 3), ("m", "tiny", 1.0, 4), ("m", "none", 1.0, 9), ("n", "big", 5.0, None), ("n", "hot", None, 1), ("n", "tiny", float("nan"), 1), (None, "big", 1.0, 1)]
    drawn, shares = run(spark, docs, targets)
    size = {d: len(encoder(f"{TOKENIZERS}/{VOCABULARY}").encode(t)) for d, t, _ in docs if t}
    stock = {s: sum(size[d] for d in {d for d, t, x in docs if x == s and t}) for s in ("big", "hot", "tiny")}
    total = 4 * stock["tiny"] / 0.25  # the share of the source that runs short first
    for (mix, source), r in shares.items():
        took = [x for x in drawn if (x.mix_name, x.source) == (mix, source)]
        assert len({x.doc_id for x in took}) == len(took) == r.docs and all(0 < x.takes <= r.max_repeats and x.tokens == size[x.doc_id] for x in took)
        assert r.tokens == sum(x.tokens * x.takes for x in took) <= r.budget
        if source in stock and r.budget:
            assert r.budget - r.tokens < max(size.values()) and r.available == stock[source]
    m = {s: shares["m", s] for s in ("big", "hot", "tiny", "none")}
    assert m["none"].tokens == 0 and abs(m["none"].target_share - 0.2) < 1e-12
    assert m["big"].budget == total // 4 and m["hot"].budget == total // 2 and m["tiny"].tokens == 4 * stock["tiny"]
    assert (m["tiny"].limit_kind, m["none"].limit_kind, m["big"].limit_kind) == ("sets the size", "absent", None)
    assert all(x.takes == 4 for x in drawn if x.source == "tiny")
    assert abs(sum(r.actual_share for (mix, _), r in shares.items() if mix == "m") - 1) < 1e-9
    assert {x.source for x in drawn if x.mix_name == "n"} == {"big"} and shares["n", "big"].tokens == stock["big"]
    _, whole = run(spark, docs, targets, total_tokens="stock")
    assert whole["m", "tiny"].limit_kind == "short" and whole["m", "hot"].budget == sum(stock.values()) // 2
    again, _ = run(spark, docs[::-1], targets)
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_given_total_and_empty_tables(spark):
    docs = [(i, "word " * 10, "s") for i in range(50)]
    _, shares = run(spark, docs, [("m", "s", 1.0, 1)], total_tokens=100)
    assert 80 < shares["m", "s"].tokens <= 100
    drawn, shares = run(spark, docs[:0], [("m", "s", 1.0, 1)])
    assert not drawn and shares["m", "s"].actual_share == 0
    drawn, shares = run(spark, docs, [])
    assert not drawn and not shares
    drawn, shares = run(spark, docs, [("m", "s", 0.0, 1)])
    assert not drawn and shares["m", "s"].tokens == 0
