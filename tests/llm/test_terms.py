import random
import unicodedata
from collections import Counter

from framewright.llm.terms import term_counts, term_form

SCHEMA = "id long, part int, keywords array<string>, loaded int, term string, records string"


def brute(rows, rare=3, common=0.05):
    first = {}
    for i, p, k, t, *_ in rows:
        if (i, p) not in first or t < first[i, p][1]:
            first[i, p] = (k, t)
    occ, rec = Counter(), Counter()
    for k, _ in first.values():
        words = [w for w in (term_form(x) for x in k or []) if w]
        occ.update(words)
        rec.update(set(words))
    return {(w, occ[w], rec[w], "rare" if rec[w] < rare else "common" if rec[w] > common * len(first) else None) for w in occ}


def test_counts(spark):
    rnd = random.Random(4)
    pool = ["Tin tức", "tin  tức ", unicodedata.normalize("NFD", "TIN TỨC"), " video", "VIDEO", "", " ", None, *[f"w{i}" for i in range(60)]]
    rows = [(i, rnd.randrange(2), rnd.choice([None, [], [rnd.choice(pool) for _ in range(rnd.randrange(1, 6))]]) if rnd.random() < 0.9 else ["hot", "hot"], 1, "x", "y") for i in range(400)]
    rows += [(i, p, ["late"], 2, "", "") for i, p, *_ in rows[:50]] + [(None, None, ["nokey"], 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = term_counts({"a": (df, ["id", "part"], "keywords", "loaded"), "b": (df.limit(0), ["id"], "keywords", "loaded")}).collect()
    assert {(r.term, r.occurrences, r.records, r.term_mark) for r in got} == brute(rows) and {r.table_name for r in got} == {"a"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert term_counts({"a": (df, ["id"], "keywords", "loaded")}).count() == 0


def test_forms():
    assert term_form("  Thanh  long\tRUỘT ") == "thanh long ruột" and term_form(None) == term_form(" 　") == ""
    assert term_form(unicodedata.normalize("NFD", "Ế")) == "ế"
