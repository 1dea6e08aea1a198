import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm.bpe import TOKENIZERS, VOCABULARY, encoder, token_count, token_ids

PATH = f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(plain, s):
    assert encoder(PATH).encode(s) == plain(s)


def test_long_runs_and_ambiguous_merges(plain):
    rnd = random.Random(2)
    texts = ["a" * 50_000, " " * 50_000, "\n" * 999, "<|endoftext|>", "=-" * 4000, "ß" * 2000, "aaaa" * 7, "́" * 40]
    texts += ["".join(rnd.choice("aeinrst") for _ in range(rnd.randrange(1, 200))) for _ in range(2000)]
    for s in texts:
        assert encoder(PATH).encode(s) == plain(s)


def test_columns(spark, plain):
    df = spark.createDataFrame([(1, "Xin chào, thế giới 42!", "x"), (2, "", "x"), (3, None, "x"), (None, "  ", "x"), (1, "Xin chào, thế giới 42!", "x")], "doc_id long, text string, ids string")
    got = df.select("doc_id", "text", token_ids(F.col("text")).alias("i"), token_count(F.col("text")).alias("n")).collect()
    for r in got:
        assert list(r.i) == (plain(r.text) if r.text else []) and r.n == len(r.i)
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0
