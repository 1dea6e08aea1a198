import pytest

from framewright.llm.mojibake import _legacy_bytes, _restore, garbled_documents, garbled_forms, is_clean, repaired_text, restored_documents, undo

CLEAN = "Kế hoạch về lễ hội đua ghe sẽ hoàn thành sau 18 tuần nữa – nhất là ở Rạch Cò. “Thủ môn là chuyện lâu dài”, đại diện nói. D’après la mairie, l’été a été très bref…"
READ = ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "gbk", "iso8859-15", "cp850"]


def broken(text, codec, errors="replace"):
    if codec in ("cp1252", "cp1250"):
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())
    return text.encode().decode(codec, errors)


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, token string, word string")
    return {r.doc_id for r in garbled_documents(df).collect()}, df


def test_every_chain_is_found_and_undone(spark):
    texts = [CLEAN] + [broken(CLEAN, c) for c in READ] + [broken(broken(CLEAN, "cp1252"), "cp1252"), "".join(chr(b) for b in _legacy_bytes("kế hoạch về lễ hội", "tcvn3")), "Sau đó " + broken("kế hoạch về lễ hội", "cp1252") + " nữa là"]
    got, df = found(spark, texts)
    assert got == set(range(1, len(texts)))
    rows = {r.doc_id: r.restored for r in restored_documents(df).collect()}
    for i in (1, 2, 3, 4, 5, len(READ) + 1):
        assert rows[i] == CLEAN, texts[i]
    assert rows[len(texts) - 2] == "kế hoạch về lễ hội" and rows[len(texts) - 1] == "Sau đó kế hoạch về lễ hội nữa là"


def test_decoys_nulls_and_empty(spark):
    import unicodedata

    decoys = [CLEAN, None, "", "   ", "Ærø Ålesby", "«Северный причал» „Žluťoučký kůň“ ΝΗΣΙ ΑΥΓΗ 「港の朝」", "r&eacute;t đậm &ldquo;Khí", unicodedata.normalize("NFD", CLEAN), CLEAN.replace(" ", "\xa0"), "▶ 31 °C № 7 € · ½", CLEAN.upper()]
    assert found(spark, decoys)[0] == set()
    assert found(spark, decoys[:0] + [None])[0] == set()


def test_null_ids_repeats_and_long_texts(spark):
    bad = broken("kế hoạch", "cp1252")
    df = spark.createDataFrame([(None, bad), (2**60 + 1, bad), (2**60 + 1, bad), (3, "kế hoạch " * 20_000), (4, "kế hoạch " * 20_000 + bad)], "doc_id long, text string")
    assert {r.doc_id for r in garbled_documents(df).collect()} == {None, 2**60 + 1, 4}


@pytest.mark.parametrize("word", ["hoạch", "được", "café", "“Tàu", "can’t", "ĐÁNG"])
def test_forms_lead_back(word):
    forms = garbled_forms(word)
    assert forms and all(not is_clean(f) and not f.isascii() for f in forms)
    assert any(undo(f, c) == word for f, c in forms.items())
    assert garbled_forms("plain") == {}


def test_clean_words():
    assert all(is_clean(w) for w in ("và", "Tàu", "ĐÁNG", "l’été", "“Khí", "năm…", "10%", "x-ray", "thủ-môn"))
    assert not any(is_clean(w) for w in ("Ã³", "lÃ", "káº¿", "Ærø", "Ã…lesby", "причал"))


def test_repair_without_a_lexicon():
    assert repaired_text(broken(CLEAN, "cp1252")) == CLEAN and repaired_text("Ærø Ålesby") == "Ærø Ålesby" and repaired_text("") == ""


def test_each_passage_is_undone_by_its_own_chain(spark):
    words = "Kế hoạch về lễ hội đua ghe sẽ hoàn thành sau đó".split()
    one, two = broken("lễ hội đua ghe", "cp1252"), broken("sẽ hoàn thành", "mac_roman")
    text = " ".join([*words[:3], one, "rồi", two, "sau đó"])
    got, df = found(spark, [CLEAN, " ".join(words), text])
    assert got == {2}
    row = restored_documents(df).collect()[0]
    assert row.restored == "Kế hoạch về lễ hội đua ghe rồi sẽ hoàn thành sau đó" and not row.left_over


def test_verified_words_go_before_a_chain():
    tokens = [{"token": "xÃ³", "word": "xó", "chain": "utf-8>cp1252"}, {"token": "zÃ", "word": "zà", "chain": "utf-8>cp1252"}]
    assert _restore("xÃ³ zÃ cÃ³", tokens) == "xó zà có" and _restore("plain", []) == "plain" and _restore(None, tokens) is None
