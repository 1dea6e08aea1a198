"""Texts that were decoded with the wrong character encoding: finding and restoring them.

The garbled forms of every distinct clean word of the corpus under all encoding chains make a table; the tokens of the
documents are hash-joined against it. A document with a token that is a garbled form, and is no clean word itself, is
garbled; its tokens are put back word by word, and the rest of its suspicious tokens by undoing the chain found in it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import checkpointed

#: Encodings in which texts are mistakenly read, each by its Python codec (fixed values).
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "mac_roman", "cp437", "cp850", "cp852", "cp866", "cp737", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "gbk", "gb18030", "big5", "shift_jis", "euc_kr", "euc_jp", "tis_620")
#: Encodings of which the damage is done twice.
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251")
#: Legacy encodings in which texts are stored that are then read as UTF-8 or as another legacy encoding.
STORED_AS = ("cp1252", "cp1258", "mac_roman", "cp437", "tcvn3")
#: The Vietnamese standard TCVN 5712-3 from byte A1 on, for which Python has no codec (fixed values; '.' is unused).
TCVN3 = (
    "ĂÂÊÔƠƯĐăâêôơưđ......àảãáạ.ằẳẵắ......."
    "ặầẩẫấậè.ẻẽéẹềểễếệìỉ...ĩíịò.ỏõóọồổỗốộờởỡớợù.ủũúụừửữứựỳỷỹýỵ"
)
_QUOTES = "“”‘’«»…–—•"
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A closing guillemet that no blank parts from a word is a byte read wrongly.
_TAIL = re.compile(r"\w»")
_SPLIT = r"[ \t\n\r\x0B\f]+"
SALTS = 16
#: Verified tokens around a token that tell the chain of its passage.
NEARBY = 5


@lru_cache(maxsize=1)
def _alphabet() -> frozenset[str]:
    """Letters of Vietnamese, French and English, in both cases, with digits and the marks that texts are set with."""
    tones, hats = ["", "̀", "́", "̃", "̉", "̣"], ["", "̂", "̆", "̛"]
    letters = {unicodedata.normalize("NFC", v + h + t) for v in "aeiouy" for h in hats for t in tones}
    letters = {x for x in letters if len(x) == 1} - set("ĕĭŏŭĩ̂") | set("đàâæçéèêëîïôœùûüÿĩũ")
    ascii_part = {chr(c) for c in range(32, 127)}
    return frozenset(ascii_part | letters | {x.upper() for x in letters if len(x.upper()) == 1} | set(_QUOTES) | {"’"})


@lru_cache(maxsize=1 << 17)
def is_clean(token: str) -> bool:
    """Whether a token is written with the corpus's letters and marks only, in one case or with a capital first."""
    token = unicodedata.normalize("NFC", token)
    if not set(token) <= _alphabet():
        return False
    if set(token.strip(_STRIP + _QUOTES)) & set(_QUOTES) - {"’"} or _TAIL.search(token):
        return False
    for part in token.replace("’", "-").replace("'", "-").split("-"):
        core = part.strip(_STRIP + _QUOTES)
        if not (core.islower() or core.isupper() or core[1:].islower() or not core[1:].strip(_STRIP + "0123456789")):
            return any(c.isdigit() for c in core) or core.isascii()
    return True


def _c1(codec: str, data: bytes) -> str:
    """Decoding that passes bytes without a meaning through as C1 controls, as many programs do."""
    return "".join(_one(codec, b) for b in data)


@lru_cache(maxsize=8192)
def _one(codec: str, b: int) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=1)
def _tcvn3() -> dict[str, int]:
    return {c: 0xA1 + i for i, c in enumerate(TCVN3) if c != "."}


def _legacy_bytes(word: str, codec: str) -> bytes | None:
    if codec == "tcvn3":
        table = _tcvn3()
        got = [ord(c) if c < "\x80" else table.get(c, table.get(c.lower())) for c in unicodedata.normalize("NFC", word)]
        return None if None in got else bytes(got)
    if codec == "cp1258":  # tones are combining there
        out = []
        for c in unicodedata.normalize("NFC", word):
            parts = unicodedata.normalize("NFD", c)
            tone = "".join(x for x in parts if x in "̣̀́̃̉")
            out.append(c if not tone else unicodedata.normalize("NFC", "".join(x for x in parts if x not in tone)) + tone)
        word = "".join(out)
    try:
        return word.encode(codec)
    except UnicodeEncodeError:
        return None


def _read(data: bytes, codec: str) -> set[str]:
    """Every text that programs make of ``data`` in ``codec``: strictly, with marks for bad bytes, without them, or with C1."""
    out = set()
    for errors in ("replace", "ignore"):
        try:
            out.add((data + b" ").decode(codec, errors).rstrip(" "))
            out.add(data.decode(codec, errors))
        except (UnicodeDecodeError, LookupError):
            pass
    if codec.startswith(("cp125", "iso8859")):
        out.add(_c1(codec, data))
    return out


def _displays(form: str) -> set[str]:
    """A form as it is, without C1 controls and soft hyphens, and in the pieces that no-break spaces cut it into."""
    bare = "".join(c for c in form if not "\x7f" <= c <= "\x9f" and c != "\xad")
    out = {form, bare, bare.replace("\xa0", "")}
    for x in (form, bare):
        if "\xa0" in x:
            out.update(p for p in x.split("\xa0") if len(p) > 1)
    return out


def garbled_forms(word: str) -> dict[str, str]:
    """{garbled form: chain} of a clean word under all chains; without forms that are the word or clean words."""
    spellings = {word, word.lower(), word.upper()} | {unicodedata.normalize("NFD", word)}
    out: dict[str, str] = {}
    for w in sorted(spellings):
        if w.isascii():
            continue
        for codec in READ_AS:
            once = _read(w.encode("utf-8"), codec)
            for form in sorted(once):
                for shown in _displays(form):
                    out.setdefault(shown, f"utf-8>{codec}")
            if codec in TWICE:
                for form in sorted(once):
                    for second in TWICE[:2] if codec in TWICE[:2] else (codec,):
                        for again in _read(form.encode("utf-8"), second):
                            for shown in _displays(again):
                                out.setdefault(shown, f"utf-8>{codec}>utf-8>{second}")
        if len(w) >= 2:
            for stored in STORED_AS if len(w) >= 3 else ("tcvn3",):
                data = _legacy_bytes(w, stored)
                if data is None:
                    continue
                for codec in ("utf-8", "cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "cp1253", "gbk"):
                    if codec != stored:
                        for form in _read(data, codec):
                            if codec != "utf-8" or "\ufffd" in form:  # other bytes are hardly ever valid UTF-8
                                out.setdefault(form, f"{stored}>{codec}")
    strip = lambda f: f.strip(_STRIP)
    made: dict[str, str] = {}
    for form, chain in out.items():
        form = strip(form)
        if form and not form.isascii() and form not in spellings and not is_clean(form) and len(form) > 1:
            made.setdefault(form, chain)
    return made


def _tokens(text: str) -> list[str]:
    return [t for t in (x.strip(_STRIP) for x in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\f", " ").split(" ")) if t and not t.isascii()]


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clean words of each block with their counts, and the suspicious tokens of each document (n = 0)."""
    for part in parts:
        words: dict[str, int] = {}
        clean: dict[str, bool] = {}
        rows = []
        for doc, text in zip(part["doc_id"], part["text"]):
            if text is None:
                continue
            odd = set()
            for t in _tokens(text):
                ok = clean.get(t)
                if ok is None:
                    ok = clean[t] = is_clean(t)
                if ok:
                    words[t] = words.get(t, 0) + 1
                else:
                    odd.add(t)
            rows += [(doc, t) for t in odd]
        yield pd.DataFrame({"doc_id": [r[0] for r in rows] + [None] * len(words), "token": [r[1] for r in rows] + list(words), "n": [0] * len(rows) + list(words.values())}, dtype=object)


def _forms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for at in range(0, len(part), 500):
            cut = part.iloc[at : at + 500]
            rows = [(form, word, n, chain) for word, n in zip(cut["token"], cut["n"]) for form, chain in garbled_forms(unicodedata.normalize("NFC", word)).items()]
            yield pd.DataFrame(rows, columns=["token", "word", "n", "chain"], dtype=object)


def garbled_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, token, word, chain: every distinct token of a document that is a garbled form of a clean corpus word.

    Rows with a null doc_id count as one document of that id. Null, empty and ASCII texts have none. Of several words with one garbled form the commonest in the corpus is taken,
    then the first in order. Distinct tokens are joined, not their occurrences, and what was found goes back to the
    documents with a salt, so a garbled word that is in a third of all documents is spread over tasks.
    """
    # ids go through Python as text: pandas would make floats of a column with nulls
    scanned = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_scan, "doc_id string, token string, n long")
    seen = checkpointed(scanned.withColumn("doc_id", F.col("doc_id").cast(dict(documents.dtypes)["doc_id"])))
    # each word makes some dozens of forms, so the words are spread over all tasks whatever their bytes; by another hash
    # than that of the sum, or the planner would take the sum's partitions, which AQE merges by size
    spread = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.sparkSession.sparkContext.defaultParallelism)
    words = seen.where("n > 0").groupBy("token").agg(F.sum("n").alias("n")).repartition(spread, F.xxhash64("token"))
    odd = seen.where("n = 0").select("doc_id", "token")
    distinct = odd.select("token").distinct()
    forms = words.mapInPandas(_forms, "token string, word string, n long, chain string")
    known = forms.join(distinct, "token", "left_semi").groupBy("token").agg(F.min_by(F.struct("word", "chain"), F.struct(-F.col("n"), "word", "chain")).alias("w"))
    salted = known.select("token", "w.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return odd.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).select("doc_id", "token", "word", "chain")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents of which the text, or a passage, is garbled."""
    return garbled_tokens(documents).select("doc_id").distinct()


@lru_cache(maxsize=1 << 16)
def undo(token: str, chain: str) -> str | None:
    """The clean word that ``chain`` made ``token`` of, if it can be undone without loss."""
    steps = chain.split(">")
    try:
        for stored, read in reversed(list(zip(steps[::2], steps[1::2]))):
            try:
                data = token.encode(read)
            except UnicodeEncodeError:
                data = b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(read) for c in token)
            token = "".join(chr(b) if b < 0x80 else TCVN3[b - 0xA1] for b in data) if stored == "tcvn3" else data.decode(stored)
    except (UnicodeError, LookupError):
        return None
    token = unicodedata.normalize("NFC", token) if "cp1258" in steps else token
    return token if is_clean(token) else None


def _encodable(token: str, codec: str) -> bool:
    try:
        token.encode(codec)
    except (UnicodeError, LookupError):
        return False
    return True


def _put_back(core: str, sure: object, own: str | None) -> str | None:
    """The text of a garbled token: by its passage's chain if that is another than the verified one, else the verified word.

    The word is verified whatever its case is; undoing keeps the case where it gives that word.
    """
    undone = undo(core, own) if own else None
    if sure is None or (undone and sure["chain"] != own):
        return undone
    exact = undo(core, sure["chain"])
    return exact if exact and exact.lower() == unicodedata.normalize("NFC", sure["word"]).lower() else sure["word"]


def _restore(text: str | None, tokens: list, chain: str | None = None) -> str | None:
    """``text`` with its garbled tokens put back: verified ones by their words, others by the chain of their passage.

    ``tokens`` are the verified ones (token, word, chain). The chain of a passage is the commonest of the ``NEARBY`` nearest
    verified tokens (ties: the nearest one's), so passages that were garbled in different ways do not mix; without any it
    is ``chain``. A verified token whose own chain is another than its passage's is undone by the passage's if that loses
    nothing: its word may come from another garbled text.
    A token that looks clean is garbled too if its chain can have made it and the nearest such token before or after it,
    ASCII aside, is garbled: the wrong reading of one legacy encoding may look like French.
    """
    if text is None or (chain is None and not tokens):
        return text
    known = {t["token"]: t for t in tokens}
    lines = [line.split(" ") for line in text.split("\n")]
    at = [(n, i) for n, cells in enumerate(lines) for i, c in enumerate(cells) if not c.isascii()]
    cores = [lines[n][i].strip(_STRIP) for n, i in at]
    sure = [k for k, c in enumerate(cores) if c in known]
    chains, j = [], 0
    for k in range(len(cores)):
        while j + 1 < len(sure) and abs(sure[j + 1] - k) < abs(sure[j] - k):
            j += 1
        near = sorted(sure[max(j - NEARBY, 0) : j + NEARBY + 1], key=lambda at: abs(at - k))[:NEARBY]
        votes = [known[cores[at]]["chain"] for at in near]
        chains.append(max(votes, key=votes.count) if votes else chain)
    bad = [c in known or not is_clean(c) for c in cores]
    # clean bytes are hardly ever valid UTF-8, so what can be undone is garbled
    bad = [b or (h is not None and h.startswith("utf-8") and undo(c, h) not in (None, c)) for b, c, h in zip(bad, cores, chains)]
    for order in (range(1, len(cores)), range(len(cores) - 2, -1, -1)):
        for k in order:
            if not bad[k] and chains[k] is not None and not chains[k].startswith("utf-8"):
                near = k - 1 if order.step > 0 else k + 1
                bad[k] = bad[near] and at[near][0] == at[k][0] and _encodable(cores[k], chains[k].split(">")[-1])
    for (n, i), core, garbled, own in zip(at, cores, bad, chains):
        if garbled and core:
            put = _put_back(core, known.get(core), own)
            lines[n][i] = lines[n][i].replace(core, put) if put else lines[n][i]
    return "\n".join(" ".join(cells) for cells in lines)


def restored_documents(documents: DataFrame) -> DataFrame:
    """doc_id, chain, text, restored, left_over for every garbled document.

    ``chain`` is the one that most of its garbled tokens have; every passage is undone by its own. Verified tokens become
    their words, the others around them are undone where that loses nothing; ``left_over`` says whether suspicious tokens
    remain (lost bytes, foreign words). Documents with a repeated doc_id are restored text by text; rows with a null
    doc_id are found but have no text to join, and are left out.
    """
    found = garbled_tokens(documents)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("token", "word", "chain")).alias("tokens"), F.mode("chain", True).alias("chain"))

    @F.pandas_udf("string")
    def put_back(text: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([_restore(t, list(k)) for t, k in zip(text, tokens)], dtype=object)

    @F.pandas_udf("boolean")
    def odd_left(text: pd.Series) -> pd.Series:
        return pd.Series([any(not is_clean(t) for t in _tokens(x or "")) for x in text])

    # garbled texts are few; AQE sends the short side's ids where that is cheaper than moving texts
    joined = documents.select("doc_id", "text").join(per_doc, "doc_id")
    fixed = joined.withColumn("restored", put_back("text", "tokens"))
    return fixed.select("doc_id", "chain", "text", "restored", odd_left("restored").alias("left_over"))


CHAINS = (*(f"utf-8>{c}" for c in READ_AS), *(f"utf-8>{a}>utf-8>{b}" for a in TWICE[:2] for b in TWICE[:2]), *(f"{s}>{c}" for s in STORED_AS for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") if s != c))


def repaired_text(text: str) -> str:
    """``text`` with garbled passages undone by the chain that undoes most of its suspicious tokens, without a lexicon.

    A text of which no chain undoes a third of the suspicious tokens is left as it is (of one legacy encoding read as
    another, which foreign words may look like, four tokens and two thirds). For uses that need readable words
    rather than proof; ``garbled_tokens`` gives the verified cases.
    """
    odd = [t for t in dict.fromkeys(_tokens(text)) if not is_clean(t)]
    if not odd:
        return text
    undone, chain = max(((sum(undo(t, c) is not None for t in odd), c) for c in CHAINS), key=lambda x: x[0])
    enough = undone * 3 >= len(odd) if chain.startswith("utf-8") else undone >= 4 and undone * 3 >= 2 * len(odd)
    return _restore(text, [], chain) if enough else text
