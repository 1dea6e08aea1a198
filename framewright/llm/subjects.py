"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search.

A term model (multinomial logistic regression over words and pairs of them) gives every sentence its subject; a boundary
model finds the sentences of texts without punctuation. From the sentences come a document's features: how many deal with
each subject, how surely, how many sentences there are, whether they were punctuated, and how often its source writes
about the subject. A chain of classifiers, each given the decisions before it, turns them into label combinations, so it
knows which subjects go together; it is fitted on documents composed of labelled sentences, whose subjects are known, and
calibrated on others of them; beam search takes the most probable combination.

Only labelled rows are bounded draws by hash: examples (``MAX_EXAMPLES``), segments (``MAX_SEGMENTS``), and punctuated
documents as labels of the boundary model (``MAX_MARKED``). Whatever describes the corpus is counted over all documents
by Spark: how common terms are, words that speakers put in, greetings, the subjects of a source, which subjects go
together, and the subjects in whose sentences a term is that no label shows (at most ``MAX_TERMS``, the commonest).
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.mojibake import repaired_text
from framewright.session import checkpointed, written

MAX_EXAMPLES, MAX_SEGMENTS, MAX_MARKED, MAX_TERMS = 5_000, 6_000, 2_500, 200_000
#: All taught terms together weigh as if they came from so many documents, so that the labels still count; each
#: occurrence weighs so much of a labelled sentence; and so many times is taught.
CORPUS_WEIGHT, TERM_WEIGHT, LESSONS = 6_000, 0.2, 1
#: A term that more than this share of a language's sentences has says nothing.
FRAME_SHARE = 0.12
#: A sentence below the first probability of its best subject deals with none; from the second on it does so firmly, and
#: from the third on it teaches.
SURE, FIRM, VERY_SURE = 0.15, 0.35, 0.8
#: A sentence that comes word for word in this share of the documents, and so often, says nothing: a greeting.
GREETING_SHARE, GREETING_TIMES = 0.002, 4
#: A word is put in by speakers if it has this share of the words of texts without punctuation, and so many times less elsewhere.
FILLER_SHARE, FILLER_TIMES = 0.001, 20
SHARE = 0.2
BEAM, COMPOSED, SEED = 6, 6_000, 11
LONG_PIECE, PIECE, BLOCK = 13, 1 << 17, 300_000
#: Sentences of about so many words are scored at once, and so many terms that stand alone are fitted at once.
BATCH, ALONE = 1 << 16, 1 << 13
#: Where the slope of a share's effect may change.
KNOTS = (0.05, 0.1, 0.14, 0.17, 0.185, 0.21, 0.24, 0.3)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»\s]+(?=\S)|\n+")
_MARKED = re.compile(r"[.!?…]")


def plain(text: str) -> str:
    """NFC, entities resolved, garbled passages undone."""
    text = repaired_text(html.unescape(text) if "&" in text else text)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(ws: list[str]) -> set[str]:
    """The words and pairs of words."""
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}


def sentences(text: str) -> list[list[str]]:
    """The sentences of a plain text by its marks, as words. A short first line before a blank one is a title."""
    head, blank, rest = text.partition("\n\n")
    if blank and rest.strip() and len(words(head)) <= 8 and not _MARKED.search(head):
        text = rest
    return [ws for part in _SENTENCE.split(text) if (ws := words(part))]


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _pieces(starts: np.ndarray, total: int) -> Iterator[tuple[int, int, int, int]]:
    """(first segment, end segment, first cell, end cell) of runs of segments of about ``PIECE`` cells."""
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, total, PIECE)), len(starts)])
    ends = np.r_[starts, total]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(a), int(b), int(ends[a]), int(ends[b])


def _batches(pieces: list[list[str]]) -> Iterator[list[list[str]]]:
    """Runs of sentences of about ``BATCH`` words; an empty one if there are no sentences."""
    at = np.cumsum([len(ws) for ws in pieces]) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(pieces)]
    for a, b in zip(cuts, cuts[1:]):
        yield pieces[a:b]


class Logistic:
    """Multinomial logistic regression over sparse named features, by full-batch AdaGrad."""

    def __init__(self, index: dict[str, int], value: np.ndarray, weights: np.ndarray):
        self.index, self.value, self.weights = index, value, weights

    @classmethod
    def fit(cls, rows: Iterable[Iterable[str]], labels: list[int], weight: list[float], classes: int, value=None, normed: bool = True, epochs: int = 25, rate: float = 0.5, l2: float = 1e-5, alone: tuple[list[str], np.ndarray] | None = None) -> Logistic:
        """``rows`` is read once and kept as numbers; sums run over pieces of ``PIECE`` cells, so memory stays small.

        ``alone`` are features that no row has, and for each class the weight of the rows of it that have just that feature;
        such rows are never made.
        """
        index: dict[str, int] = {}
        r, c = array("i"), array("i")
        for k, row in enumerate(rows):
            for f in row:
                c.append(index.setdefault(f, len(index)))
                r.append(k)
        weigh = lambda names: np.array([value(f) for f in names] if value else np.ones(len(names)), np.float32)
        wt = np.array(weight, np.float32)[:, None]
        shrink = l2 * (float(wt.sum()) + (float(alone[1].sum(dtype=float)) if alone else 0.0))  # many light rows pull no more than their weight
        v = weigh(index)
        w = cls._fit_rows(r, c, v, labels, wt, classes, normed, epochs, rate, shrink)
        if alone:
            own = weigh(alone[0])
            index.update(zip(alone[0], range(len(index), len(index) + len(own))))
            w = np.concatenate([w, cls._fit_alone(own / (own + np.float32(1e-9)) if normed else own, alone[1], epochs, rate, shrink)])
            v = np.r_[v, own]
        return cls(index, v, w)

    @staticmethod
    def _fit_alone(x: np.ndarray, by_class: np.ndarray, epochs: int, rate: float, shrink: float) -> np.ndarray:
        """The weights of features that stand alone in their rows. None changes another's, so they are fitted block by block."""
        w = np.zeros(by_class.shape, np.float32)
        for a in range(0, len(w), ALONE):
            own, xs, y = w[a : a + ALONE], x[a : a + ALONE, None], by_class[a : a + ALONE].astype(np.float32)
            total, seen = y.sum(axis=1, keepdims=True), np.full_like(own, 1e-8)
            for _ in range(epochs):
                g = xs * (softmax(xs * own) * total - y) + shrink * own
                seen += g * g
                own -= rate * g / np.sqrt(seen)
        return w

    @staticmethod
    def _fit_rows(r: array, c: array, v: np.ndarray, labels: list[int], wt: np.ndarray, classes: int, normed: bool, epochs: int, rate: float, shrink: float) -> np.ndarray:
        """The weights of the features ``c`` of the rows ``r``."""
        w, n = np.zeros((len(v), classes), np.float32), len(labels)
        if not c:
            return w
        r, c = np.frombuffer(r, np.int32), np.frombuffer(c, np.int32)
        x = v[c]
        if normed:
            norm = np.sqrt(np.bincount(r, x * x, minlength=n)) + 1e-9
            x = (x / norm[r]).astype(np.float32)
        x = x[:, None]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        held = r[first]
        order = np.argsort(c, kind="stable")
        col = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
        xo, ro = x[order], r[order]
        by_row, by_column = list(_pieces(first, len(c))), list(_pieces(col, len(c)))
        y = np.zeros((n, classes), np.float32)
        y[np.arange(n), labels] = 1
        seen = np.full_like(w, 1e-8)
        z, g = np.zeros((n, classes), np.float32), np.zeros_like(w)
        for _ in range(epochs):
            for a, b, lo, hi in by_row:
                z[held[a:b]] = np.add.reduceat(x[lo:hi] * w[c[lo:hi]], first[a:b] - lo, axis=0)
            error = (softmax(z) - y) * wt
            for a, b, lo, hi in by_column:
                g[a:b] = np.add.reduceat(xo[lo:hi] * error[ro[lo:hi]], col[a:b] - lo, axis=0)
            g += shrink * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
        return w

    def strongest(self, most: int) -> np.ndarray:
        """The numbers of the ``most`` features that say most."""
        says = self.value * np.abs(self.weights - self.weights.mean(axis=1, keepdims=True)).max(axis=1, initial=0.0)
        return np.argsort(-says, kind="stable")[: min(most, int((says > 0.02).sum()))]


class TermModel:
    """The scores of sentences by their words and pairs of words, for many sentences at once."""

    def __init__(self, fitted: Logistic, classes: int):
        keep = fitted.strongest(MAX_TERMS)
        names = list(fitted.index)
        self.value, self.weights, self.classes = fitted.value[keep], fitted.weights[keep], classes
        self.words: dict[str, int] = {}
        first, second = array("q"), array("q")
        for k in keep.tolist():
            a, _, b = names[k].partition(" ")
            first.append(self.words.setdefault(a, len(self.words)))
            second.append(self.words.setdefault(b, len(self.words)) if b else -1)
        first, second = np.array(first, np.int64), np.array(second, np.int64)
        self.single = np.full(len(self.words) + 1, -1)
        self.single[first[second < 0]] = np.flatnonzero(second < 0)
        two = np.flatnonzero(second >= 0)
        key = first[two] * len(self.words) + second[two]
        order = np.argsort(key)
        self.pairs, self.pair_of = key[order], two[order]

    def scores(self, pieces: list[list[str]]) -> np.ndarray:
        """A row of scores for each sentence; zeros where no term is known."""
        return np.concatenate([self._scores(own) for own in _batches(pieces)])

    def _scores(self, pieces: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(pieces), self.classes), np.float32)
        if not self.words or not pieces:
            return out
        get, none = self.words.get, len(self.words)
        ids = np.array([get(w, none) for ws in pieces for w in ws], np.int64)
        row = np.repeat(np.arange(len(pieces)), [len(ws) for ws in pieces])
        key = np.where((ids[:-1] < none) & (ids[1:] < none) & (row[:-1] == row[1:]), ids[:-1] * none + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        hit = np.flatnonzero(self.pairs[at] == key) if len(self.pairs) else np.zeros(0, int)
        one = np.flatnonzero(self.single[ids] >= 0)
        feature = np.r_[self.single[ids[one]], self.pair_of[at[hit]]]
        cells = np.unique(np.r_[row[one], row[hit]] * len(self.value) + feature)
        row, feature = cells // len(self.value), cells % len(self.value)
        if len(cells):
            v = self.value[feature]
            norm = np.sqrt(np.bincount(row, v * v, minlength=len(pieces))) + 1e-9
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat((v / norm[row])[:, None] * self.weights[feature], first, axis=0)
        return out


def gap_features(ws: list[str], i: int) -> list[tuple[str, ...]]:
    """What the words around a gap say about a sentence beginning at ``ws[i]``: a kind and up to three words."""
    n = len(ws)
    b2, b1 = ws[i - 2] if i > 1 else "", ws[i - 1] if i else ""
    a0, a1, a2 = ws[i] if i < n else "", ws[i + 1] if i + 1 < n else "", ws[i + 2] if i + 2 < n else ""
    return [("0", a0), ("1", a0, a1), ("2", a0, a1, a2), ("3", b1), ("4", b2, b1), ("5", b1, a0)]


class GapModel:
    """Where a sentence begins in words without marks, for many texts at once."""

    def __init__(self, fitted: Logistic):
        keep = fitted.strongest(MAX_TERMS)
        names = list(fitted.index)
        margin = fitted.value * (fitted.weights[:, 1] - fitted.weights[:, 0])
        # 0: no word there, 1: a word that no feature has
        self.words = {"": 0} | {w: i + 2 for i, w in enumerate(dict.fromkeys(w for k in keep for w in names[k][1:] if w))}
        self.base = len(self.words) + 2
        self.keys = np.array([self._key(int(names[k][0]), *(self.words[w] for w in names[k][1:])) for k in keep], np.int64)
        order = np.argsort(self.keys)
        self.keys, self.margin = self.keys[order], margin[keep][order]

    def _key(self, kind, a, b=0, c=0):
        return ((kind * self.base + a) * self.base + b) * self.base + c

    def margins(self, pieces: list[list[str]]) -> np.ndarray:
        """For each word of each piece, one after the other: how much speaks for a sentence beginning there."""
        return np.concatenate([self._margins(own) for own in _batches(pieces)])

    def _margins(self, pieces: list[list[str]]) -> np.ndarray:
        get = self.words.get
        pad = [0, 0]
        ids = np.array([i for ws in pieces for i in (*pad, *(get(w, 1) for w in ws), *pad)], np.int64)
        inner = np.concatenate([np.arange(len(ws)) + at for ws, at in zip(pieces, np.cumsum([2] + [len(ws) + 4 for ws in pieces[:-1]]))])
        b2, b1, a0, a1, a2 = (ids[inner + k] for k in (-2, -1, 0, 1, 2))
        total = np.zeros(len(inner))
        for key in (self._key(0, a0), self._key(1, a0, a1), self._key(2, a0, a1, a2), self._key(3, b1), self._key(4, b2, b1), self._key(5, b1, a0)):
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            total += np.where(self.keys[at] == key, self.margin[at], 0.0) if len(self.keys) else 0.0
        return total


_STATE = "n int, unsure boolean, marked boolean, counts array<int>, firm array<int>, best array<float>"


class SubjectModel:
    """The fitted models; ``label`` gives the subjects of one text."""

    subjects: list[str]
    term_model: TermModel
    gaps: GapModel | None = None
    fillers: frozenset[str] = frozenset()
    greetings: frozenset[str] = frozenset()
    source_rate: dict[str, np.ndarray]
    chain: list[np.ndarray]
    order: list[int]

    def cut(self, documents: list[list[list[str]]]) -> list[list[list[str]]]:
        """The sentences of documents without the words that speakers put in; long ones are cut where others begin."""
        fillers = self.fillers
        documents = [[kept for ws in pieces if (kept := [w for w in ws if w not in fillers] if fillers else ws)] for pieces in documents]
        long = [ws for pieces in documents for ws in pieces if len(ws) >= LONG_PIECE] if self.gaps else []
        if not long:
            return documents
        margins, at = self.gaps.margins(long), 0
        parts = {}
        for ws in long:
            begun, out = 0, []
            for i in np.flatnonzero(margins[at : at + len(ws)] > 0).tolist():
                if 3 <= i < len(ws) - 2 and i - begun >= 4:
                    out.append(ws[begun:i])
                    begun = i
            parts[id(ws)] = [*out, ws[begun:]]
            at += len(ws)
        return [[p for ws in pieces for p in parts.get(id(ws), (ws,))] for pieces in documents]

    def pieces(self, text: str) -> list[list[str]]:
        """The sentences of a plain text, as words."""
        return self.cut([sentences(text)])[0]

    def probabilities(self, pieces: list[list[str]]) -> np.ndarray:
        """A row of the subjects' probabilities for each sentence; greetings deal with none."""
        z = self.term_model.scores(pieces)
        if self.greetings:
            z[[i for i, ws in enumerate(pieces) if " ".join(ws) in self.greetings]] = 0
        return softmax(z)

    def summary(self, documents: list[list[list[str]]]) -> tuple[np.ndarray, ...]:
        """Of documents with sentences: their number, whether one says nothing, and for each subject: the sentences that
        deal with it, at all and firmly, and its best probability."""
        n = np.array([len(pieces) for pieces in documents])
        p = self.probabilities([ws for pieces in documents for ws in pieces])
        first, doc, k = np.r_[0, np.cumsum(n)[:-1]], np.repeat(np.arange(len(n)), n), p.shape[1]
        top = p.max(axis=1)
        of = doc * k + p.argmax(axis=1)
        counts, firm = (np.bincount(of[top >= t], minlength=len(n) * k).reshape(len(n), k) for t in (SURE, FIRM))
        return n, np.bincount(doc[top < SURE], minlength=len(n)) > 0, counts, firm, np.maximum.reduceat(p, first, axis=0)

    def rows(self, n: np.ndarray, unsure: np.ndarray, counts: np.ndarray, firm: np.ndarray, best: np.ndarray, marked: np.ndarray, sources: Iterable[str | None]) -> np.ndarray:
        """The features of documents, given what ``summary`` tells of each: documents by subjects by features.

        The share of a subject's sentences acts by a slope that may change at ``KNOTS``, on its own for punctuated texts;
        a subject without a firm sentence is weak.
        """
        n, marked = np.asarray(n, float), np.asarray(marked, float)
        hard = counts / n[:, None]
        none = np.zeros(hard.shape[1])
        odds = np.array([self.source_rate.get(source or "", none) for source in sources]).reshape(hard.shape)
        wide = lambda v: np.repeat(np.asarray(v, float)[:, None], hard.shape[1], axis=1)
        slopes = [hard * 5, *(np.clip(hard - t, 0, 0.1) * 50 for t in KNOTS)]
        own = [s * m[:, None] for m in (marked, 1 - marked) for s in slopes]
        weak = np.where((counts > 0) & (firm == 0), 1.0, 0.0)
        return np.stack([np.ones_like(hard), *own, weak * best, weak, wide(unsure), wide(np.log1p(n) / 3), wide(marked), wide(1 / n), odds], axis=2)

    def decode_many(self, x: np.ndarray) -> np.ndarray:
        """The most probable label combinations of documents under the chain, by beam search: documents by subjects."""
        docs, width, k = len(x), x.shape[2], len(self.order)
        score, chosen = np.zeros((docs, 1)), np.zeros((docs, 1, k))
        for step, j in enumerate(self.order):
            z = (x[:, j] @ self.chain[j][:width])[:, None] + chosen @ self.chain[j][width:]
            soft = np.log1p(np.exp(-np.abs(z)))
            both = np.concatenate([score - soft - np.maximum(z, 0), score - soft - np.maximum(-z, 0)], axis=1)
            yes = chosen.copy()
            yes[:, :, step] = 1
            every = np.concatenate([chosen, yes], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            score, chosen = np.take_along_axis(both, top, axis=1), np.take_along_axis(every, top[:, :, None], axis=1)
        out = np.zeros((docs, k), bool)
        out[:, self.order] = chosen[:, 0] > 0
        return out

    def decode(self, x: np.ndarray) -> list[int]:
        """``decode_many`` of one document."""
        return np.flatnonzero(self.decode_many(x[None])[0]).tolist()

    def label(self, text: str | None, source: str | None) -> list[str]:
        """The subjects of a text; none for null, blank and wordless texts."""
        pieces = self.pieces(plain(text)) if text and self.subjects else []
        if not pieces:
            return []
        x = self.rows(*self.summary([pieces]), np.array([bool(_MARKED.search(text))]), [source])
        return [self.subjects[j] for j in self.decode(x[0])]


def prepared(documents: DataFrame) -> DataFrame:
    """doc_id (as text), source, lang, marked, pieces: the sentences of every document with words, words parted by blanks.

    Texts are read, repaired and split here and only here.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, text, source, lang in zip(part["doc_id"], part["text"], part["source"], part["lang"]):
                text = plain(text) if text and text.strip() else ""
                if pieces := sentences(text):
                    rows.append((doc, source, lang, bool(_MARKED.search(text)), [" ".join(ws) for ws in pieces]))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "lang", "marked", "pieces"], dtype=object)

    # ids go through Python as text: pandas would make floats of a column with nulls
    lang = F.lower(F.trim("lang")) if "lang" in documents.columns else F.lit("")
    cut = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.coalesce(lang, F.lit("")).alias("lang"))
    return cut.mapInPandas(run, "doc_id string, source string, lang string, marked boolean, pieces array<string>")


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, lang, name, n over all ``prepared`` documents: 'documents', 'sentences' of each language, in how many of them
    each 'term' is, how often each word is in texts 'with' and 'without' marks, and in how many with marks each 'sentence'
    is. Each block is counted before the shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        block = lambda: pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "lang", "name", "n"])
        for part in parts:
            for lang, marked, pieces in zip(part["lang"], part["marked"], part["pieces"]):
                c["documents", "", ""] += 1
                c["sentences", lang, ""] += len(pieces)
                if marked:
                    c.update([("sentence", "", s) for s in set(pieces)])
                side = "with" if marked else "without"
                for s in pieces:
                    ws = s.split(" ")
                    c.update([("term", lang, t) for t in terms(ws)])
                    c.update([(side, lang, w) for w in ws])
                if len(c) > BLOCK:
                    yield block()
                    c.clear()
        yield block()

    counted = texts.select("lang", "marked", "pieces").mapInPandas(run, "kind string, lang string, name string, n long")
    return counted.groupBy("kind", "lang", "name").agg(F.sum("n").alias("n"))


def corpus_statistics(texts: DataFrame) -> tuple[int, frozenset[str], frozenset[str], dict[str, float]]:
    """Of all documents: how many there are, greetings, fillers, and in which share of a language's sentences a term is.

    Terms so rare that they have full value are left out, so at most some hundred times a sentence's terms are collected.
    Sentences of texts without marks are not told apart yet; their language's rates come from the other texts.
    """
    counts = checkpointed(corpus_counts(texts))
    total = {(r.kind, r.lang): r.n for r in counts.where("kind in ('documents', 'sentences')").collect()}
    n = total.get(("documents", ""), 0)
    greetings = frozenset(r.name for r in counts.where((F.col("kind") == "sentence") & (F.col("n") >= max(GREETING_TIMES, GREETING_SHARE * n))).select("name").collect())
    said = {(r.kind, r.lang): r.n for r in counts.where("kind in ('with', 'without')").groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    fillers = set()
    for (kind, lang), size in said.items():
        if kind == "without" and (other := said.get(("with", lang))):
            spoken = counts.where((F.col("kind") == kind) & (F.col("lang") == lang) & (F.col("n") >= max(FILLER_TIMES, FILLER_SHARE * size)))
            both = spoken.select("name", "n").join(counts.where((F.col("kind") == "with") & (F.col("lang") == lang)).select("name", F.col("n").alias("m")), "name", "left")
            fillers.update(r.name for r in both.collect() if r.n > FILLER_TIMES * size / other * (r.m or 0))
    rate: dict[str, float] = {}
    for (kind, lang), size in total.items():
        if kind == "sentences":
            often = (F.col("kind") == "term") & (F.col("lang") == lang) & (F.col("n") >= FRAME_SHARE * math.exp(-3) * 0.99 * (size + 50))
            for r in counts.where(often).select("name", "n").collect():
                rate[r.name] = max(rate.get(r.name, 0.0), r.n / (size + 50))
    return n, greetings, frozenset(fillers), rate


def taught_terms(texts: DataFrame, model: SubjectModel, known: frozenset[str]) -> DataFrame:
    """term, label, n: in how many sentences of all punctuated documents, whose subject is beyond doubt, a term is that no
    label shows. Each block is counted before the shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast((model, known))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (model, known), c = shared.value, Counter()
        block = lambda: pd.DataFrame([(*k, n) for k, n in c.items()], columns=["term", "label", "n"])
        for part in parts:
            documents = model.cut([[s.split(" ") for s in pieces] for pieces in part["pieces"] if len(pieces) > 1])
            documents = [d for d in documents if d]
            if documents:
                flat = [ws for pieces in documents for ws in pieces]
                n = np.array([len(pieces) for pieces in documents])
                p = model.probabilities(flat)
                # a sentence is judged beside the others of its document
                mean = np.add.reduceat(p, np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
                q = p * (np.repeat(mean, n, axis=0) + 0.02)
                q /= q.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(q.max(axis=1) > VERY_SURE).tolist():
                    label = int(q[i].argmax())
                    c.update([(t, label) for t in terms(flat[i]) if t not in known])
            if len(c) > BLOCK:
                yield block()
                c.clear()
        yield block()

    return texts.where("marked").select("pieces").mapInPandas(run, "term string, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))


def document_scores(texts: DataFrame, model: SubjectModel) -> DataFrame:
    """What ``summary`` tells of every ``prepared`` document; all sentences of a batch are scored at once."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in parts:
            cut = model.cut([[s.split(" ") for s in pieces] for pieces in part["pieces"]]) if model.subjects else [[]] * len(part)
            held = np.array([bool(pieces) for pieces in cut], bool)
            own = part[held]
            if len(own):
                n, unsure, counts, firm, best = model.summary([pieces for pieces in cut if pieces])
                yield pd.DataFrame({"doc_id": own["doc_id"], "source": own["source"], "n": n, "unsure": unsure, "marked": own["marked"].astype(bool), "counts": list(counts), "firm": list(firm), "best": list(best)})

    return texts.select("doc_id", "source", "marked", "pieces").mapInPandas(run, f"doc_id string, source string, {_STATE}")


def _features_of(part: pd.DataFrame, model: SubjectModel) -> np.ndarray:
    """The features of scored documents."""
    sources = [s if isinstance(s, str) else None for s in part["source"]]
    return model.rows(part["n"].to_numpy(), part["unsure"].to_numpy(), np.stack(part["counts"].tolist()), np.stack(part["firm"].tolist()), np.stack(part["best"].tolist()), part["marked"].to_numpy(), sources)


def source_counts(scored: DataFrame, subjects: int) -> tuple[Counter, dict[str, np.ndarray], np.ndarray]:
    """Of all scored documents: how many each source has, how many of them deal with each subject, and with each two.

    The lists of sources and subjects are short; every batch is counted before the shuffle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for part in parts:
            if len(part):
                y = (np.stack(part["counts"].tolist()) / part["n"].to_numpy()[:, None] >= SHARE - 1e-9).astype(float)
                source = part["source"].fillna("").to_numpy()
                for s in np.unique(source):
                    own = y[source == s]
                    c[s, -1] += len(own)
                    for j, k in enumerate(own.sum(axis=0)):
                        c[s, j] += int(k)
                for j, k in enumerate((y.T @ y).ravel()):
                    c["", subjects + j] += int(k)
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["source", "cell", "k"])

    seen, rates, together = Counter(), {}, np.zeros(subjects * subjects)
    for r in scored.select("source", "n", "counts").mapInPandas(run, "source string, cell int, k long").groupBy("source", "cell").agg(F.sum("k").alias("k")).collect():
        if r.cell < 0:
            seen[r.source] = r.k
        elif r.cell < subjects:
            rates.setdefault(r.source, np.zeros(subjects))[r.cell] = r.k
        else:
            together[r.cell - subjects] = r.k
    return seen, rates, together.reshape(subjects, subjects)


def fit(subjects: list[str], examples: list[tuple[str, str, int]], segments: list[tuple[str, list[str], int]], documents: DataFrame | None) -> SubjectModel:
    """The models from labelled examples (text, lang, subject), labelled segments (summary, keywords, subject) and
    all unlabelled documents (doc_id, text, source), if there are any."""
    return fit_scored(subjects, examples, segments, documents)[0]


def fit_scored(subjects: list[str], examples: list[tuple[str, str, int]], segments: list[tuple[str, list[str], int]], documents: DataFrame | None) -> tuple[SubjectModel, DataFrame | None]:
    """``fit``, with the ``document_scores`` of all documents that it needed, written once."""
    model, n = SubjectModel(), len(subjects)
    model.subjects, model.source_rate, model.order = subjects, {}, list(range(n))
    if not n:
        return model, None
    texts = written(prepared(documents))[0] if isinstance(documents, DataFrame) else None
    size, rate = 0, {}
    if texts is not None:
        size, model.greetings, model.fillers, rate = corpus_statistics(texts)
    # how much of a language's sentences a term is in: the frames of sentences are in many
    value = lambda t: min(3.0, max(0.0, math.log(FRAME_SHARE / max(rate.get(t, 1e-4), 1e-4)))) / 3
    rows, labels, weight = [], [], []

    def add(text: str, label: int, w: float) -> int:
        own = model.cut([sentences(plain(text))])[0] if text else []
        rows.extend(own)
        labels.extend([label] * len(own))
        weight.extend([w] * len(own))
        return len(own)

    for text, _, label in examples:
        add(text, label, 1.0)
    for summary, _, label in segments:
        add(summary, label, 1.0)
    whole = len(rows)
    for _, keywords, label in segments:
        for k in dict.fromkeys(keywords or []):
            add(k, label, 0.5)
    # a fifth of the labelled sentences is kept from the models that the chain learns on, so that it meets their errors
    held = np.array([i < whole and i % 5 == 4 for i in range(len(rows))], bool)

    def term_model(kept: np.ndarray, taught: tuple[list[str], np.ndarray] | None = None) -> TermModel:
        at = np.flatnonzero(kept)
        return TermModel(Logistic.fit((terms(rows[i]) for i in at), [labels[i] for i in at], [weight[i] for i in at], n, value, alone=taught), n)

    each, new, scored = TERM_WEIGHT * min(1.0, CORPUS_WEIGHT / max(size, 1)), None, None
    model.term_model = term_model(~held)
    if texts is not None:
        # again with terms that no label shows, each with its weight for every subject it was taught for; what it teaches
        # the model lets it judge more sentences, above all in languages with few labels
        known = frozenset(t for ws in rows for t in terms(ws))
        for _ in range(LESSONS):
            names, counts = _commonest(checkpointed(taught_terms(texts, model, known)), n)
            new = (names, np.float32(each) * counts)
            model.term_model = term_model(~held, new)
        drawn = [[s.split(" ") for s in r.pieces] for r in _hashed(texts.where("marked and size(pieces) between 2 and 60"), ["doc_id"], MAX_MARKED).orderBy("doc_id").select("pieces").collect()]
        drawn = [d for d in model.cut(drawn) if len(d) > 1]
        if drawn:
            model.gaps = _fit_gaps(drawn)
    learner, model.term_model = model.term_model, term_model(np.ones(len(rows), bool), new) if held.any() else model.term_model
    if texts is not None:
        scored = written(document_scores(texts, model))[0]
    at = np.flatnonzero(held)
    _fit_chain(model, learner, scored, [rows[i] for i in at], [labels[i] for i in at])
    return model, scored


def _commonest(taught: DataFrame, subjects: int) -> tuple[list[str], np.ndarray]:
    """The ``MAX_TERMS`` commonest taught terms, and how often each was taught for each subject.

    A term comes as one row of numbers in Arrow batches: rows for each of its subjects would be too many for the driver.
    """
    by_label = F.array(*(F.sum(F.when(F.col("label") == j, F.col("n")).otherwise(0)) for j in range(subjects)))
    terms_of = taught.groupBy("term").agg(F.sum("n").alias("all"), by_label.alias("by_label")).where("all >= 2")
    got = terms_of.orderBy(F.desc("all"), "term").limit(MAX_TERMS).select("term", "by_label").orderBy("term").toArrow()
    counts = got["by_label"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return got["term"].to_pylist(), counts.reshape(-1, subjects).astype(np.float32)


def _fit_gaps(marked: list[list[list[str]]]) -> GapModel:
    """The boundary model, from sentences whose ends are known by their marks."""
    flat = [[w for s in pieces for w in s] for pieces in marked]
    labels: list[int] = []
    for pieces, ws in zip(marked, flat):
        starts = set(np.cumsum([len(s) for s in pieces])[:-1].tolist())
        labels += [int(i in starts) for i in range(1, len(ws))]
    return GapModel(Logistic.fit((gap_features(ws, i) for ws in flat for i in range(1, len(ws))), labels, [1.0] * len(labels), 2, normed=False))


def composed_documents(model: SubjectModel, rows: list[list[str]], labels: list[int], seen: Counter, rates: dict[str, np.ndarray], together: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and true subjects of ``n`` documents made of labelled sentences.

    Sources, their subjects and which subjects go together are drawn as often as the corpus has them; some documents lose
    their marks and are cut by the boundary model.
    """
    rng, k = np.random.default_rng(SEED), len(model.subjects)
    pool: list[list[list[str]]] = [[] for _ in range(k)]
    for ws, label in zip(rows, labels):
        pool[label].append(ws)
    usable = np.array([j for j in range(k) if pool[j]])
    greetings = [g.split(" ") for g in sorted(model.greetings)]
    sources = sorted(seen) or [""]
    share = np.array([max(seen[s], 1) for s in sources], float)
    documents, marked, names, truth = [], [], [], []
    for _ in range(n if len(usable) > 1 else 0):
        source = sources[int(rng.choice(len(sources), p=share / share.sum()))]
        often = rates.get(source, np.zeros(k))[usable] + together.diagonal()[usable] / max(together.trace(), 1) * 5 + 0.1
        main = int(rng.choice(usable, p=often / often.sum()))
        pull = together[main][usable] + together[main][usable].mean() + 0.1
        second = int(rng.choice(usable, p=pull / pull.sum()))
        count = int(rng.integers(1, 18))
        kinds = rng.random(count)
        lead = rng.uniform(0.5, 0.95)
        picked = [main if x < lead else second if x < lead + (1 - lead) * 0.8 else -1 if greetings and x > 0.98 else int(rng.choice(usable)) for x in kinds]
        text = [greetings[int(rng.integers(len(greetings)))] if j < 0 else pool[j][int(rng.integers(len(pool[j])))] for j in picked]
        truth.append(np.bincount([j for j in picked if j >= 0], minlength=k) / count >= SHARE - 1e-9)
        marked.append(bool(rng.random() < 0.6))
        documents.append(text if marked[-1] else [[w for ws in text for w in ws]])
        names.append(source)
    if not documents:
        return np.zeros((0, k, 1)), np.zeros((0, k))
    x = model.rows(*model.summary(model.cut(documents)), np.array(marked), names)
    return x, np.array(truth, float)


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, offset: np.ndarray, l2: float, steps: int = 40) -> np.ndarray:
    """Logistic regression of ``y`` on ``x`` by Newton steps; ``offset`` is added to the score."""
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + l2 * (w - start))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(model: SubjectModel, x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> list[np.ndarray]:
    """The classifiers of the chain, each with the decisions before it, fitted on four fifths of the documents; on the
    last fifth their scores are scaled and shifted, so that they are calibrated."""
    k = len(model.subjects)
    chain = [np.zeros(x.shape[2] + k)] * k
    held = np.arange(len(x)) % 5 == 4
    for step, j in enumerate(model.order):
        own = np.concatenate([x[:, j], y[:, model.order[:step]]], axis=1)
        w = _newton(own[~held], y[~held, j], np.zeros(own.shape[1]), 0.0, l2)
        score = own[held] @ w
        shift, scale = _newton(np.stack([np.ones(held.sum()), score], axis=1), y[held, j], np.array([0.0, 1.0]), 0.0, 1e-3)
        w = w * max(scale, 0.1)
        w[0] += shift
        chain[j] = np.r_[w, np.zeros(k - step)]
    return chain


def _fit_chain(model: SubjectModel, learner: TermModel, scored: DataFrame | None, rows: list[list[str]], labels: list[int]) -> None:
    """Source rates and co-occurrence over all ``scored`` documents, and the chain on composed ones, as ``learner`` sees them."""
    k = len(model.subjects)
    seen, rates, together = source_counts(scored, k) if scored is not None else (Counter(), {}, np.zeros((k, k)))
    total = sum(seen.values())
    overall = sum(rates.values()) / total if total else np.full(k, 1 / k)
    model.source_rate = {s: np.log((r + 20 * overall + 0.1) / (seen[s] + 20.2) / (overall + 0.01)) for s, r in rates.items()}
    model.order = [int(j) for j in np.argsort(-overall, kind="stable")]
    final, model.term_model = model.term_model, learner
    x, y = composed_documents(model, rows, labels, seen, rates, together + 1, COMPOSED)
    model.term_model = final
    if len(x):
        model.chain = fit_chain(model, x, y)
    else:
        width = model.rows(np.ones(1), np.zeros(1), *(np.zeros((1, k)) for _ in range(3)), np.zeros(1), [None]).shape[2]
        model.chain = [np.zeros(width + k)] * k


def subject_key(name: str) -> str:
    """The form in which ids of subjects are compared."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def _hashed(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """About ``most`` rows at the most, drawn by the hash of ``key``; the same rows however they are partitioned."""
    share = min(1.0, most / max(df.count(), 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 53)) < int(share * (1 << 53)))


def fit_tables(domains: DataFrame, examples: DataFrame, segments: DataFrame, documents: DataFrame) -> SubjectModel:
    """``fit`` on bounded samples of the labelled tables and on all documents. Labels that are no live subject are left out."""
    return fit_tables_scored(domains, examples, segments, documents)[0]


def fit_tables_scored(domains: DataFrame, examples: DataFrame, segments: DataFrame, documents: DataFrame) -> tuple[SubjectModel, DataFrame | None]:
    """``fit_tables``, with the scores of all documents."""
    subjects = sorted(r.domain_id for r in domains.where("deleted_at is null and domain_id is not null").select("domain_id").distinct().collect())
    number = {subject_key(s): i for i, s in enumerate(subjects)}
    labelled = [(r.text, r.lang, number[subject_key(r.domain_id)]) for r in _hashed(examples, ["example_id"], MAX_EXAMPLES).orderBy("example_id").select("text", "lang", "domain_id").collect() if r.text and r.domain_id and subject_key(r.domain_id) in number]
    once = segments.select("analysis_id", "segment_idx", "domain_id", "summary", "keywords").dropDuplicates(["analysis_id", "segment_idx"])
    parts = [(r.summary, [k for k in r.keywords or [] if k], number[subject_key(r.domain_id)]) for r in _hashed(once, ["analysis_id", "segment_idx"], MAX_SEGMENTS).orderBy("analysis_id", "segment_idx").collect() if r.domain_id and subject_key(r.domain_id) in number]
    return fit_scored(subjects, labelled, parts, documents)


def scored_subjects(scored: DataFrame, model: SubjectModel, id_type: str) -> DataFrame:
    """doc_id, domain_id of scored documents; the bounded model goes to them."""
    shared = scored.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.subjects, object)
        for part in parts:
            if len(part):
                doc, subject = np.nonzero(model.decode_many(_features_of(part, model)))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(object)[doc], "domain_id": names[subject]}, dtype="object")

    labelled = scored.mapInPandas(run, "doc_id string, domain_id string")
    return labelled.select(F.col("doc_id").cast(id_type).alias("doc_id"), "domain_id").distinct()


def document_subjects(documents: DataFrame, model: SubjectModel, scored: DataFrame | None = None) -> DataFrame:
    """doc_id, domain_id: a row for every subject of every document.

    Null, blank and wordless texts have no row; texts of any length are read whole; garbled passages are undone first.
    Documents with the same text and source have the same subjects; a repeated doc_id is labelled row by row and its
    rows are kept once. ``scored`` are the documents' scores if the fit has them already.
    """
    return scored_subjects(document_scores(prepared(documents), model) if scored is None else scored, model, dict(documents.dtypes)["doc_id"])


def subject_composition(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """domain_id, n_documents, share_of_documents: what the corpus is about (documents can have several subjects)."""
    total = documents.agg(F.countDistinct("doc_id").alias("total"))
    return labels.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(F.broadcast(total)).select("domain_id", "n_documents", (F.col("n_documents") / F.col("total")).alias("share_of_documents"))  # total: one row
