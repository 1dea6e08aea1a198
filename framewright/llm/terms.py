"""How often every distinct term occurs, and in how many records, over collections of any size."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import checkpointed, written

#: Identifiers per count array, buckets of the dictionary, and groups of blocks that are added up side by side.
RANGE, BUCKETS, BLOCK_GROUPS = 1024, 4096, 32
#: Records of a block, and the least number of blocks.
BLOCK_ROWS, MIN_BLOCKS = 50_000, 12
RARE_RECORDS, COMMON_SHARE = 3, 0.05


def term_form(spelling: str | None) -> str:
    """Lower case, Unicode NFC, no outer blanks, single inner blanks; '' for null and blank spellings."""
    if not spelling:
        return ""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", spelling).lower()).split())


def _forms(keywords: object, forms: dict[str, str]) -> list[str]:
    """The term forms of one record's keywords; ``forms`` remembers spellings."""
    out = []
    for k in keywords if keywords is not None else ():
        w = forms.get(k)
        if w is None:
            if len(forms) > 200_000:
                forms.clear()
            w = forms[k] = term_form(k)
        if w:
            out.append(w)
    return out


def _distinct_terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, term: the terms that a block holds, each once for every batch of its rows."""
    forms: dict[str, str] = {}
    for part in parts:
        held = {(b, w) for b, keywords in zip(part["block"], part["keywords"]) for w in _forms(keywords, forms)}
        yield pd.DataFrame(sorted(held), columns=["block", "term"])


def _dictionary(terms: DataFrame) -> DataFrame:
    """term, id: dense identifiers from 0, in the order of hash buckets and, within them, of the terms."""
    terms = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = terms.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("term")) - 1
    return terms.withColumn("nth", inside).join(starts, "bucket").select("term", (F.col("start") + F.col("nth")).alias("id"))


_ARRAYS = "table_name string, range long, part int, occurrences array<long>, records array<long>"


def _encoded(key: tuple, rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The count arrays of one block: its records are encoded with the identifiers of its terms, and counted by range."""
    ids = dict(zip(words["term"], words["id"].tolist()))
    forms: dict[str, str] = {}
    out = []
    for name, own in rows.groupby("table_name", sort=True):
        codes = [np.array([ids[w] for w in _forms(k, forms)], np.int64) for k in own["keywords"]]
        counts = []
        for every in (codes, [np.unique(c) for c in codes]):
            flat = np.concatenate(every) if every else np.zeros(0, np.int64)
            counts.append(np.unique(flat, return_counts=True))
        for r in np.unique(counts[0][0] // RANGE):
            arrays = []
            for at, n in counts:
                array, here = np.zeros(RANGE, np.int64), at // RANGE == r
                array[at[here] % RANGE] = n[here]
                arrays.append(array)
            out.append((name, int(r), int(key[0]) % BLOCK_GROUPS, *arrays))
    return pd.DataFrame(out, columns=["table_name", "range", "part", "occurrences", "records"])


def _added(key: tuple, arrays: pd.DataFrame) -> pd.DataFrame:
    """The sum of count arrays of one range."""
    add = lambda c: np.sum(np.stack(arrays[c].tolist()), axis=0, dtype=np.int64)
    return pd.DataFrame({"table_name": [key[0]], "range": [key[1]], "part": [0], "occurrences": [add("occurrences")], "records": [add("records")]})


def term_counts(tables: Mapping[str, tuple[DataFrame, list[str], str, str]], rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """table_name, term, occurrences, records, term_mark for every distinct term of each table.

    ``tables`` maps a name to (rows, key columns, column of the terms, time of loading). A record that came again (same
    key) counts once, as first loaded; rows whose key has nulls are compared null to null. Null and empty arrays and
    elements hold no term, but their records count in the size of the table. A term twice in one record is two
    occurrences in one record. 'rare': in fewer than ``rare`` records; otherwise 'common': in more than ``common`` of
    all records of the table; else null. Empty tables give no rows.

    Records are cut into blocks of about ``BLOCK_ROWS`` by the hash of their key, so a term that is in a third of all
    records is in many blocks. One global dictionary gives the distinct terms of all blocks dense identifiers; every
    block encodes its records with those of its own terms and accumulates one count array for occurrences and one for
    record presence over each range of identifiers; the arrays are added by range, in two steps.
    """
    rows = None
    for name, (df, key, terms, loaded) in tables.items():
        keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
        once = df.groupBy(*keys).agg(F.min(F.struct(F.col(loaded), F.col(terms).alias("keywords"))).alias("r"))
        part = once.select(F.lit(name).alias("table_name"), F.xxhash64(F.lit(name), *[c for c in once.columns if c != "r"]).alias("h"), "r.keywords")
        rows = part if rows is None else rows.unionByName(part)
    rows, _ = written(rows)
    sizes = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("size"))
    n = rows.count()
    blocks = rows.select("table_name", F.pmod("h", F.lit(max(MIN_BLOCKS, n // BLOCK_ROWS))).alias("block"), "keywords")
    held = blocks.where(F.size("keywords") > 0).select("block", "keywords").mapInPandas(_distinct_terms, "block long, term string").distinct()
    held, _ = written(held)
    words = checkpointed(_dictionary(held))
    encoded = held.join(words, "term")
    arrays = blocks.where(F.size("keywords") > 0).groupBy("block").cogroup(encoded.groupBy("block")).applyInPandas(_encoded, _ARRAYS)
    for by in (["table_name", "range", "part"], ["table_name", "range"]):
        arrays = arrays.groupBy(*by).applyInPandas(_added, _ARRAYS)
    cells = arrays.select("table_name", "range", F.posexplode(F.arrays_zip("occurrences", "records")).alias("at", "n")).where("n.occurrences > 0")
    sums = cells.select("table_name", (F.col("range") * RANGE + F.col("at")).alias("id"), "n.occurrences", "n.records")
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.col("size") * common, "common")
    return sums.join(words, "id").join(F.broadcast(sizes), "table_name").select("table_name", "term", "occurrences", "records", mark.alias("term_mark"))  # sizes: one row per table
