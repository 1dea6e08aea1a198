"""Models as injected functions: loaded once in each Python worker, fed with Arrow batches, never named here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(column: Column, factory: Callable[[], Callable[[Sequence], np.ndarray]], batch: int = 64) -> Column:
    """array<float>: ``factory()`` gives, once in a worker, a function from values (texts, image bytes) to row vectors.

    Nulls give null and are not passed to the model; vectors come out with length 1 (over max(length, 1e-12)).
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            out: list = [None] * len(part)
            held = [i for i, v in enumerate(part) if v is not None]
            for at in range(0, len(held), batch):
                rows = held[at : at + batch]
                v = np.asarray(model([part.iloc[i] for i in rows]), np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, x in zip(rows, v.astype(np.float32)):
                    out[i] = x
            yield pd.Series(out, dtype=object)

    return run(column)


def expand(df: DataFrame, key: str, factory: Callable[[], Callable[[object], list[tuple]]], columns: str, source: str) -> DataFrame:
    """A row for each thing a model finds in a row's ``source``: shots of a video, pieces of a transcript.

    ``columns`` is the schema of the found tuples. Null sources find nothing. Nothing is shuffled; a row's result is
    given out before the next row is read.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            for k, v in zip(part["k"], part["v"]):
                if v is not None:
                    rows = [(k, *r) for r in model(v)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["k", *names], dtype=object)

    found = df.select(F.col(key).cast("string").alias("k"), F.col(source).alias("v")).mapInPandas(run, f"k string, {columns}")
    return found.select(F.col("k").cast(dict(df.dtypes)[key]).alias(key), *names)


def ask_until_valid(provider: Callable[[str, str | None], object], validate: Callable[[object], object], question: str, retries: int = 3) -> object:
    """The validated answer of a provider; after a failed validation it is asked again with the validator's message.

    Raises the last error after ``retries`` further attempts.
    """
    said = None
    for attempt in range(retries + 1):
        try:
            return validate(provider(question, said))
        except ValueError as e:
            said = str(e)
            if attempt == retries:
                raise
    raise AssertionError("not reached")


def valid_tags(chosen: Sequence, vocab: Sequence[int], most: int = 5) -> list[int]:
    """The chosen tags that are whole numbers of the vocabulary, each once, in order, ``most`` of them."""
    known, out = set(vocab), []
    for t in chosen:
        try:
            n = int(t)
        except (TypeError, ValueError):
            continue
        if n in known and n not in out:
            out.append(n)
    return out[:most]
