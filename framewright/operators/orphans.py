"""References whose target is missing, deleted or late, for keys of one or more columns with nulls in any of them."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def same_key(column: str, is_text: bool) -> Column:
    """The form in which keys are compared: text regardless of case and outer white space; empty text stays a key."""
    c = F.col(column)
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) if is_text else c.cast("long")


def first_loaded(df: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """One row for each ``key``: as first loaded (ties: the smallest row)."""
    return df.groupBy(*key).agg(F.min(F.struct(F.col(time), *[F.col(c) for c in columns if c != time and c not in key])).alias("__r")).select(*key, "__r.*")


def orphan_references(refs: DataFrame, targets: DataFrame, keys: Mapping[str, str], row_id: str, loaded: str, arrived: str, deleted: str | None = None, match: str = "simple") -> DataFrame:
    """The references in ``refs`` that find no target, only deleted ones, or only ones that arrived later.

    ``keys`` maps each referring column to its target column. References are grouped by the mask of their null key
    columns, and every mask is resolved on its non-null columns only. ``match`` says what a partly null key means, as
    in SQL: 'simple': nothing is referred to; 'partial': any target that agrees on the other columns will do; 'full':
    it is an orphan. A wholly null key never refers to anything. A repeated reference (same ``row_id``) counts once, as
    first loaded; of several targets with one key a live one wins, and of the live ones the first to arrive.

    Keys are resolved once for each distinct key; the few keys that have orphans are then joined to the references
    with a salt, so a key that holds a third of all references is spread over tasks. Rows without a row id cannot be
    told to be repeated; each counts. Columns: row_id, orphan_kind ('missing', 'deleted', 'late'), loaded.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    columns = list(keys)
    text = {c: dict(refs.dtypes)[c] == "string" for c in columns}
    names = [f"k{i}" for i in range(len(columns))]
    flat = refs.select(F.col(row_id).alias("row_id"), F.col(loaded).alias("loaded"), *[same_key(c, text[c]).alias(n) for c, n in zip(columns, names)])
    unnamed = flat.where("row_id is null")
    flat = first_loaded(flat.where("row_id is not null"), ["row_id"], "loaded", ["loaded", *names]).select(*flat.columns).unionByName(unnamed)
    there = targets.select(F.col(arrived).alias("arrived"), (F.col(deleted).isNotNull() if deleted else F.lit(False)).alias("deleted"), *[same_key(t, text[c]).alias(n) for n, (c, t) in zip(names, keys.items())])
    out = None
    for mask in product((True, False), repeat=len(names)):
        held = [n for n, on in zip(names, mask) if on]
        if not held or (len(held) < len(names) and match == "simple"):
            continue
        group = flat
        for n, on in zip(names, mask):
            group = group.where(F.col(n).isNotNull() if on else F.col(n).isNull())
        if len(held) < len(names) and match == "full":
            bad = group.select("row_id", F.lit("missing").alias("orphan_kind"), "loaded")
        else:
            ours = group.groupBy(*held).agg(F.max(F.lit(1)).alias("used"), F.min("loaded").alias("first"))
            live = F.when(~F.col("deleted"), F.col("arrived"))
            known = there.where(" and ".join(f"{n} is not null" for n in held)).groupBy(*held).agg(F.min("deleted").alias("gone"), F.min(live).alias("since"))
            state = ours.join(known, held, "left").where("gone is null or gone or since > first")
            salted = state.select(*held, "gone", "since", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            kind = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("since") > F.col("loaded"), "late")
            bad = group.withColumn("salt", F.pmod(F.xxhash64("row_id", "loaded"), F.lit(SALTS)).cast("int")).join(salted, [*held, "salt"]).select("row_id", kind.alias("orphan_kind"), "loaded").where("orphan_kind is not null")
        out = bad if out is None else out.unionByName(bad)
    return out


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """How many orphans of each kind a table has in each month of loading (null loading times in month null)."""
    return orphans.groupBy(F.lit(table).alias("ref_field"), "orphan_kind", F.date_format("loaded", "yyyy-MM").alias("load_month")).agg(F.count(F.lit(1)).alias("n"))
