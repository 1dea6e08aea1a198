"""Column expressions that stay inside the JVM, and Arrow functions for what Spark has no expression for."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

SENTINEL_TAG = 65535


# vectors


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """``v`` over max(length, 1e-12)."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(l2_norm(v), F.lit(1e-12)))


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of an array column with ``dim`` finite values that are not all zero, and their indices."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    held = np.flatnonzero(lengths == dim)
    x = column.take(pa.array(held)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], held[good]


def cosine_to(df: DataFrame, vector: str, query: np.ndarray, out: str = "score", then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The rows of ``df`` with a usable vector, and their cosine with ``query`` to 6 decimals; the vector column is dropped.

    One matrix product per Arrow batch; nothing is shuffled. Rows whose vector is null, has another size, holds a null,
    NaN or infinite value, or is all zero are left out. ``then`` goes over the scored batches of each task, in the same pass.
    """
    q = np.asarray(query, np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    rest = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = matrix_of(batch.column(len(rest)), len(q))
            score = np.round(x @ q / np.maximum(np.linalg.norm(x, axis=1), 1e-12), 6)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(rest))), pa.array(score)], [*rest, out])

    plain = df.select(*rest, vector)
    both = run if then is None else lambda batches: then(run(batches))
    return plain.mapInArrow(both, plain.select(*rest, F.lit(0.0).alias(out)).schema)


def usable(df: DataFrame, vector: str = "vector", dim: int = 64) -> DataFrame:
    """The rows whose vector has ``dim`` finite values that are not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0))


def sq8(v: Column) -> Column:
    """8-bit scalar codes of a unit vector: floor(x * 127 + 0.5) in -127..127."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 127 + 0.5), F.lit(-127)), F.lit(127)).cast("int"))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean of the vectors of each key, over max(length, 1e-12), 6 decimals; positions are averaged in the JVM."""
    cells = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("v"))
    return whole.select(*keys, F.transform(l2_normalize(F.col("v")), lambda x: F.round(x, 6)).alias(vector))


# bits and ids


def point_id(video_id: Column, frame: Column) -> Column:
    """video_id << 32 | frame."""
    return F.shiftleft(video_id.cast("long"), 32).bitwiseOR(frame.cast("long"))


def bit_is_clear(bits: Column, row: Column) -> Column:
    """Whether bit ``row`` (least significant first) of a binary bit set is 0; rows beyond it are clear."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(row / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", F.coalesce(byte, F.lit(0)), F.pmod(row, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 0


@F.pandas_udf(LongType())
def blake2_point_id(name: pd.Series, frame: pd.Series) -> pd.Series:
    """63 bits of BLAKE2b over 'name:frame'; null if either is null."""
    ids = [None if n is None or f is None or f != f else int.from_bytes(hashlib.blake2b(f"{n}:{int(f)}".encode(), digest_size=8).digest(), "big") & (2**63 - 1) for n, f in zip(name, frame)]
    return pd.Series(ids, dtype="Int64")


def djb2(s: Column) -> Column:
    """The 32-bit hash h = h * 33 ^ c over the characters of ``s`` (those of the basic plane; others count as one)."""
    step = lambda h, c: (h * 33).bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(5381).cast("long"), step)


# text


def canonicalize(text: Column) -> Column:
    """Underscores to blanks, no ASCII punctuation, lower case, single blanks, trimmed."""
    bare = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC with single blanks, trimmed; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def keyword_form(keyword: str | None) -> str:
    """NFC, trimmed, single blanks, case-folded; empty for null."""
    return " ".join(unicodedata.normalize("NFC", keyword).split()).casefold() if keyword else ""


def normalize_keywords(keywords: Column, most: int = 4) -> Column:
    """The ``keyword_form`` of each keyword, without empty ones, each once in order of first use, ``most`` of them.

    A null array stays null. Spark has no expression for NFC, so an Arrow batch at a time goes through Python.
    """

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        form = lru_cache(1 << 16)(keyword_form)
        return pd.Series([None if a is None else list(dict.fromkeys(f for k in a if (f := form(k))))[:most] for a in arrays], dtype=object)

    return run(keywords)


def to_seconds(value: Column) -> Column:
    """Seconds of '12.5', 'HH:MM:SS.fff' and 'HH:MM:SS:ms'; null for what is none of them."""
    p = F.split(F.trim(value), ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    clock = n(1) * 3600 + n(2) * 60 + n(3)
    return F.when(F.size(p) == 4, clock + n(4) / 1000).when(F.size(p) == 3, clock).when(F.size(p) == 1, n(1))


def natural_key(text: Column, width: int = 12) -> Column:
    """A key that sorts runs of digits by value: each run padded to ``width``; longer runs stay whole."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, F.greatest(F.length(x), F.lit(width)), F.lit("0"))).otherwise(x)), "")


def frame_of_key(key: Column) -> Column:
    """The number before '.webp' at the end of a key, else null."""
    got = F.regexp_extract(key, r"(\d+)\.webp$", 1)
    return F.when(got != "", got.cast("long"))


def strip_prefix(url: Column, prefix: Column) -> Column:
    """``url`` without ``prefix`` and the slash after it."""
    return F.when(url.startswith(prefix), F.regexp_replace(F.substring(url, F.length(prefix) + 1, F.length(url)), "^/", "")).otherwise(url)


def scene_source_parts(key: Column) -> Column:
    """struct(group_name, video_name) of '<group>/keyscence/<video>/scenes.json'; null for other keys."""
    p = F.split(key, "/")
    good = (F.size(p) == 4) & (F.get(p, F.lit(1)) == "keyscence") & (F.get(p, F.lit(3)) == "scenes.json")
    return F.when(good, F.struct(F.regexp_replace(F.get(p, F.lit(0)), "^Keyscence_", "").alias("group_name"), F.get(p, F.lit(2)).alias("video_name")))


def stable_hash(fields: dict[str, Column]) -> Column:
    """sha256 of the JSON object of ``fields`` with sorted keys, without blanks; nulls are kept as null."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def json_tags(text: Column, most: int = 5) -> Column:
    """The distinct integers in "tags" of the JSON object inside ``text`` (first brace to last); empty if there is none."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tags = F.from_json(F.get_json_object(body, "$.tags"), "array<string>")
    whole = F.filter(F.transform(tags, lambda t: t.try_cast("int")), lambda t: t.isNotNull())
    return F.coalesce(F.slice(F.array_distinct(whole), 1, most), F.array().cast("array<int>"))


def speech_segments(answer: Column, plain: Column | None = None) -> Column:
    """array<struct(start, end, text)> in seconds of a recogniser's answer, which is a JSON list or ``plain`` text.

    A segment has text or decode, start, and perhaps end (else its start); segments without text are dropped. Plain text is
    one segment without times.
    """
    listed = F.from_json(answer, "array<struct<start:string,end:string,text:string,decode:string>>")
    text = lambda x: F.trim(F.coalesce(F.nullif(x["text"], F.lit("")), x["decode"], F.lit("")))
    at = lambda x: F.coalesce(to_seconds(x), F.lit(0.0))
    whole = F.transform(listed, lambda x: F.struct(at(x["start"]).alias("start"), at(F.coalesce(x["end"], x["start"])).alias("end"), text(x).alias("text")))
    kept = F.coalesce(F.filter(whole, lambda x: x["text"] != ""), F.array().cast("array<struct<start:double,end:double,text:string>>"))
    if plain is None:
        return kept
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.trim(plain).alias("text")))
    return F.when(plain.isNotNull(), one).otherwise(kept)


def prune_json(text: Column, drop: tuple[str, ...] = ("title", "default")) -> Column:
    """JSON text without the keys in ``drop`` at any depth; broken JSON gives null."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if k not in drop}
        return [clean(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(text)


def text_encoder(dim: int = 32):
    """A stand-in encoder: a unit vector that depends on the text only. Models are passed in its place."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for t in part:
                if t is None:
                    out.append(None)
                    continue
                seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
                v = np.random.default_rng(seed).standard_normal(dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return encode


def region_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes struct(x, y, w, h); 0 for empty boxes."""
    side = lambda o, s: F.greatest(F.lit(0.0), F.least(a[o] + a[s], b[o] + b[s]) - F.greatest(a[o], b[o]))
    common = side("x", "w") * side("y", "h")
    return F.coalesce(F.try_divide(common, a["w"] * a["h"] + b["w"] * b["h"] - common), F.lit(0.0))


# media and addresses


def frame_seconds(frame: Column, fps: Column) -> Column:
    """Seconds of a frame to 3 decimals; null without a positive rate."""
    return F.when(fps > 0, F.round(frame / fps, 3))


def even_width(width: Column, height: Column, out_height: Column) -> Column:
    """The even width that keeps the aspect ratio at a new height; halves are rounded to even."""
    return (F.bround(width * out_height / height / 2) * 2).cast("int")


def object_url(base: Column, *parts: Column) -> Column:
    """The address of an object below a base, with single slashes; null if any part is null."""
    path = F.concat(*[x for p in parts for x in (F.lit("/"), F.regexp_replace(p, "^/+|/+$", ""))])
    return F.concat(F.regexp_replace(base, "/+$", ""), path)


def file_name(index: Column, width: int, suffix: str) -> Column:
    """'000012.webp': a number padded to ``width`` with a suffix."""
    return F.concat(F.lpad(index.cast("string"), width, "0"), F.lit(suffix))


def parse_answer(text: Column) -> Column:
    """struct(kind, video, answer, ms) of a submitted line: 'TR-<video>-<ms>,...' or 'QA-<answer>-<video>-<ms>'; else nulls."""
    chain = r"^TR-(.+)-(\d+(?:,\d+)*)$"
    qa = r"^QA-(.*)-([^-]+)-(\d+)$"
    is_tr, is_qa = text.rlike(chain), text.rlike(qa)
    times = F.when(is_tr, F.regexp_extract(text, chain, 2)).when(is_qa, F.regexp_extract(text, qa, 3))
    return F.struct(
        F.when(is_tr, "trake").when(is_qa, "qa").alias("kind"),
        F.when(is_tr, F.regexp_extract(text, chain, 1)).when(is_qa, F.regexp_extract(text, qa, 2)).alias("video"),
        F.when(is_qa, F.regexp_extract(text, qa, 1)).alias("answer"),
        F.transform(F.split(times, ","), lambda x: x.cast("long")).alias("ms"),
    )
