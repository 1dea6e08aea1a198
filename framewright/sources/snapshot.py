"""Immutable, versioned snapshots: written once, checked whole before they serve, swapped by pointer."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.expr import SENTINEL_TAG, l2_norm
from framewright.sources.files import SHARD_ROWS, file_hashes

NORM_TOLERANCE = 1e-3


class SnapshotError(ValueError):
    """A snapshot that must not serve."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise SnapshotError(f"missing: {path}")
    return "\n".join(r.value for r in spark.read.text(path).collect())


def write_snapshot(points: DataFrame, root: str, version: int, *, encoder: str, dim: int, groups: list[str] | None = None, expected: int | None = None, vocab: DataFrame | None = None) -> str:
    """Writes ``root``/v=<version>: Parquet of the points, the vocabulary, and a manifest with a checksum of every file.

    The folder must not exist. ``points`` has point_id, vector and any payload; deleted (false) and tag (unassigned) are
    added where they lack. A count other than ``expected`` is an error before the manifest, so the folder never serves.
    """
    spark, path = points.sparkSession, f"{root}/v={version:09d}"
    full = points
    if "deleted" not in full.columns:
        full = full.withColumn("deleted", F.lit(False))
    if "tag" not in full.columns:
        full = full.withColumn("tag", F.lit(None).cast("int"))
    full.write.mode("errorifexists").option("maxRecordsPerFile", SHARD_ROWS).parquet(f"{path}/points")
    if vocab is not None:
        vocab.write.mode("errorifexists").parquet(f"{path}/vocab")
    count = spark.read.parquet(f"{path}/points").count()
    if expected is not None and count != expected:
        raise SnapshotError(f"{count} points written, {expected} expected")
    manifest = {"version": version, "count": count, "dim": dim, "encoder": encoder, "metric": "cosine", "groups": sorted(groups or []), "checksums": _checksums(spark, path)}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return path


def _checksums(spark: SparkSession, path: str) -> dict[str, str]:
    rows = file_hashes(spark, path, "*.parquet").collect()  # one short row for each file
    return {"/".join(r.path.split("/")[-2:]): r.sha256 for r in rows}


def merge_checksums(old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """The old entries with new and changed ones over them."""
    return {**old, **new}


@dataclass
class Snapshot:
    """A snapshot that passed all checks."""

    path: str
    manifest: dict
    points: DataFrame
    vocab: DataFrame | None
    warnings: list[str] = field(default_factory=list)

    def info(self) -> dict:
        return {k: self.manifest[k] for k in ("version", "count", "dim", "encoder", "metric", "groups")}

    def live(self) -> DataFrame:
        return self.points.where(~F.col("deleted"))

    def tag_vocab(self) -> DataFrame:
        """tag, name, description, n of the live points."""
        counts = self.live().groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
        if self.vocab is None:
            return counts.where("tag is not null")
        return self.vocab.join(counts, "tag", "left").na.fill(0, ["n"])


def load_snapshot(spark: SparkSession, path: str, *, dim: int = 0, encoder: str = "", checksums: bool = True) -> Snapshot:
    """Reads and checks a snapshot; any broken invariant raises ``SnapshotError``.

    Checked: the manifest and its contract (dim and encoder, where given), every listed file's checksum and no file
    missing, the count, ids unique and not null, every vector's size and norm (none sampled), tags in 0..65534 and in the
    vocabulary. One pass over the points for all of it.
    """
    manifest = json.loads(_read_text(spark, f"{path}/manifest.json"))
    if missing := [k for k in ("version", "count", "dim", "encoder", "checksums") if k not in manifest]:
        raise SnapshotError(f"manifest lacks {missing}")
    if dim and manifest["dim"] != dim:
        raise SnapshotError(f"dim {manifest['dim']}, wanted {dim}")
    if encoder and manifest["encoder"] != encoder:
        raise SnapshotError(f"encoder {manifest['encoder']}, wanted {encoder}")
    if checksums:
        if not manifest["checksums"]:
            raise SnapshotError("no file is listed")
        there = _checksums(spark, path)
        for name, want in manifest["checksums"].items():
            if there.get(name) != want:
                raise SnapshotError(f"checksum of {name}")
    points = spark.read.parquet(f"{path}/points")
    fs, p = _fs(spark, f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab") if fs.exists(p) else None
    sized = F.coalesce(F.size("vector") == manifest["dim"], F.lit(False))
    off = sized & F.coalesce(F.abs(l2_norm(F.col("vector")) - 1) > NORM_TOLERANCE, F.lit(True))
    bad_tag = F.col("tag").isNotNull() & ~F.col("tag").between(0, SENTINEL_TAG - 1)
    r = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("point_id").isNull()).alias("nulls"), F.count_if(~sized).alias("sizes"), F.count_if(off).alias("norms"), F.count_if(bad_tag).alias("tags")).first()
    for name, wrong in (("count", r.n != manifest["count"]), ("null ids", r.nulls), ("vector sizes", r.sizes), ("vector norms", r.norms), ("tag range", r.tags)):
        if wrong:
            raise SnapshotError(f"{name}: {dict(r.asDict())}")
    if points.groupBy("point_id").count().where("count > 1").limit(1).count():
        raise SnapshotError("repeated ids")
    if vocab is not None and points.where("tag is not null").select("tag").distinct().join(vocab, "tag", "left_anti").limit(1).count():
        raise SnapshotError("tags outside the vocabulary")
    return Snapshot(path, manifest, points, vocab)


def missing_videos(snapshot: Snapshot, expected: DataFrame) -> DataFrame:
    """The expected videos that no point has."""
    return expected.select("video_name").distinct().join(snapshot.points.select("video_name").distinct(), "video_name", "left_anti")


class Holder:
    """The snapshot that serves. A new one is loaded and checked first and then takes its place; one load at a time."""

    def __init__(self):
        self._current: Snapshot | None = None
        self._lock = threading.Lock()

    def get(self) -> Snapshot:
        if self._current is None:
            raise SnapshotError("no snapshot is loaded")
        return self._current

    def load_and_swap(self, spark: SparkSession, path: str, **contract) -> Snapshot:
        if not self._lock.acquire(blocking=False):
            raise SnapshotError("a load is under way")
        try:
            fresh = load_snapshot(spark, path, **contract)
            self._current = fresh
            return fresh
        finally:
            self._lock.release()
