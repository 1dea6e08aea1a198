"""Collections of versioned snapshots: versions, aliases, compaction."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.snapshot import SnapshotError, _fs, _read_text, _write_text, load_snapshot, write_snapshot


class Catalog:
    """Collections below one folder: <root>/<collection>/v=<n>, and <root>/aliases.json."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def collections(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def versions(self, collection: str) -> list[int]:
        """The versions that have a manifest, oldest first."""
        fs, p = _fs(self.spark, f"{self.root}/{collection}")
        if not fs.exists(p):
            return []
        jvm = self.spark.sparkContext._jvm
        found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
        return sorted(int(q.getName()[2:]) for q in found if fs.exists(jvm.org.apache.hadoop.fs.Path(q, "manifest.json")))

    def add(self, collection: str, points: DataFrame, **contract) -> int:
        """Writes the next version and returns its number."""
        n = max(self.versions(collection), default=0) + 1
        write_snapshot(points, f"{self.root}/{collection}", n, **contract)
        return n

    def open(self, name: str, version: int | None = None, **contract):
        """The checked snapshot of a collection or alias, by default its newest version."""
        collection = self.aliases().get(name, name)
        there = self.versions(collection)
        if not there or (version is not None and version not in there):
            raise SnapshotError(f"{collection} has no version {version or ''}")
        return load_snapshot(self.spark, f"{self.root}/{collection}/v={version or there[-1]:09d}", **contract)

    def aliases(self) -> dict[str, str]:
        try:
            return json.loads(_read_text(self.spark, f"{self.root}/aliases.json"))
        except SnapshotError:
            return {}

    def set_alias(self, alias: str, collection: str) -> None:
        """Points an alias at a collection that has a version; readers see it with their next ``open``."""
        if not self.versions(collection):
            raise SnapshotError(f"{collection} has no version")
        _write_text(self.spark, f"{self.root}/aliases.json", json.dumps({**self.aliases(), alias: collection}, sort_keys=True))

    def optimize(self, collection: str) -> int:
        """A new version without the deleted points; old versions stay until they are dropped."""
        snap = self.open(collection)
        m = snap.manifest
        return self.add(collection, snap.live().withColumn("deleted", F.lit(False)), encoder=m["encoder"], dim=m["dim"], groups=m["groups"], vocab=snap.vocab)

    def drop(self, collection: str, keep: int = 0) -> None:
        """Removes a collection, or all of its versions but the newest ``keep``."""
        there = self.versions(collection)
        fs, p = _fs(self.spark, f"{self.root}/{collection}")
        if keep == 0:
            fs.delete(p, True)
            return
        for n in there[:-keep]:
            fs.delete(_fs(self.spark, f"{self.root}/{collection}/v={n:09d}")[1], True)
