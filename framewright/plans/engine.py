"""The service's calls as functions over a snapshot: search, encode, tags, neighbours, health, counters."""

from __future__ import annotations

import time
from collections import Counter, deque
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import search as S
from framewright.operators.scenes import neighbours
from framewright.operators.tags import check_tags
from framewright.sources.snapshot import Holder
from framewright.streaming.streams import search_stream

DEFAULT_K, MOST_K, CORE_K, SAMPLES = 20, 300, 10, 4096


def clamp_k(asked: int | None, default: int = DEFAULT_K, most: int = MOST_K) -> int:
    """The asked number of hits, or the default, and never more than ``most``."""
    return min(asked or default, most)


class Engine:
    """Serves one snapshot at a time. ``encode`` turns texts into unit vectors; ``choose_tags`` may pick tags for a text."""

    def __init__(self, spark: SparkSession, encode: Callable[[Sequence[str]], np.ndarray], choose_tags: Callable[[str, DataFrame], Sequence[int]] | None = None):
        self.spark, self.encode, self.choose_tags = spark, encode, choose_tags
        self.holder = Holder()
        self.started, self.counts = time.time(), Counter()
        self.samples: dict[str, deque] = {}

    def load(self, path: str, **contract) -> dict:
        """Loads, checks and swaps in a snapshot."""
        return self.holder.load_and_swap(self.spark, path, **contract).info()

    def search(self, text: str | None = None, vector: Sequence[float] | None = None, *, top_k: int | None = None, tags: Sequence[int] | None = None, where: Column | None = None, min_score: float | None = None, max_per_video: int = 0, min_gap: float = 0.0, dedup: float = 0.0, payload: Sequence[str] = ("video_name", "frame")) -> tuple[DataFrame, dict]:
        """Hits (point_id, score, rank, payload) and what was done: strategy, candidates, tags used, warnings, corpus.

        Deleted points and filters are applied before ranking, min_score after the cut, diversity after that; the payload
        is joined to the hits only. A failing tag choice gives an untagged search with a warning.
        """
        snap, began, warnings = self.holder.get(), time.time(), []
        if (text is None) == (vector is None) or (text is not None and not text.strip()):
            raise ValueError("one text that is not empty, or one vector")
        q = np.asarray(self.encode([text])[0] if vector is None else vector, float)
        if len(q) != snap.manifest["dim"]:
            raise ValueError(f"the query has {len(q)} values, the snapshot {snap.manifest['dim']}")
        if tags is None and text is not None and self.choose_tags:
            try:
                tags = list(self.choose_tags(text, snap.tag_vocab()))
            except Exception as e:  # noqa: BLE001 - whatever fails there must not fail the search
                warnings.append(f"tags: {e}")
        live, test = snap.live(), where
        if tags:
            top = live.agg(F.max("tag")).first()[0]
            used = check_tags(list(tags), -1 if top is None else top)
            in_tags = F.coalesce(F.col("tag").isin(used), F.lit(False))
            test = in_tags if test is None else test & in_tags
        k = clamp_k(top_k)
        hits, meta = S.search(live, q, k, test, min_score)
        if "tag_fallback" in meta["warnings"]:
            tags = None
        extra = [c for c in dict.fromkeys([*payload, *(["video_name", "keyframe_time"] if max_per_video or min_gap or dedup else [])]) if c in live.columns]
        # at most k rows
        full = live.select("point_id", *extra, "vector").join(F.broadcast(hits.select("point_id", "score", "rank")), "point_id")
        if max_per_video or min_gap or dedup:
            kept = S.diversify(full, k, max_per_video, min_gap, dedup).select("point_id", "score", F.col("rank").alias("rank"))
            full = live.select("point_id", *extra, "vector").join(F.broadcast(kept), "point_id")
        self._note(meta["strategy"], time.time() - began)
        meta |= {"tags_used": list(tags or []), "warnings": warnings + meta["warnings"], "corpus": snap.manifest["count"], "version": snap.manifest["version"]}
        return full.select("point_id", "score", "rank", *[c for c in payload if c in live.columns]).orderBy("rank"), meta

    def search_batch(self, queries: DataFrame, k: int = CORE_K) -> DataFrame:
        return S.batch_topk(self.holder.get().live(), queries, k)

    def encode_batch(self, texts: Sequence[str]) -> np.ndarray:
        """The vectors of some texts; an empty text is an error."""
        if any(not t or not t.strip() for t in texts):
            raise ValueError("texts that are not empty")
        return np.asarray(self.encode(list(texts)), float) if len(texts) else np.zeros((0, self.holder.get().manifest["dim"]))

    def search_stream(self, vector: Sequence[float], k: int = CORE_K):
        """The coarse result at once, then the exact one."""
        return search_stream(self.holder.get().live(), vector, k)

    def temporal(self, steps: Sequence[Sequence[float]], min_gap: float, max_gap: float, k: int = CORE_K, candidates: int = MOST_K, optional: Sequence[int] = ()) -> DataFrame:
        """The best chains of one hit of each step, in order, within a video: every step is a search of its own.

        Steps whose number is in ``optional`` may be missing from a chain; such chains come from the steps that are left.
        """
        live, kinds = self.holder.get().live(), [f"step{i}" for i in range(len(steps))]
        events = None
        for kind, q in zip(kinds, steps):
            hits = S.exact_topk(live, q, candidates, ("video_name", "keyframe_time"))
            part = hits.select("video_name", F.lit(kind).alias("kind"), F.col("keyframe_time").alias("at"), "score", F.col("point_id").alias("event_id"))
            events = part if events is None else events.unionByName(part)
        return S.optional_chains(events, "video_name", kinds, [kinds[i] for i in optional], min_gap, max_gap, k)

    def feedback(self, vector: Sequence[float], liked: Sequence[int], disliked: Sequence[int] = (), k: int = CORE_K) -> DataFrame:
        """The search moved to the liked points and away from the disliked ones."""
        live = self.holder.get().live()
        of = lambda ids: live.where(F.col("point_id").isin(list(ids)))
        return S.exact_topk(live, S.rocchio(vector, of(liked), of(disliked)), k)

    def reset_stats(self) -> None:
        """Counts, samples and uptime begin anew."""
        self.started, self.counts, self.samples = time.time(), Counter(), {}

    def similar(self, point_id: int, k: int = CORE_K, exclude_same_video: bool = True) -> DataFrame:
        """The points most like a point, without itself (and its video)."""
        live = self.holder.get().live()
        row = live.where(F.col("point_id") == point_id).select("vector", "video_name").first()
        if row is None:
            raise KeyError(point_id)
        rest = live.where(F.col("point_id") != point_id)
        return S.exact_topk(rest.where(F.col("video_name") != row.video_name) if exclude_same_video else rest, row.vector, k)

    def grouped(self, vector: Sequence[float], groups: int, size: int, by: str = "video_name") -> DataFrame:
        scored = S.cosine_to(self.holder.get().live().select("point_id", by, "vector"), "vector", vector)
        return S.grouped_topk(S.once(scored), by, groups, size)

    def neighbours(self, video: str, frame: int, before: int = 25, after: int = 25) -> DataFrame:
        """The frames around one frame of a video; an unknown frame is an error."""
        frames = self.holder.get().points.where(F.col("video_name") == video)
        anchor = frames.where(F.col("frame") == frame).select("video_name", F.col("frame").alias("anchor_frame"))
        if not anchor.limit(1).count():
            raise KeyError(f"{video}#{frame}")
        return neighbours(frames, "video_name", anchor, before, after)

    def tags(self) -> DataFrame:
        return self.holder.get().tag_vocab()

    def health(self) -> dict:
        try:
            return {"ready": True} | self.holder.get().info()
        except ValueError:
            return {"ready": False}

    def _note(self, strategy: str, seconds: float) -> None:
        self.counts[strategy] += 1
        self.samples.setdefault("search", deque(maxlen=SAMPLES)).append(seconds)

    def stats(self) -> dict:
        """Counts by strategy, uptime, and latency percentiles of the last samples (0 without any)."""
        out = {"queries_by_strategy": dict(self.counts), "queries": sum(self.counts.values()), "uptime": time.time() - self.started}
        for stage, s in self.samples.items():
            out[stage] = dict(zip(("p50", "p95", "p99"), np.percentile(list(s), (50, 95, 99)).tolist())) if s else dict.fromkeys(("p50", "p95", "p99"), 0.0)
        return out
