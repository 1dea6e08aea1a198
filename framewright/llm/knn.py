"""The most similar vectors of every vector: NN-descent on a neighbour graph, and greedy search in that graph.

NN-descent joins the neighbours of neighbours, round by round, until few lists change. The join is laid out by regions
of about ``REGION_ROWS`` vectors. Where both ends of a pair share a region they are joined in the task that holds its
vectors, so a round moves nothing: lists start from small cells around random pivots, and in each round a sample of every
point's new neighbours, forward and reverse, is paired with its new and old ones. A vector near a border is in two
regions, so the graphs of the regions hang together; across regions Spark joins the graph with itself by id, scores the
pairs that no region has compared, and merges them into the lists, until few lists change. Only vectors of such pairs
travel again.

Centres are fitted on a bounded sample (``MAX_SAMPLE`` vectors); every row is indexed. A centre whose share of the sample
means more than ``REGION_ROWS`` rows is cut further by hyperplanes, so regions do not grow with the data. Vectors
are moved as 4 bytes a value; similarities in the result are computed from them in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.session import bucketed, checkpointed, drop_bucketed

DIM, K = 64, 5
#: Rows of a region, and of a fine centre's cell.
REGION_ROWS, CELL_ROWS = 4096, 64
#: The sample for the centres (at least, at most), and its rows for each fine centre.
MIN_SAMPLE, MAX_SAMPLE, SAMPLE_PER_CELL = 20_000, 200_000, 7
#: So many fine centres, about, are compared with a vector: those under its nearest coarse centres.
PROBED_CELLS = 3000
#: A vector also visits its second nearest region if that centre is less similar by at most this.
BORDER = 0.08
#: Within regions: entries of a list, sampled new and old neighbours each way, rows of a starting cell, pivot draws.
LIST, SAMPLED, START_ROWS, STARTS = 12, 6, 12, 3
#: Rows of one block of similarities.
BLOCK = 2048
#: Descent ends when fewer than this share of the lists' entries changed; the number of rounds is only a safeguard.
SETTLED, MOST_ROUNDS = 0.001, 30
#: Bits of the filter that keeps vectors nobody asked for from being shuffled (1 MB, whatever the data).
FILTER_BITS = 1 << 23
SALTS = 16
#: Rows of a bucket of the graph.
PART_ROWS = 250_000


def _centres(x: np.ndarray, n: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(x[order], cut, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[near[order][cut][norm > 0]] = sums[norm > 0] / norm[norm > 0, None]
    return c


class Cells:
    """A partition of the unit sphere into regions of about ``rows`` of ``n`` vectors each, whatever ``n`` is.

    A vector belongs to the nearest of many fine centres (about ``fine_rows`` vectors each, as far as the sample carries
    them with ``SAMPLE_PER_CELL`` of its rows); centres near each other make a region, so tight groups stay together.
    A centre with more than a region's rows is cut by hyperplanes at the sample's medians, one for each doubling.
    Centres lie under coarse ones, of which a vector meets those nearest to it, about ``PROBED_CELLS`` centres.
    """

    def __init__(self, sample: np.ndarray, n: int, rows: int, fine_rows: int = CELL_ROWS):
        cells = max(1, min(n // fine_rows, len(sample) // SAMPLE_PER_CELL))
        self.coarse = _centres(sample, round(cells**0.5))
        near = np.argmax(sample @ self.coarse.T, axis=1)
        fine, start = [], [0]
        for g in range(len(self.coarse)):
            own = sample[near == g]
            fine.append(_centres(own, max(1, round(cells * len(own) / len(sample)))) if len(own) else self.coarse[g : g + 1])
            start.append(start[-1] + len(fine[-1]))
        self.fine, self.start = np.concatenate(fine), np.array(start)
        near = self._two_nearest(sample)[1][:, 0]
        regions = max(1, min(n // rows, len(self.fine)))
        region = np.arange(regions) if regions == len(self.fine) else np.argmax(self.fine @ _centres(self.fine, regions).T, axis=1)
        times = np.bincount(near, minlength=len(self.fine)) / len(sample) * n / rows
        self.bits = np.where(times > 2, np.ceil(np.log2(np.maximum(times, 1))), 0).astype(np.int64)
        self.planes = np.random.default_rng(5).standard_normal((int(self.bits.max()), sample.shape[1])).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=1, keepdims=True)
        self.cuts = np.zeros((len(self.fine), len(self.planes)), np.float32)
        for c in np.flatnonzero(self.bits):
            self.cuts[c] = np.median(sample[near == c] @ self.planes.T, axis=0)
        own = np.where(self.bits > 0, 1 << self.bits, 0)
        self.first = np.where(self.bits > 0, regions + np.cumsum(own) - own, region).astype(np.int64)
        self.size = regions + int(own.sum())

    def _two_nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers of the two nearest fine centres (-1: there is no second)."""
        n = len(x)
        best, which = np.full((n, 2), -2.0, np.float32), np.full((n, 2), -1, np.int64)
        probes = min(len(self.coarse), max(4, round(PROBED_CELLS * len(self.coarse) / len(self.fine))))
        groups = np.argpartition(-(x @ self.coarse.T), probes - 1, axis=1)[:, :probes]
        for g in np.unique(groups):
            of_g = np.flatnonzero((groups == g).any(axis=1))
            for at in range(0, len(of_g), BLOCK):
                rows = of_g[at : at + BLOCK]
                sims = x[rows] @ self.fine[self.start[g] : self.start[g + 1]].T
                for _ in range(min(2, sims.shape[1])):
                    j = np.argmax(sims, axis=1)
                    s = sims[np.arange(len(rows)), j]
                    sims[np.arange(len(rows)), j] = -3
                    first = s > best[rows, 0]
                    second = (s > best[rows, 1]) & ~first
                    down, only = rows[first], rows[second]
                    best[down, 1], which[down, 1] = best[down, 0], which[down, 0]
                    best[down, 0], which[down, 0] = s[first], j[first] + self.start[g]
                    best[only, 1], which[only, 1] = s[second], j[second] + self.start[g]
        return best, which

    def _place(self, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The regions of vectors under their centres, and the regions beyond the nearest hyperplane (-1: none near)."""
        cell, over = self.first[centre].copy(), np.full(len(centre), -1, np.int64)
        cut = np.flatnonzero(self.bits[centre])
        if len(cut):
            unused = np.arange(len(self.planes)) >= self.bits[centre[cut]][:, None]
            away = x[cut] @ self.planes.T - self.cuts[centre[cut]]
            side = ((away > 0) & ~unused) @ (1 << np.arange(len(self.planes), dtype=np.int64))
            cell[cut] += side
            away = np.where(unused, 9.0, np.abs(away))
            j = np.argmin(away, axis=1)
            over[cut] = np.where(away[np.arange(len(cut)), j] <= BORDER / 2, self.first[centre[cut]] + (side ^ (1 << j)), -1)
        return cell, over

    def assign(self, x: np.ndarray, border: float = BORDER) -> tuple[np.ndarray, np.ndarray]:
        """The region of each unit vector, and the next one if its border is near (else -1)."""
        best, which = self._two_nearest(x)
        home, other = self._place(x, which[:, 0])
        near = np.flatnonzero((which[:, 1] >= 0) & (best[:, 1] >= best[:, 0] - border))
        beyond = self._place(x[near], which[near, 1])[0]
        other[near] = np.where(beyond != home[near], beyond, other[near])
        return home, other


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of an array<float> column whose vectors all have ``dim`` values; a null value becomes NaN."""
    return column.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bytes(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _floats(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=np.float32).reshape(-1, dim) if len(flat) else np.zeros((0, dim), np.float32)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable: finite and not all zero."""
    wide = x.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        good = np.isfinite(norm) & (norm > 0)
        return wide / norm[:, None], good


def _sized(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.col("point_id").isNotNull() & (F.size("vector") == dim)).select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<float>").alias("vector"))


def _sample(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors for fitting centres, drawn by the hash of the id; never fewer than one if a row is usable."""
    want = max(MIN_SAMPLE, min(MAX_SAMPLE, n // 8))
    share = min(1.0, want / max(n, 1))
    # 2^53 classes of the hash: a share stays above 0 at any number of rows
    part = rows.where(F.pmod(F.xxhash64("point_id"), F.lit(1 << 53)) < int(share * (1 << 53))) if share < 1 else rows
    got = part.select("vector").limit(MAX_SAMPLE + MAX_SAMPLE // 10).toArrow()["vector"].combine_chunks()
    x, good = _unit(_matrix(got, dim))
    return x[good].astype(np.float32) if good.any() else np.eye(1, dim, dtype=np.float32)


def _first_of_copies(ids: np.ndarray, keys: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` smallest distinct ids of each key."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    fresh = new_key | np.r_[True, i[1:] != i[:-1]]
    order, k, new_key = order[fresh], k[fresh], None
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    rank = np.arange(len(k)) - np.repeat(starts, np.diff(np.r_[starts, len(k)]))
    return order[rank < keep]


def _copy_keys(x: np.ndarray) -> np.ndarray:
    """Equal numbers for rows of equal bytes, from 0."""
    return np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_inverse=True)[1].ravel()


def _to_cells(cells: Cells, dim: int, keep: int):
    """A row for each cell of each vector. Of equal vectors in one batch only the ``keep`` smallest ids go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            unit, good = _unit(x)
            rows = np.flatnonzero(good)
            rows = rows[_first_of_copies(ids[rows], _copy_keys(x[rows]), keep)] if len(rows) else rows
            home, next_to = cells.assign(unit[rows].astype(np.float32))
            away = np.flatnonzero(next_to >= 0)
            pick = np.r_[np.arange(len(rows)), away]
            cell = np.r_[home, next_to[away]]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[rows][pick], pa.int64()), pa.array(home[pick]), pa.array(next_to[pick]), _bytes(x[rows][pick])], ["cell", "point_id", "c1", "c2", "vec"])

    return run


def _ranked(row: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each row, by similarity (in millionths, falling) and id."""
    order = np.lexsort((ids, -sims, row))
    r = row[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    return order[rank < k]


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The position of each element within its run of equal numbers."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _starting_pairs(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pairs (2 rows of indices) within small cells: every vector goes to the nearest of some vectors drawn as pivots.

    Cells of many vectors are cut into runs by similarity to the pivot.
    """
    n, out = len(x), []
    for _ in range(STARTS):
        pivots = x[rng.choice(n, max(1, n // START_ROWS), replace=False)]
        cell, like = np.empty(n, np.int64), np.empty(n, np.float32)
        for at in range(0, n, BLOCK):
            sims = x[at : at + BLOCK] @ pivots.T
            cell[at : at + BLOCK], like[at : at + BLOCK] = sims.argmax(axis=1), sims.max(axis=1)
        order = np.lexsort((-like, cell))
        run = cell[order] * n + _ranks(cell[order]) // (2 * START_ROWS)
        place = _ranks(run)
        table = np.full((np.count_nonzero(place == 0), 2 * START_ROWS), -1)
        table[np.cumsum(place == 0) - 1, place] = order
        for i in range(1, table.shape[1]):
            for j in range(i):
                held = table[:, i] >= 0
                out.append(table[held][:, [j, i]].T)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


class _Lists:
    """The neighbour lists of one region while it descends: similarity falls along a row; -1 is an empty place."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, n = x, ids, len(x)
        self.near, self.sim, self.new = np.full((n, LIST), -1), np.full((n, LIST), -2, np.float32), np.zeros((n, LIST), bool)

    def offer(self, pairs: np.ndarray) -> int:
        """Compares pairs, and takes those that are better than a list's last; gives the number of new entries."""
        n = len(self.x)
        both = np.unique(np.minimum(pairs[0], pairs[1]) * n + np.maximum(pairs[0], pairs[1]))
        a, b = both // n, both % n
        apart = self.ids[a] != self.ids[b]
        a, b = a[apart], b[apart]
        s = np.concatenate([np.einsum("ij,ij->i", self.x[a[i : i + 65536]], self.x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, np.float32)
        row, to, s = np.r_[a, b], np.r_[b, a], np.r_[s, s]
        good = s >= self.sim[row, -1]
        row, to, s = row[good], to[good], s[good]
        fresh = ~(self.near[row] == to[:, None]).any(axis=1)
        row, to, s = row[fresh], to[fresh], s[fresh]
        touched = np.unique(row)
        if not len(touched):
            return 0
        r = np.r_[np.repeat(touched, LIST), row]
        c, v = np.r_[self.near[touched].ravel(), to], np.r_[self.sim[touched].ravel(), s]
        new = np.r_[self.new[touched].ravel(), np.ones(len(row), bool)]
        arrived = np.r_[np.zeros(len(touched) * LIST, bool), np.ones(len(row), bool)]
        order = np.lexsort((self.ids[c], -v, r))
        place = _ranks(r[order])
        order, place = order[place < LIST], place[place < LIST]
        at = (r[order], place)
        self.near[at], self.sim[at], self.new[at] = c[order], v[order], new[order]
        return int(arrived[order].sum())

    def join(self, rng: np.random.Generator) -> np.ndarray:
        """Pairs of neighbours of one point, forward or reverse, sampled, of which at least one is new."""
        r, p = np.nonzero(self.near >= 0)
        c, new = self.near[r, p], self.new[r, p]

        def sampled(edges: np.ndarray) -> np.ndarray:
            at, to, edge = np.r_[r[edges], c[edges]], np.r_[c[edges], r[edges]], np.r_[edges, edges]
            order = np.lexsort((rng.random(len(at)), at))
            place = _ranks(at[order])
            order, place = order[place < SAMPLED], place[place < SAMPLED]
            table = np.full((len(self.x), SAMPLED), -1)
            table[at[order], place] = to[order]
            self.new[r[edge[order]], p[edge[order]]] = False
            return table

        fresh, old = sampled(np.flatnonzero(new)), sampled(np.flatnonzero(~new))
        out = []
        for i in range(SAMPLED):
            for other in [*fresh.T[i + 1 :], *old.T]:
                held = (fresh[:, i] >= 0) & (other >= 0) & (fresh[:, i] != other)
                out.append(np.stack([fresh[held, i], other[held]]))
        return np.concatenate(out, axis=1)


def _descended(x: np.ndarray, ids: np.ndarray, seed: int, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) of the lists of one region after NN-descent."""
    rng, lists = np.random.default_rng(seed), _Lists(x, ids)
    lists.offer(_starting_pairs(x, rng))
    for _ in range(rounds):
        if lists.offer(lists.join(rng)) <= SETTLED * LIST * len(x):
            break
    r, p = np.nonzero(lists.near >= 0)
    return r, lists.near[r, p]


def _in_region(dim: int, k: int):
    """The ``k`` most similar vectors within one region, of each of its vectors; ties by id, on 6 decimals."""

    def run(table: pa.Table) -> pa.Table:
        x = _floats(table["vec"], dim)
        ids = table["point_id"].to_numpy()
        c1, c2 = table["c1"].to_numpy(), table["c2"].to_numpy()
        keep = _first_of_copies(ids, _copy_keys(x), k)
        x, ids, c1, c2, n = x[keep], ids[keep], c1[keep], c2[keep], len(keep)
        unit = _unit(x)[0]
        r, c = _descended(unit.astype(np.float32), ids, int(table["cell"][0].as_py()) & 0xFFFFFFFF)
        exact = np.rint(np.einsum("ij,ij->i", unit[r], unit[c]) * 1e6).astype(np.int64)
        # of two versions of an id the more similar one
        order = np.lexsort((-exact, ids[c], r))
        order = order[np.r_[True, (r[order][1:] != r[order][:-1]) | (ids[c[order]][1:] != ids[c[order]][:-1])]] if len(order) else order
        r, c, s = r[order], c[order], exact[order]
        best = _ranked(r, s, ids[c], k) if len(r) else order
        r, c, s = r[best], c[best], s[best]
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=n))].astype(np.int32))
        entry = pa.StructArray.from_arrays([pa.array(-s, pa.int32()), pa.array(ids[c], pa.int64()), pa.array(c1[c]), pa.array(c2[c]), pa.array(np.ones(len(c), bool))], ["far", "id", "c1", "c2", "new"])
        return pa.table([pa.array(ids, pa.int64()), pa.array(c1), pa.array(c2), pa.ListArray.from_arrays(offsets, entry)], names=["point_id", "c1", "c2", "near"])

    return run


_ENTRY = "struct<far:int,id:long,c1:long,c2:long,new:boolean>"


def _nearest(entries: Column, k: int) -> Column:
    """The ``k`` nearest distinct ids of an array of entries; of two entries of an id the nearer, then the older one."""
    ordered = F.array_sort(F.array_distinct(entries))
    ids = F.transform(ordered, lambda x: x["id"])
    first = F.filter(ordered, lambda e, i: F.array_position(ids, e["id"]) == i + 1)
    # few lists hold an id twice; only those pay for the search of first places
    return F.slice(F.when(F.size(F.array_distinct(ids)) == F.size(ordered), ordered).otherwise(first), 1, k)


def _asked(pairs: DataFrame) -> np.ndarray:
    """A bit for each hash of an id that some pair has; of ``FILTER_BITS`` bits, built by Spark's bitmap aggregates."""
    at = pairs.select(F.explode(F.array("a", "b")).alias("id")).select((F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1).alias("at"))
    parts = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for p in parts:
        bits[(p.bucket - 1) * 4096 : p.bucket * 4096] = np.frombuffer(bytes(p.bits), np.uint8)
    return bits


def _fetch(dim: int, bits: np.ndarray):
    """point_id and vec of the vectors that were asked for (and a few more, as the filter has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(2).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
            x = _matrix(batch.column(1), dim)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[rows], pa.int64()), _bytes(x)], ["point_id", "vec"])

    return run


def _pair_similarity(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, good), (y, fine) = _unit(_floats(batch.column(2), dim)), _unit(_floats(batch.column(3), dim))
            s = np.where(good & fine, np.einsum("ij,ij->i", x, y), -2.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(-np.rint(np.nan_to_num(s, nan=-2.0) * 1e6), pa.float64()).cast(pa.int32())], ["a", "b", "far"])

    return run


def _descend(graph: DataFrame, rows: DataFrame, dim: int, k: int, begun: bool) -> tuple[DataFrame, DataFrame]:
    """One round of NN-descent over all regions: the new edges, in both directions, are joined by id with the lists of
    the points they lead to, and neighbours of neighbours that no region has compared are.

    At first all edges are new and lie within regions, where only points of two regions lead out of one. Returns the
    graph with its entries marked as new or not, and the pairs, which are to be unpersisted with it.
    """
    near = F.filter(F.slice("near", 1, k), lambda e: e["new"] & (F.lit(begun) | (e["c2"] >= 0) | (F.col("c2") >= 0)))
    edge = graph.select("point_id", "c1", "c2", F.explode(near).alias("m"))
    way = lambda i, x, y, m, two: F.struct(F.col(i).alias("a"), F.col(x).alias("a1"), F.col(y).alias("a2"), F.col(m).alias("m"), F.col(two).alias("two"))
    both_ways = F.array(way("point_id", "c1", "c2", "m.id", "m.c2"), way("m.id", "m.c1", "m.c2", "point_id", "c2"))
    hop = edge.select(F.explode(both_ways).alias("h")).select("h.*").where(F.lit(begun) | (F.col("two") >= 0)).drop("two")
    apart = lambda x: (x["id"] != F.col("a")) & (x["c1"] != F.col("a1")) & (x["c1"] != F.col("a2")) & ((x["c2"] < 0) | ((x["c2"] != F.col("a1")) & (x["c2"] != F.col("a2"))))
    met = graph.select(F.col("point_id").alias("m"), F.slice("near", 1, k).alias("via")).join(hop, "m").select("a", "a1", "a2", F.filter("via", apart).alias("far_off")).where(F.size("far_off") > 0)
    found = met.select("a", "a1", "a2", F.explode("far_off").alias("x")).select(F.struct(F.col("a").alias("id"), F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("p"), F.struct("x.id", "x.c1", "x.c2").alias("q"))
    pairs = found.groupBy(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).agg(F.first(F.when(F.col("p.id") < F.col("q.id"), F.struct("p", "q")).otherwise(F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("pq"))
    pairs = pairs.select("a", "b", F.col("pq.p.c1").alias("a1"), F.col("pq.p.c2").alias("a2"), F.col("pq.q.c1").alias("b1"), F.col("pq.q.c2").alias("b2")).persist()
    bits = _asked(pairs)
    vectors = rows.select("point_id", "vector", F.pmod(F.xxhash64("point_id"), F.lit(FILTER_BITS)).alias("at")).mapInArrow(_fetch(dim, bits), "point_id long, vec binary")
    one = pairs.select("a", "b").join(vectors.select(F.col("point_id").alias("a"), F.col("vec").alias("va")), "a")
    two = one.join(vectors.select(F.col("point_id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
    scored = two.mapInArrow(_pair_similarity(dim), "a long, b long, far int").where("far < 2000000")
    best = scored.groupBy("a", "b").agg(F.min("far").alias("far")).join(pairs, ["a", "b"])
    entry = lambda i, x, y: F.struct(F.col("far").alias("far"), F.col(i).alias("id"), F.col(x).alias("c1"), F.col(y).alias("c2"), F.lit(True).alias("new"))
    both = best.select(F.explode(F.array(F.struct(F.col("a").alias("point_id"), entry("b", "b1", "b2").alias("e")), F.struct(F.col("b").alias("point_id"), entry("a", "a1", "a2").alias("e")))).alias("x")).select("x.*")
    news = both.groupBy("point_id").agg(F.collect_list("e").alias("news"))
    seen = F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["id"].alias("id"), e["c1"].alias("c1"), e["c2"].alias("c2"), F.lit(False).alias("new")))
    merged = graph.join(news, "point_id", "left").select("point_id", "c1", "c2", F.when(F.col("news").isNull(), seen).otherwise(_nearest(F.concat(seen, "news"), k + 1)).alias("near"))
    return merged, pairs


def neighbour_graph(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = MOST_ROUNDS, region_rows: int = REGION_ROWS) -> DataFrame:
    """point_id and ``near``: the k + 1 most similar points, nearest first, as entries (far: minus millionths, id, ...).

    ``vectors`` has point_id and vector; rows with a null id, or whose vector is null, has not ``dim`` values, a null,
    NaN or infinite value, or is all zero are left out. A point that comes again counts once; if it comes with other
    values, each version is searchable and the most similar version counts. Of more than k + 1 equal vectors, only those
    of the smallest ids need be in the graph, for no other can be among anyone's first k; see ``with_copies``.
    Fewer points than k + 1 give shorter lists; an empty table gives no rows. ``rounds`` across regions end when few
    lists change; the graph is a table in the checkpoint folder.
    """
    rows = _sized(vectors, dim)
    n = rows.count()
    cells = Cells(_sample(rows, n, dim), n, region_rows)
    spread = rows.mapInArrow(_to_cells(cells, dim, k + 1), "cell long, point_id long, c1 long, c2 long, vec binary")
    lists = spread.groupBy("cell").applyInArrow(_in_region(dim, k + 1), f"point_id long, c1 long, c2 long, near array<{_ENTRY}>")
    # the graph is a table of buckets by id, so in a round only new edges, pairs and their vectors move
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    first = lists.repartition(parts, "point_id").groupBy("point_id").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2"), _nearest(F.flatten(F.collect_list("near")), k + 1).alias("near"))
    graph, name = bucketed(first, "point_id", parts)
    for done in range(rounds):
        merged, pairs = _descend(graph, rows, dim, k, done > 0)
        before, (graph, name) = name, bucketed(merged, "point_id", parts)
        pairs.unpersist()
        drop_bucketed(graph.sparkSession, before)
        changed = graph.agg(F.sum(F.size(F.filter(F.slice("near", 1, k), lambda e: e["new"])))).first()[0] or 0
        if changed <= SETTLED * k * n:
            break
    return graph


def with_copies(graph: DataFrame, vectors: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """point_id, id: the first ``k`` of every point, also of those that the graph leaves out as copies of others.

    Such a point has the list of the first point with its vector, with that point itself in it. Points are matched to
    it by the hash of their values, with a salt, so a vector that a third of all rows share is spread over tasks.
    """
    ids = _sized(vectors, dim).select("point_id", F.xxhash64("vector").alias("v")).distinct()
    held = ids.join(graph.select("point_id", F.lit(True).alias("held")), "point_id", "left")
    firsts = held.where("held").groupBy("v").agg(F.min("point_id").alias("point_id"))
    others = held.where("held is null").select("point_id", "v", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int").alias("salt"))
    self_entry = F.struct(F.lit(-1_000_000).alias("far"), F.col("point_id").alias("id"))
    whole = F.array_sort(F.concat(F.array(self_entry), F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["id"].alias("id")))))
    wanted = others.select("v").distinct()
    lists = firsts.join(wanted, "v").join(graph, "point_id").select("v", whole.alias("near"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    theirs = others.join(lists, ["v", "salt"]).select("point_id", F.filter("near", lambda e: e["id"] != F.col("point_id")).alias("near"))
    every = graph.select("point_id", F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["id"].alias("id"))).alias("near")).unionByName(theirs)
    return every.select("point_id", F.explode(F.slice("near", 1, k)).alias("e")).select("point_id", "e.id", (-F.col("e.far") / 1e6).alias("similarity"))


def neighbour_pairs(vectors: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """point_a < point_b: the pairs of which at least one point is among the other's ``k`` most similar."""
    links = with_copies(neighbour_graph(vectors, k, dim), vectors, k, dim)
    return links.select(F.least("point_id", "id").alias("point_a"), F.greatest("point_id", "id").alias("point_b")).distinct()


def graph_search(vectors: DataFrame, queries: DataFrame, k: int = K, dim: int = DIM, beam: int = 24, width: int = 6, hops: int = 8, entries: int = 40, graph: DataFrame | None = None) -> DataFrame:
    """query_id, point_id, similarity: the ``k`` most similar points of each query, by greedy search in the graph.

    ``queries`` has query_id and vector. A search starts from some points (``entries``) of the two cells nearest to the
    query, for the graph of tight clusters is not connected, and then, hop by hop, follows the graph edges (both ways) of its ``width`` best points not yet followed, keeping the best ``beam``;
    it ends when no search has such a point, or after ``hops``. Points are joined to searches by id, so nothing but the
    asked vectors of a hop moves. A point is no hit of a query with its own id. Unusable vectors on either side are left
    out; repeated points and queries count once. Accuracy is set by ``beam`` and ``width``.
    """
    rows, asked = _sized(vectors, dim), _sized(queries.select(F.col("query_id").alias("point_id"), "vector"), dim)
    graph = checkpointed(neighbour_graph(vectors, k, dim) if graph is None else graph).select("point_id", "near")
    n = rows.count()
    cells = Cells(_sample(rows, n, dim), n, CELL_ROWS)
    located = rows.mapInArrow(_packed(cells, dim, False), "point_id long, cell long, vec binary").dropDuplicates(["point_id"])
    points = checkpointed(located.join(graph.select("point_id"), "point_id", "left_semi"))
    started = checkpointed(asked.mapInArrow(_packed(cells, dim, True), "point_id long, cell long, vec binary").dropDuplicates(["point_id", "cell"])).withColumnRenamed("point_id", "query_id")
    searches = started.groupBy("query_id").agg(F.first("vec").alias("qv"))
    edges = graph.select("point_id", F.explode("near.id").alias("id"))
    edges = checkpointed(edges.unionByName(edges.select(F.col("id").alias("point_id"), F.col("point_id").alias("id"))).distinct())
    # the same few points open every search of a cell: those of the smallest hashes
    doors = points.groupBy("cell").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("point_id"), F.lit(2)) == 0, F.struct(F.xxhash64("point_id").alias("h"), F.col("point_id").alias("id"))))), 1, entries).alias("d"), F.min("point_id").alias("least"))
    doors = doors.select("cell", F.explode(F.array_union(F.transform("d", lambda x: x["id"]), F.array("least"))).alias("id"))
    fresh = started.select("query_id", "cell").join(doors, "cell").select("query_id", "id")
    state = None
    for _ in range(hops):
        pairs = fresh.where("query_id <> id").distinct().join(points.select(F.col("point_id").alias("id"), "vec"), "id").join(searches.select("query_id", "qv"), "query_id").select("query_id", "id", "qv", "vec")
        scored = pairs.mapInArrow(_pair_similarity(dim), "a long, b long, far int").select(F.col("a").alias("query_id"), F.struct("far", F.col("b").alias("id"), F.lit(False).alias("followed")).alias("e"))
        found = scored.groupBy("query_id").agg(F.collect_list("e").alias("new"))
        if state is None:
            merged = found.withColumn("best", F.slice(F.array_sort("new"), 1, beam))
        else:
            merged = state.join(found, "query_id", "left").withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array().cast("array<struct<far:int,id:long,followed:boolean>>")))), 1, beam))
        ahead = F.slice(F.filter("best", lambda e: ~e["followed"]), 1, width)
        state = checkpointed(merged.select("query_id", "best", F.transform(ahead, lambda e: e["id"]).alias("go")))
        if not state.where(F.size("go") > 0).limit(1).count():
            break
        step = state.select("query_id", F.explode("go").alias("point_id"), F.transform("best", lambda e: e["id"]).alias("have")).join(edges, "point_id").where(~F.array_contains("have", F.col("id")))
        fresh = step.select("query_id", "id")
        state = state.select("query_id", F.transform("best", lambda e: F.struct(e["far"].alias("far"), e["id"].alias("id"), (e["followed"] | F.array_contains("go", e["id"])).alias("followed"))).alias("best"))
    return state.select("query_id", F.explode(F.slice("best", 1, k)).alias("e")).select("query_id", F.col("e.id").alias("point_id"), (-F.col("e.far") / 1e6).alias("similarity"))


def _packed(cells: Cells, dim: int, both: bool):
    """point_id, nearest cell and vector of the usable rows; with ``both`` a second row for the next cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            unit, good = _unit(x)
            rows = np.flatnonzero(good)
            home, other = cells.assign(unit[rows].astype(np.float32), 9.0 if both else BORDER)
            cell = np.r_[home, other[other >= 0]] if both else home
            rows = np.r_[rows, rows[other >= 0]] if both else rows
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cell), _bytes(x[rows])], ["point_id", "cell", "vec"])

    return run


def graph_coarse(vectors: DataFrame, dim: int = DIM, graph: DataFrame | None = None):
    """An approximate coarse cut for ``operators.search.two_tier`` and ``search``: greedy search in the neighbour graph.

    Of the points nearest to the query those among the given points are kept, so a filter that few points pass leaves few
    rows; the exact plan is for such. Of more than six equal vectors only those of the smallest ids are in the graph.
    """
    held = checkpointed(neighbour_graph(vectors, K, dim) if graph is None else graph)

    def coarse(points: DataFrame, query: Sequence[float], n: int) -> DataFrame:
        asked = vectors.sparkSession.createDataFrame([(-1, [float(x) for x in query])], "query_id long, vector array<float>")
        near = graph_search(vectors, asked, n, dim, beam=max(n, 24), width=max(6, n // 4), graph=held)
        return points.select("point_id").join(near.select("point_id"), "point_id", "left_semi").distinct()

    return coarse
