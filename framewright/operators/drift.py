"""JSON record files whose layout drifts: one consistent table of all records, and a report of every change.

The layouts are matched to the wanted fields by similarity flooding. Spark reduces the records to the distinct layouts
and these to counts of paths, shapes and pairs of paths; only those reach the driver, and their number depends on the
distinct JSON paths, not on the records or layouts (``MAX_PATHS`` is checked before).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import spread_lag
from framewright.session import checkpointed

MAX_PATHS = 20_000
#: A path that occurs beside a field's own name in more than this share of its records cannot be another name of it.
BESIDE = 0.2
#: A path whose name is less like a field's than this needs a telling shape and the field's own name elsewhere.
LIKE = 0.3
ROUNDS, SETTLED = 50, 1e-4
#: The shapes that the values of a field of each class can have; a number may turn into text ("s0007").
CLASSES = {"series": ("series",), "number": ("number", "length", "text"), "text": ("text", "number", "length"), "flag": ("flag",)}
_SERIES = re.compile(r"^[\s\[(]*-?\d[\d.eE+-]*(\s*[,;\s]\s*-?\d[\d.eE+-]*)+[\s\])]*$")
_NUMBER = re.compile(r"^\s*[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\s*$")


def _refuse(token: str):
    raise ValueError(token)


def parse_record(raw: str | None) -> dict | None:
    """The JSON object in ``raw``; None if it is null, broken, not an object, or holds NaN or Infinity."""
    try:
        got = json.loads(raw, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def leaves(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Full path and value of every non-null leaf; arrays are leaves. Tabs and line ends in names become blanks."""
    for k, v in obj.items():
        path = f"{prefix}.{k}" if prefix else k
        if not path.isprintable():
            path = re.sub(r"[\t\r\n]", " ", path)
        if isinstance(v, dict):
            yield from leaves(v, path)
        elif v is not None:
            yield path, v


def kind_of(value: object) -> str:
    """'integer', 'decimal', 'string', 'boolean', or 'array<...>' of the widest kind of its elements."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    if isinstance(value, str):
        return "string"
    kinds = {kind_of(x) for x in value if x is not None and not isinstance(x, dict)}
    return f"array<{next((k for k in ('string', 'decimal', 'integer', 'boolean') if k in kinds), 'none')}>"


def shape_of(value: object, longest: int) -> str:
    """What the value looks like whatever its type: 'series', 'length' (of the record's longest series), 'number', ..."""
    if isinstance(value, list) or (isinstance(value, str) and _SERIES.match(value)):
        return "series"
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, (int, float)) or _NUMBER.match(value):
        return "length" if longest and float(value) == longest else "number"
    return "text"


def _series_length(value: object) -> int:
    if isinstance(value, list):
        return len(value)
    return len(re.split(r"\s*[,;\s]\s*", value.strip("[]() \t"))) if isinstance(value, str) and _SERIES.match(value) else 0


def layout_of(raw: str | None) -> str | None:
    """The record's layout: a line 'path TAB kind TAB shape' for every non-null leaf; None for an invalid record."""
    obj = parse_record(raw)
    if obj is None:
        return None
    found = list(leaves(obj))
    longest = max((_series_length(v) for _, v in found), default=0)
    return "\n".join(sorted(f"{p}\t{kind_of(v)}\t{shape_of(v, longest)}" for p, v in found))


def _layouts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        raw = part.pop("raw_json")
        part["layout"] = [layout_of(x) for x in raw]
        yield part


_KEYS = ("shard_id", "line_no", "stream_key", "written_at", "received_at")
_SHAPE = ", ".join(f"{c} string" for c in (*_KEYS, "same"))


def _as_text(records: DataFrame) -> DataFrame:
    """The key columns as text, as they go through Python, and raw_json: pandas would make floats of ids with nulls.

    ``same`` tells records apart that have no line_no or no shard_id: by their text."""
    unknown = F.col("line_no").isNull() | F.col("shard_id").isNull()
    same = F.when(unknown, F.coalesce(F.sha2("raw_json", 256), F.lit("")))
    return records.select(*[F.col(c).cast("string").alias(c) for c in _KEYS], same.alias("same"), "raw_json")


def _as_before(parsed: DataFrame, records: DataFrame) -> DataFrame:
    types = dict(records.dtypes)
    return parsed.withColumns({c: F.col(c).cast(types[c]) for c in _KEYS})


def shard_layouts(records: DataFrame) -> DataFrame:
    """How many records of each shard have each layout: stream_key, shard_id, written_at, layout, n.

    A record that came again (same shard_id and line_no) counts once, as first received; a time of receipt goes before
    none. Records without line_no or shard_id are the same if their text is. Records are parsed before anything is
    shuffled, so only layouts move.
    """
    keys = _as_text(records)
    parsed = keys.mapInPandas(_layouts, f"{_SHAPE}, layout string")
    parsed = _as_before(parsed, records)
    once = parsed.groupBy("shard_id", "line_no", "same").agg(F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "stream_key", "written_at", "layout")).alias("r"))
    return once.groupBy("shard_id", "r.stream_key", "r.written_at", "r.layout").agg(F.count(F.lit(1)).alias("n"))


def _words(path: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", path)]


def name_similarity(a: str, b: str) -> float:
    """0 to 1: how far the words of two paths agree; an abbreviation agrees with the word it begins."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0

    def best(w: str, others: list[str]) -> float:
        return max(1.0 if w == o else 0.8 if len(min(w, o, key=len)) >= 3 and (w.startswith(o) or o.startswith(w)) else 0.0 for o in others)

    return (sum(best(w, y) for w in x) + sum(best(w, x) for w in y)) / (len(x) + len(y))


def flood(fields: list[str], shapes: dict[str, Counter], paths: list[str]) -> dict[tuple[str, str], float]:
    """Match scores of (field, path) by similarity flooding.

    The two schema graphs have the fields and the paths as elements, each tied to its shape nodes (weighted by how often
    it has that shape) and to the node of its parent object. Scores start from the names and flow along equally labelled
    edges of the pairwise graph, out of every pair to its neighbour pairs and back, until they settle.
    """
    start: dict[tuple, float] = {}
    edges: dict[tuple, list[tuple[tuple, float]]] = defaultdict(list)
    share = {p: {s: n / sum(c.values()) for s, n in c.items()} for p, c in shapes.items()}
    for f in fields:
        for p in paths:
            pair = ("element", f, p)
            start[pair] = name_similarity(f, p)
            for s in share[f].keys() & share[p].keys():
                node, weight = ("shape", s, s), min(share[f][s], share[p][s])
                start[node] = 1.0
                edges[pair].append((node, weight))
                edges[node].append((pair, weight))
            up = ("parent", f.rpartition(".")[0], p.rpartition(".")[0])
            start[up] = 1.0 if up[1] == up[2] else name_similarity(up[1], up[2])
            edges[pair].append((up, 0.5))
            edges[up].append((pair, 0.5))
    out_of = {node: sum(w for _, w in near) for node, near in edges.items()}
    score = dict(start)
    for _ in range(ROUNDS):
        after = {n: start[n] + score[n] + sum(score[m] * w / out_of[m] for m, w in edges[n]) for n in start}
        top = max(after.values(), default=1.0) or 1.0
        after = {n: v / top for n, v in after.items()}
        moved = max((abs(after[n] - score[n]) for n in after), default=0.0)
        score = after
        if moved < SETTLED:
            break
    return {(f, p): score["element", f, p] for f in fields for p in paths}


def correspondences(layouts: list[tuple[str, int]], fields: dict[str, str]) -> dict[str, str]:
    """Which path holds which field: {path: field}, from the distinct layouts and how often each occurs.

    ``fields`` gives the class of each field's values (see ``CLASSES``); a path whose values mostly look otherwise is no
    candidate.
    A path that occurs beside a field's own name is no other name of it, and of two paths that occur together only the
    better one is taken, so no record has two values for a field.
    """
    shapes: dict[str, Counter] = defaultdict(Counter)
    beside_own, paths = Counter(), []
    for layout, n in layouts:
        held = [line.split("\t") for line in layout.split("\n") if line]
        paths.append((sorted({h[0] for h in held}), n))
        for p, _, s in held:
            shapes[p][s] += n
            for q in fields:
                beside_own[p, q] += n * any(q == h[0] for h in held)

    def pairs(wanted: list[str]) -> Counter:
        out = Counter()
        for held, n in paths:
            out.update({(a, b): n for i, a in enumerate(held) for b in held[i + 1 :] if a in wanted and b in wanted})
        return out

    return _matched(shapes, beside_own, pairs, fields)


def _matched(shapes: dict[str, Counter], beside_own: Counter, pairs: Callable[[list[str]], Counter], fields: dict[str, str]) -> dict[str, str]:
    """``correspondences`` from what is counted of the schema.

    ``shapes`` has how often each path has each shape, ``beside_own`` how often it occurs with each field's own name, and
    ``pairs`` gives how often each two of some paths occur together (keys in order).
    """
    count = {p: sum(c.values()) for p, c in shapes.items()}
    shapes = {p: Counter(c) for p, c in shapes.items()}
    named = [f for f in fields if f in count]
    for f in fields:
        shapes.setdefault(f, Counter())[fields[f]] += 1
    fits = lambda p, f: sum(shapes[p][s] for s in CLASSES[fields[f]]) > 0.5 * count[p]
    beside = lambda p, q: beside_own[p, q] > BESIDE * min(count[p], count.get(q, 0) or 1) or not fits(p, q)
    rest = [p for p in count if p not in fields and not all(beside(p, f) for f in fields)]
    score = flood(list(fields), shapes, rest)
    tells = lambda p, f: f in named and shapes[p].most_common(1)[0][0] in ("series", "length")
    taken, together = {f: f for f in named}, pairs(rest)
    for p, f in sorted(((p, f) for p in rest for f in fields), key=lambda x: (-score[x[1], x[0]], x)):
        if p in taken or beside(p, f) or (name_similarity(f, p) < LIKE and not tells(p, f)) or score[f, p] < max(score[g, p] for g in fields if not beside(p, g)):
            continue
        if all(together[min(p, q), max(p, q)] <= BESIDE * min(count[p], count[q]) for q, g in taken.items() if g == f):
            taken[p] = f
    return taken


def match_fields(counts: DataFrame, fields: dict[str, str]) -> dict[str, str]:
    """``correspondences`` of the layouts in ``shard_layouts``.

    Spark counts the shapes of each path and which paths occur together; what reaches the driver is a row for each path
    and shape, and for each two candidate paths. The number of paths is checked before anything is collected.
    """
    spark = counts.sparkSession
    line = F.col("lines")
    # layouts that differ in kinds only are one
    bare = F.regexp_replace("layout", "\t[^\t\n]*\t", "\t")
    sets = counts.where("layout <> ''").groupBy(bare.alias("layout")).agg(F.sum("n").alias("n")).select("layout", "n", F.split("layout", "\n").alias("lines"))
    begins = lambda f: F.exists(line, lambda x: F.startswith(x, F.lit(f + "\t"))).cast("long")
    own = [begins(f) for f in fields]
    lines = checkpointed(sets.select("layout", "n", F.array(*own).alias("own"), F.explode("lines").alias("x")).select("layout", "n", "own", F.split_part("x", F.lit("\t"), F.lit(1)).alias("path"), F.split_part("x", F.lit("\t"), F.lit(2)).alias("shape")))
    if (found := lines.select("path").distinct().count()) > MAX_PATHS:
        raise ValueError(f"{found} distinct paths; the schema graph holds {MAX_PATHS} at most")
    shapes: dict[str, Counter] = defaultdict(Counter)
    beside_own = Counter()
    beside = [F.sum(F.col("n") * F.col("own")[i]).alias(f"own{i}") for i in range(len(fields))]
    for r in lines.groupBy("path", "shape").agg(F.sum("n").alias("n"), *beside).collect():
        shapes[r.path][r["shape"]] = r.n
        for i, f in enumerate(fields):
            beside_own[r.path, f] += r[f"own{i}"]

    def pairs(wanted: list[str]) -> Counter:
        held = lines.join(spark.createDataFrame([(p,) for p in wanted], "path string"), "path", "left_semi").groupBy("layout", "n").agg(F.sort_array(F.collect_set("path")).alias("p"))
        two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        return Counter({(r.a, r.b): r.n for r in held.select("n", F.explode(two).alias("t")).groupBy("t.a", "t.b").agg(F.sum("n").alias("n")).collect()})

    return _matched(shapes, beside_own, pairs, fields)


def schema_changes(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Each change of a field between a shard and the one written just before it in its stream.

    Columns: shard_id, field_name, change_kind ('added', 'removed', 'renamed', 'type'). A shard's name and type for a
    field are those of most of its non-null values (ties: the first in alphabetical order). Broken, null and non-object
    records count for nothing; a shard that has only such records lacks every field. Shards written at the same time
    follow each other by shard_id; shards without written_at come before all others of their stream. An empty table gives
    no rows.
    """
    counts = checkpointed(shard_layouts(records))
    field_of = match_fields(counts, fields)
    pick = F.create_map(*[F.lit(x) for pair in field_of.items() for x in pair]) if field_of else F.create_map().cast("map<string,string>")
    lines = counts.select("shard_id", "n", F.explode(F.split("layout", "\n")).alias("line")).select("shard_id", "n", F.split("line", "\t").alias("x"))
    uses = lines.select("shard_id", "n", F.col("x")[0].alias("path"), F.get(F.col("x"), F.lit(1)).alias("kind")).withColumn("field_name", pick[F.col("path")]).where("field_name is not null")
    tally = lambda c: uses.groupBy("shard_id", "field_name", c).agg(F.sum("n").alias("n")).groupBy("shard_id", "field_name").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
    held = tally("path").join(tally("kind"), ["shard_id", "field_name"])
    shards = counts.groupBy("shard_id").agg(F.min("stream_key").alias("stream_key"), F.min("written_at").alias("written_at"))
    wanted = shards.select("*", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
    state = wanted.join(held, ["shard_id", "field_name"], "left")
    lagged = spread_lag(state, ["stream_key", "field_name"], F.coalesce(F.date_trunc("month", "written_at"), F.lit("0001-01-01").cast("timestamp")), ["written_at", "shard_id"], ["path", "kind"])
    change = lambda when, name: F.when(when, F.lit(name))
    here, before = F.col("path").isNotNull(), F.col("prev_path").isNotNull()
    kinds = F.array_compact(F.array(change(here & ~before, "added"), change(~here & before, "removed"), change(here & before & (F.col("path") != F.col("prev_path")), "renamed"), change(here & before & (F.col("kind") != F.col("prev_kind")), "type")))
    return lagged.where("prev_exists").select("shard_id", "field_name", F.explode(kinds).alias("change_kind"))


def _number(value: object) -> float | None:
    """The number, or the only run of digits in a text such as "s0007"."""
    try:
        if isinstance(value, str) and not _NUMBER.match(value) and len(runs := re.findall(r"\d+", value)) == 1:
            return float(runs[0])
        return float(value) if not isinstance(value, (bool, list)) else None
    except (TypeError, ValueError):
        return None


def _numbers(value: object) -> list[float | None] | None:
    if isinstance(value, str):
        value = re.split(r"\s*[,;\s]\s*", value.strip("[]() \t")) if value.strip() else []
    return [_number(x) for x in value] if isinstance(value, list) else None


def _whole(value: object, half: float = 0.0) -> int | None:
    """The integer of 64 bits; a fraction is cut off, with ``half`` = 0.5 rounded."""
    n = value if isinstance(value, int) and not isinstance(value, bool) else _number(value)
    if n is None or not abs(n) < 2**63 - 1024:
        return None
    return n if isinstance(n, int) else int(n + math.copysign(half, n))


_OWN = {"point_id": ("long", _whole), "video_name": ("string", lambda v: v if isinstance(v, str) else None), "frame": ("long", _whole)}
#: The column type and the cast of a field of each class.
_CASTS = {"series": ("array<double>", _numbers), "number": ("long", lambda v: _whole(v, 0.5)), "text": ("string", lambda v: v if isinstance(v, str) else None if isinstance(v, list) else json.dumps(v)), "flag": ("boolean", lambda v: v if isinstance(v, bool) else None)}


def _kept(value: object, cast: object) -> bool:
    """Whether a cast value says all that the value said; a number in a text ("s0007") does."""
    if isinstance(cast, list):
        return isinstance(value, str) or all(_kept(x, y) for x, y in zip(value, cast))
    return value is cast or (cast is not None and (not isinstance(value, float) or float(value) == cast) and (not isinstance(value, str) or isinstance(cast, str) or _number(value) == cast))


def _columns(fields: dict[str, str]) -> dict[str, str]:
    """{field: column}: the last part of its path where that is free, else the path with underscores."""
    taken, out = {*_KEYS, "same", *_OWN, "valid", "other", "raw_json"}, {}
    for f in fields:
        short, full = f.rpartition(".")[2], f.replace(".", "_")
        out[f] = next(c for c in (short, full, *(f"{full}_{i}" for i in range(2, len(fields) + len(taken) + 3))) if c not in taken)
        taken.add(out[f])
    return out


def consistent_records(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """All records in one layout: shard_id, line_no, stream_key, written_at, received_at, valid, point_id, video_name,
    frame, a column for each of ``fields`` (the last part of its path, typed by its class), other, raw_json.

    Values of another type are cast; what cannot be cast becomes null. ``other`` (map of path to JSON text) has every
    non-null leaf that has no column: all further paths, values that the cast does not keep whole, and a second value of
    a field. Broken records stay, with valid = false and their raw_json, which is null for the others. A record that
    came again counts once, as first received; a time of receipt goes before none. Records without line_no or shard_id are
    the same if their text is.
    """
    field_of = match_fields(checkpointed(shard_layouts(records)), fields)
    names = _columns(fields)
    made_of = {f: (names[f], *_CASTS[fields[f]]) for f in fields}
    column_of = {name: (name, *rest) for name, rest in _OWN.items()} | {p: made_of[f] for p, f in field_of.items()}
    types = {name: t for name, (t, _) in _OWN.items()} | {c: t for c, t, _ in made_of.values()}
    shape = f"{_SHAPE}, valid boolean, {', '.join(f'`{c}` {t}' for c, t in types.items())}, other map<string,string>, raw_json string"

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for raw in part.pop("raw_json"):
                obj = parse_record(raw)
                got, other = dict.fromkeys(types), {}
                # a field's own name goes before its other names
                for p, v in sorted(leaves(obj or {}), key=lambda x: x[0] not in fields):
                    column, _, cast = column_of.get(p, (None, None, None))
                    value = cast(v) if column and got[column] is None else None
                    if value is not None:
                        got[column] = value
                    if not _kept(v, value):
                        while p in other:
                            p += "#"
                        other[p] = json.dumps(v)
                rows.append((obj is not None, *got.values(), other, raw if obj is None else None))
            made = pd.DataFrame(rows, columns=["valid", *types, "other", "raw_json"], index=part.index, dtype=object)
            for c, t in types.items():
                if t == "long":
                    made[c] = made[c].astype("Int64")
            yield pd.concat([part, made], axis=1)

    flat = _as_before(_as_text(records).mapInPandas(convert, shape), records)
    rest = [c for c in flat.columns if c not in ("shard_id", "line_no", "same")]
    first = F.struct(F.col("received_at").isNull(), "received_at", "stream_key", "written_at")
    return flat.groupBy("shard_id", "line_no", "same").agg(F.min_by(F.struct(*rest), first).alias("r")).select("shard_id", "line_no", "r.*")
