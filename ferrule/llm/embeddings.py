"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its ``NEAREST`` reference points (pivots) in order
of nearness. Inverted lists are kept for pairs of pivots, so vectors that meet in
a list share at least two of them; the order decides which: a pair of pivots
counts if their places add up to ``PLACES`` at most, so the nearest pivot pairs
with many others and far ones with none. Of two vectors that meet in several
lists, only the list of their smallest shared pair of pivots counts them.

A list holds no vectors but 128 signs of projections on seeded directions. Those
of near vectors differ in few places, so hardly any member is left that has to
bring its vector, and these are verified by their cosine in double precision.
Long lists are cut into blocks that are compared block against block, and a block
yields sums and components, never its pairs. Exact copies were collapsed to one
representative before.

The number of pivots grows with the square root of the table. Recall of pairs
with a cosine of exactly 0.95 is about 0.99 with 512 pivots, 0.96 with 4096 and
0.92 with 16,384, the most there are, at 64 to 768 dimensions; it is higher above.
The signs lose about one such pair in ten million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_dealt
from .components import connected_components

LEAST_PIVOTS, MOST_PIVOTS = 512, 1 << 14
NEAREST, PLACES = 7, 8
#: Places (from 0) of the pairs of pivots a vector has lists for.
PAIRS = [(i, j) for i in range(NEAREST) for j in range(i + 1, NEAREST) if i + j + 2 <= PLACES]
#: Most dimensions that get pivots of their own.
MOST_DIMENSIONS = 4096
#: Most bytes of all pivots, which every worker holds, and likenesses to pivots worked out at once.
PIVOT_BYTES, LIKENESSES = 64 << 20, 1 << 20
#: Members of a list from which it is cut, and of a block then.
LIST, BLOCK = 2048, 1024
_BITS = 14


def _directed():
    e = F.col("embedding")
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, a, b) of the vectors that have an id and a direction; a and b are digests of the vector."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda x: x + 0).alias("embedding")).where(_directed() & F.col("vec_id").isNotNull())  # no negative zero
    return found.select("vec_id", "embedding", F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))


def collapse_copies(valid: DataFrame) -> DataFrame:
    """(rep, copies, embedding, a, b): one row for each distinct vector."""
    return valid.groupBy("a", "b", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def pivots_for(n: int) -> int:
    """The power of two below twice the root of the number of distinct vectors, within the bounds."""
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, 1 << int(math.log2(max(1.0, 2 * math.sqrt(n))))))


def choose_pivots(reps: DataFrame, size: int | None = None, apart: float = 0.7) -> dict[int, np.ndarray]:
    """Unit pivots of each dimension, no two of them with a cosine above ``apart``.

    Dimensions get pivots while all together take PIVOT_BYTES at most, the most
    frequent first; vectors of others use seeded directions. Candidates are the
    vectors whose hashed ids are below a bound that lets about twice as many of
    each dimension through as it gets pivots (all the driver ever sees), taken
    in turn if they are far from those taken before:
    near copies as pivots would shuffle each other's ranks. Seeded random
    directions fill up.
    """
    rows = reps.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_DIMENSIONS).collect()
    sizes, room = {}, PIVOT_BYTES
    for r in rows:
        wanted = size or pivots_for(r["n"])
        if wanted * r["dim"] * 4 <= room:
            sizes[r["dim"]] = wanted
            room -= wanted * r["dim"] * 4
    rows = [r for r in rows if r["dim"] in sizes]
    if not rows:
        return {}
    bounds = reps.sparkSession.createDataFrame([(r["dim"], min(1.0, 2 * sizes[r["dim"]] / r["n"]) * float(1 << 63)) for r in rows], "dim int, bound double")
    near = reps.withColumn("dim", F.size("embedding")).join(F.broadcast(bounds), "dim").where(F.shiftrightunsigned(F.xxhash64("rep"), 1) <= F.col("bound"))
    found = near.orderBy("rep", F.xxhash64("embedding")).select("dim", "embedding").toArrow()
    of, out = found.column("dim").to_numpy(), {}
    for d in np.unique(of).tolist():
        own = found.column("embedding").filter(pa.array(of == d)).combine_chunks()
        x = np.empty((len(own), d), np.float32)
        for at in range(0, len(x), 1024):  # scaled in double precision, a part at a time
            x[at : at + 1024] = _unit(np.asarray(own.slice(at, 1024).flatten(), np.float64).reshape(-1, d))
        out[d] = _apart(x, sizes[d], apart)
    return out


def _apart(candidates: np.ndarray, size: int, apart: float) -> np.ndarray:
    taken = np.empty((size, candidates.shape[1]), np.float32)
    n = 0
    for at in range(0, len(candidates), 256):
        block = candidates[at : at + 256]
        if n:
            block = block[(block @ taken[:n].T).max(axis=1) <= apart]
        before = n
        for x in block:
            if n < size and (n == before or (taken[before:n] @ x).max() <= apart):
                taken[n] = x
                n += 1
    taken[n:] = _unit(np.random.default_rng(candidates.shape[1]).normal(size=(size - n, candidates.shape[1])))
    return taken


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values, np.float64), offsets


def ordered_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of unit vectors, nearest first; -1 where there are fewer. Rows go in parts, so LIKENESSES (or one row's) are held."""
    x, step = x.astype(pivots.dtype), max(1, LIKENESSES // max(1, len(pivots)))
    choose = (lambda s: np.argsort(-s, axis=1, kind="stable")[:, :NEAREST]) if len(pivots) <= 64 else _first
    near = np.concatenate([choose(x[at : at + step] @ pivots.T) for at in range(0, len(x), step)]) if len(x) else np.empty((0, min(NEAREST, len(pivots))), int)
    return np.pad(near, ((0, 0), (0, NEAREST - near.shape[1])), constant_values=-1)


def _first(likeness: np.ndarray) -> np.ndarray:
    near = np.argpartition(-likeness, NEAREST, axis=1)[:, :NEAREST]
    near.sort(axis=1)  # of equally near ones the first
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable"), 1)


def list_keys(near: np.ndarray) -> np.ndarray:
    """Of each row of ordered pivots, the pairs it has lists for, as numbers."""
    i, j = (near[:, list(p)].astype(np.int64) for p in zip(*PAIRS, strict=True))
    return np.minimum(i, j) << _BITS | np.maximum(i, j)


def _signs(x: np.ndarray) -> np.ndarray:
    """128 signs of projections, packed in two numbers."""
    planes = np.random.default_rng(x.shape[1] + 1).normal(size=(x.shape[1], 128))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_unlike(threshold: float) -> int:
    """Signs that may differ between vectors with such a cosine, five and a half deviations beyond the mean."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(128 * p + 5.5 * math.sqrt(128 * p * (1 - p)))


_PACKED = [(f"p{i}", pa.int64()) for i in range(2)] + [(f"s{i}", pa.int64()) for i in range(2)]


def index_rows(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(rep, keys, p0, p1, s0, s1): each vector's lists, its ordered pivots (packed) and signs."""
    kinds = [("rep", pa.int64()), ("keys", pa.list_(pa.int64())), *_PACKED]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            values, offsets = _matrix(batch.column(1))
            sizes = np.diff(offsets)
            keys, packed = np.empty((batch.num_rows, len(PAIRS)), np.int64), np.empty((batch.num_rows, 4), np.int64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = _unit(values[offsets[at][:, None] + np.arange(d)])
                own = pivots[d] if d in pivots else _apart(np.empty((0, d)), LEAST_PIVOTS, 1.0)  # a rare dimension: seeded directions
                near = ordered_pivots(x, own)
                keys[at] = d << 2 * _BITS | list_keys(near)
                wide = near.astype(np.int64)
                packed[at, 0] = wide[:, 0] | wide[:, 1] << 16 | wide[:, 2] << 32 | wide[:, 3] << 48
                packed[at, 1] = wide[:, 4] | wide[:, 5] << 16 | wide[:, 6] << 32
                packed[at, 2:] = _signs(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(PAIRS)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *(pa.array(c) for c in packed.T)], schema=schema)

    return reps.select("rep", "embedding").mapInArrow(run, "rep bigint, keys array<bigint>, p0 bigint, p1 bigint, s0 bigint, s1 bigint")


def _unpacked(p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return np.stack([(p0 if k < 4 else p1) >> 16 * (k % 4) & 0xFFFF for k in range(NEAREST)], axis=1)


def _counted_here(key: int, near: np.ndarray) -> np.ndarray:
    """Which pairs of these members of list ``key`` share no smaller one."""
    own = list_keys(near)
    small = np.where(own < (key & (1 << 2 * _BITS) - 1), own, -1)
    names, place = np.unique(small, return_inverse=True)
    has = np.zeros((len(near), len(names)), np.float32)
    has[np.arange(len(near))[:, None], place.reshape(small.shape)] = 1
    has = has[:, names >= 0]
    return (has @ has.T) == 0


def _grouped(batches, names: list[str]):
    """Whole groups of rows with equal key, x and y, sorted by them; a group may span batches."""

    def ends(held):
        k, x, y = (held.column(c).to_numpy() for c in names)
        return np.flatnonzero((k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        at = ends(held)
        if len(at):
            yield held.slice(0, int(at[-1])), np.concatenate([[0], at])
            held = held.slice(int(at[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.concatenate([[0], ends(held), [held.num_rows]])


def met_members(indexed: DataFrame, threshold: float) -> DataFrame:
    """(key, x, y, own, rep, p0, p1): members of a list with another there whose signs differ little."""
    rows = indexed.select("rep", "p0", "p1", "s0", "s1", F.explode("keys").alias("key"))
    long = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LIST).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    few = long.count() <= 200_000
    if few:  # else the join below deals the rows by key
        long = F.broadcast(long)
    placed = rows.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(rep, s0), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "p0", "p1", "s0", "s1")
    most = most_unlike(threshold)
    names = ["key", "x", "y", "own", "rep", "p0", "p1"]
    schema = pa.schema([(n, pa.int32() if n in ("x", "y", "own") else pa.int64()) for n in names])

    def run(batches):
        for part, at in _grouped(batches, names[:3]):
            columns = {c: part.column(c).to_numpy() for c in (*names, "s0", "s1")}
            signs = np.unpackbits(np.stack([columns["s0"], columns["s1"]], axis=1).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            keep = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                alike = signs[a:b] @ signs[a:b].T >= 128 - 2 * most
                np.fill_diagonal(alike, False)
                if columns["x"][a] != columns["y"][a]:
                    alike &= columns["own"][a:b, None] != columns["own"][None, a:b]
                touched = np.flatnonzero(alike.any(axis=1))
                if len(touched):
                    near = _unpacked(columns["p0"][a + touched], columns["p1"][a + touched])
                    counted = (alike[np.ix_(touched, touched)] & _counted_here(int(columns["key"][a]), near)).any(axis=1)
                    keep.append(a + touched[counted])
            if keep:
                keep = np.concatenate(keep)
                yield pa.RecordBatch.from_arrays([pa.array(columns[n][keep], t.type) for n, t in zip(names, schema, strict=True)], schema=schema)

    sorted_rows = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sorted_rows.mapInArrow(run, "key bigint, x int, y int, own int, rep bigint, p0 bigint, p1 bigint")


def _block_links(key, apart, reps, copies, own, near, vectors, threshold):
    """(rep, linked copies, smallest linked id) of one block against another (or itself)."""
    link = vectors @ vectors.T >= threshold
    np.fill_diagonal(link, False)
    if apart:
        link &= own[:, None] != own[None, :]
    link &= _counted_here(key, near)
    touched = np.flatnonzero(link.any(axis=1))
    if not len(touched):
        return
    link = link[np.ix_(touched, touched)]
    linked = link @ copies[touched]
    label = reps[touched].copy()
    while True:  # smallest id by spreading inside the block
        low = np.minimum(label, np.where(link, label[None, :], label.max()).min(axis=1))
        if (low == label).all():
            break
        label = low
    yield from zip(reps[touched].tolist(), linked.tolist(), label.tolist(), strict=True)


def verified_links(reps: DataFrame, indexed: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(rep, links, low): parts of the verified link counts and of the components."""
    met = cut(met_members(indexed, threshold))
    names = ["key", "x", "y", "own", "rep", "p0", "p1", "copies", "embedding"]
    full = met.join(reps.select("rep", "copies", "embedding"), "rep").select(names).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(batches):
        made: list[tuple] = []
        for part, at in _grouped(batches, names[:3]):
            key, x, y, own, rep, p0, p1, copies = (part.column(c).to_numpy() for c in names[:8])
            values, offsets = _matrix(part.column("embedding"))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 1:
                    vectors = _unit(values[offsets[a] : offsets[b]].reshape(b - a, -1))
                    made += _block_links(int(key[a]), x[a] != y[a], rep[a:b], copies[a:b], own[a:b], _unpacked(p0[a:b], p1[a:b]), vectors, threshold)
            while len(made) >= 20_000:
                yield _rows(schema, made[:20_000])
                made = made[20_000:]
        if made:
            yield _rows(schema, made)

    return full.mapInArrow(run, "rep bigint, links bigint, low bigint")


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are their own component. Only vectors of one dimension
    are compared. Exact copies link with each other. Repeated rows count as
    copies; rows with a null vec_id link with nothing. An empty table stays empty.
    """
    valid = valid_vectors(vectors)
    reps = cut(collapse_copies(valid))
    indexed = cut(index_rows(reps, choose_pivots(reps)))
    parts = cut(verified_links(reps, indexed, threshold))
    comps = connected_components(parts.select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    counted = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    clash = not reps.groupBy("a", "b").count().where("count > 1").isEmpty()
    on = ["a", "b", "embedding"] if clash else ["a", "b"]  # digests of different vectors that collide
    named = (
        reps.select(*on, "rep", "copies")
        .join(counted, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*on, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.col("copies").alias("n"))
    )
    found = join_dealt(valid.select("vec_id", *on), cut(named), on, ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_directed() | F.col("vec_id").isNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
