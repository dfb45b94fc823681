"""Parts shared by the operators that find long repeats across documents.

Both cut a document into windows of fixed length and give every window a key that
depends on the window's content alone, so equal windows have equal keys. Windows
that follow each other under one key make a span: a row (doc_id, key, digest,
first, last), the digest being of all the content the span's windows cover. Few
rows stand for many windows, and only keys seen at several places matter.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, join_dealt

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Digests of any slice of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if n >= len(Rolling._powers):
            size = max(4096, 2 * n)
            Rolling._powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, BASE, np.uint64))])
            Rolling._inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * Rolling._powers[:n], dtype=np.uint64)])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * Rolling._inverse[start] + (stop - start).astype(np.uint64))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


class Resolved(NamedTuple):
    #: (doc_id, first, last): all windows of the span occur earlier.
    settled: DataFrame
    #: (doc_id, key, first, last): windows that have to be compared one by one.
    open: DataFrame


def resolve(spans: DataFrame, seen: DataFrame, place: Column, done: Callable[[], None] = lambda: None, few: bool = False) -> Resolved:
    """Settle spans whose whole content occurs at an earlier place.

    ``spans``: doc_id, key, digest, first, last. ``seen`` (key, n) are the keys that
    occur at several places and how often. ``place`` orders occurrences (a struct or the id).
    ``done`` is called when spans are read no more. With ``few`` the keys seen and
    their spans are shuffled once more, to be written to few files. Counts are
    combined before every shuffle, so a passage that a third of all documents share
    costs one row a task; rows are joined to hot keys in parts.
    """
    where = ["doc_id", "first"]
    less = gathered if few else lambda df: df
    shared = cut(less(join_dealt(spans, cut(less(seen.select("key", "n"))), ["key"], where)))
    done()
    first = cut(shared.groupBy("key", "digest").agg(F.min(place).alias("origin"), F.count("*").alias("n")))
    several = cut(first.groupBy("key").agg(F.count("*").alias("digests"), F.sum("n").alias("n")).where("digests > 1").select("key", "n"))
    placed = join_dealt(shared, first, ["key", "digest"], where)
    settled = placed.where(place > F.col("origin")).select("doc_id", "first", "last")
    left = join_dealt(placed.where(place == F.col("origin")).select("doc_id", "key", "first", "last"), several, ["key"], where)
    return Resolved(settled, left)


def by_document(ranges: DataFrame, name: str) -> DataFrame:
    """(doc_id, name: array<struct<first, last>>): bounded by the document's length."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias(name))


def covered(length: int, ranges, window: int) -> np.ndarray:
    """Mask of the elements that the windows starting in the ranges cover."""
    steps = np.zeros(length + 1, np.int64)
    if ranges:
        first = np.fromiter((r["first"] for r in ranges), np.int64, len(ranges))
        last = np.fromiter((r["last"] for r in ranges), np.int64, len(ranges))
        np.add.at(steps, first, 1)
        np.add.at(steps, np.minimum(last + window, length), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(sorted_positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each maximal run of consecutive integers."""
    if not len(sorted_positions):
        return sorted_positions, sorted_positions
    gap = np.flatnonzero(np.diff(sorted_positions) != 1)
    return sorted_positions[np.concatenate([[0], gap + 1])], sorted_positions[np.concatenate([gap, [len(sorted_positions) - 1]])]
