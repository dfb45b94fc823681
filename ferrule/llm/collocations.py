"""Phrases of words that occur together, by hierarchical pair naming.

Texts become sequences of words, cut into slices of bounded size. Words that
are frequent get an id; then, level by level, two adjacent frequent phrases of
k - 1 words that overlap in k - 2 are a pair, and the pairs that are frequent
over all slices get an id that replaces them in the sequences. No phrase of k
words can be frequent unless both its parts of k - 1 words are, so nothing is
missed. A pair's two ids are its parents: of a phrase, the left parent is the
phrase without its last word, the right one that without its first. The counts
of all its beginnings come down the left parents and those of all its ends the
right ones, which gives every cut; a phrase's extensions are those that name it
as a parent.

A slice asks for a name once for each different pair it holds and says where
the pair stands. What slices ask is dealt to buckets of pairs, and a bucket
counts, names and answers; pairs that are not frequent get no answer. A hot
word or pair is one row (or entry) a slice, however often it occurs there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, join_dealt, release

#: Most bytes of the texts of a slice, and about how many different pairs of slices a bucket gets.
SLICE_BYTES, BUCKET = 6 << 20, 1 << 20
UNKNOWN = "und"

# What ends a piece, and what parts words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
_OUTSIDE = re.compile(b"[" + re.escape(BLANKS + ENDS) + b"]")
_END = re.compile(b"[" + re.escape(ENDS) + b"]")


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in groups of seven bits, low ones first, the last marked by a clear high bit; and the bytes each takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for g in range(1, 10):
        more = x >> np.uint64(7 * g) > 0
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(x) else 0, np.uint8)
    for g in range(int(size.max()) if len(x) else 0):
        at = np.flatnonzero(size > g)
        out[end[at] - size[at] + g] = (x[at] >> np.uint64(7 * g) & np.uint64(127)).astype(np.uint8) | np.where(size[at] > g + 1, 128, 0).astype(np.uint8)
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """The numbers that packed() wrote."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, start)


def _bytes(x: np.ndarray) -> bytes:
    return packed(x)[0].tobytes()


def _steps(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending places within groups (which begin at ``first``) as steps, the first of each group as it is."""
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    return steps


def _places(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places that _steps() was given."""
    if not len(steps):
        return steps
    total = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - steps[first], sizes)


def parts_of(text: bytes, most: int, known: int) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about ``most`` bytes that end outside words, each with the last words of its piece before it; how many these are (``known`` at most), and the part."""
    at, before, n = 0, b"", 0
    while True:
        end = at + most
        if end < len(text):
            m = _OUTSIDE.search(text, end)
            end = m.start() if m else len(text)
        part = before + text[at:end]
        yield n, part
        if end >= len(text):
            return
        last = None
        for last in _END.finditer(part, max(0, len(part) - (1 << 16))):
            pass
        tail = part[last.end() :] if last else part[max(part.rfind(bytes([c])) for c in ENDS) + 1 :]
        words = tail.rsplit(maxsplit=known)[-known:] if known else []
        at, before, n = end, b" ".join(words), len(words)


def sequence(data: bytes, lead: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of lower-cased bytes, the number of each word, and its place: one more than the word before, two more in a new piece, ``lead`` at first."""
    b = np.frombuffer(data, np.uint8)
    b = b | ((b >= 65) & (b <= 90)).astype(np.uint8) << 5
    kind = _KIND[b]
    inner = kind == 0
    edge = np.diff(inner.view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    place = lead + np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    ends = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(b[inner])]).dictionary_encode()
    return words.dictionary, np.asarray(words.indices), place


def _slice_rows(number: int, lang: str, data: bytes, lead: int, known: int) -> pa.RecordBatch:
    words, code, place = sequence(data, known - lead)
    order = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=len(words))
    counted = np.bincount(code[place >= known], minlength=len(words))
    first = np.cumsum(sizes) - sizes
    out, width = packed(_steps(place[order], first))
    ends = np.concatenate([[0], np.cumsum(width)])[np.append(first, len(order))] if len(words) else np.zeros(1, np.int64)
    at = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    columns = [pa.array(np.full(len(words), number)), pa.array([lang] * len(words), pa.string()), words.cast(pa.binary()).view(pa.string()), pa.array(counted.astype(np.int64)), pa.array(sizes.astype(np.int64)), at]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "lang", "word", "n", "size", "places"])


def word_slices(docs: DataFrame, known: int) -> DataFrame:
    """(slice, lang, word, n, size, places): each different word of a slice, how often the slice counts it, and where it stands.

    A slice holds texts of one lang. A text longer than a slice is cut between
    words; the next slice begins with the ``known`` words before the cut, in
    places below ``known``. A phrase is counted where its last word is at
    ``known`` or beyond.
    """
    bounded_batches(docs.sparkSession)
    most = SLICE_BYTES

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size = 0

        def made(parts):
            nonlocal number
            for lang, data, lead in parts:
                rows = _slice_rows(number, lang, data, lead, known)
                number += 1
                if rows.num_rows:
                    yield rows

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) > most:
                    yield from made((lang, part, lead) for lead, part in parts_of(data, most, known))
                    continue
                held.setdefault(lang, []).append(data)
                size += len(data) + 1
                if size >= most:
                    yield from made([(lang, b"\n".join(t), 0) for lang, t in held.items()])
                    held, size = {}, 0
        yield from made([(lang, b"\n".join(t), 0) for lang, t in held.items()])
        release()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "slice bigint, lang string, word string, n bigint, size bigint, places binary")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written, with an id from 0 without gaps: partitions number their rows, and offsets (a row a partition) are sent to all."""
    own = cut(rows.select(F.monotonically_increasing_id().alias("_own"), "*"))
    part = F.shiftright("_own", 33)
    counts = own.groupBy(part.alias("_part")).count()
    offsets = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_offset"))
    found = own.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.select((F.col("_offset") + F.col("_own").bitwiseAND((1 << 33) - 1)).alias("id"), *rows.columns)


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)).astype(np.int64) % buckets


_ASKS = [("slice", pa.int64()), ("bucket", pa.int64()), ("lefts", pa.binary()), ("rights", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())]
_NAMES = [("slice", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())]
_ASKS_DDL = "slice bigint, bucket bigint, lefts binary, rights binary, counts binary, sizes binary, places binary"
_NAMES_DDL = "slice bigint, ids binary, sizes binary, places binary, id bigint, left bigint, right bigint, n bigint"


def _asked(slice_id, ids: np.ndarray, place: np.ndarray, least: int, buckets: int, more: bool) -> pa.Table:
    """A row for each bucket: the pairs of adjacent ids, how often they count (from place ``least`` on), and where they stand if ``more`` levels follow."""
    order = np.argsort(place, kind="stable")
    ids, place = ids[order], place[order]
    next_to = np.flatnonzero(np.diff(place) == 1)
    left, right, place = ids[next_to], ids[next_to + 1], place[next_to]
    bucket = _bucket(left, right, buckets)
    order = np.lexsort((place, right, left, bucket))
    bucket, left, right, place = bucket[order], left[order], right[order], place[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(left)))
    counts = np.add.reduceat((place >= least).astype(np.int64), first) if len(first) else sizes
    steps = _steps(place, first) if len(first) else place
    own = bucket[first]
    at = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
    rows = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        f, s = first[a:b], slice(first[a], first[b] if b < len(first) else len(left))
        spots = (_bytes(sizes[a:b]), _bytes(steps[s])) if more else (None, None)
        rows.append((slice_id, int(own[a]), _bytes(np.diff(left[f], prepend=0)), _bytes(right[f]), _bytes(counts[a:b]), *spots))
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ASKS)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _ASKS, strict=True)], names=[n for n, _ in _ASKS])


def _named(asks: pa.Table, least: int) -> pa.Table:
    """Names of the pairs of a bucket that all slices together count ``least`` times: a row for each, and for each slice where they stand."""
    lists = {c: [unpacked(x) if x is not None else None for x in asks[c].to_pylist()] for c in ("lefts", "rights", "counts", "sizes", "places")}
    lengths = np.array([len(x) for x in lists["rights"]])
    left = np.concatenate([np.cumsum(x) for x in lists["lefts"]])
    right, counts = np.concatenate(lists["rights"]), np.concatenate(lists["counts"])
    order = np.lexsort((right, left))
    new = np.ones(len(left), bool)
    new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first)
    frequent = total >= least
    base = int(asks["bucket"][0].as_py()) << 32
    name = np.where(frequent, base + np.cumsum(frequent) - 1, -1)
    own = np.empty(len(left), np.int64)
    own[order] = np.repeat(name, np.diff(np.append(first, len(left))))
    rows: list[tuple] = []
    ends = np.cumsum(lengths)
    for i, slice_id in enumerate(asks["slice"].to_pylist()):
        if lists["sizes"][i] is None:
            break
        ids = own[ends[i] - lengths[i] : ends[i]]
        has = ids >= 0
        if has.any():
            steps = lists["places"][i][np.repeat(has, lists["sizes"][i])]
            rows.append((slice_id, _bytes(np.diff(ids[has], prepend=0)), _bytes(lists["sizes"][i][has]), _bytes(steps)))
    n, m = len(rows), int(frequent.sum())
    made = list(zip(*rows, strict=True)) or [[]] * 4
    at = order[first[frequent]]
    columns = [pa.array([*c, *[None] * m], t) for c, (_, t) in zip(made, _NAMES[:4], strict=True)]
    columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c.astype(np.int64))]) for c in (name[frequent], left[at], right[at], total[frequent])]
    return pa.table(columns, names=[c for c, _ in _NAMES])


def _of_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(rows["size"])
    steps = unpacked(b"".join(rows["places"].to_pylist()))
    return np.repeat(np.asarray(rows["id"]), sizes), _places(steps, sizes)


def _of_names(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, places = [], []
    for i, s, p in zip(rows["ids"].to_pylist(), rows["sizes"].to_pylist(), rows["places"].to_pylist(), strict=True):
        sizes = unpacked(s)
        ids.append(np.repeat(np.cumsum(unpacked(i)), sizes))
        places.append(_places(unpacked(p), sizes))
    return np.concatenate(ids), np.concatenate(places)


def name_pairs(named: DataFrame, words: bool, least: int, lead: int, buckets: int, more: bool) -> DataFrame:
    """One level: adjacent ids of ``named`` slices become pairs, and the frequent ones get names. Written."""
    read = _of_words if words else _of_names
    asks = named.groupBy("slice").applyInArrow(lambda t: _asked(t["slice"][0].as_py(), *read(t), lead, buckets, more), _ASKS_DDL)
    return cut(asks.groupBy("bucket").applyInArrow(lambda t: _named(t, least), _NAMES_DDL))


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 the phrases that occur ``least`` times in a lang, and the number of words of each lang (lang, total).

    Phrases have (id, lang, phrase, last, n, before, after, left, right): last
    is the last word, before the counts of its beginnings of 1, 2, ... words,
    after those of its ends of 1, 2, ... words, left and right its parents.
    """
    known = longest - 1
    slices = cut(word_slices(docs, known))
    totals = cut(slices.groupBy("lang").agg(F.sum("n").alias("total")))
    # one row a slice and word: hot words are dealt to several tasks by the join below
    words = cut(numbered(slices.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.count("*").alias("n")).where(F.col("f") >= least)))
    none = F.array().cast("array<bigint>")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("n"), none.alias("before"), none.alias("after"))]
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    named = join_dealt(slices.select("slice", "lang", "word", "size", "places"), words.select("lang", "word", "id", "n"), ["lang", "word"], ["slice"]).select("slice", "id", "size", "places")
    for k in range(2, longest + 1):
        found = name_pairs(named, k == 2, least, known - k + 1, buckets, k < longest)
        if k == 2:
            discard(slices)
        level = found.where("slice is null").select("id", "left", "right", "n").alias("p")
        parent = levels[-1].drop("left", "right")
        a, b = parent.alias("a"), parent.alias("b")
        phrase = level.join(a, F.col("left") == F.col("a.id")).join(b, F.col("right") == F.col("b.id"))
        phrase = phrase.select(
            "p.id",
            F.col("a.lang").alias("lang"),
            F.concat_ws(" ", "a.phrase", "b.last").alias("phrase"),
            F.col("b.last").alias("last"),
            "p.n",
            F.concat("a.before", F.array("a.n")).alias("before"),
            F.concat("b.after", F.array("b.n")).alias("after"),
            "left",
            "right",
        )
        levels.append(cut(phrase))
        named = found.where("slice is not null").select("slice", "ids", "sizes", "places")
    return levels, totals


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of 2 to ``longest`` words of ``docs`` (text, lang).

    A-Z are lower-cased; texts are parted at .,;:!? and line ends into pieces
    and these at spaces and tabs into words. Everything is per lang. n counts
    all words, a all occurrences of the phrase, l and r those of its two parts
    at the cut with the lowest floor(1000000 a a / (l r)), the shortest first
    part among equals; that is its score. Phrases with a >= ``least`` are
    candidates; those inside a longer one that occurs at least ``share`` percent
    as often are dropped. Each lang's ``top`` by score, a and phrase (bytes)
    come in rank order (None: all).

    A null lang is "und", a null or empty text has no words, repeated rows
    count again, ids and further columns are not looked at, and a table without
    words gives no rows. Arithmetic is exact while counts stay below 10**16.
    Texts longer than a slice are cut, so memory does not grow with a text
    beyond the row itself.
    """
    levels, totals = frequent_phrases(docs, least, longest)
    found = None
    for k, level in enumerate(levels[1:], 2):
        if k < longest:
            longer = levels[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), F.col("n").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
            level = level.join(longer, "id", "left").where(F.coalesce(100 * F.col("m") < share * F.col("n"), F.lit(True)))
        wide = "cast(cast({} as decimal(16,0)) * cast({} as decimal(16,0)) as decimal(32,0))"
        score = f"cast({wide.format('n', 'n')} * cast(1000000 as decimal(7,0)) as decimal(38,0)) div {wide.format('before[j]', f'after[{k - 2} - j]')}"
        best = F.expr(f"array_min(transform(sequence(0, {k - 2}), j -> struct({score} as score, j, before[j] as l, after[{k - 2} - j] as r)))")
        part = level.select("lang", "phrase", F.col("n").alias("a"), best.alias("b"))
        found = part if found is None else found.unionByName(part)
    rows = found.select("lang", "phrase", "a", "b.l", "b.r", "b.score").join(totals, "lang")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
