"""Exact substring dedup over bytes by suffix arrays.

A window is ``window`` consecutive bytes of one document. Its key is the leftmost
smallest digest among its byte n-grams: it depends on the window's bytes alone,
so equal windows have equal keys, and windows of different keys never need to be
compared. Consecutive windows owned by one occurrence of an n-gram make a span.
Spans whose bytes occur as a whole at an earlier place are pre-aggregated by key
and XXH64 of their bytes; all other spans whose key occurs several times bring
their bytes to a shard chosen by the key.

A key is hot if a short passage stands in very many surroundings. All windows that
have its n-gram within some range of offsets also share the bytes around it, so a
hot key's spans are cut at ranges of offsets and get longer keys, at last whole
windows: the work stays linear in the number of spans, and no pair of them is
looked at.

A shard builds a suffix array by Larsson-Sadakane refinement (only groups that
are still tied are sorted again, by the rank ``h`` bytes further on) and Kasai's
common prefixes. Suffixes in a row with a common prefix of a window's length are
one string; all but its first place are repeats. A key whose spans are too many
for one shard is dealt to several; each pair of them is merged by binary search
of one side's strings in the other side's suffix array.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, distinct_documents, each, id_and_text, join_dealt, with_ranges
from .repeats import Rolling, by_document, covered, mix, resolve, runs, sliding

WINDOW, GRAM = 100, 24
#: Windows that are looked at together in a very long document.
CHUNK = 1 << 20
#: Bytes a shard holds on average, and bytes of one key from which it is dealt to several shards.
SPREAD_BYTES, SHARD_BYTES = 1 << 20, 1 << 20
#: Bytes of one key from which it is hot, and the widths of the ranges of offsets its spans are cut at in turn.
HOT_BYTES, OFFSETS = 8 << 20, (10, 1)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


_SPANS = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "digest")] + [("first", pa.int32()), ("last", pa.int32())])


def owners(data: np.ndarray, window: int = WINDOW, gram: int = GRAM, with_owner: bool = False):
    """Of one document, chunk by chunk: its place and bytes, n-gram digests, first and last windows and owners of its spans."""
    for at in range(0, len(data) - window + 1, CHUNK):
        part = data[at : at + CHUNK + window - 1]
        rolling = Rolling(_BYTE_VALUES[part])
        start = np.arange(len(part) - gram + 1)
        grams = rolling.slices(start, start + gram)
        packed = (grams & np.uint64(0xFFFFFFFFFF000000)) | start.astype(np.uint64)
        owner = (sliding(packed, window - gram + 1, np.minimum) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        made = at, part, grams[owner[first]], first, np.concatenate([first[1:] - 1, [len(owner) - 1]])
        yield (*made, owner[first]) if with_owner else made


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """XXH64 of slices of the data, as signed numbers."""
    body, digest = data.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start)).view(np.int64)


def _batches(docs: DataFrame, schema: pa.Schema, window: int, columns) -> DataFrame:
    """Columns of every chunk's spans, in few large batches."""

    def run(batches):
        held, rows = [], 0
        for doc_id, text in each(batches, 64):
            data = text_bytes(text)
            if doc_id is None or len(data) < window:
                continue
            for chunk in owners(data, window):
                made = columns(doc_id, *chunk)
                held.append(made)
                rows += len(made[0])
                if rows >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(run, ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in schema))


def document_keys(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key) of every span of all documents. No shuffle."""
    return _batches(docs, pa.schema([("key", pa.int64())]), window, lambda doc_id, at, part, key, first, last: (key.view(np.int64),))


def document_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, digest, first, last) of every span of all documents. No shuffle."""

    def columns(doc_id, at, part, key, first, last):
        return np.full(len(key), doc_id, np.int64), key.view(np.int64), _digests(part, first, last + window), (first + at).astype(np.int32), (last + at).astype(np.int32)

    return _batches(docs, _SPANS, window, columns)


def longer_spans(docs: DataFrame, spans: DataFrame, width: int, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, digest, first, last): the spans cut where the offset of their n-gram enters another range of ``width``.

    The new key is of the bytes that all windows with an offset in the range
    share: all but ``width`` - 1 of a window's. It depends on a window's bytes alone.
    """
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    digest = xxhash.xxh64_intdigest

    def run(batches):
        def rows():
            for doc_id, text, own in each(batches, 64):
                data = text_bytes(text)
                for r in own:
                    body = data[r["first"] : r["last"] + window]
                    raw = body.tobytes()
                    for at, _, _, first, last, owner in owners(body, window, with_owner=True):
                        for a, z, gram in zip((first + at).tolist(), (last + at).tolist(), (owner + at).tolist(), strict=True):
                            # the offset falls as the window moves right
                            while a <= z:
                                part = (gram - a) // width
                                low, high = part * width, min((part + 1) * width, window - GRAM + 1)
                                end = min(z, gram - low)
                                key = digest(raw[gram - low : gram + window + 1 - high], part)
                                yield doc_id, _signed(key), _signed(digest(raw[a : end + window])), r["first"] + a, r["first"] + end
                                a = end + 1

        return arrow_rows(_SPANS, rows(), 50_000)

    return id_and_text(docs).join(found, "doc_id").mapInArrow(run, "doc_id bigint, key bigint, digest bigint, first int, last int")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order. Rounds go on until none is tied: Kasai's bound needs the full order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group is named by its first place
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    h = 8
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        suffix, own = order[tied], group[tied]
        further = rank[np.minimum(suffix + h, n)]
        again = np.argsort(own * (n + 1) + further)  # groups stay in place, their members are sorted by the rank further on
        suffix, further = suffix[again], further[again]
        order[tied] = suffix
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (further[1:] != further[:-1])])
        head[tied] = split
        group[tied] = np.maximum.accumulate(np.where(split, tied, 0))
        rank[suffix] = group[tied]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """Kasai's common prefix of every suffix with the one before it in the array, at most ``most``.

    The text is dealt to lanes of ``lane`` places that advance together; in each
    lane the length falls by one at most from a place to the next.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    lanes = np.arange(0, n, lane)
    length, out = np.zeros(len(lanes), np.int64), np.zeros(n, np.int64)
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    for step in range(min(lane, n)):
        place = lanes + step
        live = place < n
        place, l = place[live], length[: live.sum()]
        at = inverse[place]
        before = np.where(at > 0, order[at - 1], n)
        l[at == 0] = 0
        active = np.flatnonzero((at > 0) & (l < most))
        while len(active):
            a, b = place[active] + l[active], before[active] + l[active]
            same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
            active = active[same]
            l[active] += 1
            active = active[l[active] < most]
        out[at] = l
        length[: len(l)] = np.maximum(l - 1, 0)
    return out


class Shard:
    """Spans of one shard, their suffix array and the strings of a window's length in it."""

    def __init__(self, doc: np.ndarray, first: np.ndarray, bodies: list[bytes], window: int):
        self.window = window
        self.data = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        begin = np.cumsum(size) - size
        span = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(self.data)) - begin[span]
        order = suffix_array(self.data)
        prefix = common_prefixes(self.data, order, window)
        string = np.cumsum(np.concatenate([[0], (prefix[1:] < window).astype(np.int64)]))
        whole = (inside + window <= size[span])[order]  # windows that lie in one span
        self.order, self.string = order[whole], string[whole]
        self.doc, self.at = doc[span[self.order]], first[span[self.order]] + inside[self.order]
        by_place = np.lexsort((self.at, self.doc, self.string))
        head = np.concatenate([[True], self.string[by_place][1:] != self.string[by_place][:-1]]) if len(by_place) else np.empty(0, bool)
        self.is_first = np.zeros(len(self.order), bool)
        self.is_first[by_place[head]] = True

    def firsts(self) -> tuple[np.ndarray, ...]:
        """Of each string, in order: where it begins in the data, its first document and place."""
        keep = self.is_first
        return self.order[keep], self.doc[keep], self.at[keep]

    def strings_words(self, begin: np.ndarray) -> np.ndarray:
        """The strings as big-endian words, for comparing them in order."""
        wide = -(-self.window // 8) * 8
        columns = np.arange(wide)
        body = np.where(columns < self.window, self.data[np.minimum(begin[:, None] + columns, len(self.data) - 1)], 0).astype(np.uint8)
        return body.view(">u8").reshape(len(begin), -1)


def repeats_within(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Documents and places of windows that occur at an earlier place of the same shard."""
    return shard.doc[~shard.is_first], shard.at[~shard.is_first]


def repeats_between(a: Shard, b: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Of strings in both shards, the later of the two first places: binary search of b's strings in a's array."""
    begin_a, doc_a, at_a = a.firsts()
    begin_b, doc_b, at_b = b.firsts()
    if not len(begin_a) or not len(begin_b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words_a, words_b = a.strings_words(begin_a), b.strings_words(begin_b)
    low, high = np.zeros(len(begin_b), np.int64), np.full(len(begin_b), len(begin_a), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        x, y = words_a[mid], words_b[open_]
        unlike = x != y
        col = unlike.argmax(axis=1)
        less = unlike.any(axis=1) & (x[np.arange(len(mid)), col] < y[np.arange(len(mid)), col])
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    hit = np.flatnonzero(low < len(begin_a))
    hit = hit[(words_a[low[hit]] == words_b[hit]).all(axis=1)]
    i = low[hit]
    b_later = (doc_b[hit] > doc_a[i]) | ((doc_b[hit] == doc_a[i]) & (at_b[hit] > at_a[i]))
    return np.where(b_later, doc_b[hit], doc_a[i]), np.where(b_later, at_b[hit], at_a[i])


def _bodies(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, first, body): the bytes of the open spans."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("body", pa.binary())])
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "last")).alias("found"))

    def run(batches):
        def rows():
            for doc_id, text, own in each(batches, 64):
                body = (text or "").encode("utf-8", "surrogatepass")
                yield from ((r["key"], doc_id, r["first"], body[r["first"] : r["last"] + window]) for r in own)

        return arrow_rows(schema, rows(), 20_000)

    return id_and_text(docs).join(found, "doc_id").mapInArrow(run, "key bigint, doc_id bigint, first int, body binary")


def shard_repeats(bodies: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, first, last): windows of the spans that occur at an earlier place."""
    sizes = bodies.groupBy("key").agg(F.sum(F.length("body")).alias("bytes"))
    large = sizes.where(F.col("bytes") > shard_bytes).select("key", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(total) // min(SPREAD_BYTES, shard_bytes)))
    dealt = bodies.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(doc_id, first), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("doc_id", "first", "body", "own", F.when(F.col("parts") > 1, F.col("key")).alias("alone"), F.when(F.col("parts") > 1, 0).otherwise(F.expr(f"pmod(xxhash64(key), {shards})")).alias("shard"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        doc, first, own = (table.column(c).to_numpy() for c in ("doc_id", "first", "own"))
        body = table.column("body").to_pylist()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()

        def shard(part):
            at = np.flatnonzero(own == part)
            return Shard(doc[at], first[at].astype(np.int64), [body[i] for i in at], window)

        found, at = repeats_within(shard(x)) if x == y else repeats_between(shard(x), shard(y))
        by_place = np.lexsort((at, found))
        found, at = found[by_place], at[by_place]
        begin, end = runs(found * (1 << 31) + at) if len(found) and found.max() < 1 << 31 and found.min() >= 0 else (None, None)
        if begin is None:
            columns = [found, at, at]
        else:
            columns = [begin >> 31, begin & ((1 << 31) - 1), end & ((1 << 31) - 1)]
        return pa.table([pa.array(np.asarray(columns[0], np.int64)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32))], names=["doc_id", "first", "last"])

    return dealt.groupBy("alone", "shard", "x", "y").applyInArrow(run, "doc_id bigint, first int, last int")


def _several(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def repeated_bytes(docs: DataFrame, window: int = WINDOW, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, first, last): starts of windows whose bytes also start at an earlier place. ``docs`` has one row an id."""
    place = F.struct("doc_id", "first")
    found = resolve(document_spans(docs, window), _several(document_keys(docs, window)), place)
    settled, cold, left = found.settled, [], cut(found.open)
    for width in OFFSETS:
        sizes = cut(left.groupBy("key").agg(F.sum(F.col("last") - F.col("first") + window).alias("bytes"), F.count("*").alias("n")))
        if sizes.where(F.col("bytes") > hot_bytes).isEmpty():
            break
        sized = join_dealt(left, sizes, ["key"], ["doc_id", "first"])
        cold.append(sized.where(F.col("bytes") <= hot_bytes).drop("bytes"))
        longer = cut(longer_spans(docs, sized.where(F.col("bytes") > hot_bytes), width, window))
        found = resolve(longer, _several(longer), place)
        settled, left = settled.unionByName(found.settled), cut(found.open)
    bodies = cut(_bodies(docs, reduce(DataFrame.unionByName, cold, left), window))
    return settled.unionByName(shard_repeats(bodies, window))


def dedup_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row.

    A byte is removed if a window that covers it also starts earlier: in a
    document with a smaller id, or further left in the same document. n_spans
    counts maximal removed runs. Null texts have no bytes. Rows that repeat a
    doc_id and its text are the same document and all keep the same bytes; of an
    id with different texts the one with the smallest hash is the document,
    and the others, like rows with a null doc_id, are kept whole and remove
    nothing. An empty table stays empty.
    """
    if window <= GRAM:
        raise ValueError("windows must be longer than the n-grams of their keys")
    unique, twice = distinct_documents(docs)
    ranges = by_document(repeated_bytes(unique, window), "ranges")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept", pa.binary())])

    def run(batches):
        def rows():
            for doc_id, text, found in each(batches, 64):
                data = text_bytes(text)
                if not found:
                    yield doc_id, len(data), 0, 0, data.tobytes()
                    continue
                gone = covered(len(data), found, window)
                begins = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                yield doc_id, len(data), int(gone.sum()), begins, data[~gone].tobytes()

        return arrow_rows(schema, rows(), 500)

    return with_ranges(id_and_text(docs), ranges, twice).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
