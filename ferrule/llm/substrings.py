"""Substring dedup over words by recompression.

A document is a sequence of word symbols. Each round first names runs (a symbol
that stands beside its like gets the run's name), then pairs: a rule on the
symbols themselves splits the alphabet in left and right, and every left symbol
followed by a right one becomes one symbol named by both. Names are 64-bit
hashes of what they stand for, so all executors name alike without exchanging a
dictionary, and a round costs no shuffle.

What a round does to a symbol depends on its two neighbours only. So of two equal
windows, a round can treat at most two symbols differently at each end, of
at most 2**r words in round r. After ROUNDS rounds at most MARGIN words at either end are
unlike, and every symbol between, of at most 2**ROUNDS words, is the same in both.
The window's key is the longest of these high-level symbols (the smallest name
among equals). Windows of 50 words leave at least 22 words there, more than two
longest symbols, so every window has a key: no repeat is missed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .common import add_columns, arrow_rows, cut, discard, distinct_documents, each, free_name, gathered, id_and_text, join_dealt, with_ranges
from .repeats import Rolling, by_document, covered, mix, resolve, signed, sliding

ROUNDS = 3
MARGIN = 2 * (2**ROUNDS - 1)
WINDOW = 50


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def recompress(symbols: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """High-level symbols of a word sequence and the word each begins at."""
    start = np.arange(len(symbols))
    for r in range(rounds):
        if len(symbols) < 2:
            break
        like = symbols[1:] == symbols[:-1]
        beside = np.concatenate([[False], like]) | np.concatenate([like, [False]])
        symbols = np.where(beside, mix(symbols + np.uint64(2 * r + 1)), symbols)
        side = (mix(symbols ^ np.uint64(r + 11)) & np.uint64(1)).astype(bool)
        joins = side[:-1] & ~side[1:]  # left then right
        named = mix(symbols[:-1][joins] * np.uint64(0x2545F4914F6CDD1D) + mix(symbols[1:][joins] + np.uint64(2 * r + 2)))
        symbols = symbols.copy()
        symbols[:-1][joins] = named
        keep = np.concatenate([[True], ~joins])
        symbols, start = symbols[keep], start[keep]
    return symbols, start


def window_keys(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The key of every window of a word sequence."""
    n = len(hashes) - window + 1
    symbols, start = recompress(hashes)
    size = np.diff(np.concatenate([start, [len(hashes)]]))
    inner = window - 2 * MARGIN
    rank = np.maximum(~symbols, np.uint64(1))  # the smallest name is the largest rank; 0 is none
    keys = np.zeros(n, np.uint64)
    for k in range(int(size.max()), 0, -1):
        own = size == k
        if k > inner or not own.any():
            continue
        at = np.zeros(len(hashes), np.uint64)
        at[start[own]] = rank[own]
        best = sliding(at[MARGIN : MARGIN + n + inner - k], inner - k + 1, np.maximum)
        keys = np.where(keys == 0, best, keys)
        if keys.all():
            break
    return keys


def window_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, digest, first, last): windows of one document that share a key, in a row. No shuffle."""
    if window < 2 * MARGIN + 2 ** (ROUNDS + 1) - 1:
        raise ValueError("windows are too short for the number of rounds")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "digest")] + [("first", pa.int32()), ("last", pa.int32())])

    def run(batches):
        def rows():
            for doc_id, text in each(batches):
                words = words_of(text)
                if doc_id is None or len(words) < window:
                    continue
                hashes = hashes_of(words)
                keys = window_keys(hashes, window)
                first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
                last = np.concatenate([first[1:] - 1, [len(keys) - 1]])
                digest = Rolling(hashes).slices(first, last + window)
                yield from zip([doc_id] * len(first), signed(keys[first]), signed(digest), first.tolist(), last.tolist(), strict=True)

        return arrow_rows(schema, rows(), 50_000)

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, key bigint, digest bigint, first int, last int")


def _open_windows(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, a, b): 128-bit digests of the windows that are still open."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def rows():
            for doc_id, text, found in each(batches, 64):
                hashes = hashes_of(words_of(text))
                at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in found]))
                a = Rolling(hashes).slices(at, at + window)
                b = Rolling(mix(hashes + np.uint64(7))).slices(at, at + window)
                yield from zip([doc_id] * len(at), at.tolist(), signed(a), signed(b), strict=True)

        return arrow_rows(schema, rows(), 50_000)

    return id_and_text(docs).join(by_document(ranges, "found"), "doc_id").mapInArrow(run, "doc_id bigint, at int, a bigint, b bigint")


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, first, last): starts of windows whose words also start in a document with a smaller id. ``docs`` has one row an id."""
    spans = cut(window_spans(docs, window))
    seen = spans.groupBy("key").agg((F.min("doc_id") < F.max("doc_id")).alias("several"), F.count("*").alias("n")).where("several")
    found = resolve(spans, seen, F.col("doc_id"), lambda: discard(spans), few=True)
    windows = cut(_open_windows(docs, found.open, window))
    origin = cut(gathered(windows.groupBy("a", "b").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("origin < most").drop("most")))
    late = join_dealt(windows, origin, ["a", "b"], ["doc_id", "at"]).where("doc_id > origin").select("doc_id", F.col("at").alias("first"), F.col("at").alias("last"))
    return found.settled.unionByName(late)


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_removed and kept_text.

    A word is removed if a window of ``window`` words that covers it also
    starts in a document with a smaller id. kept_text joins the kept words by
    one space. Null texts have no words; repeated rows of one document are the
    same document and all keep the same words; of an id with different texts
    the one with the smallest hash is the document, and the others, like rows
    with a null doc_id, are kept whole and remove nothing.
    """
    unique, twice = distinct_documents(docs)
    ranges = by_document(repeated_ranges(unique, window), "ranges")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        def rows():
            for doc_id, text, found in each(batches, 64):
                words = words_of(text)
                n = len(words)
                if found:
                    gone = covered(n, found, window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                yield doc_id, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")

        return arrow_rows(schema, rows(), 500)

    return with_ranges(id_and_text(docs), ranges, twice).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, repeated words cut out of text and white space elsewhere as it was.

    A document all of whose words go is left out; one that had no word stays.
    Null and repeated ids as in dedup_words.
    """
    unique, twice = distinct_documents(docs)
    name = free_name(docs, "repeated_ranges")
    ranges = by_document(repeated_ranges(unique, window), name)
    pieces = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def work(texts, found):
        out = []
        for text, own in zip(texts, found, strict=True):
            if own:
                body = text.encode("utf-8", "surrogatepass")
                parts = pieces.findall(body)
                gone = covered(len(parts), own, window)
                lead = body[: len(body) - sum(map(len, parts))]
                kept = b"".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)
                text = (lead + kept).decode("utf-8", "surrogatepass") if kept else None
            out.append(text)
        return [out]

    marked = with_ranges(docs, ranges, twice)
    out = add_columns(marked, ["text", name], [StructField("text", StringType())], [pa.string()], work)
    return out.where(F.col("text").isNotNull() | F.col(name).isNull()).select(docs.columns)
