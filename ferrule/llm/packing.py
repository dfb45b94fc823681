"""Hierarchical packing of token sequences into several context sizes.

Every document is routed to the smallest tier (context size) that holds it and
opens a window there, unless a gap of a longer window that is already open
takes it whole: the tightest such gap is filled first. When too many windows are
open, the fullest are closed by cutting the next documents to fit. At the end of
a partition the emptiest windows are taken apart to fill the others, and what
remains is laid out in windows of powers of two, so no sequence needs padding.

Windows are filled inside each partition of the input, so nothing is shuffled
and memory is bounded by ``open_windows`` windows whatever the input's size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import load
from .common import arrow_rows, id_and_text, slices

TIERS = (512, 1024, 2048, 4096)


class _Window:
    __slots__ = ("pieces", "room", "size", "stamp")

    def __init__(self, size: int, stamp: int):
        self.size, self.room, self.stamp, self.pieces = size, size, stamp, []

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.room -= len(piece[2]) // 4


class Packer:
    """Packs the documents of one partition; emits (size, pieces) of full windows.

    A piece is (document key, start, ids as little-endian uint32 bytes).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, open_windows: int = 96):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers, self.most, self.open, self.stamp = sorted(tiers), open_windows, [], 0
        #: Sorted (room, stamp, window) of the open windows.

    def add(self, key, ids: bytes) -> Iterator[tuple[int, list]]:
        top, start, left = self.tiers[-1], 0, len(ids) // 4
        while left > 0:
            piece_of = lambda n: (key, start, ids[4 * start : 4 * (start + n)])
            if left >= top:
                yield top, [piece_of(top)]
                start, left = start + top, left - top
                continue
            at = bisect_left(self.open, (left, -1))
            if at < len(self.open):  # the tightest gap that takes it whole
                n, window = left, self.open.pop(at)[2]
            elif len(self.open) >= self.most:  # cut it to close the fullest window
                room, _, window = self.open.pop(0)
                n = min(room, left)
            else:
                self.stamp += 1
                n, window = left, _Window(next(t for t in self.tiers if t >= left), self.stamp)
            window.add(piece_of(n))
            start, left = start + n, left - n
            if window.room:
                insort(self.open, (window.room, window.stamp, window))
            else:
                yield window.size, window.pieces

    def finish(self) -> Iterator[tuple[int, list]]:
        windows = [w for _, _, w in sorted(self.open, key=lambda x: (x[2].size - x[0], x[1]))]  # least filled first
        self.open = []
        low, high = 0, len(windows) - 1
        while low < high:
            donor, taker = windows[low], windows[high]
            while donor.pieces and taker.room:
                key, start, ids = donor.pieces.pop()
                n = min(taker.room, len(ids) // 4)
                taker.add((key, start + len(ids) // 4 - n, ids[len(ids) - 4 * n :]))
                donor.room += n
                if 4 * n < len(ids):
                    donor.pieces.append((key, start, ids[: len(ids) - 4 * n]))
            if not taker.room:
                yield taker.size, taker.pieces
                high -= 1
            if not donor.pieces:
                low += 1
        if low == high and windows[low].pieces:
            yield from self._powers(windows[low])

    @staticmethod
    def _powers(window: _Window) -> Iterator[tuple[int, list]]:
        """The last window's content, at most one partly filled window, in windows of powers of two."""
        total, pieces = window.size - window.room, list(window.pieces)
        while total:
            size, out, need = 1 << (total.bit_length() - 1), [], 1 << (total.bit_length() - 1)
            while need:
                key, start, ids = pieces.pop(0)
                n = min(need, len(ids) // 4)
                out.append((key, start, ids[: 4 * n]))
                need -= n
                if 4 * n < len(ids):
                    pieces.insert(0, (key, start + n, ids[4 * n :]))
            total -= size
            yield size, out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, open_windows: int = 96, step_tokens: int = 65_536, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each packed sequence.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset (in the
    sequence), tier (the sequence's length), step_group (sequences of one tier
    that together hold ``step_tokens`` tokens, so steps are balanced), and with
    ``with_ids`` the ids (little-endian uint32 bytes). Every document ends with
    ``end_id``, so null and empty texts make a piece of one token. Repeated rows
    are packed as often as they occur. sequence_id and step_group are unique
    over the whole result: the partition's number in the high bits.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    closing = end_id.to_bytes(4, "little")

    def run(batches):
        bpe, packer = load(tokenizer_path), Packer(tiers, open_windows)
        base = TaskContext.get().partitionId() << 32
        made, groups, room = 0, 0, {}

        def done(windows):
            nonlocal made, groups
            for size, pieces in windows:
                if room.get(size, (0, 0))[1] < size:
                    room[size] = groups, step_tokens
                    groups += 1
                group, left = room[size]
                room[size] = group, left - size
                offset = 0
                for (doc_id, total), start, ids in pieces:
                    n = len(ids) // 4
                    row = (doc_id, start, n, zlib.crc32(ids), total, base | made, offset, size, base | group)
                    yield (*row, ids) if with_ids else row
                    offset += n
                made += 1

        def rows():
            for doc_ids, texts in slices(batches):
                for doc_id, ids in zip(doc_ids, bpe.encode_many(texts), strict=True):
                    yield from done(packer.add((doc_id, len(ids) // 4 + 1), ids + closing))
            yield from done(packer.finish())

        return arrow_rows(schema, rows(), 2000 if with_ids else 20_000)

    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return id_and_text(docs).mapInArrow(run, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema))
