"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by any
merge, so between its two bytes there is a certain cut. A word is split at all
its cuts, the fragments are encoded independently (and remembered), and their
ids are concatenated. Words themselves are the tokenizer's own pre-tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, arrow_rows, id_and_text, slices

# Letters and numbers that are newer than Python's own table.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters whose lower case may be newer than Python's table.
UNSURE_CASE = re.compile("[ᲉꟋ-Ƛ\U00010d40-\U00010d85\U00016ea0-\U00016eff]")
#: Characters that may need more than lower case, and those beyond the basic plane.
UNUSUAL, ASTRAL = re.compile("[^\x00-\u012f\u0131-\u017f]"), re.compile("[\U00010000-\U0010ffff]")
#: Most words remembered by a worker.
WORD_CACHE = 300_000
NO_MERGE, NOTHING, WIDTHS = 1 << 30, 1 << 29, (0, 4, 8, 12, 16, 24, 40)


def _ranges(first: str, extra: list, top: int) -> str:
    found, start = list(extra), None
    for i in range(top + 2):
        inside = i <= top and unicodedata.category(chr(i))[0] == first
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            found.append((start, i - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found if a <= top)


@cache
def _pattern(top: int) -> re.Pattern:
    """Pre-token pattern for texts whose characters are at most ``top``."""
    letters, numbers = _ranges("L", NEW_LETTERS, top), _ranges("N", NEW_NUMBERS, top)
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^{SPACES}{letters}{numbers}]+")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _check(spec: dict, path: str) -> None:
    """An error unless the file says what this encoder does: its normaliser, pre-tokens, model flags and decoder are built in."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    normal = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    told = {
        "normalizer": normal == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)],
        "pre_tokenizer": len(steps) == 2
        and steps[0].get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex"),
        "decoder": spec.get("decoder") is None,
        "model": model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    wrong = [name for name, ok in told.items() if not ok]
    if wrong:
        raise ValueError(f"{path}: unsupported {', '.join(wrong)}")


class Words(dict):
    """Ids of known words; any other is None and noted in ``unknown``."""

    unknown: dict[str, None]

    def __missing__(self, word: str) -> None:
        self.unknown[word] = None

    def look(self, words: list[str]) -> tuple:
        return itemgetter(*words)(self) if len(words) > 1 else tuple(map(self.__getitem__, words))


class WordBpe:
    """Encoder and decoder over one tokenizers JSON file with word-end BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.chars = _byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(self.end)
            if all(c in back for c in body):
                own = [back[c] for c in body]
                joined[own[:-1], own[1:]] = True
        self.joined = joined
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first_added = sorted({c[:2] for c in self.added})
        table = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [table.get(i, "") for i in range(max(table) + 1)]
        ids = [self.vocab[c] for c in self.chars], [self.vocab[c + self.end] for c in self.chars]
        self.byte_ids = np.array(ids, np.int32).ravel()  # from 256 up: at the end of a word
        merged = [(self.vocab[a] << 32 | self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.rank.items()]
        merged.sort()
        self.pair_keys = np.array([k for k, _, _ in merged] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r, _ in merged] + [NO_MERGE], np.int32)
        self.made = np.zeros(len(self.rank), np.int32)
        self.made[[r for _, r, _ in merged]] = [i for _, _, i in merged]
        self.byte_ranks = self._ranks(self.byte_ids[:256, None], self.byte_ids)
        self.words = Words()

    def fragments(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes of the words, and each fragment's start, end and whether it ends its word."""
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))
        cut = np.ones(len(flat), bool)  # at i: a fragment ends with byte i
        cut[:-1] = ~self.joined[flat[:-1], flat[1:]]
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        stop = np.flatnonzero(cut | last) + 1
        return flat, np.concatenate([[0], stop[:-1]]), stop, last[stop - 1]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Bytes of the ids of each word: fragments of like length are merged side by side."""
        bodies = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, start, stop, final = self.fragments(bodies)
        length = stop - start
        count, parts = np.zeros(len(start), np.int64), []
        for low, high in zip(WIDTHS, WIDTHS[1:], strict=False):
            at = np.flatnonzero((length > low) & (length <= high))
            if len(at):
                got, n = self._merge_many(flat, start[at], length[at], final[at], high)
                count[at] = n
                parts.append((at, got))
        for k in np.flatnonzero(length > WIDTHS[-1]).tolist():
            symbols = [self.chars[b] for b in flat[start[k] : stop[k]].tolist()]
            if final[k]:
                symbols[-1] += self.end
            got = np.array([[self.vocab[s] for s in self._merge_long(symbols)]], np.int64)
            count[k] = got.shape[1]
            parts.append((np.array([k]), got))
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(offset[-1], "<u4")
        for at, got in parts:
            col = np.arange(got.shape[1])
            used = col < count[at][:, None]
            out[(offset[at][:, None] + col)[used]] = got[used]
        ids = out.tobytes()
        ends = (offset[np.flatnonzero(final) + 1] * 4).tolist()
        return dict(zip(words, (ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NO_MERGE))

    def _merge_many(self, flat, start, length, final, width) -> tuple[np.ndarray, np.ndarray]:
        """Merge the leftmost lowest-ranked pair of every row until none has one."""
        n = len(start)
        col = np.arange(width)
        inside = col < length[:, None]
        code = flat[np.minimum(start[:, None] + col, len(flat) - 1)].astype(np.int16)
        tail = np.flatnonzero(final)
        code[tail, length[tail] - 1] += 256
        s = np.where(inside, self.byte_ids[code], np.int32(NOTHING))
        done, count = s.copy(), length.copy()
        row = np.arange(n)
        ranks = np.full((n, width + 1), NO_MERGE, np.int32)  # ranks[:, j + 1] is of symbols j and j + 1
        ranks[:, 1:-1] = np.where(inside[:, 1:], self.byte_ranks[code[:, :-1] & 255, code[:, 1:]], np.int32(NO_MERGE))
        while len(row):
            j = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), j]
            on = low < NO_MERGE
            if not on.all():
                done[row[~on]] = s[~on]
                row, s, ranks, j, low = row[on], s[on], ranks[on], j[on] , low[on]
                if not len(row):
                    break
            j = j - 1
            every = np.arange(len(row))
            s[every, j] = self.made[low]
            take = np.minimum(col + (col > j[:, None]), width - 1)
            s = np.take_along_axis(s, take, axis=1)
            s[:, -1] = NOTHING
            wide = np.arange(width + 1)
            ranks = np.take_along_axis(ranks, np.minimum(wide + (wide > j[:, None]), width), axis=1)
            ranks[every, j + 1] = self._ranks(s[every, j], s[every, np.minimum(j + 1, width - 1)])
            left = j > 0
            ranks[every[left], j[left]] = self._ranks(s[every[left], j[left] - 1], s[every[left], j[left]])
            count[row] -= 1
        return done, count

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same merges by a heap over a linked list: n log n for very long words."""
        n, get = len(s), self.rank.get
        nxt, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], live[j], nxt[i] = a + b, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := get((s[i], s[nxt[i]]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[nxt[i]]))
            if prev[i] >= 0 and (r := get((s[prev[i]], s[i]))) is not None:
                heapq.heappush(heap, (r, prev[i], s[prev[i]], s[i]))
        return [x for x, on in zip(s, live, strict=True) if on]

    def _plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return _pattern(127).findall(text.lower())
        if not UNUSUAL.search(text):  # composed already, and lower case stays below U+0180
            return _pattern(0x17F).findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if UNSURE_CASE.search(text):
            from tokenizers.normalizers import Lowercase

            text = Lowercase().normalize_str(text)
        text = text.replace("Σ", "σ").lower()  # the tokenizer has no final sigma
        return _pattern(sys.maxunicode if ASTRAL.search(text) else 0xFFFF).findall(text)

    def _pieces(self, text: str) -> list:
        """Words of a text, and ids of the special tokens spelt out in it."""
        if any(start in text for start in self.first_added):
            return [self.added[p] if p in self.added else self._plain(p) for p in self.split_added.split(text)]
        return [self._plain(text)]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(t or "") for t in texts]
        known = self.words
        known.unknown = {}
        found = [[p if isinstance(p, int) else known.look(p) for p in ps] for ps in pieces]
        new = known.unknown
        if len(known) + len(new) > WORD_CACHE:
            used = {w: known[w] for ps in pieces for p in ps if not isinstance(p, int) for w in p if w not in new}
            self.words = Words(used if len(used) + len(new) <= WORD_CACHE else {})
        got = self.learn(list(new)) if new else {}
        if len(self.words) + len(got) <= WORD_CACHE:
            self.words.update(got)

        def ids(piece, own) -> bytes:
            if isinstance(own, int):
                return own.to_bytes(4, "little")
            return b"".join([got[w] if x is None else x for w, x in zip(piece, own, strict=True)] if None in own else own)

        return [b"".join(map(ids, ps, own)) if len(ps) > 1 else ids(ps[0], own[0]) for ps, own in zip(pieces, found, strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces: this tokenizer declares no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def load(path: str) -> WordBpe:
    """One encoder a worker process and file, until another operator's task drops it."""
    return WordBpe(path)


CACHES.append(load.cache_clear)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids binary, n_tokens) for every row; no shuffle.

    ids holds little-endian unsigned 32-bit integers. Null and empty texts have
    no ids; repeated rows keep their repeats; an empty table stays empty.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        bpe = load(tokenizer_path)
        def rows():
            for ids, texts in slices(batches):
                yield from ((d, x, len(x) // 4) for d, x in zip(ids, bpe.encode_many(texts), strict=True))

        return arrow_rows(schema, rows(), 500)

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text) from the rows of encode_documents; null ids decode to ''."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = load(tokenizer_path)

        def rows():
            for columns in slices(batches):
                yield from ((d, x, n, bpe.decode(np.frombuffer(x or b"", "<u4"))) for d, x, n in zip(*columns, strict=True))

        return arrow_rows(schema, rows(), 500)

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint, text string")
