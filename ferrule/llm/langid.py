"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters, word
ends marked) in order. A document's own most frequent n-grams are compared to
every profile by the out-of-place distance: how far each n-gram stands from its
place in the profile, or the profile's length if it isn't there.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import add_columns, arrow_rows, each, fold, id_and_text

UNKNOWN = "und"
#: Most languages whose cut-offs are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 10_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str | None, n_max: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of the whole text, ascending, and their counts.

    A code packs up to three code points of 21 bits; other characters than
    letters count as one word end.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]])
    gap = points == 32
    points = points[~(gap & np.concatenate([[False], gap[:-1]]))]
    found, code = [points[points != 32]], points
    for _ in range(n_max - 1):
        code = (code[:-1] << 21) | points[len(points) - len(code) + 1 :]
        found.append(code)
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Profiles of all languages: for each n-gram of any of them, the languages that have it and its place there.

    Entries are as many as the profiles are long together.
    """

    def __init__(self, by_lang: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(by_lang), size
        code = np.concatenate([np.empty(0, np.int64), *(by_lang[x] for x in self.langs)])
        lang = np.concatenate([np.empty(0, np.int64), *(np.full(len(by_lang[x]), i) for i, x in enumerate(self.langs))])
        rank = np.concatenate([np.empty(0, np.int64), *(np.arange(len(by_lang[x])) for x in self.langs)])
        order = np.lexsort((lang, code))
        self.codes, begin = np.unique(code[order], return_index=True)
        self.begin = np.append(begin, len(code))
        self.lang, self.rank = lang[order], rank[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - normalised distance); ('und', 0) without letters."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        codes = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, codes)
        place = np.flatnonzero((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes))
        first, n = self.begin[at[place]], self.begin[at[place] + 1] - self.begin[at[place]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        saved = self.size - np.abs(self.rank[entry] - np.repeat(place, n))  # a missing n-gram is the profile's length away
        distance = 1.0 - np.bincount(self.lang[entry], saved, len(self.langs)) / (self.size * len(codes))
        best = int(np.argmin(distance))  # of equally near ones the first
        return self.langs[best], float(max(0.0, 1.0 - distance[best]))


def learn_profiles(docs: DataFrame, size: int = 300, per_language: int = 4000) -> Profiles:
    """Profiles from rows with text and lang.

    The fit reads about ``per_language`` documents of each language: those whose
    hashed id is below a bound that follows from the language's count, so a
    language costs one row a task and texts are never shuffled. n-gram counts are
    summed on the executors; the driver gets ``size`` rows a language.
    """
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    cuts = labelled.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share")).select("lang", (F.col("share") * float(1 << 63)).alias("cut"))
    small = cuts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    chosen = labelled.join(F.broadcast(cuts) if small else cuts, "lang").where("h <= cut").select("lang", "text")

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

        def rows():
            for lang, text in each(batches):
                yield from ((lang, a, b) for a, b in zip(*(x.tolist() for x in ngrams(text)), strict=True))

        return arrow_rows(schema, rows())

    counted = chosen.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    by_lang: dict[str, list] = {}
    for row in top.select("lang", "code", "r").collect():
        by_lang.setdefault(row["lang"], []).append((row["r"], row["code"]))
    return Profiles({k: np.array([c for _, c in sorted(v)], np.int64) for k, v in by_lang.items()}, size)


def identify_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Null texts and texts without a letter give 'und' with score 0, as does
    every text if no language was learnt. score is one minus the normalised
    out-of-place distance to the nearest profile; ties go to the language that
    sorts first. Repeated rows keep their repeats.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        return arrow_rows(schema, ((doc_id, *profiles.predict(text)) for doc_id, text in each(batches)))

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def annotate_languages(docs: DataFrame, profiles: Profiles, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (or what ``names`` says) added or replaced."""

    def work(texts):
        found = [profiles.predict(t) for t in texts]
        return [[x for x, _ in found], [y for _, y in found]]

    return add_columns(docs, ["text"], [StructField(names[0], StringType()), StructField(names[1], DoubleType())], [pa.string(), pa.float64()], work)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows the query may learn from."""
    return docs.where(fold("doc_id", 4) != 2)
