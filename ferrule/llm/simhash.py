"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a common point within ceil(r/2)
bits of each. So every distinct fingerprint emits all variants in that half
ball, equal variants meet in a shuffle, and each meeting pair is verified.
For r = 2 a fingerprint emits 65 variants, and a variant's bucket holds at most
65 different fingerprints however many documents there are, because equal
fingerprints were collapsed to one representative before.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, each, id_and_text
from .components import connected_components

SEED = 42


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """Hashes of all runs of ``words`` words, of the whole of a shorter text; none for a text without words or a null.

    The list grows with the text: some 40 bytes a word.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) < words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def of_hashes(hashes: list[int]) -> int:
    """64-bit SimHash of hashes; 0 for none."""
    total, sums = len(hashes), np.zeros(64, np.int64)
    for at in range(0, total, 65_536):  # bounded memory for the bits
        block = np.array(hashes[at : at + 65_536], dtype=">u8")
        sums += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > total).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of one text; 0 for a text without words or a null."""
    return of_hashes(shingle_hashes(text, words))


def simhash_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint) for every row. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches):
        def rows():
            for doc_id, text in each(batches):
                x = fingerprint(text, words)
                yield doc_id, x - (1 << 64) if x >> 63 else x

        return arrow_rows(schema, rows())

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, fingerprint bigint")


def ball_links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Verified (src, dst) between representatives at most ``radius`` bits apart.

    ``points`` has one row (rep bigint, fingerprint bigint) for each distinct
    fingerprint. Inside a bucket every member is within the half radius of the
    bucket's key, so members form one connected class; a star from the smallest
    representative loses no connection, and the pairs are verified again.
    """
    half = (radius + 1) // 2
    masks = sorted({sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)})
    signed = ",".join(f"{m - (1 << 64) if m >> 63 else m}L" if m != 1 << 63 else "shiftleft(1L, 63)" for m in masks)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select("rep", "fingerprint").repartition(tasks, "fingerprint")  # few small files hold many fingerprints
    variants = dealt.select("rep", "fingerprint", F.explode(F.expr(f"array({signed})")).alias("mask")).select(F.struct("rep", "fingerprint").alias("p"), F.expr("fingerprint ^ mask").alias("variant"))
    met = variants.groupBy("variant").agg(F.sort_array(F.collect_set("p")).alias("ps")).where(F.size("ps") > 1)
    if radius % 2:  # members of one bucket may be radius + 1 apart: look at all pairs of the bounded bucket
        stars = met.select(F.explode("ps").alias("a"), "ps").select("a", F.explode("ps").alias("b")).where("a.rep < b.rep")
    else:
        stars = met.select(F.col("ps")[0].alias("a"), F.explode(F.slice("ps", 2, F.size("ps"))).alias("b"))
    return stars.where(F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= radius).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst")).distinct()


def simhash_near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Null and empty texts have fingerprint zero and
    link like any other; a repeated row keeps its repeats; a row whose doc_id
    is null has its own fingerprint and never names a component unless all its
    class has null ids (then component_id is null). An empty table gives an
    empty result.
    """
    prints = cut(simhash_fingerprints(docs, words))
    points = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    points = cut(points)
    comps = connected_components(ball_links(points, radius))
    named = points.join(comps, points.rep == comps.node, "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")
