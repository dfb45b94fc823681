"""Near-duplicates of a corpus by the Jaccard likeness of word shingles.

SimHash alone loses texts with a few words replaced, whose fingerprints differ
in about ten bits. So every distinct text also has ``BANDS`` keys, each of
``ROWS`` seeded minima of its shingle hashes. A pair of likeness s shares a key
with probability 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8, and more above. Pairs
that share a key are verified by the exact likeness of their shingle sets.

A key's texts are first compared with their smallest one alone. Only where some
are in different components after that, the members outside the key's largest
component are compared with the others, in blocks of bounded size that yield
links between components and never their pairs. So no pair that could join two
components is left out, and a large group of near copies costs about one
comparison a member; only texts that share keys without being alike cost the
square of their number, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, each, gathered, id_and_text, join_dealt, sent
from .components import connected_components
from .simhash import SEED, ball_links, of_hashes, shingle_hashes

BANDS, ROWS = 24, 6

_rng = np.random.default_rng(SEED)
_FLIPS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(hashes: list[int]) -> np.ndarray:
    """The different hashes, ascending, as signed 64-bit numbers."""
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def digest_of(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)) if len(found) else 0


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band; none for a text without words."""
    if not len(found):
        return []
    low = (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):  # bounded memory on very long texts
        mixed = low[None, at : at + 4096] ^ _FLIPS
        mixed *= _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fingerprint, digest of the shingle set, its size, bands). No shuffle."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "fingerprint", "digest", "size")] + [("bands", pa.list_(pa.int64()))])

    def run(batches):
        def rows():
            for doc_id, text, text_hash in each(batches):
                hashes = shingle_hashes(text, words)
                found = shingle_set(hashes)
                yield doc_id, text_hash, _signed(of_hashes(hashes)), digest_of(found), len(found), band_keys(found)

        return arrow_rows(schema, rows(), 4096)

    hashed = id_and_text(docs).withColumn("text_hash", text_hash())
    return hashed.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint, digest bigint, size bigint, bands array<bigint>")


def text_hash(text: str = "text") -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of every row. No shuffle."""
    schema = pa.schema([("digest", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        def rows():
            for _, text in each(batches):
                found = shingle_set(shingle_hashes(text, words))
                yield digest_of(found), found

        return arrow_rows(schema, rows(), 256)

    return id_and_text(docs).mapInArrow(run, "digest bigint, shingles array<bigint>")


def _sets_of(digests: DataFrame, points: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(digest, shingles), written, of these digests."""
    wanted = cut(points.join(digests.distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    texts = docs.join(sent(cut(wanted.select("doc_id").distinct())), "doc_id", "left_semi")
    return cut(shingle_sets(texts, words).join(sent(wanted.select("digest")), "digest", "left_semi").dropDuplicates(["digest"]))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a and b, digests) whose shingle sets have a likeness of ``least`` or more."""
    both = pairs.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a")
    common = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return common.where(F.col("common") >= least * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b")


#: Texts and shingles of a block that is compared with another.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def _in_blocks(rest: DataFrame) -> DataFrame:
    """``rest`` (key, digest, size, component) dealt to comparisons (key, x, kind, y) with the side a row is on.

    Of each key, blocks x of members outside its largest component meet blocks y
    of that component (kind 0) and each other (kind 1, x <= y).
    """
    parts = cut(rest.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("sum")))
    whole = parts.groupBy("key").agg(F.max(F.struct("n", "sum", "component")).alias("most"), F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    split = cut(whole.select("key", "n", F.col("most.component").alias("main"), blocks(F.col("most.n"), F.col("most.sum")).alias("mains"), blocks(F.col("n") - F.col("most.n"), F.col("sum") - F.col("most.sum")).alias("others")))
    dealt = join_dealt(rest, split, ["key"], ["digest"])
    place = """if(component = main,
        transform(sequence(0, others - 1), i -> named_struct('x', i, 'kind', 0, 'y', cast(pmod(xxhash64(digest), mains) as int), 'side', 1)),
        flatten(transform(array(cast(pmod(xxhash64(digest), others) as int)), k -> concat(
          transform(sequence(0, mains - 1), j -> named_struct('x', k, 'kind', 0, 'y', j, 'side', 0)),
          transform(sequence(k, others - 1), j -> named_struct('x', k, 'kind', 1, 'y', j, 'side', 0)),
          transform(slice(sequence(0, k), 1, k), i -> named_struct('x', i, 'kind', 1, 'y', k, 'side', 1))))))"""
    return dealt.withColumn("at", F.explode(F.expr(place))).select("key", "at.*", "digest", "component")


def _linked(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Pairs of components of one comparison that hold alike members, enough of them to connect all such components."""
    side, label = (table.column(c).to_numpy().copy() for c in ("side", "component"))
    kind, x_, y_ = (table.column(c)[0].as_py() for c in ("kind", "x", "y"))
    lists = table.column("shingles").combine_chunks()
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    size = np.diff(offsets)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if kind == 1 and x_ == y_:  # a block against itself
        right = left
    own = np.repeat(np.arange(len(right)), size[right])
    flat = np.concatenate([values[offsets[r] : offsets[r + 1]] for r in right]) if len(right) else values[:0]
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    out = []
    for x in left.tolist():
        if (label[right] == label[x]).all():
            continue
        mine = values[offsets[x] : offsets[x + 1]]
        begin, end = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = end - begin
        met = own[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(met, minlength=len(right))
        alike = right[common >= least * (size[x] + size[right] - common) - 1e-9]
        for y in alike.tolist():
            if label[y] != label[x]:
                low, high = sorted((int(label[x]), int(label[y])))
                out.append((low, high))
                label[label == high] = low
    return out


def _late_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst): components joined by alike members of one key."""

    def run(table: pa.Table) -> pa.Table:
        found = np.array(_linked(table, least), np.int64).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["src", "dst"])

    return _in_blocks(rest).join(sets, "digest").groupBy("key", "x", "kind", "y").applyInArrow(run, "src bigint, dst bigint")


def shingle_near_duplicates(docs: DataFrame, least: float = 0.8, radius: int = 2, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, component_id, kept) for every row of ``docs`` that has an id.

    Links are pairs of texts whose shingle sets have a Jaccard likeness of
    ``least`` or more, or whose SimHash differs in at most ``radius`` bits;
    component_id is the smallest doc_id reachable, and kept marks the rows with
    the component's smallest doc_id and text hash. Null and empty texts link
    with each other. Texts of one doc_id are told apart by text_hash; repeated
    rows keep their repeats. An empty table gives an empty result.
    """
    docs = id_and_text(docs).where("doc_id is not null")
    prints = cut(shingle_prints(docs, words))
    points = cut(prints.groupBy("fingerprint", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    by_print = cut(points.groupBy("fingerprint").agg(F.min("digest").alias("rep")))

    keyed = points.select(F.explode("bands").alias("key"), "digest")
    first = cut(gathered(keyed.groupBy("key").agg(F.min("digest").alias("a"), F.count("*").alias("n")).where("n > 1")))
    met = cut(gathered(join_dealt(keyed, first, ["key"], ["digest"]).where("digest <> a")))
    sizes = points.select("digest", "size")
    pairs = met.select("a", F.col("digest").alias("b")).distinct()
    sized = pairs.join(sizes.withColumnsRenamed({"digest": "a", "size": "na"}), "a").join(sizes.withColumnsRenamed({"digest": "b", "size": "nb"}), "b")
    stars = cut(sized.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select("a", "b"))
    sets = _sets_of(stars.select(F.col("a").alias("digest")).unionByName(met.select("digest")), points, docs, words)
    alike = cut(gathered(_alike(stars, sets, least)))

    near = ball_links(by_print, radius).unionByName(alike.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    same = points.select("fingerprint", F.col("digest").alias("src")).join(by_print.withColumnRenamed("rep", "dst"), "fingerprint").where("src <> dst").select("src", "dst")
    own = cut(connected_components(near.unionByName(same)))

    placed = cut(met.join(own.withColumnRenamed("node", "digest"), "digest", "left").join(sizes, "digest").select("key", "digest", "size", F.coalesce("component", "digest").alias("component")))
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    rest = cut(join_dealt(placed, mixed, ["key"], ["digest"]))  # the smallest was compared with all
    late = cut(gathered(_late_links(rest, sets, least)))
    over = connected_components(late).select(F.col("node").alias("component"), F.col("component").alias("top"))
    tops = (
        points.select("fingerprint", "digest")
        .join(own.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("component", F.coalesce("component", "digest"))
        .join(over, "component", "left")
        .select("fingerprint", "digest", F.coalesce("top", "component").alias("component"))
    )
    named = cut(prints.select("doc_id", "text_hash", "fingerprint", "digest").join(tops, ["fingerprint", "digest"]).select("doc_id", "text_hash", "component"))
    chosen = cut(named.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("n")))
    found = join_dealt(named, chosen, ["component"], ["doc_id", "text_hash"])
    return found.select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("kept"))
