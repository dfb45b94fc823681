"""Approximate search: codebooks, cells, product codes, hashing, proximity graphs, filters.

Codebooks are small numpy arrays on the driver (k rows); vectors never leave the
executors but for bounded seeds. Every assignment is one matrix product a batch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import written
from ..plans.ranking import top_k
from .dense import _matrix, _table, _Vectors


#: Most queries whose vectors or tables are sent to every task at once.
MOST_QUERIES = 4096
#: The same where a task only meets the queries that share a bucket with its rows.
MOST_BUCKET_QUERIES = 32768


def in_blocks(queries: DataFrame, search, most: int | None = None) -> DataFrame:
    """``search`` over blocks of at most about ``most`` (MOST_QUERIES) collected queries [(qid, vec)], united.

    What a task is sent is bounded however many queries there are; the corpus is
    scanned once a block.
    """
    n = queries.count()
    blocks = max(1, -(-n // (most or MOST_QUERIES)))
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = [(x[0], np.array(x[1])) for x in own.select("qid", F.col("vec").cast("array<double>")).collect()]
        part = search(rows)
        out = part if out is None else out.unionByName(part)
    return out


# Vector quantisation.
def _literal(x) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def nearest_codes(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest codeword (lowest of equals) and the squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :]
    code = np.round(d, 9).argmin(axis=1)
    return code, np.maximum(d[np.arange(len(x)), code], 0.0)


def assign(vectors: DataFrame, book: np.ndarray, vec: str = "vec") -> DataFrame:
    """The rows with ``cell`` and ``residual2`` added."""
    at = vectors.columns.index(vec)
    schema = vectors.select("*", F.lit(0).cast("bigint").alias("cell"), F.lit(0.0).alias("residual2")).schema

    def run(batches):
        for batch in batches:
            code, d = nearest_codes(_matrix(batch.column(at)), book) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64()), pa.array(d, pa.float64())], names=[*batch.schema.names, "cell", "residual2"])

    return vectors.mapInArrow(run, schema)


def cell_sums(vectors: DataFrame, book: np.ndarray, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts of the cells and the distortion, in one scan; one small table a task is shuffled."""

    def run(batches):
        sums, counts, total = np.zeros_like(book), np.zeros(len(book)), np.zeros(len(book))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                code, d = nearest_codes(x, book)
                np.add.at(sums, code, x)
                counts += np.bincount(code, minlength=len(book))
                total[0] += d.sum()
        yield pa.RecordBatch.from_pydict({"k": list(range(len(book))), "s": np.column_stack([counts, total, sums]).tolist()})

    parts = vectors.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "k long, s array<double>")
    wide = parts.select("k", F.posexplode("s").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).orderBy("k", "i").collect()
    whole = np.array([r["x"] for r in wide]).reshape(len(book), -1)
    return whole[:, 2:], whole[:, 0], float(whole[:, 1].sum())


def seed_codebook(vectors: DataFrame, k: int, vec: str = "vec", seed: int = 0, most: int = 4096) -> np.ndarray:
    """D^2-weighted seeds from a bounded, hash-chosen sample of at most ``most`` vectors."""
    rows = vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select(F.col(vec).cast("array<double>")).collect()
    x, rng = np.array([r[0] for r in rows]), np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else len(chosen))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lloyd(vectors: DataFrame, book: np.ndarray, rounds: int = 10, tol: float = 1e-9, vec: str = "vec") -> tuple[np.ndarray, list[float]]:
    """Codebook and distortion after each round; an empty cell keeps its codeword."""
    history: list[float] = []
    for _ in range(rounds):
        sums, counts, total = cell_sums(vectors, book, vec)
        history.append(total)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        moved, book = float(((new - book) ** 2).sum()), new
        if moved < tol:
            break
    return book, history


# Product quantisation.
def subspaces(d: int, m: int) -> list[slice]:
    if d % m:
        raise ValueError("the dimension must be a multiple of the number of subspaces")
    return [slice(j * d // m, (j + 1) * d // m) for j in range(m)]


def train_product(vectors: DataFrame, d: int, m: int, k_star: int, rounds: int = 6, seed: int = 0, vec: str = "vec") -> list[np.ndarray]:
    books = []
    for j, part in enumerate(subspaces(d, m)):
        own = vectors.select("doc_id", F.slice(vec, part.start + 1, part.stop - part.start).alias("vec"))
        books.append(lloyd(own, seed_codebook(own, k_star, seed=seed + 101 * j), rounds)[0])
    return books


def product_codes(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.stack([nearest_codes(x[:, p], b)[0] for p, b in zip(subspaces(x.shape[1], len(books)), books, strict=True)], axis=1)


def product_decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.hstack([b[codes[:, j]] for j, b in enumerate(books)])


def encode(vectors: DataFrame, books: list[np.ndarray], vec: str = "vec") -> DataFrame:
    """(doc_id, codes array<int>, error): product codes and squared error."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.empty((0, 0))
            codes = product_codes(x, books) if len(x) else np.empty((0, 0), int)
            error = ((x - product_decode(codes, books)) ** 2).sum(1) if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error, pa.float64())], names=["doc_id", "codes", "error"])

    return vectors.select("doc_id", F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "doc_id bigint, codes array<int>, error double")


def distance_table(q: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Squared distances of a query's parts to all codewords."""
    return np.stack([((b - q[p]) ** 2).sum(1) for p, b in zip(subspaces(len(q), len(books)), books, strict=True)])


def code_search(queries: DataFrame, encoded: DataFrame, books: list[np.ndarray], k: int = 10, symmetric: bool = False, skip_self: bool = True) -> DataFrame:
    """Nearest codes by table look-ups; with ``symmetric`` the query is quantised too. Queries are (qid, vec)."""
    return top_k(in_blocks(queries, lambda rows: _code_search(rows, encoded, books, k, symmetric, skip_self)), k)


def _code_search(rows, encoded, books, k, symmetric, skip_self) -> DataFrame:
    tables = []
    for qid, q in rows:
        q = product_decode(product_codes(q[None, :], books), books)[0] if symmetric else q
        tables.append((qid, distance_table(q, books)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, codes = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            out = []
            for qid, table in tables:
                d = table[np.arange(len(books)), codes].sum(axis=1)
                if skip_self:
                    d = np.where(ids == qid, np.inf, d)
                near = np.lexsort((ids, np.round(d, 9)))[:k]
                out += [(qid, int(ids[i]), -float(d[i])) for i in near if np.isfinite(d[i])]
            yield from _table(out).to_batches()

    return encoded.select("doc_id", "codes").mapInArrow(run, "qid bigint, doc_id bigint, score double")


def parametric_rotation(values: np.ndarray, axes: np.ndarray, m: int) -> np.ndarray:
    """Principal axes dealt to m subspaces so that the subspaces' summed log variances balance."""
    room, load = len(values) // m, np.zeros(m)
    dealt: list[list[int]] = [[] for _ in range(m)]
    for i in np.argsort(values)[::-1].tolist():
        j = min((j for j in range(m) if len(dealt[j]) < room), key=lambda j: (load[j], j))
        dealt[j].append(i)
        load[j] += np.log(max(values[i], 1e-12))
    return axes[[i for part in dealt for i in part]]


def procrustes(cross: np.ndarray) -> np.ndarray:
    """The rotation that best maps data to its codes, from their d x d cross product sum(x code^T)."""
    u, _, v = np.linalg.svd(cross)
    return (u @ v).T


def _sums(vectors: DataFrame, make, vec: str = "vec") -> np.ndarray:
    """Sum over all batches of ``make(matrix)``, an array of fixed shape; the driver gets one array a partition."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [np.ravel(total).tolist()]})

    rows = vectors.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "s array<double>").collect()
    return sum(np.array(r["s"]) for r in rows)


def train_rotated(vectors: DataFrame, d: int, m: int, k_star: int, rounds: int = 4, steps: int = 3, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """A rotation and product codebooks trained in turn, and the distortion before each turn of the rotation.

    Every round moves the codebooks a few steps on the rotated vectors and then turns
    the space so that vectors come nearest to their codes (orthogonal
    Procrustes). Neither step can raise the distortion.
    """
    turn, books, history = np.eye(d), None, []
    for _ in range(rounds):
        turned = _rotated(vectors, turn)
        if books is None:
            books = train_product(turned, d, m, k_star, steps, seed)
        else:
            for j, part in enumerate(subspaces(d, m)):
                own = turned.select("doc_id", F.slice("vec", part.start + 1, part.stop - part.start).alias("vec"))
                books[j] = lloyd(own, books[j], steps)[0]

        def cross(x, turn=turn, books=books):
            y = x @ turn.T
            code = product_decode(product_codes(y, books), books)
            return np.append(x.T @ code, ((y - code) ** 2).sum())

        sums = _sums(vectors, cross)
        history.append(float(sums[-1]))
        turn = procrustes(sums[:-1].reshape(d, d))
    return turn, books, history


def _rotated(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    from .dense import project

    return project(vectors.select("doc_id", "vec"), turn)


# Codewords that keep inner products of the best matches.
def anisotropic_distances(x: np.ndarray, book: np.ndarray, eta: float) -> np.ndarray:
    """Squared residuals with the part along x weighted ``eta`` times the part across it."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    whole = (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :]
    along = ((x * unit).sum(1)[:, None] - unit @ book.T) ** 2
    return np.maximum(whole, 0.0) + (eta - 1) * along


def anisotropic_lloyd(vectors: DataFrame, book: np.ndarray, eta: float, rounds: int = 5) -> tuple[np.ndarray, list[float]]:
    """Codebook and weighted distortion of each round: assign by the weighted distance, then solve each cell's least squares.

    A cell's best codeword c solves sum(A_x) c = sum(A_x x) with
    A_x = I + (eta - 1) u u^T, u being x at unit length; with eta = 1 it is the mean.
    """
    k, d = book.shape
    history = []
    for _ in range(rounds):

        def sums(x, book=book):
            far = anisotropic_distances(x, book, eta)
            code = np.round(far, 9).argmin(axis=1)
            unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
            out = np.zeros(k * (d * d + d + 1) + 1)
            for c in range(k):
                u, own = unit[code == c], x[code == c]
                a = len(u) * np.eye(d) + (eta - 1) * u.T @ u
                b = own.sum(0) + (eta - 1) * (u * (u * own).sum(1)[:, None]).sum(0)
                out[c * (d * d + d + 1) : (c + 1) * (d * d + d + 1)] = np.concatenate([a.ravel(), b, [len(u)]])
            out[-1] = far[np.arange(len(x)), code].sum()
            return out

        total = _sums(vectors, sums)
        history.append(float(total[-1]))
        parts = total[:-1].reshape(k, -1)
        book = np.array([np.linalg.solve(part[: d * d].reshape(d, d), part[d * d : -1]) if part[-1] else old for part, old in zip(parts, book, strict=True)])
    return book, history


# Buckets of vectors.
def bucket_topk(queries: DataFrame, corpus: DataFrame, asked, kept, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank): exact squared distances to the vectors that share a bucket with the query.

    ``asked`` and ``kept`` give the buckets of a matrix of queries and of one of
    corpus rows, a line each. A task meets them bucket by bucket, in tiles, and
    keeps k rows a query and bucket, so no pair becomes a row. The k best of all
    buckets are among the k best of each, where a vector can be several times.
    """

    def search(rows):
        qids, q = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows])
        order, at = (np.empty(0, np.int64), {}) if not len(rows) else _by_bucket(asked(q))

        def run(batches):
            found: dict[int, _Vectors] = {}
            for batch in batches:
                if batch.num_rows and len(qids):
                    ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                    own, here = _by_bucket(kept(x))
                    for bucket in here.keys() & at.keys():
                        mine = order[at[bucket]]
                        if bucket not in found:
                            found[bucket] = _Vectors(qids[mine], q[mine], k, "euclidean", True)
                        found[bucket].add_rows(ids[own[here[bucket]]], x[own[here[bucket]]])
            parts = [b for v in found.values() for b in v.nearest.batches()]
            if parts:
                yield from _best(pa.Table.from_batches(parts), k).to_batches()

        return corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("vec").cast("array<double>").alias("v")).where("doc_id is not null and v is not null").mapInArrow(run, "qid bigint, doc_id bigint, score double")

    return top_k(in_blocks(queries.where("qid is not null and vec is not null"), search, MOST_BUCKET_QUERIES), k)


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """Lines in order of their buckets (a line is there once for each), and where each bucket's lie."""
    flat = buckets.ravel()
    order = np.argsort(flat, kind="stable")
    names, first = np.unique(flat[order], return_index=True)
    ends = np.append(first[1:], len(flat))
    return order // buckets.shape[1], {int(b): slice(s, e) for b, s, e in zip(names, first, ends, strict=True)}


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best different rows of each query."""
    qid, doc, score = (c.to_numpy() for c in found.columns)
    order = np.lexsort((doc, -np.round(score, 9), qid))
    qid, doc, score = qid[order], doc[order], score[order]
    new = np.append(True, (qid[1:] != qid[:-1]) | (doc[1:] != doc[:-1]))  # the same pair has the same score
    qid, doc, score = qid[new], doc[new], score[new]
    top = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return pa.table([pa.array(x[top]) for x in (qid, doc, score)], names=["qid", "doc_id", "score"])


# Cells.
def _near_cells(x: np.ndarray, book: np.ndarray, nprobe: int) -> np.ndarray:
    """The nprobe nearest cells of each row."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)
    return np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :nprobe]


def probe(queries: DataFrame, corpus: DataFrame, book: np.ndarray, nprobe: int, k: int = 10) -> DataFrame:
    """Exact ranking (qid, doc_id, score, rank) inside each query's nprobe nearest cells."""
    return bucket_topk(queries, corpus, lambda q: _near_cells(q, book, nprobe), lambda x: nearest_codes(x, book)[0][:, None], k)


def probed(queries: DataFrame, corpus: DataFrame, book: np.ndarray, nprobe: int) -> DataFrame:
    """(qid, scanned): how many vectors lie in each query's nprobe nearest cells, itself not counted; queries without any are left out.

    The sizes of the cells are added up, so no pair is formed.
    """

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _near_cells(_matrix(batch.column(1)), book, nprobe)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))), pa.array(cells.ravel())], names=["qid", "cell"])

    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").cast("array<double>").alias("v")).where("qid is not null and v is not null").mapInArrow(near, "qid bigint, cell bigint")
    cells = written(assign(corpus.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "vec"), book).select("doc_id", "cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    own = cells.groupBy(F.col("doc_id").alias("qid"), "cell").agg(F.count("*").alias("own"))
    met = asked.join(F.broadcast(sizes), "cell").join(own, ["qid", "cell"], "left")
    return met.groupBy("qid").agg(F.sum(F.col("size") - F.coalesce("own", F.lit(0))).alias("scanned")).where("scanned > 0")


# Pivots and the triangle inequality.
def inspected_share(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, skip_self: bool = True) -> DataFrame:
    """(qid, share): candidates that no pivot rules out for the exact nearest neighbour.

    A candidate x goes if |d(q, p) - d(p, x)| exceeds the nearest distance for some
    pivot p. Distances to the pivots are worked out once a vector and block of
    queries, and a task keeps two numbers a query.
    """
    from .dense import knn

    near = knn(queries, corpus, 1, "euclidean", skip_self).select("qid", F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("radius"))
    # the radius goes with its query, as one more component
    reaching = written(queries.select("qid", "vec").join(near, "qid").select("qid", F.concat(F.col("vec").cast("array<double>"), F.array("radius")).alias("vec")))
    away = lambda x: np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))

    def search(rows):
        asked = [(qid, away(q[None, :-1])[0], float(q[-1])) for qid, q in rows]

        def run(batches):
            kept, seen = np.zeros(len(asked)), np.zeros(len(asked))
            for batch in batches:
                if batch.num_rows:
                    ids, far = batch.column(0).to_numpy(), away(_matrix(batch.column(1)))
                    for i, (qid, own, r) in enumerate(asked):
                        other = (ids != qid) | (not skip_self)
                        kept[i] += (other & (np.round(np.abs(far - own), 9) <= round(r, 9)).all(axis=1)).sum()
                        seen[i] += other.sum()
            yield pa.RecordBatch.from_pydict({"qid": pa.array([a[0] for a in asked], pa.int64()), "kept": kept, "seen": seen})

        return corpus.select("doc_id", F.col("vec").cast("array<double>").alias("v")).mapInArrow(run, "qid bigint, kept double, seen double")

    return in_blocks(reaching, search).groupBy("qid").agg((F.sum("kept") / F.sum("seen")).alias("share"))


# Codes of residuals inside cells.
def residual_variance(vectors: DataFrame, book: np.ndarray) -> dict[str, float]:
    """Total variance of the vectors and of what their cells' codewords leave of them."""

    def run(batches):
        n, s = 0, np.zeros((4, book.shape[1]))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                rest = x - book[nearest_codes(x, book)[0]]
                n += len(x)
                s += np.stack([x.sum(0), (x * x).sum(0), rest.sum(0), (rest * rest).sum(0)])
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.ravel().tolist()]})

    rows = vectors.select(F.col("vec").cast("array<double>").alias("v")).mapInArrow(run, "n bigint, s array<double>").collect()
    n, s = sum(r["n"] for r in rows), sum(np.array(r["s"]) for r in rows).reshape(4, -1) / max(1, sum(r["n"] for r in rows))
    return {"n": n, "raw": float((s[1] - s[0] ** 2).sum()), "residual": float((s[3] - s[2] ** 2).sum())}


def residual_codes(vectors: DataFrame, book: np.ndarray, books: list[np.ndarray]) -> DataFrame:
    """(doc_id, cell, codes): product codes of each vector's residual from its own cell's codeword."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = nearest_codes(x, book)[0]
                codes = product_codes(x - book[cell], books)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int64()), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["doc_id", "cell", "codes"])

    return vectors.select("doc_id", F.col("vec").cast("array<double>").alias("v")).mapInArrow(run, "doc_id bigint, cell bigint, codes array<int>")


def residual_search(queries: DataFrame, coded: DataFrame, book: np.ndarray, books: list[np.ndarray], nprobe: int, k: int = 10) -> DataFrame:
    """Nearest codes of the residuals in each query's nprobe nearest cells: queries and codes meet by cell.

    A query brings to each probed cell the distances of its residual there to
    all codewords, so a code costs one look-up a subspace.
    """
    tables = pa.schema([("qid", pa.int64()), ("cell", pa.int64()), ("table", pa.list_(pa.float64()))])
    m, k_star = len(books), len(books[0])

    def probes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, out = batch.column(0).to_pylist(), _matrix(batch.column(1)), []
            d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :nprobe]
            for i, qid in enumerate(ids):
                out += [(qid, int(c), distance_table(x[i] - book[c], books).ravel().tolist()) for c in near[i]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), tables, strict=True)], schema=tables)

    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("v")).mapInArrow(probes, "qid bigint, cell bigint, table array<double>")
    pairs = asked.join(coded, "cell").where("qid <> doc_id")
    distance = sum((F.col("table")[F.lit(j * k_star) + F.col("codes")[j]] for j in range(1, m)), F.col("table")[F.col("codes")[0]])
    return top_k(pairs.select("qid", "doc_id", (-distance).alias("score")), k)


# Hashing.
def hyperplanes(d: int, bits: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(bits, d))


def signature(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The signs of each row at the hyperplanes, packed in a number (at most 32 planes)."""
    return ((np.round(x @ planes.T, 9) >= 0) @ (1 << np.arange(len(planes)))).astype(np.int64)


def signatures(vectors: DataFrame, planes: list[np.ndarray], key: str = "doc_id", vec: str = "vec") -> DataFrame:
    """(key, table, sig): one packed signature for each table of hyperplanes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for t, h in enumerate(planes):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), t)), pa.array(signature(x, h))], names=[key, "table", "sig"])

    return vectors.select(F.col(key).cast("bigint").alias(key), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, f"{key} bigint, table bigint, sig bigint")


def hash_topk(queries: DataFrame, corpus: DataFrame, planes: list[np.ndarray], k: int = 10) -> DataFrame:
    """Exact ranking (qid, doc_id, score, rank) of the vectors that share a bucket with the query in any table."""
    buckets = lambda x: np.stack([signature(x, h) + (t << 32) for t, h in enumerate(planes)], axis=1)
    return bucket_topk(queries, corpus, buckets, buckets, k)


# Proximity graphs.
class ProximityGraph:
    """A layered navigable graph over one shard's vectors (one layer if ``layered`` is false)."""

    def __init__(self, x: np.ndarray, m: int = 8, build_width: int = 32, layered: bool = True, seed: int = 0):
        self.x, self.m, self.width = x, m, build_width
        rng = np.random.default_rng(seed)
        scale = 1 / np.log(m) if layered else 0.0
        self.level = np.floor(-np.log(1 - rng.random(len(x))) * scale).astype(int)
        self.layers: list[dict[int, list[int]]] = []
        self.entry, self.work = -1, 0
        for i in range(len(x)):
            self._insert(i)

    def _distance(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        self.work += len(nodes)
        return ((self.x[nodes] - q) ** 2).sum(axis=1)

    def _beam(self, q, layer: dict, entries: list[int], width: int, live=None) -> list[tuple[float, int]]:
        """The ``width`` nearest found by best-first walk; nodes that fail ``live`` are walked through, not returned."""
        seen = set(entries)
        todo = [(d, i) for d, i in zip(self._distance(q, entries).tolist(), entries, strict=True)]
        heapq.heapify(todo)
        best = [(-d, -i) for d, i in todo if live is None or live[i]]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [j for j in layer.get(i, ()) if j not in seen]
            seen.update(new)
            for e, j in zip(self._distance(q, new).tolist() if new else (), new, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    if live is None or live[j]:
                        heapq.heappush(best, (-e, -j))
                        if len(best) > width:
                            heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def select(self, base: int, found: list[tuple[float, int]], most: int) -> list[int]:
        """Keep a candidate if no kept one is nearer to it than the base is."""
        kept: list[int] = []
        for d, c in found:
            if c != base and len(kept) < most and (not kept or (((self.x[kept] - self.x[c]) ** 2).sum(1) >= d).all()):
                kept.append(c)
        return kept

    def _link(self, layer: dict, i: int, neighbours: list[int], most: int) -> None:
        layer[i] = neighbours
        for j in neighbours:
            layer[j].append(i)
            if len(layer[j]) > most:
                order = sorted(zip(((self.x[layer[j]] - self.x[j]) ** 2).sum(1).tolist(), layer[j], strict=True))
                layer[j] = self.select(j, order, most)

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        entries = [self.entry] if self.entry >= 0 else []
        high = len(self.layers) - 1
        while len(self.layers) <= top:
            self.layers.append({})
        for at in range(high, top, -1):
            entries = [self._beam(self.x[i], self.layers[at], entries, 1)[0][1]]
        for at in range(top, -1, -1):
            layer, most = self.layers[at], self.m if at else 2 * self.m
            found = self._beam(self.x[i], layer, entries, self.width) if entries and at <= high else []
            self._link(layer, i, self.select(i, found, self.m), most)
            entries = [j for _, j in found] or entries
        if top > high:
            self.entry = i

    def search(self, q: np.ndarray, k: int, width: int, live=None) -> list[tuple[float, int]]:
        entries = [self.entry]
        for layer in reversed(self.layers[1:]):
            entries = [self._beam(q, layer, entries, 1)[0][1]]
        return self._beam(q, self.layers[0], entries, max(width, k), live)[:k]

    def delete(self, gone: set[int]) -> None:
        """Drop nodes; neighbours of a dropped node are linked again among themselves."""
        for at, layer in enumerate(self.layers):
            most = self.m if at else 2 * self.m
            for i in [i for i in layer if i not in gone]:
                lost = [j for j in layer[i] if j in gone]
                if lost:
                    near = {j for j in layer[i] if j not in gone} | {k for j in lost for k in layer.get(j, ()) if k not in gone and k != i}
                    order = sorted(zip(((self.x[list(near)] - self.x[i]) ** 2).sum(1).tolist(), near, strict=True)) if near else []
                    layer[i] = self.select(i, order, most)
            for i in gone:
                layer.pop(i, None)
        while self.layers and not self.layers[-1]:
            self.layers.pop()
        if self.entry in gone:
            self.entry = next(iter(self.layers[-1])) if self.layers else -1


_STORED = "shard bigint, doc_id bigint, vec array<double>, live boolean, links array<array<bigint>>, entry boolean"


def _table_of(graph: ProximityGraph, shard: int, ids: np.ndarray, live: np.ndarray, left: list[int]) -> pa.Table:
    """One row a node: its neighbours on each layer it is on."""
    links = [[[int(ids[j]) for j in layer[i]] for layer in graph.layers if i in layer] for i in left]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.list_(pa.int64())), pa.bool_())
    columns = [[shard] * len(left), [int(ids[i]) for i in left], [graph.x[i].tolist() for i in left], [bool(live[i]) for i in left], links, [i == graph.entry for i in left]]
    return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(_STORED.split(", "), columns, kinds, strict=True)})


def _restored(group: pa.Table, m: int) -> tuple[ProximityGraph, np.ndarray, np.ndarray]:
    """A stored shard's graph, its ids and which of them are live."""
    order = np.argsort(group.column("doc_id").to_numpy())
    group = group.take(pa.array(order))
    ids, graph = group.column("doc_id").to_numpy(), ProximityGraph.__new__(ProximityGraph)
    place = {int(d): i for i, d in enumerate(ids)}
    graph.x, graph.m, graph.work, graph.layers = _matrix(group.column("vec")), m, 0, []
    for i, links in enumerate(group.column("links").to_pylist()):
        while len(graph.layers) < len(links):
            graph.layers.append({})
        for layer, own in zip(graph.layers, links, strict=False):
            layer[i] = [place[j] for j in own]
    entry = np.flatnonzero(group.column("entry").to_numpy(zero_copy_only=False))
    graph.entry = int(entry[0]) if len(entry) else -1
    return graph, ids, group.column("live").to_numpy(zero_copy_only=False)


def store_graph(corpus: DataFrame, m: int = 8, layered: bool = True, shard_rows: int = 20_000, live: str | None = None) -> DataFrame:
    """Adjacency (shard, doc_id, vec, live, links, entry) of the graphs of all shards, built once and written.

    ``live`` names a boolean column of the corpus: rows where it is false are
    walked through but never returned.
    """
    shards = max(1, -(-corpus.count() // shard_rows))
    flag = F.col(live) if live else F.lit(True)

    def run(key, group):
        ids, x = group.column("doc_id").to_numpy(), _matrix(group.column("vec"))
        order = np.argsort(ids)
        graph = ProximityGraph(x[order], m, layered=layered)
        return _table_of(graph, key[0].as_py(), ids[order], group.column("live").to_numpy(zero_copy_only=False)[order], list(range(len(ids))))

    sharded = corpus.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", F.col("vec").cast("array<double>").alias("vec"), flag.alias("live"))
    return written(sharded.groupBy("shard").applyInArrow(run, _STORED))


def delete_from_graph(stored: DataFrame, gone: DataFrame, m: int = 8) -> DataFrame:
    """The stored graph without the documents of ``gone`` (doc_id), whose neighbours are linked again among themselves; written."""

    def run(key, group):
        dead = group.column("gone").to_numpy(zero_copy_only=False)[np.argsort(group.column("doc_id").to_numpy())]
        graph, ids, live = _restored(group, m)
        graph.delete(set(np.flatnonzero(dead).tolist()))
        return _table_of(graph, key[0].as_py(), ids, live, [i for i in range(len(ids)) if not dead[i]])

    marked = stored.join(gone.select("doc_id").distinct().withColumn("gone", F.lit(True)), "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return written(marked.select("shard", "doc_id", "vec", "live", "links", "entry", "gone").groupBy("shard").applyInArrow(run, _STORED))


def search_graph(queries: DataFrame, stored: DataFrame, k: int = 10, width: int = 64, m: int = 8) -> DataFrame:
    """Every shard answers every query from its stored graph; the best of all shards stay. ``work`` counts the distances computed for the query."""
    return top_k(in_blocks(queries, lambda rows: _search_graph(rows, stored, k, width, m)), k)


def _search_graph(rows, stored, k, width, m) -> DataFrame:
    def run(group):
        graph, ids, live = _restored(group, m)
        out = []
        for qid, v in rows if graph.entry >= 0 else ():
            graph.work = 0
            found = [(d, int(ids[i])) for d, i in graph.search(v, k + 1, width, live) if ids[i] != qid][:k]
            out += [(qid, i, -d, graph.work) for d, i in found]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("work", pa.int64())))})

    return stored.groupBy("shard").applyInArrow(run, "qid bigint, doc_id bigint, score double, work bigint")


def graph_search(queries: DataFrame, corpus: DataFrame, k: int = 10, width: int = 64, m: int = 8, layered: bool = True, shard_rows: int = 20_000, live: str | None = None) -> DataFrame:
    """search_graph() over a graph stored for this search."""
    return search_graph(queries, store_graph(corpus, m, layered, shard_rows, live), k, width, m)


# Filters.
def filter_then_search(queries: DataFrame, corpus: DataFrame, predicate: Column, k: int = 10) -> DataFrame:
    from .dense import knn

    return knn(queries, corpus.where(predicate), k, "euclidean")


def search_then_filter(queries: DataFrame, corpus: DataFrame, predicate: Column, k: int = 10, fetch: int = 50) -> DataFrame:
    """May return fewer than k: only the first ``fetch`` are looked at."""
    from .dense import knn

    passing = corpus.where(predicate).select("doc_id")
    found = knn(queries, corpus, fetch, "euclidean").drop("rank").join(passing, "doc_id", "left_semi")
    return top_k(found, k)


