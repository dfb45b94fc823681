"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line's evidence is a linear
function of its own features and those of the lines before and after it; a
transition weight says how much neighbouring labels tend to agree. Marginals by
the forward-backward recursions, weighted by the lines' lengths, give the
document's share of good text, which a two-parameter logistic turns into a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import islice
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, each, fold, id_and_text

#: Character classes by UTF-8 byte: lower case, upper case, digit, space, stop and comma, other ASCII, beyond ASCII.
_CLASS = np.full(256, 5, np.int64)
_CLASS[128:] = 6
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 3, 4
#: Upper bounds of the features' bins.
_EDGES = np.array([
    [0.02, 0.08, 0.2, 0.5],  # capitals
    [0.01, 0.05, 0.15, 0.4],  # digits
    [0.01, 0.04, 0.1, 0.2],  # other ASCII signs
    [0.01, 0.03, 0.06, 0.12],  # stops and commas
    [0.02, 0.1, 0.3, 0.6],  # beyond ASCII
    [0.05, 0.1, 0.2, 0.4],  # words like the one before
    [0.3, 0.5, 0.7, 0.9],  # different words
    [2.5, 4.0, 6.0, 9.0],  # letters a word
    [1.0, 2.0, 4.0, 6.0],  # log of the line's length
    [0.02, 0.1, 0.3, 0.6],  # words that end in a sign
])
N_OWN = _EDGES.size
N_ALL = 3 * N_OWN + 3
#: Lines whose features are held at once, and lines whose evidence is.
LINES, HELD_LINES = 4096, 1 << 16


def _own_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which bounds each of ten measures of each line exceeds, and the lines' lengths."""
    measures = np.empty((len(lines), len(_EDGES)))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(size) - size
    kinds = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    count = np.stack([np.add.reduceat(kinds == k, start, dtype=np.int64) for k in range(7)], axis=1)
    letters = count[:, 0] + count[:, 1] + count[:, 6]
    measures[:, 0] = count[:, 1] / np.maximum(1, letters)
    measures[:, 1] = count[:, 2] / size
    measures[:, 2] = count[:, 5] / size
    measures[:, 3] = count[:, 4] / size
    measures[:, 4] = count[:, 6] / size
    for row, line in zip(measures, lines, strict=True):
        words = line.split()
        n = len(words)
        row[5] = sum(map(bytes.__eq__, words, words[1:])) / n
        row[6] = len(set(words)) / n
        row[9] = sum(1 for w in words if w[-1] in b"!#$%&*+<=>@^_|~") / n
        row[7] = n
    measures[:, 7] = letters / measures[:, 7]
    measures[:, 8] = np.log(size)
    return (measures[:, :, None] > _EDGES).reshape(len(lines), N_OWN), size.astype(np.float64)


def feature_blocks(text: str | None, step: int = LINES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features in steps of every line that isn't blank, with their neighbours', and the lines' lengths, ``step`` lines at a time.

    Each of ten measures is told by which of its four bounds it exceeds. A text
    without a line has one line of length one without features.
    """
    lines = (x.removesuffix(b"\n") for x in io.BytesIO((text or "").encode("utf-8", "surrogatepass")) if x.strip())
    blocks = iter(lambda: list(islice(lines, step)), [])
    now = next(blocks, None)
    if now is None:
        yield np.zeros((1, N_ALL)), np.ones(1)
        return
    none = np.zeros((1, N_OWN))
    before, (own, size), first = none, _own_features(now), 1
    while own is not None:
        ahead = next(blocks, None)
        following, lengths = _own_features(ahead) if ahead else (None, None)
        ends = np.zeros((len(own), 3))
        ends[:, 0], ends[0, 1], ends[-1, 2] = 1, first, following is None
        yield np.hstack([own, np.vstack([before, own[:-1]]), np.vstack([own[1:], none if following is None else following[:1]]), ends]), size
        before, own, size, first = own[-1:], following, lengths, 0


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All of feature_blocks() at once."""
    x, size = zip(*feature_blocks(text), strict=True)
    return np.vstack(x), np.concatenate(size)


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, chains), np.int64, len(chains))
    out = np.zeros((len(chains), length.max()))
    for row, chain in zip(out, chains, strict=True):
        row[: len(chain)] = chain
    return out, length


def _pass(u: float | np.ndarray, a: np.ndarray, stay: float) -> np.ndarray:
    """One step of the recursion on log-odds: a message through the transition."""
    return np.logaddexp(0.0, stay + a) - np.logaddexp(stay, a) + u


def _alone(u: list[float], stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of one long chain, as log_odds() has them."""

    def step(a: float) -> float:
        return max(0.0, stay + a) + log1p(exp(-abs(stay + a))) - max(stay, a) - log1p(exp(-abs(stay - a)))

    f, b = np.empty(len(u)), np.zeros(len(u))
    a = f[0] = u[0]
    for t in range(1, len(u)):
        f[t] = a = step(a) + u[t]
    a = 0.0
    for t in range(len(u) - 2, -1, -1):
        b[t] = a = step(u[t + 1] + a)
    return f, b


def log_odds(evidence: list[np.ndarray], stay: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Forward and backward log-odds of 'good' for each line of each chain.

    Their sum is the marginal's log-odds. Chains of like length advance together.
    """
    order = sorted(range(len(evidence)), key=lambda i: len(evidence[i]))
    forward, backward = [np.empty(0)] * len(evidence), [np.empty(0)] * len(evidence)
    at = 0
    while at < len(order):
        most = 2 * len(evidence[order[at]]) + 8
        to = at
        while to < len(order) and len(evidence[order[to]]) <= most:
            to += 1
        if to == at + 1 and len(evidence[order[at]]) > LINES:
            forward[order[at]], backward[order[at]] = _alone(evidence[order[at]].tolist(), stay)
            at = to
            continue
        u, length = _padded([evidence[i] for i in order[at:to]])
        f, b = u.copy(), np.zeros_like(u)
        for t in range(1, u.shape[1]):
            f[:, t] = _pass(u[:, t], f[:, t - 1], stay)
        for t in range(u.shape[1] - 2, -1, -1):
            live = t + 1 < length
            b[:, t] = np.where(live, _pass(0.0, u[:, t + 1] + b[:, t + 1], stay), 0.0)
        for row, i in enumerate(order[at:to]):
            forward[i], backward[i] = f[row, : length[row]], b[row, : length[row]]
        at = to
    return forward, backward


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


class LineField:
    """The random field: weights of the evidence, the transition's, and the score's two parameters."""

    def __init__(self, weights: np.ndarray, stay: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.stay, self.slope, self.shift = weights, stay, slope, shift

    def shares(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of 'good', for each document."""
        return self._weighed([(x @ self.weights, n) for x, n in documents])

    def _weighed(self, evidence: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        f, b = log_odds([u for u, _ in evidence], self.stay)
        return np.array([(_sigmoid(p + q) * n).sum() / n.sum() for p, q, (_, n) in zip(f, b, evidence, strict=True)])

    def evidence(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The evidence and length of each line of a text; features are held for LINES lines at once, so a text's lines cost a few numbers each."""
        u, n = zip(*((x @ self.weights, n) for x, n in feature_blocks(text)), strict=True)
        return np.concatenate(u), np.concatenate(n)

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.scores_of([(x @ self.weights, n) for x, n in documents])

    def scores_of(self, evidence: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of documents told by the evidence of their lines."""
        share = np.clip(self._weighed(evidence), 1e-6, 1 - 1e-6)
        return _sigmoid(self.slope * np.log(share / (1 - share)) + self.shift)


def fit_lines(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 3, steps: int = 60) -> LineField:
    """Fit on documents whose label is known but whose lines' labels aren't.

    Lines start with their document's label. Each round fits the field by
    gradient steps on its conditional likelihood (forward-backward gives the
    expectations), then looks again at the lines of bad documents: those that the
    evidence calls good become good, but the worst line of a bad document stays bad.
    """
    x = np.vstack([d for d, _ in documents]).astype(np.uint8)  # all features are 0 or 1
    parts = range(0, len(x), 1 << 15)
    times = lambda w: np.concatenate([x[a : a + (1 << 15)].astype(float) @ w for a in parts])
    summed = lambda r: sum(x[a : a + (1 << 15)].astype(float).T @ r[a : a + (1 << 15)] for a in parts)
    size = np.fromiter((len(d) for d, _ in documents), np.int64, len(documents))
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(documents)), size)
    y = labels[doc].astype(float)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    weights, stay = np.zeros(x.shape[1]), 0.0
    share = 1.0 / np.sqrt(size[doc])  # many lines of one document say less each
    for round_ in range(rounds):
        first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
        for step in range(1, steps + 1):
            u = times(weights)
            f, b = (np.concatenate(p) for p in log_odds(np.split(u, begin[1:]), stay))
            p = _sigmoid(f + b)
            grad = summed((y - p) * share) / len(documents) - 1e-3 * weights
            i, j = inner, inner + 1
            back = u[j] + b[j]
            like = np.logaddexp(stay, stay + f[i] + back)
            agree = np.exp(like - np.logaddexp(like, np.logaddexp(f[i], back)))
            pull = (((y[i] == y[j]) - agree) * share[i]).sum() / len(documents) - 1e-2 * stay
            g = np.append(grad, pull)
            first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
            move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
            weights, stay = weights + move[:-1], float(np.clip(stay + move[-1], -2.0, 2.0))
        if round_ < rounds - 1:
            u = times(weights)
            worst = np.minimum.reduceat(u, begin)
            y = np.where(labels[doc] == 1, 1.0, ((u > 0) & (u > worst[doc])).astype(float))
    field = LineField(weights, stay)
    share_ = np.clip(field.shares(documents), 1e-6, 1 - 1e-6)
    odds, slope, shift = np.log(share_ / (1 - share_)), 1.0, 0.0
    for _ in range(40):  # Newton steps of a two-parameter logistic
        p = _sigmoid(slope * odds + shift)
        r, w = labels - p, p * (1 - p) + 1e-9
        h = np.array([[(w * odds * odds).sum() + 1.0, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, [(r * odds).sum() - (slope - 1.0), r.sum()])
        slope, shift = slope + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
    field.slope, field.shift = max(slope, 1e-3), shift
    return field


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = 4000, most_lines: int = 300) -> LineField | None:
    """Fit on at most ``most`` labelled documents, those with the smallest hashed ids.

    Of very long ones only documents with at most ``most_lines`` lines are used
    to fit, and of an id's rows one text (that of the smallest hash), so what
    the driver gets is bounded: a bit a feature and line. Ids with both labels are left
    out. None if only one label occurs.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").where("text is not null")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("bits", pa.binary()), ("sizes", pa.list_(pa.float64()))])

    def run(batches):
        def rows():
            for doc_id, text, quality in each(batches, 64):
                x, n = next(feature_blocks(text, most_lines + 1))
                if len(n) <= most_lines:
                    yield doc_id, quality, np.packbits(x.astype(bool), axis=1).tobytes(), n.tolist()

        return arrow_rows(schema, rows(), 1000)

    found = sorted(texts.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id bigint, quality int, bits binary, sizes array<double>").collect(), key=lambda r: (r["doc_id"], r["bits"]))
    documents = [(np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(len(r["sizes"]), -1), axis=1)[:, :N_ALL], np.array(r["sizes"])) for r in found]
    y = np.array([r["quality"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_lines(documents, y)


def score_quality(docs: DataFrame, field: LineField | None) -> DataFrame:
    """(doc_id, score) for every row; no shuffle.

    score is 0 to 1, higher for likelier good. Null and empty texts score what a
    line without features does; without a fitted field every score is 0.5.
    Repeated rows keep their repeats; an empty table stays empty. A worker holds
    the features of LINES lines and some 50 bytes for each line of the documents
    scored together (HELD_LINES lines, or one document).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        def rows():
            held, lines = [], 0
            for doc_id, text in each(batches):
                held.append((doc_id, *(field.evidence(text) if field else (None, ()))))
                lines += len(held[-1][2])
                if len(held) == 256 or lines >= HELD_LINES:
                    yield from done(held)
                    held, lines = [], 0
            yield from done(held)

        def done(held):
            if held:
                scores = field.scores_of([h[1:] for h in held]) if field else np.full(len(held), 0.5)
                yield from zip([h[0] for h in held], scores.tolist(), strict=True)

        return arrow_rows(schema, rows())

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels the query may learn from."""
    return labels.where(fold("doc_id", 5) != 0)
