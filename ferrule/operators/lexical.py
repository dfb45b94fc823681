"""Lexical indexing and ranking as long tables.

An index is four tables: postings (doc_id, term, tf, dl), docs (doc_id, dl), terms
(term, df, cf) and one row of collection statistics. A posting carries its
document's length, so its weight is known before it meets any query. Queries are (qid, term, qtf).
A ranking is (qid, doc_id, score, rank), ties by ascending doc_id. Query terms
meet postings by an equi-join on the term, so the work follows the postings of
the query terms, never queries times documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.durable import written
from ..plans.ranking import numbered, top_k
from ..sources.tables import spread


#: Most rows of a small table that is sent to every task.
MOST_SENT = 200_000


@dataclass
class LexicalIndex:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    def with_stats(self, df: DataFrame) -> DataFrame:
        """Append n, avgdl and coll_len: one row, so the broadcast is bounded."""
        return df.crossJoin(F.broadcast(self.stats))


def build_index(docs: DataFrame, text: str = "text", tokenizer=tokens) -> LexicalIndex:
    """Documents without a token count in n and in the average length."""
    tokenised = docs.select("doc_id", tokenizer(text).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))
    postings = tokenised.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    return _index_of(postings, tokenised.select("doc_id", "dl"))


def _index_of(postings: DataFrame, lengths: DataFrame) -> LexicalIndex:
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("coll_len"))
    return LexicalIndex(postings, lengths, terms, stats)


def stored_index(docs: DataFrame, text: str = "text", tokenizer=tokens) -> LexicalIndex:
    """build_index() with postings, lengths and terms written once to the shared folder, so no query tokenises twice."""
    lazy = build_index(spread(docs.select("doc_id", text)), text, tokenizer)
    half = _index_of(written(lazy.postings), written(lazy.docs))
    return LexicalIndex(half.postings, half.docs, written(half.terms), written(half.stats))


def save_index(index: LexicalIndex, folder: str, mode: str = "errorifexists") -> None:
    """Write an index once, postings ranged and sorted by term: a term's postings lie in few row groups, whose statistics let scans skip the rest."""
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{folder}/postings")
    for name in ("docs", "terms", "stats"):
        getattr(index, name).write.mode(mode).parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "docs", "terms", "stats")))


def query_terms(queries: DataFrame, text: str = "text", tokenizer=tokens) -> DataFrame:
    """(qid, term, qtf) of queries (qid, text)."""
    return queries.select("qid", F.explode(tokenizer(text)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


# Weights, as column expressions.
def idf(variant: str = "bm25", df: str = "df", n: str = "n") -> Column:
    """bm25, textbook, smooth, or feedback (each with its own formula)."""
    d, m = F.col(df).cast("double"), F.col(n).cast("double")
    if variant == "bm25":
        return F.log((m - d + 0.5) / (d + 0.5) + 1.0)
    if variant == "textbook":
        return F.when(d == 0, 0.0).otherwise(F.log(m / d))
    if variant in ("smooth", "feedback"):
        return F.log(1.0 + m / d)
    if variant == "raw":
        return F.log((m - d + 0.5) / (d + 0.5))
    raise ValueError(f"unknown variant {variant}")


def idf_bits(df: str = "df", n: str = "n") -> Column:
    return F.log2(F.col(n).cast("double") / F.col(df))


def okapi_idf(index: LexicalIndex, epsilon: float = 0.25) -> DataFrame:
    """terms with idf; negative values are floored at epsilon times the mean."""
    raw = index.with_stats(index.terms).select("term", "df", idf("raw").alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def tf_factor(k1: float = 1.5, b: float = 0.75) -> Column:
    tf = F.col("tf").cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def sublinear(tf: str = "tf") -> Column:
    return F.when(F.col(tf) > 0, 1.0 + F.log(F.col(tf).cast("double"))).otherwise(0.0)


# BM25.
def posting_weights(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, variant: str = "bm25") -> DataFrame:
    """(term, doc_id, contribution) of every posting of the queries' terms: weighed once, however many queries have the term."""
    weights = okapi_idf(index) if variant == "okapi" else index.with_stats(index.terms).select("term", idf(variant).alias("idf"))
    own = queries.select("term").distinct().join(weights.select("term", "idf"), "term")
    return index.with_stats(index.postings.join(own, "term")).select("term", "doc_id", (F.col("idf") * tf_factor(k1, b)).alias("contribution"))


def bm25_contributions(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, variant: str = "bm25") -> DataFrame:
    """(qid, doc_id, term, contribution); a repeated query term counts once."""
    return queries.select("qid", "term").distinct().join(posting_weights(index, queries, k1, b, variant), "term").select("qid", "doc_id", "term", "contribution")


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, variant: str = "bm25") -> DataFrame:
    return bm25_contributions(index, queries, k1, b, variant).groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score"))


def bm25_rank(index: LexicalIndex, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(bm25_scores(index, queries, **options), k)


# Vector space model.
def document_weights(index: LexicalIndex, variant: str = "smooth", sub: bool = True) -> DataFrame:
    """(doc_id, term, w) of every posting."""
    w = (sublinear() if sub else F.col("tf").cast("double")) * idf(variant)
    return index.with_stats(index.postings.join(index.terms, "term")).select("doc_id", "term", w.alias("w"))


def vsm_scores(index: LexicalIndex, queries: DataFrame, variant: str = "smooth", sub: bool = True, normalized: bool = True) -> DataFrame:
    """Cosine (or inner product) of weights; unknown query terms are dropped."""
    docs = document_weights(index, variant, sub)
    own = index.with_stats(queries.join(index.terms, "term")).select("qid", "term", ((sublinear("qtf") if sub else F.col("qtf").cast("double")) * idf(variant)).alias("qw"))
    scores = own.join(docs, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    if not normalized:
        return scores
    doc_norm = docs.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    query_norm = own.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    return scores.join(doc_norm, "doc_id").join(query_norm, "qid").select("qid", "doc_id", (F.col("score") / (F.col("dn") * F.col("qn"))).alias("score"))


def vsm_contributions(index: LexicalIndex, queries: DataFrame, norms: DataFrame, variant: str = "smooth", sub: bool = True) -> DataFrame:
    """(qid, doc_id, term, contribution): each shared term's part of the cosine; ``norms`` (doc_id, dn) are the lengths of the documents' weights."""
    own = index.with_stats(queries.join(index.terms, "term")).select("qid", "term", ((sublinear("qtf") if sub else F.col("qtf").cast("double")) * idf(variant)).alias("qw"))
    query_norm = own.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    met = own.join(document_weights(index, variant, sub), "term").join(norms, "doc_id").join(query_norm, "qid")
    return met.select("qid", "doc_id", "term", (F.col("qw") * F.col("w") / (F.col("dn") * F.col("qn"))).alias("contribution"))


def ql_contributions(index: LexicalIndex, queries: DataFrame, pairs: DataFrame, mu: float = 2000.0) -> DataFrame:
    """(qid, doc_id, term, matched, contribution) of the given pairs: c(t,q) ln P(t|d) of every known query term, also of those a document lacks."""
    known = index.with_stats(queries.join(index.terms, "term")).select("qid", "term", "qtf", (F.col("cf") / F.col("coll_len")).alias("pc"))
    every = pairs.select("qid", "doc_id").join(known, "qid").join(index.docs, "doc_id")
    met = every.join(index.postings.select("doc_id", "term", "tf"), ["doc_id", "term"], "left")
    return met.select("qid", "doc_id", "term", F.col("tf").isNotNull().alias("matched"), (F.col("qtf") * F.log((F.coalesce("tf", F.lit(0)) + mu * F.col("pc")) / (F.col("dl") + mu))).alias("contribution"))


def vsm_rank(index: LexicalIndex, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(vsm_scores(index, queries, **options), k)


# Query likelihood.
def ql_scores(index: LexicalIndex, queries: DataFrame, method: str = "dirichlet", param: float = 2000.0) -> DataFrame:
    """Sum of c(t,q) ln P(t|d) over the query's known terms, for documents that hold one of them.

    A term a document lacks adds its background: for Dirichlet
    ln(mu P(t|C) / (dl + mu)), for Jelinek-Mercer ln(lambda P(t|C)). So a
    document's score is a sum over matching postings plus a term that only
    depends on the query and the document's length: no completion to all pairs.
    """
    known = index.with_stats(queries.join(index.terms, "term")).select("qid", "term", "qtf", (F.col("cf") / F.col("coll_len")).alias("pc"))
    # a posting's lift is worked out once, before it meets the queries
    posted = index.postings.join(known.select("term", "pc").distinct(), "term")
    own = known.select("qid", "term", "qtf")
    if method == "dirichlet":
        lift = F.log((F.col("tf") + param * F.col("pc")) / (param * F.col("pc")))
        ground = F.col("base") + F.col("q") * F.log(F.lit(float(param)) / (F.col("dl") + param))
    elif method == "jm":
        lift = F.log(((1 - param) * F.col("tf") / F.col("dl") + param * F.col("pc")) / (param * F.col("pc")))
        ground = F.col("base") + F.col("q") * F.log(F.lit(float(param)))
    elif method == "none":  # minus infinity unless every term is there
        matched = own.join(posted.select("term", "doc_id", F.log(F.col("tf") / F.col("dl")).alias("p")), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * F.col("p")).alias("s"), F.count("*").alias("m"))
        need = known.groupBy("qid").agg(F.count("*").alias("need"))
        return matched.join(need, "qid").select("qid", "doc_id", F.when(F.col("m") == F.col("need"), F.col("s")).otherwise(F.lit(float("-inf"))).alias("score"))
    else:
        raise ValueError(f"unknown method {method}")
    lifts = own.join(posted.select("term", "doc_id", "dl", lift.alias("lift")), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * F.col("lift")).alias("lift"), F.first("dl").alias("dl"))
    base = known.groupBy("qid").agg(F.sum(F.col("qtf") * F.log("pc")).alias("base"), F.sum("qtf").alias("q"))
    return lifts.join(base, "qid").select("qid", "doc_id", (F.col("lift") + ground).alias("score"))


def ql_rank(index: LexicalIndex, queries: DataFrame, k: int = 10, method: str = "dirichlet", param: float = 2000.0) -> DataFrame:
    return top_k(ql_scores(index, queries, method, param), k)


def neg_kl_scores(index: LexicalIndex, queries: DataFrame, method: str = "dirichlet", param: float = 2000.0) -> DataFrame:
    """-KL(query model || document model): ranks as query likelihood does."""
    known = queries.join(index.terms.select("term"), "term")
    size = known.groupBy("qid").agg(F.sum("qtf").alias("q"), F.sum(F.col("qtf") * F.log(F.col("qtf").cast("double"))).alias("qlq"))
    scores = ql_scores(index, queries, method, param)
    return scores.join(size, "qid").select("qid", "doc_id", (F.col("score") / F.col("q") - F.col("qlq") / F.col("q") + F.log(F.col("q").cast("double"))).alias("score"))


# Relevance feedback.
def relevance_model(index: LexicalIndex, feedback: DataFrame, queries: DataFrame, mu: float = 2000.0) -> DataFrame:
    """RM1: (qid, term, p) over the terms of the feedback documents (qid, doc_id).

    P(w) is the sum of P(w|d) P(q|d) / Z with Dirichlet models. The background
    part of P(w|d) of a term a document lacks is left out of the sum and added
    by the documents' lengths, which keeps the table to terms that occur.
    """
    likelihood = ql_scores(index, queries, "dirichlet", mu).join(feedback.select("qid", "doc_id"), ["qid", "doc_id"])
    most = W.partitionBy("qid")
    weight = likelihood.withColumn("u", F.exp(F.col("score") - F.max("score").over(most))).withColumn("pq", F.col("u") / F.sum("u").over(most)).join(index.docs, "doc_id")
    ground = weight.groupBy("qid").agg(F.sum(F.col("pq") * mu / (F.col("dl") + mu)).alias("g"))
    seen = weight.join(index.postings.drop("dl"), "doc_id").groupBy("qid", "term").agg(F.sum(F.col("pq") * F.col("tf") / (F.col("dl") + mu)).alias("s"))
    model = index.with_stats(seen.join(index.terms, "term").join(ground, "qid"))
    return model.select("qid", "term", (F.col("s") + F.col("g") * F.col("cf") / F.col("coll_len")).alias("p"))


def expanded_model(index: LexicalIndex, feedback: DataFrame, queries: DataFrame, alpha: float = 0.5, n_terms: int = 10, mu: float = 2000.0) -> DataFrame:
    """RM3: (1 - alpha) query model + alpha times the n_terms best terms of RM1 (not renormalised)."""
    best = relevance_model(index, feedback, queries, mu).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("p"), "term"))).where(F.col("r") <= n_terms)
    own = queries.withColumn("p", F.col("qtf") / F.sum("qtf").over(W.partitionBy("qid")))
    return own.select("qid", "term", ((1 - alpha) * F.col("p")).alias("p")).unionByName(best.select("qid", "term", (alpha * F.col("p")).alias("p"))).groupBy("qid", "term").agg(F.sum("p").alias("p"))


def model_scores(index: LexicalIndex, model: DataFrame, mu: float = 2000.0) -> DataFrame:
    """Sum of P(w) ln P(w|d) for documents that hold a term of the model."""
    return ql_scores(index, model.select("qid", "term", F.col("p").alias("qtf")), "dirichlet", mu)


def rocchio_query(index: LexicalIndex, feedback: DataFrame, queries: DataFrame, a: float = 1.0, b: float = 0.75) -> DataFrame:
    """a q + b centroid of the feedback documents, in (1 + ln tf) ln(1 + n/df) weights: (qid, term, w)."""
    docs = document_weights(index, "feedback")
    own = index.with_stats(queries.join(index.terms, "term", "left")).select("qid", "term", (a * sublinear("qtf") * F.log(1.0 + F.col("n") / F.coalesce("df", "n"))).alias("w"))
    size = feedback.groupBy("qid").agg(F.count("*").alias("m"))
    centre = feedback.select("qid", "doc_id").join(docs, "doc_id").join(size, "qid").select("qid", "term", (b * F.col("w") / F.col("m")).alias("w"))
    return own.unionByName(centre).groupBy("qid", "term").agg(F.sum("w").alias("w"))


def rocchio_scores(index: LexicalIndex, feedback: DataFrame, queries: DataFrame, a: float = 1.0, b: float = 0.75) -> DataFrame:
    """Cosine of the expanded query and every matching document."""
    docs, query = document_weights(index, "feedback"), rocchio_query(index, feedback, queries, a, b)
    scores = query.join(docs.withColumnRenamed("w", "dw"), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("dw")).alias("s"))
    dn = docs.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qn = query.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    return scores.join(dn, "doc_id").join(qn, "qid").select("qid", "doc_id", (F.col("s") / (F.col("dn") * F.col("qn"))).alias("score"))


# Dynamic pruning.
def term_upper_bounds(index: LexicalIndex) -> DataFrame:
    """(term, bound): the largest BM25 contribution over a term's postings."""
    all_terms = index.with_stats(index.postings.join(index.terms, "term"))
    return all_terms.groupBy("term").agg(F.max(idf("bm25") * tf_factor()).alias("bound"))


def posting_blocks(index: LexicalIndex, terms: DataFrame, block_size: int = 64, ranges: int = 64) -> DataFrame:
    """(term, block, last_doc, bound) of blocks of postings in doc_id order.

    Postings are numbered in ranges of doc_id, so no task orders all postings
    of a frequent word.
    """
    placed = numbered(posting_weights(index, terms), "term", "doc_id", "place", ranges).withColumn("block", F.floor(F.col("place") / block_size))
    return placed.groupBy("term", "block").agg(F.max("doc_id").alias("last_doc"), F.max("contribution").alias("bound"))


def _term_counts(batches):
    """Of (doc_id, range, tokens) each different token of a row: (doc_id, range, term, tf, dl)."""
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        dl = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0)).astype(np.int64)
        words = batch.column(2).flatten().dictionary_encode()
        row = np.repeat(np.arange(len(dl)), dl)
        pair, tf = np.unique(row * max(1, len(words.dictionary)) + np.asarray(words.indices), return_counts=True)
        row, code = np.divmod(pair.astype(np.int64), max(1, len(words.dictionary)))
        columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), words.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(dl[row])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "range", "term", "tf", "dl"])


def term_blocks(docs: DataFrame, terms: DataFrame, text: str = "text", tokenizer=tokens, block_size: int = 64, ranges: int = 64) -> DataFrame:
    """posting_blocks() of an index of ``docs``, without the index.

    Only postings of the given terms leave a document's task. They are shuffled
    once, by term and range of doc_id, and numbered and written there; the
    ranges' sizes (terms x ranges) give their starts and the terms' df.
    """
    sent = lambda small: F.broadcast(small) if small.count() <= MOST_SENT else small
    docs = docs.select("doc_id", F.col(text).alias("text"))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [])) if ranges > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("doc_id"))) if bounds else F.lit(0)
    words = spread(docs).select("doc_id", at.alias("range"), tokenizer("text").alias("tokens"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = words.mapInArrow(_term_counts, f"doc_id {kind}, range int, term string, tf bigint, dl bigint")
    own = written(terms.select("term").distinct())
    near = counted.join(sent(own), "term", "left_semi").repartition("term", "range")
    merged = near.groupBy("term", "range", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    placed = written(merged.withColumn("place", F.row_number().over(W.partitionBy("term", "range").orderBy("doc_id")) - 1))
    of_term = W.partitionBy("term")
    before = of_term.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("term", "range").agg(F.count("*").alias("size"))
    starts = written(sizes.select("term", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(of_term).alias("df")))
    whole = placed.join(sent(starts), ["term", "range"]).crossJoin(F.broadcast(written(stats)))
    return whole.groupBy("term", F.floor((F.col("place") + F.col("start")) / block_size).alias("block")).agg(F.max("doc_id").alias("last_doc"), F.max(idf("bm25") * tf_factor()).alias("bound"))


def dynamic_topk(index: LexicalIndex, queries: DataFrame, k: int = 10, span: int | None = None, seeds: int = 3, share: float = 0.4) -> DataFrame:
    """The exhaustive BM25 top k with few documents scored in full: (qid, doc_id, score, rank, scored).

    A threshold comes first: of the documents that hold one of a query's
    ``seeds`` strongest terms, the 4k best are scored in full, and the k-th score
    is reached by k documents for certain. A query's weakest terms whose upper
    bounds add up to less than ``share`` of it can't lift a document there, so
    only the postings of the other (essential) terms are looked at; the words
    with the longest lists are never among them. Their best 4k documents, scored
    in full, give the threshold that counts, and documents go on
    whose essential score and the bound of the rest reach it.

    Without ``span`` bounds are those of whole lists, as in WAND. With it they
    are those of blocks of ``span`` document ids, as in block-max WAND, so
    blocks of the essential terms are passed over too. ``scored`` is the number
    of documents scored in full. Results equal exhaustive scoring.
    """
    weights = written(posting_weights(index, queries))
    asked = queries.select("qid", "term").distinct()
    bounds = weights.groupBy("term").agg(F.max("contribution").alias("bound"))
    own = written(asked.join(bounds, "term"))

    def total(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score"))

    def threshold(best: DataFrame) -> DataFrame:
        full = total(best.select("qid", "doc_id").join(weights, "doc_id").join(asked, ["qid", "term"]))
        return top_k(full, k).where(F.col("rank") == k).select("qid", (F.col("score") - 1e-6).alias("theta"))

    strongest = top_k(own, seeds, score="bound", tie="term").select("qid", "term")
    theta = threshold(top_k(total(strongest.join(weights, "term")), 4 * k))
    rising = W.partitionBy("qid").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
    judged = own.join(theta, "qid", "left").withColumn("weak", F.coalesce(F.sum("bound").over(rising) < share * F.col("theta"), F.lit(False)))
    judged = written(judged.select("qid", "term", "bound", "weak", "theta"))
    essential, weak = judged.where("not weak").select("qid", "term"), judged.where("weak").select("qid", "term")
    if span is None:
        slack = judged.groupBy("qid").agg(F.sum(F.when(F.col("weak"), F.col("bound")).otherwise(0.0)).alias("slack"))
        hits = essential.join(weights, "term").join(slack, "qid")
    else:
        block = F.floor(F.col("doc_id") / span).alias("block")
        met = judged.join(weights.groupBy("term", block).agg(F.max("contribution").alias("most")), "term")
        sums = met.groupBy("qid", "block").agg(F.first("theta").alias("theta"), F.sum("most").alias("all"), F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0.0)).alias("slack"))
        hits = essential.join(weights.withColumn("block", block), "term").join(sums.where("theta is null or all >= theta").select("qid", "block", "slack"), ["qid", "block"])
    part = written(hits.groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score"), F.first("slack").alias("slack")))
    last = threshold(top_k(part, 4 * k))
    alive = written(part.join(last, "qid", "left").where("theta is null or score + slack >= theta").select("qid", "doc_id", F.col("score").alias("contribution")))
    rest = alive.select("qid", "doc_id").join(weights, "doc_id").join(weak, ["qid", "term"])
    count = alive.groupBy("qid").agg(F.count("*").alias("scored"))
    return top_k(total(alive.unionByName(rest.select("qid", "doc_id", "contribution"))), k).join(count, "qid")


def wand_topk(index: LexicalIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """dynamic_topk() with bounds of whole lists."""
    return dynamic_topk(index, queries, k)


def block_max_topk(index: LexicalIndex, queries: DataFrame, k: int = 10, span: int = 64) -> DataFrame:
    """dynamic_topk() with bounds of blocks of document ids."""
    return dynamic_topk(index, queries, k, span)


# Learned sparse retrieval.
def sparse_weights(tokenised: DataFrame, id_column: str, associations: DataFrame | None = None) -> DataFrame:
    """(id, term, w): the largest ln(1 + max(0, logit)) over a text's tokens.

    A token has logit 1 for itself, and the given logit for every associated
    term of ``associations`` (term, to, logit).
    """
    own = tokenised.select(id_column, "term", F.lit(1.0).alias("logit"))
    if associations is not None:
        own = own.unionByName(tokenised.join(associations, "term").select(id_column, F.col("to").alias("term"), "logit"))
    return own.groupBy(id_column, "term").agg(F.max(F.log1p(F.greatest(F.col("logit"), F.lit(0.0)))).alias("w"))


def sparse_scores(query_weights: DataFrame, doc_weights: DataFrame, tau: float = 0.0) -> DataFrame:
    """Sparse inner products over weights above tau."""
    a = query_weights.where(F.col("w") > tau).select("qid", "term", F.col("w").alias("qw"))
    return a.join(doc_weights.where(F.col("w") > tau), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def flops_term(doc_weights: DataFrame, n: int) -> DataFrame:
    """Sum over terms of the squared mean weight over n documents."""
    return doc_weights.groupBy("term").agg((F.sum("w") / n).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("flops"))
