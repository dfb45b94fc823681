"""The thin registered queries over the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import decode_documents, encode_documents
from .collocations import collocations
from .common import cut, fold, table
from .embeddings import embedding_near_duplicates
from .fingerprints import digest_classes, edited_prints, fingerprints, with_classes
from .langid import identify_languages, learn_profiles, training_rows
from .negatives import mine_hard_negatives
from .packing import pack_documents
from .pages import extract_pages
from .quality import learn_quality, score_quality, training_labels
from .secrets import count_kind, scan_documents, spans_string
from .simhash import simhash_near_duplicates
from .substrings import dedup_words
from .suffixes import dedup_bytes


def tokenizer() -> str:
    """Path of the public tokenizer file the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _sha(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn_quality(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = score_quality(docs, field)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_documents(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return out.select(
        "doc_id",
        *[count_kind(spans, k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))],
        F.sha2(spans_string(base).cast("binary"), 256).alias("base_sha256"),
        spans_string(spans).alias("spans"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = cut(edited_prints(docs))
    return with_classes(prints, *digest_classes(fingerprints(docs), prints)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=2, with_ids=False)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha("kept").alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer()
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", _sha("ids").alias("ids_sha256"), _sha("text").alias("decoded_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha("kept_text").alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(training_rows(docs))
    return identify_languages(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, k=5, low=80, high=100, scale=256.0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, longest=3, share=50, top=2000)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_embeddings": op3_embeddings,
    "op4_fingerprint": op4_fingerprint,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_language_id": op10_language_id,
    "op11_negatives": op11_negatives,
    "op12_collocations": op12_collocations,
    "op13_html": op13_html,
}

#: The others hash with XXH64, tokenize or learn, which SQL can't say.
ORACLE_SQL: dict[str, str] = {"op2_secrets": oracle.OP2, "op3_embeddings": oracle.OP3, "op7_suffixes": oracle.OP7, "op9_substrings": oracle.OP9, "op11_negatives": oracle.OP11, "op12_collocations": oracle.OP12}
