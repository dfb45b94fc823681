"""A corpus pipeline over ``documents``: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes a
stage's result as Parquet in the cluster's shared folder and rereads it as the
next stage's docs, so a lost executor never repeats a finished stage.

All stages but the last keep the columns of docs, also further ones whatever
their names, and leave an empty table empty. Null texts count as empty, rows
without an id are judged alone and never make another row go, and repeated rows
are told of in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import cut, free_name, sent, table
from ferrule.llm.langid import UNKNOWN, annotate_languages, learn_profiles, training_rows
from ferrule.llm.minhash import shingle_near_duplicates, text_hash
from ferrule.llm.packing import pack_documents
from ferrule.llm.queries import tokenizer
from ferrule.llm.secrets import redact, scan_secrets
from ferrule.llm.substrings import without_repeats

#: Least closeness to the nearest language profile; running text has 0.35 and more.
LEAST_LANGUAGE_SCORE = 0.2


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every learnt language, go. Each row by its text alone: null texts go, repeated rows go or stay together."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = annotate_languages(docs, learn_profiles(training_rows(docs)), (lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, likeness of 0.8 and more) one row stays, that of the smallest id.

    Rows are told apart by id and text, so of an id with several texts only the
    texts that are copies go; of rows with the same id and text one stays. Rows
    without an id stay.
    """
    groups = shingle_near_duplicates(docs, least=0.8, radius=2, words=5)
    own = free_name(docs, "text_hash")
    same = ["doc_id", own]
    copies = cut(groups.where("not kept").select("doc_id", F.col("text_hash").alias(own)).distinct())
    kept = docs.withColumn(own, text_hash()).join(sent(copies), same, "left_anti")
    repeated = cut(kept.where("doc_id is not null").groupBy(same).count().where("count > 1").select(same))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(repeated, same, "left_semi").groupBy(same).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").select(docs.columns).unionByName(one)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; documents that keep nothing go.

    Rows that repeat an id and its text lose the same words; of an id with
    different texts one is the document (that of the smallest hash), and the
    others, like rows without an id, are kept whole. Texts without a word stay.
    """
    return _counted(without_repeats(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; all rows stay, null texts stay null."""
    spans = free_name(docs, "secret_spans")
    return _counted(redact(scan_secrets(docs, spans), column=spans)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the context-size tiers, one row a piece; every row is packed, null and empty texts as their end token."""
    return pack_documents(docs, tokenizer())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", simhash_stage),
    ("repeated_passages", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
