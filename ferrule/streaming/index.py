"""A lexical index that follows a stream of upserts and tombstones, version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexical import LexicalIndex, _index_of, build_index, load_index, save_index
from .monitor import live_documents


def apply_changes(index: LexicalIndex, changes: DataFrame) -> LexicalIndex:
    """The index after ``changes`` (doc_id, version, deleted, text): of each document the last version counts, deleted ones leave.

    Postings of changed documents are replaced, all others are only copied;
    document frequencies and statistics are counted anew from the postings.
    """
    changed = changes.select("doc_id").distinct()
    new = build_index(live_documents(changes).select("doc_id", "text"))
    postings = index.postings.join(changed, "doc_id", "left_anti").unionByName(new.postings)
    return _index_of(postings, index.docs.join(changed, "doc_id", "left_anti").unionByName(new.docs))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are complete, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/stats/_SUCCESS"))]
    return sorted(done)


def follow(changes: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Write a new version of the index under ``folder`` for every batch of the stream.

    A version is numbered by its batch, and is made from the one before it, so a batch that
    runs again after a failure writes the same version: changes count once.
    Readers take the newest complete version; older ones can be deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, folder) if v < number + 1]
        empty = batch.where(F.lit(False)).select("doc_id", "text")
        index = load_index(spark, f"{folder}/v{before[-1]}") if before else build_index(empty)
        save_index(apply_changes(index, batch), f"{folder}/v{number + 1}", "overwrite")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
