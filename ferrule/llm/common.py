"""Helpers shared by the corpus operators: table access, durable cuts, folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by any path that Spark's own readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a session of one machine gets a temporary folder; on a cluster this
    is an error, since executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ferrule-cut-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The scan survives lost executors, unlike cached blocks, and reading it
    never repeats the work above it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df``, few rows made by many tasks, shuffled to partitions of the session's advised size, so they are written to few files."""
    return df.hint("rebalance")


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (a null id counts as '')."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


#: Most bytes a Parquet writer holds before it writes a row group; every writing task has one, so executors stay small.
GROUP_BYTES = 16 << 20

#: Most bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes an Arrow batch holds to BATCH_BYTES, so long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the columns the operators need, so other columns can't clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Most rows that are sent to every task.
MOST_BROADCAST = 200_000


def sent(small: DataFrame) -> DataFrame:
    """``small`` (written before), to be sent to every task by a join if it has at most MOST_BROADCAST rows, else left to a shuffle."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def distinct_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row an id (rows without an id go), and (doc_id, chosen) of the ids held by several rows.

    Of such an id the text with the smallest hash is the document: rows with
    this text repeat it, rows with another are no part of it. None is returned
    where no id is held twice; then nothing is joined.
    """
    rows = id_and_text(docs).where("doc_id is not null")
    twice = cut(rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("chosen"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return rows, None
    marked = rows.join(sent(twice), "doc_id", "left")
    one = marked.where(F.xxhash64("text") == F.col("chosen")).dropDuplicates(["doc_id"])
    return marked.where("chosen is null").unionByName(one).select("doc_id", "text"), twice


def with_ranges(docs: DataFrame, ranges: DataFrame, twice: DataFrame | None) -> DataFrame:
    """``docs`` with the column of ``ranges`` (doc_id, one column); null for rows that are no part of their id's document."""
    found = docs.join(ranges, "doc_id", "left")
    if twice is None:
        return found
    (name,) = (c for c in ranges.columns if c != "doc_id")
    marked = found.join(sent(twice.select("doc_id", F.struct("chosen").alias("_chosen"))), "doc_id", "left")
    own = F.col("_chosen").isNull() | (F.xxhash64(F.col("text").cast("string")) == F.col("_chosen.chosen"))
    return marked.withColumn(name, F.when(own, F.col(name))).drop("_chosen")


def join_dealt(left: DataFrame, right: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """``left`` joined to the keys of ``right``, hot keys dealt to several tasks.

    ``right`` (written before, one row a key) has in ``n`` how many rows of
    ``left`` hold the key. A key with more than a quarter of a task's share of
    them all (1 in 1024 with few tasks) is dealt in parts by a hash of
    ``spread``, and its row of ``right`` is repeated for each part. There are
    fewer such keys than four a task, whatever the input, so they go to
    every task; without one the join is a plain one. ``n`` goes. Tasks hash
    their keys of ``right``, which are fewer than their rows of ``left``, so
    neither side is sorted.
    """
    share = max(1024, 4 * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    limit = int(total["n"]) // share + 1
    if total["most"] <= limit:
        return left.join(right.drop("n").hint("shuffle_hash"), on)
    hot = F.broadcast(right.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    dealt = left.join(hot, on, "left").withColumn("_part", F.expr(f"if(_parts is null, 0, cast(pmod(xxhash64({', '.join(spread)}), _parts) as int))")).drop("_parts")
    copied = right.drop("n").join(hot, on, "left").withColumn("_part", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)"))).drop("_parts")
    return dealt.join(copied.hint("shuffle_hash"), [*on, "_part"]).drop("_part")


def arrow_rows(schema: pa.Schema, rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length out of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


#: What empties a worker's caches; workers are used again by other operators' tasks.
CACHES: list[Callable[[], None]] = []

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = lambda _: None


def release() -> None:
    """Give memory that this worker holds without use back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def each(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Row tuples of Arrow batches, turned into Python values a slice at a time.

    Empties the caches that tasks of caching operators (which use slices()) left in this worker.
    """
    for empty in CACHES:
        empty()
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
    part = batch = None
    release()


def slices(batches: Iterable[pa.RecordBatch], most: int = 1_000_000, rows: int = 512) -> Iterator[list[list]]:
    """Columns of slices that hold at most about ``most`` bytes (one row at least), as Python lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield [c.to_pylist() for c in batch.slice(at, step).columns]
    batch = None
    release()


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_columns(df: DataFrame, inputs: list[str], fields: list[StructField], types: list[pa.DataType], work: Callable[..., list[list]]) -> DataFrame:
    """``df`` with columns computed by ``work`` from the Python values of ``inputs``; fields of the same name are replaced.

    ``work`` gets one list for each input and returns one list for each field.
    """
    bounded_batches(df.sparkSession)
    names = [f.name for f in fields]
    own = [f for f in df.schema.fields if f.name not in names]
    out = StructType(own + fields)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = work(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs))
                kept = [part.column(part.schema.get_field_index(f.name)) for f in own]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=out.names)
        batch = part = made = kept = None
        release()

    return df.mapInArrow(run, out)
