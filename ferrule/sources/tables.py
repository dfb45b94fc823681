"""Reading tables and loosely structured files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as there are cores where a small input has fewer parts (one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder (any file system Spark reads)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, body) of text files that begin with a block between two lines of '---'."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    has = F.col("value").rlike(pattern)
    return whole.select("path", F.when(has, F.regexp_extract("value", pattern, 1)).alias("header"), F.when(has, F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def prerequisite_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their in- and out-degrees, and the edges whose ends are no node (which a valid graph has none of)."""
    ids = nodes.select("id")
    bad = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.join(out, "id", "left").join(inn, "id", "left").fillna(0, ["out_degree", "in_degree"]), bad


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
