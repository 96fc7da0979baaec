"""Readers and writers of record tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SOURCE = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A strict TSV: the header must be exactly these columns, nothing is quoted, an empty field is an empty string."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    options = {"sep": "\t", "quote": "", "header": True, "mode": "FAILFAST", "enforceSchema": False, "encoding": "UTF-8"}
    return spark.read.schema(schema).options(**options).csv(path).na.fill("")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SOURCE)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Projection and filter are declared here and reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def list_partitions(df: DataFrame, key: str = "country") -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def explode_truth(truth: DataFrame) -> DataFrame:
    """s1_id, other_id and other_source (the id's prefix), one row per matched id; entities without any give none."""
    ids = F.array_distinct(F.filter(F.split("matched_entity_ids", ","), lambda x: x != ""))
    pairs = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("other_id"))
    return pairs.withColumn("other_source", F.substring("other_id", 1, 2))


def id_lists(required: DataFrame, pairs: DataFrame, key: str, member: str, order: Column, out: str) -> DataFrame:
    """Each required key once, with its members joined by commas in the given order (then by member); none gives ''."""
    listed = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(member).alias("m")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["m"].cast("string")), ",")
    return required.join(listed, key, "left").select(key, F.coalesce(joined, F.lit("")).alias(out))


def write_id_list_tsv(lists: DataFrame, path: str, key: str, member: str) -> None:
    """One TSV in key order, after the checks that its readers rely on."""
    ids = F.filter(F.split(member, ","), lambda x: x != "")
    rows, keys, repeated, odd = lists.agg(
        F.count(F.lit(1)), F.count_distinct(key), F.count_if(F.size(ids) != F.size(F.array_distinct(ids))),
        F.count_if(F.concat_ws("", key, member).rlike(r"[\t\r\n\"]")),
    ).first()
    if rows != keys or repeated or odd:
        raise ValueError(f"{rows - keys} repeated keys, {repeated} lists with repeated ids, {odd} rows with forbidden characters")
    lists.orderBy(key).select(F.concat_ws("\t", key, member).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def find_root(argument: str | None, variable: str, candidates: list[str]) -> str | None:
    """A data folder: the argument, else the environment's, else the first candidate there is."""
    return argument or os.environ.get(variable) or next((c for c in candidates if os.path.isdir(c)), None)
