"""Corpus pipeline: toxic documents go, exact and near copies go, secrets are redacted, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it as the next one's
docs. All stages but the last return the columns of documents, whatever other
columns docs has and whatever their names are; an empty table stays empty
(and packs into no piece); very long texts are judged whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolink.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from recolink.llm.shared import save, table

#: Score from which a document is rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC, learnt from the labels of all rows but those with remainder 1.

    A null or empty text has the score of a text without any term and stays; rows that repeat a text are judged alike;
    a null id is no label's. Without labels of both classes the fixed lexicon scores.
    """
    labels = table(spark, sf_dir, "labels")
    learn = F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(3)) != 1
    return toxicity.keep_clean(docs, labels, learn, TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id.

    Null and empty texts are one group; of rows that repeat an id and its text one stays; a null id gives way to any other.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more on five-word runs connect: that with the smallest id.

    Texts without words (null, empty, blank) all stay, and so do rows that repeat a leading id.
    """
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, where they stand. Null and empty texts stay as they are, repeated rows change alike."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens. Null and empty texts are the end id alone; repeated rows are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_entries=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The first stage is a trained classifier, which SQL can't express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
