"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every document gets a digest of its normalised text and belongs to a leaf run,
dealt by a hash of its identifier. There are about ``LEAF_ROWS`` rows to a
leaf, so the number of leaves grows with the table, by powers of two. A leaf
run holds each digest once, sorted, with the smallest identifier and the row
count. In every round run 2i + 1 is exchanged to run 2i: both are sorted by
digest and merged by a full outer sort-merge join, which keeps the smaller
identifier and adds the counts. After log2(leaves) rounds one run is left.

A text that a third of all rows share is one row in each leaf run, so no task
of a round ever sees more than two rows of it. The answer travels back down
through the leaf runs; that join is by leaf and digest, and so a hot text's
rows stay spread over all leaves.

"Verified": SHA-256, length and an independent 64-bit hash must all agree at
every level; rows that differ in any of them are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolink.llm.shared import discard, fresh, save

SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a leaf run on average, and the least and greatest number of leaves.
LEAF_ROWS, FEWEST, MOST = 65_536, 8, 4096
_KEY = ["digest", "length", "check"]


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of blanks becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def leaf_count(rows: int) -> int:
    """The least power of two of leaves that hold LEAF_ROWS rows or fewer on average, within the bounds."""
    return min(MOST, max(FEWEST, 1 << max(0, -(-rows // LEAF_ROWS) - 1).bit_length()))


def digests(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(leaves)).cast("int").alias("leaf"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.length(text).alias("length"),
        F.xxhash64(text).alias("check"),
    )


def merged(runs: DataFrame) -> DataFrame:
    """One round: each odd run meets the even one before it, both in digest order; keep is the smaller identifier, size the sum."""
    parent = F.shiftright("run", 1).alias("parent")
    even = runs.where("run % 2 = 0").select(parent, *_KEY, F.col("keep").alias("keep_a"), F.col("size").alias("size_a"))
    odd = runs.where("run % 2 = 1").select(parent, *_KEY, F.col("keep").alias("keep_b"), F.col("size").alias("size_b"))
    zero = F.lit(0).cast("long")
    return even.hint("merge").join(odd, ["parent", *_KEY], "full").select(
        F.col("parent").alias("run"), *_KEY, F.least("keep_a", "keep_b").alias("keep"), (F.coalesce("size_a", zero) + F.coalesce("size_b", zero)).alias("size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaves: int | None = None) -> DataFrame:
    """One row per input row: id, keep (smallest id of its equal texts), size (rows of the group), digest (hex).

    Null or empty texts form one group; texts of blanks only are equal to each
    other, not to empty ones. Ties cannot arise: equal ids with equal texts are
    the same document, and all their rows carry the same answer. A null id
    joins its group and is never the kept id unless all ids are null. An empty
    table gives an empty result; other columns of the input are ignored,
    whatever their names. leaves, if given, must be a power of two.
    """
    leaves = leaf_count(docs.count()) if leaves is None else leaves
    own = save(digests(docs, id_col, text_col, leaves), "digests")
    leaf = save(own.groupBy("leaf", *_KEY).agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size")).sortWithinPartitions("leaf", *_KEY), "leaf-runs")
    runs, left, old = leaf.withColumnRenamed("leaf", "run"), leaves, None
    while left > 1:
        runs, left = save(merged(runs).sortWithinPartitions("run", *_KEY), "runs"), left // 2
        if old is not None:
            discard(old)
        old = runs
    # back down: one row for each leaf and digest, then the documents by leaf and digest
    answer = leaf.select("leaf", *_KEY).join(runs.select(*_KEY, "keep", "size"), _KEY)
    return own.join(answer, ["leaf", *_KEY]).select("id", "keep", "size", F.lower(F.hex("digest")).alias("digest"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text no smaller id has; repeated rows of one id and text become one.

    Nulls, blanks, ties and empty tables count as in exact_dedup; very long texts are compared whole. All columns of
    docs come back, whatever their names.
    """
    ident, digest = fresh("id"), fresh("digest")
    found = exact_dedup(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("keep")))
    kept = save(found.groupBy(F.col("id").alias(ident), F.col("digest").alias(digest)).agg(F.count(F.lit(1)).alias("rows")), "kept")
    own = fresh("digest")
    rows = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    out = rows.join(kept, F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(own) == F.col(digest)), "left_semi")
    if not kept.where("rows > 1").isEmpty():
        out = out.dropDuplicates([id_col, own])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
