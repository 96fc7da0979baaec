"""Exact top-k inner products by MaxScore over shards of posting lists.

The terms of a query are its vector's components. A shard keeps one posting
list per term (a row of the transposed matrix) with the least and greatest
value in it, and the length of what each candidate has in the last 1, 2, ...
groups of terms. A group of terms can add to a score at most the sum of its
terms' bounds, and at most the product of the two lengths (Cauchy-Schwarz).

Each query's terms are split by these bounds: the non-essential ones are the
longest tail that cannot lift any candidate of the shard to the query's k-th
best score so far. Only the essential postings are traversed for all
candidates. The best by what they have are scored in full, which raises the
bar; the other terms are probed group by group, and only for candidates whose
bound still competes. Shards are merged by score.

Queries and candidates meet block by block. A block of queries is as large as a
task's memory allows, so a shard is sent only once to each ``block_rows`` of
them, and work is spread evenly whatever the ids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of a group, which is traversed or probed together.
GROUP = 8
#: Candidates scored in full to get a first k-th best score; queries searched together; pairs probed together.
SEED, TOGETHER, PROBED = 512, 256, 200_000


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    if scores.shape[1] <= k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


class Shard:
    """Posting lists of one shard, in groups of terms by falling width for the given queries, with their bounds."""

    def __init__(self, ids: np.ndarray, cands: np.ndarray, queries: np.ndarray):
        postings = cands.T
        most, least = postings.max(axis=1, initial=0).astype(float), postings.min(axis=1, initial=0).astype(float)
        self.order = np.argsort(-(most - least) * np.abs(queries).mean(axis=0), kind="stable")
        self.ids, self.postings = ids, np.ascontiguousarray(postings[self.order])
        self.most, self.least = most[self.order], least[self.order]
        self.cuts = [*range(0, len(postings), GROUP), len(postings)]
        square = [(self.postings[a:b].astype(float) ** 2).sum(axis=0) for a, b in zip(self.cuts, self.cuts[1:])]
        # length of each candidate in the groups from each cut on
        self.length = np.sqrt(np.concatenate([np.cumsum(square[::-1], axis=0)[::-1], np.zeros((1, len(ids)))]))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, tally: dict) -> pd.DataFrame:
        queries, last = queries[:, self.order], len(self.cuts) - 1
        high = np.maximum(queries * self.most, queries * self.least).astype(float)
        tail = lambda x: np.stack([x[:, c:].sum(axis=1) for c in self.cuts], axis=1)
        most, length = tail(high), np.sqrt(tail(queries.astype(float) ** 2))
        slack = 1e-6 + 1e-9 * (length[:, 0] * self.length[0].max(initial=0))
        own = qids[:, None] == self.ids[None, :]

        seed = (queries @ self.postings[:, :SEED]).astype(float)
        seed[own[:, :SEED]] = -np.inf
        bar = _kth(seed, k) - slack
        out_of_reach = np.minimum(most, length * self.length.max(axis=1)[None, :]) < bar[:, None]
        out_of_reach[:, 0], out_of_reach[:, last] = False, True
        essential = out_of_reach.argmax(axis=1)  # groups that are traversed

        scores = np.zeros((len(queries), len(self.ids)), queries.dtype)
        for g in range(int(essential.max(initial=0))):
            rows, terms = essential > g, slice(self.cuts[g], self.cuts[g + 1])
            scores[rows] += queries[rows, terms] @ self.postings[terms]
        if len(self.ids) > k + 1:  # the best so far, in full: at least k of them are not the query's own row
            best = np.argpartition(scores, len(self.ids) - k - 1, axis=1)[:, -k - 1 :]
            full = np.einsum("qt,tqk->qk", queries, self.postings[:, best]).astype(float)
            full[np.take_along_axis(own, best, axis=1)] = -np.inf
            bar = np.maximum(bar, _kth(full, k) - slack)
        row = np.arange(len(queries))
        reach = np.minimum(most[row, essential][:, None], length[row, essential][:, None] * self.length[essential])
        q, c = np.nonzero((scores + reach >= bar[:, None]) & ~own)
        tally["pairs"] = tally.get("pairs", 0) + own.size
        tally["traversed"] = tally.get("traversed", 0) + int(essential.sum()) * len(self.ids)
        tally["groups"] = tally.get("groups", 0) + last * own.size
        found = []
        for lo in range(0, len(q), PROBED):
            found.append(self._probe(q[lo : lo + PROBED], c[lo : lo + PROBED], scores, queries, essential, most, length, bar, tally))
        if found:
            q, c, score = (np.concatenate(x) for x in zip(*found))
        else:
            score = scores[q, c]
        rank = np.lexsort((self.ids[c], -score, q))
        q, c, score = q[rank], c[rank], score[rank]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return pd.DataFrame({"query_id": qids[q[keep]], "vec_id": self.ids[c[keep]], "score": score[keep].astype(np.int64)})

    def _probe(self, q, c, scores, queries, essential, most, length, bar, tally):
        """The competing ones of the pairs (query, candidate), with their whole scores."""
        score, at = scores[q, c], essential[q]
        for g in range(int(at.min(initial=0)), len(self.cuts) - 1):
            now, terms = np.flatnonzero(at == g), slice(self.cuts[g], self.cuts[g + 1])
            tally["probed"] = tally.get("probed", 0) + len(now)
            score[now] += (queries[q[now], terms] * self.postings[terms, c[now]].T).sum(axis=1)
            at[now] = g + 1
            reach = np.minimum(most[q[now], g + 1], length[q[now], g + 1] * self.length[g + 1, c[now]])
            keep = np.ones(len(q), bool)
            keep[now] = score[now] + reach >= bar[q[now]]
            q, c, score, at = q[keep], c[keep], score[keep], at[keep]
        tally["scored"] = tally.get("scored", 0) + len(q)
        return q, c, score


def search_block(ids: np.ndarray, cands: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, tally: dict | None = None) -> pd.DataFrame:
    """The k best candidates (ties to the smaller id) of each query within one shard; integer inputs, exact scores.

    tally, if given, counts the pairs, those scored to the last term, and the groups of terms traversed and probed.
    """
    tally = {} if tally is None else tally
    top = float(np.abs(cands).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, cands.shape[1])
    kind = np.int64 if top >= 2**53 else np.float64  # beyond what doubles hold exactly
    cands, queries = cands.astype(kind), queries.astype(kind)
    if not cands.shape[1]:  # vectors without components: all scores are 0
        cands, queries = np.zeros((len(ids), 1), kind), np.zeros((len(qids), 1), kind)
    shard = Shard(ids, cands, queries)
    return pd.concat([shard.search(qids[at : at + TOGETHER], queries[at : at + TOGETHER], k, tally) for at in range(0, len(qids), TOGETHER)], ignore_index=True)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query; ties go to the smaller id.

    Rows without id, without vector, or with a null or non-finite component take no part. Shorter vectors count as
    padded by zeros. A candidate with the query's own id is left out; of queries that repeat an id the least vector
    asks. Fewer than k candidates are all returned; an empty table gives no rows. Clashing names don't matter.
    """
    vectors = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks")
    )
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    n, asking, width, most = vectors.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v")), largest).first()
    kind = "int" if (most or 0) < 2**31 else "long"
    blocks, shards, width = max(1, -(-(asking or 0) // block_rows)), max(1, -(-n // shard_rows)), int(width or 0)
    padded = F.when(F.size("v") == width, F.col("v")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width)), 1, max(width, 1))).cast(f"array<{kind}>")

    def grouped(df: DataFrame, by: str, parts: int, names: tuple[str, str]) -> DataFrame:
        group = F.pmod(F.xxhash64("id", F.lit(by)), F.lit(parts)).cast("int")
        return df.groupBy(group.alias(by)).agg(F.collect_list(F.struct("id", padded.alias("v"))).alias("g")).select(
            by, F.col("g.id").alias(names[0]), F.flatten("g.v").alias(names[1])
        )

    queries = grouped(vectors.where("asks").groupBy("id").agg(F.min("v").alias("v")), "block", blocks, ("qids", "queries"))
    cands = grouped(vectors, "shard", shards, ("ids", "cands"))
    met = cands.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("shuffle_hash").join(queries, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, qids = np.asarray(row.ids), np.asarray(row.qids)
                yield search_block(ids, np.asarray(row.cands).reshape(len(ids), -1), qids, np.asarray(row.queries).reshape(len(qids), -1), k)

    found = met.select("shard", "ids", "cands", "qids", "queries").repartition(blocks * shards, "shard", F.hash("qids")).mapInPandas(
        run, "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
