"""Language identification as a mixture of languages per document.

Letter trigrams are counted per language over labelled rows. A document is a
mixture: expectation-maximisation estimates the share of each language from the
likelihoods of its trigrams, first with all languages, then with the one, two,
... largest. The set whose log-likelihood less half a log-count per free share
is greatest is kept, and its largest share is the prediction.

All work on texts is by document, over whole texts; documents of an Arrow batch
go through EM together as one sparse matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolink.llm.shared import bounded_batches

#: Hash buckets of trigrams.
BUCKETS = 8192
#: Labelled rows that the trigram counts come from on average, and rows of each language that are taken at least, if it has them.
TRAIN_ROWS, LEAST_ROWS = 6000, 300
#: Steps of EM with all languages, and with each smaller set.
STEPS, SET_STEPS = 6, 3
#: Documents whose mixtures are estimated together.
TOGETHER = 512


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text, all that is not a letter being one blank; without those of two blanks at their heart."""
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(_letters()[code], code, 32).astype(np.uint32)
    a, b, c = code[:-2], code[1:-1], code[2:]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(19)).astype(np.int64)[b != 32]


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and P(bucket | language), shape (BUCKETS, languages). Counts are made per partition and summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": counts[seen]})

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "lang string, bucket long, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows per language
    langs = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), 0.25)
    counts[found["bucket"], found["lang"].map({x: i for i, x in enumerate(langs)})] += found["n"]
    return langs, (counts / counts.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, weight: np.ndarray, starts: np.ndarray, doc: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after so many steps, and the log-likelihood under the shares before the last."""
    total = np.add.reduceat(weight, starts)
    for _ in range(steps):
        joint = like * share[doc]
        mass = joint.sum(axis=1)
        joint *= (weight / mass)[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    return share, np.add.reduceat(weight * np.log(mass), starts)


def mixtures(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages per text (0 for those not chosen), and which texts have a letter."""
    n, k = len(texts), table.shape[1]
    shares, has = np.zeros((n, k)), np.zeros(n, bool)
    buckets, weights, sizes = [], [], []
    for at, text in enumerate(texts):
        grams = trigrams(text)
        if len(grams):
            has[at] = True
            count = np.bincount(grams, minlength=BUCKETS)
            buckets.append(seen := np.flatnonzero(count))
            weights.append(count[seen])
            sizes.append(len(seen))
    if not sizes or not k:
        return shares, has
    like, weight = table[np.concatenate(buckets)], np.concatenate(weights).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first, value = _em(like, weight, starts, doc, np.full((len(sizes), k), 1 / k, np.float32), STEPS)
    penalty = 0.5 * np.log(np.add.reduceat(weight, starts))
    rank = np.argsort(np.argsort(-first, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = value - (k - 1) * penalty, first
    for size in range(1, k):
        start = np.where(rank < size, first + 1e-6, 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        share, value = _em(like, weight, starts, doc, start, SET_STEPS if size > 1 else 1)
        better = value - (size - 1) * penalty > best
        best, chosen = np.where(better, value - (size - 1) * penalty, best), np.where(better[:, None], share, chosen)
    shares[has] = chosen
    return shares, has


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, lang_pred and score (the language's share) of each row.

    learn says which rows' labels may be used. Of each language's about train_rows times its share of them, LEAST_ROWS
    at least, give the trigram counts, chosen by a hash of the id (all, if they are no more); what is learnt from is so
    bounded by train_rows and the number of languages. Null texts and texts without a letter are ``und`` with score 0,
    as is every text if there is nothing to learn from. Ties go to the language first in order. Repeated rows give
    repeated results; an empty table gives none; other columns, whatever their names, are not looked at.
    """
    bounded_batches(docs)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), learn.alias("learn")).where("learn AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    known, whole = sum(counts.values()), 1 << 30
    shares = {x: int(min(1.0, max(train_rows / known, LEAST_ROWS / n)) * whole) for x, n in counts.items()}
    share = F.element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), F.col("lang")) if shares else F.lit(0)
    some = labelled.where(F.pmod(F.xxhash64("id"), F.lit(whole)) < share)
    langs, table = train(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.iloc[at : at + TOGETHER]
                shares, has = mixtures(part["text"].tolist(), table)
                out = part[["id"]].copy()
                best = shares.argmax(axis=1) if langs else np.zeros(len(part), int)
                out["lang_pred"] = [langs[b] if h and langs else "und" for b, h in zip(best, has)]
                out["score"] = np.clip(shares.max(axis=1), 0, 1) if langs else 0.0
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double")
