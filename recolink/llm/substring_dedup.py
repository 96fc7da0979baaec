"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Every window selects one anchor: of
the runs of ``GRAM`` words in it the one with the least hash, so equal windows
select equal anchors, and a text needs about one anchor in 13 words.

``FingerprintIndex`` keeps (anchor hash, region hash, least and greatest
document) rows in immutable runs, each sorted by hash, in a folder with a
manifest; it can be opened again by a later session. A region is what
neighbouring windows that select one anchor span. A new batch becomes a run of
its own and is merge-joined with the older runs: an anchor that both hold is
suspect. When ``FAN`` runs of a level have gathered they are compacted into one
of the next level. ``dedup_batch`` adds one batch to an index and judges it
against all that came before; of the older texts it reads only those that hold
the first copy of a suspect region. ``dedup_passages`` adds a whole table in
batches of ascending ids and verifies all suspects together.

(The hashes of all windows, instead of one anchor for about 13 of them, would
make each run twice as large as the texts.)

Suspect anchors are then verified on the texts' own bytes by 128-bit digests.
Regions are compared first: one that also occurs under a smaller document id is a repeat as a whole.
Where an anchor has several different regions (at the ends of passages), each
region's first occurrence is compared window by window. Everything is keyed by
hash or by document; a passage that many documents share is one group of an
aggregation, never a list in a task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolink.llm.shared import bounded_batches, delete_path, discard, new_path, read_text, save, write_text
from recolink.llm.wordhash import Words

WINDOW, GRAM = 50, 25
#: Batches that a whole table is added in, and runs of a level that are compacted together.
BATCHES, FAN = 4, 3


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of the anchor that each window selects (the leftmost of equal ones)."""
    hashes = words.grams(gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    span = window - gram + 1
    at = np.arange(n)
    for lo in range(0, n, 1 << 16):  # bounded memory for long texts
        view = np.lib.stride_tricks.sliding_window_view(hashes[lo : min(n, lo + (1 << 16)) + span - 1], span)
        at[lo : lo + len(view)] += view.argmin(axis=1)
    return hashes[at], at


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the row: equal ids with equal texts are one document) and text; a null id counts as the greatest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    return docs.select(F.col(id_col).alias("doc_id"), ident.alias("id"), F.xxhash64(ident, text).alias("key"), text.alias("text"))


def regions(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of windows that select one anchor."""
    hashes, at = anchors(words, window, gram)
    if not len(at):
        return hashes.view(np.int64), at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[first].view(np.int64), first, np.concatenate([first[1:], [len(at)]]) - 1


def fingerprints(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document its word count, the digest of all its words, and the anchors and hashes of its regions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = Words(text)
                hashes, first, last = regions(words, window, gram)
                spans = words.spans(first, last + window - 1).view(np.int64) if len(first) else hashes
                out.append((len(words), hashlib.sha256(words.joined).hexdigest(), hashes, spans))
            yield pd.concat([batch[["doc_id", "id", "key"]], pd.DataFrame(out, columns=["n_words", "sha", "anchors", "regions"], index=batch.index)], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, id long, key long, n_words long, sha string, anchors array<long>, regions array<long>")


class FingerprintIndex:
    """Sorted immutable runs, by level, of (hash, region, a, b): a region of an anchor with the least and greatest id that holds it.

    ``folder`` holds the runs and ``manifest.json``, which names those that count. A run is written whole before the
    manifest names it, and deleted after the manifest has let it go; so a session that dies leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        known = read_text(spark, f"{self.folder}/manifest.json")
        self.runs: list[tuple[int, str]] = [tuple(x) for x in json.loads(known)] if known else []  # (level, name)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema("hash long, region long, a long, b long").parquet(f"{self.folder}/{name}")

    def _put(self, rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"run{level}-{uuid.uuid4().hex[:12]}"
        rows.groupBy("hash", "region").agg(F.min("a").alias("a"), F.max("b").alias("b")).sortWithinPartitions("hash", "region").write.parquet(f"{self.folder}/{name}")
        return level, name

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(runs))
        gone, self.runs = [x for x in self.runs if x not in runs], runs
        for _, name in gone:
            delete_path(self.spark, f"{self.folder}/{name}")

    def add(self, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Add a batch (id, anchors and regions). Returns, both saved, the hashes that several of its ids or older runs share, and
        the older ids (id, hash) that hold a first copy of a region with such a hash (None if there are no older runs)."""
        zipped = marks.select("id", F.explode(F.arrays_zip("anchors", "regions")).alias("x"))
        rows = zipped.select(F.col("x.anchors").alias("hash"), F.col("x.regions").alias("region"), F.col("id").alias("a"), F.col("id").alias("b"))
        run = self._put(rows, 0)
        new = self._table(run[1]).groupBy("hash").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        new = save(new.sortWithinPartitions("hash"), "batch") if self.runs else new
        shared, old = new.where("a < b").select("hash"), None
        for _, name in self.runs:
            met = self._table(name).select("hash", F.col("a").alias("id")).join(new.select("hash").hint("merge"), "hash")
            old = met if old is None else old.unionByName(met)
        if old is not None:
            old = save(old, "older")
            shared = shared.unionByName(old.select("hash"))
        shared = save(shared.distinct(), "shared")
        self._commit([*self.runs, run])
        self.compact()
        return shared, old

    def compact(self) -> None:
        """Merge the runs of each level that has gathered ``fan`` of them into one of the next."""
        level = 0
        while len(same := [x for x in self.runs if x[0] == level]) >= self.fan:
            merged = reduce(DataFrame.unionByName, [self._table(name) for _, name in same])
            self._commit([x for x in self.runs if x[0] != level] + [self._put(merged, level + 1)])
            level += 1

    def drop(self) -> None:
        self.runs = []
        delete_path(self.spark, self.folder)


def region_digests(suspects: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """suspects: id, key, text, hashes -> hash, digest, first and last window of each region whose anchor is listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ident, key, text, listed in zip(batch["id"], batch["key"], batch["text"], batch["hashes"]):
                words = Words(text)
                hashes, first, last = regions(words, window, gram)
                keep = np.isin(hashes, np.asarray(listed, np.int64))
                hashes, first, last = hashes[keep], first[keep], last[keep]
                digests = [hashlib.blake2b(words.span(p, q - p + window), digest_size=16).digest() for p, q in zip(first.tolist(), last.tolist())]
                yield pd.DataFrame({"hash": hashes, "digest": pd.Series(digests, dtype=object), "id": ident, "key": key, "first": first, "last": last})

    return suspects.select("id", "key", "text", "hashes").mapInPandas(run, "hash long, digest binary, id long, key long, first int, last int")


def window_digests(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """places: id, text, spans (hash, digest, first, last) -> per window its digest, and the region it is in and its number there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ident, text, hashes, regions_, firsts, lasts in zip(*(batch[c] for c in ("id", "text", "hashes", "digests", "firsts", "lasts"))):
                words, rows = Words(text), []
                for h, region, p, q in zip(hashes, regions_, firsts, lasts):
                    rows += [(hashlib.blake2b(words.span(w, window), digest_size=16).digest(), h, region, w - p) for w in range(int(p), int(q) + 1)]
                yield pd.DataFrame(rows, columns=["window", "hash", "digest", "at"]).assign(id=ident)

    return places.mapInPandas(run, "window binary, hash long, digest binary, at int, id long")


def repeated_windows(suspects: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document key the windows that also start under a smaller id: whole regions (firsts, lasts) and single ones (at)."""
    places = save(region_digests(suspects, window, gram), "regions")
    head = F.min(F.struct("id", "key", "first", "last")).alias("head")
    firsts = save(places.groupBy("hash", "digest").agg(head).select("hash", "digest", "head.*"), "firsts")
    several = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    spans = firsts.join(several.hint("merge"), "hash").groupBy("key").agg(F.collect_list(F.struct("hash", "digest", "first", "last")).alias("s"))
    texts = suspects.select("key", "id", "text").join(spans.hint("merge"), "key").select(
        "id", "text", F.col("s.hash").alias("hashes"), F.col("s.digest").alias("digests"), F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts")
    )
    windows = save(window_digests(texts, window), "windows")
    least = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("window", "least")
    single = windows.join(least.hint("merge"), "window").where("id > least").groupBy("hash", "digest").agg(F.collect_set("at").alias("at"))
    known = firsts.select("hash", "digest", F.col("id").alias("least")).join(single, ["hash", "digest"], "left")
    # saved, so that both sides of the next join come straight from a shuffle and a passage's rows can be split
    met = places.join(save(known, "known").hint("merge"), ["hash", "digest"])
    whole = F.col("id") > F.col("least")
    met = met.where(whole | F.col("at").isNotNull()).select(
        "key",
        F.when(whole, F.struct("first", "last")).alias("whole"),
        F.when(~whole, F.transform("at", lambda x: x + F.col("first"))).alias("at"),
    )
    return met.groupBy("key").agg(F.collect_list("whole").alias("whole"), F.flatten(F.collect_list("at")).alias("at")).select(
        "key", F.col("whole.first").alias("firsts"), F.col("whole.last").alias("lasts"), "at"
    )


def remove_windows(words: Words, firsts, lasts, window: int = WINDOW) -> tuple[int, bytes]:
    """Number of words that windows from one of firsts to the last beside it cover, and the other words, joined."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.asarray(firsts, np.int64), 1)
    np.add.at(edge, np.asarray(lasts, np.int64) + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return int(covered.sum()), b" ".join(w for w, gone in zip(words.words, covered.tolist()) if not gone)


def _suspects(rows: DataFrame, marks: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows that hold a shared hash, with the list of these (at most a document's own anchors)."""
    held = marks.select("key", F.explode(F.array_distinct("anchors")).alias("hash")).join(shared.hint("merge"), "hash")
    lists = held.groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    return rows.select("id", "key", "text").join(lists.hint("merge"), "key").dropDuplicates(["key"])


def _judged(rows: DataFrame, marks: DataFrame, suspects: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """The result of rows (with their marks), whose suspects and these' older partners are given, saved."""
    repeats = repeated_windows(suspects, window, gram)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            out = []
            for text, firsts, lasts, at in zip(batch["text"], batch["firsts"], batch["lasts"], batch["at"]):
                n, joined = remove_windows(Words(text), np.concatenate([firsts, at]), np.concatenate([lasts, at]), window)
                out.append((n, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
            frame = pd.DataFrame(out, columns=["n_removed", "kept", "left"], index=batch.index)
            yield pd.concat([batch[["key"]], frame if with_text else frame[["n_removed", "kept"]]], axis=1)

    cut = suspects.join(repeats, "key").select("key", "text", "firsts", "lasts", "at").mapInPandas(
        run, "key long, n_removed long, kept string" + ", left string" * with_text
    )
    cut = save(cut, "cut")
    base = marks.select("doc_id", "key", "n_words", "sha")
    if with_text:
        base = base.join(rows.select("key", "text").dropDuplicates(["key"]), "key")
    out = base.join(cut, "key", "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.coalesce("left", "text").alias("text")] if with_text else []))


def dedup_batch(index: FingerprintIndex, batch: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Judge a batch against all that the index holds and itself, and add it: doc_id, n_words, n_removed, kept_sha256[, text].

    corpus has the id_col and text_col of what was added before (more rows do no harm); only the documents that hold a
    first copy of a suspect region are read from it. A word goes if a window over it also starts in a document with a
    smaller id. A batch's ids should be greater than those before: older documents aren't judged again.
    """
    bounded_batches(batch)
    rows = keyed(batch, id_col, text_col)
    marks = save(fingerprints(rows, window, gram), "marks")
    shared, old = index.add(marks)
    suspects = _suspects(rows, marks, shared)
    if old is not None and corpus is not None:
        listed = old.groupBy("id").agg(F.collect_set("hash").alias("hashes"))
        texts = keyed(corpus, id_col, text_col).select("id", "key", "text")
        suspects = suspects.unionByName(texts.join(listed.hint("merge"), "id").select("id", "key", "text", "hashes").dropDuplicates(["key"]))
    return _judged(rows, marks, save(suspects, "suspects"), window, gram, with_text)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, text] per row of docs.

    A word goes if a window over it also starts in a document with a smaller id; windows are judged on the input. Null
    and empty texts have no words; texts shorter than a window are left alone, as are repeats inside one document and
    among rows of one id. Rows that repeat id and text get equal results. A null id counts as the greatest. An empty
    table gives no rows; other columns, whatever their names, are not looked at. The table is added to an index in
    ``batches`` of ascending ids of about equal size.
    """
    bounded_batches(docs)
    spark, rows = docs.sparkSession, keyed(docs, id_col, text_col)
    marks = save(fingerprints(rows, window, gram), "marks")
    shares = [k / batches for k in range(1, batches)]
    cuts = marks.agg(F.percentile_approx("id", shares, 1000)).first()[0] if shares else None
    number = sum((F.when(F.col("id") > x, 1).otherwise(0) for x in cuts or []), F.lit(0))
    index, found = FingerprintIndex(spark, new_path(spark, "passages")), []
    for k in range(batches):
        found.append(index.add(marks.where(number == k).select("id", "anchors", "regions")))
    index.drop()
    shared = reduce(DataFrame.unionByName, [x for x, _ in found]).distinct()
    suspects = save(_suspects(rows, marks, shared), "suspects")
    discard(*(x for pair in found for x in pair if x is not None))
    return _judged(rows, marks, suspects, window, gram, with_text)
