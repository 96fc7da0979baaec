"""Bound-certified best-fit packing of tokenised documents into sequences.

1. Every document is tokenised once; only its length and one checksum per
   piece are kept. Documents longer than a sequence are cut into full pieces,
   which need no packing, and a first piece that may be shorter.
2. The open pieces are dealt to partitions of bounded size, and each is packed
   by best-fit decreasing. Dual-feasible functions give a lower bound of its
   bin count; a partition that meets it is certified.
3. Partitions with a gap exchange documents: what lies in their bins that are
   not full is dealt anew and packed again, for a given number of rounds or
   until no bin is saved.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolink.llm.chunked import ChunkCache, spelled
from recolink.llm.shared import bounded_batches, discard, save

#: Chunks in a generation of a worker's cache, and texts whose chunks are looked up together.
CHUNK_ENTRIES, TEXTS = 800_000, 256


class ChunkTokenizer:
    """Ids of texts as little-endian unsigned 32-bit words, from a tokenizers file.

    The string of a special token in a text is that token, as the library has it; texts are cut there, as chunks must not hold it.
    """

    def __init__(self, path: str, entries: int = CHUNK_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.special = {t.content: struct.pack("<I", i) for i, t in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if added else None
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        self.cache = ChunkCache(self._encode, bytes.__add__, entries)

    def _encode(self, keys: list) -> list[bytes]:
        """Chunks of one blank and one word are encoded in a row with others: the id that starts with a blank starts the next."""
        out: list = [None] * len(keys)
        words, others = [], []
        for i, key in enumerate(keys):
            (words if type(key) is str and key.isalnum() else others).append(i)
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            ids = np.array(self.tokenizer.encode(" " + " ".join([keys[i] for i in some]), add_special_tokens=False).ids, "<u4")
            starts, raw = (np.flatnonzero(self.blank_first[ids]) * 4).tolist(), ids.tobytes()
            for i, start, stop in zip(some, starts, [*starts[1:], len(raw)], strict=True):
                out[i] = raw[start:stop]
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            for i, enc in zip(some, self.tokenizer.encode_batch_fast([spelled(keys[i]) for i in some], add_special_tokens=False)):
                out[i] = struct.pack(f"<{len(enc.ids)}I", *enc.ids)
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TEXTS):
            some = texts[at : at + TEXTS]
            if not any(x in text for x in self.special for text in some):
                yield from map(b"".join, self.cache.values(some))
                continue
            cut = [self.cut(text) for text in some]  # every second part is a special token
            values = iter(self.cache.values([part for parts in cut for part in parts[::2]]))
            for parts in cut:
                yield b"".join(self.special[part] if i % 2 else b"".join(next(values)) for i, part in enumerate(parts))


_TOKENIZERS: dict[tuple[str, int], ChunkTokenizer] = {}


def tokenizer(path: str, entries: int = CHUNK_ENTRIES) -> ChunkTokenizer:
    if (path, entries) not in _TOKENIZERS:
        _TOKENIZERS[path, entries] = ChunkTokenizer(path, entries)
    return _TOKENIZERS[path, entries]


def cut_lengths(n: int, size: int) -> list[int]:
    """Piece lengths of a document of n ids: full pieces behind a first one that may be shorter."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest bound of a family of dual-feasible functions over the lengths, one for each threshold t.

    f_t: lengths above size - t count a whole bin, those under t count nothing, the others as they are. The bins
    that the mapped lengths fill are a lower bound of the bins that the lengths need.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    mass = np.cumsum(count * np.arange(size + 1))
    above = count.sum() - np.cumsum(count)
    best = -(-int(mass[-1]) // size)
    for t in range(1, size // 2 + 1):
        filled = int(above[size - t]) * size + int(mass[size - t] - mass[t - 1])
        best = max(best, -(-filled // size))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """bin and offset of each length, and the number of bins; the fullest bin that still has room takes the next item."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps, used = 0, 0  # gaps: bit g is set if a bin has room for exactly g
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = gaps >> need
        if fitting:
            gap = need + (fitting & -fitting).bit_length() - 1
            at = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, at, used = size, used, used + 1
        bins[i], offsets[i] = at, size - gap
        if left := gap - need:
            open_by_gap[left].append(at)
            gaps |= 1 << left
    return bins, offsets, used


def _pack_round(items: DataFrame, parts: int, size: int, number: int, seed: int) -> DataFrame:
    """items: uid, length -> with round, part, bin, offset, full (its bin has no room), certified (its partition meets the bound)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        pool = pd.concat(got, ignore_index=True).sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = pool["length"].to_numpy(np.int64)
        for part, rows in pool.groupby("part", sort=True):
            own = lengths[rows.index.to_numpy()]
            bins, offsets, used = best_fit_decreasing(own, size)
            fill = np.bincount(bins, weights=own, minlength=used).astype(np.int64)
            yield pd.DataFrame({
                "uid": rows["uid"].to_numpy(), "length": own, "round": number, "part": part, "bin": bins, "offset": offsets,
                "full": fill[bins] == size, "certified": used == lower_bound(own, size),
            })

    part = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).cast("long")
    dealt = items.select("uid", "length", part.alias("part")).repartition(parts, "part")
    return dealt.mapInPandas(run, "uid long, length long, round int, part long, bin long, offset long, full boolean, certified boolean")


def _bins(packed: DataFrame) -> int:
    return packed.select("part", "bin").distinct().count()


def assign(items: DataFrame, size: int = 1024, per_partition: int = 60_000, rounds: int = 3) -> DataFrame:
    """Sequence and offset for each item (uid long, length 1..size): uid, round, part, bin, offset."""
    gap = ~F.col("certified") & ~F.col("full")
    packed = save(_pack_round(items, max(1, -(-items.count() // per_partition)), size, 0, 0), "packed")
    done = []
    for number in range(1, rounds):
        open_rows = packed.where(gap)
        count, partitions = open_rows.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
        if partitions < 2:  # none is left to exchange with
            break
        retry = save(_pack_round(open_rows, -(-count // per_partition), size, number, number), "packed")
        if _bins(retry) >= _bins(open_rows):
            discard(retry)
            break
        done.append(packed.where(~gap))
        packed = retry
    done.append(packed)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("uid", "round", "part", "bin", "offset")


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """One row per document: uid, id, n, crcs (one per piece) and, if asked for, the ids themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = tokenizer(tokenizer_path, cache_entries), struct.pack("<I", end_id)
        alone = TaskContext.get().partitionId() << 40  # numbers of the sequences that one full piece fills
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            ns, crcs, kept, numbers = [], [], [], []
            for ids in enc.ids(texts):
                ids, at, own = ids + end, 0, []
                ns.append(len(ids) // 4)
                for length in cut_lengths(ns[-1], size):
                    own.append(zlib.crc32(ids[at : at + 4 * length]))
                    at += 4 * length
                crcs.append(own)
                numbers.append(alone)
                alone += ns[-1] // size
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            yield pd.DataFrame({"uid": batch["uid"], "id": batch["id"], "n": ns, "crcs": crcs, "alone": numbers} | ({"ids": kept} if with_ids else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInPandas(run, f"uid long, id {kind}, n long, crcs array<long>, alone long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 60_000, rounds: int = 3, with_ids: bool = False, cache_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one for each piece of each document.

    Null and empty texts are documents of the end id alone. Repeated rows are packed one by one. An empty table
    gives no pieces. Only the row numbers and lengths of open pieces are shuffled; one task packs at most about
    ``per_partition`` of them, whatever the sources are.
    """
    bounded_batches(docs)
    cut = save(pieces(docs, tokenizer_path, size, end_id, id_col, text_col, with_ids, cache_entries), "pieces")
    first = F.col("n") % size
    items = cut.where(first > 0).select("uid", first.alias("length"))
    packed = save(assign(items, size, per_partition, rounds), "sequences")
    has_first = (first > 0).cast("int")
    rows = cut.select("*", has_first.alias("__first"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(
        F.when(F.col("__first") == 1, first).otherwise(F.lit(size)) + (F.col("piece") - 1) * size
    ).cast("long")
    length = F.when((F.col("piece") == 0) & (F.col("__first") == 1), first).otherwise(F.lit(size)).cast("long")
    rows = rows.withColumn("start", start).withColumn("length", length).select(
        "uid", F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "__first", "alone",
        *([F.expr("slice(ids, int(start) + 1, int(length))").alias("ids")] if with_ids else []),
    )
    # an open piece's sequence is numbered by round, partition and bin; a full piece's, below zero, by its place in its task
    opening = (F.col("piece") == 0) & (F.col("__first") == 1)
    shared = rows.where(opening).join(packed, "uid").withColumn("sequence_id", F.expr("(round * 1000000L + part) * 1000000000L + bin"))
    alone = rows.where(~opening).select(
        "*", F.expr("-1L - alone - (piece - __first)").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return shared.select(*names).unionByName(alone.select(*names))

