"""Byte-level BPE by prefix dynamic programming, and decoding.

For every byte prefix exactly one token can end its encoding. ``PrefixCoder``
stores that last token per prefix: a longer prefix is coded by trying the
tokens that end there, longest first, and taking the one that forms a valid
pair with the last token stored for the prefix before it. Appending bytes only
adds entries (``Encoding.append``), and an edit recodes from the edited byte on
(``Encoding.edit``); the entries before it stay as they are.

A pair of tokens is valid if undoing their merges, latest first, never meets
two neighbours that would have merged earlier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolink.llm.chunked import ChunkCache, spelled
from recolink.llm.shared import bounded_batches

#: A byte prefix longer than this is coded in an array of its own instead of the shared memo.
MEMO_BYTES = 40
#: Entries of the memo, and of a generation of the chunk cache, after which each starts afresh; bounds a worker's memory.
MEMO_ENTRIES, CHUNK_ENTRIES = 600_000, 350_000
#: Texts whose chunks are looked up together.
TEXTS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixCoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece
        #: The longest token that ends in a given pair of bytes: no longer suffix is tried.
        self.reach: dict[bytes, int] = {}
        for piece in ranks:
            if len(piece) > 1 and len(piece) > self.reach.get(piece[-2:], 0):
                self.reach[piece[-2:]] = len(piece)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, int] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes[a] + self.bytes[b], token) for a, b in zip(parts, parts[1:])]
                at = min(range(len(merged)), key=merged.__getitem__)
                if merged[at] >= token:
                    break
                parts[at : at + 2] = [merged[at]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def valid(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MEMO_ENTRIES:
                self.pairs.clear()
            known = self.pairs[left, right] = self._valid(left, right)
        return known

    def _valid(self, left: int, right: int) -> bool:
        """Walk the seam back in time. A merge across it at a time before both sides' merges would have come first."""
        now = len(self.bytes) + 1
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < now:
                return False
            # undo the later of the two sides' own merges; at equal rank the right one came later
            if left > right:
                sides = ("left", "right")
            else:
                sides = ("right", "left")
            for side in sides:
                halves = self.split(left if side == "left" else right)
                if halves is None:
                    continue
                if side == "left":
                    now, left = left, halves[1]
                else:
                    now, right = right + 1, halves[0]
                break
            else:
                return True

    def last_token(self, data: bytes, end: int, before) -> int:
        """The token that ends data[:end]; before(i) is the one stored for data[:i]."""
        ranks, most = self.ranks, min(end, self.reach.get(data[end - 2 : end], 1) if end > 1 else 1)
        for length in range(most, 0, -1):
            token = ranks.get(data[end - length : end])
            if token is not None and (length == end or self.valid(before(end - length), token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > MEMO_BYTES:
            return Encoding(self, piece).ids()
        memo, end = self.memo, len(piece)
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        known = end
        while known and piece[:known] not in memo:
            known -= 1
        get = lambda i: memo[piece[:i]]
        for i in range(known + 1, end + 1):
            memo[piece[:i]] = self.last_token(piece, i, get)
        ids = []
        while end:
            # a memo cleared between calls can't lack a prefix: all of this piece's were just stored or found in order
            token = memo[piece[:end]]
            ids.append(token)
            end -= len(self.bytes[token])
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoding:
    """One piece's table of last tokens; exact under appends and edits."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Encoding:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.coder.last_token(self.data, end, self.last.__getitem__))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> Encoding:
        """Replace data[start:stop]; only prefixes that reach past start are coded anew."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.coder.bytes[self.last[end]])
        return out[::-1]


class CachedEncoder:
    """Encodes texts chunk by chunk. A chunk's value: number of ids, the decimal ids each followed by a blank, the bytes they decode to."""

    def __init__(self, coder: PrefixCoder, pattern: str):
        self.coder, self.find = coder, regex.compile(pattern).findall
        self.cache = ChunkCache(lambda keys: [self._chunk(spelled(k)) for k in keys], lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), CHUNK_ENTRIES)

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        ids = [i for piece in self.find(chunk) for i in self.coder.encode(piece.encode("utf-8", "surrogatepass"))]
        return len(ids), b"".join(b"%d " % i for i in ids), self.coder.decode(ids)

    def parts(self, texts: list[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
        for at in range(0, len(texts), TEXTS):
            yield from self.cache.values(texts[at : at + TEXTS])


_ENCODERS: dict = {}


def encoder(path: str, pattern: str) -> CachedEncoder:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = CachedEncoder(PrefixCoder(read_ranks(path)), pattern)
    return _ENCODERS[path, pattern]


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of docs; null and empty texts have no ids.

    Narrow: no shuffle; a worker holds one Arrow batch and its bounded caches.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for parts in enc.parts(batch["text"].fillna("").tolist()):
                ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                if parts:
                    counts, listed, raw = zip(*parts)
                    n = sum(counts)
                    ids.update(b"".join(listed)[:-1])
                    decoded.update(b"".join(raw))
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            yield pd.concat([batch[["id"]], pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)], axis=1)

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", "doc_id")


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with an array column of the text's ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks_path, pattern)
        return pd.Series([[int(i) for _, listed, _ in parts for i in listed.split()] for parts in enc.parts(texts.fillna("").tolist())])

    return docs.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; null ids give null, an unknown id fails."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        coder = encoder(ranks_path, pattern).coder
        return ids.map(lambda x: None if x is None else coder.decode(x))

    return df.withColumn(out_col, raw(F.col(ids_col)))
