"""Texts cut where no pre-token of the byte-level pattern can cross, so that ids of seen chunks can be looked up.

A blank before a non-blank always starts a pre-token, and so does a lone line
end and what follows it. Texts without two neighbouring white-space characters
are cut at every blank and line end; others only before a blank that precedes a
non-blank. Full stops and commas behind a letter are pre-tokens of their own.

Keys: ``"word"`` stands for a blank and the word, ``"\\nword"`` for itself, and
``(chunk,)`` for a chunk without a blank put before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

_TWO_SPACES = re.compile(r"\s\s").search
_BEFORE_BLANK = regex.compile(r"(?= \S)")
#: Longer chunks are not kept.
KEEP_CHARS = 48
#: What a chunk ends in that has full stops or commas behind its word.
_STOPS = frozenset(".,")


def spelled(key) -> str:
    return key[0] if type(key) is tuple else key if key[:1] == "\n" else f" {key}"


def keys_of(text: str) -> list:
    if _TWO_SPACES(text):
        return [(x,) for x in _BEFORE_BLANK.split(text) if x]
    keys: list = text.replace("\n", " \n").split(" ")
    keys[0] = (keys[0],)
    return keys


class ChunkCache:
    """encode: chunk keys -> one value each; join: two values -> the value of the chunks' concatenation.

    Two generations of at most ``entries`` chunks each: when the young one is full it becomes the old one, whose chunks
    move back when met again. So memory is bounded, and frequent chunks stay.
    """

    def __init__(self, encode: Callable, join: Callable, entries: int):
        self.encode, self.join, self.entries, self.seen, self.old = encode, join, entries, {}, {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks in order; unseen chunks of all texts are encoded in one call."""
        if len(self.seen) > self.entries:
            self.old, self.seen = self.seen, {}
        seen, known = self.seen, self.old.get
        out, need, waiting, joined = [], {}, [], []
        for text in texts:
            keys = keys_of(text)
            got = list(map(seen.get, keys))
            out.append(got)
            at = -1
            while True:
                try:
                    at = got.index(None, at + 1)
                except ValueError:
                    break  # no more unseen ones in this text
                key = keys[at]
                value = known(key)
                if value is not None:
                    got[at] = seen[key] = value
                    continue
                if key[-1:] in _STOPS and type(key) is str:
                    word = key.rstrip(".,")
                    if word and word[-1].isalpha():
                        tail = (key[len(word) :],)
                        for part in (word, tail):
                            if part not in seen:
                                value = known(part)
                                if value is None:
                                    need[part] = None
                                else:
                                    seen[part] = value
                        if word in seen and tail in seen:
                            got[at] = seen[key] = self.join(seen[word], seen[tail])
                        else:
                            joined.append((got, at, word, tail))
                        continue
                need[key] = None
                waiting.append((got, at, key))
        if need:
            fresh = dict(zip(need, self.encode(list(need))))
            for got, at, key in waiting:
                got[at] = fresh[key]
            for got, at, word, tail in joined:
                got[at] = self.join(fresh[word] if word in fresh else seen[word], fresh[tail] if tail in fresh else seen[tail])
            seen.update(fresh)
            for key in need:
                if len(key if type(key) is str else key[0]) > KEEP_CHARS:
                    del seen[key]
        return out
