"""Tokenizing by pieces that a tokenizer treats apart, with a bounded cache of pieces.

Most words repeat. Where a tokenizer never merges across a place in a text, the tokens of the
text are those of the parts on both sides, so each distinct part is encoded once per worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

CACHE_ENTRIES = 300_000
CACHED_CHARS = 64


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Cache:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, object] = {}

    def values(self, lists: list[list[str]], prefix: str, value) -> list[list]:
        """The value of every piece of every list; unknown ones are encoded in one batch."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        found = [list(map(self.known.get, one)) for one in lists]
        missing = {
            p
            for one, got in zip(lists, found, strict=True)
            if None in got
            for p, g in zip(one, got, strict=True)
            if g is None
        }
        if not missing:
            return found
        ordered = sorted(missing)
        encoded = self.tokenizer.encode_batch_fast(
            [prefix + p for p in ordered], add_special_tokens=False
        )
        fresh = {p: value(e) for p, e in zip(ordered, encoded, strict=True)}
        self.known.update((p, v) for p, v in fresh.items() if len(p) <= CACHED_CHARS)
        return [
            [fresh[p] if g is None else g for p, g in zip(one, got, strict=True)]
            if None in got
            else got
            for one, got in zip(lists, found, strict=True)
        ]


class SpaceFreeCounts(_Cache):
    """Token counts for a vocabulary that drops white space before it splits words.

    No token then reaches over white space, so the words on both sides are independent.
    """

    def words(self, texts: Iterable[str]) -> list[list[str]]:
        return [re.sub("[\n\t\r]", " ", text).split(" ") for text in texts]

    def counts(self, lists: list[list[str]]) -> list[list[int]]:
        return self.values(lists, "", lambda e: len(e.ids))
