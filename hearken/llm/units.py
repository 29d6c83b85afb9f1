"""Token ids of whole texts from their distinct parts, without a Python object per word.

A text is cut where its tokenizer never merges across, so the ids of the text are those of its
parts in order. The parts of a slice of texts become a dictionary in Arrow; only parts that the
worker does not know yet are encoded, many in one string, and the ids of all parts lie in flat
arrays from which a slice takes its ids by index. Every part is encoded by the tokenizers
library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from hearken.llm.common import LOWER

KEPT_PARTS = 400_000
KEPT_VALUES = 8_000_000
KEPT_BYTES = 64
JOINED_PARTS = 20_000

# white space beyond ASCII, and U+2581, which one tokenizer takes for a space
_WIDE_2 = np.array([0xC285, 0xC2A0])
_WIDE_3 = np.array(
    [0xE19A80, 0xE2819F, 0xE38080, 0xE280A8, 0xE280A9, 0xE280AF, 0xE29681]
    + [0xE28080 + k for k in range(11)]
)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


TAKEN = 1 << 20


def take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] one after the other.

    Places are worked out for about TAKEN values at a time, so that they need little memory
    besides the result.
    """
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    first = done = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, done + TAKEN, side="right")))
        upto = int(ends[last - 1])
        if last == first + 1:
            out[done:upto] = flat[starts[first] : starts[first] + lengths[first]]
        else:
            n = lengths[first:last]
            shift = np.repeat(starts[first:last] - (ends[first:last] - n), n)
            out[done:upto] = flat[np.arange(done, upto) + shift]
        first, done = last, upto
    return out


class Runs:
    """Runs of values for `n` parts, added in any order: flat values, starts and lengths."""

    def __init__(self, n: int, dtype):
        self.starts, self.lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.flat, self.size = [np.zeros(0, dtype)], 0

    def add(self, parts, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts[parts], self.lengths[parts] = starts + self.size, lengths
        self.flat.append(flat)
        self.size += len(flat)

    def add_each(self, parts: list[int], runs: list[np.ndarray]) -> None:
        if parts:
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            self.add(parts, np.concatenate(runs), np.cumsum(lengths) - lengths, lengths)

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.flat), self.starts, self.lengths


class Parts:
    """Values of parts in flat arrays, one array per field, with a bounded memory.

    `encode` gives for a list of parts the (flat values, starts, lengths) of each field. When
    the memory is full, the parts that were met in most slices stay, at most half of them.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[tuple]]):
        self.encode = encode
        self.known: dict[bytes, int] = {}
        self.fields: list[tuple] = []
        self.met = np.zeros(0, np.int64)

    def _append(self, found: list[tuple]) -> None:
        if not self.fields:
            self.fields = [(f[:0], s[:0], n[:0]) for f, s, n in found]
        self.fields = [
            (np.append(flat, f), np.append(starts, s + len(flat)), np.append(lengths, n))
            for (flat, starts, lengths), (f, s, n) in zip(self.fields, found, strict=True)
        ]
        self.met = np.append(self.met, np.zeros(len(found[0][1]), np.int64))

    def _forget(self) -> None:
        entries = np.fromiter(self.known.values(), np.int64, len(self.known))
        met = self.met[entries]
        least = 2
        if len(met) > KEPT_PARTS // 2:
            least = max(2, int(np.partition(met, -(KEPT_PARTS // 2))[-(KEPT_PARTS // 2)]) + 1)
        stays = met >= least
        names = [k for k, one in zip(self.known, stays.tolist(), strict=True) if one]
        kept = entries[stays]
        self.met = self.met[kept] // 2
        self.known = {k: i for i, k in enumerate(names)}
        self.fields = [
            (take(flat, starts[kept], n[kept]), np.cumsum(n[kept]) - n[kept], n[kept])
            for flat, starts, n in self.fields
        ]

    def entries(self, parts: list[bytes]) -> np.ndarray:
        """The places of `parts` in the fields; they hold until the next call."""
        if len(self.met) > KEPT_PARTS or any(len(f[0]) > KEPT_VALUES for f in self.fields):
            self._forget()
        found = [self.known.get(p, -1) for p in parts]
        at = np.array(found, np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            missing = [parts[i] for i in fresh.tolist()]
            first = len(self.met)
            self._append(self.encode(missing))
            at[fresh] = np.arange(first, first + len(missing))
            self.known.update(
                (p, k) for k, p in enumerate(missing, first) if len(p) <= KEPT_BYTES
            )
        self.met[at] += 1
        return at

    def values(self, field: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of a field at all places in order, and how many each has."""
        flat, starts, lengths = self.fields[field]
        lengths = lengths[at]
        return take(flat, starts[at], lengths), lengths


def binary_runs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The runs of `data` that begin at `starts`, up to the next one, as an Arrow array."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers)


def _wide(lead: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    two = (lead.astype(np.int64) << 8) | second
    return np.isin(two, _WIDE_2) | np.isin((two << 8) | third, _WIDE_3)


def lone_leads(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single spaces or line feeds between two characters that are no white space."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~(edge[at] | edge[at + 1])]
    at = at[(data[at - 1] > 0x20) & (data[at + 1] > 0x20)]
    # a character before or after that is not ASCII may be wide white space
    beyond = np.flatnonzero((data[at - 1] >= 0x80) | (data[at + 1] >= 0x80))
    if len(beyond):
        padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
        p = at[beyond] + 3
        before = _wide(padded[p - 3], padded[p - 2], padded[p - 1]) | np.isin(
            (padded[p - 2].astype(np.int64) << 8) | padded[p - 1], _WIDE_2
        )
        after = _wide(padded[p + 1], padded[p + 2], padded[p + 3])
        at = np.delete(at, beyond[before | after])
    return at


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
# 1: letter, 2: mark that is in no contraction and no special token, 3: digit
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[ord(c) for c in '.,!?;:()"$%&*']] = 2
_KIND[0x30:0x3A] = 3
_KINDS_APART = np.zeros((4, 4), bool)
for _a, _b in ((1, 2), (1, 3), (2, 3)):
    _KINDS_APART[_a, _b] = _KINDS_APART[_b, _a] = True
_DIGITS_APART = _KINDS_APART.copy()
_DIGITS_APART[3, 3] = True


def led_parts(
    data: np.ndarray, offsets: np.ndarray, by_kind: bool = False
) -> tuple[pa.Array, np.ndarray]:
    """Parts that begin a text or a lone space or line feed, and each row's range of parts.

    `by_kind` cuts also between ASCII letters, marks and digits.
    """
    begins = np.zeros(len(data), bool)
    if by_kind:
        kind = _KIND[data]
        begins[1:] = _KINDS_APART[kind[:-1], kind[1:]]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    begins[lone_leads(data, offsets)] = True
    starts = np.flatnonzero(begins)
    return binary_runs(data, starts), np.searchsorted(starts, offsets)


def one_word(text: str) -> bool:
    return text.split() == [text]


def individually(tokenizer, texts: list[str]) -> list[np.ndarray]:
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(e.ids, np.uint32) for e in found]


def add_joined(runs: Runs, some: list[int], ids: np.ndarray, starts: np.ndarray, skip: int) -> bool:
    """Add the runs that begin at `starts`, without their first `skip` ids.

    False if they are not one for each part: then the parts must be encoded one by one.
    """
    if len(starts) != len(some) or starts[0] != 0:
        return False
    runs.add(some, ids, starts + skip, np.diff(np.append(starts, len(ids))) - skip)
    return True


class LedIds:
    """Ids of a byte-level BPE whose words take one leading space.

    Its splitting rule ends a token before a lone space, before and after a lone line feed, and
    between an ASCII letter, mark or digit and one of another kind.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.lead = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.lead[i] = token.startswith("Ġ") or token == "Ċ"
        self.parts = Parts(lambda parts: [self.encode(parts)])

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = Runs(len(parts), np.uint32)
        led, heads, odd = [], [], []
        texts = [p.decode() for p in parts]
        for i, text in enumerate(texts):
            if text[0] in " \n" and one_word(text[1:]):
                led.append(i)
            else:
                (heads if one_word(text) else odd).append(i)
        # a line feed before a part without a lead is a token of its own
        for prefix, group in (("", led), ("\n", heads)):
            for k in range(0, len(group), JOINED_PARTS):
                some = group[k : k + JOINED_PARTS]
                joined = prefix + prefix.join([texts[i] for i in some])
                ids = individually(self.tokenizer, [joined])[0]
                starts = np.flatnonzero(self.lead[ids])
                if not add_joined(runs, some, ids, starts, len(prefix)):
                    odd += some
        runs.add_each(odd, individually(self.tokenizer, [texts[i] for i in odd]))
        return runs.done()

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and where each row begins among them."""
        return _rows(self.parts, *led_parts(data, offsets, by_kind=True))


def spaceless_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words without the white space between them, cut also between ASCII letters, marks and
    single digits, in lower case; and each row's range of parts."""
    inner = ~_SPACE[data]
    kind = _KIND[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = inner[1:] & (~inner[:-1] | _DIGITS_APART[kind[:-1], kind[1:]])
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = inner[rows]
    at = np.flatnonzero(begins)
    words = data[inner]
    if b"<|" not in words.tobytes():  # the names of special tokens keep their case
        words = LOWER[words]
    # in `words`, each place is moved ahead by the white space before it
    starts = (np.cumsum(inner) - inner)[at]
    return binary_runs(words, starts), np.searchsorted(at, offsets)


class SpacelessIds:
    """Ids of a vocabulary that drops white space, lowers case and splits words by kind.

    Its splitting rule ends a token at white space, between an ASCII letter and a mark, and on
    both sides of a digit. Words of Latin-1 letters are only lower-cased by its normaliser and not
    split, so that they need only its model.
    """

    WORD = re.compile("[a-zªºµß-öø-ÿ]+")

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = load(path)
        self.mark = individually(self.tokenizer, [self.MARK])[0]
        with open(path, encoding="utf-8") as file:
            plain = json.load(file)
        split = {"type": "WhitespaceSplit"}
        rest = plain["pre_tokenizer"]["pretokenizers"][1:]
        plain |= {
            "normalizer": None,
            "added_tokens": [],
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, *rest]},
        }
        self.model = Tokenizer.from_str(json.dumps(plain))
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in plain["model"]["vocab"].items():
            self.ends[i] = token.endswith(plain["model"]["end_of_word_suffix"])
        self.parts = Parts(lambda parts: [self.encode(parts)])

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = Runs(len(parts), np.uint32)
        words, marked, odd = [], [], []
        texts = [p.decode() for p in parts]
        for i, text in enumerate(texts):
            lower = text if text.isascii() else text.lower()
            if self.WORD.fullmatch(lower):
                texts[i] = lower
                words.append(i)
            else:
                (odd if self.MARK in text else marked).append(i)
        for k in range(0, len(words), JOINED_PARTS):
            some = words[k : k + JOINED_PARTS]
            joined = " ".join([texts[i] for i in some])
            ids = individually(self.model, [joined])[0]
            starts = np.flatnonzero(np.append(True, self.ends[ids[:-1]]))
            if not add_joined(runs, some, ids, starts, 0):
                odd += some
        for k in range(0, len(marked), JOINED_PARTS):
            some = marked[k : k + JOINED_PARTS]
            joined = "".join([f"{self.MARK} {texts[i]} " for i in some])
            ids = individually(self.tokenizer, [joined])[0]
            starts = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) != 1 or not add_joined(runs, some, ids, starts, 1):
                odd += some
        runs.add_each(odd, individually(self.tokenizer, [texts[i] for i in odd]))
        return runs.done()

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and where each row begins among them."""
        return _rows(self.parts, *spaceless_parts(data, offsets))


def distinct_parts(cut: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct parts, and the place of each part among them."""
    encoded = cut.dictionary_encode()
    _, offsets, data = encoded.dictionary.buffers()
    raw = data.to_pybytes()
    ends = np.frombuffer(offsets, np.int64)[: len(encoded.dictionary) + 1].tolist()
    return [raw[a:b] for a, b in pairwise(ends)], encoded.indices.to_numpy()


def _rows(parts: Parts, cut: pa.Array, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(cut):
        return np.zeros(0, np.uint32), np.zeros(len(ranges), np.int64)
    distinct, at = distinct_parts(cut)
    ids, lengths = parts.values(0, parts.entries(distinct)[at])
    return ids, np.concatenate([[0], np.cumsum(lengths)])[ranges]


@lru_cache(maxsize=2)
def encoder(kind: type, source):
    """One encoder per worker process, kept from task to task."""
    return kind(source)
