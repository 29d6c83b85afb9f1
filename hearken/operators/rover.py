"""Word voting between systems (Fiscus 1997, ROVER)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearken.functions.words import alignments
from hearken.runtime import quoted

TIES = ("first", "word_over_null")
NETWORK, PIVOT = "network", "pivot"


def _voting(tie: str, align: str):
    """The voted text of the texts in a row, one per system.

    Alignment and vote are one Arrow step, so that the result is a column like any other.
    Everything is nested so that it travels to the workers by value.
    """
    _, edit_script = alignments()

    def winner(votes):
        # the earliest system breaks what the counts and the tie rule leave open
        return max(
            dict.fromkeys(votes),
            key=lambda word: (votes.count(word), tie == "first" or word != ""),
        )

    def over_first(texts):
        """Slots of words, all systems laid over the first one. Words inserted at one place
        meet by their order there."""
        first, *others = texts
        n = len(texts)
        at = [[["", *[""] * (n - 1)]]] + [[[word, *[""] * (n - 1)]] for word in first]
        for system, words in enumerate(others, 1):
            left, place, depth = iter(words), 0, 0
            for letter in edit_script(first, words):
                if letter == "I":
                    depth += 1
                    if depth == len(at[place]):
                        at[place].append([""] * n)
                else:
                    place, depth = place + 1, 0
                if letter != "D":
                    at[place][depth][system] = next(left)
        return [slot for place in at for slot in place]

    def laid_over(slots, words):
        """The cheapest script of words over slots of earlier systems' words.

        A word among a slot's words is free, another one costs one, as does a word of its own;
        a slot is left out for nothing if an earlier system left it out, else for one. Of equal
        scripts the alphabetically first of A, D, I is taken. Rows of costs to go are kept for
        every stride-th word, those between are made again.
        """
        from math import isqrt

        import numpy as np

        n, m = len(slots), len(words)
        where = {}
        for i, slot in enumerate(slots):
            for word in dict.fromkeys(slot):
                where.setdefault(word, []).append(i)
        skip = np.ones(n, np.int64)
        skip[where.get("", [])] = 0
        before = np.concatenate([[0], np.cumsum(skip)])

        def replaced(word):
            cost = np.ones(n, np.int64)
            cost[where.get(word, [])] = 0
            return cost

        def earlier(row, word):
            open_ = row + 1
            open_[:-1] = np.minimum(open_[:-1], row[1:] + replaced(word))
            return np.minimum.accumulate((open_ + before)[::-1])[::-1] - before

        stride = isqrt(m) + 1
        row = before[-1] - before
        kept = {m: row}
        for j in reversed(range(m)):
            row = earlier(row, words[j])
            if j % stride == 0:
                kept[j] = row
        script, i, j = [], 0, 0
        for low in range(0, m, stride):
            high = min(low + stride, m)
            rows = [kept[high]]
            for k in reversed(range(low, high)):
                rows.append(earlier(rows[-1], words[k]))
            rows = [r.tolist() for r in reversed(rows)]
            while j < high:
                now, then = rows[j - low], rows[j - low + 1]
                if i < n and now[i] == then[i + 1] + (words[j] not in slots[i]):
                    script.append("A")
                    i, j = i + 1, j + 1
                elif i < n and now[i] == now[i + 1] + ("" not in slots[i]):
                    script.append("D")
                    i += 1
                else:
                    script.append("I")
                    j += 1
        return [*script, *"D" * (n - i)]

    def network(texts):
        """Slots of words, each system laid over the network of those before it."""
        slots = [[word] for word in texts[0]]
        for system, words in enumerate(texts[1:], 1):
            plain = system == 1
            script = edit_script(texts[0], words) if plain else laid_over(slots, words)
            left, old, grown = iter(words), iter(slots), []
            for letter in script:
                slot = [""] * system if letter == "I" else next(old)
                grown.append([*slot, "" if letter == "D" else next(left)])
            slots = grown
        return slots

    laid_out = network if align == NETWORK else over_first

    def voted(texts):
        texts = [(text or "").split() for text in texts]
        if all(words == texts[0] for words in texts[1:]):
            return " ".join(texts[0])
        return " ".join(word for slot in laid_out(texts) if (word := winner(slot)))

    @F.pandas_udf("string")
    def vote(texts: pd.DataFrame) -> pd.Series:
        return pd.Series([voted(row) for row in zip(*(texts[c] for c in texts))], dtype=object)

    return vote


def rover(
    df: DataFrame,
    systems: Sequence[str],
    tie: str = "first",
    output: str = "rover",
    align: str = PIVOT,
) -> DataFrame:
    """Add the voted text of the hypothesis columns `systems`.

    With `align="pivot"` every system is aligned to the first one. With `align="network"` the
    first system grows to a network of words: each system is aligned to the network of those
    before it, where a word may match any of a slot's words, so that words which the first
    system lacks meet, too. Each slot goes to the word, or to nothing, with most votes. `tie`
    decides between equals: "first" takes what the earliest system says, "word_over_null"
    prefers any word to nothing, then the earliest system. With two systems and "first" the
    result is the first hypothesis. A null text has no words.

    All hypotheses of an utterance sit in one row, so the vote is a column expression: no
    word is unfolded into a row and nothing is shuffled. It can be normalised and scored in the
    same plan.
    """
    if tie not in TIES:
        raise ValueError(f"tie must be one of {TIES}, got {tie!r}")
    if align not in (NETWORK, PIVOT):
        raise ValueError(f"align must be {NETWORK!r} or {PIVOT!r}, got {align!r}")
    if len(systems) < 2:
        raise ValueError("voting takes at least two systems")
    texts = F.struct(*[F.col(quoted(s)).alias(f"s{i}") for i, s in enumerate(systems)])
    return df.withColumn(output, _voting(tie, align)(texts))
