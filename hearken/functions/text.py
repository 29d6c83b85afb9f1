"""Text cleaning with Unicode-safe character classes.

Java's plain `\\w` and `\\s` are ASCII only and would erase Cyrillic, so the classes are
spelled out. The same spelling is valid in RE2, which lets SQL engines check the results.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearken.runtime import ColumnLike, as_column

# The characters that count as whitespace, as a class body and as text.
WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE_CHARS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CLASS = r"\p{L}\p{N}_"
# A whitespace run. The rough zone is tested first and dismisses letters at once; the exact
# class alone takes twice as long.
WHITESPACE_RUN = (
    rf"[[\x00-\x20\x{{80}}-\x{{a0}}\x{{1680}}-\x{{3000}}]&&[{WHITESPACE_CLASS}]]+"
)
CYRILLIC_CLASS = r"\x{0400}-\x{04FF}"
# Fixed value: the marks removed before building a character vocabulary.
PUNCTUATION = ',?!.-;:"«»'


def normalize_full(text: ColumnLike) -> Column:
    """Lower-case, keep word characters only, single spaces, trimmed. Null gives ''."""
    lowered = F.lower(F.coalesce(as_column(text), F.lit("")))
    # "a-z " adds nothing to the classes, it lets the commonest characters pass quickly
    words_only = F.regexp_replace(lowered, f"[^a-z {WORD_CLASS}{WHITESPACE_CLASS}]+", "")
    return F.trim(F.regexp_replace(words_only, WHITESPACE_RUN, " "))


def normalize_cyrillic(text: ColumnLike) -> Column:
    """Keep Cyrillic and whitespace, lower-case. Spaces are neither merged nor trimmed."""
    return F.lower(
        F.regexp_replace(as_column(text), f"[^{CYRILLIC_CLASS}{WHITESPACE_CLASS}]", "")
    )


def normalize_punct(text: ColumnLike) -> Column:
    """Delete the fixed punctuation marks, lower-case."""
    return F.lower(F.translate(as_column(text), PUNCTUATION, ""))


def strip(text: ColumnLike) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(as_column(text), F.lit(WHITESPACE_CHARS))


def strip_lower(text: ColumnLike) -> Column:
    return F.lower(strip(text))
