"""Column functions: each takes columns and returns a column, without reading or moving data."""

from hearken.functions.labels import argmax, encode_chars, unmask_decode
from hearken.functions.paths import absolute_path, canonical_path, prefix_path, rebase_path
from hearken.functions.prompts import (
    chat_message,
    fill_template,
    merge_request,
    render_chat,
)
from hearken.functions.text import (
    normalize_cyrillic,
    normalize_full,
    normalize_punct,
    strip,
    strip_lower,
)
from hearken.functions.words import (
    align_words,
    aligned_slots,
    edit_detail,
    percent,
    split_words,
    word_edits,
)

__all__ = [
    "absolute_path",
    "align_words",
    "aligned_slots",
    "argmax",
    "chat_message",
    "edit_detail",
    "encode_chars",
    "fill_template",
    "merge_request",
    "normalize_cyrillic",
    "normalize_full",
    "normalize_punct",
    "percent",
    "prefix_path",
    "rebase_path",
    "render_chat",
    "split_words",
    "strip",
    "strip_lower",
    "unmask_decode",
    "word_edits",
]
