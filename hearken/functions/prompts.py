"""Prompt text and chat messages for language-model correctors."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from hearken.runtime import ColumnLike, as_column

# How the two versions are labelled in a merge request.
VERSION_A_LABEL = "Версия А: "
VERSION_B_LABEL = "Версия Б: "

# Role tags of the plain prompt rendering.
ROLE_OPEN = "<|"
ROLE_CLOSE = "|>\n"
TURN_END = "\n"


def fill_template(template: str, **values: ColumnLike) -> Column:
    """Put columns into the named placeholders of `template`.

    The template is cut into literals and columns once, so braces inside a value are
    ordinary text. A null value makes the result null.
    """
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field not in values:
                raise KeyError(f"no column for placeholder {field!r}")
            pieces.append(as_column(values[field]))
    return F.concat(*pieces) if pieces else F.lit("")


def chat_message(role: str, content: ColumnLike) -> Column:
    return F.struct(F.lit(role).alias("role"), as_column(content).alias("content"))


def merge_request(version_a: ColumnLike, version_b: ColumnLike, system_text: str) -> Column:
    """System message plus a user message that quotes both versions."""
    quoted = F.concat(
        F.lit(f'{VERSION_A_LABEL}"'),
        as_column(version_a),
        F.lit(f'"\n\n{VERSION_B_LABEL}"'),
        as_column(version_b),
        F.lit('"'),
    )
    return F.array(chat_message("system", F.lit(system_text)), chat_message("user", quoted))


def tagged_turn(role: ColumnLike, content: ColumnLike) -> Column:
    return F.concat(
        F.lit(ROLE_OPEN), as_column(role), F.lit(ROLE_CLOSE), as_column(content), F.lit(TURN_END)
    )


def generation_prompt() -> str:
    return f"{ROLE_OPEN}assistant{ROLE_CLOSE}"


def render_chat(messages: ColumnLike, add_generation_prompt: bool = True) -> Column:
    """One prompt string from an array of role/content messages."""
    turns = F.array_join(
        F.transform(as_column(messages), lambda m: tagged_turn(m["role"], m["content"])), ""
    )
    return F.concat(turns, F.lit(generation_prompt())) if add_generation_prompt else turns
