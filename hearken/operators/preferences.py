"""Training rows for language-model correctors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearken.functions.prompts import chat_message, fill_template
from hearken.runtime import ColumnLike, as_column


def preference_triples(
    df: DataFrame, template: str, truth: ColumnLike = "ref", machine: ColumnLike = "hyp"
) -> DataFrame:
    """`prompt`, `chosen`, `rejected`: correct the machine text, prefer the truth to it.

    The template's placeholder is `{instruction}`.
    """
    return df.select(
        fill_template(template, instruction=machine).alias("prompt"),
        as_column(truth).alias("chosen"),
        as_column(machine).alias("rejected"),
    )


def chat_preference(df: DataFrame) -> DataFrame:
    """The triples with each field as a list of one chat message."""
    return df.withColumns(
        {
            "prompt": F.array(chat_message("user", "prompt")),
            "chosen": F.array(chat_message("assistant", "chosen")),
            "rejected": F.array(chat_message("assistant", "rejected")),
        }
    )


def instruction_text(
    df: DataFrame, template: str, truth: ColumnLike = "ref", machine: ColumnLike = "hyp"
) -> DataFrame:
    """One training text per row; placeholders `{instruction}` and `{response}`."""
    return df.select(fill_template(template, instruction=machine, response=truth).alias("text"))
