"""Row-wise preparation of a corpus: columns, filters, flags, file checks, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearken.functions.paths import canonical_path
from hearken.runtime import ColumnLike, as_column, quoted


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail at plan time when a column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}, need {list(columns)}")
    return df


def select_dropna(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns and the rows without a null in them."""
    return df.select(*[f"`{c}`" for c in columns]).na.drop("any")


def to_canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename source columns to the names the other operators use."""
    return require_columns(df, list(mapping)).withColumnsRenamed(dict(mapping))


def drop_empty(df: DataFrame, column: ColumnLike) -> DataFrame:
    """Keep rows whose text is longer than nothing; nulls go too."""
    return df.where(F.length(as_column(column)) > 0)


def by_flag(df: DataFrame, flag: str, value: int) -> DataFrame:
    """One part of a predefined split. On a partition column this prunes whole folders."""
    return df.where(F.col(f"`{flag}`") == value)


def split_by_flag(
    df: DataFrame, flag: str, parts: tuple[str, str] = ("train", "eval"), split: str = "split"
) -> DataFrame:
    """Both parts of a predefined split in one pass: flag 0 and flag 1, other rows are left out."""
    column = F.col(f"`{flag}`")
    return df.where(column.isin(0, 1)).withColumn(
        split, F.when(column == 0, parts[0]).otherwise(parts[1])
    )


def assert_split(
    df: DataFrame, split: str = "split", parts: Sequence[str] = ("train", "eval")
) -> DataFrame:
    """Fail when a part has no rows. Counts all parts in one pass over one column."""
    column = F.col(f"`{split}`")
    sizes = df.agg(*[F.count_if(column == p).alias(p) for p in parts]).first().asDict()
    empty = [p for p in parts if not sizes[p]]
    if empty:
        raise ValueError(f"empty parts {empty} in column {split!r}")
    return df


def split_errors(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that passed and rows that failed, so that bad rows do not stop a job."""
    failed = F.coalesce(failed, F.lit(False))
    return df.where(~failed), df.where(failed)


def bundle_splits(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Two tables as one, told apart by the column `split`."""
    return train.withColumn("split", F.lit("train")).unionByName(
        evaluation.withColumn("split", F.lit("eval"))
    )


_PATH_KEY = "_canonical_path"


def _file_keys(files: DataFrame, path: str, base: str) -> DataFrame:
    return files.select(canonical_path(F.col(quoted(path)), base).alias(_PATH_KEY))


def with_existing_audio(
    df: DataFrame, files: DataFrame, path: str = "path", base: str = "/"
) -> DataFrame:
    """Rows whose clip is in the listing, however either side spells its path.

    Both sides are compared in their canonical form, relative paths as seen from `base`. A plain
    semi join: adaptive execution splits a path that many rows share.
    """
    keyed = df.withColumn(_PATH_KEY, canonical_path(F.col(quoted(path)), base))
    return keyed.join(_file_keys(files, path, base), _PATH_KEY, "left_semi").drop(_PATH_KEY)


def missing_audio(
    df: DataFrame, files: DataFrame, path: str = "path", base: str = "/"
) -> DataFrame:
    """Rows whose clip is not in the listing: the skip report. Paths as in `with_existing_audio`."""
    keyed = df.withColumn(_PATH_KEY, canonical_path(F.col(quoted(path)), base))
    return keyed.join(_file_keys(files, path, base), _PATH_KEY, "left_anti").drop(_PATH_KEY)


def prep_report(
    df: DataFrame,
    kept: ColumnLike,
    split: ColumnLike,
    parts: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """Rows read, rows kept and kept rows per part, in one pass."""
    kept, split = as_column(kept), as_column(split)
    return df.agg(
        F.count("*").alias("rows_read"),
        F.count_if(kept).alias("rows_kept"),
        *[F.count_if(kept & (split == p)).alias(f"rows_{p}") for p in parts],
    )


def first_of_split(
    df: DataFrame, part: str, n: int = 1, order: str = "utt_id", split: str = "split"
) -> DataFrame:
    """First records of one part for a look; a top-n per task, no full sort."""
    return df.where(F.col(split) == part).orderBy(order).limit(n)
