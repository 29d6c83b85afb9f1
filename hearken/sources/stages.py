"""Stages that run once and are read back until something they depend on changes.

Beside the writer's `_SUCCESS`, a stage folder holds a manifest: a digest of the stage's
arguments and of its inputs. An input that is itself a stage counts by its manifest, so a change
runs through all stages after it; any other input counts by path, size and time of its files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearken.runtime import path_exists, read_small, write_small

MANIFEST = "_stage"


def is_complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _manifest(spark: SparkSession, path: str) -> str | None:
    place = f"{path.rstrip('/')}/{MANIFEST}"
    return read_small(spark, place) if path_exists(spark, place) else None


def files_digest(spark: SparkSession, path: str) -> str:
    """Of the files that Spark reads from `path` (a file, a folder or a pattern): how many, and a
    sum over their paths, sizes and times. Listed and added up as a table."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("n"))
    )
    r = files.agg(F.count("n").alias("files"), F.sum("n").alias("total")).first()
    return f"{r['files']}:{r['total']}"


def input_digest(spark: SparkSession, path: str) -> str:
    plain = not re.search(r"[*?\[{]", path)
    return (_manifest(spark, path) if plain else None) or files_digest(spark, path)


def stage_digest(
    spark: SparkSession, arguments: Mapping[str, Any] | None, inputs: Sequence[str]
) -> str | None:
    """Digest of what a stage depends on; None for a stage that depends on nothing named."""
    if arguments is None and not inputs:
        return None
    named = {"arguments": arguments or {}, "inputs": {p: input_digest(spark, p) for p in inputs}}
    text = json.dumps(named, sort_keys=True, default=repr, ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def _is_current(spark: SparkSession, path: str, digest: str | None) -> bool:
    return is_complete(spark, path) and (digest is None or _manifest(spark, path) == digest)


def materialize_once(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    enabled: bool = True,
    arguments: Mapping[str, Any] | None = None,
    inputs: Sequence[str] = (),
) -> DataFrame | None:
    """Write the result of `build` to `path` unless it is there already, then read it.

    `arguments` are the values that `build` depends on, `inputs` the paths it reads. If either
    differs from what the stage was written with, it is written again; without them a stage is
    never stale. A half-written folder has no success marker and is written again. The table
    cuts the lineage: executors lost later cost a re-read, not the stage. A stage that is
    switched off and not current gives None.
    """
    digest = stage_digest(spark, arguments, inputs)
    if not _is_current(spark, path, digest):
        if not enabled:
            return None
        build().write.mode("overwrite").parquet(path)
        _mark(spark, path, digest)
    return spark.read.parquet(path)


def export_once(
    spark: SparkSession,
    path: str,
    write: Callable[[], None],
    arguments: Mapping[str, Any] | None = None,
    inputs: Sequence[str] = (),
) -> None:
    """Run `write`, which leaves a folder with a success marker at `path`, unless it is current."""
    digest = stage_digest(spark, arguments, inputs)
    if not _is_current(spark, path, digest):
        write()
        _mark(spark, path, digest)


def _mark(spark: SparkSession, path: str, digest: str | None) -> None:
    # after the success marker: a stage without its manifest is not current
    if digest is not None:
        write_small(spark, f"{path.rstrip('/')}/{MANIFEST}", digest)
