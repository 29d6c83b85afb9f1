"""Which audio clips exist."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearken.functions.paths import canonical_path
from hearken.runtime import scratch_path

ENTRY = "path string, length long, modificationTime timestamp, folder boolean"
ROWS_PER_BATCH = 10_000


def _entries(folder: str, pattern: str) -> Iterator[tuple]:
    """Subfolders, and files whose name fits, of one folder; of a file, itself."""
    import posixpath
    from fnmatch import fnmatchcase

    from pyarrow import fs

    scheme, colon, _ = folder.partition("://")
    if colon:
        store, place = fs.FileSystem.from_uri(folder)
        front = scheme + colon + folder[len(scheme + colon) :].split("/", 1)[0]
        # an object store has its bucket in the place, a file system its host only in front
        front = f"{scheme}{colon}" if not place.startswith("/") else front
    else:
        store, place, front = fs.LocalFileSystem(), folder, ""
    root = store.get_file_info([place])[0]
    if root.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [root]
    if root.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(place))
    for entry in found:
        is_folder = entry.type == fs.FileType.Directory
        if is_folder or fnmatchcase(posixpath.basename(entry.path), pattern):
            yield front + entry.path, entry.size, entry.mtime, is_folder


def _listing(pattern: str):
    def work(frames):
        import pandas as pd

        columns = ["path", "length", "modificationTime", "folder"]
        for frame in frames:
            rows: list[tuple] = []
            for folder in frame["path"]:
                for row in _entries(folder, pattern):
                    rows.append(row)
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return work


def list_audio(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*.wav"
) -> DataFrame:
    """Path, length and time of every matching file below `path`, one folder or several.

    Folders are rows: each level of the tree is listed by the workers, a folder by one task,
    and written to the shared folder before its subfolders are listed. The driver sees only
    whether there is a next level. No file is opened, and none is left out: empty files and
    names that begin with a dot or an underscore are files like others. Paths are canonical
    (see `canonical_path`); a missing folder is an error.
    """
    roots = [path] if isinstance(path, str) else list(path)
    folders = spark.createDataFrame([(r,) for r in roots], "path string").select(
        canonical_path("path").alias("path")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = scratch_path(spark, "listing")
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        level = f"{place}/level={len(levels)}"
        spread = folders.distinct().repartition(tasks, "path")
        spread.mapInPandas(_listing(pattern), ENTRY).write.parquet(level)
        found = spark.read.schema(ENTRY).parquet(level)
        levels.append(found.where("not folder").drop("folder"))
        folders = found.where("folder").select("path")
    files = reduce(DataFrame.unionByName, levels)
    return files.withColumn("path", canonical_path("path"))
