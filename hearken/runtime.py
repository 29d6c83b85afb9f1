"""Session helpers shared by the operators: names, where to write, how wide to spread work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, which may use it many times."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> str:
    """A column name taken as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows anew into `partitions`, or leave them as they are read.

    For inputs that arrive in few large tasks, such as CSV with line breaks inside texts.
    """
    return df if partitions is None else df.repartition(partitions)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="hearken-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def read_small(spark: SparkSession, path: str) -> str:
    """A small text file in any store that Spark reaches."""
    files, hadoop_path = _file_system(spark, path)
    stream = files.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    stream = files.create(hadoop_path, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
