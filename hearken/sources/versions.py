"""Immutable dataset versions with a registry and the alias `latest`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hearken.runtime import path_exists, quoted

REGISTRY_SCHEMA = "name string, version int, rows bigint, fingerprint decimal(38,0)"
LATEST = "latest"


def _cell(field: T.StructField) -> Column:
    """Name, type and value, its length in front, so neighbouring cells cannot run together."""
    value = F.col(quoted(field.name))
    complex_type = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    text = F.to_json(value) if complex_type else value.cast("string")
    named = F.lit(f"{field.name}:{field.dataType.simpleString()}=")
    return F.concat(named, F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content sum over names, types and values.

    The sum adds a 60-bit number per row; unlike an exclusive or it counts duplicates.
    It is added up map-side, one row per task is shuffled.
    """
    cells = F.concat_ws("|", *[_cell(df.schema[c]) for c in sorted(df.columns)])
    number = F.conv(F.substring(F.md5(cells), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(number.alias("n")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"),
    )


def registry(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/registry"
    if not path_exists(spark, path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def _newest(spark: SparkSession, root: str, name: str):
    return (
        registry(spark, root)
        .where(F.col("name") == name)
        .agg(F.max(F.struct("version", "rows", "fingerprint")).alias("r"))
        .first()["r"]
    )


def publish_version(df: DataFrame, root: str, name: str) -> int:
    """Store `df` as the next version of `name`; equal content keeps the current version.

    The registry row is appended after the data is complete, so a reader never sees a
    version that is still being written. One publisher per name at a time.
    """
    spark = df.sparkSession
    root = root.rstrip("/")
    content = fingerprint(df).first()
    newest = _newest(spark, root, name)
    if newest and (newest["rows"], newest["fingerprint"]) == tuple(content):
        return newest["version"]
    version = newest["version"] + 1 if newest else 1
    df.write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
    row = [(name, version, content["rows"], content["fingerprint"])]
    spark.createDataFrame(row, REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{root}/registry"
    )
    return version


def read_version(
    spark: SparkSession, root: str, name: str, version: int | str = LATEST
) -> DataFrame:
    if version == LATEST:
        newest = _newest(spark, root, name)
        if newest is None:
            raise LookupError(f"no published version of {name!r}")
        version = newest["version"]
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/v={version}")
