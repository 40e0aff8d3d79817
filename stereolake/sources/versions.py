"""Tables whose versions stay: each version is a folder that is never changed, and a commit file points at it.

A writer puts its rows into a folder of its own and then creates the commit file of the next number. Creating fails where
the file is there already, so of two writers that started from the same version one is told of the conflict and the table
is as the other left it. HDFS and stores with conditional writes create exclusively; on a local disk, as in tests, the file
system checks first and creates then. A folder without a commit file belongs to no version. Readers see a version whole or
not at all, and old versions as they were.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(Exception):
    """Another writer has committed since the version that a writer started from."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Folder by version; a commit file that isn't written to its end yet doesn't count."""
    fs, commits = _path(spark, f"{root}/commits")
    if not fs.exists(commits):
        return {}
    rows = spark.read.text(f"{root}/commits").select(F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)$", 1).alias("v"), "value").where("v <> '' AND value LIKE '% end'").collect()
    return {int(r.v): r.value.removesuffix(" end") for r in rows}


def current(spark: SparkSession, root: str) -> int:
    """The last version, 0 before the first."""
    return max(versions(spark, root), default=0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version, the last one if not told; KeyError where there is no such version."""
    found = versions(spark, root)
    return spark.read.parquet(f"{root}/{found[max(found, default=0) if version is None else version]}")


def commit(rows: DataFrame, root: str, based_on: int) -> int:
    """Writes rows as the version after `based_on` and returns its number; VersionConflict if that one is taken."""
    spark = rows.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    fs, path = _path(spark, f"{root}/commits/{based_on + 1:012d}")
    fs.mkdirs(path.getParent())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise VersionConflict(f"version {based_on + 1} of {root} is another writer's") from None
    try:
        out.write(bytearray(f"{folder} end\n".encode()))
    finally:
        out.close()
    return based_on + 1


def merge(spark: SparkSession, root: str, changes: DataFrame, key: str = "session", based_on: int | None = None) -> int:
    """The table with `changes` patched in, as a new version; see `patch` for what a change says."""
    based_on = current(spark, root) if based_on is None else based_on
    return commit(patch(read(spark, root, based_on), changes, key), root, based_on)


def patch(rows: DataFrame, changes: DataFrame, key: str = "session", named: str = "named") -> DataFrame:
    """Rows with the named fields of `changes` in place of theirs, everything else kept; a change has one row a key.

    Without a column `named` a change names all its fields, and null sets null. With it, an array of field names, just
    these are set, so that null can be told from a field that stays; a null array names nothing.
    """
    fields = [c for c in changes.columns if c not in (key, named)]
    own = F.col(named) if named in changes.columns else F.array(*[F.lit(c) for c in fields]).cast("array<string>")
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields], F.coalesce(own, F.array().cast("array<string>")).alias("_names"))
    joined = rows.join(new, F.col(key) == F.col("_k"), "left")
    told = lambda c: F.coalesce(F.array_contains("_names", c), F.lit(False))
    return joined.select(*[F.when(told(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
