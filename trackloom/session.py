"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "trackloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACKLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a fresh local folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="trackloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of the current scope, or below the shared folder outside any."""
    return f"{_SCOPE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever store the shared folder lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """A job's own folder: tables that are written inside are removed at the end.

    Read or write results before it ends; a result that is still to be computed cannot be read afterwards.
    """
    path = fresh_path(spark, "job")
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        remove(spark, path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with data that survive the loss of executors; used where several later steps would otherwise
    recompute an expensive input. The table stays until the ``scope`` around it ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # smaller than the default for numbers, which is most of what is written
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, name: str = "lookup") -> DataFrame:
    """One row per group, about to be joined to a table with many rows per group.

    It is written to the shared folder, so that its real size is known when the join is planned: Spark broadcasts it
    when it is below ``spark.sql.autoBroadcastJoinThreshold`` and the large table is not shuffled; otherwise the join
    is a sort-merge join whose skewed partitions are split.
    """
    return materialised(df, name)


def together(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df`` shuffled once by ``keys``, for several steps whose own keys all contain these.

    Windows, groups and joins on more keys find their rows in place. Spark joins in place only if told that some of a join's keys
    suffice, which is a setting of the session. Columns are put in order, numbers that differ from row to row last and side by
    side, as neighbouring rows then pack better.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    keys = list(keys)
    late = {"double": 3, "float": 3, "bigint": 2, "int": 2}
    names = sorted(df.columns, key=lambda c: 0 if c in keys else late.get(dict(df.dtypes)[c], 1))
    return df.select(*[F.col(f"`{c}`") for c in names]).repartition(*[F.col(f"`{k}`") for k in keys])


def frame_keys(keys: Iterable[str]) -> list[str]:
    """Of ``keys`` those that name a frame, or all where not both are there: many enough to spread rows by, and shared by most steps."""
    keys = list(keys)
    return ["session", "frame"] if {"session", "frame"} <= set(keys) else keys


def many_rows(df: DataFrame) -> DataFrame:
    """A side of a join that has rows for every frame: both sides are shuffled, skewed partitions are split.

    Spark sizes a table that ``explode`` or a task made by the files behind it. Where these are small it would send rows many
    times as many through the driver to every task.
    """
    return df.hint("merge")
