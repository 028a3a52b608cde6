"""Shared folder, tables written to cut lineage, and sizes that follow the input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where driver and executors are one process, else one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master} share no other folder")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="vellum-"))
        folder = f"file://{_own_folder[0]}"
    return folder.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: computed once, kept if executors go."""
    return _written(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that are deleted when dropped, or at the end of the with block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _written(df, name)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [x for x in self.paths if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
            self.paths.remove((table, path))

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in self.paths])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores in front until the rows have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions_of(df: DataFrame) -> int:
    """How many tasks read this input, which is in proportion to its size."""
    return max(1, df.rdd.getNumPartitions())
