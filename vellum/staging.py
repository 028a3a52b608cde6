"""Tables that several branches of a plan read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_folder: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows under spark.checkpoint.dir (where it is unset, as in local tests, under a folder of our own) and read them again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; executors share no other folder")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="vellum-staged-"))
        folder = f"file://{_own_folder[0]}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
