"""Incremental intake: new block files as they arrive, and poll states with what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.ingest import FINAL_STATES
from vellum.sources.layout import LAYOUT, blocks_of


def layout_stream(spark: SparkSession, root: str) -> DataFrame:
    """Canonical blocks of layout files (root/document/layout.json) as they appear."""
    files = spark.readStream.schema(LAYOUT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    path = F.col("_metadata.file_path")
    return blocks_of(files.select(F.element_at(F.split(path, "/"), -2).alias("doc_id"), "pdf_info"))


def final_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each file of a batch once, when it first reaches a final state (events: batch, file, state, at)."""
    final = events.where(F.col("state").isin(*FINAL_STATES)).withWatermark("at", delay)
    return final.dropDuplicatesWithinWatermark(["batch", "file"])
