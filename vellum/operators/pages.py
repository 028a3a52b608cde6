"""Printed page numbers and page margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx


def body(blocks: DataFrame) -> DataFrame:
    return blocks.where("zone = 'body'")


def footnote_blocks(blocks: DataFrame) -> DataFrame:
    """Footnotes keep source order (ord); they are never sorted by index."""
    return blocks.where("zone = 'discarded' and type = 'page_footnote'")


def discarded(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where((F.col("zone") == "discarded") & (F.col("type") == kind))


def page_numbers(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_idx, pnum.

    A page's own number is the first number in the first of its page-number
    blocks that has one; other pages are filled by the commonest difference of
    number and page_idx (of equally common ones the first seen), or page_idx + 1
    in documents without any number."""
    read = discarded(blocks, "page_number").select("doc_id", "page_idx", "ord", tx.first_number(F.col("text")).alias("n")).where("n is not null")
    seen = read.groupBy("doc_id", "page_idx").agg(F.min_by("n", "ord").alias("n"))
    counted = seen.groupBy("doc_id", (F.col("n") - F.col("page_idx")).alias("offset")).agg(F.count("*").alias("times"), F.min("page_idx").alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("times"), "first")
    offsets = counted.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("doc_id", "offset")
    filled = pages.select("doc_id", "page_idx").join(seen, ["doc_id", "page_idx"], "left").join(offsets, "doc_id", "left")
    return filled.select("doc_id", "page_idx", F.coalesce("n", F.col("page_idx") + F.coalesce("offset", F.lit(1))).alias("pnum"))


def margins(blocks: DataFrame) -> DataFrame:
    """doc_id, page_idx, left, right: commonest x0 (of equals the smallest) and x1 (the largest).

    Blocks of several lines decide; the first line's indent misleads in others,
    which count only on pages that have no block of several lines."""
    texts = body(blocks).where("type in ('text', 'ref_text')").select("doc_id", "page_idx", "x0", "x1", (F.col("n_lines") >= 2).alias("several"))
    page = Window.partitionBy("doc_id", "page_idx")
    used = texts.withColumn("any_several", F.max("several").over(page)).where("several = any_several")
    sides = {}
    for side, sign in (("x0", 1), ("x1", -1)):
        counted = used.groupBy("doc_id", "page_idx", side).agg(F.count("*").alias("n"))
        sides[side] = counted.groupBy("doc_id", "page_idx").agg(F.max_by(side, F.struct("n", F.col(side) * -sign)).alias(side))
    return sides["x0"].withColumnRenamed("x0", "left").join(sides["x1"].withColumnRenamed("x1", "right"), ["doc_id", "page_idx"])
