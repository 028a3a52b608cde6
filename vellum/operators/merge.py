"""Connections between blocks: edges, chains, and what is wrong with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_edges(positions: DataFrame, connections: DataFrame) -> DataFrame:
    """doc_id, src_page, src_index, dst_page, dst_index of consecutive positions in a connection.

    Both ends must resolve; of several edges from one source the last counts."""
    order = Window.partitionBy("doc_id", "conn").orderBy("ord")
    pairs = connections.withColumn("next", F.lead("position").over(order)).where("next is not null")
    src = positions.select("doc_id", "position", F.col("page_idx").alias("src_page"), F.col("index").alias("src_index"))
    dst = positions.select("doc_id", F.col("position").alias("next"), F.col("page_idx").alias("dst_page"), F.col("index").alias("dst_index"))
    edges = pairs.join(src, ["doc_id", "position"]).join(dst, ["doc_id", "next"])
    last = F.max_by(F.struct("dst_page", "dst_index"), F.struct("conn", "ord")).alias("d")
    return edges.groupBy("doc_id", "src_page", "src_index").agg(last).select("doc_id", "src_page", "src_index", "d.dst_page", "d.dst_index")


def chains(edges: DataFrame) -> DataFrame:
    """Every block that a chain appends, with the chain's head and the depth.

    Heads are sources that are no target. A chain stops before it meets a block
    again; what can only be reached through a cycle has no head and is in
    cycles(). Each round of the loop extends all chains of all documents by one
    edge, and rounds end when no chain goes on."""
    targets = edges.select("doc_id", F.col("dst_page").alias("src_page"), F.col("dst_index").alias("src_index")).distinct()
    name = lambda page, index: F.concat_ws(":", F.col(page).cast("string"), F.col(index).cast("string"))
    heads = edges.join(targets, ["doc_id", "src_page", "src_index"], "left_anti")
    spark = edges.sparkSession
    view = f"edges_{uuid.uuid4().hex}"
    edges.withColumns({"_src": name("src_page", "src_index"), "_dst": name("dst_page", "dst_index")}).createOrReplaceTempView(view)
    heads.withColumns({"_src": name("src_page", "src_index"), "_dst": name("dst_page", "dst_index")}).createOrReplaceTempView(f"{view}_heads")
    walked = spark.sql(f"""
        WITH RECURSIVE walk(doc_id, head_page, head_index, page_idx, index, depth, seen) MAX RECURSION LEVEL 1000000 AS (
          SELECT doc_id, src_page, src_index, dst_page, dst_index, CAST(1 AS BIGINT), concat('|', _src, '|', _dst, '|') FROM {view}_heads
          UNION ALL
          SELECT w.doc_id, w.head_page, w.head_index, e.dst_page, e.dst_index, w.depth + 1, concat(w.seen, e._dst, '|')
          FROM walk w JOIN {view} e ON e.doc_id = w.doc_id AND e.src_page = w.page_idx AND e.src_index = w.index
          WHERE instr(w.seen, concat('|', e._dst, '|')) = 0)
        SELECT doc_id, head_page, head_index, page_idx, index, depth FROM walk""")
    # the query is resolved; its views are not needed again
    for name in (view, f"{view}_heads"):
        spark.catalog.dropTempView(name)
    return walked


def cycles(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """Edges that no chain walks: they close or lie in a cycle, and their blocks would be lost or repeated."""
    reached = walked.select("doc_id", F.col("page_idx").alias("dst_page"), F.col("index").alias("dst_index")).distinct()
    heads = walked.select("doc_id", F.col("head_page").alias("src_page"), F.col("head_index").alias("src_index")).distinct()
    unreached = edges.join(reached, ["doc_id", "dst_page", "dst_index"], "left_anti")
    ends = walked.select("doc_id", F.col("page_idx").alias("src_page"), F.col("index").alias("src_index")).unionByName(heads).distinct()
    steps = Window.partitionBy("doc_id", "head_page", "head_index").orderBy("depth")
    went = walked.withColumns({"src_page": F.coalesce(F.lag("page_idx").over(steps), "head_page"), "src_index": F.coalesce(F.lag("index").over(steps), "head_index")}).select("doc_id", "src_page", "src_index")
    closing = edges.join(ends, ["doc_id", "src_page", "src_index"], "left_semi").join(went.distinct(), ["doc_id", "src_page", "src_index"], "left_anti")
    return unreached.select(edges.columns).unionByName(closing.select(edges.columns)).distinct()


def double_targets(edges: DataFrame) -> DataFrame:
    """Blocks that two sources claim: their text comes out twice."""
    return edges.groupBy("doc_id", "dst_page", "dst_index").agg(F.count("*").alias("n")).where("n > 1")
