"""Paragraphs that a page boundary cuts, joined again in the rendered text.

At a standalone anchor the block before and the block after it (figures and
their captions are stepped over) are one paragraph if the first stops open and
the second opens nothing new. What stands before and after an anchor is found by
windows over a document. Only one thing is carried from anchor to anchor: what
the join before has taken. A joined block ends as its last part does, and where
figures were stepped over, the last of them stands before the next anchor. So a
fold over a document's anchors, few and without texts, decides; then each block
that is taken goes to the head of its run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.profile import CJK_PROFILE, Profile

_ANCHOR = r"(?U)\A\s*<!--p\.(-?\d+)-->\s*\z"
_FLOAT = r"(?U)\A\s*(!\[|\*|<small>)"


def _decided(lines: DataFrame, profile: Profile) -> DataFrame:
    """lines with k (place from 0), and of each anchor page, float count and whether either side allows a join."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.select("doc_id", "pos", "md").withColumns({"k": F.row_number().over(order).cast("long") - 1, "bare": tx.strip(F.col("md"))})
    solid = F.when(~F.col("md").rlike(_FLOAT), F.struct("k", "bare"))
    rows = rows.withColumns({"next": F.first(solid, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), "before": F.lag("bare").over(order), "page": F.regexp_extract("md", _ANCHOR, 1).try_cast("long")})
    rows = rows.withColumns({"open": tx.stays_open(F.col("before"), profile), "bound": tx.is_continued(F.col("next.bare"), profile), "noted": tx.is_only_references(F.col("before"))})
    return rows.withColumns({"floats": F.col("next.k") - F.col("k") - 1, "after": F.col("next.k")}).drop("next", "before")


def _joins(decided: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, k, after, floats, page of each anchor that joins."""
    # the mark of an anchor stands where references after it are taken away
    mark_is_open = F.lit(">" not in profile.terminals)
    anchors = decided.where("page > 0 and bound and k > 0").select("doc_id", F.struct("k", "after", "floats", "page", "open", "noted").alias("a"))
    in_order = F.array_sort(F.collect_list("a"))
    kind = "array<struct<k: bigint, after: bigint, floats: bigint, page: bigint, open: boolean, noted: boolean>>"

    def step(done, a):
        last = F.try_element_at(done, F.lit(-1))
        taken = F.coalesce(last["after"] == a["k"] - 1, F.lit(False))
        before = F.when(taken, (last["floats"] == 0) & (a["open"] | (a["noted"] & mark_is_open))).otherwise(a["open"])
        return F.when(before, F.concat(done, F.array(a))).otherwise(done)

    folded = anchors.groupBy("doc_id").agg(F.aggregate(in_order, F.array().cast(kind), step).alias("joins"))
    return folded.select("doc_id", F.inline("joins")).select("doc_id", "k", "after", "floats", "page")


def _parts(lines: DataFrame, profile: Profile) -> DataFrame:
    """Every block with the place of the block that it ends up in (head), and what joins it (page and floats, at anchors that join)."""
    decided = _decided(lines, profile)
    joins = _joins(decided, profile)
    taken = joins.select("doc_id", "k", F.lit(True).alias("anchor"), "floats", "page").unionByName(joins.select("doc_id", F.col("after").alias("k"), F.lit(False).alias("anchor"), F.lit(None).cast("long").alias("floats"), F.lit(None).cast("long").alias("page")))
    rows = decided.select("doc_id", "k", "md", "bare").join(taken, ["doc_id", "k"], "left")
    order = Window.partitionBy("doc_id").orderBy("k")
    own = F.when(F.col("anchor").isNull(), F.col("k"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a block after floats belongs where its anchor does
    rows = rows.withColumn("stand", F.last(own, ignorenulls=True).over(upto))
    run = F.last(F.when(F.col("anchor"), F.col("stand")), ignorenulls=True).over(upto)
    return rows.withColumn("head", F.when(F.col("anchor").isNull(), F.col("k")).when(F.col("anchor"), F.col("stand")).otherwise(run))


def join_page_breaks(lines: DataFrame, profile: Profile = CJK_PROFILE) -> DataFrame:
    """doc_id, pos, md with the blocks of each paragraph as one (lines: doc_id, pos, md)."""
    parts = _parts(lines, profile)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "bare"))), lambda x: x["bare"]), "")
    blocks = parts.groupBy("doc_id", "head").agg(F.when(F.count("*") > 1, whole).otherwise(F.min("md")).alias("md"))
    return blocks.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("head")).cast("long").alias("pos"), "md")


def page_joins(lines: DataFrame, profile: Profile = CJK_PROFILE, shown: int = 26) -> DataFrame:
    """doc_id, pnum, before, after, floats of every join."""
    run = Window.partitionBy("doc_id", "head").orderBy("k")
    so_far = F.array_join(F.collect_list("bare").over(run.rowsBetween(Window.unboundedPreceding, -1)), "")
    parts = _parts(lines, profile).withColumns({"before": F.right(so_far, F.lit(shown)), "after": F.left(F.lead("bare").over(run), F.lit(shown))})
    return parts.where("anchor").select("doc_id", F.col("page").alias("pnum"), "before", "after", "floats")
