"""Every substantive change between a source and its product, character by character."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.audit import page_texts
from vellum.operators.pages import footnote_blocks

_LABELS = {"replace": "改", "insert": "增", "delete": "删"}


def source_sections(blocks: DataFrame) -> DataFrame:
    """doc_id, section (body or notes), text: all body text; notes without journal data and without their first mark."""
    pages = page_texts(blocks)
    whole = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]), "")
    body = pages.groupBy("doc_id").agg(whole(F.struct("page_idx", F.col("text").alias("t"))).alias("text")).withColumn("section", F.lit("body"))
    kept = footnote_blocks(blocks).where((F.col("text") != "") & ~tx.is_meta(F.col("text")))
    bare = F.regexp_replace("text", "^[①-⑳]", "")
    notes = kept.groupBy("doc_id").agg(whole(F.struct("page_idx", "ord", bare.alias("t"))).alias("text")).withColumn("section", F.lit("notes"))
    return body.unionByName(notes).select("doc_id", "section", "text")


def product_sections(docs: DataFrame) -> DataFrame:
    """The same of finished Markdown (doc_id, text): without head, our own remarks, comments and markup."""
    body, notes = tx.body_and_notes(tx.without_frontmatter(F.col("text")))
    own = r"(?:AI\s*校注)"
    clean = lambda c: tx.plain_markdown(tx.without_callouts(c, own))
    parts = F.array(F.struct(F.lit("body").alias("section"), clean(body).alias("text")), F.struct(F.lit("notes").alias("section"), clean(notes).alias("text")))
    return docs.select("doc_id", F.explode(parts).alias("s")).select("doc_id", "s.section", "s.text")


def concatenated(parts: DataFrame, separator: str = "") -> DataFrame:
    """One document of several files or folders (doc_id, part, section, text), in order of part."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("doc_id", "section").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(separator), x["text"])), "").alias("text"))


def operations(before: str, after: str) -> list[tuple[str, int, int, int, int]]:
    """Edits between two strings of kept characters, without equal stretches."""
    return [op for op in SequenceMatcher(None, before, after, autojunk=False).get_opcodes() if op[0] != "equal"]


def changes(source: DataFrame, product: DataFrame, around: int = 22) -> DataFrame:
    """doc_id, section, seq, tag, before, after, left, right.

    Sections are aligned one by one: the alignment's time grows with the square
    of a section at worst, so long books come by chapter. Deleted note marks are
    no change. A section that one side lacks is compared with nothing."""
    pairs = source.select("doc_id", "section", tx.significant(F.col("text")).alias("a")).join(product.select("doc_id", "section", tx.significant(F.col("text")).alias("b")), ["doc_id", "section"], "full")
    pairs = pairs.select("doc_id", "section", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).where("a <> b")

    @F.pandas_udf("array<struct<tag:string,i1:bigint,i2:bigint,j1:bigint,j2:bigint>>")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        fields = ("tag", "i1", "i2", "j1", "j2")
        return pd.Series([[dict(zip(fields, op, strict=True)) for op in operations(x, y)] for x, y in zip(a, b, strict=True)])

    found = pairs.withColumn("ops", edits("a", "b")).select("doc_id", "section", "a", "b", F.posexplode("ops").alias("seq", "op"))
    piece = lambda c, lo, hi: F.substring(c, (lo + 1).cast("int"), (hi - lo).cast("int"))
    i1, i2 = F.col("op.i1"), F.col("op.i2")
    rows = found.select(
        "doc_id",
        "section",
        F.col("seq").cast("long").alias("seq"),
        F.col("op.tag").alias("tag"),
        piece("a", i1, i2).alias("before"),
        piece("b", F.col("op.j1"), F.col("op.j2")).alias("after"),
        piece("a", F.greatest(i1 - around, F.lit(0)), i1).alias("left"),
        piece("a", i2, i2 + around).alias("right"),
    )
    return rows.where(~((F.col("tag") == "delete") & F.col("before").rlike("^[①-⑳]+$")))


def moved(changed: DataFrame, source: DataFrame, product: DataFrame) -> DataFrame:
    """doc_id, section, n_changes, n_moved: how many pieces still stand on the other side."""
    key = ["doc_id", "section"]
    joined = changed.join(source.select(*key, F.col("text").alias("s")), key, "left").join(product.select(*key, F.col("text").alias("p")), key, "left")
    there = ((F.col("before") != "") & F.coalesce(F.contains("p", F.col("before")), F.lit(False))).cast("long")
    back = ((F.col("after") != "") & F.coalesce(F.contains("s", F.col("after")), F.lit(False))).cast("long")
    return joined.groupBy(*key).agg(F.count("*").alias("n_changes"), F.sum(there + back).alias("n_moved"))


def label(tag: Column) -> Column:
    out = tag
    for name, shown in _LABELS.items():
        out = F.when(tag == name, shown).otherwise(out)
    return out


def report_rows(changed: DataFrame, most: int = 160) -> DataFrame:
    """Changes as the report shows them: labels, long pieces cut in the middle."""
    return changed.select("doc_id", "section", "seq", label(F.col("tag")).alias("label"), tx.cut(F.col("before"), most).alias("before"), tx.cut(F.col("after"), most).alias("after"), "left", tx.cut(F.col("before"), 60).alias("shown"), "right")
