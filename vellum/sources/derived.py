"""Layout tables made from plain documents by integer rules, for tests and registered queries.

There is no parser output in the test tables; these views give every operator
input of all its cases, and are stated in SQL for the other engine too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import mark_of


def lines_of(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    rows = rows.withColumns({"line_no": F.col("line_no").cast("long"), "page_idx": F.expr("cast(line_no div 5 as bigint)"), "idx": F.expr("cast(line_no % 5 as bigint)"), "has_m": F.expr("(doc_id + line_no) % 3 <> 0")})
    page = Window.partitionBy("doc_id", "page_idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rk", F.sum(F.col("has_m").cast("long")).over(page))


def pages(documents: DataFrame) -> DataFrame:
    return lines_of(documents).select("doc_id", "page_idx").distinct()


def blocks(documents: DataFrame) -> DataFrame:
    """The canonical blocks: body, page_footnote and page_number."""
    lines = lines_of(documents)
    title = (F.col("idx") == 0) & (F.col("page_idx") % 2 == 0)
    shape = F.expr("(page_idx div 2) % 3")
    prefix = F.when(title, F.when(shape == 0, "第一章 ").when(shape == 1, "一、").otherwise("1. ")).otherwise("")
    enumeration = F.when(F.expr("(doc_id + line_no) % 13 = 0"), "A：①b；②c；③d。").otherwise("")
    mark = F.when(F.col("has_m"), mark_of(F.col("rk") - 1)).otherwise("")
    none = F.lit(None)
    shared = [F.lit("").alias("html"), F.array().cast("array<struct<type:string,text:string,html:string>>").alias("sub"), F.array().cast("array<string>").alias("images")]
    body = lines.select(
        "doc_id",
        "page_idx",
        F.lit("body").alias("zone"),
        F.col("idx").alias("ord"),
        F.col("idx").alias("index"),
        F.when(title, "title").otherwise("text").alias("type"),
        F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1 + F.col("page_idx") % 3).cast("long").alias("level"),
        F.when(F.expr("(line_no * 7 + doc_id) % 4 = 0"), 77.5).otherwise(65.0).alias("x0"),
        F.when(F.expr("(doc_id + line_no * 3) % 5 = 0"), 507.5).otherwise(520.0).alias("x1"),
        F.expr("1 + (doc_id + line_no) % 3").alias("n_lines"),
        F.concat(prefix, enumeration, F.col("line"), mark).alias("text"),
        F.array(F.expr("1.0D - ((doc_id * 13 + line_no) % 25) / 100.0D")).alias("scores"),
        *shared,
    )
    k = F.expr("(doc_id * 7 + line_no) % 11")
    note = (
        F.when(k == 1, F.left("line", F.lit(40)))
        .when(k == 2, F.concat(F.lit("收稿日期："), F.left("line", F.lit(20))))
        .when(k == 3, F.concat(F.lit("2. "), F.left("line", F.lit(40))))
        .when(k == 4, F.concat(mark_of(F.col("rk") - 1), mark_of(F.col("rk")), F.left("line", F.lit(40))))
        .otherwise(F.concat(mark_of(F.col("rk") - 1), F.left("line", F.lit(40))))
    )
    bare = [none.cast("bigint").alias("level"), none.cast("double").alias("x0"), none.cast("double").alias("x1"), F.lit(1).cast("long").alias("n_lines")]
    no_scores = F.array().cast("array<double>").alias("scores")
    notes = lines.where("has_m").where(k != 0).select("doc_id", "page_idx", F.lit("discarded").alias("zone"), F.col("idx").alias("ord"), F.col("idx").alias("index"), F.lit("page_footnote").alias("type"), *bare, note.alias("text"), no_scores, *shared)
    value = F.expr("page_idx + 1 + doc_id % 7 - 3")
    numbered = lines.select("doc_id", "page_idx").distinct().where(F.expr("(doc_id + page_idx) % 4 <> 0") & (value > 0))
    numbers = numbered.select("doc_id", "page_idx", F.lit("discarded").alias("zone"), F.lit(9).cast("long").alias("ord"), F.lit(0).cast("long").alias("index"), F.lit("page_number").alias("type"), *bare, F.concat(F.lit("- "), value.cast("string"), F.lit(" -")).alias("text"), no_scores, *shared)
    return body.unionByName(notes).unionByName(numbers)


def edges(documents: DataFrame) -> DataFrame:
    lines = lines_of(documents)
    ends = lines.groupBy("doc_id", "page_idx").agg(F.max("idx").alias("last"), F.min("idx").alias("first"))
    after = ends.select("doc_id", (F.col("page_idx") - 1).alias("page_idx"), F.col("first").alias("dst_index"))
    across = ends.join(after, ["doc_id", "page_idx"]).where(F.expr("(doc_id + page_idx) % 5 in (0, 1)"))
    across = across.select("doc_id", F.col("page_idx").alias("src_page"), F.col("last").alias("src_index"), (F.col("page_idx") + 1).alias("dst_page"), "dst_index")
    both = lines.groupBy("doc_id", "page_idx").agg(F.count_if(F.col("idx") == 0).alias("zero"), F.count_if(F.col("idx") == 1).alias("one"), F.max("idx").alias("last"))
    same = both.where("(doc_id + page_idx) % 17 = 0 and zero > 0 and one > 0 and last <> 0")
    same = same.select("doc_id", F.col("page_idx").alias("src_page"), F.lit(0).cast("long").alias("src_index"), F.col("page_idx").alias("dst_page"), F.lit(1).cast("long").alias("dst_index"))
    return across.unionByName(same)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def markdown(documents: DataFrame) -> DataFrame:
    """doc_id, text: finished Markdown with chapters, anchors, references and notes, some of them wrong on purpose."""
    lines = lines_of(documents)
    page = Window.partitionBy("doc_id", "page_idx").orderBy("line_no")
    lines = lines.withColumn("_first", F.row_number().over(page) == 1)
    number = F.expr("page_idx + 1 - if((doc_id + page_idx) % 7 = 0, 1, 0)").cast("string")
    chapter = F.when(F.col("_first") & ((F.col("page_idx") % 2 == 0) | (F.col("page_idx") == 0)), F.concat(F.lit("# C"), F.col("page_idx").cast("string"), F.lit("\n\n"))).otherwise("")
    anchor = F.when(F.col("_first"), F.concat(F.lit("<!--p."), number, F.lit("-->\n\n"))).otherwise("")
    plain = F.left(F.regexp_replace("line", "[^A-Za-z ]", ""), F.lit(40))
    reference = F.when(F.col("has_m"), F.concat(F.lit("[^"), F.expr("line_no + 1 - if(line_no % 9 = 8, 1, 0)").cast("string"), F.lit("]"))).otherwise("")
    tag = F.when(F.expr("(doc_id + line_no) % 11 = 0"), "<sub>x</sub>").when(F.expr("(doc_id + line_no) % 23 = 0"), "<!--?quote-->").otherwise("")
    note = F.when(F.expr("has_m and (doc_id + line_no) % 10 <> 0"), F.concat(F.lit("[^"), F.expr("line_no + 1").cast("string"), F.lit("]: <!--p."), number, F.lit("--> note "), F.col("line_no").cast("string")))
    rows = lines.select("doc_id", "line_no", F.concat(chapter, anchor, F.lit("x"), plain, tag, reference).alias("md"), note.alias("note"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))), lambda x: x[c]), "\n\n")
    texts = rows.groupBy("doc_id").agg(join("md").alias("body"), join("note").alias("notes"))
    first = F.expr("min(page_idx)")
    starts = lines.groupBy("doc_id").agg(first.alias("page"))
    own = F.when(F.expr("doc_id % 3 = 0"), "标签: x\n").otherwise("")
    head = F.when(F.expr("doc_id % 4 <> 0"), F.concat(F.lit("---\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\n"), own, F.lit("---\n"))).otherwise("")
    opening = F.when(F.col("page") % 2 == 1, "# C\n\n").otherwise("")
    return texts.join(starts, "doc_id").select("doc_id", F.concat(head, opening, F.col("body"), F.lit("\n\n---\n\n## 注释\n\n"), F.col("notes")).alias("text"))
