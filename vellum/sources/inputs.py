"""More inputs derived from plain documents by integer rules: parser JSON, block lists, file listings, media, marked-up Markdown.

Like those of derived.py they stand in for files, and are stated in SQL too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources import layout
from vellum.sources.derived import lines_of

_SUB = "array<struct<type:string,text:string,html:string>>"


def _some(condition: str, value: Column) -> Column:
    return F.when(F.expr(condition), value).otherwise("")


def media(documents: DataFrame) -> DataFrame:
    """A figure or table for the second line of each page, with captions, html, images and feet by turns."""
    lines = lines_of(documents).where("idx = 1").withColumn("word", F.left(F.regexp_replace("line", "[^A-Za-z]", ""), F.lit(20)))
    kind = F.when(F.col("page_idx") % 2 == 0, "image").otherwise("table")
    none = F.lit("")
    inner = F.struct(F.concat(kind, F.lit("_body")).alias("type"), F.col("word").alias("text"), _some("line_no % 3 = 0", F.concat(F.lit("<table><b>"), "word", F.lit("</table>"))).alias("html"))
    caption = F.struct(F.concat(kind, F.lit("_caption")).alias("type"), _some("doc_id % 2 = 0", F.col("word")).alias("text"), none.alias("html"))
    foot = F.struct(F.concat(kind, F.lit("_footnote")).alias("type"), _some("line_no % 4 = 0", F.col("word")).alias("text"), none.alias("html"))
    image = F.concat(F.lit("far/off/p"), F.col("line_no").cast("string"), F.lit(".jpg"))
    images = F.when(F.col("line_no") % 2 == 0, F.array(image)).otherwise(F.array().cast("array<string>"))
    own = _some("line_no % 7 = 0", F.concat(F.lit("<table>"), "word", F.lit("</table>")))
    return lines.select("doc_id", "page_idx", kind.alias("type"), own.alias("html"), F.array(foot, inner, caption).cast(_SUB).alias("sub"), images.alias("images"))


def layouts(documents: DataFrame) -> DataFrame:
    """doc_id and pdf_info, read back from JSON text as a parser writes it: body blocks of two printed lines, notes with a text of their own.

    Pages without lines stay in place with empty lists."""
    lines = lines_of(documents)
    span = lambda text: F.struct(F.array(F.struct(text.alias("content"), F.lit(0.95).alias("score"))).alias("spans"))
    tagged = F.concat(F.lit(" <sub>"), F.left("line", F.lit(20)), F.lit("</sub>"))
    block = F.struct(
        F.lit("text").alias("type"),
        F.col("idx").alias("index"),
        F.array(F.lit(1.0) + F.col("idx"), F.lit(2.0), F.lit(300.0), F.lit(9.0)).alias("bbox"),
        F.array(span(tagged), span(F.substring("line", F.lit(21), F.length("line")))).alias("lines"),
    )
    note = F.struct(F.lit("page_footnote").alias("type"), F.concat(F.lit("n "), F.left("line", F.lit(10)), F.lit("<sup>1</sup>")).alias("text"))
    pages = lines.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", block.alias("b")))).alias("body"), F.array_sort(F.collect_list(F.when(F.col("has_m"), F.struct("line_no", note.alias("b"))))).alias("notes"))
    page = F.struct(F.transform("body", lambda x: x["b"]).alias("preproc_blocks"), F.transform("notes", lambda x: x["b"]).alias("discarded_blocks"))
    whole = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_idx", page.alias("p")))).alias("at"), F.max("page_idx").alias("last"))
    info = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: F.try_element_at("at", k))
    text = F.to_json(F.struct(info.alias("pdf_info")))
    return whole.select("doc_id", F.from_json(text, layout.LAYOUT).alias("j")).select("doc_id", "j.pdf_info")


def block_lists(documents: DataFrame) -> DataFrame:
    """doc_id, pdfData, mergeConnections: on some pages all blocks are one connection, with a position that no block has at its end."""
    lines = lines_of(documents)
    position = F.concat_ws("-", F.col("page_idx").cast("string"), F.col("idx").cast("string"))
    # blocks stand in reverse order, so places say nothing
    row = F.struct((-F.col("idx")).alias("k"), F.struct(position.alias("block_position"), F.col("idx").alias("index"), F.col("line").alias("text")).alias("b"))
    pages = lines.groupBy("doc_id", "page_idx").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["b"]).alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("idx", position.alias("p")))), lambda x: x["p"]).alias("blocks"))
    conn = F.when(F.expr("(doc_id + page_idx) % 3 = 0"), F.struct("page_idx", F.struct(F.concat("blocks", F.array(F.lit("none-9"))).alias("blocks"), F.lit("text").alias("type")).alias("c")))
    whole = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_idx", "page"))).alias("at"), F.max("page_idx").alias("last"), F.transform(F.array_sort(F.collect_list(conn)), lambda x: x["c"]).alias("mergeConnections"))
    data = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: F.try_element_at("at", k))
    return whole.select("doc_id", data.alias("pdfData"), "mergeConnections")


#: Path of a listed file and the rule by which a document has it.
_LISTED = (
    ("layout.json", "doc_id % 2 = 0"),
    ("a_middle.json", "doc_id % 3 = 0"),
    ("result/b_middle.json", "true"),
    ("result/layout.json", "doc_id % 5 = 0"),
    ("images/x.jpg", "doc_id % 4 = 0"),
    ("out/images/y.jpg", "true"),
    ("full.md", "doc_id % 7 = 0"),
)


def listings(documents: DataFrame) -> DataFrame:
    """A listing of files as layout.list_files gives it."""
    entries = F.array(*[F.when(F.expr(rule), F.lit(path)) for path, rule in _LISTED])
    rows = documents.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.array_compact(entries)).alias("path"))
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.col("doc"))
    return rows.select("doc", "path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), folder.alias("folder"), F.length("path").cast("long").alias("size"))


def marked_up(markdown: DataFrame) -> DataFrame:
    """Finished Markdown with a callout of our own, a picture and bold words before each chapter."""
    return markdown.withColumn("text", F.replace("text", F.lit("# C"), F.lit("> [!note] AI 校注 x\n> our remark\n\n![p](images/a.png) **bold**\n\n# C")))


def with_code(markdown: DataFrame) -> DataFrame:
    """Finished Markdown whose every tag also stands in code."""
    return markdown.withColumn("text", F.replace("text", F.lit("<sub>x</sub>"), F.lit("`<sub>`<sub>x</sub>\n```\n<sup>y</sup>\n```\n")))


def illustrated(documents: DataFrame) -> DataFrame:
    """Texts in which each word that ends a sentence is a picture."""
    return documents.withColumn("text", F.regexp_replace("text", r"([A-Za-z]+)\.", "![x](images/$1.png)"))


def lost_notes(documents: DataFrame) -> DataFrame:
    """A note "page:circled:text" for each document, some of them malformed or on pages that do not exist."""
    spec = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(":"), F.when(F.col("doc_id") % 6 == 5, "x").otherwise((F.col("doc_id") % 20 + 1).cast("string")), F.lit(": lost: "), F.col("doc_id").cast("string"))
    return documents.select("doc_id", spec.alias("spec"))
