"""Parser output as canonical tables.

A document is a folder. Blocks nest (figures and tables hold captions and
bodies), so the schema spells out three levels; it is never inferred, as an
always-empty array would change type from corpus to corpus.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as tx

_SPAN = T.StructType([T.StructField("content", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("image_path", T.StringType()), T.StructField("img_path", T.StringType())])
_LINE = T.StructType([T.StructField("spans", T.ArrayType(_SPAN))])
_FLAT = [
    T.StructField("type", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("level", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("table_body", T.StringType()),
    T.StructField("lines", T.ArrayType(_LINE)),
]
_LEAF = T.StructType(_FLAT)
_MIDDLE = T.StructType([*_FLAT, T.StructField("blocks", T.ArrayType(_LEAF))])
BLOCK = T.StructType([*_FLAT, T.StructField("blocks", T.ArrayType(_MIDDLE))])
PAGE = T.StructType([T.StructField("preproc_blocks", T.ArrayType(BLOCK)), T.StructField("discarded_blocks", T.ArrayType(BLOCK))])
LAYOUT = T.StructType([T.StructField("pdf_info", T.ArrayType(PAGE))])
BLOCK_LIST = T.StructType(
    [
        T.StructField("pdfData", T.ArrayType(T.ArrayType(T.StructType([T.StructField("block_position", T.StringType()), T.StructField("index", T.LongType()), T.StructField("text", T.StringType())])))),
        T.StructField("mergeConnections", T.ArrayType(T.StructType([T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("type", T.StringType())]))),
    ]
)

#: (kind, priority, pattern of the file name): what a document's folder may hold.
ARTIFACTS = (
    ("layout", 0, r"^layout\.json$"),
    ("layout", 1, r"_middle\.json$"),
    ("layout", 2, r"^middle\.json$"),
    ("block_list", 0, r"^block_list\.json$"),
    ("full_md", 0, r"^full\.md$"),
    ("full_md", 1, r"^[A-Za-z]+_markdown_.*\.md$"),
    ("content_list", 0, r"_content_list\.json$"),
    ("content_list_v2", 0, r"_content_list_v2\.json$"),
    ("model", 0, r"_model\.json$"),
    ("origin_pdf", 0, r"_origin\.pdf$"),
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """doc (folder under root), path, name, depth and size of every file under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    # the reader gives file:/a for file:///a, so schemes are left out on both sides
    base = "/" + re.sub(r"^[a-z]+:/*", "", root).strip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    inside = F.get(F.split(plain, rf"^\Q{base}\E", 2), F.lit(1))
    parts = F.split(inside, "/")
    return files.select(F.get(parts, F.lit(0)).alias("doc"), "path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 2).alias("depth"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("size"))


def artifacts(files: DataFrame) -> DataFrame:
    """doc, kind, path, size: of each kind the first by name rule, then in the folder itself, then below it, then by path.

    The images folder counts as an artefact; its path is that of its first file's folder."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority"), F.lit(r).alias("pattern")) for k, p, r in ARTIFACTS])
    matched = files.select("*", F.explode(kinds).alias("k")).where("name rlike k.pattern").select("doc", F.col("k.kind").alias("kind"), F.col("k.priority").alias("priority"), "depth", "path", "size")
    images = files.where("folder = 'images'").select("doc", F.lit("images").alias("kind"), F.lit(0).alias("priority"), (F.col("depth") - 1).alias("depth"), F.regexp_replace("path", "/[^/]*$", "").alias("path"), "size")
    order = Window.partitionBy("doc", "kind").orderBy("priority", F.col("depth") > 0, "path")
    return matched.unionByName(images).withColumn("n", F.row_number().over(order)).where("n = 1").select("doc", "kind", "path", "size")


def _line_texts(lines: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(lines, lambda l: F.array_join(F.transform(l["spans"], lambda s: F.coalesce(s["content"], F.lit(""))), "")), empty)


def _image_paths(lines: Column) -> Column:
    empty = F.array().cast("array<string>")
    path = lambda s: F.coalesce(F.nullif(s["image_path"], F.lit("")), F.nullif(s["img_path"], F.lit("")))
    found = F.flatten(F.transform(lines, lambda l: F.transform(l["spans"], path)))
    return F.coalesce(F.transform(F.filter(found, lambda p: p.isNotNull()), lambda p: F.ltrim(p, F.lit("/"))), empty)


def _deep(block: Column, of, depth: int) -> Column:
    """of(lines) of a block and of the blocks in it, in order."""
    own = of(block["lines"])
    if not depth:
        return own
    below = F.coalesce(F.flatten(F.transform(block["blocks"], lambda b: _deep(b, of, depth - 1))), F.array().cast("array<string>"))
    return F.concat(own, below)


def _subs(block: Column, depth: int) -> Column:
    """Blocks inside a block, in order: type, text, html."""

    def described(b: Column, left: int) -> Column:
        html = F.coalesce(F.nullif(b["html"], F.lit("")), b["table_body"], F.lit(""))
        own = F.array(F.struct(b["type"].alias("type"), tx.strip(tx.strip_tags(tx.join_lines(_deep(b, _line_texts, left)))).alias("text"), tx.strip(html).alias("html")))
        return F.concat(own, _subs(b, left)) if left else own

    kind = "array<struct<type:string,text:string,html:string>>"
    return F.coalesce(F.flatten(F.transform(block["blocks"], lambda b: described(b, depth - 1))), F.array().cast(kind))


def blocks_of(layouts: DataFrame) -> DataFrame:
    """The canonical blocks of layouts (doc_id, pdf_info).

    zone is body or discarded; ord is the place in the source; text has tags
    removed; lines counts the block's own lines; scores are of its own spans."""
    pages = layouts.select("doc_id", F.posexplode("pdf_info").alias("page_idx", "page"))
    zones = [pages.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.lit(zone).alias("zone"), F.posexplode(f"page.{field}").alias("ord", "b")) for zone, field in (("body", "preproc_blocks"), ("discarded", "discarded_blocks"))]
    b = F.col("b")
    none = F.array().cast("array<double>")
    scores = F.coalesce(F.filter(F.flatten(F.transform(b["lines"], lambda l: F.transform(l["spans"], lambda s: s["score"]))), lambda s: s.isNotNull()), none)
    lines = _deep(b, _line_texts, 2)
    return reduce(DataFrame.unionByName, zones).select(
        "doc_id",
        "page_idx",
        "zone",
        F.col("ord").cast("long").alias("ord"),
        F.coalesce(b["index"], F.lit(0)).alias("index"),
        b["type"].alias("type"),
        b["level"].alias("level"),
        F.get(b["bbox"], F.lit(0)).alias("x0"),
        F.get(b["bbox"], F.lit(2)).alias("x1"),
        F.coalesce(F.size(b["lines"]), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("zone") == "body", tx.strip(tx.strip_tags(tx.join_lines(lines)))).otherwise(tx.text_or_lines(b["text"], lines)).alias("text"),
        scores.alias("scores"),
        tx.strip(F.coalesce(F.nullif(b["html"], F.lit("")), b["table_body"], F.lit(""))).alias("html"),
        _subs(b, 2).alias("sub"),
        _deep(b, _image_paths, 2).alias("images"),
    )


def read_json_documents(spark: SparkSession, found: DataFrame, kind: str, schema: T.StructType, broken: str | None = None) -> DataFrame:
    """doc_id (the folder's name) and the fields of each document's artefact of a kind.

    The list of paths is one row for each document; Spark's reader needs it on
    the driver. broken names a field of the schema for the text of files that
    are no JSON; their other fields are null."""
    paths = [r["path"] for r in found.where(F.col("kind") == kind).select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.StringType()), *schema.fields]))
    reader = spark.read.schema(schema).option("multiLine", True)
    if broken:
        reader = reader.option("columnNameOfCorruptRecord", broken)
    rows = reader.json(paths).withColumn("path", F.col("_metadata.file_path"))
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*", "/")
    named = found.where(F.col("kind") == kind).select(F.col("doc").alias("doc_id"), plain(F.col("path")).alias("key"))
    return rows.withColumn("key", plain(F.col("path"))).join(named, "key").select("doc_id", *schema.fieldNames())


def broken_documents(spark: SparkSession, found: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """doc_id and path of artefacts that are no JSON; read_json_documents gives these null fields."""
    whole = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = read_json_documents(spark, found, kind, whole, broken="_broken").where(F.col("_broken").isNotNull() & F.col(schema.fieldNames()[0]).isNull()).select(F.col("doc_id").alias("doc"))
    return found.where(F.col("kind") == kind).join(rows, "doc", "left_semi").select(F.col("doc").alias("doc_id"), "path")


def documents_without(found: DataFrame, kind: str = "layout") -> DataFrame:
    """Documents that lack an artefact; without a layout nothing can be built."""
    return found.select("doc").distinct().join(found.where(F.col("kind") == kind).select("doc"), "doc", "left_anti")


def block_positions(lists: DataFrame) -> DataFrame:
    """doc_id, position, page_idx, index of block lists (doc_id, pdfData, mergeConnections)."""
    pages = lists.select("doc_id", F.posexplode("pdfData").alias("page_idx", "page"))
    rows = pages.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.posexplode("page").alias("ord", "b"))
    rows = rows.where("b.block_position is not null")
    # of a position that is given twice the last counts
    order = Window.partitionBy("doc_id", "position").orderBy(F.desc("page_idx"), F.desc("ord"))
    return rows.select("doc_id", F.col("b.block_position").alias("position"), "page_idx", F.col("b.index").alias("index"), "ord").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "ord")


def merge_connections(lists: DataFrame) -> DataFrame:
    """doc_id, conn, ord, position."""
    conns = lists.select("doc_id", F.posexplode("mergeConnections").alias("conn", "c"))
    return conns.select("doc_id", F.col("conn").cast("long").alias("conn"), F.posexplode("c.blocks").alias("ord", "position"))


def read_parts(spark: SparkSession, spec: str) -> DataFrame:
    """part (from 0), path and text of a comma list of files and globs; the files of a glob in order of their paths."""
    listed = [p.strip() for p in spec.split(",") if p.strip()]
    rows = reduce(DataFrame.unionByName, [read_markdown(spark, [p]).withColumn("_at", F.lit(k)) for k, p in enumerate(listed)])
    # as many rows as files are named
    order = Window.orderBy("_at", "path")
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("part"), "path", "text")


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and text of whole files; missing patterns are an error of the reader."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
