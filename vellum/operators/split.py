"""A book into self-contained chapters: notes renumbered, frontmatter inherited, an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.profile import NOTES_HEADING

_NOTES = rf"(?U)\n+---\n+#+\s*{NOTES_HEADING}\s*\n+"
_NOTE = r"(?sU)^\[\^(\d+)\]:\s*(?:<!--p\.(-?\d+)-->)?\s*(.*)$"


def parse(books: DataFrame) -> DataFrame:
    """doc_id, head, body, notes of whole Markdown (doc_id, text)."""
    parts = F.split(tx.without_frontmatter(F.col("text")), _NOTES, 2)
    return books.select("doc_id", F.coalesce(tx.frontmatter(F.col("text")), F.lit("")).alias("head"), tx.strip(F.get(parts, F.lit(0))).alias("body"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("notes"))


def blocks(parsed: DataFrame) -> DataFrame:
    cut = parsed.select("doc_id", F.posexplode(F.split("body", "\n\n")).alias("pos", "md"))
    return cut.select("doc_id", F.col("pos").cast("long").alias("pos"), "md")


def note_table(parsed: DataFrame) -> DataFrame:
    """doc_id, n, pnum, note; of a number that is defined twice the last counts. Chunks of another shape have null n."""
    chunks = parsed.select("doc_id", F.posexplode(F.split(tx.strip(F.col("notes")), "\n\n")).alias("pos", "chunk"))
    chunks = chunks.withColumn("chunk", tx.strip(F.col("chunk"))).where("chunk <> ''")
    part = lambda k: F.nullif(F.regexp_extract("chunk", _NOTE, k), F.lit(""))
    rows = chunks.select("doc_id", "pos", part(1).cast("long").alias("n"), part(2).alias("pnum"), tx.strip(F.coalesce(part(3), F.lit(""))).alias("note"), "chunk")
    last = Window.partitionBy("doc_id", F.coalesce("n", -1 - F.col("pos"))).orderBy(F.desc("pos"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "pos")


def faults(parsed: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, fault, detail: what keeps a book from being split."""
    mark = "#" * level + " "
    no_start = parsed.where(~F.col("body").startswith(mark)).select("doc_id", F.lit("no_chapter_start").alias("fault"), F.left("body", F.lit(80)).alias("detail"))
    bad = note_table(parsed).where("n is null").select("doc_id", F.lit("bad_note").alias("fault"), F.left("chunk", F.lit(80)).alias("detail"))
    gone = chapter_notes(parsed, level).where("missing").groupBy("doc_id", "chapter").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("new", "n"))), 1, 8), lambda x: x["n"].cast("string")), ",").alias("detail"))
    return no_start.unionByName(bad).unionByName(gone.select("doc_id", F.lit("undefined_note").alias("fault"), "detail"))


def chapter_blocks(parsed: DataFrame, level: int = 1, start_page: str | None = None) -> DataFrame:
    """doc_id, chapter, pos, md, page_before (last anchor before the block), page (with the block's own anchors)."""
    mark = "#" * level + " "
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = F.element_at(F.regexp_extract_all("md", F.lit(r"<!--p\.(-?\d+)-->"), F.lit(1)), -1)
    found = F.size(F.regexp_extract_all("md", F.lit(r"<!--p\.(-?\d+)-->"), F.lit(1))) > 0
    rows = blocks(parsed).withColumns({"chapter": F.sum(F.col("md").startswith(mark).cast("long")).over(upto), "_own": F.when(found, own)})
    page = F.coalesce(F.last("_own", True).over(upto), F.lit(start_page))
    before = F.coalesce(F.last("_own", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start_page))
    return rows.select("doc_id", "chapter", "pos", "md", before.alias("page_before"), page.alias("page")).where("chapter > 0")


def chapters(parsed: DataFrame, level: int = 1, start_page: str | None = None) -> DataFrame:
    """doc_id, chapter, title, start_page, end_page, pages."""
    rows = chapter_blocks(parsed, level, start_page).groupBy("doc_id", "chapter").agg(F.min_by("md", "pos").alias("first"), F.min_by("page_before", "pos").alias("start_page"), F.max_by("page", "pos").alias("end_page"))
    return rows.select("doc_id", "chapter", tx.strip(F.substring("first", F.lit(level + 2), F.length("first"))).alias("title"), "start_page", "end_page", F.concat_ws("-", "start_page", "end_page").alias("pages"))


def chapter_notes(parsed: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, chapter, n, new, pnum, note, missing: numbers of a chapter in order of first use."""
    used = chapter_blocks(parsed, level).select("doc_id", "chapter", "pos", F.posexplode(F.regexp_extract_all("md", F.lit(r"\[\^(\d+)\]"), F.lit(1))).alias("k", "n"))
    first = used.groupBy("doc_id", "chapter", F.col("n").cast("long").alias("n")).agg(F.min(F.struct("pos", "k")).alias("at"))
    new = F.row_number().over(Window.partitionBy("doc_id", "chapter").orderBy("at"))
    notes = note_table(parsed).where("n is not null").select("doc_id", "n", "pnum", "note", F.lit(True).alias("_there"))
    return first.withColumn("new", new.cast("long")).join(notes, ["doc_id", "n"], "left").select("doc_id", "chapter", "n", "new", "pnum", "note", F.col("_there").isNull().alias("missing"))


def _renumbered(parsed: DataFrame, level: int) -> DataFrame:
    """doc_id, chapter, text with the chapter's own note numbers."""
    cut = chapter_blocks(parsed, level).select("doc_id", "chapter", "pos", F.posexplode(F.split("md", r"(?=\[\^\d+\])")).alias("k", "piece"))
    n = F.nullif(F.regexp_extract("piece", r"^\[\^(\d+)\]", 1), F.lit("")).cast("long")
    joined = cut.withColumn("n", n).join(chapter_notes(parsed, level).select("doc_id", "chapter", "n", "new"), ["doc_id", "chapter", "n"], "left")
    piece = F.when(F.col("new").isNotNull(), F.concat(F.lit("[^"), F.col("new").cast("string"), F.lit("]"), F.regexp_replace("piece", r"^\[\^\d+\]", ""))).otherwise(F.col("piece"))
    by_block = joined.groupBy("doc_id", "chapter", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("t")))), lambda x: x["t"]), "").alias("md"))
    return by_block.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n").alias("text"))


def _fields(extra: dict[str, str] | None) -> Column:
    return F.lit("".join(f"{k}: {v}\n" for k, v in (extra or {}).items()))


def chapter_files(parsed: DataFrame, level: int = 1, start_page: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id, chapter, title, file, pages, n_notes, text of every chapter's file."""
    notes = chapter_notes(parsed, level)
    page = F.when(F.col("pnum").isNotNull(), F.concat(F.lit("<!--p."), F.col("pnum"), F.lit("--> "))).otherwise("")
    line = F.concat(F.lit("[^"), F.col("new").cast("string"), F.lit("]: "), page, F.coalesce("note", F.lit("")))
    tails = notes.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_notes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("notes"))
    rows = chapters(parsed, level, start_page).join(_renumbered(parsed, level), ["doc_id", "chapter"]).join(tails, ["doc_id", "chapter"], "left").join(parsed.select("doc_id", "head"), "doc_id")
    inherited = F.array_join(F.filter(F.split("head", "\n"), lambda x: (tx.strip(x) != "") & ~x.rlike(r"(?U)^title\s*:")), "\n")
    head = F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\n"), F.when(inherited != "", F.concat(inherited, F.lit("\n"))).otherwise(""), _fields(extra), F.when(F.col("pages") != "", F.concat(F.lit("pages: "), F.col("pages"), F.lit("\n"))).otherwise(""), F.lit("---\n\n"))
    tail = F.when(F.col("notes").isNotNull(), F.concat(F.lit(f"\n\n---\n\n## {NOTES_HEADING}\n\n"), F.col("notes"))).otherwise("")
    # at least two digits, more where there are more chapters
    number = F.when(F.col("chapter") < 10, F.concat(F.lit("0"), F.col("chapter").cast("string"))).otherwise(F.col("chapter").cast("string"))
    name = F.concat(number, F.lit("-"), tx.safe_name(F.col("title")), F.lit(".md"))
    return rows.select("doc_id", "chapter", "title", name.alias("file"), "pages", F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), F.concat(tx.strip_right(F.concat(head, F.col("text"), tail)), F.lit("\n")).alias("text"))


def index(files: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text: a table of a book's chapters with file, pages and notes."""
    book = (extra or {}).get("book")
    row = F.concat(F.lit("| "), F.col("title"), F.lit(" | [["), F.regexp_replace("file", r"\.md$", ""), F.lit("]] | "), F.when(F.col("pages") == "", "—").otherwise(F.col("pages")), F.lit(" | "), F.col("n_notes").cast("string"), F.lit(" |"))
    rows = files.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"), F.count("*").alias("n"), F.sum("n_notes").alias("notes"))
    title = F.lit(book) if book else F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\n"), _fields(extra), F.lit("---\n\n# "), title, F.lit("\n\n| 篇章 | 文件 | 印刷页 | 脚注 |\n|---|---|---|---|\n"))
    return rows.select("doc_id", F.concat(head, F.col("rows"), F.lit("\n\n共 "), F.col("n").cast("string"), F.lit(" 篇，"), F.col("notes").cast("string"), F.lit(" 条脚注。\n")).alias("text"))


def split_report(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, n_chapters, n_source, n_placed, n_unplaced: every note of the book should be in a chapter."""
    source = note_table(parsed).where("n is not null").groupBy("doc_id").agg(F.count("*").alias("n_source"))
    placed = files.groupBy("doc_id").agg(F.count("*").alias("n_chapters"), F.sum("n_notes").alias("n_placed"))
    joined = placed.join(source, "doc_id", "full").na.fill(0)
    return joined.select("doc_id", "n_chapters", "n_source", "n_placed", (F.col("n_source") - F.col("n_placed")).alias("n_unplaced"))
