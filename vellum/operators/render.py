"""From blocks to footnoted Markdown with page anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.pages import body, margins
from vellum.profile import CIRCLED_CLASS, HEADINGS, NOTES_HEADING


def merge_free(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Body blocks that no connection appends to another."""
    targets = edges.select("doc_id", F.col("dst_page").alias("page_idx"), F.col("dst_index").alias("index")).distinct()
    return body(blocks).join(targets, ["doc_id", "page_idx", "index"], "left_anti")


def _pattern(title: Column) -> Column:
    """Number of the first heading shape that a title has, from 0; null if none."""
    found = F.lit(None).cast("int")
    for k in range(len(HEADINGS) - 1, -1, -1):
        found = F.when(title.rlike(HEADINGS[k]), k).otherwise(found)
    return found


def heading_levels(blocks: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, page_idx, index, ord, level of every title, 1 to 6.

    Where all of a document's titles (more than a few) have one level, the
    shapes that occur rank from level 2 on; else, and for titles of no shape,
    the source's level holds."""
    doc = Window.partitionBy("doc_id")
    titles = body(blocks).where("type = 'title'").withColumns({"_shape": _pattern(F.regexp_replace("text", r"(?U)^#+\s*", "")), "_own_shape": _pattern(F.col("text"))})
    levels = F.size(F.collect_set(F.coalesce("level", F.lit(-1))).over(doc))
    titles = titles.withColumns({"_flat": (levels <= 1) & (F.count("*").over(doc) > least), "_shapes": F.array_sort(F.collect_set("_own_shape").over(doc))})
    rank = F.array_position("_shapes", F.col("_shape")).cast("long")
    own = F.least(F.greatest(F.coalesce(F.nullif("level", F.lit(0)), F.lit(2)), F.lit(1)), F.lit(6))
    level = F.when(F.col("_flat") & F.col("_shape").isNotNull() & (rank > 0), F.least(rank + 1, F.lit(6))).otherwise(own)
    return titles.select("doc_id", "page_idx", "index", "ord", level.cast("long").alias("level"))


def indents(blocks: DataFrame, quote_indent: float = 10.0) -> DataFrame:
    """Blocks of several lines that are set in: quote, or center if both margins are about equal."""
    key = ["doc_id", "page_idx"]
    placed = body(blocks).where("n_lines >= 2 and type not in ('image', 'table', 'title') and text <> ''").join(margins(blocks), key)
    left, right = F.col("x0") - F.col("left"), F.col("right") - F.col("x1")
    kind = F.when((F.abs(left - right) < 12) & (F.col("n_lines") <= 2), "center").otherwise("quote")
    found = placed.where(left > quote_indent)
    return found.select(*key, "index", "ord", kind.alias("kind"), F.bround(left).cast("long").alias("left_indent"), F.bround(right).cast("long").alias("right_indent"))


def media_markdown(has_images: bool = True) -> tuple[Column, Column, Column]:
    """(text before, html and images, text after) of figures and tables; marks in captions still stand."""
    sub = F.col("sub")
    texts = lambda *kinds: F.transform(F.filter(sub, lambda s: s["type"].isin(*kinds) & (s["text"] != "")), lambda s: s["text"])
    captions = F.transform(texts("image_caption", "table_caption"), lambda t: F.concat(F.lit("*"), t, F.lit("*")))
    feet = F.transform(texts("image_footnote", "table_footnote"), lambda t: F.concat(F.lit("<small>"), t, F.lit("</small>")))
    below = F.get(F.transform(F.filter(sub, lambda s: s["type"].isin("table_body", "image_body") & (s["html"] != "")), lambda s: s["html"]), F.lit(0))
    html = F.coalesce(F.nullif("html", F.lit("")), below)
    if has_images:
        images = F.transform("images", lambda p: F.concat(F.lit("![](images/"), F.substring_index(p, "/", -1), F.lit(")")))
    else:
        images = F.transform("images", lambda p: F.concat(F.lit("![]("), p, F.lit(")")))
    inner = tx.strip(F.array_join(F.transform(F.filter(sub, lambda s: s["type"].isin("table_body", "image_body")), lambda s: s["text"]), " "))
    shown = F.when(html.isNull() & (F.size("images") == 0), F.array(inner)).otherwise(F.array().cast("array<string>"))
    middle = F.concat(F.array(F.coalesce(html, F.lit(""))), images)
    join = lambda a: F.array_join(F.filter(a, lambda x: x != ""), "\n\n")
    return join(captions), join(middle), join(F.concat(shown, feet))


def render_order(blocks: DataFrame, edges: DataFrame, walked: DataFrame) -> DataFrame:
    """Blocks in rendering order: by head page, head place, and depth in the chain."""
    free = merge_free(blocks, edges)
    heads = free.select("*", F.col("page_idx").alias("head_page"), F.col("index").alias("head_index"), F.col("ord").alias("head_ord"), F.lit(0).cast("long").alias("depth"))
    first = Window.partitionBy("doc_id", "page_idx", "index").orderBy("ord")
    by_place = body(blocks).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    head_ord = free.select("doc_id", F.col("page_idx").alias("head_page"), F.col("index").alias("head_index"), F.col("ord").alias("head_ord"))
    # a chain ends at the first block that is not there
    present = walked.join(by_place.select("doc_id", "page_idx", "index", F.lit(True).alias("_there")), ["doc_id", "page_idx", "index"], "left")
    upto = Window.partitionBy("doc_id", "head_page", "head_index").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    present = present.withColumn("_all", F.bool_and(F.coalesce("_there", F.lit(False))).over(upto)).where("_all").drop("_there", "_all")
    appended = present.join(by_place, ["doc_id", "page_idx", "index"]).join(head_ord, ["doc_id", "head_page", "head_index"])
    return heads.unionByName(appended)


def renumber(rows: DataFrame, order: list[str], skip: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Circled digits of a column, in the order given, become [^n]; skip (doc_id, seq) names those that are no note marks.

    Adds n_marks (all digits of the row) and n_used (those replaced)."""
    key = [c for c in rows.columns if c != text]
    exploded = rows.select(*key, F.posexplode_outer(tx.pieces(F.col(text))).alias("_k", "_piece"))
    marked = F.coalesce(F.col("_piece").rlike(f"^{CIRCLED_CLASS}"), F.lit(False))
    along = Window.partitionBy("doc_id").orderBy(*order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    numbered = exploded.withColumn("_mark", marked).withColumn("_seq", F.sum(F.col("_mark").cast("long")).over(along))
    if skip is not None:
        # a bounded list of exceptions, typed in by hand
        named = skip.select("doc_id", F.col("seq").alias("_seq"), F.lit(True).alias("_skip")).distinct()
        numbered = numbered.join(named, ["doc_id", "_seq"], "left")
        used = F.col("_mark") & F.col("_skip").isNull()
    else:
        used = F.col("_mark")
    numbered = numbered.withColumn("_use", used).withColumn("_n", F.sum(F.col("_use").cast("long")).over(along))
    piece = F.when(F.col("_use"), F.concat(F.lit("[^"), F.col("_n").cast("string"), F.lit("]"), F.substring("_piece", F.lit(2), F.length("_piece")))).otherwise(F.coalesce("_piece", F.lit("")))
    place = ["doc_id", *order]
    rest = [c for c in key if c not in place]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_k", F.lit(0)).alias("k"), piece.alias("p")))), lambda x: x["p"]), "")
    return numbered.groupBy(*place).agg(*[F.first(c).alias(c) for c in rest], joined.alias(text), F.sum(F.col("_mark").cast("long")).alias("n_marks"), F.sum(F.col("_use").cast("long")).alias("n_used"))


_ORDER = ["head_page", "head_index", "head_ord", "depth"]


def rendered_blocks(blocks: DataFrame, edges: DataFrame, walked: DataFrame, numbers: DataFrame, *, skip: DataFrame | None = None, quote_indent: float = 10.0, has_images: bool = True) -> DataFrame:
    """doc_id, head_page, head_index, pos, md, pages: a row for each output block, chains joined with inline anchors."""
    ordered = render_order(blocks, edges, walked)
    before, middle, after = media_markdown(has_images)
    media = F.col("type").isin("image", "table")
    # captions, body and feet are one string while marks are replaced: html keeps its digits
    split = ordered.withColumns({"_before": F.when(media, before).otherwise(F.col("text")), "_middle": F.when(media, middle).otherwise(""), "_after": F.when(media, after).otherwise("")})
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("_before").alias("t")), F.struct(F.lit(1).alias("part"), F.col("_after").alias("t")))
    long_ = split.select("doc_id", *_ORDER, "page_idx", "index", "ord", "type", "level", "_middle", F.explode(parts).alias("x")).select("*", F.col("x.part").alias("part"), F.col("x.t").alias("text")).drop("x")
    done = renumber(long_, [*_ORDER, "part"], skip)
    joined = done.groupBy("doc_id", *_ORDER).agg(
        *[F.first(c).alias(c) for c in ("page_idx", "index", "ord", "type", "level", "_middle")],
        F.max(F.when(F.col("part") == 0, F.col("text"))).alias("_before"),
        F.max(F.when(F.col("part") == 1, F.col("text"))).alias("_after"),
        F.sum("n_used").alias("n_used"),
    )
    key = ["doc_id", "page_idx", "index", "ord"]
    levels = heading_levels(blocks).withColumnRenamed("level", "_level")
    marked = joined.join(levels, key, "left").join(indents(blocks, quote_indent).select(*key, "kind"), key, "left")
    plain = F.regexp_replace("_before", r"(?U)^#+\s*", "")
    blank = F.array_join(F.filter(F.array("_before", "_middle", "_after"), lambda t: t != ""), "\n\n")
    md = (
        F.when(F.col("type").isin("image", "table"), blank)
        .when(F.col("_before") == "", "")
        .when(F.col("type") == "title", F.concat(F.repeat(F.lit("#"), F.coalesce("_level", F.lit(2)).cast("int")), F.lit(" "), plain))
        .when(F.col("kind").isNotNull(), F.concat(F.lit("<!--?"), F.col("kind"), F.lit("--> "), F.col("_before")))
        .otherwise(F.col("_before"))
    )
    rendered = marked.select("doc_id", *_ORDER, "page_idx", md.alias("md")).join(numbers, ["doc_id", "page_idx"], "left")
    piece = F.when(F.col("depth") == 0, F.col("md")).when(F.col("md") == "", "").otherwise(F.concat(F.lit("<!--p."), F.col("pnum").cast("string"), F.lit("-->"), F.col("md")))
    whole = rendered.groupBy("doc_id", "head_page", "head_index", "head_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", piece.alias("p")))), lambda x: x["p"]), "").alias("md"),
        F.collect_set(F.when((F.col("depth") > 0) & (F.col("md") != ""), F.col("page_idx"))).alias("pages"),
    )
    whole = whole.withColumn("md", tx.strip(F.col("md"))).where("md <> ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("head_page", "head_index", "head_ord"))
    return whole.select("doc_id", "head_page", "head_index", pos.cast("long").alias("pos"), "md", F.array_sort("pages").alias("pages"))


def anchored(rendered: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, pos, md: a page's anchor before its first block, unless a chain has shown the page already; none for page 0."""
    seams = rendered.select("doc_id", F.col("pos").alias("seam_pos"), F.explode("pages").alias("head_page"))
    shown = seams.groupBy("doc_id", "head_page").agg(F.min("seam_pos").alias("seam_pos"))
    first = rendered.groupBy("doc_id", "head_page").agg(F.min("pos").alias("first_pos"))
    due = first.join(shown, ["doc_id", "head_page"], "left").where("head_page > 0 and (seam_pos is null or seam_pos > first_pos)")
    anchors = due.join(numbers.withColumnRenamed("page_idx", "head_page"), ["doc_id", "head_page"]).select("doc_id", F.col("first_pos").alias("pos"), F.lit(0).alias("sub"), F.concat(F.lit("<!--p."), F.col("pnum").cast("string"), F.lit("-->")).alias("md"))
    rows = anchors.unionByName(rendered.select("doc_id", "pos", F.lit(1).alias("sub"), "md"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub"))
    return rows.select("doc_id", pos.cast("long").alias("new"), "md").withColumnRenamed("new", "pos")


def assemble(lines: DataFrame, notes: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id and the whole Markdown: empty head to fill in, first page's anchor, body, notes."""
    body_text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n").alias("body"))
    note = F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]: <!--p."), F.col("pnum").cast("string"), F.lit("--> "), F.col("note"), F.lit("\n\n"))
    note_text = notes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", note.alias("t")))), lambda x: x["t"]), "").alias("notes"))
    first = numbers.groupBy("doc_id").agg(F.min_by("pnum", "page_idx").alias("pnum"))
    head = F.concat(F.lit("---\ntitle: \nauthor: \ntags: []\n---\n\n<!--p."), F.col("pnum").cast("string"), F.lit("-->\n\n"))
    joined = first.join(body_text, "doc_id", "left").join(note_text, "doc_id", "left")
    tail = F.concat(F.lit(f"\n\n---\n\n## {NOTES_HEADING}\n\n"), F.coalesce("notes", F.lit("")))
    return joined.select("doc_id", F.concat(head, F.coalesce("body", F.lit("")), tail).alias("text"))


def build_report(lines: DataFrame, marks: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_marks, n_used, n_notes, balanced: whether references and notes agree in number."""
    sums = [lines.groupBy("doc_id").agg(F.count("*").alias("n_blocks")), marks.groupBy("doc_id").agg(F.sum("n_marks").alias("n_marks"), F.sum("n_used").alias("n_used")), notes.groupBy("doc_id").agg(F.count("*").alias("n_notes"))]
    joined = sums[0].join(sums[1], "doc_id", "full").join(sums[2], "doc_id", "full").na.fill(0)
    return joined.select("doc_id", "n_blocks", "n_marks", "n_used", "n_notes", (F.col("n_used") == F.col("n_notes")).alias("balanced"))


#: Sections of a report, and what stands for an entry's page and content.
_ENTRIES = {
    "added": ("page_idx", lambda: F.concat(F.coalesce(tx.mark_of(F.col("circ")), F.lit("")), F.lit(" "), F.col("text"))),
    "split": ("pnum", lambda: F.concat_ws(" ", "marks", "note")),
    "joined": ("pnum", lambda: F.concat_ws(" | ", "before", "after")),
    "meta": ("pnum", lambda: F.col("text")),
    "candidates": ("pnum", lambda: F.concat_ws(" | ", "before", "after")),
}


def report_sections(counts: DataFrame, **findings: DataFrame) -> DataFrame:
    """doc_id, section, page, value: the report of a rebuild as one table.

    counts is build_report's; each count is a row of section counts, named by
    its value, and warning where references and notes differ in number. findings
    are named by section: added, split, joined, meta, candidates."""
    names = [c for c in counts.columns if c not in ("doc_id", "balanced")]
    shown = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names]
    none = F.lit(None).cast("long").alias("page")
    rows = counts.select("doc_id", F.lit("counts").alias("section"), none, F.explode(F.array(*shown)).alias("value"))
    differ = F.concat_ws(" <> ", F.col("n_used").cast("string"), F.col("n_notes").cast("string"))
    rows = rows.unionByName(counts.where("not balanced").select("doc_id", F.lit("warning").alias("section"), none, differ.alias("value")))
    for section, found in findings.items():
        page, value = _ENTRIES[section]
        rows = rows.unionByName(found.select("doc_id", F.lit(section).alias("section"), F.col(page).cast("long").alias("page"), value().alias("value")))
    return rows
