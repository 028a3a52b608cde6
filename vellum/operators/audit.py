"""Audit of parser output: what to look at before a document is rebuilt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.pages import body, discarded, footnote_blocks
from vellum.profile import CIRCLED_CLASS, FORMULA_KINDS, SENTENCE_MARKS, Profile

MEDIA = ("image", "table", "equation", "interline_equation")


def _ranked_counts(rows: DataFrame, key: Column) -> DataFrame:
    """Counts by document and key; rank by count, of equals the first seen."""
    counted = rows.groupBy("doc_id", key.alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("page_idx", "ord")).alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return counted.select("doc_id", "key", "n", F.row_number().over(order).cast("long").alias("rank"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    """doc_id, zone, key (block type), n, rank."""
    zones = [_ranked_counts(blocks.where(F.col("zone") == z), F.col("type")).withColumn("zone", F.lit(z)) for z in ("body", "discarded")]
    return reduce(DataFrame.unionByName, zones)


def media_counts(blocks: DataFrame) -> DataFrame:
    return body(blocks).where(F.col("type").isin(*MEDIA)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def headers(blocks: DataFrame, most: int = 6) -> DataFrame:
    """The commonest page headers of each document."""
    return _ranked_counts(discarded(blocks, "header"), F.col("text")).where(F.col("rank") <= most)


def confidence(blocks: DataFrame, low: float = 0.9) -> DataFrame:
    """doc_id, n_spans, min_score, n_low over spans of body blocks' own lines."""
    spans = body(blocks).select("doc_id", F.explode("scores").alias("score"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.min("score").alias("min_score"), F.count_if(F.col("score") < low).alias("n_low"))


def low_spans(blocks: DataFrame, low: float = 0.9) -> DataFrame:
    """The single spans of low confidence, to be read again."""
    return body(blocks).select("doc_id", "page_idx", "index", F.posexplode("scores").alias("span", "score")).where(F.col("score") < low)


def punctuation(blocks: DataFrame) -> DataFrame:
    """doc_id, n_cjk, n_marks, ratio (6 digits), band: lost, thin or complete."""
    counts = body(blocks).select("doc_id", F.regexp_count("text", F.lit("[一-鿿]")).cast("long").alias("c"), (F.length("text") - F.length(F.translate("text", SENTENCE_MARKS, ""))).cast("long").alias("m"))
    sums = counts.groupBy("doc_id").agg(F.sum("c").alias("n_cjk"), F.sum("m").alias("n_marks"))
    ratio = F.when(F.col("n_cjk") > 0, F.col("n_marks") / F.col("n_cjk")).otherwise(F.lit(0.0))
    band = F.when(ratio < 0.02, "lost").when(ratio < 0.05, "thin").otherwise("complete")
    return sums.select("doc_id", "n_cjk", "n_marks", F.round(ratio, 6).alias("ratio"), band.alias("band"))


def alignment(pages: DataFrame, blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Every page's marks in the body, note blocks, and note blocks that carry a number."""
    marks = body(blocks).groupBy("doc_id", "page_idx").agg(F.sum(F.regexp_count("text", F.lit(CIRCLED_CLASS))).alias("marks"))
    numbered = ~tx.is_meta(F.col("text"))
    expanded = F.when(numbered, F.greatest(F.length(tx.leading_marks(F.col("text"))), F.lit(1))).otherwise(0)
    notes = footnote_blocks(blocks).groupBy("doc_id", "page_idx").agg(F.count("*").alias("notes"), F.count_if(numbered).alias("numbered"), F.sum(expanded).alias("numbered_expanded"))
    key = ["doc_id", "page_idx"]
    joined = pages.select(*key).join(numbers, key, "left").join(marks, key, "left").join(notes, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(*key, "pnum", zero("marks"), zero("notes"), zero("numbered"), zero("numbered_expanded"))


def mismatches(aligned: DataFrame) -> DataFrame:
    return aligned.where("marks <> numbered")


def alignment_rows(aligned: DataFrame, terse_from: int = 24) -> DataFrame:
    """All pages of short documents; of longer ones those that mismatch."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return aligned.withColumn("_n", n).where(f"_n <= {terse_from} or marks <> numbered").drop("_n")


def alignment_rollup(aligned: DataFrame) -> DataFrame:
    """Sums by page, by document (page_idx null) and over all (both null)."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("marks", "notes", "numbered")]
    return aligned.rollup("doc_id", "page_idx").agg(F.grouping_id().cast("long").alias("level"), *sums)


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, page_idx and the joined text of the page's body in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "ord", "text")))
    return body(blocks).groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "").alias("text"))


def markers(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each circled digit in page order: doc_id, seq, page_idx, pnum, char_pos, mark, context."""
    cut = page_texts(blocks).withColumn("_pieces", tx.pieces(F.col("text")))
    placed = cut.select("doc_id", "page_idx", "text", "_pieces", F.posexplode("_pieces").alias("k", "piece")).where(F.col("piece").rlike(f"^{CIRCLED_CLASS}"))
    before = F.aggregate(F.slice("_pieces", 1, F.col("k")), F.lit(0), lambda n, p: n + F.length(p))
    placed = placed.select("doc_id", "page_idx", "text", before.alias("char_pos"), F.left("piece", F.lit(1)).alias("mark"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "char_pos"))
    joined = placed.withColumn("seq", seq.cast("long")).join(numbers, ["doc_id", "page_idx"], "left")
    return joined.select("doc_id", "seq", "page_idx", "pnum", F.col("char_pos").cast("long").alias("char_pos"), "mark", tx.context(F.col("text"), F.col("char_pos")).alias("context"))


def block_marks(blocks: DataFrame) -> DataFrame:
    """Each circled digit of each body block with its 0-based place in the block's text."""
    cut = body(blocks).select("doc_id", "page_idx", "index", "ord", "text", tx.pieces(F.col("text")).alias("_pieces"))
    placed = cut.select("*", F.posexplode("_pieces").alias("k", "piece")).where(F.col("piece").rlike(f"^{CIRCLED_CLASS}"))
    before = F.aggregate(F.slice("_pieces", 1, F.col("k")), F.lit(0), lambda n, p: n + F.length(p))
    return placed.select("doc_id", "page_idx", "index", "ord", "text", before.cast("long").alias("char_pos"), tx.mark_index(F.left("piece", F.lit(1))).alias("circ"))


def enum_runs(blocks: DataFrame, near: int = 40) -> DataFrame:
    """Circled digits that count up in close order inside a block: an enumeration rather than note marks.

    Runs of three or more, or of two that a colon introduces."""
    block = Window.partitionBy("doc_id", "page_idx", "index", "ord").orderBy("char_pos")
    marks = block_marks(blocks)
    goes_on = (F.col("circ") == F.lag("circ").over(block) + 1) & (F.col("char_pos") - F.lag("char_pos").over(block) < near)
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(block)
    runs = marks.withColumn("run", run).groupBy("doc_id", "page_idx", "index", "ord", "run").agg(F.count("*").alias("n"), F.min("char_pos").alias("start"), F.first("text").alias("text"))
    lead = F.substring("text", (F.greatest(F.col("start") - 12, F.lit(0)) + 1).cast("int"), F.least(F.col("start"), F.lit(12)).cast("int"))
    shown = F.substring("text", (F.greatest(F.col("start") - 24, F.lit(0)) + 1).cast("int"), (F.least(F.col("start"), F.lit(24)) + 60).cast("int"))
    found = runs.where((F.col("n") >= 2) & ((F.col("n") >= 3) | lead.rlike("[：:]")))
    return found.select("doc_id", "page_idx", "index", F.col("start"), "n", shown.alias("shown"))


def _note(blocks: DataFrame, numbers: DataFrame, rule: Column, shown: int | None = 60) -> DataFrame:
    text = F.col("text") if shown is None else F.left("text", F.lit(shown))
    return footnote_blocks(blocks).where(rule).join(numbers, ["doc_id", "page_idx"], "left").select("doc_id", "page_idx", "ord", "pnum", text.alias("text"))


def misfiled_notes(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Notes that start like a list item: most likely body text in the wrong zone."""
    return _note(blocks, numbers, (F.col("text") != "") & F.col("text").rlike(r"(?U)^\d+\s*[.．、]"))


def orphan_notes(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Notes without a circled digit that are no journal data."""
    return _note(blocks, numbers, (F.col("text") != "") & ~F.col("text").rlike(f"^{CIRCLED_CLASS}") & ~tx.is_meta(F.col("text")))


def meta_notes(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Journal data in the notes, to be moved to the frontmatter."""
    return _note(blocks, numbers, tx.is_meta(F.col("text")), None)


def break_candidates(pages: DataFrame, blocks: DataFrame, numbers: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """Page boundaries that cut a paragraph though no connection says so."""
    texts = body(blocks).where("type in ('text', 'ref_text')")
    place = F.struct("index", "ord")
    ends = texts.groupBy("doc_id", "page_idx").agg(F.max_by("text", place).alias("last"), F.max_by("index", place).alias("last_index"), F.min_by("text", place).alias("first"))
    key = ["doc_id", "page_idx"]
    ends = pages.select(*key).join(ends, key, "left").join(numbers, key, "left")
    order = Window.partitionBy("doc_id").orderBy("page_idx")
    after = ends.withColumns({"next_page": F.lead("page_idx").over(order), "next_pnum": F.lead("pnum").over(order), "next": F.lead("first").over(order)})
    last, following = tx.strip_right(F.col("last")), tx.strip_left(F.col("next"))
    open_ = (F.col("next_page") == F.col("page_idx") + 1) & (F.col("pnum") > 0) & (F.col("next_pnum") > 0) & (following != "") & tx.ends_open(last, profile) & ~following.rlike(profile.opener)
    if profile.contents_line:
        open_ = open_ & ~last.rlike(profile.contents_line) & ~following.rlike(profile.contents_line)
    sources = edges.select("doc_id", F.col("src_page").alias("page_idx"), F.col("src_index").alias("last_index")).distinct()
    cut = after.where(open_).join(sources, [*key, "last_index"], "left_anti")
    return cut.select(*key, "pnum", F.right(last, F.lit(26)).alias("before"), F.left(following, F.lit(26)).alias("after"))


def flat_titles(blocks: DataFrame, least: int = 5) -> DataFrame:
    """Documents whose titles, more than a few, all have one level."""
    titles = body(blocks).where("type = 'title'").groupBy("doc_id").agg(F.count("*").alias("n_titles"), F.count_distinct(F.coalesce("level", F.lit(-1))).alias("levels"), F.min("level").alias("level"))
    return titles.where((F.col("levels") == 1) & (F.col("n_titles") > least)).select("doc_id", "n_titles", "level")


def truncation(pages: DataFrame, blocks: DataFrame, numbers: DataFrame, profile: Profile) -> DataFrame:
    """Documents that start after page 1 or stop inside a sentence."""
    ends = pages.join(numbers, ["doc_id", "page_idx"]).groupBy("doc_id").agg(F.min_by("pnum", "page_idx").alias("first_pnum"), F.max_by("pnum", "page_idx").alias("last_pnum"), F.max("page_idx").alias("page_idx"))
    tails = body(blocks).where("text <> ''").groupBy("doc_id", "page_idx").agg(F.max_by("text", F.struct("index", "ord")).alias("tail"))
    joined = ends.join(tails, ["doc_id", "page_idx"], "left").withColumn("tail", F.coalesce(tx.strip_right(F.col("tail")), F.lit("")))
    stops = tx.ends_open(F.col("tail"), profile)
    return joined.where((F.col("first_pnum") > 1) | stops).select("doc_id", "first_pnum", "last_pnum", stops.alias("stops_open"), F.right("tail", F.lit(40)).alias("tail"))


def formula_noise(blocks: DataFrame) -> DataFrame:
    """doc_id, kind, n: notation that recognition takes for formulas. Counted on the whole text, so a pair may span blocks."""
    pages = page_texts(blocks).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda p: p["text"]), "").alias("text"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n")) for kind, pattern in FORMULA_KINDS])
    return pages.select("doc_id", F.explode(kinds).alias("k")).where("k.n > 0").select("doc_id", "k.kind", "k.n")


def same_page_merges(blocks: DataFrame, numbers: DataFrame, edges: DataFrame) -> DataFrame:
    """Connections inside one page; missing ends are shown as ?."""
    texts = body(blocks).groupBy("doc_id", "page_idx", "index").agg(F.max_by("text", "ord").alias("text"))
    found = edges.where("src_page = dst_page").select("doc_id", F.col("src_page").alias("page_idx"), "src_index", "dst_index")
    for end in ("src", "dst"):
        found = found.join(texts.select("doc_id", "page_idx", F.col("index").alias(f"{end}_index"), F.col("text").alias(f"{end}_text")), ["doc_id", "page_idx", f"{end}_index"], "left")
    found = found.join(numbers, ["doc_id", "page_idx"], "left")
    return found.select("doc_id", "page_idx", "pnum", "src_index", "dst_index", F.coalesce(F.right("src_text", F.lit(26)), F.lit("?")).alias("before"), F.coalesce(F.left("dst_text", F.lit(34)), F.lit("?")).alias("after"))


def checks(blocks: DataFrame, pages: DataFrame, numbers: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, check, n: findings of the seven automatic checks."""
    found = {
        "enumeration": enum_runs(blocks),
        "misfiled": misfiled_notes(blocks, numbers),
        "break": break_candidates(pages, blocks, numbers, edges, profile),
        "same_page": same_page_merges(blocks, numbers, edges),
        "flat_titles": flat_titles(blocks),
        "truncation": truncation(pages, blocks, numbers, profile),
        "formula": formula_noise(blocks),
    }
    rows = [df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("check"), "n") for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


def preview(findings: DataFrame, order: list[str], most: int = 12) -> DataFrame:
    """The first findings of each document."""
    place = Window.partitionBy("doc_id").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")


def inventory(pages: DataFrame, blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, n_pages, first and last printed page, n_blocks, n_notes."""
    spans = pages.join(numbers, ["doc_id", "page_idx"], "left").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min_by("pnum", "page_idx").alias("first_pnum"), F.max_by("pnum", "page_idx").alias("last_pnum"))
    counts = blocks.groupBy("doc_id").agg(F.count_if(F.col("zone") == "body").alias("n_blocks"), F.count_if((F.col("zone") == "discarded") & (F.col("type") == "page_footnote")).alias("n_notes"))
    return spans.join(counts, "doc_id", "left").na.fill(0, ["n_blocks", "n_notes"])
