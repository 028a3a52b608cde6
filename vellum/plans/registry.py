"""Registered queries of the layout engine, over tables derived from documents and events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import audit, diff, footnotes, ingest, merge, pages, render, seam, split, verify
from vellum.profile import CONTENTS_LINE, LATIN_PROFILE
from vellum.session import configure
from vellum.sources import derived, inputs, layout
from vellum.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


@dataclass
class Corpus:
    """The canonical tables of one scale."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def documents(self) -> DataFrame:
        return derived.documents(configure(self.spark), self.sf_dir)

    @cached_property
    def blocks(self) -> DataFrame:
        return derived.blocks(self.documents)

    @cached_property
    def pages(self) -> DataFrame:
        return derived.pages(self.documents)

    @cached_property
    def edges(self) -> DataFrame:
        return derived.edges(self.documents)

    @cached_property
    def numbers(self) -> DataFrame:
        return pages.page_numbers(self.pages, self.blocks)

    @cached_property
    def aligned(self) -> DataFrame:
        return audit.alignment(self.pages, self.blocks, self.numbers)

    @cached_property
    def markdown(self) -> DataFrame:
        return derived.markdown(self.documents)

    @cached_property
    def book(self) -> DataFrame:
        return split.parse(self.markdown)

    @cached_property
    def skip(self) -> DataFrame:
        """Every ninth mark is none."""
        return audit.markers(self.blocks, self.numbers).where("seq % 9 = 0").select("doc_id", "seq")

    @cached_property
    def staged(self) -> Corpus:
        """The same corpus with its layout written once, as a parsed corpus is: rendering reads it in many branches."""
        own = Corpus(self.spark, self.sf_dir)
        own.__dict__ |= {"blocks": staged(self.blocks, "blocks"), "edges": staged(self.edges, "edges"), "pages": staged(self.pages, "pages")}
        own.__dict__["numbers"] = staged(own.numbers, "numbers")
        return own

    @cached_property
    def rendered(self) -> DataFrame:
        c = self.staged
        return render.rendered_blocks(c.blocks, c.edges, merge.chains(c.edges), c.numbers)

    @cached_property
    def seamless(self) -> DataFrame:
        """Rendered lines joined across pages."""
        return seam.join_page_breaks(self.lines, LATIN_PROFILE)

    @cached_property
    def lines(self) -> DataFrame:
        """Rendered lines with their anchors, written once."""
        return staged(render.anchored(staged(self.rendered, "rendered"), self.staged.numbers), "lines")

    @cached_property
    def page_joins(self) -> DataFrame:
        return seam.page_joins(self.lines, LATIN_PROFILE)

    @cached_property
    def files(self) -> DataFrame:
        """Files to submit: sizes follow the documents'."""
        docs = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.col("source"), F.lit(".pdf")).alias("name"), (F.col("n_chars") % 701 + 1).alias("pages"), (F.col("n_chars") * 300000).alias("bytes"), F.col("doc_id").alias("pos"), F.concat(F.lit("id"), (F.col("doc_id") % 5).cast("string")).alias("data_id"))

    @cached_property
    def events(self) -> DataFrame:
        """Poll events: an event is a file's next state in its user's batch."""
        rows = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        state = F.expr("CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END")
        return rows.select(F.col("user_id").cast("long").alias("batch"), (F.col("event_id") % 3).alias("file"), F.col("event_id").alias("seq"), state.alias("state"))

    @cached_property
    def added(self) -> DataFrame:
        """Notes typed in by hand."""
        note = inputs.lost_notes(self.documents).select("doc_id", tx.parse_added_note(F.col("spec")).alias("a"))
        return note.where("a is not null").select("doc_id", "a.page_idx", "a.circ", "a.text")

    @cached_property
    def polled(self) -> DataFrame:
        """What a poll says of each file, and which files are down already."""
        state = F.expr("CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END")
        rows = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select(F.col("event_id").alias("file"), state.alias("state"), F.when(F.col("event_id") % 4 > 0, "u").alias("url"), F.when(F.col("event_id") % 5 == 0, "no pages").alias("error"))
        down = rows.where("file % 3 = 0").select("file", (F.col("file") % 2 == 0).alias("downloaded"))
        parts = rows.where("file % 11 <> 0").select("file", F.concat(F.lit("id"), F.col("file").cast("string")).alias("data_id"))
        return ingest.reconcile(rows, down, parts)

    @cached_property
    def ledger(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        return rows.select(ingest.usage_day(F.col("ts")).alias("date"), F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("key"), (F.col("event_id") % 40 + 1).alias("pages"), F.col("event_id").alias("at"))


def _query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    _registered[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
    return f


@_query
def body_blocks(c: Corpus) -> DataFrame:
    return pages.body(c.blocks).select("doc_id", "page_idx", "index", "type", "level", "text")


@_query
def footnote_blocks(c: Corpus) -> DataFrame:
    return pages.footnote_blocks(c.blocks).select("doc_id", "page_idx", "ord", "text")


@_query
def type_histogram(c: Corpus) -> DataFrame:
    return audit.type_histogram(c.blocks)


@_query
def inventory(c: Corpus) -> DataFrame:
    return audit.inventory(c.pages, c.blocks, c.numbers)


@_query
def orphan_preview(c: Corpus) -> DataFrame:
    return audit.preview(audit.orphan_notes(c.blocks, c.numbers), ["page_idx", "ord"])


@_query
def alignment_rows(c: Corpus) -> DataFrame:
    return audit.alignment_rows(c.aligned)


@_query
def preflight(c: Corpus) -> DataFrame:
    return ingest.preflight(ingest.upload_parts(c.files))


@_query
def upload_batches(c: Corpus) -> DataFrame:
    return ingest.batches(ingest.upload_parts(c.files).where("part = 1"), ["file_id"]).select("file_id", "batch")


@_query
def needs_ocr(c: Corpus) -> DataFrame:
    """A document's lines stand in for the pages of a file."""
    lines = c.documents.where("text is not null").select(F.col("doc_id").alias("file_id"), F.size(F.split("text", "\n")).alias("n_pages"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return ingest.needs_ocr(lines)


@_query
def context_breaks(c: Corpus) -> DataFrame:
    """Neighbouring body blocks that the rebuild's rule would join."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("page_idx", "index"))
    rows = pages.body(c.blocks).withColumn("after", after).where("after is not null")
    return rows.where(tx.is_break(F.col("text"), F.col("after"), LATIN_PROFILE)).select("doc_id", "page_idx", "index", F.right("text", F.lit(10)).alias("before"))


@_query
def cut_text(c: Corpus) -> DataFrame:
    return pages.body(c.blocks).select("doc_id", "page_idx", "index", tx.cut(F.col("text"), 40).alias("text"))


@_query
def header_counts(c: Corpus) -> DataFrame:
    """Page numbers stand in for headers, which the derived layout lacks."""
    as_headers = c.blocks.withColumn("type", F.when(F.col("type") == "page_number", "header").otherwise(F.col("type")))
    return audit.headers(as_headers)


@_query
def media_counts(c: Corpus) -> DataFrame:
    """Titles stand in for figures."""
    return audit.media_counts(c.blocks.withColumn("type", F.when(F.col("type") == "title", "image").otherwise(F.col("type"))))


@_query
def confidence(c: Corpus) -> DataFrame:
    return audit.confidence(c.blocks)


@_query
def page_number_map(c: Corpus) -> DataFrame:
    return c.numbers


@_query
def margins(c: Corpus) -> DataFrame:
    return pages.margins(c.blocks)


@_query
def marker_sequence(c: Corpus) -> DataFrame:
    return audit.markers(c.blocks, c.numbers)


@_query
def align_pages(c: Corpus) -> DataFrame:
    return c.aligned


@_query
def align_mismatches(c: Corpus) -> DataFrame:
    return audit.mismatches(c.aligned)


@_query
def align_rollup(c: Corpus) -> DataFrame:
    return audit.alignment_rollup(c.aligned)


@_query
def enum_runs(c: Corpus) -> DataFrame:
    return audit.enum_runs(c.blocks)


@_query
def misfiled_notes(c: Corpus) -> DataFrame:
    return audit.misfiled_notes(c.blocks, c.numbers)


@_query
def orphan_notes(c: Corpus) -> DataFrame:
    return audit.orphan_notes(c.blocks, c.numbers)


@_query
def meta_notes(c: Corpus) -> DataFrame:
    return audit.meta_notes(c.blocks, c.numbers)


@_query
def break_candidates(c: Corpus) -> DataFrame:
    return audit.break_candidates(c.pages, c.blocks, c.numbers, c.edges, LATIN_PROFILE)


@_query
def verify_statuses(c: Corpus) -> DataFrame:
    """What a run over each document would end with."""
    return verify.statuses(c.markdown)


@_query
def same_page_merges(c: Corpus) -> DataFrame:
    return audit.same_page_merges(c.blocks, c.numbers, c.edges)


@_query
def flat_titles(c: Corpus) -> DataFrame:
    return audit.flat_titles(c.blocks)


@_query
def truncation(c: Corpus) -> DataFrame:
    return audit.truncation(c.pages, c.blocks, c.numbers, LATIN_PROFILE)


@_query
def formula_noise(c: Corpus) -> DataFrame:
    return audit.formula_noise(c.blocks)


@_query
def punctuation(c: Corpus) -> DataFrame:
    return audit.punctuation(c.blocks)


@_query
def merge_edges(c: Corpus) -> DataFrame:
    """Edges read back from positions and two-block connections, as a block list states them."""
    rows = pages.body(c.blocks).select("doc_id", F.concat_ws("-", F.col("page_idx").cast("string"), F.col("index").cast("string")).alias("position"), "page_idx", "index")
    numbered = c.edges.select("doc_id", (F.col("src_page") * 100 + F.col("src_index") * 10 + F.when(F.col("src_page") == F.col("dst_page"), 1).otherwise(0)).alias("conn"), F.array(F.concat_ws("-", F.col("src_page").cast("string"), F.col("src_index").cast("string")), F.concat_ws("-", F.col("dst_page").cast("string"), F.col("dst_index").cast("string"))).alias("ends"))
    return merge.merge_edges(rows, numbered.select("doc_id", "conn", F.posexplode("ends").alias("ord", "position")))


@_query
def merge_chains(c: Corpus) -> DataFrame:
    return merge.chains(c.edges)


@_query
def heading_levels(c: Corpus) -> DataFrame:
    return render.heading_levels(c.blocks).select("doc_id", "page_idx", "index", "level")


@_query
def footnotes_expanded(c: Corpus) -> DataFrame:
    return footnotes.footnotes(c.blocks, c.numbers)


@_query
def marker_renumber(c: Corpus) -> DataFrame:
    """Marks in page order; every ninth is skipped."""
    rows = pages.body(c.blocks).select("doc_id", "page_idx", "index", "text")
    done = render.renumber(rows, ["page_idx", "index"], c.skip)
    return done.select("doc_id", "page_idx", "index", "text", "n_marks", "n_used")


@_query
def indent_blocks(c: Corpus) -> DataFrame:
    return render.indents(c.blocks).drop("ord")


@_query
def rendered_blocks(c: Corpus) -> DataFrame:
    return c.rendered.select("doc_id", "pos", "head_page", "head_index", "md")


@_query
def seam_join(c: Corpus) -> DataFrame:
    return c.seamless


@_query
def assembled(c: Corpus) -> DataFrame:
    own = c.staged
    return render.assemble(c.seamless, footnotes.footnotes(own.blocks, own.numbers), own.numbers)


@_query
def join_lines(c: Corpus) -> DataFrame:
    """A page's lines as one paragraph; their last marks are cut, so that words meet."""
    rows = c.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    rows = rows.select("doc_id", F.expr("cast(line_no div 5 as bigint)").alias("page_idx"), "line_no", F.regexp_replace("line", r"[.,!?|]+\s*$", "").alias("line"))
    lines = rows.groupBy("doc_id", "page_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select("doc_id", "page_idx", tx.join_lines(F.col("lines")).alias("text"))


@_query
def strip_tags(c: Corpus) -> DataFrame:
    tagged = pages.body(c.blocks).withColumn("text", F.regexp_replace("text", "([,.;])", "<sub>$1</sub>"))
    return tagged.select("doc_id", "page_idx", "index", tx.strip_tags(F.col("text")).alias("text"))


@_query
def tidy_footnotes(c: Corpus) -> DataFrame:
    return pages.footnote_blocks(c.blocks).select("doc_id", "page_idx", "ord", tx.tidy_footnote(F.col("text")).alias("text"))


@_query
def significant(c: Corpus) -> DataFrame:
    return pages.body(c.blocks).select("doc_id", "page_idx", "index", tx.significant(F.col("text")).alias("text"))


@_query
def verify_counts(c: Corpus) -> DataFrame:
    return verify.reference_counts(c.markdown)


@_query
def verify_problems(c: Corpus) -> DataFrame:
    return verify.problems(c.markdown)


@_query
def verify_yaml(c: Corpus) -> DataFrame:
    """Every seventh document's head gets a line that is no key."""
    broken = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"\A---\ntitle:", "---\ntitle\nauthor: [")).otherwise(F.col("text"))
    return verify.bad_yaml(c.markdown.withColumn("text", broken)).select("doc_id", "rule")


@_query
def diff_changes(c: Corpus) -> DataFrame:
    """Each page against a product from which some words are dropped; pages are the sections, as alignment is quadratic in one."""
    source = audit.page_texts(c.blocks).select("doc_id", F.col("page_idx").alias("section"), "text")
    return diff.changes(source, source.withColumn("text", F.regexp_replace("text", "(and|und|que) ", "")))


@_query
def chapters(c: Corpus) -> DataFrame:
    return split.chapters(c.book, start_page="1")


@_query
def chapter_notes(c: Corpus) -> DataFrame:
    return split.chapter_notes(c.book)


@_query
def chapter_files(c: Corpus) -> DataFrame:
    return split.chapter_files(c.book, start_page="1").select("doc_id", "chapter", "file", "pages", "n_notes", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query
def upload_parts(c: Corpus) -> DataFrame:
    return ingest.upload_parts(c.files)


@_query
def unique_names(c: Corpus) -> DataFrame:
    return ingest.unique_names(c.files)


@_query
def usage_daily(c: Corpus) -> DataFrame:
    empty = c.ledger.where("false")
    return ingest.daily_usage(ingest.append_usage(empty, c.ledger), 3000, 60000).withColumn("date", F.col("date").cast("string"))


@_query
def batch_states(c: Corpus) -> DataFrame:
    return ingest.batch_states(c.events)


@_query
def poll_outcomes(c: Corpus) -> DataFrame:
    """Batches polled for up to 30 days."""
    at = F.col("event_id").alias("seq")
    times = c.spark.read.parquet(f"{c.sf_dir}/events.parquet").select(at, F.unix_timestamp("ts").alias("at"))
    return ingest.poll_outcomes(c.events.join(times, "seq"), 30 * 86400)


@_query
def state_changes(c: Corpus) -> DataFrame:
    return ingest.state_changes(c.events)


@_query
def check_summary(c: Corpus) -> DataFrame:
    """Findings of all checks by document."""
    return audit.checks(c.blocks, c.pages, c.numbers, c.edges, LATIN_PROFILE)


@_query
def layout_blocks(c: Corpus) -> DataFrame:
    """Blocks of parser JSON."""
    return layout.blocks_of(inputs.layouts(c.documents)).select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), "zone", "ord", "index", "type", "x0", "n_lines", "text")


@_query
def block_list_edges(c: Corpus) -> DataFrame:
    """Edges of connections of several blocks, from block lists."""
    lists = inputs.block_lists(c.documents)
    return merge.merge_edges(layout.block_positions(lists), layout.merge_connections(lists))


@_query
def artifact_choice(c: Corpus) -> DataFrame:
    return layout.artifacts(inputs.listings(c.documents))


@_query
def media_blocks(c: Corpus) -> DataFrame:
    parts = F.array(*render.media_markdown())
    rows = inputs.media(c.documents)
    return rows.select("doc_id", "page_idx", "type", F.array_join(F.filter(parts, lambda x: x != ""), "\n\n").alias("md"))


@_query
def contents_breaks(c: Corpus) -> DataFrame:
    """Cut paragraphs where some blocks are lines of a table of contents, which are none."""
    dotted = F.when(F.expr("(doc_id + page_idx) % 3 = 0"), F.concat("text", F.lit(" ………12"))).otherwise(F.col("text"))
    return audit.break_candidates(c.pages, c.blocks.withColumn("text", dotted), c.numbers, c.edges, replace(LATIN_PROFILE, contents_line=CONTENTS_LINE))


@_query
def source_sections(c: Corpus) -> DataFrame:
    return diff.source_sections(c.blocks)


@_query
def product_sections(c: Corpus) -> DataFrame:
    return diff.product_sections(inputs.marked_up(c.markdown))


@_query
def tags_outside_code(c: Corpus) -> DataFrame:
    return verify.problems(inputs.with_code(c.markdown)).where("rule = 'tags'")


@_query
def missing_images(c: Corpus) -> DataFrame:
    """Every other length of path has a file."""
    docs = inputs.illustrated(c.documents)
    return verify.missing_images(docs, verify.image_references(docs).where("length(path) % 2 = 0"))


@_query
def added_notes(c: Corpus) -> DataFrame:
    return footnotes.footnotes(c.blocks, c.numbers, c.added)


@_query
def build_sections(c: Corpus) -> DataFrame:
    """The rebuild's report of every document."""
    own = c.staged
    body = pages.body(own.blocks).select("doc_id", "page_idx", "index", "text")
    return render.report_sections(
        render.build_report(c.rendered, render.renumber(body, ["page_idx", "index"]), footnotes.footnotes(own.blocks, own.numbers, c.added)),
        added=c.added,
        split=footnotes.split_notes(own.blocks, own.numbers),
        joined=c.page_joins,
        meta=audit.meta_notes(own.blocks, own.numbers),
        candidates=audit.break_candidates(own.pages, own.blocks, own.numbers, own.edges, LATIN_PROFILE),
    )


@_query
def file_keys(c: Corpus) -> DataFrame:
    """Cache keys, names, archive paths and rectangles of files."""
    text = F.col("file_id").cast("string")
    path = F.expr("CASE file_id % 5 WHEN 0 THEN 'a/../../b' WHEN 1 THEN '/a' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'C:/a' ELSE 'a/b' END")
    rect = tx.parse_rect(F.concat(text, F.lit("， 2,"), F.when(F.col("file_id") % 3 == 0, "x").otherwise("3.5"), F.lit(",4")))
    return c.files.select(
        "file_id",
        tx.fingerprint(F.col("name"), F.col("bytes").cast("string"), text).alias("fingerprint"),
        tx.safe_name(F.concat(F.lit(" a/b:"), F.col("name"), F.lit('?"'))).alias("safe"),
        tx.member_is_inside(path).alias("inside"),
        F.aggregate(rect, F.lit(0.0), lambda a, x: a + x).alias("rect_sum"),
        F.array_join(F.transform(tx.parse_numbers(F.concat(text, F.lit("，7, 8,"))), lambda x: x.cast("string")), "+").alias("numbers"),
    )


@_query
def fetch_actions(c: Corpus) -> DataFrame:
    return c.polled


@_query
def fetch_status(c: Corpus) -> DataFrame:
    return ingest.exit_code(c.polled)


def queries() -> dict[str, Query]:
    return dict(_registered)
