"""Planning and bookkeeping of intake: parts, names, batches, quotas, states. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import fingerprint
from vellum.staging import staged

# Limits of a submission.
PAGES_PER_PART = 200
BYTES_PER_PART = 200 * 1024 * 1024
FILES_PER_BATCH = 50
FILES_PER_DAY = 5000
PAGES_PER_DAY = 1000
OCR_BELOW = 120
POLL_SECONDS = 21600
FINAL_STATES = ("done", "failed")


def upload_parts(files: DataFrame, pages_per_part: int = PAGES_PER_PART, bytes_per_part: int = BYTES_PER_PART) -> DataFrame:
    """Page ranges of each file (file_id, name, pages, bytes).

    Ranges of at most so many pages; one whose share of the bytes is too large
    is halved until its share fits. A single page may stay too large: oversize."""
    ranges = files.where("pages > 0").select("file_id", "name", "pages", "bytes", F.explode(F.expr(f"sequence(1, pages, {pages_per_part})")).alias("first"))
    ranges = ranges.withColumn("last", F.least(F.col("first") + pages_per_part - 1, F.col("pages")))
    n = F.col("last") - F.col("first") + 1
    # halving k times leaves at most ceil(n / 2^k) pages; the first k whose share fits
    halvings = F.expr(f"coalesce(get(filter(sequence(0, 20), k -> cast(ceil((last - first + 1) / pow(2.0D, k)) as bigint) * bytes <= {bytes_per_part} * pages), 0), 20)")
    ranges = ranges.withColumn("_size", F.greatest(F.ceil(n / F.pow(F.lit(2.0), halvings)).cast("long"), F.lit(1).cast("long")))
    parts = ranges.select("file_id", "name", "pages", "bytes", F.col("last").alias("_end"), "_size", F.explode(F.expr("sequence(first, last, _size)")).alias("page_start"))
    parts = parts.withColumn("page_end", F.least(F.col("page_start") + F.col("_size") - 1, F.col("_end")))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("page_start"))
    count = F.count("*").over(Window.partitionBy("file_id"))
    oversize = (F.col("page_end") - F.col("page_start") + 1) * F.col("bytes") > F.lit(bytes_per_part) * F.col("pages")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    range_name = F.concat(stem, F.lit("_p"), F.lpad(F.col("page_start").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("page_end").cast("string"), 4, "0"), F.lit(".pdf"))
    return parts.select("file_id", number.cast("long").alias("part"), "page_start", "page_end", (F.col("page_end") - F.col("page_start") + 1).alias("pages"), F.when(count == 1, F.col("name")).otherwise(range_name).alias("upload_name"), oversize.alias("oversize"))


def data_id(path: Column, size: Column, mtime: Column, start: Column, end: Column) -> Column:
    """A part's id: the source's fingerprint and the page range."""
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    return F.concat(fingerprint(path, size.cast("string"), mtime.cast("string")), F.lit("-"), pad(start), F.lit("-"), pad(end))


def uncached(parts: DataFrame, cache: DataFrame) -> DataFrame:
    """Parts that no file of the cache holds, by data_id."""
    return parts.join(cache.select("data_id").distinct(), "data_id", "left_anti")


def unique_names(files: DataFrame) -> DataFrame:
    """file_id, name: of names that are equal but for case the first in order of pos stays.

    The others become stem.data_id.n.pdf; n counts from 2 within a stem and
    data_id, and goes on after the numbers that given names of that shape have,
    so no two names are equal but for case (files: file_id, name, pos, data_id)."""
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    again = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("pos", "file_id"))
    named = files.select("file_id", "name", "pos", F.concat(stem, F.lit("."), F.col("data_id")).alias("base"), again.alias("again"))
    shape = r"(?is)^(.+)\.([0-9]{1,9})\.pdf$"
    given = files.select(F.lower(F.regexp_extract("name", shape, 1)).alias("key"), F.regexp_extract("name", shape, 2).try_cast("long").alias("n")).where("n is not null").groupBy("key").agg(F.max("n").alias("most"))
    rest = named.where("again > 1").withColumn("key", F.lower("base")).join(given, "key", "left")
    number = F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)) + F.row_number().over(Window.partitionBy("key").orderBy("pos", "file_id"))
    return named.where("again = 1").select("file_id", "name").unionByName(rest.select("file_id", F.concat("base", F.lit("."), number.cast("string"), F.lit(".pdf")).alias("name")))


def batches(parts: DataFrame, order: list[str], per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Parts with their batch, from 0, in order.

    Ranks are made of two steps, so that no task has all parts: rows are dealt to
    ranges of the order, and a range starts after the rows of those before it."""
    # written, so that both readers see the same ranges
    ranged = staged(parts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range: as many as shuffle partitions
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_place", place).join(starts, "_range")
    return ranked.withColumn("batch", ((F.col("_before") + F.col("_place") - 1) / per_batch).cast("long")).drop("_range", "_place", "_before")


def needs_ocr(pages: DataFrame, below: int = OCR_BELOW) -> DataFrame:
    """file_id, n_chars, is_ocr: too little text on the first, middle and last page (pages: file_id, page, n_pages, text)."""
    probes = pages.where((F.col("page") == 0) | (F.col("page") == F.expr("n_pages div 2")) | (F.col("page") == F.col("n_pages") - 1))
    chars = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "")))
    return probes.groupBy("file_id").agg(chars.cast("long").alias("n_chars")).select("file_id", "n_chars", (F.col("n_chars") < below).alias("is_ocr"))


def append_usage(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger (date, key, pages, at) with new records; of a key on a day the first stays."""
    order = Window.partitionBy("date", "key").orderBy("_late", "at")
    rows = ledger.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_late")


def usage_day(at: Column) -> Column:
    """The ledger's day of a moment: the service counts in UTC+8."""
    return F.to_date(F.from_utc_timestamp(at, "+08:00"))


def daily_usage(ledger: DataFrame, files_per_day: int = FILES_PER_DAY, pages_per_day: int = PAGES_PER_DAY) -> DataFrame:
    """date, files, pages and what is left of both quotas, never below 0."""
    sums = ledger.groupBy("date").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))
    left = lambda quota, c: F.greatest(F.lit(quota).cast("long") - F.col(c), F.lit(0).cast("long"))
    return sums.select("date", "files", "pages", left(files_per_day, "files").alias("files_left"), left(pages_per_day, "pages").alias("pages_left"))


def batch_states(events: DataFrame) -> DataFrame:
    """batch, n, n_done, n_failed, complete from poll events (batch, file, seq, state): the last state of each file counts."""
    last = events.groupBy("batch", "file").agg(F.max_by("state", "seq").alias("state"))
    final = F.bool_and(F.col("state").isin(*FINAL_STATES))
    return last.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state") == "failed").alias("n_failed"), final.alias("complete"))


def poll_outcomes(events: DataFrame, timeout: int = POLL_SECONDS) -> DataFrame:
    """batch, n_polls and outcome of poll events (batch, file, seq, state, at in seconds).

    done when the last state of every file is final, timeout when the last poll
    is so many seconds after the first or more and it is not, else open."""
    by_file = events.groupBy("batch", "file").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    sums = by_file.groupBy("batch").agg(F.sum("n").alias("n_polls"), F.bool_and(F.col("state").isin(*FINAL_STATES)).alias("final"), (F.max("last") - F.min("first")).alias("took"))
    return sums.select("batch", "n_polls", F.when(F.col("final"), "done").when(F.col("took") >= timeout, "timeout").otherwise("open").alias("outcome"))


def state_changes(events: DataFrame) -> DataFrame:
    """Events at which a file's state differs from the one before."""
    order = Window.partitionBy("batch", "file").orderBy("seq")
    before = F.lag("state").over(order)
    return events.withColumn("was", before).where(~F.equal_null("was", "state"))


def reconcile(results: DataFrame, previous: DataFrame, parts: DataFrame) -> DataFrame:
    """file, data_id, action of every polled file: keep (already down), fetch, failed, missing_url, or wait.

    results: file, state, url, error; previous: file, downloaded; parts: file, data_id."""
    joined = results.join(previous.select("file", F.col("downloaded").alias("_down")), "file", "left").join(parts.select("file", "data_id"), "file", "left")
    action = F.when(F.coalesce("_down", F.lit(False)), "keep").when(F.col("state") == "failed", "failed").when(F.col("state") != "done", "wait").when(F.coalesce("url", F.lit("")) == "", "missing_url").otherwise("fetch")
    return joined.select("file", "data_id", action.alias("action"), F.coalesce("error", F.lit("")).alias("error"))


def exit_code(actions: DataFrame) -> DataFrame:
    """One row: 2 if anything failed, else 0."""
    return actions.agg(F.when(F.count_if(F.col("action").isin("failed", "missing_url")) > 0, 2).otherwise(0).alias("code"))


def valid_inputs(files: DataFrame) -> DataFrame:
    """Files (path, size) that can be submitted: PDFs that are not empty."""
    return files.where(F.lower("path").endswith(".pdf") & (F.col("size") > 0))


def preflight(parts: DataFrame) -> DataFrame:
    """One row: files, parts and pages of a submission, and how many parts are too large."""
    return parts.agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("parts"), F.sum("pages").alias("pages"), F.count_if("oversize").alias("oversize"))


def public_part(parts: DataFrame) -> DataFrame:
    """What a report may show of a part: no local path."""
    return parts.select(*[c for c in ("source", "upload_name", "data_id", "pages", "page_start", "page_end", "is_ocr") if c in parts.columns])


def assign_urls(parts: DataFrame, urls: DataFrame) -> DataFrame:
    """Parts with the upload url of the same place (both have batch and place); a batch whose counts differ is an error."""
    joined = parts.join(urls.select("batch", "place", "url"), ["batch", "place"], "full")
    short = F.col("url").isNull() | F.col("data_id").isNull()
    return joined.withColumn("url", F.when(short, F.raise_error(F.concat(F.lit("urls and parts differ in number in batch "), F.col("batch").cast("string")))).otherwise(F.col("url")))


def resumable(jobs: DataFrame, batch_id: str) -> DataFrame:
    """The parts of a job that are not down yet (batch_id, file, downloaded)."""
    return jobs.where((F.col("batch_id") == batch_id) & ~F.coalesce("downloaded", F.lit(False)))


def residual_text(pages: DataFrame) -> DataFrame:
    """file_id, n_chars: characters that a stripped text layer still holds (pages: file_id, text)."""
    return pages.groupBy("file_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))
