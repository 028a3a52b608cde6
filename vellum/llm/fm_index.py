"""Benchmark decontamination with one FM-index per training shard.

The words of a shard's texts become numbers over the benchmark's vocabulary. A
test phrase can only stand where consecutive words all belong to it, so runs of
such words, separated by 0, are the shard's text; shorter runs than the
shortest phrase hold no phrase. Its suffix array gives the Burrows-Wheeler
transform, kept in a wavelet matrix. Phrases are looked up by backward search
over its ranks, all phrases at once; each occurrence is located by walking to a
sampled suffix position; the words covered are merged into removal spans.

The benchmark reaches the tasks as a broadcast. Where its words exceed
MAX_PHRASE_BYTES it is split by item into blocks under that size, each block is
searched in all shards, and the spans of the blocks are merged.

Defined results: null, empty and wordless texts have no word and no hit; an item
without words has no phrase; equal phrases of several items count for each item,
items that repeat an id count once;
rows that repeat are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb
from vellum.llm.runtime import unused, written

#: Words of a phrase.
WIDTH = 13
#: Bytes of text of one FM-index.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text in one broadcast.
MAX_PHRASE_BYTES = 8 << 20
#: Suffix positions that are a multiple of this are kept.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol must be smaller than all others."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector with running counts for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each end."""
        at = [np.zeros(len(symbols), np.int64), *ends]
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbols >> level) & 1 == 1
            ones = self.ones[k]
            at = [np.where(bit, self.zeros[k] + ones[x], x - ones[x]) for x in at]
        return [x - at[0] for x in at[1:]]


class FMIndex:
    """Backward search and locating over one shard's numbers (all at least 1, or 0 between runs)."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.concatenate((text.astype(np.int64) + 1, [0]))
        order = suffix_array(text)
        self.last = text[order - 1]
        self.wavelet = WaveletMatrix(self.last, int(text.max()).bit_length())
        self.size = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def search(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of each occurrence; a phrase is a row of the grid, right-aligned after -1."""
        most = len(self.before) - 2
        active = np.arange(len(grid))
        low, high = np.zeros(len(grid), np.int64), np.full(len(grid), self.size, np.int64)
        for step in range(grid.shape[1] - 1, -1, -1):
            symbols = grid[active, step].astype(np.int64)
            going = symbols >= 0
            own, symbols = active[going], symbols[going]
            known = symbols <= most
            high[own[~known]] = low[own[~known]]
            own, symbols = own[known], symbols[known]
            a, b = self.wavelet.rank(symbols, low[own], high[own])
            low[own], high[own] = self.before[symbols] + a, self.before[symbols] + b
            active = active[high[active] > low[active]]
            if not len(active):
                break
        counts = high[active] - low[active]
        found = np.repeat(active, counts)
        rows = np.repeat(low[active] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return found, self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the left until one is sampled."""
        position, rows = np.zeros(len(rows), np.int64), rows.copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            here = rows[open_]
            done = self.sampled[here]
            position[open_[done]] = self.samples[self.sample_rank[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbols = self.last[here]
            rows[open_] = self.before[symbols] + self.wavelet.rank(symbols, here)[0]
            steps += 1
        return position


def search_grid(phrases: list, lengths: np.ndarray, shift: int) -> np.ndarray:
    """Phrases of numbers as right-aligned rows, each number raised by shift, -1 before them."""
    grid = np.full((len(phrases), int(lengths.max(initial=0))), -1, np.int32)
    flat = np.fromiter((x for p in phrases for x in p), np.int32, int(lengths.sum())) + shift
    grid[np.arange(grid.shape[1])[None, :] >= grid.shape[1] - lengths[:, None]] = flat
    return grid


class Phrases:
    """Windows of the benchmark's items over its own vocabulary."""

    def __init__(self, items: pa.Array, texts: pa.Array, width: int = WIDTH) -> None:
        data, offsets = tb.utf8(texts)
        data = tb.lower(data)
        starts, ends, first = tb.words(data, offsets, tb.ALPHANUMERIC)
        self.vocabulary, numbers = np.unique(tb.span_hashes(data, starts, ends), return_inverse=True)
        windows: dict[tuple[int, ...], list[int]] = {}
        for row in range(len(items)):
            own = numbers[first[row] : first[row + 1]].tolist()
            for k in range(max(1, len(own) - width + 1) if own else 0):
                holders = windows.setdefault(tuple(own[k : k + width]), [])
                if not holders or holders[-1] != row:
                    holders.append(row)
        self.items = items
        self.lengths = np.array([len(w) for w in windows], np.int64)
        #: Windows as the index numbers their words, 2 above the vocabulary's.
        self.grid = search_grid(list(windows), self.lengths, 2)
        self.holders = np.array([r for rows in windows.values() for r in rows], np.int64)
        self.first_holder = np.concatenate(([0], np.cumsum([len(rows) for rows in windows.values()]))).astype(np.int64)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each row and the end, hit by word, row and holder of each occurrence)."""
        data = tb.lower(data)
        starts, ends, first = tb.words(data, offsets, tb.ALPHANUMERIC)
        hit = np.zeros(len(starts) + 1, np.int64)
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(self.grid):
            return first, hit[:-1] > 0, none, none
        hashes = tb.span_hashes(data, starts, ends)
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == hashes
        edge = np.zeros(len(starts) + 1, bool)
        edge[first] = True
        run_first = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
        run_end = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
        long_enough = run_end - run_first >= self.lengths.min()
        run_first, run_end = run_first[long_enough], run_end[long_enough]
        if not len(run_first):
            return first, hit[:-1] > 0, none, none
        size = run_end - run_first
        shard = np.zeros(int(size.sum()) + len(size), np.int64)
        at = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # a run and its separator
        word = np.repeat(run_first - at, size + 1) + np.arange(len(shard))
        inside = np.ones(len(shard), bool)
        inside[at + size] = False
        shard[inside] = number[word[inside]] + 1
        found, position = FMIndex(shard).search(self.grid)
        word_at = word[position]
        np.add.at(hit, word_at, 1)
        np.subtract.at(hit, word_at + self.lengths[found], 1)
        row = np.searchsorted(first, word_at, "right") - 1
        n = self.first_holder[found + 1] - self.first_holder[found]
        holder = self.holders[np.repeat(self.first_holder[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        return first, np.cumsum(hit[:-1]) > 0, np.repeat(row, n), holder


def _search(key: str, phrases):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Phrases = phrases.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in tb.text_chunks(texts, SHARD_BYTES):
                first, hit, row, holder = known.occurrences(data, offsets)
                n = hi - lo
                edges = np.zeros(len(hit) + 1, bool)
                edges[first] = True
                span_first = np.flatnonzero(hit & (edges[:-1] | ~np.concatenate(([False], hit[:-1]))))
                span_end = np.flatnonzero(hit & (edges[1:] | ~np.concatenate((hit[1:], [False])))) + 1
                span_row = np.searchsorted(first, span_first, "right") - 1
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(span_row, np.arange(n + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(span_first - first[span_row], pa.int64()), pa.array(span_end - first[span_row], pa.int64())], ["start", "end"]),
                )
                pairs = np.unique(row * np.int64(len(known.items) + 1) + holder)
                row, holder = pairs // (len(known.items) + 1), pairs % (len(known.items) + 1)
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), known.items.take(pa.array(holder)))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, n), pa.array(np.diff(first), pa.int64()), spans, items], names=[key, "n_words", "spans", "items"])

    return kernel


def _blocks(benchmark: DataFrame, item: str) -> tuple[DataFrame, int]:
    """Items with a text, and into how many broadcasts they are to be split."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, max(1, -(-2 * size // MAX_PHRASE_BYTES))


def _phrases(items: DataFrame, width: int) -> Phrases:
    table = items.toArrow()
    names, texts = (pa.concat_arrays(table[c].chunks) if table.num_rows else pa.array([], pa.string()) for c in ("item", "text"))
    return Phrases(names, texts, width)


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id", width: int = WIDTH) -> DataFrame:
    """key, n_words, spans (merged, in words, end excluded) and items (their ids as strings, sorted) of every document."""
    spark = docs.sparkSession
    items, blocks = _blocks(benchmark, item)
    texts = docs.select(key, "text")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    found = None
    if blocks > 1:
        texts = texts.withColumn("_row", F.monotonically_increasing_id())
        texts = written(texts, "decontaminate-texts")
        key, schema = "_row", schema.replace(f"`{key}` {kind}", "_row bigint")
    for block in range(blocks):
        phrases = _phrases(items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items, width)
        part = texts.select(key, "text").mapInArrow(_search(key, spark.sparkContext.broadcast(phrases)), schema)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        by_row = found.groupBy(key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        merged = F.expr("aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, s) -> if(size(acc) > 0 and s.start <= acc[size(acc) - 1].end, concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].start as start, greatest(acc[size(acc) - 1].end, s.end) as end))), concat(acc, array(s))))")
        found = texts.drop("text").join(by_row.withColumn("spans", merged), key).drop(key)
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def verdicts(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)}).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _clean(phrases, at: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Phrases = phrases.value
        for batch in batches:
            for lo, hi, data, offsets in tb.text_chunks(batch.column(at), SHARD_BYTES):
                first, hit, _, _ = known.occurrences(data, offsets)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit, n_words = total[first[1:]] - total[first[:-1]], np.diff(first)
                yield batch.slice(lo, hi - lo).filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))

    return kernel


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, item: str = "item_id", width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, that are not contaminated; each row is judged by its own text."""
    items, blocks = _blocks(benchmark, item)
    if blocks > 1:
        row = unused(docs, "row")[0]
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
        found = verdicts(contamination(numbered, benchmark, key=row, item=item, width=width))
        return numbered.join(found.where("contaminated").select(row), row, "left_anti").select(docs.columns)
    read = docs.sparkSession.sparkContext.broadcast(_phrases(items, width))
    return docs.mapInArrow(_clean(read, docs.columns.index("text")), docs.schema)
