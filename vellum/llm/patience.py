"""Line dedup: align documents that share rare lines, and delete from the later one what is aligned.

A line's hash is rare if it is not blank and at most RARE_SHARE of the documents
hold it. A run is the shortest stretch of lines, blank and frequent ones too,
with at least LEAST_BYTES of text and a rare line, that starts or ends at a
line; every longer stretch is a union of runs. Each run points from
each document to the first that holds it (smallest doc_id), so a document meets
at most two partners for each of its lines, however many documents share a run,
and whatever stretch it shares with any earlier document is shared, run by run,
with its partners. A copy of every deleted line stays: what a partner loses
itself, a still earlier document holds.

A document and a partner are aligned by patience diff over the lines they
share: lines that are unique in both anchor a longest common subsequence, gaps
between anchors are aligned in the same way, and equal lines next to aligned
ones are added; blank and frequent lines are aligned like others. A block of
consecutive aligned lines is deleted if it holds at least LEAST_BYTES of text and
a rare line. Runs that the partner holds but the alignment leaves
out (they stand in another order, or repeat) are deleted as blocks of their own.
So a line goes if and only if it is in a stretch of that size and with a rare
line that an earlier document holds, whoever the partners are.

Lines travel as hashes with their sizes; only the spans that stay come back to
the text, which is cut by DataFrame functions.

Defined results: lines are compared without the white space around them; blank
and frequent lines go only in a block with a rare one; null texts have no line and stay null; empty texts
have one blank line; of rows that repeat a doc_id none takes lines from the
other; rows without doc_id come back as they are; an empty table gives an empty
result; of ties the smallest doc_id is the first holder, and of its texts the
one with the smallest hash; texts are cut whole, however long; only doc_id and
text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb
from vellum.llm.runtime import Scratch, written

RARE_SHARE = 0.5
LEAST_BYTES = 40


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, in order of the first, that increases in the second."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[k] = last[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[at], last[at] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(shared: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Aligned (line, line) pairs of two documents; shared has the places of each common line in both."""
    mine = {x: k for k, (xs, _) in enumerate(shared) for x in xs}
    theirs = {y: k for k, (_, ys) in enumerate(shared) for y in ys}
    aligned: dict[int, int] = {}
    open_ = [(min(mine), max(mine) + 1, min(theirs), max(theirs) + 1)] if mine and theirs else []
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and mine.get(a, -1) == theirs.get(c, -2):
            aligned[a] = c
            a, c = a + 1, c + 1
        while a < b and c < d and mine.get(b - 1, -1) == theirs.get(d - 1, -2):
            aligned[b - 1] = d - 1
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        here: dict[int, list[int]] = {}
        for x in (x for x in mine if a <= x < b) if b - a > len(mine) else (x for x in range(a, b) if x in mine):
            here.setdefault(mine[x], []).append(x)
        there: dict[int, list[int]] = {}
        for y in (y for y in theirs if c <= y < d) if d - c > len(theirs) else (y for y in range(c, d) if y in theirs):
            there.setdefault(theirs[y], []).append(y)
        unique = sorted((xs[0], there[k][0]) for k, xs in here.items() if len(xs) == 1 and len(there.get(k, ())) == 1)
        anchors = _increasing(unique)
        if not anchors:
            continue
        for x, y in anchors:
            aligned[x] = y
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        open_ += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False) if x + 1 < x2 and y + 1 < y2]
    return sorted(aligned.items())


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first line, lines, first line of the partner) of runs that are consecutive in both."""
    out: list[tuple[int, int, int]] = []
    for x, y in pairs:
        if out and x == out[-1][0] + out[-1][1] and y == out[-1][2] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1, out[-1][2])
        else:
            out.append((x, 1, y))
    return out


def runs(lines: np.ndarray, size: np.ndarray, rare: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end, key) of the shortest stretches with least bytes and a rare line that start or end at each line of each text."""
    n = len(lines)
    at = np.arange(n)
    sizes, rares = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(rare)))
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + least), np.searchsorted(rares, rares[:-1] + 1))
    starts = np.minimum(np.searchsorted(sizes, sizes[1:] - least, "right"), np.searchsorted(rares, rares[1:] - 1, "right")) - 1
    length = np.diff(first)
    forward, back = ends <= np.repeat(first[1:], length), starts >= np.repeat(first[:-1], length)
    starts, ends = np.unique(np.stack((np.concatenate((at[forward], starts[back])), np.concatenate((ends[forward], at[back] + 1)))), axis=1)
    return starts, ends, tb.run_hashes(tb.mix(lines.view(np.uint64)), starts, ends)


_SPAN = pa.struct([("start", pa.int32()), ("n", pa.int32())])
_BLOCK = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("partner", pa.int64()), ("partner_start", pa.int32())])


def _columns(lists: pa.Array, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bytes, rare, first line of each text and the end) of a column of lines."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    lines, size = (np.asarray(flat.field(k)) for k in (0, 1))
    return lines, size.astype(np.int64), (size > 0) & ~np.isin(lines, common), offsets - offsets[0]


def _runs(common: np.ndarray, least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, size, rare, first = _columns(batch.column(2), common)
            starts, _, keys = runs(lines, size, rare, first, least)
            text = np.searchsorted(first, starts, "right") - 1
            found = np.unique(np.stack((text.astype(np.uint64), keys)), axis=1)
            text = pa.array(found[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), pa.array(found[1].view(np.int64))], names=["doc_id", "digest", "run"])

    return kernel


def _shared(mine: np.ndarray, theirs: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Places in both of each line that both hold."""
    places: dict[int, tuple[list[int], list[int]]] = {}
    for x in np.flatnonzero(np.isin(mine, theirs)).tolist():
        places.setdefault(int(mine[x]), ([], []))[0].append(x)
    for y in np.flatnonzero(np.isin(theirs, mine)).tolist():
        places[int(theirs[y])][1].append(y)
    return list(places.values())


def _left_out(found: list[tuple[int, int, int]], mine: tuple, theirs: tuple, least: int) -> list[tuple[int, int, int]]:
    """Blocks of the runs that both hold and that are not in the blocks found."""
    open_ = np.ones(len(mine[0]) + 1, np.int64)
    for start, n, _ in found:
        open_[start : start + n] = 0
    before = np.concatenate(([0], np.cumsum(open_)))
    starts, ends, keys = runs(*mine, np.array([0, len(mine[0])]), least)
    left = before[ends] > before[starts]
    if not left.any():
        return []
    there_starts, _, there_keys = runs(*theirs, np.array([0, len(theirs[0])]), least)
    there = dict(zip(there_keys.tolist()[::-1], there_starts.tolist()[::-1], strict=True))
    more = [(there[k] - x, x, y) for x, y, k in zip(starts[left].tolist(), ends[left].tolist(), keys[left].tolist(), strict=True) if k in there]
    out: list[tuple[int, int, int]] = []
    for shift, x, y in sorted(more):
        if out and out[-1][2] - out[-1][0] == shift and x <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y - out[-1][0]), out[-1][2])
        else:
            out.append((x, y - x, x + shift))
    return out


def _aligned(common: np.ndarray, least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (_columns(batch.column(k), common) for k in (3, 4))
            removed = []
            for k, partner in enumerate(batch.column(2).to_pylist()):
                own, other = (tuple(c[first[k] : first[k + 1]] for c in columns) for *columns, first in (mine, theirs))
                found = blocks(align(_shared(own[0], other[0])))
                found = [b for b in found if own[1][b[0] : b[0] + b[1]].sum() >= least and own[2][b[0] : b[0] + b[1]].any()]
                found += _left_out(found, own, other, least)
                removed.append([{"start": start, "n": n, "partner": partner, "partner_start": there} for start, n, there in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(mine[3]), pa.int32()), pa.array(removed, pa.list_(_BLOCK))], names=["doc_id", "digest", "n_lines", "removed"])

    return kernel


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all partners, without overlaps, and the spans between them."""
    for batch in batches:
        removed, kept = [], []
        for n_lines, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            at, own, stays = 0, [], []
            for r in sorted(found, key=lambda r: (r["start"], -r["n"], r["partner"], r["partner_start"])):
                start, end = max(r["start"], at), r["start"] + r["n"]
                if end <= at:
                    continue
                if start > at:
                    stays.append({"start": at + 1, "n": start - at})
                own.append({"start": start, "n": end - start, "partner": r["partner"], "partner_start": r["partner_start"] + start - r["start"]})
                at = end
            if at < n_lines:
                stays.append({"start": at + 1, "n": n_lines - at})
            removed.append(own)
            kept.append(stays)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.list_(_BLOCK)), pa.array(kept, pa.list_(_SPAN))], names=["doc_id", "digest", "removed", "kept"])


def lines_of(docs: DataFrame, write: Callable = written) -> DataFrame:
    """doc_id, digest of the text, and its lines (hash and bytes), once for each text of a doc_id."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.octet_length(x).alias("bytes")))
    whole = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), hashed.alias("lines"))
    return write(whole.dropDuplicates(["doc_id", "digest"]), "lines")


def common_lines(texts: DataFrame, rare_share: float = RARE_SHARE) -> np.ndarray:
    """Hashes of the lines that are not rare: at most 1 / rare_share times the mean number of lines, whatever the corpus."""
    held = texts.select("doc_id", F.explode("lines").alias("l")).where("l.bytes > 0").select("doc_id", F.col("l.line").alias("line")).distinct()
    most = max(2, int(rare_share * texts.where("exists(lines, l -> l.bytes > 0)").select("doc_id").distinct().count()))
    return np.array([r["line"] for r in held.groupBy("line").agg(F.count("*").alias("holders")).where(F.col("holders") > most).collect()], np.int64)


def partners(texts: DataFrame, common: np.ndarray, least_bytes: int = LEAST_BYTES, write: Callable = written) -> DataFrame:
    """doc_id and digest of each text with those of the first holders of its runs."""
    held = write(texts.mapInArrow(_runs(common, least_bytes), "doc_id bigint, digest bigint, run bigint"), "runs")
    first = held.groupBy("run").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc"), F.min_by("digest", F.struct("doc_id", "digest")).alias("first_digest")).where("holders > 1")
    # written, so that a run with many holders can be split where it is joined
    first = write(first, "first-holders")
    return held.join(first, "run").where("doc_id <> first_doc").select("doc_id", "digest", "first_doc", "first_digest").distinct()


def dedup_lines(docs: DataFrame, rare_share: float = RARE_SHARE, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (blocks with their partner) and text of every document (columns doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        texts = lines_of(docs, scratch.written)
        common = common_lines(texts, rare_share)
        theirs = texts.select(F.col("doc_id").alias("first_doc"), F.col("digest").alias("first_digest"), F.col("lines").alias("first_lines"))
        asked = partners(texts, common, least_bytes, scratch.written).join(texts, ["doc_id", "digest"]).join(theirs, ["first_doc", "first_digest"]).select("doc_id", "digest", "first_doc", "lines", "first_lines")
        block = "array<struct<start: int, n: int, partner: bigint, partner_start: int>>"
        found = asked.mapInArrow(_aligned(common, least_bytes), f"doc_id bigint, digest bigint, n_lines int, removed {block}")
        by_doc = found.groupBy("doc_id", "digest").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("removed")).alias("removed"))
        spans = written(by_doc.mapInArrow(_spans, f"doc_id bigint, digest bigint, removed {block}, kept array<struct<start: int, n: int>>"), "line-spans").where("size(removed) > 0")
    cut = F.expr(r"array_join(transform(kept, s -> array_join(slice(split(text, '\n', -1), s.start, s.n), '\n')), '\n')")
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["n"]), F.lit(0).cast("long"))
    # by shuffle at every size: what is to be cut grows with the corpus
    whole = docs.withColumn("digest", F.xxhash64("text")).hint("merge").join(spans, ["doc_id", "digest"], "left")
    return whole.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), "removed", F.when(F.col("kept").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cut).alias("text"))
