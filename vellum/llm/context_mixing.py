"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is coded byte by byte, high bit first, and closed by an end symbol. For
each predictor (1 to ORDER bytes before; the word so far) a table, hashed by
its context and the bits so far, holds how often a 0 and a 1 followed. Their
log odds are summed with weights that a gate selects by bit position and by the
evidence behind the two longest contexts; the result is refined
by an adaptive map of (byte before, mixed probability) to what really followed.
The code length in bits gives the text's probability.

Training: all texts are reduced to distinct (context, byte) codes with counts,
which are dealt to ranges of their hash. They fill the tables; then the weights
are learned online over the codes of each range, in order of their hash, from the
tables less the code's own count, while the refining map counts what they lead to;
weights of the ranges are averaged by evidence, maps are summed. Ranges and table
sizes follow the bytes and the distinct codes of the training texts, and sums are
taken in a fixed order, so that scores do not depend on how the texts are dealt to
tasks. Tables grow with the distinct codes up to MOST_BITS, which bounds
what is broadcast; beyond, contexts share entries. When scoring, all statistics
are frozen and a code that a task has met before is looked up.

Beside it, token_scores gives the unigram base score. Its vocabulary grows with
the corpus and never meets in one place: words are dealt to ranges of their
hash; words with at least 1 / HOT_WORDS of all tokens (at most HOT_WORDS) are
broadcast; for the others each batch of texts sends its occurrences to the
word's range and gets sums by text back.

Defined results: null texts are scored as empty; without training texts every
bit costs one bit and every token log10(1 / 1); rows that repeat are scored one
by one, and alike; an empty table gives an empty result; only doc_id and text are
read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb
from vellum.llm.contexts import sums_by_text, windows
from vellum.llm.runtime import Scratch, written

#: The predictors: by 1 to ORDER bytes before, and by the word so far. Bits of each one's table index.
ORDER = 4
TABLE_BITS = (16, 18, 19, 20, 20)
PREDICTORS = len(TABLE_BITS)
#: Bytes of a word that its predictor looks back at most.
WORD_BYTES = 64
#: Distinct codes from which on tables double with the codes, and the bits at which they stop.
FIRST_GROWTH = 1 << 20
MOST_BITS = 21
END = 0xFF
#: Entries of the tables that travel in one row.
BLOCK = 512
#: Most codes kept by a task before it passes them on.
MOST_CODES = 1 << 20
BATCH_CODES = 1 << 14
#: Codes between two steps of the weights.
LEARN_CODES = 1 << 11
#: Positions coded at once: their arrays stay in a core's cache.
WINDOW = 1 << 17
#: Evidence behind an entry: none, little, some, much.
EVIDENCE = (1, 4, 32)
GATES = 8 * (len(EVIDENCE) + 1) ** 2
BINS = 33
RATE = 0.4
PRIOR = 0.2
CACHE_BITS = 22
#: Bytes of training text behind a range of hashes, and the most ranges.
RANGE_BYTES = 8 << 20
MOST_RANGES = 4096
#: Codes that one task fills tables with.
TABLE_CODES = 1 << 22
HOT_WORDS = 4096
_END_WORD = np.uint64(0xE4D5F1A2B3C49687)
#: Stands for a null doc_id while ids travel as bytes.
_NO_ID = -(1 << 63)
_ROW = "kind int, slot int, part bigint, a binary, b binary, n bigint"


def closed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with an end symbol after each."""
    data, offsets = tb.utf8(column)
    ended = np.insert(tb.lower(data), offsets[1:], np.uint8(END)) if len(offsets) > 1 else tb.lower(data)
    return ended, offsets + np.arange(len(offsets))


def coded(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first position, end, codes): a byte, ORDER bytes before it, and a hash of its word so far."""
    for a, b, codes in windows(data, offsets, ORDER, WINDOW):
        lo = max(0, a - WORD_BYTES)
        own = data[lo:b]
        here = np.arange(len(own))
        after = np.where(tb.SPACE_SEPARATED[own] & (own != END), 0, here + 1)
        start = np.maximum(np.concatenate(([0], np.maximum.accumulate(after)[:-1])), here - WORD_BYTES)
        word = tb.span_hashes(own, start[a - lo :], here[a - lo :]) >> np.uint64(8 * (ORDER + 1))
        yield a, b, codes | np.where(start[a - lo :] < here[a - lo :], word << np.uint64(8 * (ORDER + 1)), np.uint64(0))


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of each order's context."""
    before = codes >> np.uint64(8)
    near = [tb.mix((before & np.uint64((1 << 8 * order) - 1)) + np.uint64(order << 56)) for order in range(1, ORDER + 1)]
    return [*near, tb.mix((codes >> np.uint64(8 * (ORDER + 1))) + np.uint64(99 << 56))]


def table_bits(codes: int) -> tuple[int, ...]:
    """Bits of each predictor's table for so many distinct codes."""
    growth = max(0, (max(codes, 1) - 1).bit_length() - FIRST_GROWTH.bit_length() + 1)
    return tuple(min(b + growth, max(b, MOST_BITS)) for b in TABLE_BITS)


def _starts(bits: tuple[int, ...]) -> list[int]:
    """First entry of each predictor in the joint tables, and the end."""
    return [sum(1 << b for b in bits[:k]) for k in range(len(bits) + 1)]


def _entry(context: np.ndarray, node: np.ndarray, bits: int, start: int) -> np.ndarray:
    """Place in the joint tables of a context and the bits so far."""
    spread = (context ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (spread >> np.uint64(64 - bits)).astype(np.int64) + start


def _bits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, node: the bits so far under a leading 1, bit) for each bit of the codes' last bytes."""
    byte = codes & np.uint64(255)
    for position in range(8):
        node = np.uint64(1 << position) | (byte >> np.uint64(8 - position))
        yield position, node, (byte >> np.uint64(7 - position)) & np.uint64(1)


def table_counts(codes: np.ndarray, counts: np.ndarray, out: np.ndarray, bits: tuple[int, ...] = TABLE_BITS) -> None:
    """Add zeros and ones of every entry to two columns of 64-bit counts."""
    contexts, flat, counts = _slots(codes), out.reshape(-1), counts.astype(np.int64)
    starts = _starts(bits)
    for _, node, bit in _bits(codes):
        one = bit.astype(np.int64)
        for k, context in enumerate(contexts):
            np.add.at(flat, 2 * _entry(context, node, bits[k], starts[k]) + one, counts)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def packed(counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of each entry in one word."""
    counts = np.minimum(counts, (1 << 32) - 2).astype(np.uint64)
    return counts[:, 0] | counts[:, 1] << np.uint64(32)


class Mixer:
    """Tables of counts, weights by gate, and the refining map."""

    def __init__(self, packed: np.ndarray, bits: tuple[int, ...] = TABLE_BITS) -> None:
        #: Zeros in the low 32 bits, ones in the high.
        self.packed = packed
        self.bits, self.starts = bits, _starts(bits)
        self.weights = np.full((GATES, PREDICTORS), 0.3, np.float32)
        self.refined = np.zeros((256, BINS), np.float32)
        self.odds: np.ndarray | None = None
        self.evidence: np.ndarray | None = None
        self.columns: list[np.ndarray] = []
        self.name = ""

    def freeze(self) -> Mixer:
        """Keep log odds in place of counts, for scoring."""
        zeros, ones = (self.packed & np.uint64(0xFFFFFFFF)).astype(np.float32), (self.packed >> np.uint64(32)).astype(np.float32)
        self.odds = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
        self.evidence = np.searchsorted(EVIDENCE, zeros + ones, "right").astype(np.uint8)
        self.columns = [np.ascontiguousarray(self.weights[:, k]) for k in range(PREDICTORS)]
        self.name = uuid.uuid4().hex
        self.packed = self.packed[:0]
        return self

    def _gate(self, evidence: list[np.ndarray], position: int) -> np.ndarray:
        gate = np.zeros(len(evidence[0]), np.int64)
        for known in evidence:
            gate = gate * (len(EVIDENCE) + 1) + known
        return gate * 8 + position

    def _frozen_inputs(self, contexts: list[np.ndarray], node: np.ndarray, position: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(log odds by predictor, gate)."""
        at = [_entry(context, node, self.bits[k], self.starts[k]) for k, context in enumerate(contexts)]
        return [self.odds[x] for x in at], self._gate([self.evidence[x] for x in at[-2:]], position)

    def _own_inputs(self, contexts: list[np.ndarray], node: np.ndarray, bit: np.ndarray, position: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The same from counts, with one event of that bit less than was counted."""
        out, evidence = [], []
        less = np.where(bit == 1, np.uint64(1 << 32), np.uint64(1))
        for k, context in enumerate(contexts):
            own = self.packed[_entry(context, node, self.bits[k], self.starts[k])] - less
            zeros, ones = (own & np.uint64(0xFFFFFFFF)).astype(np.float32), (own >> np.uint64(32)).astype(np.float32)
            out.append(np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))))
            if k >= PREDICTORS - 2:
                seen = zeros + ones
                evidence.append(sum((seen >= e).astype(np.int64) for e in EVIDENCE))
        return out, self._gate(evidence, position)

    def _mixed(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return sum(self.weights[gate, k] * x for k, x in enumerate(inputs))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(x * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)

    def learn(self, codes: np.ndarray, counts: np.ndarray, curvature: np.ndarray, seen: np.ndarray) -> None:
        """One online pass over a batch of codes; seen counts all and ones by cell of the refining map."""
        contexts, weight = _slots(codes), np.minimum(counts, 64).astype(np.float32)
        before = ((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * BINS
        for position, node, bit in _bits(codes):
            inputs, gate = self._own_inputs(contexts, node, bit, position)
            mixed = self._mixed(inputs, gate)
            p, one = _squash(mixed), bit.astype(np.float32)
            cell = before + self._bin(mixed)
            seen[0] += np.bincount(cell, counts, 256 * BINS)
            seen[1] += np.bincount(cell, counts * one, 256 * BINS)
            slope, bend = (one - p) * weight, (p * (1 - p) + np.float32(1e-3)) * weight
            for k, x in enumerate(inputs):
                own = np.bincount(gate, bend * x * x, GATES)
                curvature[:, k] += own
                self.weights[:, k] += (RATE * np.bincount(gate, slope * x, GATES) / (0.1 * curvature[:, k] + own + 1e-3)).astype(np.float32)

    def set_map(self, seen: np.ndarray) -> None:
        centre = _squash((np.arange(BINS) - BINS // 2) / 2)
        self.refined = ((seen[1].reshape(256, BINS) + 4 * centre) / (seen[0].reshape(256, BINS) + 4)).astype(np.float32)

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits that each code's last byte costs after its context."""
        out = np.zeros(len(codes), np.float32)
        for at in range(0, len(codes), BATCH_CODES):
            own = codes[at : at + BATCH_CODES]
            contexts, before = _slots(own), ((own >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            for position, node, bit in _bits(own):
                inputs, gate = self._frozen_inputs(contexts, node, position)
                mixed = sum(column[gate] * x for column, x in zip(self.columns, inputs, strict=True))
                p = (_squash(mixed) + self.refined[before, self._bin(mixed)]) / 2
                p = np.clip(p, 1e-6, 1 - 1e-6)
                out[at : at + BATCH_CODES] -= np.log2(np.where(bit == 1, p, 1 - p))
        return out


class Pricer:
    """Costs of codes, the recent ones kept by hash; what is kept changes no result."""

    def __init__(self, mixer: Mixer) -> None:
        self.mixer = mixer
        self.code = np.full(1 << CACHE_BITS, np.uint64((1 << 64) - 1))
        self.price = np.zeros(1 << CACHE_BITS, np.float32)

    def cost(self, codes: np.ndarray) -> np.ndarray:
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.price[slot]
        missed = np.flatnonzero(self.code[slot] != codes)
        if len(missed):
            fresh, at = np.unique(codes[missed], return_inverse=True)
            price = self.mixer.cost(fresh)
            out[missed] = price[at]
            self.code[slot[missed]], self.price[slot[missed]] = codes[missed], price[at]
        return out

    def bits(self, column: pa.Array) -> np.ndarray:
        """Code length of each text with its end symbol."""
        data, offsets = closed(column)
        out = np.zeros(len(column))
        for a, _, codes in coded(data, offsets):
            sums_by_text(self.cost(codes).astype(np.float64), a, offsets, out)
        return out


#: A worker process prices several tasks of one model; what it knows of the last model stays.
_pricer: list[Pricer] = []


def pricer_of(mixer: Mixer) -> Pricer:
    if not _pricer or _pricer[0].mixer.name != mixer.name:
        _pricer[:] = [Pricer(mixer)]
    return _pricer[0]


def _tallied(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.concatenate((first, [len(values)])))


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range of each hash."""
    edges = np.array([-(-(k << 64) // ranges) for k in range(ranges)], np.uint64)
    return np.searchsorted(edges, hashes, "right") - 1


def _bounds(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """First of each range in sorted hashes, and the end."""
    edges = [np.uint64(-(-(k << 64) // ranges)) for k in range(ranges)]
    return np.append(np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes))


class _Tally:
    """Distinct keys and counts of a task, passed on when there are many."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        keys, counts = _distinct(values)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * MOST_CODES:
            key, n = _tallied(self.keys, self.counts)
            self.keys, self.counts, self.size = [key], [n], len(key)
            if len(key) > MOST_CODES:
                return self.take()
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.keys:
            return None
        found = _tallied(self.keys, self.counts)
        self.keys, self.counts, self.size = [], [], 0
        return found


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "slot", "part", "a", "b", "n"])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    data = tb.lower(data)
    starts, ends, first = tb.words(data, offsets, tb.SPACE_SEPARATED)
    return tb.span_hashes(data, starts, ends), first


def _statistics(ranges: int):
    """Words (kind 0) and codes (kind 1) of each range of their hash, with counts."""

    def rows(kind: int, found) -> Iterator[pa.RecordBatch]:
        if found:
            key, n = found
            if kind == 0:
                at = _bounds(key, ranges)
            else:
                # neighbouring codes are alike, so they stay in their own order within a range
                place = _range_of(tb.mix(key), ranges)
                by = np.argsort(place, kind="stable")
                key, n, at = key[by], n[by], np.searchsorted(place[by], np.arange(ranges + 1))
            yield _rows([(kind, r, 0, key[at[r] : at[r + 1]].tobytes(), n[at[r] : at[r + 1]].astype(np.int64).tobytes(), 0) for r in range(ranges) if at[r + 1] > at[r]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, codes = _Tally(), _Tally()
        for batch in batches:
            column = batch.column(0)
            for lo, hi, data, offsets in tb.text_chunks(column):
                hashes, _ = _word_hashes(data, offsets)
                yield from rows(0, vocabulary.add(np.concatenate((hashes, np.full(hi - lo, _END_WORD)))))
            group: list[np.ndarray] = []
            for _, _, own in coded(*closed(column)):
                group.append(own)
                if len(group) * WINDOW >= MOST_CODES:
                    yield from rows(1, codes.add(np.concatenate(group)))
                    group = []
            if group:
                yield from rows(1, codes.add(np.concatenate(group)))
        yield from rows(0, vocabulary.take())
        yield from rows(1, codes.take())

    return kernel


def _merged_codes(table: pa.Table) -> pa.Table:
    """Distinct codes of a range with their counts."""
    key, n = _tallied([np.frombuffer(x.as_buffer(), np.uint64) for x in table["a"]], [np.frombuffer(x.as_buffer(), np.int64) for x in table["b"]])
    columns = [pa.array([table["slot"][0].as_py()], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(key)])]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(columns, names=["slot", "a", "b", "n"])])


def _table_blocks(bits: tuple[int, ...]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                total = np.zeros((_starts(bits)[-1], 2), np.int64) if total is None else total
                codes, counts = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.int64)
                for at in range(0, len(codes), BATCH_CODES):
                    table_counts(codes[at : at + BATCH_CODES], counts[at : at + BATCH_CODES], total, bits)
        if total is None:
            return
        blocks = total.reshape(-1, BLOCK * 2)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 256):
            yield _rows([(2, int(k), part, _narrow(blocks[k]), None, 0) for k in used[at : at + 256]])

    return kernel


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes, in 32 bits where they fit; the first byte says which."""
    narrow = counts.max(initial=0) < 1 << 31
    return bytes([int(narrow)]) + counts.astype(np.int32 if narrow else np.int64).tobytes()


def _widened(data) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data[1:], np.int32 if data[0] else np.int64).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of arrays by slot, as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, a in zip(batch.column("slot").to_pylist(), batch.column("a"), strict=True):
            own = _widened(a.as_buffer())
            total[slot] = total[slot] + own if slot in total else own.copy()
    for slot, own in total.items():
        yield _rows([(2, slot, 0, _narrow(own), None, 0)])


def _learned(mixer):
    """For each range of codes: weights and refining counts after one pass over it in order of the hash, and the evidence behind the weights."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Mixer = mixer.value
        for batch in batches:
            for slot, a, b in zip(batch.column("slot").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                own.weights = np.full((GATES, PREDICTORS), 0.3, np.float32)
                curvature, seen = np.zeros(own.weights.shape), np.zeros((2, 256 * BINS))
                codes, counts = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.int64)
                order = np.argsort(tb.mix(codes))
                for at in range(0, len(codes), LEARN_CODES):
                    part = order[at : at + LEARN_CODES]
                    own.learn(codes[part], counts[part], curvature, seen)
                yield _rows([(3, slot, 0, own.weights.astype(np.float64).tobytes() + seen.tobytes(), curvature.tobytes(), 0)])

    return kernel


def _sum_by_slot(rows: DataFrame, parts: int) -> DataFrame:
    """Arrays of equal slot summed, those of many tasks in two steps, so that no task gets an array from every task before."""
    if parts == 1:
        return rows
    if parts > 16:
        rows = rows.repartition("slot", F.pmod("part", F.lit(int(parts**0.5)))).mapInArrow(_summed, _ROW)
    return rows.repartition("slot").mapInArrow(_summed, _ROW)


def _averaged(key: tuple, table: pa.Table) -> pa.Table:
    """Weights averaged by curvature, passed on with its sum; refining counts summed; in order of the streams."""
    size = GATES * PREDICTORS
    top, bottom, seen = np.zeros(size), np.zeros(size), np.zeros(2 * 256 * BINS)
    table = table.sort_by("slot")
    for a, b in zip(table["a"], table["b"], strict=True):
        w, c = np.frombuffer(a.as_buffer(), np.float64), np.frombuffer(b.as_buffer(), np.float64)
        top, bottom, seen = top + w[:size] * c, bottom + c, seen + w[size:]
    weights = np.where(bottom > 0, top / np.maximum(bottom, 1e-9), 0.3)
    return pa.Table.from_batches([_rows([(3, key[0].as_py(), 0, weights.tobytes() + seen.tobytes(), bottom.tobytes(), 0)])])


class Model:
    """A frozen mixer, and the vocabulary as a table by range."""

    def __init__(self, mixer: Mixer, vocabulary: DataFrame, ranges: int, tokens: int, words: int, hot: tuple[np.ndarray, np.ndarray]) -> None:
        self.mixer, self.vocabulary, self.ranges, self.tokens, self.words, self.hot = mixer, vocabulary, ranges, tokens, words, hot


def _merged_range(table: pa.Table) -> pa.Table:
    key, n = _tallied([np.frombuffer(x.as_buffer(), np.uint64) for x in table["a"]], [np.frombuffer(x.as_buffer(), np.int64) for x in table["b"]])
    slot = table["slot"][0].as_py()
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([int(n.sum())]), pa.array([len(key)])], names=["slot", "words", "counts", "tokens", "n_words"])])


def _hot(least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[counts >= least]), pa.array(counts[counts >= least])], names=["word", "n"])

    return kernel


def fit(texts: DataFrame) -> Model:
    """Learn from a column text."""
    spark = texts.sparkSession
    context = spark.sparkContext
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(1, -(-size // RANGE_BYTES)))
    with Scratch(spark) as scratch:
        statistics = scratch.written(texts.mapInArrow(_statistics(ranges), _ROW), "lm-statistics")
        merged = "slot int, words binary, counts binary, tokens bigint, n_words bigint"
        vocabulary = written(statistics.where("kind = 0").select("slot", "a", "b").groupBy("slot").applyInArrow(_merged_range, merged), "lm-vocabulary")
        codes = scratch.written(statistics.where("kind = 1").select("slot", "a", "b").groupBy("slot").applyInArrow(_merged_codes, "slot int, a binary, b binary, n bigint"), "lm-codes")
        scratch.drop(statistics)
        tokens, words = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        least = max(1, -(-tokens // HOT_WORDS))
        hot = vocabulary.select("words", "counts").mapInArrow(_hot(least), "word bigint, n bigint").toArrow()
        hot_words, hot_counts = hot["word"].to_numpy().view(np.uint64), hot["n"].to_numpy()
        order = np.argsort(hot_words)
        distinct = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bits = table_bits(distinct)
        table = np.zeros(_starts(bits)[-1], np.uint64)
        # each task's tables travel, so a task gets many codes
        tasks = max(1, -(-distinct // TABLE_CODES))
        for row in _sum_by_slot(codes.coalesce(tasks).mapInArrow(_table_blocks(bits), _ROW), tasks).select("slot", "a").toLocalIterator():
            table[row["slot"] * BLOCK : (row["slot"] + 1) * BLOCK] = packed(_widened(row["a"]).reshape(-1, 2))
        mixer = Mixer(table, bits)
        read = context.broadcast(mixer)
        learned = codes.mapInArrow(_learned(read), _ROW)
        # neighbouring ranges make a group
        fan = max(1, int(ranges**0.5))
        groups = learned.select((F.col("slot").cast("long") * fan / F.lit(ranges)).cast("int").alias("g"), "slot", "a", "b")
        trained = groups.groupBy("g").applyInArrow(_averaged, _ROW).select("slot", "a", "b").toArrow()
        if trained.num_rows:
            found = np.frombuffer(_averaged((pa.scalar(0),), trained)["a"][0].as_buffer(), np.float64)
        else:
            found = np.concatenate((np.full(GATES * PREDICTORS, 0.3), np.zeros(2 * 256 * BINS)))
    mixer.weights = found[: GATES * PREDICTORS].reshape(mixer.weights.shape).astype(np.float32)
    mixer.set_map(found[GATES * PREDICTORS :].reshape(2, -1))
    return Model(mixer.freeze(), vocabulary, ranges, tokens, words, (hot_words[order], hot_counts[order]))


_HEAD = "chunk bigint, slot int, ids binary, a binary, b binary, c binary"


def _score_kernel(model, ranges: int):
    """Slot -1: a batch's ids, tokens, hot sums and bits. Other slots: occurrences of a range's words in a batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, hot_words, hot_counts = model.value
        pricer, number = pricer_of(mixer), TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            if not n:
                continue
            sums, known, tokens = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            rare_text, rare_word = [], []
            for lo, hi, data, offsets in tb.text_chunks(column):
                hashes, first = _word_hashes(data, offsets)
                count = np.diff(first)
                text = np.concatenate((np.repeat(np.arange(lo, hi), count), np.arange(lo, hi)))
                hashes = np.concatenate((hashes, np.full(hi - lo, _END_WORD)))
                tokens[lo:hi] = count + 1
                if len(hot_words):
                    at = np.minimum(np.searchsorted(hot_words, hashes), len(hot_words) - 1)
                    is_hot = hot_words[at] == hashes
                    sums += np.bincount(text[is_hot], np.log10(hot_counts[at[is_hot]] + 1.0), n)
                    known += np.bincount(text[is_hot], minlength=n)
                    text, hashes = text[~is_hot], hashes[~is_hot]
                rare_text.append(text.astype(np.uint32))
                rare_word.append(hashes)
            bits = pricer.bits(column)
            rows = [(number, -1, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), tokens.tobytes(), np.stack((sums, known.astype(np.float64))).tobytes(), bits.tobytes())]
            text, word = np.concatenate(rare_text), np.concatenate(rare_word)
            order = np.argsort(word)
            text, word = text[order], word[order]
            words, times = _distinct(word)
            at = _bounds(words, ranges)
            upto = np.concatenate(([0], np.cumsum(times)))
            for r in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[r], at[r + 1])
                rows.append((number, r, None, words[own].tobytes(), times[own].astype(np.uint32).tobytes(), text[upto[at[r]] : upto[at[r + 1]]].tobytes()))
            number += 1
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "slot", "ids", "a", "b", "c"])

    return kernel


def _range_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each batch with words of a range: its texts, sums of log10(c + 1) and known tokens."""
    out = []
    if left.num_rows:
        words = np.frombuffer(left["words"][0].as_buffer(), np.uint64)
        counts = np.frombuffer(left["counts"][0].as_buffer(), np.int64)
        for chunk, a, b, c in zip(right["chunk"].to_pylist(), right["a"], right["b"], right["c"], strict=True):
            asked, times = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint32)
            at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
            n = np.repeat(np.where(words[at] == asked, counts[at], 0), times)
            texts, place = np.unique(np.frombuffer(c.as_buffer(), np.uint32), return_inverse=True)
            sums = np.bincount(place, np.log10(n + 1.0), len(texts))
            out.append((chunk, texts.tobytes(), sums.tobytes(), np.bincount(place, n > 0, len(texts)).astype(np.uint32).tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["chunk", "texts", "sums", "known"])


_SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _assemble(tokens: int, words: int):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[], [], [], []]
        for k in range(left.num_rows):
            ids = np.frombuffer(left["ids"][k].as_buffer(), np.int64)
            own = np.frombuffer(left["a"][k].as_buffer(), np.int64)
            sums, known = np.frombuffer(left["b"][k].as_buffer(), np.float64).reshape(2, -1).copy()
            for a, b, c in zip(right["texts"], right["sums"], right["known"], strict=True):
                at = np.frombuffer(a.as_buffer(), np.uint32)
                sums[at] += np.frombuffer(b.as_buffer(), np.float64)
                known[at] += np.frombuffer(c.as_buffer(), np.uint32)
            bits = np.frombuffer(left["c"][k].as_buffer(), np.float64)
            score = -bits * np.log10(2.0)
            for into, values in zip(parts, (ids, own, known.astype(np.int64), np.stack((sums - own * np.log10(tokens + words + 1.0), score))), strict=True):
                into.append(values)
        if not parts[0]:
            parts = [[np.zeros(0, np.int64)]] * 3 + [[np.zeros((2, 0))]]
        ids, own, known = (np.concatenate(x) for x in parts[:3])
        base, score = np.concatenate(parts[3], axis=1)
        return pa.table([pa.array(x) for x in (ids, own, known, np.full(len(ids), tokens), base, score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return kernel


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    read = docs.sparkSession.sparkContext.broadcast((model.mixer, *model.hot))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(_score_kernel(read, model.ranges), _HEAD), "lm-scores")
    asked = rows.where("slot >= 0").select("slot", "chunk", "a", "b", "c")
    sums = model.vocabulary.select("slot", "words", "counts").groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(_range_sums, "chunk bigint, texts binary, sums binary, known binary")
    heads = rows.where("slot = -1").select("chunk", "ids", "a", "b", "c")
    scored = heads.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_assemble(model.tokens, model.words), _SCORES)
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
