"""URL filter: exact membership in a list of hosts by a cascade of Bloom filters.

The keys that can ever be asked are known: the distinct hosts of the corpus.
Level 1 encodes the listed keys; level 2 the unlisted keys that level 1 lets
through; level 3 the listed keys that level 2 lets through; and so on until
nothing is let through wrongly. A key is judged by the first level that rejects
it, so every key of the universe gets its exact answer without a join.

Bits are set by partial aggregation (bit_or by word of the filter); the driver
holds one filter, whose bytes are bounded by MAX_FILTER_BYTES: where the listed
keys, or the unlisted ones that level 1 is expected to let through, need more,
keys are split by hash into segments with a cascade each, and each segment of
the rows is judged in its own branch. Keys are 64-bit hashes of hosts: two hosts
of one hash are one key.

Defined results: null urls and urls without "://" have empty host and path; an
empty list lists nothing; null hosts and listed hosts that no row has change
nothing; repeated rows and list entries are judged one by one; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb
from vellum.llm.runtime import unused, written

BITS_PER_KEY = 10
HASHES = 5
MAX_FILTER_BYTES = 16 << 20
MAX_LEVELS = 60
#: Share of unlisted keys that level 1 lets through, with room: 0.94 % at 10 bits and 5 hashes.
EXPECTED_PASSES = 0.0125


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, small), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host, path)."""
    found_rule, found_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found_rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found_rule)
        found_verdict = F.when(fits, F.lit(verdict)).otherwise(found_verdict)
    return found_rule, found_verdict


def _hashes(column: pa.Array) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in tb.text_chunks(column):
        out.append(tb.span_hashes(data, offsets[:-1], offsets[1:]))
    return np.concatenate(out)


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit positions of each key in a level, a column for each hash."""
    seeds = tb.mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1000 * (level + 1)))
    return (tb.mix(keys[:, None] ^ seeds[None, :]) % np.uint64(size)).astype(np.int64)


class Cascade:
    """Filters in order of level, as arrays of 64-bit words."""

    def __init__(self, levels: list[np.ndarray] | None = None) -> None:
        self.levels = levels or []

    def passed(self, keys: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level]
        bits = _bits(keys, level, len(words) * 64)
        return ((words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """How many levels each key passes before the first that rejects it."""
        depth, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(len(self.levels)):
            open_ = open_[self.passed(keys[open_], level)]
            depth[open_] = level + 1
        return depth

    def listed(self, keys: np.ndarray) -> np.ndarray:
        # passing an odd number of levels: let in by a level of listed keys, not excepted by the next
        return self.depth(keys) % 2 == 1


def _survivors(cascade):
    """Of keys: those that every level so far lets through."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Cascade = cascade.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(known.depth(keys) == len(known.levels)))

    return kernel


def _bit_words(level: int, size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), level, size))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    return kernel


def _key_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0)).view(np.int64)), batch.column(1)], names=["key", "listed"])


def universe(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """key and listed of every distinct host of the rows; both inputs have a column host."""
    both = rows.select("host", F.lit(False).alias("listed")).distinct().unionAll(hosts.select("host", F.lit(True)).where("host is not null").distinct())
    keys = both.mapInArrow(_key_hashes, "key bigint, listed boolean")
    # a key that only the list has is never asked
    return keys.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("only")).where("not only").select("key", "listed")


def build(keys: DataFrame) -> list[Cascade]:
    """Cascades by segment over the whole universe; keys has key (64-bit hash) and listed, each key once."""
    spark = keys.sparkSession
    n_all, n_listed = keys.agg(F.count("*"), F.count_if("listed")).first()
    largest = max(n_listed, int((n_all - n_listed) * EXPECTED_PASSES))
    segments = max(1, -(-largest * BITS_PER_KEY // (8 * MAX_FILTER_BYTES)))
    cascades = []
    for segment in range(segments):
        own = keys.where(F.pmod("key", F.lit(segments)) == segment) if segments > 1 else keys
        sides = {True: own.where("listed").select("key"), False: own.where("not listed").select("key")}
        cascade, side = Cascade(), True
        while n := sides[side].count():
            if len(cascade.levels) >= MAX_LEVELS:
                raise ValueError("the levels do not end; keys must be distinct")
            words = max(1, -(-n * BITS_PER_KEY // 64))
            filled = sides[side].mapInArrow(_bit_words(len(cascade.levels), words * 64), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
            level = np.zeros(words, np.uint64)
            table = filled.toArrow()
            level[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
            cascade = Cascade([*cascade.levels, level])
            side = not side
            sides[side] = sides[side].mapInArrow(_survivors(spark.sparkContext.broadcast(cascade)), "key bigint")
        cascades.append(cascade)
    return cascades


def _judge(cascade, schema: list[str], into: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Cascade = cascade.value
        for batch in batches:
            listed = known.listed(_hashes(batch.column(schema.index("host"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed)], names=[*schema, into])

    return kernel


def mark_listed(rows: DataFrame, hosts: DataFrame) -> tuple[DataFrame, str]:
    """Rows (column host) with a boolean: is the host in the list (column host); and the name of that column, listed if free."""
    into = unused(rows, "listed")[0]
    keys = written(universe(rows, hosts), "cascade-keys")
    cascades = build(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` boolean"
    parts = []
    for segment, cascade in enumerate(cascades):
        own = rows
        if len(cascades) > 1:
            own = rows.mapInArrow(_in_segment(len(cascades), segment, rows.columns), rows.schema)
        parts.append(own.mapInArrow(_judge(rows.sparkSession.sparkContext.broadcast(cascade), rows.columns, into), schema))
    return reduce(DataFrame.unionAll, parts), into


def _in_segment(segments: int, segment: int, schema: list[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _hashes(batch.column(schema.index("host"))).view(np.int64)
            yield batch.filter(pa.array(keys % segments == segment))

    return kernel
