"""Leaving rows out of a shuffle: one bit for each place that a wanted key's hash takes.

The bits are a small broadcast table. A row whose bit is not set has no wanted
key for sure; a row whose bit is set may have one, and an exact join decides. So
the bits change what travels and never a result: with few bits for many keys more
rows travel, none is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.runtime import unused

#: Bits for each key, so that about one other row in 32 seems wanted.
BITS_A_KEY = 32
#: Most bits in all (16 MB): what each executor holds.
MOST_BITS = 1 << 27
#: Words of 64 bits in a row of the table.
WORDS = 128


@dataclass
class KeyBits:
    #: chunk and words (an array of WORDS longs)
    table: DataFrame
    chunks: int

    def place(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.chunks * WORDS * 64))


def _bit(place: Column) -> Column:
    return place.bitwiseAND(F.lit(63)).cast("int")


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")


def key_bits(write: Callable, keys: DataFrame, *key: str) -> KeyBits:
    """Bits of all rows of keys, which are read twice; null keys have one too."""
    bits = KeyBits(keys, -(-min(max(1, keys.count()) * BITS_A_KEY, MOST_BITS) // (WORDS * 64)))
    place = bits.place(*[F.col(k) for k in key])
    words = keys.select(F.shiftright(place, 13).cast("int").alias("chunk"), _word(place).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(place)).alias("bit"))
    words = words.groupBy("chunk", "word").agg(F.bit_or("bit").alias("bits"))
    set_ = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("of", w), F.lit(0).cast("long")))
    bits.table = write(set_.select("chunk", every.alias("words")), "key-bits")
    return bits


def marked(rows: DataFrame, bits: KeyBits, *key: Column, name: str) -> DataFrame:
    """The rows, with a column of that name: false if the key is none of the wanted ones for sure."""
    place, chunk, words = unused(rows.select("*", F.lit(0).alias(name)), "place", "chunk", "words")
    table = bits.table.select(F.col("chunk").alias(chunk), F.col("words").alias(words))
    placed = rows.withColumn(place, bits.place(*key)).withColumn(chunk, F.shiftright(place, 13).cast("int")).join(F.broadcast(table), chunk, "left")
    is_set = F.call_function("shiftright", F.get(words, _word(F.col(place))), _bit(F.col(place))).bitwiseAND(F.lit(1)) == 1
    return placed.withColumn(name, F.coalesce(is_set, F.lit(False))).select(*rows.columns, name)


def possible(rows: DataFrame, bits: KeyBits, *key: str) -> DataFrame:
    """The rows that may have a wanted key: all that have one and a few others."""
    name = unused(rows, "wanted")[0]
    return marked(rows, bits, *[F.col(k) for k in key], name=name).where(F.col(name)).select(rows.columns)
