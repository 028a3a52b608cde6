"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of orders 0 to ORDER, as counts of
(context, byte). The code length of a byte starts at its longest context that
the language has seen: a byte seen there costs -log2(c / (n + u)), else an
escape costs -log2(u / (n + u)) and the next shorter context is asked (n: bytes
seen after the context, u: distinct ones; method C, no exclusion), down to one
of 256 equal bytes. The statistics are frozen; the language with the shortest
code for the whole text is predicted. In a window of text each distinct context
is priced once.

The model is fitted on at most TRAIN_DOCS labelled documents of each language,
those with the smallest hash of their id, as far as their texts are within
TRAIN_BYTES together, which bounds the trees.

Defined results: `und` with score 0 for texts that are null or have no letter
and where nothing could be learned; ties go to the alphabetically first
language; rows that repeat are judged one by one; null labels teach nothing; an
empty table gives an empty result; only the key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.contexts import arrow_texts, sums_by_text, windows

ORDER = 4
TRAIN_DOCS = 1000
TRAIN_BYTES = 16 << 20
UNKNOWN = "und"
#: The score compares code lengths over so many bytes.
SCORE_BYTES = 32


class ContextTrees:
    """The trees of all languages over one set of keys: sorted codes, and a column of counts for each language."""

    def __init__(self, names: list[str], language: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        self.names, self.levels = names, []
        for order in range(ORDER, -1, -1):
            own = codes & np.uint64((1 << 8 * (order + 1)) - 1)
            keys, at = np.unique(own, return_inverse=True)
            seen = np.zeros((len(keys), len(names)), np.float32)
            np.add.at(seen, (at, language), counts)
            contexts, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
            totals, distinct = np.zeros((2, len(contexts), len(names)), np.float32)
            np.add.at(totals, parent, seen)
            np.add.at(distinct, parent, (seen > 0).astype(np.float32))
            self.levels.append((keys, seen, contexts, totals, distinct))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each code's last byte after the bytes before it, a column for each language."""
        bits = np.zeros((len(codes), len(self.names)), np.float32)
        pending = np.ones(bits.shape, bool)
        for order, (keys, seen, contexts, totals, distinct) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            own = codes & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == own >> np.uint64(8)
            n, u = totals[at] * known[:, None], distinct[at] * known[:, None]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            c = seen[at] * (keys[at] == own)[:, None]
            here = pending & (n > 0)
            bits += np.where(here, np.log2(n + u, where=n > 0, out=np.zeros_like(n)) - np.log2(np.where(c > 0, c, np.maximum(u, 1))), 0)
            pending &= ~(here & (c > 0))
        return bits + 8 * pending

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits by text and language, bytes by text)."""
        data, offsets = arrow_texts(column)
        out = np.zeros((len(column), len(self.names)))
        for a, _, codes in windows(data, offsets, ORDER):
            distinct, at = np.unique(codes, return_inverse=True)
            sums_by_text(self.bits(distinct)[at], a, offsets, out)
        return out, np.diff(offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0)
        for name in names.unique():
            data, offsets = arrow_texts(batch.filter(pc.equal(names, name)).column(1))
            for _, _, codes in windows(data, offsets, ORDER):
                keys, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def fit(labelled: DataFrame, label: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Trees of the languages in labelled rows (label, key, text)."""
    rows = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return None
    most = 1 << 30
    pairs = [F.lit(x) for name, n in sizes.items() for x in (name, min(most, int(1.3 * most * train_docs / n) + 1 if n > train_docs else most))]
    order = F.pmod(F.xxhash64(key), F.lit(most))
    near = rows.where(order < F.element_at(F.create_map(*pairs), F.col(label))).select(label, "text", order.alias("_order"), F.col(key).alias("_key"))
    # the filter above leaves about 1.3 * train_docs rows of each label to rank
    place = Window.partitionBy(label).orderBy("_order", "_key")
    near = near.withColumn("_row", F.row_number().over(place)).where(F.col("_row") <= train_docs)
    upto = F.sum(F.octet_length("text").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_bytes", upto).where(F.col("_bytes") <= train_bytes)
    counted = near.select(label, "text").mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sizes)
    encoded = counted["lang"].combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    place = np.array([names.index(x) for x in encoded.dictionary.to_pylist()], np.int64)
    return ContextTrees(names, place[encoded.indices.to_numpy()], counted["code"].to_numpy().view(np.uint64), counted["n"].to_numpy())


def _predict(key: str, trees):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: ContextTrees = trees.value
        names = pa.array(known.names)
        for batch in batches:
            bits, size = known.code_lengths(batch.column(1))
            best = bits.argmin(axis=1)
            behind = bits - bits.min(axis=1, keepdims=True)
            score = 1 / np.exp2(-np.minimum(behind * (SCORE_BYTES / np.maximum(size, SCORE_BYTES))[:, None], 1000)).sum(axis=1)
            lettered = batch.column(1).is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lettered, names.take(pa.array(best)), UNKNOWN), pc.if_else(lettered, pa.array(score), 0.0)], names=[key, "lang_pred", "score"])

    return kernel


def predict(docs: DataFrame, trees: ContextTrees | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every document; only its text is read."""
    kind = docs.schema[key].dataType.simpleString()
    lettered: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        return docs.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    texts = docs.select(key, F.when(lettered, F.col("text")).alias("text"))
    read = docs.sparkSession.sparkContext.broadcast(trees)
    return texts.mapInArrow(_predict(key, read), f"`{key}` {kind}, lang_pred string, score double")

