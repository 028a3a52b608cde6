"""Near-duplicate detection by HyperMinHash sketches, banding and exact verification.

A text's set holds the hashes of its distinct runs of WIDTH words (of its whole
word sequence, if shorter). The leading bits of a hash name a register; of the
smallest rest in a register the sketch keeps the count of leading zeros and the
next MANTISSA bits. Empty registers borrow from the next filled one for banding.

1. Texts with equal sets form a class, named by a 64-bit digest of the set.
2. Registers are banded; a bucket is all classes with equal bands. Every class
   of a bucket is compared with the bucket's centre, the one with most
   neighbours over all its buckets: rows follow classes times bands.
3. A pair is kept if its Jaccard estimate, corrected for registers that agree by
   chance, is within MARGIN standard errors of the threshold; then it is
   confirmed on the full sets. Confirmed links give components, by minimum
   labels and pointer jumping over DataFrames.
4. What the centres leave apart is settled in full: all pairs of each bucket
   whose ends are in different components. First the shingles of these classes
   are counted: a shingle that only one component holds can be in no further
   link, and a class with too few others is done. The rest meet in pieces of at
   most about PIECE members, outsiders with all members, so that sketches and sets
   travel with members and not with pairs; sizes and shingle counts bound a
   pair's similarity before its estimate is taken, and it is confirmed where it
   is met. No bucket's size changes a result.

A pair at the threshold shares a band with probability above 1 - 1e-6. The work
of the last step grows with members times outsiders of the same bucket that the
shingle counts leave, which a bucket of mutually different texts does not have.

Whole texts are not shuffled for the sets, which are worked out where a text is
read; bits of the wanted keys (keybits.py) keep other rows out of the shuffles of
band rows and sets. In deduplicated only rows whose component may hold others travel.

Written tables are deleted as soon as the next ones stand.

Defined results: null, empty and wordless texts have no shingle and are linked
with nothing; rows that repeat a doc_id are judged by their own texts, and are
in one component only if these link; rows without doc_id are linked with nothing
and kept; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb
from vellum.llm.keybits import key_bits, marked, possible
from vellum.llm.runtime import Scratch, unused, written

WIDTH = 5
#: What a text with a word holds.
WORD = r"[^\x20\x09-\x0D]"
THRESHOLD_PERCENT = 85
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
#: Registers of a band: texts that share a passage only should not share a bucket.
BAND = 8
#: Bands of neighbouring registers, then bands over the registers in another order.
BAND_ORDERS = np.concatenate((np.arange(REGISTERS), np.arange(REGISTERS // 2) * 37 % REGISTERS))
BANDS = len(BAND_ORDERS) // BAND
#: Members of a bucket that meet others at once.
PIECE = 256
MARGIN = 5.0
_EMPTY = 0xFFFF
#: Chance that two registers agree though their smallest hashes differ: 0.17 * 2**-MANTISSA (Yu and Weber 2020).
CHANCE = 0.169919487159739 / (1 << MANTISSA)
_TEXTS = 1 << 10


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes sorted by text and value without repeats, first of each text and the end, bits of a hash that are lost)."""
    n = len(offsets) - 1
    data = tb.lower(data)
    starts, ends, first = tb.words(data, offsets, tb.SPACE_SEPARATED)
    words = tb.span_hashes(data, starts, ends)
    count = np.diff(first)
    runs = np.maximum(count - width + 1, 0)
    text = np.repeat(np.arange(n), runs)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    hashes = tb.window_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = []
        for k in short.tolist():
            own = words[first[k] : first[k + 1]]
            whole.append(tb.mix(tb.window_hashes(own, len(own)) + np.uint64(len(own)))[0])
        text, hashes = np.concatenate((text, short)), np.concatenate((hashes, np.array(whole, np.uint64)))
    lost = max(1, n.bit_length())
    codes = np.sort((text.astype(np.uint64) << np.uint64(64 - lost)) | (hashes >> np.uint64(lost)))
    codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes
    return codes, np.searchsorted(codes, np.arange(n + 1, dtype=np.uint64) << np.uint64(64 - lost)), lost


def sketches(codes: np.ndarray, first: np.ndarray, lost: int) -> np.ndarray:
    """Registers of each text, 16 bits each: leading zeros above mantissa; all ones if empty."""
    n = len(first) - 1
    out = np.full(n * REGISTERS, _EMPTY, np.uint16)
    if len(codes):
        place = codes >> np.uint64(64 - lost - REGISTER_BITS)
        smallest = np.concatenate(([True], place[1:] != place[:-1]))
        rest = (codes[smallest] << np.uint64(lost + REGISTER_BITS)) >> np.uint64(12)
        power = np.frexp(rest.astype(np.float64))[1]
        zeros = (52 - power).astype(np.uint64)
        mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << 52) - 1)) >> np.uint64(52 - MANTISSA)
        out[place[smallest].astype(np.int64)] = (np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out.reshape(n, REGISTERS)


def bands(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of each text's bands; empty registers take the next filled one's value, with its distance."""
    n = len(registers)
    filled = registers != _EMPTY
    place = np.where(np.concatenate((filled, filled), axis=1), np.arange(2 * REGISTERS), 4 * REGISTERS)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    distance = np.minimum(nearest - np.arange(REGISTERS), REGISTERS)
    values = np.take_along_axis(registers, nearest % REGISTERS, axis=1).astype(np.uint64) << np.uint64(REGISTER_BITS + 1) | distance.astype(np.uint64)
    values = values[:, BAND_ORDERS]
    keys = np.zeros((n, BANDS), np.uint64) + tb.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for k in range(BAND):
        keys = tb.mix(keys ^ values[:, k::BAND])
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers it rests on) of rows of registers."""
    either = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    same = ((a == b) & (a != _EMPTY)).sum(axis=1)
    share = same / np.maximum(either, 1)
    return np.clip((share - CHANCE) / (1 - CHANCE), 0, 1), either


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tb.text_chunks(batch.column(1)):
            for a in range(0, hi - lo, _TEXTS):
                b = min(a + _TEXTS, hi - lo)
                own = offsets[a : b + 1]
                codes, first, lost = shingle_sets(data[own[0] : own[-1]], own - own[0])
                registers = sketches(codes, first, lost)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), b - a, [None, pa.py_buffer(registers.tobytes())]).cast(pa.binary())
                ids = [batch.column(k).slice(lo + a, b - a) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(first)), pa.array(set_digests(codes, first, lost)), sketch], names=["doc_id", "text_hash", "n_shingles", "cls", "sketch"])


def set_digests(codes: np.ndarray, first: np.ndarray, lost: int) -> np.ndarray:
    """A 64-bit name of each text's set, the same whatever texts it is worked out with."""
    # a code holds its text's number, so the hash is taken without it
    mixed = tb.mix((codes << np.uint64(lost)) >> np.uint64(16))
    one, two = (np.diff(np.concatenate(([np.uint64(0)], np.cumsum(m)))[first]) for m in (mixed, tb.mix(mixed + np.uint64(1))))
    return tb.mix(one ^ tb.mix(two + np.diff(first).astype(np.uint64))).view(np.int64)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            cls, own = np.unique(part.column(0).to_numpy(), return_index=True)
            keys = bands(_registers(part.column(1).take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cls, keys.shape[1]))], names=["bucket", "cls"])


def _near(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether an estimate is near enough to the threshold."""
    bar = THRESHOLD_PERCENT / 100
    return share >= bar - MARGIN * np.sqrt(bar * (1 - bar) / np.maximum(n, 1))


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            yield part.select([0, 1]).filter(pa.array(_near(*estimate(_registers(part.column(2)), _registers(part.column(3))))))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts, each with its digest and size."""
    for batch in batches:
        data, offsets = tb.utf8(batch.column(0))
        for k in range(batch.num_rows):
            own = data[offsets[k] : offsets[k + 1]]
            codes, first, lost = shingle_sets(own, np.array([0, len(own)]))
            if len(codes):
                shingles = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array((codes << np.uint64(lost)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(codes, first, lost)), pa.array([len(codes)]), shingles], names=["cls", "size", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            if THRESHOLD_PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
                good.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= THRESHOLD_PERCENT * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes in links (a, b)."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.written(both, "edges")
    table = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("was"))
        step = scratch.written(step, "labels")
        scratch.drop(table)
        table = step
        if step.where("label <> was").isEmpty():
            scratch.drop(both)
            return step.select("node", "label")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each class with the centre of each of its buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    neighbours = members.join(sizes, "bucket").groupBy("cls").agg(F.sum("n").alias("n"))
    most = F.struct("n", F.xxhash64("cls"))
    centres = members.join(neighbours, "cls").groupBy("bucket").agg(F.max_by("cls", most).alias("centre"))
    pairs = members.join(centres, "bucket").where("cls <> centre")
    return pairs.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _across(key: tuple, members: pa.Table) -> pa.Table:
    """Links between different components of two pieces of a bucket: outsiders, and members of any kind."""
    members = members.combine_chunks()
    cls, label, size, shared = (members[c].to_numpy() for c in ("cls", "label", "size", "shared"))
    few, outside = (members[c].to_numpy(zero_copy_only=False) for c in ("few", "outside"))
    rows, many = np.flatnonzero(few), np.flatnonzero(~few)
    out: list[tuple[int, int]] = []
    if len(rows) and len(many):
        registers = _registers(members["sketch"])
        keys = bands(registers)
        band = int(np.argmax(keys[0].view(np.int64) == key[0].as_py()))
        flat = members["shingles"].combine_chunks()
        first, shingles = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        for x in rows.tolist():
            # both hold no more of each other than what either shares with other components
            both = np.minimum(shared[x], shared[many])
            y = many[(label[many] != label[x]) & (~outside[many] | (cls[many] > cls[x])) & (100 * both >= THRESHOLD_PERCENT * (size[x] + size[many] - both))]
            # a pair that shares several bands is met in the first
            y = y[np.argmax(keys[y] == keys[x], axis=1) == band] if len(y) else y
            y = y[_near(*estimate(registers[y], registers[x : x + 1]))] if len(y) else y
            own = shingles[first[x] : first[x + 1]]
            for k in y.tolist():
                n = _common(own, shingles[first[k] : first[k + 1]])
                if 100 * n >= THRESHOLD_PERCENT * (size[x] + size[k] - n):
                    out.append((int(min(cls[x], cls[k])), int(max(cls[x], cls[k]))))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared_counts(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, label, size of the set, and an upper bound (shared) of its shingles that other components hold too; classes has cls and label."""
    shingles = classes.join(sets.select("cls", "shingles"), "cls").select("cls", "label", F.explode("shingles").alias("shingle"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "cls") for f in (F.min, F.max)]
    alone = shingles.groupBy("shingle").agg(*ends).where("min_label = max_label")
    # of the classes of one component that hold a shingle, two are named without a join
    alone = alone.select(F.explode(F.array_distinct(F.array("min_cls", "max_cls"))).alias("cls")).groupBy("cls").agg(F.count("*").alias("alone"))
    own = classes.join(sets.select("cls", "size"), "cls").join(alone, "cls", "left")
    return own.select("cls", "label", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _across_links(members: DataFrame, sketch_of: DataFrame, sets: DataFrame) -> DataFrame:
    """All links of each bucket whose ends are in different components.

    members has bucket, cls, label, size and shared. The members outside a
    bucket's main component meet all its members, piece by piece."""
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = by_label.groupBy("bucket").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > most")
    pieces = [F.ceil(x / F.lit(PIECE)).cast("int") for x in (F.col("n") - F.col("most"), F.col("n"))]
    open_ = open_.select("bucket", "main", pieces[0].alias("fews"), pieces[1].alias("manys"))
    member = members.join(open_, "bucket").withColumn("outside", F.col("label") != F.col("main"))
    own = [F.pmod(F.xxhash64("cls"), F.col(x)).cast("int") for x in ("fews", "manys")]
    each = [F.sequence(F.lit(0), F.col(x) - 1) for x in ("fews", "manys")]
    pair = lambda p, q, few: F.struct(p.alias("p"), q.alias("q"), F.lit(few).alias("few"))
    as_few = F.when(F.col("outside"), F.transform(each[1], lambda q: pair(own[0], q, True)))
    as_many = F.transform(each[0], lambda p: pair(p, own[1], False))
    met = member.withColumn("at", F.explode(F.concat(F.coalesce(as_few, F.array().cast("array<struct<p:int,q:int,few:boolean>>")), as_many)))
    met = met.select("bucket", "at.p", "at.q", "at.few", "outside", "cls", "label", "size", "shared")
    met = met.join(sketch_of.join(sets.select("cls", "shingles"), "cls"), "cls")
    return met.groupBy("bucket", "p", "q").applyInArrow(_across, "a bigint, b bigint").distinct()


def _both_ends(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs a, b with a column of the table for either end."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("cls").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _confirm(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs that reach the threshold on their full sets."""
    pairs = scratch.written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    sets = possible(sets, key_bits(scratch.written, ends, "cls"), "cls")
    found = scratch.written(_both_ends(pairs, sets, "shingles").mapInArrow(_confirmed, "a bigint, b bigint"), "links")
    scratch.drop(pairs)
    return found


def _labels(scratch: Scratch, members: DataFrame, sketch_of: DataFrame, sets: DataFrame) -> DataFrame:
    """cls and label of all classes that share a bucket (members: bucket, cls); linked classes share a label."""
    pairs = scratch.written(_star_pairs(members), "stars")
    near = _both_ends(pairs, sketch_of, "sketch").mapInArrow(_promising, "a bigint, b bigint")
    found = _confirm(scratch, near, sets)
    scratch.drop(pairs)
    top = components(found, scratch)
    labels = members.select("cls").distinct().join(top.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"))
    labels = scratch.written(labels, "class-labels")
    labelled = scratch.written(members.join(labels, "cls"), "labelled")
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    unsettled = scratch.written(labelled.join(apart, "bucket", "left_semi").select("cls", "label").distinct(), "unsettled")
    able = _shared_counts(unsettled, possible(sets, key_bits(scratch.written, unsettled, "cls"), "cls")).where(100 * F.col("shared") >= THRESHOLD_PERCENT * F.col("size"))
    able = scratch.written(able, "able")
    across = labelled.select("bucket", "cls").join(able, "cls")
    bits = key_bits(scratch.written, able, "cls")
    more = scratch.written(_across_links(across, possible(sketch_of, bits, "cls"), possible(sets, bits, "cls")), "links")
    if more.isEmpty():
        return labels
    # links between components, as links between their labels
    ends = more
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("cls").alias(end), F.col("label").alias(f"label_{end}")), end)
    above = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), scratch)
    return labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left").select("cls", F.coalesce("above", "label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (columns doc_id, text).

    Also text_hash (xxhash64 of the text), component, a name of the component
    that no other has, even if repeated doc_ids give them one component_id, and
    component_rows, how many rows it has; both null for what is linked with nothing by rule."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        all_rows = scratch.written(hashed.mapInArrow(_sketch, "doc_id bigint, text_hash bigint, n_shingles bigint, cls bigint, sketch binary"), "sketches")
        own = all_rows.where("n_shingles > 0 and doc_id is not null")
        rows = own.select("cls", "sketch").mapInArrow(_band_rows, "bucket bigint, cls bigint")
        shared = rows.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("bucket")
        shared = scratch.written(shared, "shared-buckets")
        bits = key_bits(scratch.written, shared, "bucket")
        members = scratch.written(possible(rows, bits, "bucket").join(shared, "bucket", "left_semi").distinct(), "members")
        scratch.drop(shared)
        needed = members.select("cls").distinct()
        # one row of each class before the join, so that copies do not travel
        firsts = own.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")).join(needed, "cls", "left_semi")
        firsts = scratch.written(firsts, "class-sketches")
        texts = possible(docs.where("doc_id is not null"), key_bits(scratch.written, firsts, "doc_id"), "doc_id").select("text")
        sets = possible(texts.mapInArrow(_sets, "cls bigint, size bigint, shingles array<bigint>"), key_bits(scratch.written, firsts, "cls"), "cls")
        sets = scratch.written(sets.dropDuplicates(["cls"]), "shingle-sets")
        labels = _labels(scratch, members, firsts.select("cls", "sketch"), sets)
        classes = own.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")).join(labels, "cls", "left").select("cls", "doc_id", "rows", F.coalesce("label", "cls").alias("component"))
        classes = scratch.written(classes, "classes")
        smallest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("component_rows"))
        named = classes.join(smallest, "component").select("cls", "component_id", "component", "component_rows")
        ruled = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
        placed = all_rows.select("doc_id", "text_hash", "n_shingles", F.when(~ruled, F.col("cls")).alias("cls")).join(named, "cls", "left")
        placed = placed.withColumn("component_id", F.coalesce("component_id", "doc_id"))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        return written(placed.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", "component", "component_rows"), "near-duplicates")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of docs.

    Of rows with equal doc_id and text the one with the smallest hash of all
    columns stays. Rows without doc_id or words are linked with nothing and stay."""
    found = near_duplicates(docs.select("doc_id", "text"))
    doc_id, text_hash, row, crowded = unused(docs, "doc_id_of", "text_hash", "row", "crowded")
    stays = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    stays = stays.select(F.col("s.doc_id").alias(doc_id), F.col("s.text_hash").alias(text_hash))
    linkable = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # a row that is alone in its component stays where it is
    bits = key_bits(written, found.where("component_rows > 1"), "doc_id", "text_hash")
    all_rows = docs.withColumns({doc_id: F.col("doc_id").cast("long"), text_hash: F.xxhash64("text")})
    all_rows = marked(all_rows, bits, F.col(doc_id), F.col(text_hash), name=crowded)
    own = all_rows.where(linkable & F.col(crowded)).join(stays, [doc_id, text_hash], "left_semi")
    number = F.row_number().over(Window.partitionBy(doc_id, text_hash).orderBy(F.xxhash64(*docs.columns)))
    once = own.withColumn(row, number).where(F.col(row) == 1)
    return once.select(docs.columns).unionByName(all_rows.where(~(linkable & F.col(crowded))).select(docs.columns))
