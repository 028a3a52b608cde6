"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by
its byte classes, word shapes, repetition and hashed words, and encoded as
h = tanh(W f + b). Gated attention (Ilse et al. 2018) weighs the passages by
softmax of w . (tanh(V h) * sigmoid(U h)); the weighted mean of h gives the
document's logit. All weights are learned together from document labels by
Adam, from a fixed seed.

The classifier is fitted on at most TRAIN_DOCS labelled documents, those with
the smallest hash of their id, and of these on the first with TRAIN_BYTES of
text together, which bounds what the driver gets; passages of whole texts are
encoded.

Defined results: null, empty and wordless texts are one passage without
features; documents without a label teach nothing; of several labels of one
document the smallest counts; without labels of both kinds every score is the
share of label 1, or 0.5; rows that repeat are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import textbytes as tb

PASSAGE = 64
BUCKETS = 64
WIDTH = 16
TRAIN_DOCS = 4000
TRAIN_BYTES = 64 << 20
EPOCHS = 40
BATCH_DOCS = 64
THRESHOLD = 0.7

# byte classes: fractions of a passage's bytes
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x80:] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20] = 4
_CLASS[[0x0A, 0x0D, 0x09]] = 5
_CLASS[[0x2E, 0x2C]] = 6
_CLASS[[0x3A, 0x3B, 0x21, 0x3F, 0x27, 0x22, 0x2D, 0x28, 0x29]] = 7
_CLASS[0x7C] = 8
_CLASSES = 10
_SHAPES = 9
FEATURES = _CLASSES + _SHAPES + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, first passage of each text and the end); every text has a passage."""
    n_texts = len(offsets) - 1
    starts, ends, first = tb.words(data, offsets, tb.SPACE_SEPARATED)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(n_passages)))
    total = int(base[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, base
    text = np.repeat(np.arange(n_texts), n_words)
    place = np.arange(len(starts)) - first[text]
    passage = base[text] + place // PASSAGE
    count = np.bincount(passage, minlength=total).astype(np.float64)
    some = count > 0
    per_word = 1 / np.maximum(count, 1)
    # bytes of a passage: from its first word to the next passage's, or the text's end
    head = np.flatnonzero(place % PASSAGE == 0)
    begin = starts[head]
    stop = np.concatenate((begin[1:], [len(data)]))
    stop = np.minimum(stop, offsets[text[head] + 1])
    bounds = np.empty(2 * len(head), np.int64)
    bounds[0::2], bounds[1::2] = begin, stop
    classes = np.concatenate((_CLASS[data], [_CLASSES]))
    size = (stop - begin).astype(np.float64)
    rows = passage[head]
    for k in range(_CLASSES):
        out[rows, k] = np.add.reduceat(classes == k, bounds, dtype=np.int64)[0::2] / size
    length = (ends - starts).astype(np.float64)
    hashes = tb.span_hashes(data, starts, ends)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=total) * per_word

    lead, tail = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    shapes = [mean(np.log1p(length)), mean(length <= 3), mean(length >= 12), mean(lead == 2), mean(tail >= 6), mean(tail >= 8)]
    _, once = np.unique(tb.mix(hashes ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    shapes.append(np.bincount(passage[once], minlength=total) * per_word)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    shapes.append(mean(again))
    shapes.append(np.repeat(np.log1p(n_words), n_passages) * some)
    for k, values in enumerate(shapes):
        out[:, _CLASSES + k] = values
    buckets = np.bincount(passage * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, _CLASSES + _SHAPES :] = buckets * per_word[:, None]
    return out, base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionMIL:
    def __init__(self, prior: float = 0.5) -> None:
        self.prior, self.weights = prior, None

    def _forward(self, x: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.weights, np.repeat(np.arange(len(base) - 1), np.diff(base))
        h = np.tanh(x @ p["W"] + p["b"])
        tanh, gate = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tanh * gate) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, base[:-1])[bag])
        a = e / np.add.reduceat(e, base[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, base[:-1])
        return {"h": h, "tanh": tanh, "gate": gate, "a": a, "z": z, "bag": bag, "score": _sigmoid(z @ p["c"] + p["d"])}

    def scores(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(base) - 1, self.prior)
        return self._forward(self._scaled(x), base)["score"].astype(np.float64)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def fit(self, x: np.ndarray, base: np.ndarray, labels: np.ndarray, seed: int = 1) -> None:
        self.prior = float(labels.mean())
        if len(set(labels.tolist())) < 2:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self._scaled(x)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = p = {"W": draw(x.shape[1], WIDTH), "b": np.zeros(WIDTH, np.float32), "V": draw(WIDTH, WIDTH), "U": draw(WIDTH, WIDTH), "w": draw(WIDTH), "c": draw(WIDTH), "d": np.zeros(1, np.float32)}
        moment = {k: np.zeros_like(v) for k, v in p.items()}
        square = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(labels))
            rate = 0.01 * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH_DOCS):
                docs = order[at : at + BATCH_DOCS]
                sizes = base[docs + 1] - base[docs]
                own = np.concatenate(([0], np.cumsum(sizes)))
                rows = np.repeat(base[docs] - own[:-1], sizes) + np.arange(own[-1])
                grads = self._gradients(x[rows], own, labels[docs])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * p[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    p[k] -= (rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, base: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self._forward(x, base)
        bag, h, a = f["bag"], f["h"], f["a"]
        error = (f["score"] - labels) / len(labels)
        into_z = error[:, None] * p["c"]
        to_h = a[:, None] * into_z[bag]
        to_a = (h * into_z[bag]).sum(axis=1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, base[:-1])[bag])
        gated = f["tanh"] * f["gate"]
        to_gated = to_e[:, None] * p["w"]
        to_v = to_gated * f["gate"] * (1 - f["tanh"] ** 2)
        to_u = to_gated * f["tanh"] * f["gate"] * (1 - f["gate"])
        to_h = (to_h + to_v @ p["V"].T + to_u @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ to_h, "b": to_h.sum(axis=0), "V": h.T @ to_v, "U": h.T @ to_u, "w": gated.T @ to_e, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tb.text_chunks(batch.column(1)):
            x, base = passages(data, offsets)
            rows = [x[base[k] : base[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["label", "features", "order"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> AttentionMIL:
    """Fit on documents whose key has a label of 0 or 1."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    most = 1 << 30
    order = F.pmod(F.xxhash64(key), F.lit(most))
    n = known.count()
    if n > train_docs:
        known = known.where(order < int(1.2 * most * train_docs / n)).orderBy(order, key).limit(train_docs)
    # at most train_docs rows of two numbers
    sizes = docs.select(key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size")).join(F.broadcast(known), key).groupBy(key).agg(F.first("_label").alias("_label"), F.sum("_size").alias("_size"))
    before = F.sum("_size").over(Window.orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1))
    known = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") + F.col("_size") <= train_bytes).select(key, "_label")
    chosen = docs.select(key, "text").join(F.broadcast(known), key).select("_label", "text", F.col(key).cast("string").alias("order"))
    table = chosen.mapInArrow(_encode, "label int, features binary, order string").toArrow()
    model = AttentionMIL()
    if table.num_rows:
        table = table.sort_by("order")
        bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in table["features"].to_pylist()]
        base = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
        model.fit(np.concatenate(bags), base, table["label"].to_numpy().astype(np.float32))
    return model


def _score(key: str, model):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: AttentionMIL = model.value
        for batch in batches:
            for lo, hi, data, offsets in tb.text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(known.scores(*passages(data, offsets)))], names=[key, "score"])

    return kernel


def score(docs: DataFrame, model: AttentionMIL, key: str = "doc_id") -> DataFrame:
    """key and score of every document; only its text is read."""
    kind = docs.schema[key].dataType.simpleString()
    read = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, "text").mapInArrow(_score(key, read), f"`{key}` {kind}, score double")


def _keep(model, threshold: float, at: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: AttentionMIL = model.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in tb.text_chunks(batch.column(at)):
                scores.append(known.scores(*passages(data, offsets)))
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return kernel


def accepted(docs: DataFrame, model: AttentionMIL, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least the threshold."""
    read = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(read, threshold, docs.columns.index("text")), docs.schema)
