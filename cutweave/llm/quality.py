"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates and
scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cutweave.llm.text import SPACE, Words, as_bytes, carried, mix, released, slices, with_fields

BITS = 18
#: At most so many labelled documents are fitted on, the first in the order of a hash of their ids.
MAX_TRAIN = 8192
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.3, 1.0, 0.02, 0.02, 8.0
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4; a null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _shapes(w: Words) -> np.ndarray:
    """What a word looks like: classes of its first two bytes, and its last bytes where they are ASCII symbols."""
    buf = np.frombuffer(w.data, np.uint8)
    kind = np.zeros(256, np.uint64)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 4
    code = np.arange(256, dtype=np.uint64)
    code[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = 0
    n = w.ends - w.starts
    second, last, before = (buf[np.maximum(w.starts, i)] for i in (np.minimum(w.starts + 1, w.ends - 1), w.ends - 1, w.ends - 2))
    return ((kind[buf[w.starts]] * np.uint64(8) + kind[second]) * np.uint64(256) + code[last]) * np.uint64(256) + code[before] + (np.minimum(n, 24) // 6).astype(np.uint64) * np.uint64(1 << 40)


def features(w: Words) -> np.ndarray:
    """Three hashed features a word (rows) within 2**BITS: the word, it with the next, and its shape with the next's.
    A text's last word is paired with nothing."""
    n = len(w.starts)
    if not n:
        return np.zeros((0, 3), np.int64)
    shape = mix(_shapes(w))
    final = np.zeros(n, bool)
    final[(w.first + w.count - 1)[w.count > 0]] = True
    after = lambda x: np.where(final, np.uint64(0), np.roll(x, -1))
    k = np.uint64(0x9E3779B97F4A7C15)
    grams = [w.hash, mix(w.hash * k + after(w.hash)), mix(shape * k + after(shape) + np.uint64(1))]
    return np.stack([(g >> np.uint64(64 - BITS)).astype(np.int64) for g in grams], 1)


def _train_rows(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(as_bytes(part), SPACE, lower=False)
                f = features(w)
                idx, val = [], []
                for i, n in zip(w.first, w.count):
                    u, c = np.unique(f[i : i + n], return_counts=True)
                    idx.append(u.astype("<i4").tobytes())
                    val.append((c * (SCALE / max(n, 1))).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part["ord"], part["label"], pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["ord", "label", "idx", "val"])

    return train.select("ord", "label", "text").mapInArrow(run, "ord long, label int, idx binary, val binary")


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over (label, indices, values); slot 2**BITS is the bias, which L1 spares."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= l1[i]] = 0.0
        return w

    for _ in range(epochs):
        for label, i, x in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Fit on ``max_train`` labelled documents at most that aren't held out, in one task bounded by that parameter.

    ``labels``: doc_id, quality; null in either is no label, and of several for a document the largest counts. Only
    the text of a document makes features; null and empty texts have none but the bias. Rows that repeat an id are
    fitted on each. Without labels, or with an empty table of documents, the weights are all 0, and every score 0.5.
    Other columns of either table are ignored. Rows come in the order of a hash of their id, then of their features, so
    neither partitioning nor retries change the weights.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    ids = ids.withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(max_train)
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = _train_rows(train).coalesce(64).repartition(1).sortWithinPartitions("ord", F.xxhash64("idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        bias = np.array([1 << BITS]), np.array([1.0])
        for b in batches:
            for label, i, x in zip(b["label"].to_pylist(), b["idx"].to_pylist(), b["val"].to_pylist()):
                got.append((label, np.append(np.frombuffer(i, "<i4"), bias[0]), np.append(np.frombuffer(x, "<f4"), bias[1])))
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(got).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    fitted = rows.mapInArrow(run, "weights binary").first()
    return np.frombuffer(fitted["weights"], "<f4") if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (default doc_id) and score, the probability of label 1, rounded to 9 places. Narrow; the weights, of
    fixed size, are broadcast.

    A text's score comes of its own words alone. Null and empty texts get the score of the bias; very long texts are
    scored whole; repeated rows repeat; a null id stays null; an empty table gives an empty one. A kept column named
    score gives way to the result; to keep all columns whatever their names, pass them as one struct (``text`` may be a
    path in it).
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows, path = carried(docs, keep or ["doc_id"], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value.astype(np.float64)
        for batch in batches:
            for part in slices(batch, path):
                w = Words(as_bytes(part, path), SPACE, lower=False)
                dot, some = np.zeros(len(w.count)), w.count > 0
                if some.any():
                    dot[some] = np.add.reduceat(weight[features(w)].sum(1), w.first[some])
                dot = dot * (SCALE / np.maximum(w.count, 1)) + weight[-1]
                yield pa.RecordBatch.from_arrays([part["kept"], pa.array(np.round(1 / (1 + np.exp(-np.clip(dot, -35, 35))), 9))], names=["kept", "score"])

    return released(rows.mapInArrow(run, with_fields(rows, ("score", "double"))), {"score": F.col("score")})
