"""Vectorised word and n-gram hashing over Arrow batches of texts. Whole texts; no text is ever cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text handled at once inside a task. A longer single text is still taken whole.
SLICE_BYTES = 1 << 20


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to a word. ``space``: all but x20 and x09-x0D. ``alnum``: 0-9, A-Z, a-z and every byte over x7F."""
    t = np.zeros(256, bool)
    if kind == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


SPACE, ALNUM = word_table("space"), word_table("alnum")
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_pows: dict[int, np.ndarray] = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    got = _pows.get(int(base))
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _pows[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes (base power series modulo 2**64) of values[starts:ends], from one prefix sum."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _pow(_BASE, n), dtype=np.uint64, out=prefix[1:])
    inv = _pow(_INV, n + 1)
    return (prefix[ends] - prefix[starts]) * inv[starts]


class Words:
    """The words of a run of texts: byte spans in one buffer, a hash each, and for each text its first word and count."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool, hashed: bool = True):
        data = b"\n".join(texts)
        if lower:
            data = data.translate(LOWER)
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = table[buf]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        self.first = np.searchsorted(self.starts, begin)
        self.count = np.diff(np.append(self.first, len(self.starts)))
        if hashed:
            self.hash = mix(spans_hash(_BYTE[buf], self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of ``size`` words that lies inside one text."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.first + self.count, self.count) - np.arange(n)
        at = np.flatnonzero(left >= size)
        return at, mix(spans_hash(self.hash, at, at + size) + np.uint64(size))


def values(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column, or, dotted, a field of a struct column."""
    first, *rest = column.split(".")
    out = batch[first]
    for name in rest:
        out = pc.struct_field(out, name)
    return out


def carried(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with its kept columns in one struct, ``kept``, so that no name of theirs can meet one of an operator's; and
    the path of ``text`` (a column, or a field of a struct column) in it: text that is kept travels once."""
    first = text.split(".")[0]
    own = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")
    if first in keep:
        return docs.select(own), f"kept.{text}"
    return docs.select(own, F.col(text).alias("body")), "body"


def released(found: DataFrame, results: dict[str, Column]) -> DataFrame:
    """The kept columns and the results. A kept column that is named like a result gives way to it."""
    taken = {x.lower() for x in results}
    kept = [F.col("kept").getField(f.name).alias(f.name) for f in found.schema["kept"].dataType.fields if f.name.lower() not in taken]
    return found.select(*kept, *(c.alias(name) for name, c in results.items()))


def with_fields(rows: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``kept`` and the fields (name, type) that a task adds."""
    return T.StructType([rows.schema["kept"], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)).fields])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take ``limit`` bytes at most, or a single row."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(values(batch, column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in pc.cast(values(batch, column), pa.large_binary()).to_pylist()]


def as_str(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in values(batch, column).to_pylist()]


#: Texts that a task remembers, so that it looks at each of many copies once.
SEEN = 1 << 16


def unseen(keys: list[int], bodies: list[bytes], seen: set) -> list[int]:
    """Which of the texts a task has not had, by key and a hash of its own; ``seen`` begins anew when it is full, which
    costs a look at a copy and changes no result."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for i, told in enumerate(zip(keys, map(hash, bodies))):
        if told not in seen:
            seen.add(told)
            out.append(i)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
