"""Token files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A block codes a run of documents by itself:
its tokens are dealt in turn to interleaved lanes, each a 63-bit state that sheds 32-bit words. At every checkpoint the
block records the states and the place in the word stream, and a CRC of each segment's tokens, so that segments can be
decoded side by side and are checked one by one. A file is a table of blocks, in ascending doc_id within and across shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cutweave.llm.text import slices
from cutweave.llm.tokens import default_path, encoder
from cutweave.session import materialise, new_path

MAGIC, VERSION = b"RANS", 1
SCALE_BITS, LOW = 20, 1 << 31
LANES, BLOCK_TOKENS, CHECKPOINT_STEPS = 2048, 1 << 20, 128
END_ID = 1
HEAD = struct.Struct("<4sHHIIQIII")  # magic, version, scale bits, lanes, checkpoint steps, tokens, words, documents, crc of the rest


class Table:
    """Frequencies scaled to 2**SCALE_BITS, none of a seen id under 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.float64)
        total, size = counts.sum(), 1 << SCALE_BITS
        freq = np.maximum(1, np.floor(counts * (size / total))).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        over = int(freq.sum()) - size
        if over > 0:  # the largest give what the smallest were raised by
            for i in np.argsort(-freq, kind="stable"):
                cut = min(over, int(freq[i]) - 1)
                freq[i] -= cut
                over -= cut
                if not over:
                    break
        elif len(freq):
            freq[np.argmax(freq)] -= over
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        dense = int(self.ids[-1]) + 1 if len(ids) else 0
        self.rank = np.zeros(dense, np.uint32)
        self.rank[self.ids] = np.arange(len(ids), dtype=np.uint32)

    def __reduce__(self):
        return _restore, (self.ids, self.freq)


def _restore(ids, freq):
    t = Table.__new__(Table)
    t.ids, t.freq = ids, freq
    t.cum = np.cumsum(freq, dtype=np.uint64) - freq
    t.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    t.rank = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.uint32)
    t.rank[ids] = np.arange(len(ids), dtype=np.uint32)
    return t


_M, _MASK = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
_SHED = np.uint64(63 - SCALE_BITS)


def encode_block(tokens: np.ndarray, doc_counts: np.ndarray, table: Table) -> bytes:
    """One block. Steps run backwards, so that decoding runs forwards."""
    n = len(tokens)
    lanes = min(LANES, max(1, n))
    steps = -(-n // lanes)
    sym = table.rank[tokens]
    state = np.full(lanes, LOW, np.uint64)
    words, marks = [], []
    n_words = 0
    for t in range(steps - 1, -1, -1):
        s = sym[t * lanes : (t + 1) * lanes]
        f, c, x = table.freq[s], table.cum[s], state[: len(s)]
        full = x >= f << _SHED
        if full.any():
            out = x[full].astype(np.uint32)  # the low 32 bits
            words.append(out)
            n_words += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(s)] = (q << _M) + (x - q * f) + c
        if t % CHECKPOINT_STEPS == 0:
            segment = tokens[t * lanes : (t + CHECKPOINT_STEPS) * lanes]
            marks.append((n_words, zlib.crc32(segment.astype("<u4").tobytes()), state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    told = b"".join(struct.pack("<II", n_words - at, crc) + states for at, crc, states in reversed(marks))
    rest = doc_counts.astype("<u4").tobytes() + told + stream
    return HEAD.pack(MAGIC, VERSION, SCALE_BITS, lanes, CHECKPOINT_STEPS, n, n_words, len(doc_counts), zlib.crc32(rest)) + rest


def decode_block(block: bytes, table: Table, segments: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents' counts; with ``segments`` the tokens of those alone. Any damage raises ValueError."""
    magic, version, bits, lanes, every, n, n_words, n_docs, crc = HEAD.unpack_from(block)
    rest = memoryview(block)[HEAD.size :]
    if (magic, version, bits) != (MAGIC, VERSION, SCALE_BITS) or zlib.crc32(rest) != crc:
        raise ValueError("not a whole block of this format")
    counts = np.frombuffer(rest, "<u4", n_docs)
    steps = -(-n // lanes)
    n_seg, size = -(-steps // every), 8 + 8 * lanes
    at = 4 * n_docs
    stream = np.frombuffer(rest, "<u4", n_words, at + n_seg * size)
    out = []
    for k in range(n_seg) if segments is None else segments:
        pos, want = struct.unpack_from("<II", rest, at + k * size)
        state = np.frombuffer(rest, "<u8", lanes, at + k * size + 8).copy()
        got = np.empty(min(n, (k + 1) * every * lanes) - k * every * lanes, np.uint32)
        for j in range(0, len(got), lanes):
            x = state[: min(lanes, len(got) - j)]
            low = x & _MASK
            s = table.slot[low]
            got[j : j + lanes] = s
            x = table.freq[s] * (x >> _M) + low - table.cum[s]
            empty = x < LOW
            m = int(np.count_nonzero(empty))
            if m:
                x[empty] = (x[empty] << np.uint64(32)) | stream[pos : pos + m]
                pos += m
            state[: len(x)] = x
        got = table.ids[got]
        if zlib.crc32(got.astype("<u4").tobytes()) != want:
            raise ValueError(f"segment {k} does not match its checksum")
        out.append(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, shards: int) -> DataFrame:
    """Uncoded blocks of all documents in order: shard, block, before (ids before it in its shard), n_tokens, doc_ids,
    counts (ids of each document) and ids, of 16 or 32 bits."""
    width = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[int] = []
        before = held = block = 0

        def flush():
            nonlocal ids, names, counts, before, held, block
            row = ((shard, pa.int32()), (block, pa.int32()), (before, pa.int64()), (held, pa.int64()), (names, pa.list_(pa.int64())), (counts, pa.list_(pa.int64())), (np.concatenate(ids).astype(width).tobytes(), pa.binary()))
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in row], names=["shard", "block", "before", "n_tokens", "doc_ids", "counts", "ids"])
            before, block, ids, names, counts, held = before + held, block + 1, [], [], [], 0
            return out

        for batch in batches:
            for part in slices(batch):
                got, count = enc.texts(part["text"], end_id)
                stop = np.cumsum(count)
                i = 0
                while i < len(count):
                    base = int(stop[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(stop, base + BLOCK_TOKENS - held, "right")))  # as many as fit, one at least
                    ids.append(got[base : int(stop[j - 1])])
                    names += part["doc_id"][i:j].to_pylist()
                    counts += count[i:j].tolist()
                    held += int(stop[j - 1]) - base
                    if held >= BLOCK_TOKENS or j < len(count):
                        yield flush()
                    i = j
        if held:
            yield flush()

    first = (F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, *first).sortWithinPartitions(*first, "text")
    return ordered.mapInArrow(run, "shard int, block int, before long, n_tokens long, doc_ids array<long>, counts array<long>, ids binary")


def id_type(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


def count_ids(blocks: DataFrame, width: str) -> Table:
    """The shared table: how often each id occurs, over all documents. Its rows are bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                seen = np.bincount(np.frombuffer(ids.as_buffer(), width))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Table(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> Table:
    """Encode all documents and write the token files at ``path``; returns the shared table, also kept there.

    The texts are sorted by range of doc_id (null first, ties by text) into ``shards``, tokenised once, and written as
    uncoded blocks; ids are counted over all of these, and each is coded by itself. A task holds one block at a time.
    Null text is empty and has the end id alone; repeated rows are coded once each; an empty table gives an empty file.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    width = id_type(tokenizer, end_id)
    blocks = materialise(token_blocks(docs, tokenizer, end_id, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))), "token-blocks")
    table = count_ids(blocks, width)
    shared = spark.sparkContext.broadcast(table)
    names = ["shard", "block", "before", "n_tokens", "doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                made = encode_block(np.frombuffer(row["ids"][0].as_buffer(), width), row["counts"][0].values.to_numpy(), shared.value)
                yield pa.RecordBatch.from_arrays([*(row[c] for c in names), pa.array([made], pa.binary())], names=[*names, "payload"])

    blocks.mapInArrow(run, "shard int, block int, before long, n_tokens long, doc_ids array<long>, payload binary").write.option("compression", "uncompressed").parquet(path + "/blocks")
    spark.createDataFrame([(table.ids.astype("<u4").tobytes(), table.freq.astype("<u8").tobytes())], "ids binary, freq binary").coalesce(1).write.parquet(path + "/table")
    return table


def read_table(spark: SparkSession, path: str) -> Table:
    row = spark.read.parquet(path + "/table").first()
    return _restore(np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["freq"], "<u8"))


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of the token files at ``path``: doc_id, start (ids before it in the whole file), n_tokens, and the
    ids, or with ``digest`` their crc32. Blocks are decoded apart from each other; a shard's start is the sum of the
    shards before it, a table of one row a shard."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.parquet(path + "/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts = decode_block(batch["payload"][i].as_py(), table)
                counts = counts.astype(np.int64)
                stop = np.cumsum(counts)
                data = ids.astype("<u4")
                docs = [data[a:b].tobytes() for a, b in zip((stop - counts).tolist(), stop.tolist())]
                last = pa.array([zlib.crc32(x) for x in docs], pa.int64()) if digest else pa.array(docs, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), batch["shard"][i].as_py(), np.int32)), pa.array(batch["doc_ids"][i].as_py(), pa.int64()), pa.array(batch["before"][i].as_py() + stop - counts), pa.array(counts), last], names=["shard", "doc_id", "at", "n_tokens", "last"])

    docs = blocks.select("shard", "before", "doc_ids", "payload").mapInArrow(run, f"shard int, doc_id long, at long, n_tokens long, last {'long' if digest else 'binary'}")
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("size")).collect()  # a row a shard
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        base[r["shard"]], total = total, total + r["size"]
    bases = spark.createDataFrame(list(base.items()), "shard int, base long")
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back as digests."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path, digest=True)
