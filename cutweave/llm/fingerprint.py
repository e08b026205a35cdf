"""Document fingerprints: canonical exact digests. Texts are put into one Unicode form, case and white space folded, and
digested by a 128-bit xxHash; within equal digests the canonical bytes themselves are compared."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import as_str, slices
from cutweave.session import materialise

#: The filter that says which digests occur more than once has 2 to the power of so many bits: 16 for each such digest, within
#: these bounds. Past the upper one more texts than need be are compared, and none fewer.
FILTER_BITS = (22, 26)


def canonical(text: str) -> bytes:
    """NFKC, full case folding, NFKC again, and each run of white space one space, none at the ends."""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: str, b: str) -> float:
    """Of exact fingerprints: 1 for equal ones, else 0."""
    return float(a == b)


def _bit(hexdigest: str, bits: int) -> int:
    return int(hexdigest[:8], 16) >> (32 - bits)


def repeated_filter(digests: DataFrame) -> tuple[int, np.ndarray]:
    """How many bits the filter has, as a power of 2, and which of them have a digest that more than one row has. Counted in
    Spark; a row for 32 bits returns, at most."""
    often = materialise(digests.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "often")
    bits = min(max(FILTER_BITS[0], (16 * often.count()).bit_length()), FILTER_BITS[1])
    bit = F.shiftright(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = often.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits, words


def collided(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests whose bucket holds different canonical bytes. Only texts of repeated digests are shuffled; the least and
    the greatest of a bucket's bytes differ exactly when any two do, so buckets combine before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, bodies = [], []
                for t in as_str(part):
                    body = canonical(t)
                    name = xxhash.xxh3_128_hexdigest(body)
                    bits, words = shared.value
                    b = _bit(name, bits)
                    if words[b >> 5] >> (b & 31) & 1:
                        names.append(name)
                        bodies.append(body)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["fingerprint", "body"])

    bodies = docs.select("text").mapInArrow(run, "fingerprint string, body binary")
    return bodies.groupBy("fingerprint").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("fingerprint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, group_id (least doc_id with that fingerprint) of every row.

    Null text is empty; the empty text has a fingerprint as any other. Rows with a null doc_id get one too, and don't
    name a group. Should two different canonical texts share a digest, each takes its SHA-256 after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = as_str(part)
                bodies = [canonical(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(b) for b in bodies]), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], names=["doc_id", "n_chars", "fingerprint", "sha"])

    made = materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string, sha string"), "prints")
    made = resolve(made, collided(docs, made), {"fingerprint": "sha"})
    return made.join(made.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint").select("doc_id", "n_chars", "fingerprint", "group_id")


def resolve(made: DataFrame, clash: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append the column named second to each fingerprint that is among ``clash``."""
    clash = materialise(clash, "clash")
    if clash.isEmpty():
        return made
    for name, sha in columns.items():
        hit = clash.select(F.col("fingerprint").alias(name), F.lit(True).alias("_hit"))
        made = made.join(hit, name, "left").withColumn(name, F.when(F.col("_hit"), F.concat_ws("-", name, sha)).otherwise(F.col(name))).drop("_hit")
    return made


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, sha string, edited_fingerprint string, edited_sha string, next_fingerprint string, next_sha string"


def _judge(doc_id: int | None, text: str, body: bytes, nxt: str, next_body: bytes) -> tuple:
    k = len(text) // 3
    edited = text[: len(text) - k] + nxt[:k]
    changed = canonical(edited)
    h, s = xxhash.xxh3_128_hexdigest, lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(text), s(edited.encode()), h(body), s(body), h(changed), s(changed), h(next_body), s(next_body)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op9: each text beside its edit, whose last third is taken from the next document's start.

    Rows are dealt by range of descending doc_id (null last; ties by a hash of the text, then the text, descending) and
    sorted, the one shuffle of texts. Null text is empty; long texts are taken whole, one at a time; other columns are ignored. A shard judges all its rows but the last, whose next stands at the head of a later shard: heads and tails,
    two rows a shard, are matched apart. A lone row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), order[1])
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = TaskContext.get().partitionId(), None

        def out(rows, edges):
            cols = list(zip(*rows)) if rows else [()] * 9
            m = len(rows)
            arrays = [pa.array([*c, *([e[1] if i == 0 else None for e in edges])], k) for i, (c, k) in enumerate(zip(cols, kinds))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([None] * m + [e[0] for e in edges], pa.string()), pa.array([shard] * (m + len(edges)), pa.int32()), pa.array([None] * m + [e[2] for e in edges], pa.string())], names=[*names, "edge", "shard", "edge_text"])

        for batch in batches:
            for part in slices(batch):
                rows, edges = [], []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    body = canonical(text)
                    if last is None:
                        edges.append(("head", doc_id, text))
                    else:
                        rows.append(_judge(*last, text, body))
                    last = doc_id, text, body
                yield out(rows, edges)
        if last is not None:
            yield out([], [("tail", last[0], last[1])])

    made = materialise(sorted_docs.mapInArrow(run, f"{_ROW}, edge string, shard int, edge_text string"), "edited")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_judge(i, t, canonical(t), u, canonical(u)) for i, t, u in zip(*(batch[c].to_pylist() for c in ("doc_id", "edge_text", "next_text")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds)], names=names)

    edges = made.where("edge is not null")
    shards = sorted(r["shard"] for r in edges.where("edge = 'head'").select("shard").collect())  # of bounded number
    following = spark.createDataFrame([(a, b) for a, b in zip(shards, shards[1:] + shards[:1])], "shard int, next_shard int")
    heads = edges.where("edge = 'head'").select(F.col("shard").alias("next_shard"), F.col("edge_text").alias("next_text"))
    tails = edges.where("edge = 'tail'").select("shard", "doc_id", "edge_text").join(following, "shard").join(heads, "next_shard").select("doc_id", "edge_text", "next_text")
    rows = made.where("edge is null").select(*names).unionByName(tails.mapInArrow(match, _ROW))
    rows = resolve(rows, collided(docs, made.where("edge is null or edge = 'tail'").select("fingerprint").where("fingerprint is not null")), {"fingerprint": "sha", "edited_fingerprint": "edited_sha", "next_fingerprint": "next_sha"})
    same = lambda a: (F.col("fingerprint") == F.col(a)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
