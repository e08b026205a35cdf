"""Spelling variants: which words of the corpus differ by one edit. The edits of each word are generated and probed against
blocked Bloom filters of the vocabulary, one filter a word length; only those that a filter lets pass are shuffled, to an
exact join with the vocabulary.

A pair is generated from one side alone: by deletion from the longer word, by replacement with a later letter from the
other. The hash of an edited word comes from its word's running sums, so a probe costs the same at any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import LOWER, mix, values
from cutweave.session import discard, materialise

LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
#: Bytes of the filters that are broadcast at once; a larger vocabulary takes several passes.
FILTER_BYTES = 64 << 20
#: Distinct words that a task counts before it hands its counts on; probes in flight; the filter's chunks, in blocks.
HELD_WORDS, PROBES, CHUNK = 1 << 20, 1 << 21, 1 << 12
#: Bits of filter for each word, and for each word of over LONG code points, whose false positives would weigh more.
BITS, LONG, LONG_BITS = 16, 32, 64

_rng = np.random.default_rng(20240311)
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def run_pattern(least: int) -> re.Pattern[bytes]:
    """Runs of letters of so many code points or more, in Latin-1 bytes in which A-Z are lower-cased."""
    return re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)


def count_words(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text", doc_id: str = "doc_id", every: int = EVERY) -> DataFrame:
    """word, n: how often each word of ``least`` code points or more stands in the texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose hash with its document's id is
    divisible by ``every`` loses one code point. Null texts have none; a null id is empty in the hash.
    """
    pattern, ascii_only = run_pattern(least), re.compile(rb"[\x00-\x7f]*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, body in zip(batch["id"].to_pylist(), batch["text"]):
                body = (body.as_py() or "").encode("latin-1", "replace").translate(LOWER)
                prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                # a run that loses a point may fall under ``least``: it is counted, then left out below
                for w, n in Counter(m[0] for m in pattern.finditer(body)).items() if len(body) > 1 << 22 else Counter(pattern.findall(body)).items():
                    utf8 = w if ascii_only.fullmatch(w) else w.decode("latin-1").encode()
                    h = zlib.crc32(utf8, prefix)
                    if not h % every:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# filters


def _sums(w: np.ndarray) -> np.ndarray:
    """Running sums of the letters' numbers times powers; a row for each word, one more column than letters."""
    m, n = w.shape
    powers = np.full(n, _STEP, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    out = np.zeros((m, n + 1), np.uint64)
    np.cumsum(_LETTER[w] * powers, axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the hash that its bits come from."""
    h = mix(h)
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mix(h + np.uint64(1))


def _lane(bits: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << ((bits >> np.uint64(5 * lane)) & np.uint64(31)).astype(np.uint32)


def _passing(filters: np.ndarray, blocks: int, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that a filter of 8 lanes of 32 bits a block may hold. Each lane is asked of those left."""
    block, bits = _place(h, blocks)
    left = np.arange(len(h))
    for lane in range(8):
        left = left[filters[block[left].astype(np.int64), lane] & _lane(bits[left], lane) != 0]
    return left


def _by_length(words: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _latin(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x.encode("latin-1") for x in values(batch, column).to_pylist()]


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def plan_filters(lengths: dict[int, int], limit: int) -> list[list[tuple[int, int, int, int]]]:
    """Passes of (length, shard, shards, blocks) whose filters fit ``limit`` bytes. A length that doesn't fit one pass is
    split into shards by hash."""
    passes: list[list[tuple[int, int, int, int]]] = [[]]
    room = limit
    for length, n in sorted(lengths.items()):
        blocks = -(-n * (LONG_BITS if length > LONG else BITS) // 256)
        shards = -(-blocks * 32 // limit)
        for shard in range(shards):
            size = -(-blocks // shards)
            if size * 32 > room and passes[-1]:
                passes.append([])
                room = limit
            passes[-1].append((length, shard, shards, size))
            room -= size * 32
    return [p for p in passes if p]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return mix(h ^ np.uint64(0x5DEECE66D)) % np.uint64(shards)


def build_filters(vocabulary: DataFrame, wanted: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(length, shard) to (shards, filter), of at most the bytes that ``plan_filters`` was given; built in Spark, chunk by
    chunk of blocks."""
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for length, shard, shards, blocks in wanted:
        plan.setdefault(length, []).append((shard, shards, blocks))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _latin(batch, "word")
            for length, at in _by_length(words).items():
                h = _sums(_matrix([words[i] for i in at]))[:, -1]
                for shard, shards, blocks in plan[length]:
                    own = h[_shard(h, shards) == shard]
                    block, bits = _place(own, blocks)
                    m = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([length] * m, pa.int32()), pa.array([shard] * m, pa.int32()), pa.array((block // CHUNK).astype(np.int32)), pa.array((block % CHUNK).astype(np.int32)), pa.array(bits.view(np.int64))], names=["length", "shard", "chunk", "block", "bits"])

    def fill(table: pa.Table) -> pa.Table:
        f = np.zeros((CHUNK, 8), np.uint32)
        block, bits = table["block"].to_numpy(), table["bits"].to_numpy().view(np.uint64)
        for lane in range(8):
            np.bitwise_or.at(f[:, lane], block, _lane(bits, lane))
        return pa.table({**{c: table[c].slice(0, 1) for c in ("length", "shard", "chunk")}, "filter": pa.array([f.tobytes()], pa.binary())})

    out = {(length, shard): (shards, np.zeros((-(-blocks // CHUNK) * CHUNK, 8), np.uint32)) for length, shard, shards, blocks in wanted}
    asked = vocabulary.where(F.length("word").isin(list(plan))).select("word").mapInArrow(bits_of, "length int, shard int, chunk int, block int, bits long")
    for r in asked.groupBy("length", "shard", "chunk").applyInArrow(fill, "length int, shard int, chunk int, filter binary").toLocalIterator():
        out[r["length"], r["shard"]][1][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["filter"], np.uint32).reshape(CHUNK, 8)
    return {k: (shards, f[: next(b for n, s, _, b in wanted if (n, s) == k)]) for k, (shards, f) in out.items()}


# edits


def edits(words: list[bytes], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length, in portions: the edited words' length, the hash of each, its word's index, the place, and
    the letter put there (0: deleted). Deletions that give the same word are made once."""
    w = _matrix(words)
    m, n = w.shape
    sums = _sums(w)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP, np.uint64)]), dtype=np.uint64)[:n]
    wide = max(1, PROBES // max(1, len(alphabet)))
    for lo in range(0, m * n, wide):  # places of all words in one row
        at = np.arange(lo, min(m * n, lo + wide))
        i, k = np.divmod(at, n)
        letter = w[i, k]
        first = np.ones(len(at), bool)
        inner = k > 0
        first[inner] = letter[inner] != w[i[inner], k[inner] - 1]
        d = np.flatnonzero(first)
        yield n - 1, sums[i[d], k[d]] + (sums[i[d], n] - sums[i[d], k[d] + 1]) * _BACK, i[d], k[d], np.zeros(len(d), np.uint8)
        p, a = np.nonzero(alphabet[None, :] > letter[:, None])
        yield n, sums[i[p], n] + (_LETTER[alphabet[a]] - _LETTER[letter[p]]) * powers[k[p]], i[p], k[p], alphabet[a]


def suspects(vocabulary: DataFrame, filters: dict[tuple[int, int], tuple[int, np.ndarray]], alphabet: np.ndarray) -> DataFrame:
    """word, n, other: the edits of each word that a filter lets pass. ``filters`` is broadcast."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)
    lengths = {length for length, _ in filters}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = _latin(batch, "word"), batch["n"].to_numpy()
            for length, at in _by_length(words).items():
                if not {length, length - 1} & lengths:
                    continue
                own = [words[i] for i in at]
                for size, h, i, k, letter in edits(own, alphabet):
                    for (wanted, shard), (shards, f) in shared.value.items():
                        if wanted != size or not len(h):
                            continue
                        ask = np.arange(len(h)) if shards == 1 else np.flatnonzero(_shard(h, shards) == shard)
                        hit = ask[_passing(f, len(f), h[ask])]
                        made = [(own[x][:y] + (bytes((z,)) if z else b"") + own[x][y + 1 :]).decode("latin-1") for x, y, z in zip(i[hit].tolist(), k[hit].tolist(), letter[hit].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([own[x].decode("latin-1") for x in i[hit].tolist()], pa.string()), pa.array(counts[np.array(at)[i[hit]]], pa.int64()), pa.array(made, pa.string())], names=["word", "n", "other"])

    out = vocabulary.mapInArrow(run, "word string, n long, other string")
    out._filters = shared
    return out


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, other, other_n: the pairs of words of ``vocabulary`` (word, n; a written table) that are one inserted,
    deleted or replaced code point apart, each pair once. One pass for each ``filter_bytes`` of filters."""
    lengths = {r["k"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("k")).count().toLocalIterator()}
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    passed = []
    for wanted in plan_filters(lengths, filter_bytes):
        found = suspects(vocabulary, build_filters(vocabulary, wanted), alphabet)
        passed.append(materialise(found, "suspects"))
        found._filters.destroy()
    if not passed:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    every = passed[0]
    for more in passed[1:]:
        every = every.union(more)
    pairs = materialise(every.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n"), "near")
    for x in passed:
        discard(x)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) ends. Each round doubles the steps; a step multiplies n, so there
    are as many steps as n has digits, at most."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_spellings(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least_length`` code points or more that stands
    ``least_count`` times or more in ``docs`` (needs doc_id, text).

    ``form`` is the near word of largest n (ties: smallest), if that n is ``times`` the word's or more, else null; ``root``
    the end of the chain of forms. Null and empty texts have no words; repeated rows count each; columns of other names
    are ignored; an empty table gives no words. A word is whole however long it is. The vocabulary is written once, and
    its words' filters are broadcast, in passes of ``filter_bytes``.
    """
    vocabulary = materialise(count_words(docs, least_length).where(F.col("n") >= least_count), "vocabulary")
    pairs = near_pairs(vocabulary, filter_bytes)
    both = pairs.select("word", "n", "other", "other_n").union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    told = vocabulary.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")))
    told = materialise(told.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
