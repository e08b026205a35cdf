"""Benchmark decontamination: Wu-Manber multi-pattern search over words. A table of block shifts skips positions where no
window can end, the block's bucket names the windows that can, and direct comparison of the words confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cutweave.llm.text import ALNUM, Words, as_bytes, carried, released, slices
from cutweave.session import discard, materialise

WINDOW = 13
#: Words of test items that one pass holds; a larger benchmark takes more passes.
PASS_WORDS = 2_000_000
SEGMENT = 192


class Patterns:
    """Shift table and suffix buckets for windows of one length in words."""

    def __init__(self, size: int, windows: list[list[bytes]], items: list[list[int]], vocabulary: dict[bytes, int]):
        self.size, self.items = size, items
        self.block = min(2, size)
        ids = np.array([[vocabulary[x] for x in w] for w in windows], np.int64)
        self.ids, self.base = ids, len(vocabulary) + 1
        key = lambda j: ids[:, j - 1] * self.base + ids[:, j] if self.block == 2 else ids[:, j]  # noqa: E731  block that ends at word j
        shift: dict[int, int] = {}
        for j in range(self.block - 1, size):
            for k in np.unique(key(j)).tolist():
                shift[k] = size - 1 - j  # a later j gives a smaller shift, and is the one kept
        self.keys = np.array(sorted(shift), np.int64)
        self.shifts = np.array([shift[k] for k in self.keys.tolist()], np.int64)
        self.default = size - self.block + 1
        self.buckets: dict[int, list[int]] = {}
        for i, k in enumerate(key(size - 1).tolist()):
            self.buckets.setdefault(k, []).append(i)
        size_log = max(10, int(np.ceil(np.log2(len(self.keys) * 16 + 1))))
        self.mask = np.int64((1 << size_log) - 1)
        self.table = np.full(1 << size_log, self.default, np.int8)
        np.minimum.at(self.table, self.slot(self.keys), self.shifts.astype(np.int8))  # keys that share a slot take the smaller shift

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & self.mask

    def search(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start word, window) of each occurrence. Cursors, one for each segment of a text, leap in step."""
        m = self.size
        has = count >= m
        f, c = first[has], count[has]
        n_seg = (c - m) // SEGMENT + 1
        seg_of = np.repeat(np.arange(len(f)), n_seg)
        k = np.arange(len(seg_of)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        at = f[seg_of] + k * SEGMENT + m - 1  # word at which a window could end
        stop = np.minimum(f[seg_of] + (k + 1) * SEGMENT + m - 1, (f + c)[seg_of])
        hits = []
        while len(at):
            key = ids[at - 1] * self.base + ids[at] if self.block == 2 else ids[at]
            leap = self.table[self.slot(key)].astype(np.int64)
            zero = leap == 0
            if zero.any():
                hits.append(at[zero])
                leap[zero] = 1
            at = at + leap
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        for e in np.concatenate(hits).tolist() if hits else ():
            key = int(ids[e - 1] * self.base + ids[e]) if self.block == 2 else int(ids[e])
            for i in self.buckets.get(key, ()):
                if np.array_equal(ids[e - m + 1 : e + 1], self.ids[i]):
                    yield e - m + 1, i


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[dict[bytes, int], list[Patterns], list[str]]:
    """Vocabulary, one Patterns for each window length, and the item ids that their lists of items point to."""
    by_size: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    names: list[str] = []
    vocabulary: dict[bytes, int] = {}
    for item_id, text in items:
        w = Words([(text or "").encode()], ALNUM, lower=True, hashed=False)
        words = [w.word(i) for i in range(len(w.starts))]
        if not words:
            continue
        names.append(item_id)
        for x in words:
            vocabulary.setdefault(x, len(vocabulary) + 1)
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            owners = by_size.setdefault(size, {}).setdefault(tuple(words[i : i + size]), [])
            if not owners or owners[-1] != len(names) - 1:
                owners.append(len(names) - 1)
    return vocabulary, [Patterns(s, [list(x) for x in ws], list(ws.values()), vocabulary) for s, ws in sorted(by_size.items())], names


def _scan(rows: DataFrame, text: str, items: list[tuple[str, str | None]], window: int, more: bool) -> DataFrame:
    """kept, n_words, spans (merged, of hit words) and items (ids that occur). With ``more``, ``rows`` are those of an
    earlier pass, whose spans and items are added to and whose text goes on."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(build(shared.value, window))
        vocabulary, patterns, names = built[0]
        v = Words(list(vocabulary), ALNUM, lower=False)
        order = np.argsort(v.hash)
        known, value = v.hash[order], np.arange(1, len(vocabulary) + 1)[order]
        spelled = list(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                w = Words(as_bytes(part, text), ALNUM, lower=True)
                if len(known):
                    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                    ids = np.where(known[at] == w.hash, value[at], 0)
                else:
                    ids = np.zeros(len(w.hash), np.int64)
                doc = w.doc_of_word()
                spans = [list(zip(x[::2], x[1::2])) for x in part["spans"].to_pylist()] if more else [[] for _ in range(part.num_rows)]
                owners: list[set] = [set(x) for x in part["items"].to_pylist()] if more else [set() for _ in range(part.num_rows)]
                for p in patterns:
                    for s, i in p.search(ids, w.first, w.count):
                        if all(w.word(j) == spelled[ids[j] - 1] for j in range(s, s + p.size)):  # the words themselves
                            d = doc[s]
                            spans[d].append((int(s - w.first[d]), int(s - w.first[d]) + p.size))
                            owners[d].update(names[x] for x in p.items[i])
                flat = [[x for se in merge(a) for x in se] for a in spans]
                told = {c: part[c] for c in through} | {"n_words": pa.array(w.count.astype(np.int64)), "spans": pa.array(flat, pa.list_(pa.int64())), "items": pa.array([sorted(o) for o in owners], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(told.values()), names=list(told))

    through = [c for c in rows.columns if c in ("kept", "body")]
    passed = T.StructType([rows.schema[c] for c in through])
    return rows.mapInArrow(run, T.StructType([*passed.fields, *T.StructType.fromDDL("n_words long, spans array<long>, items array<string>").fields]))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


WORD_BYTES = 6  # of a benchmark's text, about


def _blocks(benchmark: DataFrame, window: int, pass_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, one at a time. Sizes are counted in Spark. An item over a sixteenth of a block
    goes in pieces that overlap by a window less one word, so no window is lost and no block outgrows its bound by much."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    most = max(pass_words // 16, 2 * window)
    words = F.expr(r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(most - window + 1))
    long = items.where(F.length("text") > most * WORD_BYTES).withColumn("words", words).withColumn("at", F.explode(starts))
    items = items.where(F.length("text") <= most * WORD_BYTES).union(long.select("item_id", F.concat_ws(" ", F.slice("words", F.col("at") + 1, most))))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // (pass_words * WORD_BYTES)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield sorted({(r["item_id"], r["text"]) for r in items.where(part == i).toLocalIterator()})


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, pass_words: int = PASS_WORDS, text: str = "text") -> DataFrame:
    """The kept columns (default doc_id), n_words, n_hit, items (sorted ids of items with a window in the text) and
    contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A benchmark within ``pass_words`` takes one narrow pass and no shuffle; its items, of that proven size, are
    broadcast. A larger one takes as many passes, each over the table that the one before has written, each with one
    block in the driver and in the tasks; texts are written again for each, and never shuffled. Null text has no words;
    very long texts are searched whole; items without words or id give no window; items that share an id are one;
    repeated rows repeat; an empty table on either side gives no hits. A kept column that is named like a result gives
    way to it; to keep all columns whatever their names, pass them as one struct (``text`` may be a path in it).
    """
    rows, path = carried(docs, keep or ["doc_id"], text)
    found, before = None, None
    for block in _blocks(benchmark, window, pass_words):
        if found is not None:
            rows = materialise(found, "pass")
            if before is not None:
                discard(before)
            before = rows
        found = _scan(rows, path, block, window, before is not None)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.withColumn("n_hit", hit)
    return released(out, {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "items": F.col("items"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
