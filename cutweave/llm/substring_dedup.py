"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words; windows that occur again anywhere merge into
maximal removal intervals.

What is counted. Each window is named by its minimiser: of the runs of ANCHOR words inside it, the one with the least
hash. Equal windows have equal minimisers, so a window whose minimiser occurs once in the corpus is unique, and only the
others' hashes are shuffled and counted. That leaves some 2 in 28 anchors and the windows of repeated passages to move,
rather than a hash for every word of the corpus. Rows that have the same whole text share one key throughout, and a copied
text of WINDOW words or more goes whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import SPACE, Words, as_bytes, carried, mix, released, slices, unseen, with_fields
from cutweave.session import discard, materialise

WINDOW, ANCHOR = 35, 8


def minimisers(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, hash and minimiser's hash of each window."""
    at, hashes = w.windows(window)
    n = len(w.starts)
    if not len(at):
        return at, hashes, hashes
    starts, a = w.windows(anchor)
    least = np.full(n + window, np.iinfo(np.uint64).max, np.uint64)
    least[starts] = a
    span, done = window - anchor + 1, 1  # least over so many starts, by doubling
    while done < span:
        step = min(done, span - done)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return at, hashes, least[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchors(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, mh, twice: the minimisers of each text, once each; twice if its run of words stands in the text again. Of a
    text's copies a task looks at one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                bodies, keys = as_bytes(part), part["key"].to_numpy()
                new = unseen(keys.tolist(), bodies, seen)
                keys, w = keys[new], Words([bodies[i] for i in new], SPACE, lower=False)
                at, _, mh = minimisers(w, window, anchor)
                doc = w.doc_of_word()
                in_doc = lambda h, starts: mix(h + doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                starts, a = w.windows(anchor)
                every = np.sort(in_doc(a, starts)) if len(at) else np.zeros(0, np.uint64)
                again = every[1:][every[1:] == every[:-1]]
                named, first = np.unique(in_doc(mh, at) if len(at) else mh, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[doc[at[first]]] if len(at) else np.zeros(0, np.int64)), pa.array(_signed(mh[first])), pa.array(np.isin(named, again))], names=["key", "mh", "twice"])

    return keyed.select("text", "key").mapInArrow(run, "key long, mh long, twice boolean")


def _suspects(listed: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, wh, twice: the windows, once each, of the texts of ``listed`` (text, key, mhs) whose minimiser is in mhs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                bodies = as_bytes(part)
                new = unseen(part["key"].to_pylist(), bodies, seen)
                w = Words([bodies[i] for i in new], SPACE, lower=False)
                at, wh, mh = minimisers(w, window, anchor)
                bounds = np.searchsorted(at, np.append(w.first, len(w.starts)))
                keys, hashes, twice = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
                for i, row in enumerate(new):
                    key, lo, hi = part["key"][row].as_py(), bounds[i], bounds[i + 1]
                    mine = np.isin(mh[lo:hi], part["mhs"][row].values.to_numpy().view(np.uint64))
                    u, n = np.unique(wh[lo:hi][mine], return_counts=True)
                    keys.append(np.full(len(u), key, np.int64))
                    hashes.append(u)
                    twice.append(n > 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(_signed(np.concatenate(hashes))), pa.array(np.concatenate(twice))], names=["key", "wh", "twice"])

    return listed.select("text", "key", "mhs").mapInArrow(run, "key long, wh long, twice boolean")


def _again(rows: DataFrame, name: str) -> DataFrame:
    """The hashes in more than one text, or twice in one, and their rows. Least and greatest key tell, and combine before
    the shuffle."""
    return rows.groupBy(name).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("twice").alias("t"), F.count("*").alias("n")).where("a < b or t").select(name, "n")


#: A hash with over one in HOT of all rows is hot: there are fewer than HOT of them, so their table is broadcast.
HOT = 2000


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """For each text's key the hashes of its that occur again; of bounded size, a text's own. ``rows`` is a written table.
    Only rows of hashes that aren't hot meet on their hash."""
    bound = F.lit(rows.count() // HOT)
    again = materialise(_again(rows, name), "again")
    hot = F.broadcast(again.where(F.col("n") > bound).select(name))
    common = rows.join(hot, name)
    others = rows.join(hot, name, "left_anti").join(again.where(F.col("n") <= bound).select(name), name)
    return common.union(others).groupBy("key").agg(F.collect_set(name).alias(name + "s"))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The kept columns (default doc_id), n_words, n_removed, spans (start and end words of what goes, flat, maximal and
    in order) and kept (the words that stay, joined by one space) of every row of ``docs`` (needs text).

    A window repeats if its words also start anywhere else in ``docs``, the same row included; all windows are judged
    on the input. Null text has no words; texts under ``window`` words lose none; rows that repeat a text go whole; an
    empty table gives none. Keys and hashes have 64 bits. The texts are shuffled twice, on their key; every count
    combines map-side, so a passage that a third of all texts have reaches a shuffle once a task, and such hot hashes
    find their rows by broadcast, as there are fewer than HOT. A kept column that is named like a result gives way to it.
    """
    rows, path = carried(docs, keep or ["doc_id"])
    keyed = rows.withColumn("key", F.xxhash64(path))
    texts = keyed.select(F.col(path).alias("text"), "key").where("text is not null")
    anchors = materialise(_anchors(texts, window, anchor), "anchors")
    listed = materialise(_lists(anchors, "mh"), "anchor-lists")
    discard(anchors)
    suspects = materialise(_suspects(texts.join(listed, "key"), window, anchor), "windows")
    copies = texts.groupBy("key", F.md5(F.col("text").cast("binary")).alias("md5")).count().where("count > 1").groupBy("key").agg(F.collect_set("md5").alias("copied"))
    found = materialise(_lists(suspects, "wh").join(copies, "key", "full"), "repeats")
    told = keyed.join(found, "key", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.md5(F.col(path).cast("binary"))), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, path):
                w = Words(as_bytes(part, path), SPACE, lower=False)
                at, wh = w.windows(window)
                bounds = np.searchsorted(at, np.append(w.first, len(w.starts)))
                spans, kept, removed = [], [], []
                for i, copy in enumerate(part["copy"].to_pylist()):
                    first, n = int(w.first[i]), int(w.count[i])
                    lo, hi = bounds[i], bounds[i + 1]
                    gone = np.zeros(n + 1, np.int32)
                    if part["whs"][i].is_valid or copy:
                        hit = at[lo:hi] if copy else at[lo:hi][np.isin(wh[lo:hi], part["whs"][i].values.to_numpy().view(np.uint64))]
                        np.add.at(gone, hit - first, 1)
                        np.add.at(gone, hit - first + window, -1)
                    out = np.cumsum(gone[:n]) > 0
                    edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                    spans.append(edge)
                    removed.append(int(out.sum()))
                    kept.append(b" ".join([w.word(first + j) for j in np.flatnonzero(~out).tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [part["kept"], pa.array(w.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["kept", "n_words", "n_removed", "spans", "stay"],
                )

    found = told.select(*rows.columns, "whs", "copy").mapInArrow(run, with_fields(rows, ("n_words", "long"), ("n_removed", "long"), ("spans", "array<long>"), ("stay", "string")))
    return released(found, {"n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "spans": F.col("spans"), "kept": F.col("stay")})
