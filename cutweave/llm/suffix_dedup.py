"""Suffix dedup of bytes: a sparse suffix array, made by a distributed merge sort that knows common prefixes.

Which suffixes. Every run of WINDOW bytes has an anchor, the leftmost of its runs of GRAM bytes with the least hash; equal
runs have it at the same place. So only suffixes that start at anchors are sorted, and of these only those whose first
GRAM bytes stand anywhere else (hashes are counted first, as the sort with prefix doubling of Bingmann, Sanders and Schimek
does): a suffix that differs from all others within GRAM bytes can't be part of a repeat.

How. A task sorts the suffixes of its texts into runs and front-codes them: each has the length of the prefix it shares with
the one before, and the rest. Runs are cut at fixed splitters (suffixes are in order of their first bytes' hash, then of
the bytes themselves, so that equal splitters are even) and exchanged. A range's runs are merged by a loser tree whose
nodes hold common prefix lengths: bytes that are known to be equal are never compared again, and the merged order comes out
with its array of common prefixes.

What repeats. A window with its anchor at p needs a partner that shares l bytes left of p and r from p on, l + r >= WINDOW.
The intervals of common prefixes are joined from the deepest up, the smaller into the larger, whose members are held in the
order of their reversed left sides: pairs that are next to each other there have the longest l for an r, others none longer.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import _BYTE, as_bytes, carried, mix, released, slices, spans_hash, unseen, with_fields
from cutweave.session import discard, materialise

WINDOW, GRAM = 400, 96
#: Window starts that are looked at together; bytes of suffixes that a task sorts at once, and that a range should have.
BLOCK, RUN_BYTES, RANGE_BYTES = 1 << 20, 8 << 20, 4 << 20
#: Suffixes that share their first bytes' hash and are resolved in one task. Windows of larger classes are counted in Spark.
CLASS = 1 << 15
#: Hashes of over one row in SHARE find their rows by broadcast: there are fewer than SHARE of them.
SHARE = 2000
_PLACE = np.uint64((1 << 21) - 1)


def anchors(body: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each anchor of the text starts, the first and last start of a window that it is the anchor of, and the hash
    of its first bytes."""
    found, n = [], len(body) - window + 1
    buf = np.frombuffer(body, np.uint8)
    for lo in range(0, max(n, 0), BLOCK):
        hi = min(lo + BLOCK, n)
        seg = _BYTE[buf[lo : hi + window - 1]]
        at = np.arange(len(seg) - gram + 1)
        h = mix(spans_hash(seg, at, at + gram))
        least = (h & ~_PLACE) | at.astype(np.uint64)
        span, done = window - gram + 1, 1
        while done < span:
            step = min(done, span - done)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            done += step
        p = (least[: hi - lo] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        found.append((p[first] + lo, first + lo, np.append(first[1:], hi - lo) - 1 + lo, h[p[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    p, a, b, h = (np.concatenate(x) for x in zip(*found))
    again = np.flatnonzero(p[1:] == p[:-1])  # one that two blocks share
    b[again] = b[again + 1]
    own = np.delete(np.arange(len(p)), again + 1)
    return p[own], a[own], b[own], h[own]


def shared(x: bytes, y: bytes, known: int = 0) -> int:
    """Bytes that both begin with; ``known`` of them need no look."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


# runs


def front_code(items: list[tuple[bytes, bytes, list[tuple[int, int, int]]]]) -> bytes:
    """A sorted run of (suffix, reversed left side, ids), front-coded."""
    prefix, rest, left, before = [], [], [], b""
    for s, l, _ in items:
        k = shared(before, s)
        prefix.append(k)
        rest.append(s[k:])
        left.append(l)
        before = s
    lengths = lambda x: np.fromiter(map(len, x), np.int32, len(x))
    ids = np.array([i for _, _, own in items for i in own], np.int64)
    packed = pickle.dumps((np.array(prefix, np.int32), lengths(rest), lengths(left), lengths([own for *_, own in items]), ids, b"".join(rest), b"".join(left)), protocol=5)
    return zstandard.ZstdCompressor(level=1).compress(packed)


def decode(run: bytes) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """Prefix shared with the one before, suffix, reversed left side and ids."""
    prefix, rests, lefts, own, ids, rest, left = pickle.loads(zstandard.ZstdDecompressor().decompress(run))
    r = l = i = 0
    before = b""
    for k, x, y, z in zip(prefix.tolist(), rests.tolist(), lefts.tolist(), own.tolist()):
        before = before[:k] + rest[r : r + x]
        yield k, before, left[l : l + y], ids[i : i + z]
        r, l, i = r + x, l + y, i + z


def merge(runs: Iterable[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in one order, each with the prefix that it shares with the one before.

    ``known[i]`` is how much run i's head shares with the item that it last lost to or was given out after; a head that
    shares more with the last item is smaller than one that shares less, and only equals are compared, from there on.
    """
    runs = list(runs)
    width = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (width - len(runs))
    known = [0] * width

    def play(x: int, y: int) -> tuple[int, int]:
        if heads[y] is None or heads[x] is None:
            return (x, y) if heads[y] is None else (y, x)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        k = shared(a, b, known[x])
        won, lost = (x, y) if (a[k : k + 1], x) < (b[k : k + 1], y) else (y, x)
        known[lost] = k
        return won, lost

    tree = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        games = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        tree[level : 2 * level] = [lost for _, lost in games]
        winners = [won for won, _ in games]
    top = winners[0]
    while heads[top] is not None:
        yield (known[top], *heads[top][1:])
        heads[top] = next(runs[top], None)
        known[top] = heads[top][0] if heads[top] else 0
        node = (top + width) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


def longest(members: list[tuple[int, bytes, bytes, np.ndarray]], head: int, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For members (shared with the one before, suffix, left side, ids) of one class, in order, the most bytes to the left
    and right that repeats of ``window`` bytes or more cover. ``head`` bytes of a suffix are its hash."""
    k = len(members)
    left, right = [0] * k, [0] * k
    text = [m[2] for m in members]
    for i, m in enumerate(members):
        if len(m[3]) > 1:  # the same surroundings in one task
            left[i], right[i] = len(m[2]), len(m[1]) - head

    def pair(x: int, y: int, r: int) -> None:
        l = shared(text[x], text[y])
        if l + r >= window:
            for z in (x, y):
                left[z], right[z] = max(left[z], l), max(right[z], r)

    if k == 2:
        pair(0, 1, members[1][0] - head)
    elif k > 2:
        order = sorted(range(k), key=text.__getitem__)
        rank = [0] * k
        for i, x in enumerate(order):
            rank[x] = i
        owner, sets = list(range(k)), {i: [rank[i]] for i in range(k)}

        def find(x: int) -> int:
            while owner[x] != x:
                owner[x] = x = owner[owner[x]]
            return x

        for i in sorted(range(1, k), key=lambda i: -members[i][0]):
            x, y, r = find(i - 1), find(i), members[i][0] - head
            if len(sets[x]) < len(sets[y]):
                x, y = y, x
            large = sets[x]
            small = sets.pop(y)
            owner[y] = x
            near = [(a, bisect_left(large, a)) for a in small]
            for a, at in near:
                if at:
                    pair(order[a], order[large[at - 1]], r)
                if at < len(large):
                    pair(order[a], order[large[at]], r)
            if len(small) * 8 > len(large):
                sets[x] = sorted(large + small)
            else:
                for a in small:
                    insort(large, a)
    return left, right


# jobs


def _ids(col):
    return [F.xxhash64(col).alias("key"), F.xxhash64(F.lit(1), col).alias("mark")]


def _grams(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """key, mh, m: the first bytes' hashes of each text's anchors, and how many anchors of it have them. Of a text's copies
    a task looks at one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                bodies, names = as_bytes(part), part["key"].to_pylist()
                keys, hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i in unseen(names, bodies, seen):
                    u, n = np.unique(anchors(bodies[i], window, gram)[3], return_counts=True)
                    keys.append(np.full(len(u), names[i], np.int64))
                    hashes.append(u)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["key", "mh", "m"])

    return texts.select("text", "key").where("length(text) > 0").mapInArrow(run, "key long, mh long, m long")


def _lists(grams: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """key, mhs, hots: for each text its hashes that stand anywhere else, and those of them of over ``limit`` anchors. Also
    how many anchors have such hashes. Counts combine before the shuffle."""
    often = grams.groupBy("mh").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("m").alias("n"), F.count("*").alias("rows"), F.max("m").alias("most"))
    again = materialise(often.where("a < b or most > 1").select("mh", "n", "rows"), "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    bound = grams.count() // SHARE
    common = grams.join(F.broadcast(again.where(F.col("rows") > bound)), "mh")
    others = grams.join(again.where(F.col("rows") <= bound), "mh")  # those left out are the common ones, of which none is in both
    told = common.select("key", "mh", "n").union(others.select("key", "mh", "n"))
    return told.groupBy("key").agg(F.collect_set("mh").alias("mhs"), F.collect_set(F.when(F.col("n") > limit, F.col("mh"))).alias("hots")), total


def _listed(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple]:
    """For each text: ids, bytes, and its listed anchors with whether their class is too large for a task."""
    for i, body in enumerate(as_bytes(batch)):
        p, a, b, h = anchors(body, window, gram)
        own = np.flatnonzero(np.isin(h, batch["mhs"][i].values.to_numpy().view(np.uint64)))
        hot = np.isin(h[own], batch["hots"][i].values.to_numpy().view(np.uint64))
        yield batch["key"][i].as_py(), batch["mark"][i].as_py(), body, p[own], a[own], b[own], h[own], hot


def _sorted_runs(listed: DataFrame, ranges: int, window: int, gram: int) -> DataFrame:
    """range, run: the front-coded runs of each task, cut at the ranges' splitters."""

    def cut(items: list[tuple]) -> pa.RecordBatch:
        items.sort()
        one = []
        for (s, l), same in groupby(items, key=lambda x: x[:2]):
            one.append((s, l, sorted({x[2:] for x in same})))
        numbers, runs = [], []
        for number, part in groupby(one, key=lambda x: int.from_bytes(x[0][:8], "big") * ranges >> 64):
            numbers.append(number)
            runs.append(front_code(list(part)))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(runs, pa.binary())], names=["range", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held = [], 0
        for batch in batches:
            for part in slices(batch):
                for key, mark, body, p, a, b, h, hot in _listed(part, window, gram):
                    for at, lo, hi, name in zip(*(x[~hot].tolist() for x in (p, a, b, h))):
                        items.append((name.to_bytes(8, "big") + body[at : hi + window], body[lo:at][::-1], key, mark, at))
                        held += hi + window - lo
                    if held > RUN_BYTES:
                        yield cut(items)
                        items, held = [], 0
        if items:
            yield cut(items)

    return listed.select("text", "key", "mark", "mhs", "hots").mapInArrow(run, "range int, run binary")


_SPAN = "key long, mark long, start long, end long"


def _merged(runs: DataFrame, window: int, gram: int) -> DataFrame:
    """key, mark, start, end: what repeats around each anchor. A range's runs are merged in one task."""
    head = 8

    def resolve(table: pa.Table) -> pa.Table:
        ids, starts, ends = [], [], []

        def close(members: list[tuple]) -> None:
            left, right = longest(members, head, window)
            for m, l, r in zip(members, left, right):
                if r:
                    ids.append(m[3])
                    starts.append(m[3][:, 2] - l)
                    ends.append(m[3][:, 2] + r)

        members: list[tuple] = []
        for item in merge(decode(x) for x in table["run"].to_pylist()):
            if item[0] < head + gram and members:
                if len(members) > 1 or len(members[0][3]) > 1:
                    close(members)
                members = []
            members.append(item)
        if members:
            close(members)
        own = np.concatenate(ids) if ids else np.zeros((0, 3), np.int64)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"key": own[:, 0], "mark": own[:, 1], "start": flat(starts), "end": flat(ends)})

    return runs.groupBy("range").applyInArrow(resolve, _SPAN)


def _hot_windows(listed: DataFrame, window: int, gram: int) -> DataFrame:
    """key, mark, start, end: the windows at anchors of classes too large for a task that occur again, counted by 128-bit
    hashes of whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [[np.zeros(0, np.int64)] * 5]
                for key, mark, body, _, a, b, _, hot in _listed(part, window, gram):
                    for lo, hi in zip(a[hot].tolist(), b[hot].tolist()):
                        seg = np.frombuffer(body, np.uint8)[lo : hi + window]
                        s = np.arange(hi - lo + 1)
                        w1, w2 = (mix(spans_hash(v, s, s + window)).view(np.int64) for v in (_BYTE[seg], mix(_BYTE[seg])))
                        out.append([np.full(len(s), key, np.int64), np.full(len(s), mark, np.int64), s + lo, w1, w2])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "mark", "start", "w1", "w2"])

    hot = materialise(listed.where("size(hots) > 0").select("text", "key", "mark", "mhs", "hots").mapInArrow(run, "key long, mark long, start long, w1 long, w2 long"), "hot-windows")
    again = hot.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return hot.join(again, ["w1", "w2"]).select("key", "mark", "start", (F.col("start") + window).alias("end"))


def remove_repeated_bytes(docs: DataFrame, keep: list[str] | None = None, text: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = CLASS) -> DataFrame:
    """The kept columns (default doc_id), n_bytes, n_removed, spans (starts and ends of what goes, flat, maximal and in
    order) and kept (the bytes that stay) of every row of ``docs``.

    A byte goes if a run of ``window`` bytes that covers it also starts anywhere else in ``docs``, the same row included.
    Null text has no bytes; texts under ``window`` bytes lose none; rows that repeat a text of ``window`` bytes or more go
    whole, and only one of them is sorted; an empty table gives no rows. Long texts are taken block by block. ``kept`` is
    binary, as it may cut a character. A kept column that is named like a result gives way to it.
    """
    rows, path = carried(docs, keep or ["doc_id"], text)
    keyed = rows.select("*", *_ids(F.col(path)), F.xxhash64("kept").alias("told") if not _maps(rows) else F.lit(0).cast("long").alias("told"))
    texts = keyed.select(F.col(path).alias("text"), "key", "mark", "told").where("text is not null")
    grams = materialise(_grams(texts, window, gram), "grams")
    lists, total = _lists(grams, limit)
    groups = materialise(texts.groupBy("key", "mark").agg(F.count("*").alias("n"), F.min("told").alias("least")), "texts")
    lists = materialise(groups.join(lists, "key").select("key", "mark", "least", "mhs", "hots"), "lists")
    discard(grams)
    listed = texts.join(lists, ["key", "mark"]).where("told = least")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * 600 // RANGE_BYTES)
    runs = _sorted_runs(listed, ranges, window, gram)
    spans = materialise(_merged(runs, window, gram), "spans")
    if not lists.where("size(hots) > 0").isEmpty():
        spans = spans.union(materialise(_hot_windows(listed, window, gram), "hot-spans"))
    whole = groups.where("n > 1").select("key", "mark", F.lit(True).alias("whole"))
    per = spans.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    told = keyed.join(materialise(per.join(whole, ["key", "mark"], "full"), "told"), ["key", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, path):
                size, gone, spans, kept = [], [], [], []
                for body, found, whole in zip(as_bytes(part, path), part["found"].to_pylist(), part["whole"].to_pylist()):
                    at: list[list[int]] = []
                    if whole and len(body) >= window:
                        at = [[0, len(body)]]
                    else:
                        for x in sorted((s["start"], s["end"]) for s in found or []):
                            if at and x[0] <= at[-1][1]:
                                at[-1][1] = max(at[-1][1], x[1])
                            else:
                                at.append(list(x))
                    edges = [0, *(x for s in at for x in s), len(body)]
                    size.append(len(body))
                    gone.append(sum(e - s for s, e in at))
                    spans.append([x for s in at for x in s])
                    kept.append(b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part["kept"], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["kept", "n_bytes", "n_removed", "spans", "stay"])

    found = told.select(*rows.columns, "found", "whole").mapInArrow(run, with_fields(rows, ("n_bytes", "long"), ("n_removed", "long"), ("spans", "array<long>"), ("stay", "binary")))
    return released(found, {"n_bytes": F.col("n_bytes"), "n_removed": F.col("n_removed"), "spans": F.col("spans"), "kept": F.col("stay")})


def _maps(rows: DataFrame) -> bool:
    """Whether a map is among the kept columns, which can't be hashed."""
    return "map<" in rows.schema["kept"].dataType.simpleString()
