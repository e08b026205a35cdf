"""Packing by cutting-stock column generation: a linear program over patterns of the length histogram, whose columns a
knapsack dynamic program prices; rounded patterns are dealt to ranked pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cutweave.llm.text import slices
from cutweave.llm.tokens import default_path, encoder
from cutweave.session import materialise

CAPACITY, END_ID = 4096, 2
#: Lengths are counted in units of so many tokens: 512 classes.
UNIT = 8
#: Pieces of one length class that one window ranks, about.
RANKED_TOGETHER = 200_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document: ``capacity`` ids each, and what is left. doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, count = enc.texts(part["text"], end_id)
                data = ids.astype("<u4").tobytes()
                names = part["doc_id"].cast(pa.int64()).to_pylist()
                rows, at = [], 0
                for name, n in zip(names, count.tolist()):
                    for s in range(0, n, capacity):
                        m = min(capacity, n - s)
                        rows.append((name, s, m, zlib.crc32(data[4 * (at + s) : 4 * (at + s + m)]), n))
                    at += n
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(dual: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack by dynamic programming: the pattern of classes (class c takes c + 1 units) worth most."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        m = min(w, len(dual))
        worth = best[w - m : w][::-1] + dual[:m]  # class 0 .. m - 1 put into w
        c = int(np.argmax(worth))
        if worth[c] > best[w - 1] + 1e-12:
            best[w], pick[w] = worth[c], c
        else:
            best[w] = best[w - 1]
    pattern: dict[int, int] = {}
    w = capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            c = int(pick[w])
            pattern[c] = pattern.get(c, 0) + 1
            w -= c + 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, max_columns: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often the linear program uses each: revised simplex on min sum x, A x = demand, x >= 0.

    It starts from one pattern a class; each round prices a column by the knapsack and leaves by the ratio test. Stops
    at no gain, or after ``max_columns`` rounds with a feasible solution that is a little worse.
    """
    live = np.flatnonzero(demand > 0)
    k = len(live)
    if not k:
        return []
    place = {int(c): i for i, c in enumerate(live)}
    columns = [{int(c): capacity // (int(c) + 1)} for c in live]
    inverse = np.diag([1.0 / (capacity // (int(c) + 1)) for c in live])
    x = inverse @ demand[live].astype(float)
    dual = np.zeros(len(demand))
    for _ in range(max_columns):
        dual[:] = 0.0
        dual[live] = np.maximum(inverse.sum(0), 0.0)
        worth, pattern = best_pattern(dual, capacity)
        if worth <= 1 + 1e-7:
            break
        a = np.zeros(k)
        for c, n in pattern.items():
            if c in place:
                a[place[c]] = n
        way = inverse @ a
        able = way > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, way, 1.0), np.inf)
        leave = int(np.argmin(ratio))
        theta = ratio[leave]
        row = inverse[leave] / way[leave]
        inverse -= np.outer(way, row)
        inverse[leave] = row
        x -= theta * way
        x[leave] = theta
        np.maximum(x, 0.0, out=x)
        columns[leave] = {c: n for c, n in pattern.items() if c in place}
    return [(p, float(v)) for p, v in zip(columns, x) if v > 1e-9]


def plan(histogram: dict[int, int], classes: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns that hold every piece of the histogram {class: count}: the program's, rounded down, and for what
    that leaves each longest-first into the room there is."""
    demand = np.zeros(classes, np.int64)
    for c, n in histogram.items():
        demand[c] = n
    left, out = demand.copy(), []
    for pattern, v in solve(demand, classes):
        times = min([int(v + 1e-6), *(int(left[c]) // n for c, n in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for c, n in pattern.items():
                left[c] -= n * times
    while left.any():
        room, pattern = classes, {}
        while room > 0 and (fits := np.flatnonzero(left[:room])).size:
            c = int(fits[-1])
            n = min(int(left[c]), room // (c + 1))
            pattern[c] = pattern.get(c, 0) + n
            left[c] -= n
            room -= n * (c + 1)
        out.append((pattern, 1))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """(class, first rank, pieces of the class a sequence, first sequence) for each class of each pattern, by rank."""
    out, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        for c, n in pattern.items():
            out.append((c, taken.get(c, 0), n, sequence))
            taken[c] = taken.get(c, 0) + n * times
        sequence += times
    return sorted(out)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The texts are read once, narrowly; from there on only pieces of fixed size move. Ranks within a length class come
    from windows over salted shares of it and a prefix sum of their counts, so a length that a third of the corpus has
    is many tasks' work; offsets come from a window over a sequence, of ``capacity`` rows at most. The driver holds the
    histogram and the patterns, both bounded by the classes. Null text is empty: one piece, of the end id. Repeated
    rows are packed once each, ties ranked by crc; a null doc_id stays null; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    classes = capacity // unit
    pieces = materialise(cut(docs, tokenizer or default_path(), end_id, capacity), "pieces")
    pieces = pieces.withColumn("class", F.when(F.col("length") == capacity, F.lit(classes)).otherwise(F.ceil(F.col("length") / unit).cast("int") - 1))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    whole = histogram.pop(classes, 0)
    patterns = plan(histogram, classes)
    table = slots(patterns)
    base = sum(t for _, t in patterns)

    most = max([whole, *histogram.values()], default=0)
    salts = max(1, -(-most // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    share = salted.groupBy("class", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = salted.withColumn("local", F.row_number().over(W.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(share) if salts * (classes + 1) <= 100_000 else share, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("local"))

    by_class: dict[int, tuple] = {}
    for c in {t[0] for t in table}:
        mine = [t for t in table if t[0] == c]
        by_class[c] = tuple(np.array([t[i] for t in mine], np.int64) for i in (1, 2, 3))
    shared = spark.sparkContext.broadcast(by_class)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b["class"].to_numpy(), b["rank"].to_numpy()
            to = base + rank
            for c in np.unique(kind):
                if c < classes:
                    first, per, sequence = shared.value[int(c)]
                    mine = kind == c
                    i = np.searchsorted(first, rank[mine], "right") - 1
                    to[mine] = sequence[i] + (rank[mine] - first[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*(b[f] for f in fields), pa.array(to)], names=[*fields, "sequence_id"])

    dealt = ranked.select(*fields, "class", "rank").mapInArrow(deal, ", ".join(f"{f} long" for f in [*fields, "sequence_id"]))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
