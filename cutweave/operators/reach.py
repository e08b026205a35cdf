"""Component metrics, hop reach and robustness of every candidate's graph. Tables carry cand_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cutweave.operators.components import star_components
from cutweave.operators.graph import adjacency, degrees, dense_rank_ids
from cutweave.session import materialise, scoped

#: Edges of one candidate that a one-task helper takes; beyond, the helper raises and the iterative form is the way.
HELPER_EDGES = 5_000_000


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """cand_id, node, comp: the least node of each component; nodes without edges are their own."""
    return nodes.select("cand_id", "node").join(star_components(edges, ["cand_id"]), ["cand_id", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))


def components_by_candidate(edges: DataFrame, nodes: DataFrame, max_edges: int = HELPER_EDGES) -> DataFrame:
    """As ``components``, by union-find, one candidate's graph in a task: for many small graphs. Raises on one with more
    than ``max_edges`` edges."""
    most = edges.groupBy("cand_id").count().agg(F.max("count")).first()[0] or 0
    if most > max_edges:
        raise ValueError(f"a candidate has {most} edges: use components")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = {int(x): int(x) for x in pdf["src"]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            if b == b:  # not null
                root.setdefault(int(b), int(b))
                x, y = find(int(a)), find(int(b))
                root[max(x, y)] = min(x, y)
        return pd.DataFrame({"cand_id": pdf["cand_id"].iloc[0], "node": list(root), "comp": [find(x) for x in root]})

    rows = edges.select("cand_id", "src", "dst").union(nodes.select("cand_id", "node", F.lit(None).cast("long")))
    return rows.groupBy("cand_id").applyInPandas(run, "cand_id int, node long, comp long")


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("cand_id", "comp").agg(F.count("*").alias("size"))


def pairwise_connectivity(comps: DataFrame) -> DataFrame:
    """cand_id, pcg: connected pairs, the sum of s (s - 1) / 2 over components."""
    return component_sizes(comps).groupBy("cand_id").agg(F.sum(F.expr("size * (size - 1) div 2")).alias("pcg"))


def largest_component(comps: DataFrame) -> DataFrame:
    return component_sizes(comps).groupBy("cand_id").agg(F.max("size").alias("largest"), F.count("*").alias("components"))


def reach_within(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """cand_id, node, reach: nodes within ``hops`` of each, itself included; exact.

    Bit-parallel: starts are numbered and taken in blocks of 64, a long holds which of a block's starts have come to a node,
    and a hop is one ``bit_or`` over arms. There are up to 64 times fewer rows than pairs; they are still as many as nodes
    times blocks where all is connected, and ``reach_sketch`` is the form beyond that. Only what a hop has added goes on;
    rounds stop when none adds any.
    """
    return scoped(lambda: _reach_bits(edges, nodes, hops), "reach")


def _reach_bits(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    a = materialise(adjacency(edges.where("src <> dst"), ("cand_id",)), "arms")
    number = materialise(dense_rank_ids(nodes.select("node").distinct(), "node"), "numbers")
    start = nodes.select("cand_id", "node").join(number, "node").select("cand_id", "node", F.floor(F.col("idx") / 64).alias("block"), F.expr("shiftleft(1L, cast(idx % 64 as int))").alias("bits"))
    at = ["cand_id", "node", "block"]
    seen = front = materialise(start, "reach")
    for _ in range(hops):
        told = a.join(front.withColumnRenamed("node", "src"), ["cand_id", "src"]).groupBy("cand_id", F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("told"))
        both = materialise(seen.join(told, at, "full").select(*at, F.coalesce("bits", F.lit(0)).alias("old"), F.coalesce("told", F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0)))).alias("new")), "reach")
        front = both.where("new <> 0").select(*at, F.col("new").alias("bits"))
        seen = both.select(*at, F.col("old").bitwiseOR(F.col("new")).alias("bits"))
        if front.isEmpty():
            break
    count = lambda i: F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1"))
    per = seen.groupBy("cand_id", "block").agg(F.array(*(count(i) for i in range(64))).alias("n"))
    long = per.select("cand_id", "block", F.posexplode("n").alias("i", "reach")).select("cand_id", (F.col("block") * 64 + F.col("i")).alias("idx"), "reach")
    return long.where("reach > 0").join(number, "idx").select("cand_id", "node", "reach")


def reach_sketch(edges: DataFrame, nodes: DataFrame, hops: int, bits: int = 12) -> DataFrame:
    """cand_id, node, reach: as ``reach_within``, estimated by HyperLogLog unions: one sketch a node at all times."""
    a = materialise(adjacency(edges.where("src <> dst"), ("cand_id",)), "sketch")
    now = materialise(nodes.groupBy("cand_id", "node").agg(F.hll_sketch_agg("node", bits).alias("s")), "sketch")
    for _ in range(hops):
        told = a.join(now.withColumnRenamed("node", "dst"), ["cand_id", "dst"]).select("cand_id", F.col("src").alias("node"), "s")
        now = materialise(now.union(told).groupBy("cand_id", "node").agg(F.hll_union_agg("s").alias("s")), "sketch")
    return now.select("cand_id", "node", F.hll_sketch_estimate("s").alias("reach"))


def max_reach(reach: DataFrame) -> DataFrame:
    return reach.groupBy("cand_id").agg(F.max("reach").alias("max_reach"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of a graph of nodes 0..n-1. Roots hook onto lesser ones, and paths are
    halved, until every edge is inside a tree."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return root
        root[np.maximum(x, y)] = np.minimum(x, y)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _pairs(n: int, a: np.ndarray, b: np.ndarray) -> int:
    sizes = np.bincount(_roots(n, a, b), minlength=n)
    return int((sizes * (sizes - 1) // 2).sum())


def _widest(n: int, a: np.ndarray, b: np.ndarray, hops: int) -> int:
    """The most nodes within ``hops`` of any node, itself included; exact. The nodes that can be reached along paths which
    don't turn back at once are counted with repeats: as many as there are on a tree, never fewer. Balls are counted, by bits,
    from the greatest of these bounds down, until no bound is above what was found."""
    if not hops or not len(a):
        return min(n, 1)
    src, dst, m = np.concatenate([a, b]), np.concatenate([b, a]), len(a)
    comp, ball = _roots(n, a, b), np.ones(2 * m)
    for _ in range(hops - 1):
        ball = np.minimum(1 + np.bincount(src, ball, n)[dst] - np.concatenate([ball[m:], ball[:m]]), n)
    bound = np.minimum(1 + np.bincount(src, ball, n), np.bincount(comp, minlength=n)[comp]).astype(np.int64)
    best, first = 1, True
    while (todo := np.flatnonzero(bound > best)).size:
        todo = todo[np.argsort(-bound[todo], kind="stable")]
        todo = todo[:64] if first else todo
        # components don't meet, so the i-th start of each has the i-th bit
        by = np.argsort(comp[todo], kind="stable")
        opens = np.flatnonzero(np.diff(comp[todo][by], prepend=-1))
        place = np.empty(len(todo), np.int64)
        place[by] = np.arange(len(todo)) - np.repeat(opens, np.diff(np.append(opens, len(todo))))
        live = np.zeros(n, bool)
        live[comp[todo]] = True
        inside = np.flatnonzero(live[comp])
        inside = inside[np.argsort(comp[inside], kind="stable")]
        at = np.empty(n, np.int64)
        at[inside] = np.arange(len(inside))
        arms = live[comp[src]]
        x, y = at[src[arms]], at[dst[arms]]
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        heads = np.flatnonzero(np.diff(x, prepend=-1))
        words = int(min(place.max() // 64 + 1, max(1, 2**22 // len(x))))
        now = place < 64 * words
        bits = np.zeros((len(inside), words), np.uint64)
        np.bitwise_or.at(bits, (at[todo[now]], place[now] // 64), np.left_shift(np.uint64(1), (place[now] % 64).astype(np.uint64)))
        for _ in range(hops):
            more = bits.copy()
            more[x[heads]] |= np.bitwise_or.reduceat(bits[y], heads, axis=0)
            if np.array_equal(more, bits):
                break
            bits = more
        opens = np.flatnonzero(np.diff(comp[inside], prepend=-1))
        for w in range(words):
            ones = np.unpackbits(np.ascontiguousarray(bits[:, w : w + 1]).view(np.uint8), axis=1)
            best = max(best, int(np.add.reduceat(ones, opens, axis=0, dtype=np.int64).max()))
        bound[todo[now]], first = 0, False
    return best


#: Rounds in which the nodes of one degree are taken side by side, before the rest are taken one by one.
TAKES = 64


def _removals(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each node in the order of removal: the greatest degree then, the least id. Among nodes of the greatest
    degree a removed one takes its neighbours out of that degree, and none comes in: those removed are the first independent
    set in order of ids, found by rounds."""
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.argsort(src, kind="stable")
    dst, begin = dst[by], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    degree, place, done = np.diff(begin), np.full(n, n), 0

    def arms(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = begin[nodes + 1] - begin[nodes]
        ends = np.cumsum(many)
        return np.repeat(nodes, many), dst[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[nodes] - ends + many, many)]

    while done < n:
        most = degree.max()
        left = np.flatnonzero(degree == most)
        on, taken = np.zeros(n, bool), []
        on[left] = True
        for _ in range(TAKES if most else 0):
            if not len(left):
                break
            x, y = arms(left)
            beaten = np.zeros(n, bool)
            beaten[x[on[y] & (y < x)]] = True
            go = left[~beaten[left]]
            taken.append(go)
            on[go] = False
            on[arms(go)[1]] = False
            left = left[on[left]]
        if most:
            for v in left.tolist():
                if on[v]:
                    taken.append(np.array([v]))
                    on[dst[begin[v] : begin[v + 1]]] = False
            left = np.sort(np.concatenate(taken))
        place[left], degree[left] = np.arange(done, done + len(left)), -1
        done += len(left)
        y = arms(left)[1]
        y = y[degree[y] >= 0]
        degree -= np.bincount(y, minlength=n)
    return place


def _robustness(n: int, a: np.ndarray, b: np.ndarray) -> float:
    """Sum of largest component / n after each removal of the node of greatest degree then, over n - 1; components are
    joined in reverse order of removal. Edges are distinct, between nodes 0..n-1."""
    if n < 2:
        return 0.0
    from array import array

    place = _removals(n, a, b)
    when = n - 1 - np.minimum(place[a], place[b])  # in reverse order the last node stands at 0
    by = np.argsort(when, kind="stable")
    root, size = array("q", range(n)), array("q", [1]) * n
    best, total, since = 1, 0, 0
    for lo in range(0, len(by), 65536):
        few = by[lo : lo + 65536]
        for x, y, t in zip(a[few].tolist(), b[few].tolist(), when[few].tolist()):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                if size[x] < size[y]:
                    x, y = y, x
                root[y] = x
                size[x] += size[y]
                if size[x] > best:
                    total, since, best = total + best * (t - since), t, size[x]
    return (total + best * (n - 1 - since)) / n / (n - 1)


def robustness(edges: DataFrame, nodes: DataFrame, max_edges: int = HELPER_EDGES) -> DataFrame:
    """cand_id, robustness: under removal of the node of greatest degree, again and again (ties: least id). Adaptive,
    so one candidate is one task; raises beyond ``max_edges``, where ``robustness_steps`` is the way."""
    most = edges.groupBy("cand_id").count().agg(F.max("count")).first()[0] or 0
    if most > max_edges:
        raise ValueError(f"a candidate has {most} edges: use robustness_steps")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _robustness(*_numbered(pdf["src"].to_numpy(), pdf["dst"].to_numpy()))
        return pd.DataFrame({"cand_id": [pdf["cand_id"].iloc[0]], "robustness": [round(r, 9)]})

    rows = edges.select("cand_id", "src", "dst").where("src <> dst").union(nodes.select("cand_id", "node", "node"))
    return rows.groupBy("cand_id").applyInPandas(run, "cand_id int, robustness double")


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many nodes, and distinct edges of nodes numbered in the order of ids; a row of one node twice stands for the node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    n = max(len(ids), 1)
    key = np.unique((np.minimum(x, y) * n + np.maximum(x, y))[x != y])
    return len(ids), key // n, key % n


def scores_without(edges: DataFrame, removed: DataFrame, pairs: bool = True, hops: int | None = None, lost: bool = False) -> DataFrame:
    """cand_id, pcg (``pairs``: connected pairs), max_reach (``hops``: the widest reach), robustness (``lost``) of each
    candidate of ``removed`` (cand_id, node), whose nodes go from ``edges``; the graph's nodes are the ends of edges.

    For graphs of at most HELPER_EDGES edges. Candidates are dealt out in blocks, and a block's task gets the graph once and
    each candidate's nodes, so that no candidate's graph or components are ever written or shuffled. Edges and nodes come
    packed, some thousands a row: a task doesn't hold them as rows beside its arrays. All scores are exact; a candidate that
    leaves no node has no row.
    """
    spark = edges.sparkSession
    cands = removed.agg(F.max("cand_id") + 1).first()[0] or 0
    each = max(1, min(16, cands // (2 * spark.sparkContext.defaultParallelism)))
    block = F.floor(F.col("cand_id") / each).cast("int").alias("block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cand, packed = pdf["cand_id"].to_numpy(), pdf["packed"].tolist()
        del pdf
        whole = [np.asarray(packed[i]).reshape(2, -1) for i in np.flatnonzero(cand < 0)]
        ends = np.concatenate(whole, 1) if whole else np.empty((2, 0), np.int64)
        ids, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(2, -1)
        del whole, ends
        gone = {c: [np.asarray(packed[i]) for i in np.flatnonzero(cand == c)] for c in np.unique(cand[cand >= 0]).tolist()}
        out = []
        for c, few in gone.items():
            stays, node = np.ones(len(ids), bool), np.concatenate(few)
            place = np.minimum(np.searchsorted(ids, node), max(len(ids) - 1, 0))
            stays[place[ids[place] == node] if len(ids) else place[:0]] = False
            n, held = int(stays.sum()), stays[a] & stays[b] & (a != b)
            if not n:
                continue
            number = np.cumsum(stays) - 1
            x, y = number[a[held]], number[b[held]]
            out.append((c, _pairs(n, x, y) if pairs else None, _widest(n, x, y, hops) if hops is not None else None, round(_robustness(n, x, y), 9) if lost else None))
        return pd.DataFrame(out, columns=["cand_id", "pcg", "max_reach", "robustness"]).astype({"pcg": "Int64", "max_reach": "Int64", "robustness": "float64"})

    def pack(batches):
        for pdf in batches:
            for (blk, c), few in pdf.groupby(["block", "cand_id"]):
                yield pd.DataFrame({"block": [blk], "cand_id": [c], "packed": [few[["src", "dst"]].to_numpy().T.ravel() if c < 0 else few["src"].to_numpy()]})

    packed = lambda t: t.mapInPandas(pack, "block int, cand_id int, packed array<long>")
    canonical = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    whole = packed(canonical.select(F.lit(-1).alias("block"), F.lit(-1).alias("cand_id"), "src", "dst"))
    rows = whole.drop("block").crossJoin(F.broadcast(removed.select(block).distinct())).select("block", "cand_id", "packed")
    rows = rows.union(packed(removed.select(block, F.col("cand_id").cast("int"), F.col("node").alias("src"), F.col("node").alias("dst"))))
    got = rows.groupBy("block").applyInPandas(run, "cand_id int, pcg long, max_reach long, robustness double")
    return got.select("cand_id", *["pcg"] * pairs, *["max_reach"] * (hops is not None), *["robustness"] * lost)


def robustness_steps(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """cand_id, robustness, for big graphs: ``rounds`` rounds, each removing an equal share of the nodes, those of the
    greatest degree then (ties: least id); the mean largest component over n.

    The cut is found on a histogram of degrees, and within the degree that it falls in on one of ranges of ids: only the
    nodes of one range are ranked, so no candidate's nodes meet in a window. With n - 1 rounds it is ``robustness``.
    """
    return scoped(lambda: _robustness_steps(edges, nodes, rounds), "robustness")


#: Ranges of ids into which the nodes of one degree are counted.
RANGES = 4096


def _worst(d: DataFrame, want: DataFrame) -> DataFrame:
    """cand_id, node of the first ``want`` (cand_id, want) nodes by degree descending, then id, of ``d`` (cand_id, node,
    degree)."""
    every = W.partitionBy("cand_id")
    hist = d.groupBy("cand_id", "degree").count().withColumn("before", F.sum("count").over(every.orderBy(F.desc("degree")).rowsBetween(W.unboundedPreceding, -1)))
    hist = hist.join(want, "cand_id").withColumn("room", F.col("want") - F.coalesce("before", F.lit(0)))
    cut = materialise(hist.where("room > 0").select("cand_id", "degree", "room", (F.col("room") >= F.col("count")).alias("whole")), "cut")
    taken = d.join(cut, ["cand_id", "degree"])
    part = taken.where("not whole")
    span = part.groupBy("cand_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    part = part.join(span, "cand_id").withColumn("r", F.expr(f"cast((node - lo) * {RANGES} div (hi - lo + 1) as int)"))
    by = part.groupBy("cand_id", "room", "r").count().withColumn("before", F.coalesce(F.sum("count").over(every.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by = materialise(by.where("before < room").select("cand_id", "r", (F.col("room") - F.col("before")).alias("left"), (F.col("before") + F.col("count") <= F.col("room")).alias("all")), "cut")
    part = part.select("cand_id", "node", "r").join(by, ["cand_id", "r"])
    edge = part.where("not all").withColumn("n", F.row_number().over(W.partitionBy("cand_id", "r").orderBy("node"))).where("n <= left")
    return taken.where("whole").select("cand_id", "node").union(part.where("all").select("cand_id", "node")).union(edge.select("cand_id", "node"))


def _robustness_steps(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    n = materialise(nodes.groupBy("cand_id").agg(F.count("*").alias("n")), "n")
    left, e, out = nodes.select("cand_id", "node"), edges.select("cand_id", "src", "dst"), None
    for k in range(1, rounds):
        share = lambda k: F.floor(F.col("n") * k / rounds)
        d = materialise(degrees(e, left, loops=0, keys=("cand_id",)), "degree")
        gone = materialise(_worst(d, n.select("cand_id", (share(k) - share(k - 1)).alias("want"))), "gone")
        left = materialise(left.join(gone, ["cand_id", "node"], "left_anti"), "steps")
        e = materialise(e.join(gone.withColumnRenamed("node", "src"), ["cand_id", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["cand_id", "dst"], "left_anti").select("cand_id", "src", "dst"), "steps")
        size = scoped(lambda: largest_component(components(e, left)).join(n, "cand_id").select("cand_id", (F.col("largest") / F.col("n")).alias("x")), "largest")  # noqa: B023
        out = size if out is None else out.union(size)
    return out.groupBy("cand_id").agg((F.sum("x") / (rounds - 1)).alias("robustness"))


def robustness_gain(base: DataFrame, scored: DataFrame) -> DataFrame:
    """cand_id, gain = R of the whole graph - R of the candidate's."""
    return scored.crossJoin(base.select(F.col("robustness").alias("r0"))).select("cand_id", (F.col("r0") - F.col("robustness")).alias("gain"))
