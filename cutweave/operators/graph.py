"""Graph tables: canonical edges, indexes, degrees, neighbours, pairs, splits, set operations, samples and walks.

Edges are undirected, ``src <= dst``, distinct. Hubs: joins on a pivot leave skew to AQE's skew join, which splits a hot
key's partition; nothing gathers a node's neighbours but where the result itself is such a list.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cutweave.functions.rand import order, permuted, turns, u
from cutweave.session import materialise


def canonical_edges(df: DataFrame, keep_loops: bool = True) -> DataFrame:
    """Distinct undirected edges with the lesser end first; rows with a null end are dropped."""
    e = df.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return e if keep_loops else e.where("src <> dst")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, a self-loop once; rows with a null end are dropped. Edges are made distinct as pairs,
    half as many rows as arms."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return canonical_edges(edges).select(F.explode(F.when(F.col("src") == F.col("dst"), F.slice(both, 1, 1)).otherwise(both)).alias("_e")).select("_e.src", "_e.dst")


def adjacency(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of canonical edges, without a shuffle."""
    return edges.select(*keys, "src", "dst").unionAll(edges.where("src <> dst").select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_set(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    n = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (n.union(nodes.select("node")) if nodes is not None else n).distinct()


def dense_rank_ids(values: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """0..n-1 in the order of a distinct column, without a global window: range partitions are written, counted, and
    ranked each by itself from the sum of the counts before it."""
    part = values.select(column).repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    part = materialise(part, "index")
    offsets = part.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = part.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1)
    return local.join(F.broadcast(offsets), "_p").select(column, (F.col("_before") + F.col("_r")).cast("long").alias(out))


def index_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, idx; edges relabelled by idx)."""
    idx = dense_rank_ids(node_set(edges, nodes), "node")
    a, b = idx.select(F.col("node").alias("src"), F.col("idx").alias("s")), idx.select(F.col("node").alias("dst"), F.col("idx").alias("d"))
    return idx, edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def graph_stats(edges: DataFrame, rate: float, gene_rate: float, nodes: DataFrame | None = None) -> DataFrame:
    """One row: n, m, k = max(1, floor(rate n)) and selected genes, likewise."""
    n = node_set(edges, nodes).agg(F.count("*").alias("n"))
    cut = lambda r: F.greatest(F.lit(1), F.floor(F.col("n") * r)).cast("long")
    return n.crossJoin(edges.agg(F.count("*").alias("m"))).withColumns({"k": cut(rate), "selected_genes": cut(gene_rate)})


def degrees(edges: DataFrame, nodes: DataFrame | None = None, loops: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """node, degree; a self-loop counts ``loops``, and a node of ``nodes`` without edges has 0."""
    ends = edges.select(*keys, F.explode(F.when(F.col("src") == F.col("dst"), F.array_repeat("src", loops)).otherwise(F.array("src", "dst"))).alias("node"))
    d = ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    return nodes.join(d, [*keys, "node"], "left").fillna(0, ["degree"]) if nodes is not None else d


def rank_by(df: DataFrame, *order_by) -> DataFrame:
    """A global rank from 1: ranges are written in order, counted, and ranked each by itself."""
    part = materialise(df.repartitionByRange(*order_by).withColumn("_p", F.spark_partition_id()), "rank")
    before = part.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return part.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order_by))).join(F.broadcast(before), "_p").withColumn("rank", (F.col("_b") + F.col("_r")).cast("long")).drop("_p", "_r", "_b")


def degree_rank(edges: DataFrame) -> DataFrame:
    """node, degree, centrality d / (n - 1), rank from 1 by degree descending, ties by node; ranked over ranges of both, so
    that neither all nodes nor all of one degree meet in a task."""
    d = degrees(edges)
    r = rank_by(d, F.desc("degree"), F.asc("node"))
    return r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n")))).select("node", "degree", F.round(F.try_divide("degree", F.col("n") - 1), 6).alias("centrality"), "rank")


def minmax_degree(edges: DataFrame) -> DataFrame:
    """node, x = (d - min) / (max - min); 1.0 where all are equal."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi")))).select("node", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))


def neighbor_lists(edges: DataFrame, hub_cap: int | None = None) -> DataFrame:
    """node, degree, nbrs (sorted). With ``hub_cap`` also chunk: a node of a greater degree has several rows, each with
    its neighbours in one of ceil(degree / hub_cap) equal ranges of their ids (ranges without any have no row); in order
    of chunk they are the whole sorted list."""
    a = adjacency(edges)
    if hub_cap is None:
        return a.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.array_sort(F.collect_set("dst")).alias("nbrs"))
    d = a.groupBy("src").agg(F.count("*").alias("degree"), F.min("dst").alias("lo"), F.max("dst").alias("hi")).withColumn("parts", F.ceil(F.col("degree") / hub_cap))
    c = a.join(d, "src").withColumn("chunk", F.expr("cast((dst - lo) * parts div (hi - lo + 1) as int)"))
    return c.groupBy(F.col("src").alias("node"), "degree", "chunk").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def gene_pool_nodes(edges: DataFrame, nodes: DataFrame | None = None, allow_self: bool = False) -> DataFrame:
    """node, n_nbrs, n_non_nbrs of the nodes that have both a neighbour and a node that isn't one; counted, not listed."""
    d = degrees(edges, node_set(edges, nodes), loops=1)
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    return d.crossJoin(n).select("node", F.col("degree").alias("n_nbrs"), (F.col("n") - F.col("degree") - (0 if allow_self else 1)).alias("n_non_nbrs")).where("n_nbrs > 0 and n_non_nbrs > 0")


def sample_non_neighbors(nodes_idx: DataFrame, edges: DataFrame, per_node: int, seed: int) -> DataFrame:
    """node, nbr, r: hash-picked non-neighbours. ``nodes_idx``: node, idx. Picks by index, then an anti-join; a node may
    get fewer than ``per_node``."""
    n = F.broadcast(nodes_idx.agg(F.count("*").alias("n")))
    p = nodes_idx.crossJoin(n).select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("r")).withColumn("pick", F.floor(u(seed, F.col("node"), F.col("r"), "non") * F.col("n")).cast("long"))
    got = p.join(nodes_idx.select(F.col("idx").alias("pick"), F.col("node").alias("nbr")), "pick").where("node <> nbr")
    return got.join(adjacency(edges).select(F.col("src").alias("node"), F.col("dst").alias("nbr")), ["node", "nbr"], "left_anti").select("node", "nbr", "r").dropDuplicates(["node", "nbr"])


def two_hop_pairs(edges: DataFrame) -> DataFrame:
    """src < dst, common: pairs that share a neighbour, and how many."""
    a = adjacency(edges.where("src <> dst"))
    x, y = a.select(F.col("src").alias("w"), F.col("dst").alias("src")), a.select(F.col("src").alias("w"), "dst")
    return x.join(y, "w").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("common"))


def non_edges(edges: DataFrame) -> DataFrame:
    """src < dst at distance two that aren't linked: all the pairs that can score. Others are counted, never listed."""
    return two_hop_pairs(edges).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def non_edges_from(edges: DataFrame, nodes: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """src < dst of every pair of nodes that isn't linked and has an end in ``queries`` (node), at any distance: the exact,
    listed form of non-edges for a stated set of nodes. The result has at most queries x nodes rows, and that is the work.

    A node meets lists of at most some ``block`` queries, less those that it is linked to, and the pairs are rows only then:
    what is shuffled grows with nodes and edges, not with pairs. A pair of two queries comes from its lesser end alone.
    """
    known = nodes.select("node").where("node is not null").distinct()
    q = queries.select(F.col("node").alias("q")).where("q is not null").distinct().join(known.select(F.col("node").alias("q"), F.lit(0).alias("new")), "q", "left")
    blocks = max(1, -(-q.count() // block))
    # those that aren't nodes themselves have lists of their own: no other end brings their pairs
    q = q.select("q", (F.pmod(F.xxhash64("q"), F.lit(blocks)) + F.coalesce("new", F.lit(blocks))).alias("block"))
    own = known.join(q.select(F.col("q").alias("node"), F.lit(True).alias("asks")), "node", "left")
    linked = adjacency(edges).select(F.col("src").alias("node"), F.col("dst").alias("q")).join(q, "q").groupBy("node", "block").agg(F.collect_set("q").alias("linked"))
    lists = q.groupBy("block").agg(F.collect_list("q").alias("qs"))
    every = own.crossJoin(F.broadcast(q.select("block").distinct())).join(linked, ["node", "block"], "left").join(lists, "block")
    left = F.when(F.col("linked").isNull(), F.col("qs")).otherwise(F.array_except("qs", "linked"))
    pairs = every.select("node", "asks", "block", F.explode(left).alias("q")).where(f"node <> q and (asks is null or node < q or block >= {blocks})")
    return pairs.select(F.least("node", "q").alias("src"), F.greatest("node", "q").alias("dst"))


def unranked(number: Column) -> tuple[Column, Column]:
    """(i, j), i < j, of a pair's number j (j - 1) / 2 + i, exact for every long whose pairs are longs."""
    j = F.floor((1 + F.sqrt(1 + 8 * number.cast("double"))) / 2).cast("long")
    first = lambda x: F.when(x % 2 == 0, (x / 2).cast("long") * (x - 1)).otherwise(x * ((x - 1) / 2).cast("long"))
    j = F.when(first(j) > number, j - 1).when(first(j + 1) <= number, j + 1).otherwise(j)
    return number - first(j), j


#: Places of a permutation that one row stands for until they are looked at.
STRIDE = 1024


def numbered_places(keys: DataFrame, lo: int, hi: int, n: int, *parts) -> DataFrame:
    """The rows of ``keys`` with k from ``lo`` to ``hi`` - 1 and number: where the permutation of 0..n-1 that ``parts`` key
    sends k. A permutation's keys are made once a row, and its places are dealt out to tasks before they are looked at.

    The numbers are written: joined as they are, filters on them would make each a dozen times over, and the rows would be
    taken for as few as ``keys`` and broadcast."""
    t = keys if lo < hi else keys.limit(0)
    t = t.withColumn("_by", turns(n, *parts)).withColumn("_lo", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(max(lo, hi - 1)).cast("long"), F.lit(STRIDE).cast("long"))))
    t = t.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, *keys.columns, "_lo")
    t = t.withColumn("k", F.explode(F.sequence("_lo", F.least(F.col("_lo") + STRIDE, F.lit(hi).cast("long")) - 1)))
    return materialise(t.select(*keys.columns, "k", permuted(F.col("k"), n, *parts, by=F.col("_by")).alias("number")), "numbers")


def draw_pairs(nodes_idx: DataFrame, edges: DataFrame, pop: int, each: int, seed: int, accept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """cand_id, pos, src < dst: for each candidate the first ``each`` pairs of nodes, in its own permutation of all pairs'
    numbers, that aren't linked by ``edges`` and that ``accept`` (a filter of rows with src, dst) lets pass; fewer only where
    no more exist. ``nodes_idx``: node, idx. Pairs at any distance are drawn; none are listed: a round looks at as many
    numbers as are wanted, and the next, for candidates that are short, at twice as many."""
    n = nodes_idx.count()
    every = n * (n - 1) // 2
    spark = nodes_idx.sparkSession
    want = spark.range(pop).select(F.col("id").cast("int").alias("cand_id"))
    held, lo, step = None, 0, each + 16
    x, y = (nodes_idx.select(F.col("idx").alias(c), F.col("node").alias(f"n{c}")) for c in ("i", "j"))
    while lo < every and each > 0:
        hi = min(every, lo + step)
        i, j = unranked(F.col("number"))
        t = numbered_places(want, lo, hi, every, seed, F.col("cand_id"), "pair").select("cand_id", "k", i.alias("i"), j.alias("j"))
        t = t.join(x, "i").join(y, "j").select("cand_id", "k", F.least("ni", "nj").alias("src"), F.greatest("ni", "nj").alias("dst"))
        t = t.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        t = materialise((accept(t) if accept else t).select("cand_id", "k", "src", "dst"), "pairs")
        held = t if held is None else held.union(t)
        full = held.groupBy("cand_id").count().where(F.col("count") >= each)
        want = materialise(want.join(full, "cand_id", "left_anti"), "short")
        if want.isEmpty():
            break
        lo, step = hi, 2 * step
    if held is None:
        return want.select("cand_id", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")).limit(0)
    pos = F.row_number().over(W.partitionBy("cand_id").orderBy("k")) - 1
    return held.withColumn("pos", pos).where(F.col("pos") < each).select("cand_id", "pos", "src", "dst")


def count_non_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return graph_stats(edges.where("src <> dst"), 0.1, 0.1, nodes).select((F.col("n") * (F.col("n") - 1) / 2 - F.col("m")).cast("long").alias("non_edges"))


def top_share(df: DataFrame, key, share: float, flag: str = "chosen") -> DataFrame:
    """``df`` with whether a row is among the first floor(share n) by ``key``, a text of even spread such as a hash.

    The cut is found on a histogram of the key's first 16 bits; only the rows of the bucket that the cut falls in are
    ranked by themselves.
    """
    d = df.withColumn("_k", key).withColumn("_b", F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"))
    hist = d.groupBy("_b").count()
    cut = hist.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    want = hist.agg(F.floor(F.sum("count") * F.lit(share)).cast("long").alias("_want"))
    cut = cut.crossJoin(F.broadcast(want)).select("_b", (F.col("_want") - F.col("_before")).alias("_room"), (F.col("_before") + F.col("count") <= F.col("_want")).alias("_all"))
    d = d.join(F.broadcast(cut), "_b").withColumn("_r", F.when(F.col("_all"), 0).when(F.col("_room") <= 0, F.lit(None)).otherwise(F.row_number().over(W.partitionBy("_b").orderBy("_k"))))
    return d.withColumn(flag, F.coalesce(F.col("_r") <= F.col("_room"), F.lit(False)) | F.col("_all")).drop("_k", "_b", "_room", "_all", "_r")


def edge_train_test_split(edges: DataFrame, test: float, seed: int) -> DataFrame:
    """src, dst, split: the first floor(test m) edges in hash order are test; all nodes stay in the train graph."""
    return top_share(edges.select("src", "dst"), order(seed, F.col("src"), F.col("dst")), test).select("src", "dst", F.when(F.col("chosen"), "test").otherwise("train").alias("split"))


def random_split(nodes: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """node, split: disjoint shares of the nodes in hash order: train, val, the rest test."""
    key = order(seed, F.col("node"))
    s = top_share(top_share(nodes.select("node"), key, train, "a"), key, train + val, "b")
    return s.select("node", F.when(F.col("a"), "train").when(F.col("b"), "val").otherwise("test").alias("split"))


def edge_set_ops(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Union, minus or intersect of canonical edges."""
    a, b = (canonical_edges(x) for x in (a, b))
    return a.union(b).distinct() if op == "union" else a.join(b, ["src", "dst"], "left_anti" if op == "minus" else "left_semi")


def greedy_degree_peel(edges: DataFrame, keep: int, which: str = "min", max_edges: int = 2_000_000) -> DataFrame:
    """node, step of each removed node: one at a time, the node of least (or greatest) degree at that time, the lesser
    id on ties, until ``keep`` are left. The order is one chain, so it runs in one task and refuses, by raising, a graph
    of more than ``max_edges`` edges; ``batch_peel`` is the way beyond."""
    m = edges.limit(max_edges + 1).count()
    if m > max_edges:
        raise ValueError(f"more than {max_edges} edges: use batch_peel")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        nbrs: dict[int, set] = {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            nbrs.setdefault(s, set()).add(d)
            nbrs.setdefault(d, set()).add(s)
        sign = 1 if which == "min" else -1
        heap = [(sign * len(v - {k}), k) for k, v in nbrs.items()]
        heapq.heapify(heap)
        out, left = [], len(nbrs)
        while left > keep and heap:
            d, k = heapq.heappop(heap)
            if k not in nbrs or d != sign * len(nbrs[k] - {k}):
                continue
            for x in nbrs.pop(k) - {k}:
                nbrs[x].discard(k)
                heapq.heappush(heap, (sign * len(nbrs[x] - {x}), x))
            left -= 1
            out.append((k, len(out)))
        return pd.DataFrame(out, columns=["node", "step"], dtype="int64")

    return edges.select("src", "dst", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "node long, step long")


def batch_peel(edges: DataFrame, keep: int, batch: int, which: str = "min") -> DataFrame:
    """node, step of removed nodes, ``batch`` a round by degree; degrees are counted anew each round."""
    left, nodes, out, step = edges, materialise(node_set(edges), "peel"), None, 0
    n = nodes.count()
    while n > keep:
        d = degrees(left, nodes)
        gone = materialise(d.orderBy(F.asc("degree") if which == "min" else F.desc("degree"), "node").limit(min(batch, n - keep)).select("node", F.lit(step).cast("long").alias("step")), "peel")
        n -= gone.count()
        out = gone if out is None else out.union(gone)
        nodes = materialise(nodes.join(gone, "node", "left_anti"), "peel")
        left = materialise(left.join(gone, F.col("src") == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"), "peel")
        step += 1
    return out if out is not None else nodes.limit(0).select("node", F.lit(0).cast("long").alias("step"))


def ego_sample(edges: DataFrame, size: int) -> DataFrame:
    """ego, node, pos: at most ``size`` one-hop neighbours by id; where short, two-hop nodes that are neither; the ego
    itself stands last."""
    a = adjacency(edges.where("src <> dst"))
    one = a.select(F.col("src").alias("ego"), F.col("dst").alias("node"), F.lit(1).alias("hop"))
    short = one.groupBy("ego").count().where(F.col("count") < size).select("ego")
    two = one.join(short, "ego").join(a.select(F.col("src").alias("node"), "dst"), "node").select("ego", F.col("dst").alias("node"), F.lit(2).alias("hop")).where("ego <> node").distinct()
    two = two.join(one, ["ego", "node"], "left_anti").select("ego", "node", "hop")
    r = one.union(two).withColumn("pos", F.row_number().over(W.partitionBy("ego").orderBy("hop", "node"))).where(F.col("pos") <= size)
    own = r.groupBy("ego").agg((F.max("pos") + 1).alias("pos")).select("ego", F.col("ego").alias("node"), "pos")
    return r.select("ego", "node", "pos").union(own)


def ego_features(edges: DataFrame, size: int) -> DataFrame:
    """ego, i, j, value: the sub-adjacency of each ego's sample; its first row and column scaled by the degrees of the
    sample's nodes, and degrees added on the diagonal."""
    s = ego_sample(edges, size)
    d = degrees(edges, loops=1)
    a = adjacency(edges.where("src <> dst"))
    i, j = s.select("ego", F.col("node").alias("src"), F.col("pos").alias("i")), s.select("ego", F.col("node").alias("dst"), F.col("pos").alias("j"))
    cells = i.join(a, "src").join(j, ["ego", "dst"])
    cells = cells.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    off = cells.select("ego", "i", "j", F.when(F.col("i") == 1, F.col("dd")).when(F.col("j") == 1, F.col("ds")).otherwise(1).alias("value"))
    diag = s.join(d, "node").select("ego", F.col("pos").alias("i"), F.col("pos").alias("j"), F.col("degree").alias("value"))
    return off.union(diag)


def random_walks(edges: DataFrame, length: int, seed: int) -> DataFrame:
    """start, step, node: a walk of ``length`` steps from every node; the neighbour of rank floor(u d) comes next. Arms are
    numbered over ranges, through all nodes, and a step finds its arm by number: no hub's arms meet in a task."""
    a = adjacency(edges.where("src <> dst"))
    arms = materialise(rank_by(a.select(F.col("src").alias("node"), F.col("dst").alias("next")), F.asc("node"), F.asc("next")), "walk")
    size = materialise(arms.groupBy("node").agg(F.min("rank").alias("first"), F.count("*").alias("degree")), "walk")
    now = size.select(F.col("node").alias("start"), "node")
    out = now.select("start", F.lit(0).alias("step"), "node")
    for k in range(1, length + 1):
        pick = now.join(size, "node").select("start", (F.col("first") + F.floor(u(seed, F.col("start"), k) * F.col("degree"))).cast("long").alias("rank"))
        now = materialise(pick.join(arms.select("rank", "next"), "rank").select("start", F.col("next").alias("node")), "walk")
        out = out.union(now.select("start", F.lit(k).alias("step"), "node"))
    return out


def rwr_subgraph(walks: DataFrame, size: int) -> DataFrame:
    """start, node, pos: the first size - 1 distinct nodes that a walk visits other than its start, then the start."""
    first = walks.where("node <> start").groupBy("start", "node").agg(F.min("step").alias("step"))
    r = first.withColumn("pos", F.row_number().over(W.partitionBy("start").orderBy("step", "node"))).where(F.col("pos") < size).select("start", "node", "pos")
    return r.union(walks.where("step = 0").select("start", "node", F.lit(size).alias("pos")))
