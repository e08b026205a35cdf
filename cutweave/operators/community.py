"""Communities: modularity, partition similarity, label propagation, and the walk matrix with its embedding. Louvain is in
``louvain``."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cutweave.functions.rand import u
from cutweave.operators.graph import adjacency, degrees
from cutweave.session import dealt, materialise, scoped


def modularity(edges: DataFrame, comms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, q: the sum over communities of m_c / m - (d_c / 2m)^2."""
    on = lambda c, out: comms.select(*[k for k in keys if k in comms.columns], F.col("node").alias(c), F.col("comm").alias(out))
    k = [x for x in keys if x in comms.columns]
    e = edges.join(on("src", "a"), [*k, "src"]).join(on("dst", "b"), [*k, "dst"])
    ends = e.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("a") == F.col("b")).cast("long").alias("inside")), F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("inside")))).alias("x"))
    per = ends.groupBy(*keys, "x.c").agg(F.count("*").alias("d"), F.sum("x.inside").alias("m_c"))
    total = per.groupBy(*keys).agg((F.sum("d") / 2).alias("m")) if keys else per.agg((F.sum("d") / 2).alias("m"))
    j = per.join(total, list(keys)) if keys else per.crossJoin(F.broadcast(total))
    q = F.sum(F.col("m_c") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2))
    return j.groupBy(*keys).agg(q.alias("q")) if keys else j.agg(q.alias("q"))


def q_fitness(q: DataFrame) -> DataFrame:
    return q.withColumn("fitness", F.exp(-F.col("q")))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, nmi = 2 I / (H_a + H_b); 1 where both entropies are 0."""
    t = a.select("node", F.col("comm").alias("x")).join(b.select("node", F.col("comm").alias("y")), "node").groupBy("x", "y").agg(F.count("*").alias("n"))
    n = F.broadcast(t.agg(F.sum("n").alias("total")))
    p = F.col("n") / F.col("total")
    h = lambda k: t.groupBy(k).agg(F.sum("n").alias("n")).crossJoin(n).agg((-F.sum(p * F.log(p))).alias("h_" + k))
    joint = t.crossJoin(n).agg((-F.sum(p * F.log(p))).alias("h_xy"))
    r = h("x").crossJoin(h("y")).crossJoin(joint)
    return r.select(F.when(F.col("h_x") + F.col("h_y") < 1e-15, 1.0).otherwise(2 * (F.col("h_x") + F.col("h_y") - F.col("h_xy")) / (F.col("h_x") + F.col("h_y"))).alias("nmi"))


#: Arms of nodes whose labels one task counts, where there are many.
ARMS = 500_000


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """node, comm after synchronous rounds from each node's own id: the commonest label among neighbours, the least on
    ties. Large graphs' arms are dealt to as many tasks as ARMS asks for, by neighbour and then by node."""
    a = materialise(adjacency(edges.where("src <> dst")), "labels")
    parts = a.count() // ARMS
    now = a.select(F.col("src").alias("node")).distinct().withColumn("comm", F.col("node"))
    for _ in range(rounds):
        told = dealt(a, parts, "dst").join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "comm")
        votes = dealt(told, parts, "node").groupBy("node", "comm").count()
        now = materialise(votes.groupBy("node").agg(F.max_by("comm", F.struct("count", -F.col("comm"))).alias("comm")), "labels")
    return now


def walk_matrix(edges: DataFrame) -> DataFrame:
    """row, col, value of M = (P + P^2) / 2 with P = A / (degree + 1)."""
    a = adjacency(edges.where("src <> dst"))
    p = a.join(degrees(edges.where("src <> dst")).select(F.col("node").alias("src"), "degree"), "src").select("src", "dst", (1.0 / (F.col("degree") + 1)).alias("p"))
    two = p.select("src", F.col("dst").alias("w"), F.col("p").alias("p1")).join(p.select(F.col("src").alias("w"), "dst", F.col("p").alias("p2")), "w").select("src", "dst", (F.col("p1") * F.col("p2")).alias("p"))
    return p.union(two).groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg((F.sum("p") / 2).alias("value"))


def lowrank_embedding(edges: DataFrame, rank: int = 6, rounds: int = 8, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, vec: the leading left singular vectors of the walk matrix, each times the root of its singular value.

    Block power iteration on M M^T: P is applied twice to a thin block, M is never formed. The driver sees rank x rank
    Gram matrices alone, one for each graph (``keys``). Vectors are settled up to sign and rotation: compare distances.
    """
    k = list(keys)
    simple = edges.where("src <> dst")
    d = adjacency(simple, keys).groupBy(*k, "src").agg(F.count("*").alias("degree"))
    p = materialise(adjacency(simple, keys).join(d, [*k, "src"]).select(*k, "src", "dst", (1.0 / (F.col("degree") + 1)).alias("p")), "embed")
    cols = [f"v{i}" for i in range(rank)]
    v = p.select(*k, F.col("src").alias("node")).distinct().select(*k, "node", *((u(seed, F.col("node"), i) - 0.5).alias(c) for i, c in enumerate(cols)))

    def times(x: DataFrame, by: str, to: str) -> DataFrame:
        return p.join(x.withColumnRenamed("node", by), [*k, by]).groupBy(*k, F.col(to).alias("node")).agg(*(F.sum(F.col("p") * F.col(c)).alias(c) for c in cols))

    def m(x: DataFrame, by: str, to: str) -> DataFrame:
        one = times(x, by, to)
        return one.union(times(one, by, to)).groupBy(*k, "node").agg(*((F.sum(c) / 2).alias(c) for c in cols))

    def grams(x: DataFrame) -> dict[tuple, np.ndarray]:
        out = {}
        for r in x.groupBy(*k).agg(*(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(rank) for j in range(i, rank))).collect():
            g = np.zeros((rank, rank))
            for i in range(rank):
                for j in range(i, rank):
                    g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
            out[tuple(r[x] for x in k)] = g
        return out

    def turn(x: DataFrame, by: dict[tuple, np.ndarray]) -> DataFrame:
        if not k:
            t = by.get((), np.eye(rank))
            return x.select("node", *(sum(F.col(cols[i]) * float(t[i, j]) for i in range(rank)).alias(cols[j]) for j in range(rank)))
        kinds = ", ".join(f"{c} {dict(x.dtypes)[c]}" for c in k)
        t = x.sparkSession.createDataFrame([(*key, [float(y) for y in m.ravel()]) for key, m in by.items()], f"{kinds}, t array<double>")
        return x.join(F.broadcast(t), k).select(*k, "node", *(sum(F.col(cols[i]) * F.col("t")[i * rank + j] for i in range(rank)).alias(cols[j]) for j in range(rank)))

    value: dict[tuple, np.ndarray] = {}
    for _ in range(rounds):
        v = materialise(m(m(v, "src", "dst"), "dst", "src"), "embed")  # M M^T v
        by = {}
        for key, g in grams(v).items():
            s, q = np.linalg.eigh(g)
            s, q = np.maximum(s[::-1], 1e-24), q[:, ::-1]
            value[key] = np.sqrt(s)  # eigenvalues of M M^T, as the block settles
            by[key] = q / np.sqrt(s)
        v = turn(v, by)
    scaled = turn(v, {key: np.diag(x ** 0.25) for key, x in value.items()})
    return scaled.select(*k, "node", F.array(*cols).alias("vec"))


#: Edges of a graph whose embedding one task may find.
HELD = 2_500_000


def embedding_by_graph(edges: DataFrame, most: int, rank: int = 6, rounds: int = 8, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``lowrank_embedding``, each graph's in one task, where the largest has ``most`` edges, at most HELD; tables beyond that.
    The same steps from the same start: places agree but for rounding. Nothing is written, and no round is a Spark job."""
    if most > HELD:
        return lowrank_embedding(edges, rank, rounds, seed, keys)
    k = list(keys) or ["_g"]
    e = edges.where("src <> dst").select(*keys, "src", "dst")
    e = e if keys else e.withColumn("_g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        n = len(ids)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        share = 1.0 / (np.bincount(src, minlength=n) + 1)
        draw = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16) / 4294967296.0 - 0.5
        v = np.array([[draw(seed, x, i) for x in ids.tolist()] for i in range(rank)])
        # P divides by the degree of the row: after its sums are taken, or before those of its transpose
        plain = lambda x: np.array([share * np.bincount(src, c[dst], n) for c in x])
        turned = lambda x: np.array([np.bincount(src, (share * c)[dst], n) for c in x])
        for _ in range(rounds):
            for times in (turned, plain):
                one = times(v)
                v = (one + times(one)) / 2
            values, q = np.linalg.eigh(v @ v.T)
            values, q = np.maximum(values[::-1], 1e-24), q[:, ::-1]
            v = (q / np.sqrt(values)).T @ v
        v = v * (np.sqrt(values) ** 0.25)[:, None] if rounds else v
        return pd.DataFrame({c: pdf[c].iloc[0] for c in k} | {"node": ids, "vec": list(v.T)}, index=range(n))

    kinds, spark = dict(e.dtypes), edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = e.repartition(tasks, *k).groupBy(*k).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in k) + ", node long, vec array<double>")
    return found.select(*keys, "node", "vec")


def pairwise_distance(emb: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """a, b, dist over all ordered pairs, the diagonal too; with ``queries`` (node) only those from one of them. Listing all
    pairs is nodes squared: beyond a few thousand take a stated query set, or the sums of ``distance_shift_blocks``."""
    from_ = emb if queries is None else emb.join(queries.select("node").distinct(), "node", "left_semi")
    x, y = from_.select(F.col("node").alias("a"), F.col("vec").alias("va")), emb.select(F.col("node").alias("b"), F.col("vec").alias("vb"))
    return y.crossJoin(x).select("a", "b", F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)).alias("dist"))


def distance_shift(dist: DataFrame, base: DataFrame) -> DataFrame:
    """One row, shift = 1 - |corr| of the distances with the base graph's."""
    j = dist.join(base.withColumnRenamed("dist", "dist0"), ["a", "b"])
    return j.agg((1 - F.abs(F.corr("dist", "dist0"))).alias("shift"))


#: Candidates whose distances one task takes together, so that the base's are computed once for all of them.
TOGETHER = 8


def _factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of ``x``'s rows, about their mean place: the product of a row of the first with one of the second is the
    square of their distance. Places are taken about the mean as squares are lost in those of the rows' lengths."""
    own, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
    return np.hstack([-2 * x, own, one]), np.hstack([x, one, own])


def _distance_sums(left: list[np.ndarray], right: list[np.ndarray], rows: int = 64, columns: int = 1024) -> np.ndarray:
    """(graphs, 2): for every graph but the first the sum of distances of left and right nodes, and of their products with the
    first graph's; and the first's own sum in the row 0. ``left``, ``right``: a graph's factors each. Tiles stay in cache."""
    out, cut = np.zeros((len(left), 2)), range(0, len(right[0]), columns)
    right = [[np.ascontiguousarray(r[c : c + columns].T) for c in cut] for r in right]
    for k in range(len(cut)):
        shape = (rows, right[0][k].shape[1])
        x, y = np.empty(shape), np.empty(shape)
        for at in range(0, len(left[0]), rows):
            for g, (a, b) in enumerate(zip(left, right)):
                part = a[at : at + rows]
                d = (y if g else x)[: len(part)]
                np.matmul(part, b[k], out=d)
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                out[g] += [d.sum(), np.dot(d.ravel(), x[: len(part)].ravel()) if g else 0.0]
    return out


#: Nodes of a block of distances, at most some; a pair of blocks is one task's work.
BLOCK = 32768


def distance_shift_blocks(emb: DataFrame, base: DataFrame, block: int = BLOCK, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, shift: ``distance_shift`` of all ordered pairs of the base's nodes, the diagonal too, from the two tables of
    node, vec (``emb`` with keys): nodes are cut into blocks, each pair of blocks is one task's work (for up to
    ``TOGETHER`` candidates), and only its sums leave it. A node that ``emb`` lacks is at 0.

    A block is one row of packed numbers, written once. Tasks read the two that they take from what is written, so that what is
    shuffled and held on disk grows with nodes alone, not with pairs of blocks."""
    return scoped(lambda: _distance_shift(emb, base, block, list(keys)), "shift")


def _distance_shift(emb: DataFrame, base: DataFrame, block: int, k: list[str]) -> DataFrame:
    spark = base.sparkSession
    n, rank = base.agg(F.count("*"), F.max(F.size("vec"))).first()
    cands = [tuple(r) for r in emb.select(*k).distinct().orderBy(*k).collect()] if k else [()]
    kinds = ", ".join(f"{c} {dict(emb.dtypes)[c]}" for c in k)
    names = ["n", "x", "y", "xx", "yy", "xy"]
    schema = ", ".join(([kinds] if k else []) + [f"{c} double" for c in names])
    if not n or not cands:
        return spark.createDataFrame([], schema).select(*k, F.lit(None).cast("double").alias("shift"))
    # enough blocks for every task that runs at once to have a pair
    blocks = max(-(-n // block), min(-(-n // 2048), int((2 * spark.sparkContext.defaultParallelism) ** 0.5) + 2))
    groups = -(-len(cands) // TOGETHER)
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("own")
    mean = lambda t, by: t.groupBy(*by).agg(F.array(*(F.sum(F.col("vec")[i]) / n for i in range(rank))).alias("mid"))
    about = F.zip_with("vec", "mid", lambda x, m: x - m).alias("vec")
    known = base.crossJoin(F.broadcast(mean(base, []))).select("node", about)
    rows = known.crossJoin(spark.range(groups).select(F.col("id").cast("int").alias("few"))).select("few", own, "node", F.lit(-1).alias("slot"), "vec")
    if k:
        slots = spark.createDataFrame([(*c, i // TOGETHER, i % TOGETHER) for i, c in enumerate(cands)], f"{kinds}, few int, slot int")
        moved = emb.join(F.broadcast(slots), k)
    else:
        moved = emb.withColumn("few", F.lit(0)).withColumn("slot", F.lit(0))
    moved = moved.join(base.select("node"), "node", "left_semi")
    # a node at 0 is at minus the mean, about it: it has no row, and is filled in when a block is packed
    mids = materialise(mean(moved, ["few", "slot"]), "mids")
    moved = moved.join(F.broadcast(mids), ["few", "slot"]).select("few", own, "node", "slot", about)
    told = {(r["few"], r["slot"]): r["mid"] for r in mids.collect()}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        few, slot, node = int(pdf["few"].iloc[0]), pdf["slot"].to_numpy(), pdf["node"].to_numpy()
        vec = np.array(pdf["vec"].tolist(), float).reshape(-1, rank)
        first = np.flatnonzero(slot == -1)
        first = first[np.argsort(node[first], kind="stable")]
        graphs = [vec[first]]
        for i in range(min(TOGETHER, len(cands) - few * TOGETHER)):
            x, of = np.repeat(-np.array(told.get((few, i), [0.0] * rank))[None], len(first), 0), np.flatnonzero(slot == i)
            x[np.searchsorted(node[first], node[of])] = vec[of]
            graphs.append(x)
        return pd.DataFrame({"few": [few], "own": [int(pdf["own"].iloc[0])], "graphs": [np.ascontiguousarray(graphs).tobytes()]})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * groups, 4 * spark.sparkContext.defaultParallelism))
    packed = materialise(rows.union(moved).repartition(tasks, "few", "own").groupBy("few", "own").applyInPandas(pack, "few int, own int, graphs binary"), "blocks")
    # numbers that Spark deals to a partition each, so that no task is given two pairs
    lane = spark.range(64 * blocks).select(F.col("id").alias("lane"), F.pmod(F.hash("id"), F.lit(blocks)).alias("own")).groupBy("own").agg(F.min("lane").alias("lane"))
    lanes = {r["own"]: r["lane"] for r in lane.collect()}
    by = spark.createDataFrame([(o, lanes.get(o, o)) for o in range(blocks)], "own int, lane long")

    def sums(batches):
        for batch in batches:
            out = []
            for few, i, j, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                many = 1 + min(TOGETHER, len(cands) - few * TOGETHER)
                left, right = (np.frombuffer(x).reshape(many, -1, rank) for x in (a, b))
                times, pairs = 1 if i == j else 2, left.shape[1] * right.shape[1]
                # squares of distances need no pairs: they add up from lengths and sums
                square = [right.shape[1] * np.vdot(x, x) + left.shape[1] * np.vdot(y, y) - 2 * np.dot(x.sum(0), y.sum(0)) for x, y in zip(left, right)]
                d = _distance_sums([_factors(x)[0] for x in left], [_factors(y)[1] for y in right])
                out += [(*cands[few * TOGETHER + g - 1], *(times * float(v) for v in (pairs, d[0, 0], d[g, 0], square[0], square[g], d[g, 1]))) for g in range(1, many)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*k, *names]), schema=arrow, preserve_index=False)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    every = None
    for few in range(groups):
        side = packed.where(F.col("few") == few).join(F.broadcast(by), "own").repartition(blocks, "lane")
        a, b = side.select("few", F.col("own").alias("i"), F.col("graphs").alias("a")), side.select(F.col("own").alias("j"), F.col("graphs").alias("b"))
        pairs = a.join(b.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j")).select("few", "i", "j", "a", "b")
        got = pairs.mapInArrow(sums, schema)
        every = got if every is None else every.union(got)
    s = every.groupBy(*k).agg(*(F.sum(c).alias(c) for c in names))
    corr = F.try_divide(F.expr("n * xy - x * y"), F.sqrt(F.expr("(n * xx - x * x) * (n * yy - y * y)")))
    return s.select(*k, (1 - F.abs(corr)).alias("shift"))


def inside_edges(edges: DataFrame, comms: DataFrame) -> DataFrame:
    """The edges whose ends share a community."""
    a, b = comms.select(F.col("node").alias("src"), F.col("comm").alias("a")), comms.select(F.col("node").alias("dst"), F.col("comm").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst")


def community_edge_pools(edges: DataFrame, comms: DataFrame, seed: int, per_node: int = 2) -> tuple[DataFrame, DataFrame]:
    """(edges inside a community; hash-picked pairs of nodes in different ones that aren't linked)."""
    from cutweave.operators.graph import dense_rank_ids, sample_non_neighbors

    a, b = comms.select(F.col("node").alias("src"), F.col("comm").alias("a")), comms.select(F.col("node").alias("dst"), F.col("comm").alias("b"))
    inside = inside_edges(edges, comms)
    idx = dense_rank_ids(comms.select("node").distinct(), "node")
    picks = sample_non_neighbors(idx, edges, per_node, seed).select(F.least("node", "nbr").alias("src"), F.greatest("node", "nbr").alias("dst")).distinct()
    return inside, picks.join(a, "src").join(b, "dst").where("a <> b").select("src", "dst")
