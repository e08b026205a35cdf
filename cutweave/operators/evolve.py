"""Candidate-table operators: initial populations, selection, crossover, mutation, repair, elitism, gene pools.

Tables: candidates(cand_id, pos, gene), fitness(cand_id, fitness), pool(idx, ...). Population tables are small, pop x
budget rows, whatever the graph's size; windows over a whole fitness table run over ``pop`` rows. All draws are hashes of
their keys, so a retried task draws the same.

Runs side by side: with ``by`` naming columns (the loop's is ``run``) that both tables carry, an operator keeps the runs apart,
and ``seed`` may be a column of theirs. A run then gets what it would get alone.
"""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cutweave.functions.rand import order, permuted, turns, u
from cutweave.operators.graph import STRIDE, dense_rank_ids, rank_by
from cutweave.session import materialise


def cand_ids(spark: SparkSession, pop: int) -> DataFrame:
    return spark.range(pop).select(F.col("id").cast("int").alias("cand_id"))


def places(spark: SparkSession, pop: int, budget: int) -> DataFrame:
    """cand_id, pos of every gene."""
    return cand_ids(spark, pop).select("cand_id", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("pos"))


def split_runs(flat: DataFrame, pop: int, runs: tuple[int, ...]) -> DataFrame:
    """Rows of candidates numbered through all runs (the r-th run's from r x pop) as run, cand_id within it, and the rest."""
    rest = [c for c in flat.columns if c != "cand_id"]
    named = F.array(*(F.lit(int(r)).cast("long") for r in runs))
    return flat.select(F.element_at(named, (F.floor(F.col("cand_id") / pop) + 1).cast("int")).alias("run"), (F.col("cand_id") % pop).cast("int").alias("cand_id"), *rest)


def join_runs(rows: DataFrame, pop: int, runs: tuple[int, ...]) -> DataFrame:
    """``split_runs`` undone: one number for run and candidate, for what is keyed by cand_id alone."""
    rest = [c for c in rows.columns if c not in ("run", "cand_id")]
    named = F.array(*(F.lit(int(r)).cast("long") for r in runs))
    return rows.select(((F.array_position(named, F.col("run")) - 1) * pop + F.col("cand_id")).cast("int").alias("cand_id"), *rest)


def init_population(pool: DataFrame, pop: int, budget: int, seed: int, runs: tuple[int, ...] = ()) -> DataFrame:
    """cand_id, pos, gene: ``budget`` distinct genes of the pool (idx from 0 without gaps) a candidate: the first of a
    permutation of its own, so the pool is counted, not listed. A budget beyond the pool repeats it in the same order. With
    ``runs``, which are seeds, one population for each, under run."""
    n = pool.count()
    at = cand_ids(pool.sparkSession, pop * max(1, len(runs)))
    if runs:
        at, seed = split_runs(at, pop, runs), F.col("run")
    key = (max(n, 1), seed, F.col("cand_id"), "init")
    at = at.withColumn("_by", turns(*key)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    if not n:
        return at.drop("_by").withColumn("gene", F.lit(0).cast("long")).limit(0)
    return at.withColumn("gene", permuted(F.col("pos") % n, *key, by=F.col("_by"))).drop("_by")


def draw_population(spark: SparkSession, n: int, pop: int, budget: int, seed: int) -> DataFrame:
    """As ``init_population`` over genes 0..n-1 without touching a pool: twice the draws are made, and the first distinct
    ``budget`` stand. A candidate may get fewer where the budget is near n; ``repair_duplicates`` fills it up."""
    d = cand_ids(spark, pop).select("cand_id", F.explode(F.sequence(F.lit(0), F.lit(2 * budget + 15))).alias("k"))
    d = d.withColumn("gene", F.floor(u(seed, F.col("cand_id"), F.col("k"), "draw") * n).cast("long")).groupBy("cand_id", "gene").agg(F.min("k").alias("k"))
    return d.withColumn("pos", F.row_number().over(W.partitionBy("cand_id").orderBy("k")) - 1).where(F.col("pos") < budget).select("cand_id", "pos", "gene")


def filled(drawn: DataFrame, pop: int, budget: int, n: int, seed: int) -> DataFrame:
    """``drawn`` with every position of every candidate: where draws ran out a further one stands, which may repeat."""
    places = cand_ids(drawn.sparkSession, pop).select("cand_id", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("pos"))
    more = F.floor(u(seed, F.col("cand_id"), F.col("pos"), "fill") * n).cast("long")
    return places.join(drawn, ["cand_id", "pos"], "left").select("cand_id", "pos", F.coalesce("gene", more).alias("gene"))


def _numbered(edges: DataFrame) -> DataFrame:
    return rank_by(edges.select("src", "dst"), F.asc("src"), F.asc("dst")).select((F.col("rank") - 1).alias("idx"), "src", "dst")


def _drawn(at: DataFrame, pool: DataFrame, seed: int, op: str) -> DataFrame:
    """The edges of a numbered pool at the places ``at`` (cand_id, pos) of each candidate's permutation of it."""
    n = pool.count()
    if not n:
        return at.where("false").select("cand_id", F.lit(op).alias("op"), "pos", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    idx = permuted(F.col("pos"), n, seed, F.col("cand_id"), op)
    return at.where(F.col("pos") < n).withColumn("idx", idx).join(pool, "idx").select("cand_id", F.lit(op).alias("op"), "pos", "src", "dst")


def init_edge_population(dels: DataFrame, adds: DataFrame, pop: int, budget: int, seed: int) -> DataFrame:
    """cand_id, op, src, dst: floor(u budget) additions, and deletions for the rest, each the first of a permutation of the
    candidate's own. Pools are numbered over ranges; no candidate lists one."""
    at = places(dels.sparkSession, pop, budget).withColumn("n_add", F.floor(u(seed, F.col("cand_id"), "mix") * budget))
    add = _drawn(at.where("pos < n_add").drop("n_add"), _numbered(adds), seed, "add")
    rest = _drawn(at.where(F.col("pos") < budget - F.col("n_add")).drop("n_add"), _numbered(dels), seed, "del")
    return add.union(rest).select("cand_id", "op", "src", "dst")


def init_link_population(train: DataFrame, non_edges: DataFrame, pop: int, budget: int, seed: int) -> DataFrame:
    """cand_id, op, pos, src, dst: ``budget`` deletions from train and ``budget`` additions from non-edges, likewise."""
    at = places(train.sparkSession, pop, budget)
    return _drawn(at, _numbered(train), seed, "del").union(_drawn(at, _numbered(non_edges), seed, "add"))


def init_rewires(adj: DataFrame, non_nbrs: DataFrame, pop: int, budget: int, seed: int) -> DataFrame:
    """cand_id, pos, node, add_node, remove_node: distinct nodes, the first of a candidate's permutation of those that have
    both; each with its least neighbour and non-neighbour by hash. ``adj``: src, dst both ways; ``non_nbrs``: node, nbr."""
    pool = dense_rank_ids(adj.select(F.col("src").alias("node")).join(non_nbrs.select("node"), "node", "left_semi").distinct(), "node")
    n = pool.count()
    at = places(adj.sparkSession, pop, budget).where(F.col("pos") < n)
    c = at.withColumn("idx", permuted(F.col("pos"), max(n, 1), seed, F.col("cand_id"), "node")).join(pool, "idx").select("cand_id", "pos", "node")
    pick = lambda df, out, tag: c.join(df, "node").groupBy("cand_id", "node").agg(F.min_by("other", order(seed, F.col("cand_id"), F.col("node"), F.col("other"), tag)).alias(out))
    rem = pick(adj.select(F.col("src").alias("node"), F.col("dst").alias("other")), "remove_node", "rem")
    add = pick(non_nbrs.select("node", F.col("nbr").alias("other")), "add_node", "add")
    return c.join(add, ["cand_id", "node"]).join(rem, ["cand_id", "node"]).select("cand_id", "pos", "node", "add_node", "remove_node")


def _apart(by: tuple[str, ...]) -> list:
    """What a window over whole fitness tables is partitioned by: the runs, or nothing."""
    return list(by) or [F.lit(0)]


def _draws(rows: DataFrame, n: int, by: tuple[str, ...]) -> DataFrame:
    """draw from 0 to n - 1, for each run of ``rows``."""
    if not by:
        return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("draw"))
    return rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))


def _other(rows: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``rows`` with its run under another name, and the conditions under which it is a draw's."""
    for c in by:
        rows = rows.withColumnRenamed(c, f"_{c}")
    return rows, [F.col(c) == F.col(f"_{c}") for c in by]


def weights(fitness: DataFrame, side: str, shift: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """cand_id, w: the fitness (negated to minimise) less its least; raw, with negatives 0, unless ``shift``; all 1 where
    all would be 0."""
    f = F.col("fitness") if side == "max" or not shift else -F.col("fitness")
    every = W.partitionBy(*_apart(by))
    w = fitness.withColumn("w", f - F.min(f).over(every) if shift else F.greatest(f, F.lit(0)))
    return w.select(*by, "cand_id", F.when(F.sum("w").over(every) <= 0, 1.0).otherwise(F.col("w").cast("double")).alias("w"))


def roulette_select(fitness: DataFrame, side: str, n: int, seed: int, shift: bool = True, tag: str = "sel", by: tuple[str, ...] = ()) -> DataFrame:
    """draw, cand_id: ``n`` draws with chances in proportion to the weight. Intervals of a running sum by cand_id; a
    range join finds each draw's; the last is closed."""
    every = W.partitionBy(*_apart(by))
    c = weights(fitness, side, shift, by).withColumn("hi", F.sum("w").over(every.orderBy("cand_id").rowsBetween(W.unboundedPreceding, 0)))
    c = c.withColumn("lo", F.col("hi") - F.col("w")).withColumn("total", F.max("hi").over(every)).where("w > 0")
    d = _draws(fitness, n, by).withColumn("x", u(seed, F.col("draw"), tag))
    c, same = _other(c, by)
    at = (F.col("x") * F.col("total") >= F.col("lo")) & ((F.col("x") * F.col("total") < F.col("hi")) | (F.col("hi") == F.col("total")))
    return d.join(F.broadcast(c), [at, *same]).groupBy(*by, "draw").agg(F.min("cand_id").alias("cand_id"))


def rotary_table(fitness: DataFrame, pattern: str = "normal", by: tuple[str, ...] = ()) -> DataFrame:
    """cand_id, p, cumulative: min-max normalised chances: 'normal' the fitness's, 'inverted' one minus it, 'trans' those of
    one minus the fitness, which are the same; equal fitness gives 1 / pop each."""
    if pattern == "trans":
        fitness = fitness.select(*by, "cand_id", (1 - F.col("fitness")).alias("fitness"))
    every = W.partitionBy(*_apart(by))
    lo, hi, n = F.min("fitness").over(every), F.max("fitness").over(every), F.count("*").over(every)
    x = (F.col("fitness") - lo) / (hi - lo)
    f = fitness.withColumn("x", F.when(hi == lo, 1.0).otherwise(1 - x if pattern == "inverted" else x)).withColumn("n", n)
    f = f.withColumn("p", F.when(F.sum("x").over(every) == 0, 1 / F.col("n")).otherwise(F.col("x") / F.sum("x").over(every)))
    return f.select(*by, "cand_id", "p", F.sum("p").over(every.orderBy("cand_id").rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"))


def rotary_select(table: DataFrame, n: int, seed: int, tag: str = "rot", by: tuple[str, ...] = ()) -> DataFrame:
    """draw, cand_id: ``n`` draws from a rotary table: the first candidate whose cumulative chance reaches the draw."""
    d = _draws(table, n, by).withColumn("x", u(seed, F.col("draw"), tag))
    held, same = _other(table.where("p > 0"), by)
    j = d.join(F.broadcast(held), [F.col("cumulative") >= F.col("x"), *same], "left").groupBy(*by, "draw").agg(F.min("cand_id").alias("cand_id"))
    last = table.where("p > 0").groupBy(*by).agg(F.max("cand_id").alias("last"))  # where rounding leaves the last chance under 1
    j = j.join(F.broadcast(last), list(by)) if by else j.crossJoin(F.broadcast(last))
    return j.select(*by, "draw", F.coalesce("cand_id", "last").alias("cand_id"))


def crossover(a: DataFrame, b: DataFrame, rate: float, seed: int, generation: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Uniform: b's gene where the draw falls under ``rate``, a's otherwise; rows meet on (cand_id, pos)."""
    j = a.join(b.withColumnRenamed("gene", "other"), [*by, "cand_id", "pos"])
    return j.select(*by, "cand_id", "pos", F.when(u(seed, generation, F.col("cand_id"), F.col("pos"), "x") < rate, F.col("other")).otherwise(F.col("gene")).alias("gene"))


def mutate(pop: DataFrame, rate: float, pool_size: int, seed: int, generation: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """A fresh gene 0..pool_size-1 where the draw falls under ``rate``."""
    key = (seed, generation, F.col("cand_id"), F.col("pos"))
    return pop.select(*by, "cand_id", "pos", F.when(u(*key, "m") < rate, F.floor(u(*key, "g") * pool_size).cast("long")).otherwise(F.col("gene")).alias("gene"))


def edge_mutation(changes: DataFrame, dels: DataFrame, adds: DataFrame, rate: float, seed: int) -> DataFrame:
    """cand_id, pos, op, src, dst with genes replaced, where the draw falls under ``rate``, by a fresh addition or
    deletion. ``dels`` and ``adds``: idx, src, dst."""
    key = (seed, F.col("cand_id"), F.col("pos"))
    sizes = F.broadcast(dels.agg(F.count("*").alias("nd")).crossJoin(adds.agg(F.count("*").alias("na"))))
    c = changes.crossJoin(sizes).withColumn("hit", u(*key, "m") < rate).withColumn("to", F.when(u(*key, "op") < 0.5, "add").otherwise("del"))
    c = c.withColumn("idx", F.when(F.col("hit"), F.floor(u(*key, "g") * F.when(F.col("to") == "add", F.col("na")).otherwise(F.col("nd"))).cast("long")))
    pool = adds.select(F.lit("add").alias("to"), "idx", F.col("src").alias("s"), F.col("dst").alias("d")).union(dels.select(F.lit("del"), "idx", "src", "dst"))
    j = c.join(pool, ["to", "idx"], "left")
    new = F.col("hit") & F.col("s").isNotNull()
    return j.select("cand_id", "pos", F.when(new, F.col("to")).otherwise(F.col("op")).alias("op"), F.when(new, F.col("s")).otherwise(F.col("src")).alias("src"), F.when(new, F.col("d")).otherwise(F.col("dst")).alias("dst"))


def rewire_mutation(rewires: DataFrame, fresh: DataFrame, rate: float, seed: int) -> DataFrame:
    """Where the draw falls under ``rate`` one of three: a whole fresh gene, its add_node, or its remove_node (the last
    two only of a fresh gene of the same node). ``fresh``: cand_id, pos, node, add_node, remove_node."""
    key = (seed, F.col("cand_id"), F.col("pos"))
    same = fresh.select("cand_id", F.col("node"), F.col("add_node").alias("a2"), F.col("remove_node").alias("r2")).dropDuplicates(["cand_id", "node"])
    whole = fresh.select("cand_id", "pos", F.col("node").alias("n3"), F.col("add_node").alias("a3"), F.col("remove_node").alias("r3"))
    j = rewires.join(same, ["cand_id", "node"], "left").join(whole, ["cand_id", "pos"], "left").withColumn("hit", u(*key, "m") < rate).withColumn("kind", F.floor(u(*key, "k") * 3))
    is_k = lambda k: F.col("hit") & (F.col("kind") == k)
    all3 = is_k(0) & F.col("n3").isNotNull()
    return j.select("cand_id", "pos", F.when(all3, F.col("n3")).otherwise(F.col("node")).alias("node"), F.when(all3, F.col("a3")).when(is_k(1) & F.col("a2").isNotNull(), F.col("a2")).otherwise(F.col("add_node")).alias("add_node"), F.when(all3, F.col("r3")).when(is_k(2) & F.col("r2").isNotNull(), F.col("r2")).otherwise(F.col("remove_node")).alias("remove_node"))


def _unused(wanted: DataFrame, pop: DataFrame, n: int, *key, by: tuple[str, ...] = ()) -> DataFrame:
    """cand_id, gene, j: genes of 0..n-1 that a candidate of ``wanted`` (cand_id, k: so many places of its permutation are
    looked at) lacks, j their place. Of the first a + b places at most b are taken by b used genes."""
    at = [*by, "cand_id"]
    most = F.least(F.col("k"), F.lit(n)).cast("int")
    j = wanted.where("k > 0").select(*at, turns(n, *key).alias("_by"), most.alias("k"), F.explode(F.sequence(F.lit(0), most - 1, F.lit(STRIDE))).alias("lo"))
    # few rows, which make many: dealt out before they do
    j = j.repartition(4 * pop.sparkSession.sparkContext.defaultParallelism, *at, "lo")
    j = j.select(*at, "_by", F.explode(F.sequence("lo", F.least(F.col("lo") + STRIDE, F.col("k")) - 1)).alias("j"))
    return j.withColumn("gene", permuted(F.col("j"), n, *key, by=F.col("_by"))).drop("_by").join(pop.select(*at, "gene").distinct(), [*at, "gene"], "left_anti")


def repair_duplicates(pop: DataFrame, pool: DataFrame, seed: int, generation: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct genes in a candidate: the i-th repeated one (by pos) is replaced by the i-th unused gene of a permutation of
    the pool (idx from 0 without gaps), of which as many places are looked at as the candidate has genes. A pool with too
    few unused genes leaves the rest repeated. Genes beyond the pool count as used."""
    n, at = pool.count(), [*by, "cand_id"]
    p = pop.withColumn("n", F.row_number().over(W.partitionBy(*at, "gene").orderBy("pos")))
    if not n:
        return p.select(*at, "pos", "gene")
    holes = p.where("n > 1").withColumn("i", F.row_number().over(W.partitionBy(*at).orderBy("pos")))
    wanted = p.groupBy(*at).agg(F.count("*").alias("k"), F.count_if(F.col("n") > 1).alias("need")).where("need > 0")
    free = _unused(wanted, pop, n, seed, generation, F.col("cand_id"), "rep", by=by)
    free = free.withColumn("i", F.row_number().over(W.partitionBy(*at).orderBy("j")))
    fixed = holes.select(*at, "pos", "gene", "i").join(free.select(*at, "i", F.col("gene").alias("g")), [*at, "i"], "left")
    return p.where("n = 1").select(*at, "pos", "gene").union(fixed.select(*at, "pos", F.coalesce("g", "gene")))


def de_mutation(x: DataFrame, x1: DataFrame, x2: DataFrame, factor: float) -> DataFrame:
    """cand_id, pos, x + factor (x1 - x2), held within 0 and 1."""
    j = x.join(x1.withColumnRenamed("x", "a"), ["cand_id", "pos"]).join(x2.withColumnRenamed("x", "b"), ["cand_id", "pos"])
    return j.select("cand_id", "pos", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x") + factor * (F.col("a") - F.col("b")))).alias("x"))


def encode_genotype(candidates: DataFrame, minmax: DataFrame) -> DataFrame:
    """cand_id, pos, x: the min-max degree of each chosen node (cand_id, pos, node)."""
    return candidates.join(minmax, "node").select("cand_id", "pos", "x")


def decode_phenotype(genotypes: DataFrame, minmax: DataFrame) -> DataFrame:
    """cand_id, pos, node: for each position in turn the node of the nearest value not yet used; ties: the lesser value, then
    the least id. A candidate with more positions than there are nodes uses each node again only after all of them.

    What is sequential is which value a position takes, and for how many a value has been taken: a candidate's group has
    ``budget`` rows, and beside them go the distinct values and their counts alone, of which there are as many as degrees
    (at most the root of twice the edges). Nodes are ranked by (value, id) over ranges, and each place finds its node by rank.
    """
    ranked = materialise(rank_by(minmax.select("node", "x"), F.asc("x"), F.asc("node")), "ranked")
    values = ranked.groupBy("x").agg(F.min("rank").alias("first"), F.count("*").alias("n")).orderBy("x").collect()
    shared = genotypes.sparkSession.sparkContext.broadcast(tuple([r[c] for r in values] for c in ("x", "first", "n")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        xs, first, size = (np.array(v) for v in shared.value)
        used = np.zeros(len(xs), int)
        out = []
        for cand, pos, x in sorted(zip(pdf["cand_id"], pdf["pos"], pdf["x"]), key=lambda r: r[1]):
            if (used == size).all():
                used[:] = 0
            d = np.abs(xs - x)
            d[used == size] = np.inf
            i = int(np.flatnonzero(d <= d.min() + 1e-12)[0])
            out.append((cand, pos, int(first[i] + used[i])))
            used[i] += 1
        return pd.DataFrame(out, columns=["cand_id", "pos", "rank"])

    taken = genotypes.groupBy("cand_id").applyInPandas(run, "cand_id int, pos int, rank long")
    return taken.join(ranked.select("rank", "node"), "rank").select("cand_id", "pos", "node")


#: Standard deviations of a resampled candidate's genes below the cut by which the cut is set above the budget.
SPARE = 8


def _cut_at(counts: list[tuple[int, int]], want: float) -> float:
    """Below which of all keys -ln(1 - u) / w some ``want`` are expected, of so many genes of each w; infinite, if there are
    no more."""
    if sum(c for _, c in counts) <= want:
        return math.inf
    lo, hi = 0.0, 1.0
    expected = lambda t: sum(-c * math.expm1(-w * t) for w, c in counts)
    while expected(hi) < want:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if expected((lo + hi) / 2) >= want else ((lo + hi) / 2, hi)
    return hi


def eda_resample(pop: DataFrame, fitness: DataFrame, n: int, budget: int, seed: int, side: str = "max", pick: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """cand_id, pos, gene: ``n`` new candidates whose genes are drawn, without replacement and in proportion to their
    counts, from those of ``pick`` x n selected ones (keys -ln(1 - u) / count; the least stand).

    A candidate ranks only its keys below a cut, set so that some more than ``budget`` are expected there; if one should have
    fewer, all keys are ranked. So what a window sorts follows the budget, not the genes of all the population."""
    sel = roulette_select(fitness, side, pick * n, seed, by=by).groupBy(*by, "cand_id").agg(F.count("*").alias("times"))
    dealt = sel.join(pop, [*by, "cand_id"]).repartition(4 * pop.sparkSession.sparkContext.defaultParallelism, *by, "gene")
    counts = materialise(dealt.groupBy(*by, "gene").agg(F.sum("times").alias("w")), "counts")
    hist: dict[tuple, list] = {}
    for r in counts.groupBy(*by, "w").count().collect():
        hist.setdefault(tuple(r[c] for c in by), []).append((r["w"], r["count"]))
    cuts = {k: _cut_at(h, budget + SPARE * (math.sqrt(budget) + 4)) for k, h in hist.items()}
    cut = F.lit(math.inf)
    for k, t in cuts.items():
        cut = F.when(F.lit(True) if not by else functools.reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(by, k))), t).otherwise(cut)
    # what is a gene's alone is made before it is taken n times: its text, and the greatest hash whose key may be below the cut
    told = counts.withColumn("_t", F.col("gene").cast("string")).withColumn("_top", F.lower(F.lpad(F.hex(F.least(F.lit(2**32 - 1), F.ceil((1 - F.exp(-cut * F.col("w"))) * 2**32 + 1)).cast("long")), 8, "0")))
    every = told.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cand_id"), *by, "gene", "w", "_t", "_top")
    draw = (seed, F.col("cand_id"), F.col("_t"), "eda")
    keyed = lambda t: t.withColumn("key", -F.log(1 - u(*draw)) / F.col("w"))
    new = keyed(every)
    near = materialise(keyed(every.where(F.substring(order(*draw), 1, 8) <= F.col("_top"))).where(F.col("key") <= cut).select(*by, "cand_id", "gene", "key"), "near")
    full = near.groupBy(*by, "cand_id").count().where((cut < math.inf) & (F.col("count") >= budget)).count()
    if full < n * sum(t < math.inf for t in cuts.values()):
        near = new
    place = F.row_number().over(W.partitionBy(*by, "cand_id").orderBy("key", "gene")) - 1
    return near.withColumn("pos", place).where(F.col("pos") < budget).select(*by, "cand_id", "pos", "gene")


def elitism(old: DataFrame, new: DataFrame, side: str, pop: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rank (from 0: the new cand_id), origin, cand_id, fitness of the best ``pop``; ties: old first, then cand_id."""
    both = old.select(*by, F.lit(0).alias("origin"), "cand_id", "fitness").union(new.select(*by, F.lit(1), "cand_id", "fitness"))
    order_by = F.asc("fitness") if side == "min" else F.desc("fitness")
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*_apart(by)).orderBy(order_by, "origin", "cand_id")) - 1).where(F.col("rank") < pop)


def sga_elitism(old: DataFrame, new: DataFrame, side: str, pop: int, genes: DataFrame, homo: DataFrame) -> DataFrame:
    """Elitism, with each survivor's sum of homophily decrease over its genes (origin, cand_id, node), and ``best`` for
    the least sum among those of the best fitness."""
    e = elitism(old, new, side, pop)
    s = genes.join(homo.select("node", "decrease"), "node").groupBy("origin", "cand_id").agg(F.round(F.sum("decrease"), 6).alias("score"))
    e = e.join(s, ["origin", "cand_id"], "left").fillna(0.0, ["score"])
    top = F.first("fitness").over(W.partitionBy(F.lit(0)).orderBy("rank"))
    e = e.withColumn("top", F.col("fitness") == top)
    r = F.row_number().over(W.partitionBy("top").orderBy("score", "rank"))
    return e.withColumn("best", F.col("top") & (r == 1)).drop("top")


def resolve_conflicts(pop: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """Distinct genes within a row, then distinct rows: of rows that have the same set of genes all but the first get
    their first gene redrawn from those they lack, by a permutation of the pool."""
    n = pool.count()
    p = repair_duplicates(pop, pool, seed)
    if not n:
        return p
    sets = p.groupBy("cand_id").agg(F.array_sort(F.collect_list("gene")).alias("s")).withColumn("n", F.row_number().over(W.partitionBy("s").orderBy("cand_id"))).where("n > 1")
    free = _unused(sets.select("cand_id", (F.size("s") + 1).alias("k")), p, n, seed, F.col("cand_id"), "conf")
    new = free.groupBy("cand_id").agg(F.min_by("gene", "j").alias("g"))
    return p.join(new, "cand_id", "left").select("cand_id", "pos", F.when((F.col("pos") == 0) & F.col("g").isNotNull(), F.col("g")).otherwise(F.col("gene")).alias("gene"))


def _first(rows: DataFrame, size: int, *order_by) -> DataFrame:
    """node, idx of the first ``size`` in order, ranked over ranges."""
    return rank_by(rows, *order_by).where(F.col("rank") <= size).select("node", (F.col("rank") - 1).cast("long").alias("idx"))


def gene_pool_cutoff(best: DataFrame, rank: DataFrame, size: int) -> DataFrame:
    """node, idx: half of ``size`` by frequency in the best rows (cand_id, node), ties by node, then by degree rank."""
    return _fill(_first(best.groupBy("node").agg(F.count("*").alias("n")), size // 2, F.desc("n"), F.asc("node")), rank, size)


def _fill(chosen: DataFrame, rank: DataFrame, size: int) -> DataFrame:
    """The chosen, then nodes in order of rank that aren't. Of rank, the first 2 x size can matter at most."""
    chosen = materialise(chosen, "chosen")
    c = chosen.count()
    rest = rank.where(F.col("rank") <= 2 * size).select("node", F.col("rank").alias("_by")).join(chosen, "node", "left_anti")
    return chosen.select("node", "idx").union(_first(rest, size - c, F.asc("_by")).select("node", (F.col("idx") + c).cast("long").alias("idx")))


def random_cutoff(nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """node, idx: the first ``size`` nodes in hash order."""
    return _first(nodes.select("node", order(seed, F.col("node"), "pool").alias("_k")), size, F.asc("_k"))


def reach_cutoff(reach: DataFrame, rank: DataFrame, size: int) -> DataFrame:
    """node, idx: half of ``size`` by reach (node, reach), ties by node, then by degree rank."""
    return _fill(_first(reach.select("node", "reach"), size // 2, F.desc("reach"), F.asc("node")), rank, size)
