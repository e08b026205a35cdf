"""The search: a thin driver loop whose every step is a Spark job, and the ten named jobs.

A problem is a pool of genes (idx and what a gene stands for) and a fitness over decoded candidates, a function from
DataFrame to DataFrame; a problem without a pool has genes that are structs of what they stand for. State between
generations is two written tables; the driver sees one row a generation. With a path, each generation's state and row are
written there, and ``resume`` reads them back, in another session too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cutweave.functions.rand import permuted
from cutweave.operators import community as C, evolve as V, graph as G, linkpred as L, nodeclass as N, perturb as P, reach as R
from cutweave.operators.louvain import SMALL, changed_scores, louvain, louvain_by_graph
from cutweave.session import by_shuffles, discard, exists, materialise, remove, scope, scoped


HISTORY = "run_id string, generation int, best_fitness double, best_gene string, metrics string"


@dataclass
class Problem:
    """``pool``: idx from 0 and a gene's payload columns; null for genes that are structs of the payload, which ``init``
    (from a seed) and ``mutate`` (from population, seed and generation) make. ``fitness``: from cand_id, pos and the
    payload to cand_id, fitness. ``metrics``: the same for reports, from the best candidate alone, to one row of numbers.
    ``select``: roulette, rotary or eda. ``survive``: elitism of its own, from old and new fitness, old and new population,
    to rank, origin, cand_id, fitness. ``propose``: a generation's new population (from population, fitness, seed and
    generation), in place of selection, crossover and mutation. ``batch``: candidates scored in one job; None: all."""

    name: str
    side: str
    pool: DataFrame | None
    budget: int
    pop: int
    fitness: Callable[[DataFrame], DataFrame]
    metrics: Callable[[DataFrame], DataFrame] | None = None
    cross_rate: float = 0.6
    mutation_rate: float = 0.2
    repair: bool = True
    select: str = "roulette"
    report_every: int = 50
    init: Callable[[int], DataFrame] | None = None
    mutate: Callable[[DataFrame, int, int], DataFrame] | None = None
    survive: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    propose: Callable[[DataFrame, DataFrame, int, int], DataFrame] | None = None
    batch: int | None = None


@dataclass
class Run:
    problem: Problem
    population: DataFrame
    fitness: DataFrame
    generation: int
    log: list = field(default_factory=list)
    path: str | None = None
    held: list = field(default_factory=list)
    graph: object = None
    #: Seeds of runs side by side, whose rows carry their seed under ``run``; none for a run of its own.
    seeds: tuple[int, ...] = ()

    def drop(self) -> None:
        """Delete the tables of this state. What another Run holds stays."""
        for table in self.held:
            discard(table)

    @property
    def history(self) -> DataFrame:
        """A row for each generation: run_id, generation, best_fitness, best_gene, metrics (JSON, where reported)."""
        return self.population.sparkSession.createDataFrame(self.log, HISTORY)


def fitness_from_pandas(f: Callable) -> Callable[[DataFrame], DataFrame]:
    """A fitness from a function of one candidate's decoded rows (a pandas frame, as many rows as the budget)."""

    def fitness(decoded: DataFrame) -> DataFrame:
        import pandas as pd

        return decoded.groupBy("cand_id").applyInPandas(lambda pdf: pd.DataFrame({"cand_id": [pdf["cand_id"].iloc[0]], "fitness": [float(f(pdf))]}), "cand_id int, fitness double")

    return fitness


def decode(pop: DataFrame, pool: DataFrame | None) -> DataFrame:
    if pool is None:
        return pop.select("cand_id", "pos", "gene.*")
    return pop.join(pool.withColumnRenamed("idx", "gene"), "gene").drop("gene")


#: Rows of edges that one job of a fitness holds for all of its candidates.
BATCH_ROWS = 20_000_000


def batch_of(edges: DataFrame) -> int:
    """So many candidates have at most BATCH_ROWS edges together; one, where a graph has more."""
    return max(1, BATCH_ROWS // max(1, edges.count()))


def score(p: Problem, pop: DataFrame, seeds: tuple[int, ...] = ()) -> DataFrame:
    """cand_id, fitness. Candidates, of all runs side by side, are scored in batches of ``p.batch``; what a batch writes goes
    with it."""
    flat = V.join_runs(pop, p.pop, seeds) if seeds else pop
    total = p.pop * max(1, len(seeds))

    def part(few: DataFrame) -> DataFrame:
        return p.fitness(decode(few, p.pool)).select("cand_id", F.round(F.col("fitness").cast("double"), 9).alias("fitness"))

    def every() -> DataFrame:
        if p.batch is None or p.batch >= total:
            out = part(flat)
        else:
            out = None
            for lo in range(0, total, p.batch):
                got = scoped(lambda: part(flat.where((F.col("cand_id") >= lo) & (F.col("cand_id") < lo + p.batch))), "fitness")  # noqa: B023
                out = got if out is None else out.union(got)
        return V.split_runs(out, p.pop, seeds) if seeds else out

    return scoped(every, "fitness")


def fitness_of(p: Problem, decoded: DataFrame) -> float:
    """The fitness of one candidate's decoded rows."""
    with scope():
        return p.fitness(decoded).first()["fitness"]


def _by(seeds: tuple[int, ...]) -> tuple[str, ...]:
    return ("run",) if seeds else ()


def _rows(p: Problem, pop: DataFrame, fit: DataFrame, generation: int, seed: int, report: bool, seeds: tuple[int, ...] = ()) -> list[tuple]:
    """The history's rows of a generation, values of HISTORY, by run_id: one row a run in the driver."""
    on = _by(seeds)
    by = F.struct(F.col("fitness") if p.side == "min" else (-F.col("fitness")).alias("fitness"), "cand_id")
    best = fit.groupBy(*on).agg(F.min_by("cand_id", by).alias("cand_id"), (F.min if p.side == "min" else F.max)("fitness").alias("best_fitness"))
    genes = pop.join(F.broadcast(best), [*on, "cand_id"])
    told = genes.groupBy(*on).agg(F.first("best_fitness").alias("best_fitness"), F.array_join(F.transform(F.array_sort(F.collect_list("gene")), lambda x: x.cast("string")), ",").alias("best_gene")).collect()
    rows = []
    for g in told:
        own = genes.where(F.col("run") == g["run"]) if seeds else genes
        metrics = None
        if p.metrics and report:
            with scope():
                metrics = p.metrics(decode(own.select("cand_id", "pos", "gene"), p.pool)).select(F.to_json(F.struct("*")).alias("m")).first()["m"]
        rows.append((run_name(p, g["run"] if seeds else seed), generation, g["best_fitness"], g["best_gene"], metrics))
    return sorted(rows, key=lambda r: r[0])


def run_name(p: Problem, seed: int) -> str:
    return f"{p.name}-{seed}"


def _state(p: Problem, pop: DataFrame, fitness: DataFrame, generation: int, rows: list[tuple], path: str | None, before: Run | None, seeds: tuple[int, ...] = ()) -> Run:
    """The run after a generation. With a path the state is written there, under its generation, the history's rows last, as a
    sign that it is whole. The run before stays as it is: it may be continued again, otherwise or twice."""
    spark = pop.sparkSession
    if path:
        at = f"{path}/state/{generation}"
        pop.write.mode("overwrite").parquet(f"{at}/population")
        fitness.write.mode("overwrite").parquet(f"{at}/fitness")
        spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/history/{generation}")
        remove(spark, f"{path}/state/{generation - 1}")
    return Run(p, pop, fitness, generation, [*(before.log if before else []), *rows], path, [pop, fitness], seeds=seeds)


def resume(p: Problem, path: str, spark: SparkSession) -> Run:
    """The last whole generation of the run, or of the runs side by side, that was written at ``path``, to be given to
    ``evolve`` with the run's seed."""
    log = sorted((tuple(r) for r in spark.read.schema(HISTORY).parquet(f"{path}/history/*").collect()), key=lambda r: (r[1], r[0]))
    at = f"{path}/state/{log[-1][1]}"
    population, fitness = spark.read.parquet(f"{at}/population"), spark.read.parquet(f"{at}/fitness")
    seeds = tuple(sorted(r["run"] for r in fitness.select("run").distinct().collect())) if "run" in fitness.columns else ()
    return Run(p, population, fitness, log[-1][1], log, path, seeds=seeds)


def _picked(p: Problem, pop: DataFrame, fit: DataFrame, seed, generation: int, tag: str, by: tuple[str, ...]) -> DataFrame:
    if p.select == "rotary":
        sel = V.rotary_select(V.rotary_table(fit, "inverted" if p.side == "min" else "normal", by), p.pop, seed, f"{tag}{generation}", by)
    else:
        sel = V.roulette_select(fit, p.side, p.pop, seed, tag=f"{tag}{generation}", by=by)
    return sel.join(pop, [*by, "cand_id"]).select(*by, F.col("draw").alias("cand_id"), "pos", "gene")


def single_step(run: Run, seed: int, report: bool = False) -> Run:
    """Selection, crossover, mutation, repair, score, elitism: one generation; ``report``: with the problem's metrics."""
    p, g, seeds = run.problem, run.generation + 1, run.seeds
    by, key = _by(seeds), F.col("run") if seeds else seed

    def bred() -> DataFrame:
        if p.propose:
            return p.propose(run.population, run.fitness, seed, g)
        if p.select == "eda":
            new = V.eda_resample(run.population, run.fitness, p.pop, p.budget, key * 1000 + g, p.side, by=by)
        else:
            a, b = (_picked(p, run.population, run.fitness, key, g, tag, by) for tag in ("a", "b"))
            new = V.crossover(a, b, p.cross_rate, key, g, by)
        new = p.mutate(new, seed, g) if p.mutate else V.mutate(new, p.mutation_rate, p.pool.count(), key, g, by)
        return V.repair_duplicates(new, p.pool, key, g, by) if p.repair and p.pool is not None else new

    new = scoped(bred, "population")
    return _survivors(run, new, score(p, new, seeds), g, seed, report)


def _survivors(run: Run, new: DataFrame, fit: DataFrame, g: int, seed: int, report: bool) -> Run:
    p, by = run.problem, _by(run.seeds)
    kept = materialise(p.survive(run.fitness, fit, run.population, new) if p.survive else V.elitism(run.fitness, fit, p.side, p.pop, by), "kept")
    both = run.population.select(*by, F.lit(0).alias("origin"), "cand_id", "pos", "gene").union(new.select(*by, F.lit(1), "cand_id", "pos", "gene"))
    rank = F.col("rank").alias("cand_id")
    pop = materialise(both.join(F.broadcast(kept.select(*by, "origin", "cand_id", "rank")), [*by, "origin", "cand_id"]).select(*by, rank, "pos", "gene"), "population")
    fitness = materialise(kept.select(*by, rank, "fitness"), "fitness")
    for table in (new, fit, kept):
        discard(table)
    return _state(p, pop, fitness, g, _rows(p, pop, fitness, g, seed, report, run.seeds), run.path, run, run.seeds)


def own_steps(p: Problem) -> bool:
    """Whether a problem brings steps of its own, which know one seed and no runs."""
    return bool(p.init or p.mutate or p.survive or p.propose)


def init_state(p: Problem, seed: int, path: str | None = None, seeds: tuple[int, ...] = ()) -> Run:
    """Generation 0: distinct genes by permutations of the pool's indexes, which never list population x pool."""
    if seeds and own_steps(p):
        raise ValueError(f"{p.name} has steps of its own: its runs can't go side by side")
    pop = scoped(lambda: p.init(seed) if p.init else V.init_population(p.pool, p.pop, p.budget, seed, seeds), "population")
    fit = score(p, pop, seeds)
    return _state(p, pop, fit, 0, _rows(p, pop, fit, 0, seed, False, seeds), path, None, seeds)


def evolve(p: Problem, generations: int, seed: int = 1024, resume: Run | None = None, path: str | None = None, seeds: tuple[int, ...] = ()) -> Run:
    """Run ``generations`` more; from ``resume`` if given. The same seed gives the same candidates, however a run is cut
    up. Metrics are reported every ``report_every`` generations and at the last of a call. ``path``: where the state of every
    generation is written. Tables of the generations between are deleted; the run given, and the one returned, keep theirs,
    so either can be continued.

    ``seeds``: as many runs side by side, each as it would be alone with its seed. Populations and fitness carry run (its
    seed), and a generation of all of them is about as many Spark jobs as one run's, but for the reports, which are a run's
    each, and for further batches of scores.
    ``alone`` takes one out."""
    run = resume or init_state(p, seed, path, tuple(seeds))
    for left in range(generations, 0, -1):
        new = single_step(run, seed, left == 1 or (run.generation + 1) % p.report_every == 0)
        if run is not resume:
            run.drop()
        run = new
    return run


def alone(run: Run, seed: int) -> Run:
    """One of runs side by side, to be continued by ``evolve`` with its seed. Its tables are those of all."""
    own = lambda df: df.where(F.col("run") == seed).drop("run")
    return Run(run.problem, own(run.population), own(run.fitness), run.generation, [r for r in run.log if r[0] == run_name(run.problem, seed)])


def until(p: Problem, generations: int, seed: int, path: str | None, again: bool, spark: SparkSession, seeds: tuple[int, ...] = ()) -> Run:
    """The run of a named job up to ``generations``. ``again``: from the last whole generation at ``path``, if there is any."""
    was = resume(p, path, spark) if again and path and exists(spark, f"{path}/history") else None
    if was is not None and was.generation >= generations:
        return was
    return evolve(p, generations - (was.generation if was else 0), seed, was, path, seeds)


def lasting(spark: SparkSession, path: str | None, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that a job makes once: read from ``path`` where a run before has written it, whole."""
    if not path:
        return scoped(build, name)
    at = f"{path}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        with scope():
            build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def restarts(p: Problem, generations: int, loops: int, seed: int = 1024, path: str | None = None, again: bool = False) -> tuple[DataFrame, Run]:
    """``loops`` runs of a problem, from seeds seed, seed + 1 and so on: (their histories under run_id, the best run; ties:
    the least seed). They go side by side; those of a problem with steps of its own go one after another, to the same
    result. ``path`` and ``again`` as for the named jobs."""
    seeds, spark = tuple(range(seed, seed + loops)), p.pool.sparkSession if p.pool is not None else SparkSession.active()
    if own_steps(p):
        runs = [until(p, generations, s, f"{path}/run={s}" if path else None, again, spark) for s in seeds]
    else:
        every = until(p, generations, seed, path, again, spark, seeds)
        runs = [alone(every, s) for s in seeds]
    sign = 1 if p.side == "min" else -1
    best = min(runs, key=lambda r: sign * r.log[-1][2])
    return spark.createDataFrame([row for r in runs for row in r.log], HISTORY), best


# problems


def _pool(df: DataFrame, *order) -> DataFrame:
    return scoped(lambda: N.rank_by(df, *order).withColumn("idx", F.col("rank") - 1).drop("rank"), "pool")


def _budget(edges: DataFrame, rate: float) -> int:
    return G.graph_stats(edges, rate, rate).first()["k"]


def _cut(edges: DataFrame, nodes: DataFrame, decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = materialise(decoded.select("cand_id", "node"), "gone")
    return materialise(P.remove_nodes(edges, gone), "cut"), materialise(P.survivors(nodes, gone), "left")


def _pcg(edges, nodes):
    """Connected pairs of each candidate's graph: a block of candidates a task, where the whole graph is counted to be
    small; star rounds over all candidates beyond that. Both give the same counts."""
    if _small(edges):
        return lambda c: R.scores_without(edges, c)
    return lambda c: R.pairwise_connectivity(R.components(*_cut(edges, nodes, c)))


def _widest(edges, nodes, hops: int):
    """The widest reach of each candidate's graph, likewise: balls of every node by bits beyond that."""
    if _small(edges):
        return lambda c: R.scores_without(edges, c, False, hops)
    return lambda c: R.max_reach(R.reach_within(*_cut(edges, nodes, c), hops))


def _small(edges: DataFrame) -> bool:
    return edges.count() <= R.HELPER_EDGES


def _cut_batch(edges: DataFrame) -> int | None:
    """Candidates whose nodes go are scored in one job where none of their graphs is written."""
    return None if _small(edges) else batch_of(edges)


def _best_rows(fitness: DataFrame, pop: DataFrame, pool: DataFrame, size: int, side: str = "min") -> DataFrame:
    """cand_id, node: the genes of the best of each ``size`` candidates."""
    by = F.struct(F.col("fitness") if side == "min" else (-F.col("fitness")).alias("fitness"), "cand_id")
    best = fitness.groupBy(F.floor(F.col("cand_id") / size).alias("run")).agg(F.min_by("cand_id", by).alias("cand_id"))
    return decode(pop.join(best.select("cand_id"), "cand_id"), pool).select("cand_id", "node")


def greedy_pool(edges: DataFrame, pool: DataFrame, k: int, size: int, pop: int, runs: int, fitness: Callable, seed: int) -> DataFrame:
    """node, idx: a gene pool of ``size``, half of it the commonest genes in the best of each of ``runs`` random populations
    (all scored in one job), the rest by degree."""

    def build() -> DataFrame:
        start = materialise(V.init_population(pool, pop * runs, k, seed), "population")
        fit = materialise(fitness(decode(start, pool)), "fitness")
        return V.gene_pool_cutoff(_best_rows(fit, start, pool, pop), G.degree_rank(edges), size)

    return scoped(build, "pool")


def searched_pool(spark: SparkSession, edges: DataFrame, p: Problem, size: int, runs: int, generations: int, seed: int, path: str | None = None, again: bool = False) -> DataFrame:
    """node, idx: as ``greedy_pool``, from the best candidate of each of ``runs`` small searches of the problem, side by side."""
    seeds = tuple(seed + 7919 * (r + 1) for r in range(runs))

    def build() -> DataFrame:
        run = until(p, generations, seed, path, again, spark, seeds)
        flat = lambda df: V.join_runs(df, p.pop, seeds)
        return V.gene_pool_cutoff(_best_rows(flat(run.fitness), flat(run.population), p.pool, p.pop, p.side), G.degree_rank(edges), size)

    return scoped(build, "pool")


def _node_pool(nodes: DataFrame) -> DataFrame:
    return _pool(nodes.select("node"), F.asc("node"))


def cutoff_problem(spark: SparkSession, edges: DataFrame, pop: int = 40, rate: float = 0.1, pool: DataFrame | None = None) -> Problem:
    """Remove nodes of a pool (default: all nodes); least pairwise connectivity."""
    nodes = materialise(G.node_set(edges), "nodes")
    k = _budget(edges, rate)
    pcg = _pcg(edges, nodes)
    reach = _widest(edges, nodes, 17)
    return Problem("cutoff", "min", pool if pool is not None else _node_pool(nodes), k, pop, lambda c: pcg(c).select("cand_id", F.col("pcg").alias("fitness")), lambda c: reach(c).select("max_reach"), 0.7, 0.2, select="rotary", batch=_cut_batch(edges))


def sixdst(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 80, rate: float = 0.1, seed: int = 1024, pool_runs: int = 10, pool_size: int | None = None, path: str | None = None, again: bool = False) -> Run:
    """Remove nodes so that the widest six-hop reach is least; reports connected pairs. The pool, of ``pool_size`` genes
    (default: four times the budget), comes from the best of ``pool_runs`` random populations by connected pairs, and degrees.

    Of all jobs: ``path`` is where pools and every generation are written; ``again`` goes on from there, in any session, up
    to ``generations`` in all.
    """
    nodes = materialise(G.node_set(edges), "nodes")
    k = _budget(edges, rate)
    pcg = _pcg(edges, nodes)
    pool = lasting(spark, path, "pool", lambda: greedy_pool(edges, _node_pool(nodes), k, pool_size or 4 * k, pop, pool_runs, lambda c: pcg(c).select("cand_id", F.col("pcg").alias("fitness")), seed))
    reach = _widest(edges, nodes, 6)
    fit = lambda c: reach(c).select("cand_id", F.col("max_reach").alias("fitness"))
    p = Problem("sixdst", "min", pool, k, pop, fit, lambda c: pcg(c).select("pcg"), 0.6, 0.2, batch=_cut_batch(edges))
    return until(p, generations, seed, path, again, spark)


def cutoff(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, pool_runs: int = 10, pool_generations: int = 100, pool_size: int | None = None, path: str | None = None, again: bool = False) -> Run:
    """Remove nodes; least pairwise connectivity, by rotary selection. The pool comes from the best rows of ``pool_runs`` small
    searches of ``pool_generations`` over all nodes, side by side, and degrees."""
    whole = cutoff_problem(spark, edges, pop, rate)
    pool = lasting(spark, path, "pool", lambda: searched_pool(spark, edges, whole, pool_size or 4 * whole.budget, pool_runs, pool_generations, seed, f"{path}/searches" if path else None, again))
    return until(cutoff_problem(spark, edges, pop, rate, pool), generations, seed, path, again, spark)


@by_shuffles
def tde(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, factor: float = 0.5, rounds: int | None = None, path: str | None = None, again: bool = False) -> Run:
    """Differential evolution over min-max degrees: genotypes move, phenotypes are the nearest nodes; greatest loss of
    robustness. Reports connected pairs and the widest reach in 17 hops. ``rounds``: robustness in so many removal steps, for
    graphs of which one doesn't fit a task; without it every node is a step."""
    nodes = materialise(G.node_set(edges), "nodes")
    k = _budget(edges, rate)
    mm = materialise(G.minmax_degree(edges), "minmax")
    pool = _pool(nodes, F.asc("node"))
    lost = R.robustness if rounds is None else lambda e, n: R.robustness_steps(e, n, rounds)
    r0 = scoped(lambda: lost(edges.select(F.lit(0).alias("cand_id"), "src", "dst"), nodes.select(F.lit(0).alias("cand_id"), "node")), "r0")
    near = rounds is None and _small(edges)
    after = lambda c: R.scores_without(edges, c, False, lost=True) if near else lost(*_cut(edges, nodes, c))
    fit = lambda c: R.robustness_gain(r0, after(c)).select("cand_id", F.col("gain").alias("fitness"))

    def metrics(c: DataFrame) -> DataFrame:
        if _small(edges):
            return R.scores_without(edges, c, hops=17).select("pcg", "max_reach")
        e, left = _cut(edges, nodes, c)
        return R.pairwise_connectivity(R.components(e, left)).select("pcg").crossJoin(R.max_reach(R.reach_within(e, left, 17)).select("max_reach"))

    def propose(population: DataFrame, fitness: DataFrame, at: int, g: int) -> DataFrame:
        geno = V.encode_genotype(decode(population, pool), mm)
        pick = lambda tag: V.roulette_select(fitness, "max", pop, at, tag=f"{tag}{g}").join(geno, "cand_id").select(F.col("draw").alias("cand_id"), "pos", "x")
        trial = V.de_mutation(pick("x"), pick("y"), pick("z"), factor)
        j = geno.withColumnRenamed("x", "old").join(trial, ["cand_id", "pos"]).select("cand_id", "pos", F.when(V.u(at, g, F.col("cand_id"), F.col("pos"), "de") < 0.5, F.col("x")).otherwise(F.col("old")).alias("x"))
        return V.decode_phenotype(j, mm).join(pool, "node").select("cand_id", "pos", F.col("idx").alias("gene"))

    p = Problem("tde", "max", pool, k, pop, fit, metrics, 0.5, 0.0, propose=propose, batch=_cut_batch(edges) if near else batch_of(edges))
    return until(p, generations, seed, path, again, spark)


def _q_of(edges: DataFrame, comms: DataFrame) -> DataFrame:
    return C.modularity(edges, comms, ("cand_id",))


def _nmi_of(a: DataFrame, base: DataFrame) -> DataFrame:
    """cand_id, nmi of each candidate's partition with the base, over the nodes of both."""
    t = a.select("cand_id", "node", F.col("comm").alias("x")).join(base.select("node", F.col("comm").alias("y")), "node").groupBy("cand_id", "x", "y").agg(F.count("*").alias("n"))
    total = t.groupBy("cand_id").agg(F.sum("n").alias("total"))
    h = lambda *k: t.groupBy("cand_id", *k).agg(F.sum("n").alias("n")).join(total, "cand_id").groupBy("cand_id").agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias("h_" + "".join(k)))
    j = h("x").join(h("y"), "cand_id").join(h("x", "y"), "cand_id")
    return j.select("cand_id", F.when(F.col("h_x") + F.col("h_y") < 1e-15, 1.0).otherwise(2 * (F.col("h_x") + F.col("h_y") - F.col("h_xy")) / (F.col("h_x") + F.col("h_y"))).alias("nmi"))


def _communities(edges: DataFrame) -> Callable[..., DataFrame]:
    """Louvain for graphs of that size: a graph a task, where the graph is counted to be small; rounds over all candidates at
    once beyond that. Both find the same communities."""
    return louvain_by_graph if edges.count() <= SMALL else louvain


def communities_after(changed: DataFrame, changes: DataFrame, nodes: DataFrame, base: DataFrame, seed: int, find: Callable[..., DataFrame] = louvain) -> DataFrame:
    """cand_id, node, comm: Louvain communities of every candidate's graph ``changed``, from the base's, looking first at the
    ends of its ``changes`` (cand_id, src, dst). A node that has lost all its edges is a community of one."""
    ends = changes.select("cand_id", F.explode(F.array("src", "dst")).alias("node"))
    every = nodes.select("node").crossJoin(changes.select("cand_id").distinct())
    return scoped(lambda: find(changed, seed, base, ("cand_id",), every, ends), "communities")


def _scores_after(edges: DataFrame, nodes: DataFrame, base: DataFrame, seed: int) -> Callable[[DataFrame], DataFrame]:
    """cand_id, q, nmi of each candidate's communities after its changes: a block of candidates a task, where the graph is
    counted to be small; rounds over all candidates beyond that. Both give the same numbers."""
    if _small(edges):
        return lambda c: changed_scores(edges, base, c, seed)

    def rounds(c: DataFrame) -> DataFrame:
        e = materialise(P.apply_edge_changes(edges, c), "changed")
        now = communities_after(e, c, nodes, base, seed)
        return _q_of(e, now).join(_nmi_of(now, base), "cand_id")

    return rounds


def cgn(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, path: str | None = None, again: bool = False) -> Run:
    """Delete edges inside communities and add some between: least similarity to the communities before. Typed genes: a
    deletion is any edge inside a community, an addition any unlinked pair of nodes in different ones, drawn by number, never
    listed. Every candidate has Louvain communities of its own; reports their modularity."""
    find = _communities(edges)
    base = lasting(spark, path, "base", lambda: find(edges, seed))
    k = _budget(edges, rate)
    nodes = scoped(lambda: G.dense_rank_ids(G.node_set(edges), "node"), "nodes")
    dels = _pool(C.inside_edges(edges, base), F.asc("src"), F.asc("dst"))
    at_all = V.places(spark, pop, k)
    gene = F.struct("op", "src", "dst").alias("gene")
    side = lambda c, out: base.select(F.col("node").alias(c), F.col("comm").alias(out))
    apart = lambda pairs: pairs.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").where("_a <> _b").drop("_a", "_b")

    def fresh(at: int) -> DataFrame:
        return G.draw_pairs(nodes, edges, pop, k, at, apart)

    def init(at: int) -> DataFrame:
        n = dels.count()
        drawn = at_all.withColumn("idx", permuted(F.col("pos") % max(n, 1), max(n, 1), at, F.col("cand_id"), "init")).join(dels, "idx").select("cand_id", "pos", F.lit("del").alias("op"), "src", "dst")
        adds = materialise(fresh(at).where(F.col("pos") < F.floor(V.u(at, F.col("cand_id"), "mix") * k)).select("cand_id", "pos", F.lit("add").alias("op"), "src", "dst"), "adds")
        return drawn.join(adds.select("cand_id", "pos"), ["cand_id", "pos"], "left_anti").union(adds).select("cand_id", "pos", gene)

    def mutate(new: DataFrame, at: int, g: int) -> DataFrame:
        adds = _pool(fresh(at * 1000 + g).select("src", "dst").distinct(), F.asc("src"), F.asc("dst"))
        return V.edge_mutation(new.select("cand_id", "pos", "gene.*"), dels, adds, 0.01, at * 1000 + g).select("cand_id", "pos", gene)

    scores = _scores_after(edges, nodes, base, seed)
    fit = lambda c: scores(c).select("cand_id", F.col("nmi").alias("fitness"))
    p = Problem("cgn", "min", None, k, pop, fit, lambda c: scores(c).select(F.round("q", 6).alias("q")), 0.7, 0.01, report_every=30, init=init, mutate=mutate, batch=_cut_batch(edges))
    return until(p, generations, seed, path, again, spark)


def qattack(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, path: str | None = None, again: bool = False) -> Run:
    """Rewire nodes: greatest exp(-Q) of the communities after the change, which every candidate has of its own. Typed
    genes: a node, one it is to be linked to and one it is to lose; fresh ones are drawn in every generation. Reports Q."""
    find = _communities(edges)
    base = lasting(spark, path, "base", lambda: find(edges, seed))
    k = _budget(edges, rate)
    idx = scoped(lambda: G.dense_rank_ids(G.node_set(edges), "node"), "nodes")
    adj = materialise(G.adjacency(edges), "adjacency")
    gene = F.struct("node", "add_node", "remove_node").alias("gene")

    def draw(at: int) -> DataFrame:
        return V.init_rewires(adj, G.sample_non_neighbors(idx, edges, 2, at), pop, k, at)

    def mutate(new: DataFrame, at: int, g: int) -> DataFrame:
        return V.rewire_mutation(new.select("cand_id", "pos", "gene.*"), materialise(draw(at * 1000 + g), "rewires"), 0.1, at * 1000 + g).select("cand_id", "pos", gene)

    scores = _scores_after(edges, idx, base, seed)
    q = lambda c: scores(P.rewire_changes(c))
    fit = lambda c: C.q_fitness(q(c)).select("cand_id", "fitness")
    p = Problem("qattack", "max", None, k, pop, fit, lambda c: q(c).select(F.round("q", 6).alias("q")), 0.8, 0.1, report_every=30, init=lambda at: draw(at).select("cand_id", "pos", gene), mutate=mutate, batch=_cut_batch(edges))
    return until(p, generations, seed, path, again, spark)


def cda_eda(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, iterations: int = 4, path: str | None = None, again: bool = False) -> Run:
    """Delete edges: greatest shift of distances in the walk matrix's embedding, over all pairs of nodes. Every candidate's
    graph has an embedding of its own, of ``iterations`` rounds, in one task where it fits. Reports modularity and similarity
    of communities."""
    pool = _pool(edges.select("src", "dst"), F.asc("src"), F.asc("dst"))
    nodes, m = materialise(G.node_set(edges), "nodes"), edges.count()
    base = lasting(spark, path, "base", lambda: C.embedding_by_graph(edges, m, 6, iterations, seed).select("node", "vec"))
    find = _communities(edges)
    comms = lasting(spark, path, "communities", lambda: find(edges, seed))

    def fit(c: DataFrame) -> DataFrame:
        e = materialise(P.delete_edges(edges, c), "changed")
        shift = C.distance_shift_blocks(materialise(C.embedding_by_graph(e, m, 6, iterations, seed, ("cand_id",)), "moved"), base, keys=("cand_id",))
        return c.select("cand_id").distinct().join(shift, "cand_id", "left").select("cand_id", F.coalesce("shift", F.lit(0.0)).alias("fitness"))

    def metrics(c: DataFrame) -> DataFrame:
        e = materialise(P.delete_edges(edges, c), "best")
        now = communities_after(e, c, nodes, comms, seed, find)
        return _q_of(e, now).select(F.round("q", 6).alias("q")).crossJoin(_nmi_of(now, comms).select(F.round("nmi", 6).alias("nmi")))

    return until(Problem("cda_eda", "max", pool, _budget(edges, rate), pop, fit, metrics, 0.6, 0.2, batch=batch_of(edges)), generations, seed, path, again, spark)


def _lpa(name: str, spark: SparkSession, edges: DataFrame, generations: int, pop: int, rate: float, seed: int, path: str | None, again: bool) -> Run:
    """Typed genes: at a candidate's first k places deletions of train edges, at the next k additions, which are any pairs of
    nodes that are neither train nor test edges, drawn by number and never listed."""
    split = materialise(G.edge_train_test_split(edges, 0.2, seed), "split")
    train, test = (materialise(split.where(F.col("split") == s).select("src", "dst"), s) for s in ("train", "test"))
    nodes = scoped(lambda: G.dense_rank_ids(G.node_set(edges), "node"), "nodes")
    n, k = nodes.count(), _budget(train, rate)
    dels = _pool(train, F.asc("src"), F.asc("dst"))
    m = dels.count()
    gene = F.struct("op", "src", "dst").alias("gene")

    def fresh(at: int, each: int) -> DataFrame:
        """cand_id, op, j, gene: of either kind the first ``each`` distinct genes a candidate, or as many as there are."""
        places = G.numbered_places(V.cand_ids(spark, pop), 0, min(each, m), m, at, F.col("cand_id"), "del").withColumnRenamed("number", "idx")
        gone = places.join(dels, "idx").select("cand_id", F.lit("del").alias("op"), F.col("k").cast("int").alias("j"), "src", "dst")
        more = G.draw_pairs(nodes, edges, pop, each, at).select("cand_id", F.lit("add").alias("op"), F.col("pos").alias("j"), "src", "dst")
        return materialise(gone.union(more).select("cand_id", "op", "j", gene), "fresh")

    def init(at: int) -> DataFrame:
        return fresh(at, k).select("cand_id", F.when(F.col("op") == "add", F.col("j") + k).otherwise(F.col("j")).cast("int").alias("pos"), "gene")

    def mutate(new: DataFrame, at: int, g: int) -> DataFrame:
        """A mutated or a repeated gene gives way to the next fresh one of its kind that the candidate lacks. Some more fresh
        ones are drawn than the candidate with the most such places has, and more if any is short, up to 2 k."""
        seen = F.row_number().over(W.partitionBy("cand_id", "gene").orderBy("pos"))
        marked = materialise(new.withColumn("out", (seen > 1) | (V.u(at, g, F.col("cand_id"), F.col("pos"), "m") < 0.1)).withColumn("op", F.col("gene.op")), "marked")
        holes = marked.where("out").withColumn("i", F.row_number().over(W.partitionBy("cand_id", "op").orderBy("pos")))
        most = marked.where("out").groupBy("cand_id", "op").count().agg(F.max("count")).first()[0] or 0
        each = min(2 * k, most + most // 4 + 16)
        while True:
            spare = fresh(at * 1000 + g, each).join(marked.select("cand_id", "gene"), ["cand_id", "gene"], "left_anti").withColumn("i", F.row_number().over(W.partitionBy("cand_id", "op").orderBy("j")))
            filled = materialise(holes.join(spare.select("cand_id", "op", "i", F.col("gene").alias("new")), ["cand_id", "op", "i"], "left").select("cand_id", "pos", "gene", "new"), "filled")
            if each >= 2 * k or filled.where("new is null").isEmpty():
                break
            each = min(2 * k, 2 * each)
        return marked.where("not out").select("cand_id", "pos", "gene").union(filled.select("cand_id", "pos", F.coalesce("new", "gene")))

    def propose(population: DataFrame, fitness: DataFrame, at: int, g: int) -> DataFrame:
        kinds = [population.where(F.col("gene.op") == op) for op in ("del", "add")]
        new = [V.eda_resample(x, fitness, pop, k, at * 1000 + g, "max") for x in kinds]
        return mutate(materialise(new[0].union(new[1].withColumn("pos", F.col("pos") + k)), "resampled"), at, g)

    ra0 = scoped(lambda: L.resource_allocation(train), "ra")
    sums = L.base_sums(train, test, ra0)

    def metrics(c: DataFrame) -> DataFrame:
        e = materialise(P.apply_edge_changes(train, c).select("src", "dst"), "best")
        ra = materialise(L.resource_allocation(e), "ra")
        return L.precision_at_l(ra, e, test).crossJoin(L.auc(ra, e, test, n)).select("precision", F.round("auc", 6).alias("auc"))

    p = Problem(name, "max", None, 2 * k, pop, lambda c: L.lpa_fitness_by_change(train, c, test, ra0, sums, n), metrics, 0.7, 0.1, report_every=10, init=init, mutate=mutate, propose=propose if name == "lpa_eda" else None)
    return until(p, generations, seed, path, again, spark)


@by_shuffles
def lpa_eda(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, path: str | None = None, again: bool = False) -> Run:
    """Delete and add edges against link prediction, by estimation of distribution, a kind of gene at a time."""
    return _lpa("lpa_eda", spark, edges, generations, pop, rate, seed, path, again)


@by_shuffles
def lpa_ga(spark: SparkSession, edges: DataFrame, generations: int, pop: int = 40, rate: float = 0.1, seed: int = 1024, path: str | None = None, again: bool = False) -> Run:
    """The same by selection and crossover."""
    return _lpa("lpa_ga", spark, edges, generations, pop, rate, seed, path, again)


@dataclass
class Labelled:
    """A labelled graph with a fitted classifier, whose logits X W are projected before any propagation."""

    edges: DataFrame
    labels: DataFrame
    xw: DataFrame
    features: DataFrame
    weights: DataFrame


def labelled(edges: DataFrame, features: DataFrame, labels: DataFrame, n_feats: int) -> Labelled:
    nodes = labels.select("node")
    w = materialise(N.fit_node_classifier(materialise(N.propagate_graph(N.row_normalize_features(features), edges, nodes, 2), "hops"), labels, n_feats, max_iter=20), "weights")
    xw = materialise(N.linear_logits(N.row_normalize_features(features), w.where("feat >= 0")).select("node", F.col("class").alias("feat"), F.col("logit").alias("value")), "xw")
    return Labelled(edges, labels, xw, features, w)


def nca_ga(spark: SparkSession, g: Labelled, generations: int, pop: int = 20, rate: float = 0.025, seed: int = 1024, path: str | None = None, again: bool = False) -> Run:
    """Delete edges so that the classifier's loss on the test split is greatest; reports accuracy and the share of the
    split whose class changes. Only nodes within two hops of a deletion are scored anew."""
    pool = _pool(g.edges.select("src", "dst"), F.asc("src"), F.asc("dst"))
    k = max(1, int(rate * pool.count()))
    before = N.propagated(g.edges, g.labels.select("node"), g.xw)
    changes = lambda c: c.select("cand_id", F.lit("del").alias("op"), "src", "dst")

    def fit(c: DataFrame) -> DataFrame:
        z = materialise(N.rescored_rows(before, changes(c)), "rescored")
        return N.loss_after(before, z, c.select("cand_id").distinct(), g.labels, "test").select("cand_id", F.col("loss").alias("fitness"))

    def metrics(c: DataFrame) -> DataFrame:
        z = materialise(N.rescored_rows(before, changes(c)), "rescored")
        return N.attack_report(before, z, g.labels, "test")

    return until(Problem("nca_ga", "max", pool, k, pop, fit, metrics, 0.7, 0.3, report_every=30), generations, seed, path, again, spark)


def gani(spark: SparkSession, g: Labelled, generations: int, pop: int = 20, seed: int = 1024, rate: float = 0.05, ratio: float = 0.7, injected: int | None = None, path: str | None = None, again: bool = False) -> Run:
    """Inject nodes (``injected``; default: rate x nodes), each with a drawn label's features, linked to nodes of other
    labels so that most test nodes are misclassified.

    For each, all single links are scored in one job, a candidate a link, by what changes within two hops of it; the first
    floor(ratio x links) by fitness, then homophily decrease, are the pool. Its own loop resolves conflicts between rows and
    breaks ties of elites by homophily decrease. The next node starts from the graph with it, and its labels' homophily anew.
    A node of one link takes the best single link, without a search. The history has the generations of every node's search,
    and after each node a row of its own, named ``gani-after``, whose generation is how many nodes are injected and whose
    metrics are accuracy and the share of test nodes whose class has changed since before the attack. ``Run.graph`` is the
    attacked graph.
    """
    edges, xw, labels, features, run, log = g.edges, g.xw, g.labels, g.features, None, []
    profile = materialise(N.label_feature_profile(g.features, labels), "profile")
    classes = [r["label"] for r in labels.select("label").distinct().orderBy("label").collect()]
    budgets = N.degree_budget(edges, labels.select("node"))
    count = injected if injected is not None else max(1, int(rate * labels.count()))
    clean = scoped(lambda: N.predict_class(N.propagated(edges, labels.select("node"), xw).logits), "clean")
    for i in range(count):
        at = f"{path}/node={i}" if path else None
        label = classes[int(spark.range(1).select(V.u(seed, i, "label")).first()[0] * len(classes))]
        drawn = budgets.orderBy(V.order(seed, i, F.col("node"))).limit(1).first()
        new_x = materialise(N.injected_node_features(profile, g.features, label), "injected")
        homo = materialise(N.homophily(edges, labels), "homophily")
        nodes = materialise(G.node_set(edges, labels.select("node")), "nodes")
        new_id = nodes.agg(F.max("node") + 1).first()[0]
        row = N.linear_logits(N.row_normalize_features(new_x.select(F.lit(new_id).alias("node"), "feat", "value")), g.weights.where("feat >= 0")).select("node", F.col("class").alias("feat"), F.col("logit").alias("value"))
        xw = materialise(xw.union(row), "xw")
        before = N.propagated(edges, nodes.union(spark.createDataFrame([(new_id,)], nodes.schema)), xw)  # the new node alone

        def fit(c: DataFrame, before=before, labels=labels, new_id=new_id) -> DataFrame:
            links = c.select("cand_id", F.lit("add").alias("op"), F.col("node").alias("src"), F.lit(new_id).alias("dst"))
            z = materialise(N.rescored_rows(before, links), "rescored")
            return N.misclassified_after(before, z, c.select("cand_id").distinct(), labels, "test")

        def links_pool(fit=fit, homo=homo, labels=labels, label=label) -> DataFrame:
            links = materialise(N.potential_edges(homo, labels, label), "links")
            single = materialise(fit(links.select((F.col("rank") - 1).cast("int").alias("cand_id"), F.lit(0).alias("pos"), "node")), "single")
            losses = links.join(single, F.col("cand_id") == F.col("rank") - 1).select("node", F.col("fitness").cast("double").alias("loss"))
            return N.rank_single_links(materialise(losses, "losses"), homo, ratio).select((F.col("rank") - 1).alias("idx"), "node")

        pool = lasting(spark, at, "pool", links_pool)
        budget = max(1, min(pool.count(), int(drawn["budget"] or 1)))

        def survive(old, new, was, now, pool=pool, homo=homo):
            genes = was.select(F.lit(0).alias("origin"), "cand_id", "pos", "gene").union(now.select(F.lit(1), "cand_id", "pos", "gene"))
            chosen = genes.join(pool.withColumnRenamed("idx", "gene"), "gene").select("origin", "cand_id", "node")
            kept = V.sga_elitism(old, new, "min", pop, chosen, homo)  # its best comes first
            return kept.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("best"), "rank")) - 1).select("rank", "origin", "cand_id", "fitness")

        def mutate(new, at, gen, pool=pool):
            return V.resolve_conflicts(V.mutate(new, 0.2, pool.count(), at, gen), pool, at * 1000 + gen)

        p = Problem(f"gani{i}", "min", pool, budget, pop, fit, None, 0.6, 0.2, report_every=30, mutate=mutate, survive=survive)
        run = until(p, generations if budget > 1 else 0, seed, at, again, spark)
        best = materialise(decode(run.population.where("cand_id = 0"), pool) if budget > 1 else pool.where("idx = 0").select(F.lit(0).alias("cand_id"), F.lit(0).alias("pos"), "node"), "best")
        features = materialise(P.inject_features(features, nodes, new_x), "features")
        edges = materialise(P.inject_node(edges, nodes, best).select("src", "dst"), "edges")
        labels = materialise(labels.union(spark.createDataFrame([(new_id, label, "injected")], labels.schema)), "labels")
        with scope():
            now = N.predict_class(N.propagated(edges, labels.select("node"), xw).logits)
            report = N.accuracy(now, labels, "test").crossJoin(N.attack_success_rate(clean, now, g.labels, "test"))
            told = report.select(F.to_json(F.struct(F.round("accuracy", 6).alias("accuracy"), F.round("asr", 6).alias("asr"))).alias("m")).first()["m"]
        log += [*run.log, (f"gani-after-{seed}", i + 1, run.log[-1][2], run.log[-1][3], told)]
    run.log, run.graph = log, Labelled(edges, labels, xw, features, g.weights)
    return run


def _copart(name):
    def job(spark: SparkSession, sf: str, **more) -> Run:
        from cutweave.sources.fixtures import copart

        return globals()[name](spark, materialise(copart(spark, sf, "sparse"), "graph"), **more)

    return job


def _classified(name):
    def job(spark: SparkSession, sf: str, **more) -> Run:
        from cutweave.sources.fixtures import copart, part_features, part_labels

        return globals()[name](spark, labelled(materialise(copart(spark, sf, "disc"), "graph"), part_features(spark, sf), materialise(part_labels(spark, sf), "labels"), 31), **more)

    return job


JOBS = {n: _copart(n) for n in ("sixdst", "cutoff", "tde", "cgn", "qattack", "cda_eda", "lpa_eda", "lpa_ga")} | {n: _classified(n) for n in ("nca_ga", "gani")}
