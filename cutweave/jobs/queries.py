"""One query for each operator, over graphs and logs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutweave.functions.rand import u
from cutweave.jobs import evolution as J
from cutweave.operators.louvain import PART, SMALL, louvain as louvain_of, louvain_by_graph, parts_of
from cutweave.operators import community as C, evolve as V, graph as G, linkpred as L, nodeclass as N, perturb as P, reach as R, reports as H
from cutweave.session import materialise, new_path
from cutweave.sources import readers as A
from cutweave.sources.fixtures import call_log, communities, copart, part_features, part_labels, run_events, table
from cutweave.streaming import streams as S

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> dict:
    """Columns rounded to six places, so that sums in another order agree."""
    return {n: F.round(n, 6) for n in names}


# fixtures


def sparse(s: SparkSession, d: str) -> DataFrame:
    return materialise(copart(s, d, "sparse"), "graph")


def disc(s: SparkSession, d: str) -> DataFrame:
    return materialise(copart(s, d, "disc"), "graph")


def whole(s: SparkSession, d: str) -> DataFrame:
    """In order within files: the table, and shuffles of its rows as they stand, take less disk."""
    return materialise(copart(s, d, "all").sortWithinPartitions("src", "dst"), "graph")


def removed(s: SparkSession, nodes: DataFrame, pop: int = 4, rate: float = 0.1) -> DataFrame:
    """cand_id, node: each node with a chance of ``rate``, by hash."""
    return V.cand_ids(s, pop).crossJoin(nodes.select("node")).where(u("rm", F.col("cand_id"), F.col("node")) < rate)


def perturbed(s: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of four candidates."""
    n = G.node_set(edges)
    gone = materialise(removed(s, n), "removed")
    return materialise(P.remove_nodes(edges, gone), "cut"), materialise(P.survivors(n, gone), "left")


def edge_changes(s: SparkSession, edges: DataFrame, pop: int = 3) -> DataFrame:
    """cand_id, op, src, dst: a twentieth of the edges, and distance-two pairs, by hash."""
    c = V.cand_ids(s, pop)
    key = (F.col("cand_id"), F.col("src"), F.col("dst"))
    dels = c.crossJoin(edges).where(u("del", *key) < 0.05).select("cand_id", F.lit("del").alias("op"), "src", "dst")
    adds = c.crossJoin(G.two_hop_pairs(edges).select("src", "dst")).where(u("add", *key) < 0.02).select("cand_id", F.lit("add").alias("op"), "src", "dst")
    return dels.union(adds)


def population(s: SparkSession, n: int, pop: int = 8, budget: int = 12) -> DataFrame:
    """cand_id, pos, gene below n, by hash; with repeats."""
    p = V.cand_ids(s, pop).crossJoin(s.range(budget).select(F.col("id").cast("int").alias("pos")))
    return p.select("cand_id", "pos", F.floor(u("pop", F.col("cand_id"), F.col("pos")) * n).cast("long").alias("gene"))


def nation_fitness(s: SparkSession, d: str) -> DataFrame:
    """cand_id, fitness: customers of each nation."""
    return table(s, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("cand_id")).agg(F.count("*").cast("double").alias("fitness"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return G.node_set(edges)


# A: sources and sinks


def edge_lines(s: SparkSession, d: str) -> DataFrame:
    """Edges as text: three separators, some with more tokens; and comments, blanks, short lines and names."""
    e = copart(s, d, "sparse")
    k = (F.col("src") + F.col("dst")) % 4
    line = F.concat(F.when(k == 3, "  ").otherwise(""), F.col("src").cast("string"), F.when(k == 0, " ").when(k == 1, "\t").when(k == 2, ",").otherwise(" , "), F.col("dst").cast("string"), F.when(k == 3, " 7 x").otherwise(""))
    n = table(s, d, "nation")
    more = n.select(F.explode(F.array(F.concat(F.lit("# "), "n_name"), F.concat(F.lit(" % 1 "), F.col("n_nationkey").cast("string")), F.lit("  "), F.concat(F.lit("lone"), F.col("n_nationkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" 5")))).alias("value"))
    return e.select(line.alias("value")).union(more)


@query
def parse_edge_lines(s, d):
    path = new_path(s, "lines")
    edge_lines(s, d).write.text(path)
    return A.read_edgelist(s, path)


@query
def csv_edges(s, d):
    path = new_path(s, "csv")
    copart(s, d, "sparse").select(F.concat_ws(" ;", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("x")).alias("value")).write.text(path)
    return A.read_csv_edges(s, path)


@query
def parse_adjlist(s, d):
    e = copart(s, d, "sparse")
    lists = G.neighbor_lists(e).select(F.concat_ws(" ", F.col("node").cast("string"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")).alias("value"))
    alone = table(s, d, "nation").select(F.concat((-F.col("n_nationkey") - 1).cast("string"), F.lit(" # alone")).alias("value"))
    return A.parse_adjlist_lines(lists.union(alone))


@query
def parse_gml(s, d):
    path = new_path(s, "gml")
    e = copart(s, d, "sparse")
    n = nodes_of(e).select(F.format_string('  node [\n id %d\n label "p%d"\n value %d\n ]', "node", "node", F.col("node") % 9).alias("value"))
    n.union(e.select(F.format_string("  edge [\n source %d\n target %d\n ]", "src", "dst"))).write.text(path)
    nodes, edges = A.read_gml(s, path)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("value").alias("b"), "label").union(edges.select(F.lit("edge"), "src", "dst", F.lit(None).cast("string")))


@query
def adjacency_to_edges(s, d):
    """Every block of 64 columns of the part graph's matrix that isn't all zero, row by row."""
    a = G.adjacency(whole(s, d))
    held = a.groupBy(F.col("src").alias("idx"), F.expr("(dst div 64) * 64").alias("base")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dst % 64 as int))")).alias("n"))
    rows = held.select("idx", "base", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("n", i).cast("int")).alias("row"))
    return A.adjacency_rows_to_edges(rows)


@query
def csr_to_edges(s, d):
    a = G.adjacency(copart(s, d, "sparse"))
    lists = N.rank_by(a, F.asc("src"), F.asc("dst")).withColumn("pos", F.col("rank") - 1)
    ptr = lists.groupBy(F.col("src").alias("row")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    return A.csr_to_edges(ptr, lists.select("pos", F.col("dst").alias("col"), F.lit(1.0).alias("value")))


@query
def labelled_graph_stats(s, d):
    return A.labelled_graph_stats(whole(s, d), part_features(s, d), part_labels(s, d))


@query
def node_split(s, d):
    return G.random_split(table(s, d, "part").select(F.col("p_partkey").alias("node")), 0.1, 0.1, 7)


def registry(s, d):
    p = table(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("nodes"), F.min("p_type").alias("task"), F.max("p_type").alias("top"))
    return p.select("name", "task", F.when(F.col("nodes") % 2 == 0, F.array("task", F.concat("top", F.lit("+")))).alias("tasks"), "nodes")


@query
def list_datasets(s, d):
    return A.list_datasets(registry(s, d)).select("name", "task", "nodes", F.array_join("tasks", ",").alias("tasks"))


@query
def datasets_for(s, d):
    links = table(s, d, "part").select(F.concat(F.lit("alg"), (F.col("p_size") % 5).cast("string")).alias("algorithm"), F.col("p_brand").alias("name"))
    return A.datasets_for(registry(s, d), links, "alg1").select("name", "nodes")


def reports(s, d):
    """One report per user and hour of their events."""
    e = table(s, d, "events").withColumn("at", F.date_trunc("hour", "ts")).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    g = e.groupBy("user_id", "at").agg(F.min("k").alias("best_fitness"), F.round(F.sum("value") / 1000, 6).alias("iter_seconds"), F.round(F.avg("value"), 6).alias("ms"), F.count("*").alias("n"))
    return g.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("at", "yyyyMMddHH")).alias("run_id"), F.concat(F.lit("alg"), (F.col("user_id") % 5).cast("string")).alias("algorithm_id"), F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("dataset"), F.when(F.col("n") % 2 == 0, "S").otherwise("M").alias("resolved_mode"), (F.col("user_id") % 2 == 0).alias("remote"), "best_fitness", "iter_seconds", F.when(F.col("user_id") % 11 != 0, F.col("ms")).alias("iter_avg_ms"), F.col("at").cast("timestamp").alias("started_at"))


@query
def report_roundtrip(s, d):
    path = new_path(s, "reports")
    rows = reports(s, d).withColumn("day", F.date_format("started_at", "yyyyMMdd"))
    A.append_run_report(rows.where("remote"), path, ["day"])
    A.append_run_report(rows.where("not remote"), path, ["day"])
    back = s.read.parquet(path)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("runs"), F.round(F.sum("iter_seconds"), 6).alias("seconds"))


# B: graph tables


@query
def canonical_edges(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst"))
    return G.canonical_edges(li)


@query
def symmetric_edges(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst"))
    return G.symmetric(li)


@query
def node_index(s, d):
    nodes, edges = G.index_nodes(whole(s, d))
    return nodes.select(F.col("node").alias("a"), F.col("idx").alias("b"), F.lit("node").alias("kind")).union(edges.select("src", "dst", F.lit("edge")))


@query
def graph_stats(s, d):
    return G.graph_stats(whole(s, d), 0.1, 0.25)


@query
def degrees(s, d):
    return G.degrees(copart(s, d, "all"), table(s, d, "part").select(F.col("p_partkey").alias("node")))


@query
def degree_rank(s, d):
    return G.degree_rank(whole(s, d))


@query
def minmax_degree(s, d):
    return G.minmax_degree(whole(s, d)).withColumns(r6("x"))


@query
def neighbor_lists(s, d):
    return G.neighbor_lists(whole(s, d), hub_cap=50).select("node", "degree", "chunk", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query
def gene_pool_nodes(s, d):
    return G.gene_pool_nodes(whole(s, d), table(s, d, "part").select(F.col("p_partkey").alias("node")))


@query
def non_neighbor_sample(s, d):
    e = whole(s, d)
    idx, _ = G.index_nodes(e)
    return G.sample_non_neighbors(idx, e, 2, 11).select("node", "nbr")


@query
def non_edges(s, d):
    e = disc(s, d)
    return G.non_edges(e).agg(F.count("*").alias("scored")).crossJoin(G.count_non_edges(e))


@query
def non_edges_from(s, d):
    """All unlinked pairs of the parts whose number 100 divides."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("node"))
    return G.non_edges_from(whole(s, d), p, p.where("node % 100 = 0"))


@query
def two_hop_pairs(s, d):
    return G.two_hop_pairs(disc(s, d))


@query
def edge_split(s, d):
    return G.edge_train_test_split(whole(s, d), 0.2, 5)


@query
def edge_set_ops(s, d):
    a, b = disc(s, d), sparse(s, d)
    out = None
    for op in ("union", "minus", "intersect"):
        x = G.edge_set_ops(a, b, op).select(F.lit(op).alias("op"), "src", "dst")
        out = x if out is None else out.union(x)
    return out


@query
def greedy_peel(s, d):
    return G.greedy_degree_peel(copart(s, d, "sparse"), 10)


@query
def greedy_peel_batch(s, d):
    e = sparse(s, d)
    return G.batch_peel(e, nodes_of(e).count() * 3 // 4, max(1, nodes_of(e).count() // 12), "max")


@query
def ego_sample(s, d):
    return G.ego_sample(disc(s, d), 6)


@query
def ego_features(s, d):
    return G.ego_features(disc(s, d), 5).select("ego", "i", "j", F.col("value").cast("long").alias("value"))


@query
def random_walks(s, d):
    return G.random_walks(whole(s, d), 4, 3).select("start", "step", "node")


@query
def rwr_subgraph(s, d):
    return G.rwr_subgraph(G.random_walks(whole(s, d), 4, 3), 4).select("start", "node", F.col("pos").cast("int").alias("pos"))


# C: perturbations


@query
def remove_nodes(s, d):
    e = disc(s, d)
    return P.remove_nodes(e, removed(s, nodes_of(e)))


@query
def delete_edges(s, d):
    e = whole(s, d)
    return P.delete_edges(e, materialise(edge_changes(s, e).where("op = 'del'"), "changes"))


@query
def apply_edge_changes(s, d):
    e = disc(s, d)
    return P.apply_edge_changes(e, edge_changes(s, e))


def rewires(s, d, e, pop=3, budget=10, seed=2):
    """From a fixed hash of non-neighbours: the node itself plus an offset, where that is no neighbour."""
    n = nodes_of(e)
    non = n.join(n.select((F.col("node") - 1).alias("node"), F.col("node").alias("nbr")), "node").join(G.adjacency(e).select(F.col("src").alias("node"), F.col("dst").alias("nbr")), ["node", "nbr"], "left_anti")
    return V.init_rewires(G.adjacency(e), non, pop, budget, seed)


@query
def init_rewires(s, d):
    return rewires(s, d, disc(s, d))


@query
def apply_rewires(s, d):
    e = disc(s, d)
    return P.apply_rewires(e, rewires(s, d, e)).groupBy("cand_id").agg(F.count("*").alias("m"), F.sum("src").alias("s"), F.sum("dst").alias("t"))


@query
def inject_node(s, d):
    e = sparse(s, d)
    n = nodes_of(e)
    return P.inject_node(e, n, removed(s, n, 3, 0.02))


@query
def decode_genes(s, d):
    e = disc(s, d)
    idx, _ = G.index_nodes(e)
    return P.decode_genes(population(s, 200), idx)


# D: metrics


def comps(s, d, kind="sparse"):
    return R.components(*perturbed(s, sparse(s, d) if kind == "sparse" else disc(s, d)))


@query
def components(s, d):
    return comps(s, d)


@query
def components_small(s, d):
    return R.components_by_candidate(*perturbed(s, sparse(s, d)))


@query
def pcg(s, d):
    """The minimum slice: n, m, k of the graph, and connected pairs before and after its k nodes of greatest degree go."""
    e = sparse(s, d)
    n = nodes_of(e)
    stats = G.graph_stats(e, 0.1, 0.1)
    top = G.degree_rank(e).crossJoin(F.broadcast(stats)).where("rank <= k")
    gone = materialise(top.select(F.lit(1).alias("cand_id"), "node").union(s.range(1).select(F.lit(0), F.lit(-1).cast("long"))), "removed")
    score = R.pairwise_connectivity(R.components(materialise(P.remove_nodes(e, gone), "cut"), materialise(P.survivors(n, gone), "left")))
    both = score.agg(F.max(F.when(F.col("cand_id") == 0, F.col("pcg"))).alias("pcg_before"), F.max(F.when(F.col("cand_id") == 1, F.col("pcg"))).alias("pcg_after"))
    return stats.select("n", "m", "k").crossJoin(both)


@query
def pcg_candidates(s, d):
    return R.pairwise_connectivity(comps(s, d))


@query
def largest_component(s, d):
    return R.largest_component(comps(s, d))


def _reach(s, d, h):
    return R.reach_within(*perturbed(s, sparse(s, d)), h)


@query
def reach6(s, d):
    return R.max_reach(_reach(s, d, 6))


@query
def reach9(s, d):
    return _reach(s, d, 9)


@query
def reach17(s, d):
    return R.max_reach(_reach(s, d, 17))


@query
def reach_sketch(s, d):
    """Estimates; held against the exact counts in tests."""
    return R.reach_sketch(*perturbed(s, sparse(s, d)), 4)


@query
def robustness(s, d):
    return R.robustness(*perturbed(s, sparse(s, d)))


@query
def robustness_steps(s, d):
    return R.robustness_steps(*perturbed(s, sparse(s, d)), 5).withColumns(r6("robustness"))


@query
def robustness_gain(s, d):
    e = sparse(s, d)
    base = R.robustness(e.select(F.lit(0).alias("cand_id"), "src", "dst"), nodes_of(e).select(F.lit(0).alias("cand_id"), "node"))
    return R.robustness_gain(base, R.robustness(*perturbed(s, e)))


@query
def modularity(s, d):
    return C.modularity(whole(s, d), communities(s, d, "p_brand")).withColumns(r6("q"))


@query
def modularity_candidates(s, d):
    e, _ = perturbed(s, whole(s, d))
    return C.modularity(e, communities(s, d, "p_brand"), ("cand_id",)).withColumns(r6("q"))


def _louvain(edges: DataFrame, of: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Communities of ``edges``, a graph or several that are parts of one (``of``). Beyond PART edges whole components are tasks
    of their own; rounds over tables are taken only where one has more than SMALL edges."""
    m = of.count()
    parts, largest = (None, 0) if m <= PART else parts_of(of, m)
    return louvain_by_graph(edges, 1, keys=keys, parts=parts) if largest <= SMALL else louvain_of(edges, 1, keys=keys)


@query
def louvain(s, d):
    """Single nodes, then communities, in turn to a fixed point."""
    e = disc(s, d)
    return _louvain(e, e)


@query
def louvain_candidates(s, d):
    """Of twenty graphs, each without a tenth of the links, and of the whole one: how many communities, and their modularity."""
    e = disc(s, d)
    every = e.join(V.cand_ids(s, 21))
    left = materialise(every.where((F.col("cand_id") == 0) | (u(5, F.col("cand_id"), F.col("src"), F.col("dst"), "gone") >= 0.1)), "left")
    found = materialise(_louvain(left, e, ("cand_id",)), "communities")
    count = found.groupBy("cand_id").agg(F.countDistinct("comm").alias("n"), F.count("*").alias("nodes"))
    return count.join(C.modularity(left, found, ("cand_id",)), "cand_id").select("cand_id", "n", "nodes", F.round("q", 6).alias("q"))


@query
def label_propagation(s, d):
    return C.label_propagation(whole(s, d), 3)


@query
def nmi(s, d):
    return C.nmi(communities(s, d, "p_brand"), communities(s, d, "p_type")).withColumns(r6("nmi"))


@query
def q_fitness(s, d):
    return C.q_fitness(C.modularity(disc(s, d), communities(s, d, "p_brand"))).withColumns(r6("q", "fitness"))


@query
def walk_matrix(s, d):
    return C.walk_matrix(disc(s, d)).withColumn("value", F.round("value", 9))


@query
def embedding(s, d):
    return C.lowrank_embedding(disc(s, d), rounds=4)


@query
def distance_corr(s, d):
    """The embedding of a changed graph against the base graph's, over all ordered pairs of nodes."""
    e = disc(s, d)
    changed = materialise(P.apply_edge_changes(e, materialise(edge_changes(s, e, 1), "changes")).select("src", "dst"), "changed")
    base, emb = (materialise(C.embedding_by_graph(x, x.count(), rounds=4), "embedding") for x in (e, changed))
    return C.distance_shift_blocks(emb, base).withColumns(r6("shift"))


@query
def resource_allocation(s, d):
    return L.resource_allocation(copart(s, d, "ret")).withColumns(r6("score"))


def link_split(s, d):
    sp = materialise(G.edge_train_test_split(disc(s, d), 0.2, 5), "split")
    return sp.where("split = 'train'").select("src", "dst"), sp.where("split = 'test'").select("src", "dst")


@query
def precision_at_l(s, d):
    train, test = link_split(s, d)
    return L.precision_at_l(materialise(L.resource_allocation(train), "ra"), train, test).withColumns(r6("precision"))


@query
def lp_auc(s, d):
    train, test = link_split(s, d)
    n = nodes_of(train.union(test)).count()
    return L.auc(materialise(L.resource_allocation(train), "ra"), train, test, n).withColumns(r6("auc"))


@query
def lpa_fitness(s, d):
    train, test = link_split(s, d)
    changes = materialise(edge_changes(s, train), "changes")
    return L.lpa_fitness(materialise(P.apply_edge_changes(train, changes), "changed"), train, changes, test, 0.001, nodes_of(train.union(test)).count()).withColumns(r6("fitness"))


@query
def affected_pairs(s, d):
    e = disc(s, d)
    changes = materialise(edge_changes(s, e), "changes")
    return L.affected_pairs(e, L.resource_allocation(e), changes).withColumns(r6("old", "new"))


def classed(s, d):
    lab = part_labels(s, d)
    return whole(s, d), lab, lab.select("node")


def seeded_weights(s, d):
    """feat, class, w by hash, for the features that occur."""
    f = part_features(s, d).select("feat").distinct()
    return f.crossJoin(s.range(5).select(F.col("id").cast("int").alias("class"))).select("feat", "class", (u("w", F.col("feat"), F.col("class")) - 0.5).alias("w"))


@query
def gcn_norm(s, d):
    e, _, n = classed(s, d)
    return N.gcn_normalize(e, n).withColumn("value", F.round("value", 9))


@query
def feature_row_norm(s, d):
    f = part_features(s, d)
    return N.row_normalize_features(f.withColumn("value", F.col("feat") % 3 * 1.0)).withColumns(r6("value"))


@query
def propagate2(s, d):
    e, _, n = classed(s, d)
    return N.propagate_graph(part_features(s, d), e, n, 2, written=True).withColumns(r6("value"))


def logits(s, d):
    """X W first, then two hops: what moves is as wide as the classes."""
    e, lab, n = classed(s, d)
    z = N.linear_logits(part_features(s, d), seeded_weights(s, d)).select("node", F.col("class").alias("feat"), F.col("logit").alias("value"))
    return materialise(N.propagate_graph(z, e, n, 2, width=8, written=True).select("node", F.col("feat").alias("class"), F.col("value").alias("logit")), "logits"), lab


@query
def linear_logits(s, d):
    return N.linear_logits(part_features(s, d), seeded_weights(s, d)).withColumns(r6("logit"))


@query
def gcn_forward(s, d):
    e, _, n = classed(s, d)
    w2 = s.range(25).select(F.expr("cast(id div 5 as int)").alias("feat"), F.expr("cast(id % 5 as int)").alias("class")).withColumn("w", u("w2", F.col("feat"), F.col("class")) - 0.5)
    return N.gcn_forward(part_features(s, d), e, n, [seeded_weights(s, d), w2]).withColumns(r6("logit"))


@query
def predict_class(s, d):
    return N.predict_class(logits(s, d)[0])


@query
def nll_loss(s, d):
    z, lab = logits(s, d)
    return N.nll_loss(z, lab, "test").withColumns(r6("loss"))


@query
def sga_fitness(s, d):
    z, lab = logits(s, d)
    return N.sga_fitness(N.predict_class(z), lab, "test")


@query
def accuracy(s, d):
    z, lab = logits(s, d)
    return N.accuracy(N.predict_class(z), lab, "test").withColumns(r6("accuracy"))


@query
def asr(s, d):
    """Predictions without propagation against those with."""
    z, lab = logits(s, d)
    flat = N.linear_logits(part_features(s, d), seeded_weights(s, d))
    return N.attack_success_rate(N.predict_class(flat), N.predict_class(z), lab, "test").withColumns(r6("asr"))


@query
def sgc_classifier(s, d):
    e, lab, n = classed(s, d)
    x = materialise(N.propagate_graph(part_features(s, d), e, n, 2, written=True), "hops")
    w = N.fit_node_classifier(x, lab, 31, max_iter=20)
    bias = x.select("node").distinct().select("node", F.lit(-1).alias("feat"), F.lit(1.0).alias("value"))
    return N.accuracy(N.predict_class(N.linear_logits(x.select("node", "feat", "value").union(bias), w)), lab, "test").withColumns(r6("accuracy"))


@query
def homophily(s, d):
    e, lab, _ = classed(s, d)
    return N.homophily(e, lab).withColumns(r6("homophily", "decrease", "attached"))


@query
def label_feature_profile(s, d):
    return N.label_feature_profile(part_features(s, d), part_labels(s, d), 10).withColumns(r6("mean"))


@query
def injected_features(s, d):
    f = part_features(s, d)
    return N.injected_node_features(N.label_feature_profile(f, part_labels(s, d)), f, 2)


@query
def degree_budget(s, d):
    e, _, n = classed(s, d)
    return N.degree_budget(e, n)


@query
def potential_edges(s, d):
    e, lab, _ = classed(s, d)
    return N.potential_edges(N.homophily(e, lab), lab, 1).withColumns(r6("decrease"))


@query
def single_link_rank(s, d):
    e, lab, _ = classed(s, d)
    h = N.homophily(e, lab)
    return N.rank_single_links(h.select("node", (F.col("degree") % 4).cast("double").alias("loss")), h, 0.3)


# E: candidates


@query
def init_population(s, d):
    idx, _ = G.index_nodes(disc(s, d))
    return V.init_population(idx, 4, 20, 1)


@query
def draw_population(s, d):
    e = disc(s, d)
    return V.draw_population(s, nodes_of(e).count(), 6, 20, 1)


@query
def init_edge_population(s, d):
    e = disc(s, d)
    return V.init_edge_population(e, G.non_edges(e), 3, 15, 4)


@query
def init_link_population(s, d):
    train, _ = link_split(s, d)
    return V.init_link_population(train, G.non_edges(train), 3, 10, 4)


@query
def roulette_select(s, d):
    f = nation_fitness(s, d)
    a = V.roulette_select(f, "min", 200, 3).withColumn("kind", F.lit("shift"))
    return a.union(V.roulette_select(f, "max", 200, 3, shift=False).withColumn("kind", F.lit("raw")))


@query
def rotary_table(s, d):
    f = nation_fitness(s, d)
    out = [V.rotary_table(f, p).withColumn("pattern", F.lit(p)) for p in ("normal", "inverted", "trans")]
    return out[0].union(out[1]).union(out[2]).withColumns(r6("p", "cumulative"))


def event_population(s, d, shift=0):
    """cand_id, pos, gene: all events of each user, in order."""
    from pyspark.sql import Window as W

    e = table(s, d, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)
    return e.select(F.col("user_id").cast("int").alias("cand_id"), "pos", (F.col("event_id") + shift).alias("gene"))


@query
def crossover(s, d):
    return V.crossover(event_population(s, d), event_population(s, d, 1_000_000), 0.4, 9)


@query
def mutate(s, d):
    return V.mutate(event_population(s, d), 0.3, 777, 9)


@query
def edge_mutation(s, d):
    from pyspark.sql import Window as W

    e = sparse(s, d)
    dels = N.rank_by(e, F.asc("src"), F.asc("dst")).select((F.col("rank") - 1).alias("idx"), "src", "dst")
    adds = N.rank_by(G.non_edges(e).select("src", "dst"), F.asc("src"), F.asc("dst")).select((F.col("rank") - 1).alias("idx"), "src", "dst")
    ch = edge_changes(s, e).withColumn("pos", F.row_number().over(W.partitionBy("cand_id").orderBy("op", "src", "dst")))
    return V.edge_mutation(ch, dels, adds, 0.3, 6)


@query
def rewire_mutation(s, d):
    e = disc(s, d)
    return V.rewire_mutation(materialise(rewires(s, d, e), "rewires"), materialise(rewires(s, d, e, seed=8), "rewires"), 0.5, 6)


@query
def repair_duplicates(s, d):
    pool = table(s, d, "supplier").select((F.col("s_suppkey") % 40).alias("idx")).distinct()
    return V.repair_duplicates(event_population(s, d).withColumn("gene", F.col("gene") % 15), pool, 2)


@query
def de_mutation(s, d):
    x = event_population(s, d).select("cand_id", "pos", (F.col("gene") % 100 / 100).alias("x"))
    y, z = x.withColumn("x", F.col("x") * F.col("x")), x.withColumn("x", 1 - F.col("x"))
    return V.de_mutation(x, y, z, 0.5).withColumns(r6("x"))


@query
def encode_genotype(s, d):
    e = disc(s, d)
    idx, _ = G.index_nodes(e)
    return V.encode_genotype(P.decode_genes(population(s, 200), idx), G.minmax_degree(e)).withColumns(r6("x"))


@query
def decode_phenotype(s, d):
    x = event_population(s, d).select("cand_id", "pos", (F.col("gene") % 100 / 100).alias("x"))
    return V.decode_phenotype(x, G.minmax_degree(sparse(s, d)))


@query
def eda_resample(s, d):
    p = event_population(s, d).withColumn("gene", F.col("gene") % 50)
    f = p.groupBy("cand_id").agg((F.sum("gene") % 97).cast("double").alias("fitness"))
    return V.eda_resample(p, f, 5, 8, 4)


@query
def elitism(s, d):
    old = nation_fitness(s, d)
    new = table(s, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("cand_id")).agg((F.count("*") * 14).cast("double").alias("fitness"))
    return V.elitism(old, new, "min", 20)


@query
def sga_elitism(s, d):
    e, lab, _ = classed(s, d)
    h = N.homophily(e, lab)
    p = population(s, 200, 12, 5)
    f = p.groupBy("cand_id").agg(F.floor(F.sum("gene") / 200).cast("double").alias("fitness"))
    genes = p.select(F.lit(0).alias("origin"), "cand_id", F.col("gene").alias("node"))
    return V.sga_elitism(f.where("cand_id < 6"), f.where("cand_id >= 6"), "min", 8, genes.union(genes.withColumn("origin", F.lit(1))), h)


@query
def resolve_conflicts(s, d):
    pool = table(s, d, "supplier").select((F.col("s_suppkey") % 12).alias("idx")).distinct()
    return V.resolve_conflicts(event_population(s, d).withColumn("gene", F.col("gene") % 4), pool, 2)


@query
def gene_pool_cutoff(s, d):
    e = disc(s, d)
    idx, _ = G.index_nodes(e)
    return V.gene_pool_cutoff(P.decode_genes(population(s, 60), idx), G.degree_rank(e), 50)


@query
def random_cutoff(s, d):
    return V.random_cutoff(nodes_of(whole(s, d)), 40, 3)


@query
def reach_cutoff(s, d):
    e = sparse(s, d)
    n = nodes_of(e)
    r = R.reach_within(e.select(F.lit(0).alias("cand_id"), "src", "dst"), n.select(F.lit(0).alias("cand_id"), "node"), 9)
    return V.reach_cutoff(r, G.degree_rank(e), 40)


@query
def community_edge_pools(s, d):
    inside, between = C.community_edge_pools(disc(s, d), communities(s, d, "p_brand"), 3)
    return inside.select(F.lit("inside").alias("kind"), "src", "dst").union(between.select(F.lit("between"), "src", "dst"))


# G: histories and reports


@query
def running_best(s, d):
    return H.running_best(run_events(s, d)).select("run_id", "generation", "fitness", "best")


@query
def best_metrics(s, d):
    return H.best_generation(run_events(s, d)).withColumns(r6("iter_ms"))


@query
def curves(s, d):
    c = H.convergence_curves(run_events(s, d))
    return c.select("run_id", F.array_join(F.transform("fitness", lambda x: x.cast("string")), ",").alias("fitness"), F.size("iter_ms").cast("long").alias("n"))


@query
def run_summary(s, d):
    return H.run_summary(run_events(s, d)).withColumns(r6("seconds", "avg_ms", "throughput"))


@query
def load_run_reports(s, d):
    rows = reports(s, d)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    bad = rows.select(F.explode(F.array(F.lit("not json"), F.lit("[1, 2"), F.to_json(F.struct("run_id", "dataset")))).alias("value"))
    return H.load_run_reports(lines.union(bad)).drop("started_at")


@query
def run_trends(s, d):
    return H.run_trends(reports(s, d), 5).withColumns(r6("mean_ms", "mean_fitness"))


@query
def benchmark_compare(s, d):
    return H.benchmark_compare(reports(s, d)).withColumns(r6("ratio", "best_iter_avg_ms", "best_iter_seconds"))


@query
def trends_with_regressions(s, d):
    """Reports joined to their benchmark rows by run, then trends."""
    rows = reports(s, d)
    return H.run_trends(rows.join(H.benchmark_compare(rows).select("run_id", "regressed"), "run_id"), 0).select("key", "runs", "regressions")


def histories(s, d, parity: int | None = None):
    """A row an id; old (parity 0) and new rows (1), or all."""
    e = table(s, d, "events")
    e = e if parity is None else e.where(F.col("event_id") % 2 == parity)
    return e.groupBy((F.col("user_id") * 10 + F.length("event_type")).alias("id")).agg(F.max("event_id").alias("created_at"), F.max_by("value", "event_id").alias("best_score"))


@query
def upsert_history(s, d):
    return H.upsert_history(histories(s, d, 0), histories(s, d, 1))


@query
def page_history(s, d):
    return H.page_history(histories(s, d), 20, 40)


@query
def delete_history(s, d):
    return H.delete_history(histories(s, d, 0), histories(s, d, 1).where("id % 3 = 0"))


@query
def latest_state(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 5).alias("algorithm"), F.col("event_type").alias("dataset"), F.col("event_id").alias("task_id"), F.floor(F.col("value")).cast("long").alias("updated_at"))
    return H.latest_state(e)


@query
def resource_rows(s, d):
    gpu = F.struct(F.col("event_id").alias("gid"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double")).alias("util"))
    e = table(s, d, "events").groupBy(F.col("user_id").alias("server")).agg(F.round(F.avg("value"), 4).alias("cpu"), F.max("value").alias("memory"), F.array_sort(F.collect_list(gpu)).alias("gpus"))
    return H.resource_rows(e).withColumns(r6("gpu_util"))


def op_calls(s, d):
    return call_log(s, d).select(F.col("worker").alias("rank"), F.when(F.col("failed"), "reduce").otherwise("gather").alias("op"), F.col("compute_ms").alias("ms"))


@query
def comm_stats(s, d):
    return H.comm_stats(op_calls(s, d)).withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6)})


@query
def comm_overall(s, d):
    return H.comm_overall(op_calls(s, d)).withColumns(r6("avg"))


@query
def iteration_stats(s, d):
    return H.iteration_stats(call_log(s, d)).withColumns({"compute": F.round("compute", 4), "overhead": F.round("overhead", 4)})


@query
def overhead_guard(s, d):
    return H.overhead_guard(H.iteration_stats(call_log(s, d)), 5, 1.0).withColumns(r6("ratio"))


@query
def stragglers(s, d):
    return H.stragglers(call_log(s, d), 1.5, 50.0).withColumns({"total": F.round("total", 4), "median": F.round("median", 4)})


@query
def recovery_percentiles(s, d):
    return H.recovery_percentiles(call_log(s, d).where("failed"), "worker", "overhead_ms")


@query
def transport_rates(s, d):
    return H.transport_rates(call_log(s, d)).withColumns(r6("failure_rate", "retries_per_call", "mean_recovery"))


@query
def worker_stats(s, d):
    return H.worker_stats(call_log(s, d)).withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6), "share": F.round("share", 6)})


@query
def export_report(s, d):
    return H.export_report(run_events(s, d)).withColumns(r6("seconds", "avg_ms"))


# H: streams


def observer_files(s, d):
    path = new_path(s, "observer")
    rows = run_events(s, d)
    lines = rows.select(F.to_json(F.struct("run_id", "generation", F.lit(99).alias("max_generation"), F.create_map(F.lit("fitness"), F.col("fitness").cast("double")).alias("metrics"))).alias("value"))
    lines.union(rows.where("generation = 1").select(F.lit("{broken"))).repartition(4).write.text(path)
    return path


@query
def stream_observer(s, d):
    rows = S.stream_observer(s, observer_files(s, d)).select("run_id", "generation", "fitness")
    return S.run_to_end(rows, new_path(s, "cp"), new_path(s, "out"))


@query
def stream_running_best(s, d):
    return S.run_to_end(S.stream_running_best(S.stream_observer(s, observer_files(s, d))), new_path(s, "cp"), new_path(s, "out"), "complete")


@query
def stream_resource_windows(s, d):
    path = new_path(s, "points")
    points = table(s, d, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("server"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cpu"), (F.col("value") / 2).alias("memory"), F.get_json_object("props", "$.k").cast("double").alias("gpu"))
    points.write.parquet(path)
    w = S.resource_windows(s.readStream.schema(points.schema).parquet(path), "6 hours")
    out = S.run_to_end(w, new_path(s, "cp"), new_path(s, "out"), "complete")
    return out.select(F.date_format("start", "yyyyMMddHH").alias("start"), "server", "n", *(F.round(c, 6).alias(c) for c in ("cpu", "memory", "gpu")))


@query
def stream_upsert(s, d):
    path, out = new_path(s, "history"), new_path(s, "out")
    e = table(s, d, "events").select((F.col("user_id") * 10 + F.length("event_type")).alias("id"), F.col("event_id").alias("created_at"), F.col("value").alias("best_score"))
    e.repartition(6).write.parquet(path)
    S.stream_upsert_history(s.readStream.schema(e.schema).option("maxFilesPerTrigger", 3).parquet(path), out, new_path(s, "cp")).awaitTermination()
    return S.read_history(s, out, e.schema)


# F: the search itself, and the named jobs. Each query runs a few generations and reports the history of the run.


@query
def evolve_cnd(s, d):
    """Two generations from a start, then resumed for two more: the run's whole history."""
    e = sparse(s, d)
    problem = J.cutoff_problem(s, e, pop=8)
    first = J.evolve(problem, 2, seed=1)
    return J.evolve(problem, 2, seed=1, resume=first).history


@query
def restarts(s, d):
    """Three searches for nodes to remove, side by side: all histories."""
    return J.restarts(J.cutoff_problem(s, sparse(s, d), pop=8), 1, 3, seed=5)[0]


@query
def custom_problem(s, d):
    """A user's own fitness: the sum of degrees, by a pandas function over each candidate's nodes."""
    e = sparse(s, d)
    deg = G.degrees(e)

    def fitness(pdf):
        return float(pdf["degree"].sum())

    p = J.Problem("degree-sum", "max", N.rank_by(deg, F.desc("degree"), F.asc("node")).select((F.col("rank") - 1).alias("idx"), "node", "degree"), 10, 8, J.fitness_from_pandas(fitness))
    return J.evolve(p, 3, seed=4).history


def _job(name, **more):
    def run(s, d):
        return J.JOBS[name](s, d, **more).history

    run.__name__ = f"job_{name}"
    return query(run)


#: What a search has beside its two generations: the small searches for a pool, and the nodes to inject.
MORE = {"cutoff": {"pool_runs": 2, "pool_generations": 2}, "gani": {"injected": 2}}
for _name in J.JOBS:
    _job(_name, generations=2, **MORE.get(_name, {}))
