"""What the findings of round 3 named, each against a plain version."""

import random

import numpy as np
from pyspark.sql import Window, functions as F

from cutweave.functions.rand import permuted
from cutweave.jobs import evolution as J, queries as Q
from cutweave.operators import community as C, evolve as V, graph as G, nodeclass as N, perturb as P, reach as R
from cutweave.sources import fixtures


def _graph(spark, n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return spark.createDataFrame(sorted(pairs), "src long, dst long"), pairs


def test_two_hops_by_node_factors_are_those_of_the_listed_matrix(spark):
    """Ids in several ranges, an isolated node, entries that are absent, and more features than stand side by side."""
    edges, _ = _graph(spark, 60, 150, 3)
    edges = edges.selectExpr("src * 1000 as src", "dst * 1000 as dst").union(spark.createDataFrame([(5000, 5000)], "src long, dst long"))
    nodes = spark.range(61).selectExpr("id * 1000 as node")
    x = nodes.selectExpr("node", "cast(node div 1000 % 11 as int) as feat", "1.0D + node as value").union(nodes.selectExpr("node", "40", "0.5D"))
    listed = N.propagate(x, N.gcn_normalize(edges, nodes), 2, width=4).collect()
    want = {(r["node"], r["feat"]): r["value"] for r in listed}
    a = {}
    for r in N.gcn_normalize(edges, nodes).collect():
        a.setdefault(r["row"], []).append((r["col"], r["value"]))
    plain = {(r["node"], r["feat"]): r["value"] for r in x.collect()}
    for _ in range(2):
        new = {}
        for row, arms in a.items():
            for col, v in arms:
                for f in (*range(11), 40):
                    if (col, f) in plain:
                        new[row, f] = new.get((row, f), 0.0) + v * plain[col, f]
        plain = new
    got = N.propagate_graph(x, edges, nodes, 2, width=4)
    assert dict(got.dtypes) == {"node": "bigint", "feat": "int", "value": "double"}
    got = {(r["node"], r["feat"]): r["value"] for r in got.collect()}
    assert set(got) == set(want) == set(plain)
    assert all(abs(got[k] - plain[k]) < 1e-9 * abs(plain[k]) and abs(want[k] - plain[k]) < 1e-9 * abs(plain[k]) for k in plain)


def test_two_hops_shuffle_the_arms_once(spark):
    edges, _ = _graph(spark, 60, 150, 3)
    got = N.propagate_graph(spark.range(60).selectExpr("id as node", "1 as feat", "1.0D as value"), edges, spark.range(60).selectExpr("id as node"), 2)
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_listed_non_edges_are_not_shuffled(spark):
    """Of nodes against queries, some of which are no nodes: each pair once; and no exchange above the rows of pairs."""
    edges, linked = _graph(spark, 40, 90, 1)
    nodes, queries = spark.range(40).selectExpr("id as node"), spark.range(0, 60, 7).selectExpr("id as node")
    want = {tuple(sorted((a, q))) for a in range(40) for q in range(0, 60, 7) if a != q} - linked
    for block in (2, 4096):
        got = G.non_edges_from(edges, nodes, queries, block)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate explode")]


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.find("== Initial Plan")].count(" Exchange ")


def test_both_directions_of_edges_take_one_shuffle(spark):
    rows = [(1, 2), (2, 1), (2, 1), (3, 3), (3, 3), (5, 4), (None, 1), (7, None)]
    got = G.symmetric(spark.createDataFrame(rows, "src long, dst long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 1), (3, 3), (4, 5), (5, 4)]
    assert _exchanges(got) == 1


def test_an_edge_meets_its_deletions_once(spark):
    """Deletions in either direction, of unknown edges, and repeated; an edge that repeats stays as often."""
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3)], "src long, dst long")
    dels = spark.createDataFrame([(0, 2, 1), (0, 2, 1), (1, 1, 3), (1, 8, 9), (2, 8, 9)], "cand_id int, src long, dst long")
    got = P.delete_edges(edges, dels)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 3), (0, 2, 3), (1, 1, 2), (1, 1, 2), (1, 2, 3), (2, 1, 2), (2, 1, 2), (2, 1, 3), (2, 2, 3)]
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()  # which met every edge once a candidate


def _balls(left, linked, hops):
    out = {}
    for s in left:
        seen = near = {s}
        for _ in range(hops):
            near = {y for a, b in linked for x, y in ((a, b), (b, a)) if x in near} - seen
            seen = seen | near
        out[s] = seen
    return out


def test_candidates_are_scored_in_blocks_without_their_graphs(spark, tiny):
    """Ids that are unknown, repeated or all of the graph's nodes; against plain counts, and the forms for big graphs."""
    edges, linked = _graph(spark, 60, 70, 5)
    ends = {x for p in linked for x in p}
    r = random.Random(2)
    gone = {c: set(r.sample(sorted(ends), 6)) | {1000 + c} for c in range(40)} | {40: set(ends)}
    removed = spark.createDataFrame([(c, n) for c, ns in gone.items() for n in ns] + [(0, 1000)], "cand_id int, node long").repartition(3)
    want = {}
    for c, ns in gone.items():
        left, held = ends - ns, {p for p in linked if not set(p) & ns}
        if left:
            all_of, six = (_balls(left, held, h) for h in (60, 3))
            want[c] = (sum(len(b) - 1 for b in all_of.values()) // 2, max(len(b) for b in six.values()))
    got = R.scores_without(edges.repartition(3), removed, hops=3, lost=True).collect()
    assert {x["cand_id"]: (x["pcg"], x["max_reach"]) for x in got} == want
    cut, left = P.remove_nodes(edges, removed), P.survivors(G.node_set(edges), removed)
    assert {x["cand_id"]: x["robustness"] for x in got} == {x["cand_id"]: x["robustness"] for x in R.robustness(cut, left).collect()}


def test_robustness_on_arrays_takes_nodes_as_one_by_one(monkeypatch):
    """Ties by id, on paths whose every node waits for the one before, and where rounds run out."""
    def plain(n, pairs):
        left, order = set(range(n)), []
        while left:
            degree = {v: sum(v in p and set(p) <= left for p in pairs) for v in left}
            order.append(min(left, key=lambda v: (-degree[v], v)))
            left.discard(order[-1])
        return order

    r = random.Random(4)
    for takes in (1, 64):
        monkeypatch.setattr(R, "TAKES", takes)
        for n in (1, 2, 9, 30):
            for pairs in ({(i, i + 1) for i in range(n - 1)}, {tuple(sorted(r.sample(range(n), 2))) for _ in range(n)} if n > 1 else set()):
                a, b = (np.array([p[i] for p in sorted(pairs)], int) for i in (0, 1))
                assert np.argsort(R._removals(n, a, b)).tolist() == plain(n, pairs)


def test_no_candidate_of_cutoff_or_sixdst_is_written_as_a_graph(spark, tiny, monkeypatch):
    edges, _ = _graph(spark, 30, 40, 6)
    monkeypatch.setattr(J, "_cut", None)  # which wrote edges and nodes of every candidate
    assert len(J.sixdst(spark, edges, 0, pop=3, rate=0.2, pool_runs=2).log) == 1
    assert J.fitness_of(J.cutoff_problem(spark, edges), spark.createDataFrame([(0, 0, 1)], "cand_id int, pos int, node long")) > 0


def test_permutations_are_keyed_once_a_candidate(spark, tiny):
    """Genes as by a plain swap-or-not; what the key alone decides is made below the rows of places."""
    import hashlib

    def u(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0

    def plain(x, n, *parts):
        for r in range(16):
            y = (int(u(*parts, r, "k") * n) - x) % n
            x = y if u(*parts, r, max(x, y)) < 0.5 else x
        return x

    pool = spark.range(11).selectExpr("id as idx")
    for runs, seeds in (((), (5,)), ((5, 9), (5, 9))):
        got = V.init_population(pool, 3, 13, 5, runs)
        want = {(s, c, p): plain(p % 11, 11, s, c, "init") for s in seeds for c in range(3) for p in range(13)}
        assert {(x["run"] if runs else 5, x["cand_id"], x["pos"]): x["gene"] for x in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("aggregate(") < plan.index("Generate explode") < plan.index("transform(")


def test_unused_genes_are_dealt_out_before_they_are_looked_at(spark, tiny, monkeypatch):
    """One candidate's places go to several tasks; a repair is the same however many places a row stands for."""
    pop = spark.createDataFrame([(0, p, p % 7) for p in range(40)] + [(1, p, p) for p in range(40)], "cand_id int, pos int, gene long")
    pool, got = spark.range(50).selectExpr("id as idx"), []
    for stride in (1024, 4):
        monkeypatch.setattr(V, "STRIDE", stride)
        got.append(sorted(tuple(x) for x in V.repair_duplicates(pop, pool, 3).collect()))
    assert got[0] == got[1] and all(len({g for c, _, g in got[0] if c == cand}) == 40 for cand in (0, 1))
    free = V._unused(spark.createDataFrame([(0, 40)], "cand_id int, k long"), pop.limit(0), 50, 3)
    assert free.select(F.spark_partition_id()).distinct().count() > 1


def test_the_query_louvain_takes_a_small_graph_in_one_task(spark, tiny, sf, monkeypatch):
    """The rounds, some hundred small Spark jobs, are for graphs beyond SMALL; both find the same (test_communities)."""
    monkeypatch.setattr(Q, "louvain_of", None)
    assert Q.QUERIES["louvain"](spark, sf).count() > 0


def test_a_rescored_node_is_one_row(spark, tiny):
    """Classes stand side by side (a row a class before), and what a row says is what its classes' rows say; one has no class 1."""
    edges, _ = _graph(spark, 12, 14, 3)
    nodes = spark.range(13).withColumnRenamed("id", "node")
    x = spark.createDataFrame([(n, c, float(n - 2 * c)) for n in range(13) for c in (0, 2)], "node long, feat int, value double")
    base = N.propagated(edges, nodes, x)
    changes = edges.limit(2).selectExpr("0 as cand_id", "'del' as op", "src", "dst").union(spark.createDataFrame([(1, "add", 12, 3)], "cand_id int, op string, src long, dst long"))
    rows = N.rescored_rows(base, changes).collect()
    assert base.width == 3 and len(rows) == len({(r["cand_id"], r["node"]) for r in rows}) > 4
    kept = {c: P.apply_edge_changes(edges, changes).where(f"cand_id = {c}").select("src", "dst") for c in (0, 1)}
    for c, e in kept.items():
        want = {(r["node"], r["feat"]): r["value"] for r in N.propagate_graph(x, e, nodes, 2).collect()}
        for r in rows:
            if r["cand_id"] == c:
                assert r["_f1"] is None and all(abs(r[f"_f{k}"] - want[r["node"], k]) < 1e-9 for k in (0, 2))


def test_changed_graphs_are_scored_in_tasks_that_hold_one_at_a_time(spark, tiny, monkeypatch):
    """As by tables of every candidate's graph and communities, which are no longer made; deleted and added at once, too."""
    edges, pairs = _graph(spark, 30, 50, 8)
    base = J.louvain_by_graph(edges, 7)
    nodes = G.node_set(edges)
    gone = sorted(pairs)[::4]
    rows = [(c, "del", *p) for c in range(3) for p in gone[c::2]] + [(0, "add", *gone[0]), (1, "add", 29, 0), (2, "add", 3, 17), (2, "add", 17, 3)]
    changes = spark.createDataFrame([r for r in rows if {r[2], r[3]} <= {n for p in pairs for n in p}], "cand_id int, op string, src long, dst long")
    e = P.apply_edge_changes(edges, changes).cache()
    now = J.communities_after(e, changes, nodes, base, 7, J.louvain_by_graph).cache()
    want = {r["cand_id"]: (r["q"], r["nmi"]) for r in J._q_of(e, now).join(J._nmi_of(now, base), "cand_id").collect()}
    monkeypatch.setattr(P, "apply_edge_changes", None)  # which wrote every candidate's graph
    got = {r["cand_id"]: (r["q"], r["nmi"]) for r in J._scores_after(edges, nodes, base, 7)(changes).collect()}
    assert set(got) == set(want) == {0, 1, 2} and all(np.allclose(got[c], want[c], atol=1e-9) for c in got)


def test_parts_of_a_graph_have_the_communities_of_the_whole(spark, tiny, monkeypatch):
    """Components go to tasks of their own (a graph was one task before), and move as they do beside the others."""
    from cutweave.operators import louvain as L

    r = random.Random(4)
    pairs = {(c * 20 + min(a, b), c * 20 + max(a, b)) for c in range(4) for a, b in (r.sample(range(16), 2) for _ in range(28))}
    table = spark.createDataFrame([(g, *p) for g in range(2) for p in sorted(pairs) if r.random() < 0.9], "g int, src long, dst long")
    monkeypatch.setattr(L, "PART", 20)
    parts, largest = L.parts_of(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    assert parts.select("part").distinct().count() > 1 and largest < len(pairs)
    want = sorted(map(tuple, L.louvain_by_graph(table, 5, keys=("g",)).collect()))
    assert sorted(map(tuple, L.louvain_by_graph(table, 5, keys=("g",), parts=parts).collect())) == want


def test_resampling_ranks_the_keys_below_a_cut_alone(spark, monkeypatch):
    """all genes of all candidates went through the window; now those near the budget, to the same result."""
    pop = spark.range(6).selectExpr("cast(id as int) as cand_id", "explode(sequence(0, 399)) as pos").withColumn("gene", F.expr("(cand_id * 97 + pos * (cand_id % 2 * 6 + 1)) % 1500"))
    fit = spark.range(6).selectExpr("cast(id as int) as cand_id", "cast(id % 4 as double) as fitness")
    sel = V.roulette_select(fit, "max", 18, 7)
    counts = sel.join(pop, "cand_id").groupBy("gene").agg(F.count("*").alias("w")).crossJoin(spark.range(6).selectExpr("cast(id as int) as cand_id"))
    key = -F.log(1 - V.u(7, F.col("cand_id"), F.col("gene"), "eda")) / F.col("w")
    plain = counts.withColumn("pos", F.row_number().over(Window.partitionBy("cand_id").orderBy(key, "gene")) - 1).where("pos < 40").select("cand_id", "pos", "gene")
    want = sorted(map(tuple, plain.collect()))
    sizes, write = [], V.materialise
    monkeypatch.setattr(V, "materialise", lambda df, what="table": sizes.append((what, write(df, what))) or sizes[-1][1])
    for spare in (8, -2):  # the second leaves candidates short, so that all keys are ranked
        monkeypatch.setattr(V, "SPARE", spare)
        assert sorted(map(tuple, V.eda_resample(pop, fit, 6, 40, 7).collect())) == want
    rows = {n: t.count() for n, t in sizes[:2]}
    assert 240 <= rows["near"] < rows["counts"] * 6 / 3
    assert V._cut_at([(1, 10), (2, 5)], 15) == float("inf")


def test_a_mutation_draws_about_as_many_fresh_genes_as_it_needs(spark, monkeypatch):
    """2 k genes of either kind were drawn for each candidate, for some tenth of k places."""
    edges = spark.range(400).selectExpr("id as src", "id + 1 + id % 7 as dst")
    asked, draw = [], G.draw_pairs
    monkeypatch.setattr(G, "draw_pairs", lambda nodes, e, pop, each, *more: asked.append(each) or draw(nodes, e, pop, each, *more))
    run = J.lpa_eda(spark, edges, 1, pop=4, rate=0.5)
    k = run.problem.budget // 2
    assert asked[0] == k and max(asked[1:]) < k / 2
    left = run.population.groupBy("cand_id").agg(F.count("*").alias("n"), F.countDistinct("gene").alias("d")).collect()
    assert all(r["n"] == r["d"] == 2 * k for r in left)


def test_places_of_a_permutation_are_written_before_they_are_joined(spark):
    """filters of joins made each number a dozen times, and the rows were broadcast as if as few as candidates."""
    keys = spark.range(3).selectExpr("cast(id as int) as cand_id")
    got = G.numbered_places(keys, 5, 2500, 9000, 11, F.col("cand_id"), "pair")
    assert "lambdafunction" not in got._jdf.queryExecution().toString()
    assert got.count() == 3 * 2495 and got.groupBy("cand_id").agg(F.countDistinct("number").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).where("n = 2495 and a = 5 and b = 2499").count() == 3
    assert got.where(permuted(F.col("k"), 9000, 11, F.col("cand_id"), "pair") != F.col("number")).count() == 0
    assert G.numbered_places(keys, 5, 5, 9000, 11, F.col("cand_id"), "pair").count() == 0


def test_label_propagation_deals_its_arms_to_more_tasks_as_they_grow(spark, monkeypatch):
    """a task's arms grew with the graph, as the count of shuffle partitions stays as it is."""
    edges, _ = _graph(spark, 200, 900, 8)
    want = sorted(map(tuple, C.label_propagation(edges, 3).collect()))
    dealt, parts = C.dealt, []
    monkeypatch.setattr(C, "ARMS", 40)
    monkeypatch.setattr(C, "dealt", lambda df, n, *c: parts.append(dealt(df, n, *c).rdd.getNumPartitions()) or dealt(df, n, *c))
    assert sorted(map(tuple, C.label_propagation(edges, 3).collect())) == want
    assert len(parts) == 6 and min(parts) >= 40


def test_links_of_parts_are_dealt_by_their_orders(spark, sf, monkeypatch):
    """so did the links that a task makes."""
    want = sorted(map(tuple, fixtures.copart(spark, sf, "sparse").collect()))
    monkeypatch.setattr(fixtures, "LINES", 300)
    got = fixtures.copart(spark, sf, "sparse")
    assert got.rdd.getNumPartitions() > 15 and sorted(map(tuple, got.collect())) == want


def test_a_job_broadcasts_small_tables_alone_and_leaves_the_session_as_it_was(spark, monkeypatch):
    """every join of a written table under 10 MB went through the driver, several times that in memory."""
    name, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(name)
    monkeypatch.setattr(J, "until", lambda *a, **k: seen.append(spark.conf.get(name)))
    edges, _ = _graph(spark, 30, 60, 4)
    J.tde(spark, edges, 0, pop=2)
    J.lpa_ga(spark, edges, 0, pop=2)
    assert seen == ["1m", "1m"] and spark.conf.get(name) == before
    monkeypatch.setattr(J, "until", None)
    try:
        J.tde(spark, edges, 0, pop=2)
    except TypeError:
        pass
    assert spark.conf.get(name) == before
