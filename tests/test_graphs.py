"""Closed-form graphs, invariants, skew and odd inputs."""

import math

import pytest
from pyspark.sql import functions as F

from cutweave.jobs import evolution as J
from cutweave.operators import community as C, evolve as V, graph as G, linkpred as L, nodeclass as N, perturb as P, reach as R, reports as H
from cutweave.operators.components import star_components
from cutweave.operators.louvain import louvain
from cutweave.sources import readers as A


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long") if pairs else spark.createDataFrame([], "src long, dst long")


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def clique(n, at=0):
    return [(at + i, at + j) for i in range(n) for j in range(i + 1, n)]


BARBELL = clique(5) + clique(5, 5) + [(4, 5)]


def one(df, *cols):
    r = df.first()
    return tuple(r[c] for c in cols)


def cand(df):
    return df.withColumn("cand_id", F.lit(0))


def scored(spark, pairs, extra=()):
    e = edges(spark, pairs)
    n = G.node_set(e, spark.createDataFrame([(x,) for x in extra], "node long") if extra else None)
    return cand(e), cand(n)


def test_components_of_hand_graphs(spark):
    for pairs, extra, sizes in ((path(6), (), [6]), (clique(4) + path(3), (99,), None), (BARBELL, (50, 51), [1, 1, 10]), ([(7, 7)], (), [1]), ([(0, i) for i in range(1, 400)], (), [400])):
        c = R.components(*scored(spark, pairs, extra))
        got = sorted(r["size"] for r in R.component_sizes(c).collect())
        assert sizes is None or got == sizes
        small = R.components_by_candidate(*scored(spark, pairs, extra))
        assert sorted(map(tuple, c.select("node", "comp").collect())) == sorted(map(tuple, small.select("node", "comp").collect()))
    assert star_components(edges(spark, [])).count() == 0
    with pytest.raises(ValueError):
        R.components_by_candidate(*scored(spark, path(6)), max_edges=3)


def test_hub(spark):
    """A star of 50,000 leaves: components and ranks stay cheap."""
    e = spark.range(1, 50_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert one(R.pairwise_connectivity(R.components(cand(e), cand(G.node_set(e)))), "pcg") == (50_001 * 50_000 // 2,)
    top = G.degree_rank(e).where("rank = 1").first()
    assert (top["node"], top["degree"]) == (0, 50_000)


def test_pcg_and_reach(spark):
    e, n = scored(spark, BARBELL)
    assert one(R.pairwise_connectivity(R.components(e, n)), "pcg") == (45,)
    gone = spark.createDataFrame([(0, 4), (0, 12345)], "cand_id int, node long")
    cut, left = P.remove_nodes(edges(spark, BARBELL), gone), P.survivors(G.node_set(edges(spark, BARBELL)), gone)
    assert one(R.pairwise_connectivity(R.components(cut, left)), "pcg") == (6 + 10,)
    r = {x["node"]: x["reach"] for x in R.reach_within(*scored(spark, path(6)), 2).collect()}
    assert r == {0: 3, 1: 4, 2: 5, 3: 5, 4: 4, 5: 3}
    est = {x["node"]: x["reach"] for x in R.reach_sketch(*scored(spark, path(6)), 2).collect()}
    assert est == r
    every = P.remove_nodes(edges(spark, path(3)), spark.createDataFrame([(0, i) for i in range(3)], "cand_id int, node long"))
    assert every.count() == 0


def brute_robustness(pairs):
    nodes = {x for p in pairs for x in p}
    n, total = len(nodes), 0
    live = set(nodes)
    for _ in range(n - 1):
        deg = {k: sum((a == k or b == k) and a in live and b in live for a, b in pairs) for k in live}
        live.remove(max(live, key=lambda k: (deg[k], -k)))
        best, seen = 0, set()
        for k in live:
            if k not in seen:
                todo, comp = [k], {k}
                while todo:
                    x = todo.pop()
                    for a, b in pairs:
                        for s, d in ((a, b), (b, a)):
                            if s == x and d in live and d not in comp:
                                comp.add(d)
                                todo.append(d)
                seen |= comp
                best = max(best, len(comp))
        total += best / n
    return total / (n - 1)


def test_robustness(spark):
    for pairs in (path(7), BARBELL, [(0, i) for i in range(1, 6)], clique(4)):
        assert one(R.robustness(*scored(spark, pairs)), "robustness")[0] == pytest.approx(brute_robustness(pairs), abs=1e-8)
    with pytest.raises(ValueError):
        R.robustness(*scored(spark, path(6)), max_edges=2)


def test_peel(spark):
    order = [r["node"] for r in G.greedy_degree_peel(edges(spark, path(4)), 1).orderBy("step").collect()]
    assert order == [0, 1, 2]
    assert [r["node"] for r in G.greedy_degree_peel(edges(spark, BARBELL), 9, "max").collect()] == [4]
    batch = {r["node"] for r in G.batch_peel(edges(spark, BARBELL), 8, 2, "max").collect()}
    assert batch == {4, 5}


def test_modularity_louvain(spark):
    e = edges(spark, BARBELL)
    comm = spark.createDataFrame([(i, i // 5) for i in range(10)], "node long, comm long")
    q = one(C.modularity(e, comm), "q")[0]
    assert q == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2))
    lv = louvain(e)
    assert one(C.modularity(e, lv), "q")[0] >= one(C.modularity(e, C.label_propagation(e, 4)), "q")[0] - 1e-9
    assert one(C.modularity(e, lv), "q")[0] > 0.3 and lv.count() == 10
    assert louvain(edges(spark, [])).count() == 0
    assert one(C.nmi(comm, comm), "nmi")[0] == pytest.approx(1.0)
    lone = spark.createDataFrame([(1, 1), (2, 1)], "node long, comm long")
    assert one(C.nmi(lone, lone), "nmi") == (1.0,)


def test_embedding_keeps_distances(spark):
    """All of the walk matrix's rank: distances equal those of U sqrt(S) from numpy."""
    import numpy as np

    pairs = path(5) + [(0, 2)]
    rows = C.lowrank_embedding(edges(spark, pairs), rank=2, rounds=30).orderBy("node").collect()
    a = np.zeros((5, 5))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    p = a / (a.sum(1, keepdims=True) + 1)
    u, s, _ = np.linalg.svd((p + p @ p) / 2)
    want = u[:, :2] * np.sqrt(s[:2])
    got = np.array([r["vec"] for r in rows])
    d = lambda x: np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(d(got), d(want), atol=1e-3)


def test_incremental_equals_full(spark):
    e = edges(spark, BARBELL + path(8))
    e = G.canonical_edges(e)
    ch = spark.createDataFrame([(0, "del", 4, 5), (0, "add", 0, 9), (1, "add", 2, 7), (1, "del", 2, 7)], "cand_id int, op string, src long, dst long")
    after = P.apply_edge_changes(e, ch)
    base = L.resource_allocation(e)
    moved = L.affected_pairs(e, base, ch)
    full = {tuple(r)[:3]: r["score"] for r in L.resource_allocation(after, keys=("cand_id",)).select("cand_id", "src", "dst", "score").collect()}
    old = {(r["src"], r["dst"]): r["score"] for r in base.collect()}
    new = {(c, *k): v for c in (0, 1) for k, v in old.items()}
    for r in moved.collect():
        new[(r["cand_id"], r["src"], r["dst"])] = r["new"]
    for k in set(full) | set(new):
        assert full.get(k, 0) == pytest.approx(new.get(k, 0), abs=1e-9)


def test_edges_of_inputs(spark):
    e = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 1), (4, None)], "src long, dst long")
    assert sorted(map(tuple, G.canonical_edges(e).collect())) == [(1, 2), (3, 3)]
    assert sorted(map(tuple, G.canonical_edges(e, keep_loops=False).collect())) == [(1, 2)]
    assert G.degrees(edges(spark, [(3, 3)])).first()["degree"] == 2
    assert G.index_nodes(edges(spark, []))[0].count() == 0
    lines = spark.createDataFrame([("",), (None,), ("# 1 2",), ("1",), ("1,2 , 3",), (" a\tb",)], "value string")
    assert sorted((r["src"], r["dst"], r["src_id"]) for r in A.parse_edge_lines(lines).collect()) == [("1", "2", 1), ("a", "b", None)]
    assert H.load_run_reports(lines).count() == 0
    split = G.edge_train_test_split(edges(spark, path(11)), 0.2, 1)
    assert split.where("split = 'test'").count() == 2
    parted = G.edge_train_test_split(edges(spark, path(11)).repartition(7), 0.2, 1)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, parted.collect()))


def test_population_invariants(spark):
    pool = spark.range(30).select(F.col("id").alias("idx"))
    p = V.init_population(pool, 3, 10, 1)
    assert p.groupBy("cand_id").agg(F.countDistinct("gene").alias("n")).where("n <> 10").count() == 0
    rep = V.repair_duplicates(p.withColumn("gene", F.col("gene") % 4), pool, 1)
    assert rep.count() == 30 and rep.groupBy("cand_id").agg(F.countDistinct("gene").alias("n")).where("n <> 10").count() == 0
    short = V.repair_duplicates(p.withColumn("gene", F.lit(1).cast("long")), pool.where("idx < 3"), 1)
    assert short.count() == 30  # a pool too small leaves repeats
    flat = spark.createDataFrame([(i, 5.0) for i in range(4)], "cand_id int, fitness double")
    drawn = V.roulette_select(flat, "min", 400, 2)
    assert drawn.count() == 400 and drawn.select("cand_id").distinct().count() == 4
    assert V.rotary_table(flat).agg(F.max("cumulative")).first()[0] == pytest.approx(1.0)


def test_decode_phenotype(spark):
    mm = spark.createDataFrame([(10, 0.0), (11, 0.5), (12, 0.5), (13, 1.0)], "node long, x double")
    g = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.5)], "cand_id int, pos int, x double")
    assert [r["node"] for r in V.decode_phenotype(g, mm).orderBy("pos").collect()] == [11, 12, 10, 13]


def test_evolution_is_monotone_and_resumes(spark):
    e = edges(spark, BARBELL + [(9, 20), (20, 21), (21, 22)])
    deg = G.degrees(e)
    pool = N.rank_by(deg, F.desc("degree"), F.asc("node")).select((F.col("rank") - 1).alias("idx"), "node", "degree")
    p = J.Problem("degree", "max", pool, 3, 5, J.fitness_from_pandas(lambda pdf: pdf["degree"].sum()))
    run = J.evolve(p, 3, seed=1)
    best = [r["best_fitness"] for r in run.history.orderBy("generation").collect()]
    assert best == sorted(best) and len(best) == 4
    again = J.evolve(p, 1, seed=1, resume=J.evolve(p, 2, seed=1))
    assert sorted(map(tuple, again.history.collect())) == sorted(map(tuple, run.history.collect()))


def test_nll_of_known_logits(spark):
    z = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 0.0)], "node long, class int, logit double")
    lab = spark.createDataFrame([(1, 1, "test"), (2, 0, "test"), (3, 0, "train")], "node long, label int, split string")
    assert one(N.nll_loss(z, lab, "test"), "loss")[0] == pytest.approx((math.log(2) + math.log(1 + math.e) - 1) / 2)
    assert one(N.accuracy(N.predict_class(z), lab, "test"), "accuracy") == (0.5,)


def test_reach_by_bits_is_reach_by_pairs(spark):
    """More than 64 nodes, several candidates, nodes alone and gone; plain breadth-first counts."""
    import random

    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(0, 900, 3), 2))) for _ in range(330)})
    gone = {0: set(), 1: set(r.sample(range(0, 900, 3), 60))}
    nodes = spark.createDataFrame([(c, n) for c in gone for n in range(0, 900, 3) if n not in gone[c]], "cand_id int, node long")
    e = spark.createDataFrame([(c, a, b) for c in gone for a, b in pairs if a not in gone[c] and b not in gone[c]], "cand_id int, src long, dst long")
    for hops in (1, 3, 20):
        got = {(x["cand_id"], x["node"]): x["reach"] for x in R.reach_within(e, nodes, hops).collect()}
        for c in gone:
            near = {}
            for a, b in pairs:
                if a not in gone[c] and b not in gone[c]:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
            for n in range(0, 900, 3):
                if n in gone[c]:
                    assert (c, n) not in got
                    continue
                seen = edge = {n}
                for _ in range(hops):
                    edge = set().union(*(near.get(x, set()) for x in edge)) - seen
                    seen = seen | edge
                assert got[c, n] == len(seen)


def test_robustness_in_steps(spark):
    """A step a node is the exact form where degrees don't tie on the way; coarse steps come near it; ties by id in ranges."""
    for pairs in ([(0, i) for i in range(1, 9)] + [(1, i) for i in range(9, 14)] + [(2, 14)], BARBELL + path(8), clique(7) + [(0, i) for i in range(7, 20)]):
        e, n = scored(spark, pairs)
        k = n.count()
        want = one(R.robustness(e, n), "robustness")[0]
        assert one(R.robustness_steps(e, n, k), "robustness")[0] == pytest.approx(want, abs=0.02)
        assert one(R.robustness_steps(e, n, 5), "robustness")[0] == pytest.approx(want, abs=0.2)
    d = spark.range(10_000).select(F.lit(0).alias("cand_id"), (F.col("id") * 977).alias("node"), F.when(F.col("id") % 100 == 7, 5).otherwise(1).alias("degree"))
    want = spark.createDataFrame([(0, 1234)], "cand_id int, want long")
    got = {r["node"] for r in R._worst(d, want).collect()}
    rows = sorted(((r["degree"], r["node"]) for r in d.collect()), key=lambda x: (-x[0], x[1]))
    assert got == {n for _, n in rows[:1234]}


def test_benchmarks_compare_like_with_like(spark):
    """Milliseconds with milliseconds, seconds where one side lacks them; both bests are kept."""
    rows = [("a", None, 2.0), ("b", 500.0, 1.0), ("c", 400.0, None), ("d", 600.0, 9.0), ("e", None, 1.5), ("f", None, None), ("g", 399.0, 0.0), ("h", None, 3.0)]
    r = spark.createDataFrame([(i, "x", "y", "S", False, ms, s, t) for t, (i, ms, s) in enumerate(rows)], "run_id string, algorithm_id string, dataset string, resolved_mode string, remote boolean, iter_avg_ms double, iter_seconds double, started_at long")
    got = {x["run_id"]: (x["unit"], x["ratio"], x["regressed"], x["best_iter_avg_ms"], x["best_iter_seconds"]) for x in H.benchmark_compare(r).collect()}
    assert got["a"] == (None, None, False, None, 2.0)
    assert got["b"] == ("s", -0.5, False, 500.0, 1.0)
    assert got["c"] == ("ms", -0.2, False, 400.0, 1.0)
    assert got["d"] == ("ms", 0.5, True, 400.0, 1.0)
    assert got["e"] == ("s", 0.5, True, 400.0, 1.0)
    assert got["f"] == (None, None, False, 400.0, 1.0)
    assert got["g"][:2] == ("ms", -0.0025) and got["g"][4] == 0.0
    assert got["h"] == (None, None, False, 399.0, 0.0)  # a best of 0 compares with nothing
