"""What the findings of round 4 named, each against a plain version."""

import re

import numpy as np
import pytest

from cutweave.jobs import queries as Q
from cutweave.operators import community as C, graph as G, louvain as L, nodeclass as N, perturb as P, reach as R
from cutweave.operators.components import star_components


def test_blocks_of_distances_are_packed_once_and_add_up_to_all_pairs(spark, tiny, monkeypatch):
    """More candidates than go together, nodes that a candidate lacks, places far from 0 beside their distances, and a table
    of a row a block, however many pairs of blocks there are."""
    r, n, cands = np.random.default_rng(4), 90, C.TOGETHER + 2
    base = 1e4 + r.normal(size=(n, 3))
    moved = {c: base + r.normal(size=(n, 3)) for c in range(cands)}
    gone = {c: set(r.choice(n, c % 3, replace=False).tolist()) for c in moved}
    b = spark.createDataFrame([(i * 7, base[i].tolist()) for i in range(n)], "node long, vec array<double>")
    e = spark.createDataFrame([(c, i * 7, x[i].tolist()) for c, x in moved.items() for i in range(n) if i not in gone[c]], "cand_id int, node long, vec array<double>")
    written, write = {}, C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, what="table": written.setdefault(what, write(df, what)))
    counted, sums = [], C.scoped
    monkeypatch.setattr(C, "scoped", lambda build, what="table": sums(lambda: (build(), counted.append(written["blocks"].count()))[0], what))
    got = {x["cand_id"]: x["shift"] for x in C.distance_shift_blocks(e, b, 10, ("cand_id",)).collect()}
    assert counted == [9 * 2] and got.keys() == moved.keys()
    far = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).ravel()
    for c, x in moved.items():
        x[list(gone[c])] = 0.0
        assert got[c] == pytest.approx(1 - abs(np.corrcoef(far(x), far(base))[0, 1]), abs=1e-9)


def test_an_embedding_in_one_task_has_the_distances_of_the_tables(spark, tiny):
    """Two graphs, with a loop, an end of degree one and a component of its own."""
    r = np.random.default_rng(5)
    pairs = {(c, *sorted((int(a), int(b)))) for c in (0, 3) for a, b in r.integers(0, 14, (30, 2)) if a != b} | {(3, 50, 51), (0, 2, 40), (0, 5, 5)}
    e = spark.createDataFrame(sorted(pairs), "cand_id int, src long, dst long")
    for graphs, keys in ((e, ("cand_id",)), (e.where("cand_id = 0").drop("cand_id"), ())):
        places = [{(*(x[k] for k in keys), x["node"]): x["vec"] for x in t.collect()} for t in (C.embedding_by_graph(graphs, 40, 3, 2, 9, keys), C.lowrank_embedding(graphs, 3, 2, 9, keys))]
        assert places[0].keys() == places[1].keys()
        at = sorted(places[0])
        one, two = (np.array([p[x] for x in at]) for p in places)
        far = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert np.allclose(far(one), far(two), atol=1e-9)


def test_the_query_louvain_takes_components_as_tasks(spark, tiny, sf, monkeypatch):
    """Where the graph has more than SMALL edges and no component has: without the rounds, to the same communities."""
    e = Q.materialise(Q.copart(spark, sf, "sparse"), "graph")
    monkeypatch.setattr(Q, "disc", lambda s, d: e)
    whole = sorted(map(tuple, L.louvain_by_graph(e, 1).collect()))
    monkeypatch.setattr(Q, "louvain_of", None)
    monkeypatch.setattr(Q, "SMALL", e.count() - 1)
    for name in ("PART", "SMALL"):
        monkeypatch.setattr(L, name, 10)
    monkeypatch.setattr(Q, "PART", 10, raising=False)
    assert sorted(map(tuple, Q.QUERIES["louvain"](spark, sf).collect())) == whole


def test_components_of_one_task_are_those_of_star_rounds(spark, tiny):
    pairs = [(1, 2), (2, 9), (4, 4), (5, 8), (11, 12), (8, 12), (20, 30)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(map(tuple, L._components_at_once(e).collect())) == sorted(map(tuple, star_components(e).collect()))


def test_of_equal_gains_the_first_is_taken():
    group, gain = np.array([0, 0, 0, 3, 3, 7]), np.array([1.0, 2.0, 2.0, -1.0, -3.0, 0.0])
    assert L._greatest(group, gain).tolist() == [1, 3, 5] and not len(L._greatest(group[:0], gain[:0]))


def test_a_hop_keeps_arms_dealt_by_range(spark, tiny, monkeypatch):
    """Both sides of the join stay as they are dealt; by range and id, a node's arms meet in as many tasks as there are."""
    plans, write = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, what="table": (plans.append(df._jdf.queryExecution().executedPlan().toString()) if what == "hop" else None, write(df, what))[1])
    monkeypatch.setattr(N, "SPAN", 4)
    edges = spark.range(40).selectExpr("id as src", "(id * 7 + 3) % 40 as dst").where("src < dst")
    nodes = spark.range(40).withColumnRenamed("id", "node")
    x = nodes.selectExpr("node", "cast(node % 3 as int) as feat", "1.0D as value")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    got = {(r["node"], r["feat"]): r["value"] for r in N.propagate_graph(x, edges, nodes, 2, written=True).collect()}
    want = {(r["node"], r["feat"]): r["value"] for r in N.propagate(x, N.gcn_normalize(edges, nodes), 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(plans) == 2 and all(re.search(r"hashpartitioning\(_span#\d+L?, \d", p) and not re.search(r"hashpartitioning\(_span#\d+L?, col", p) for p in plans)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_ranges_are_as_long_as_leaves_two_for_each_task():
    assert [N.span_of(n, 8) for n in (0, 100_000, 160_000, 10_000_000)] == [N.SPAN, 6250, 10_000, N.LONGEST]


def test_graphs_come_packed_to_the_tasks_that_score_candidates(spark, tiny):
    """As by tables of every candidate's graph; a node that isn't there, and a candidate that leaves none. A row was an edge."""
    edges = spark.range(30).selectExpr("id as src", "(id * 7 + 3) % 30 as dst").where("src <> dst")
    every = [r["node"] for r in G.node_set(edges).collect()]
    gone = spark.createDataFrame([(0, 3), (0, 99), (1, 5), (1, 6), *((2, n) for n in every)], "cand_id int, node long")
    scored = R.scores_without(edges, gone, True, 3)
    canonical, nodes = G.canonical_edges(edges), G.node_set(edges)
    cut, left = P.remove_nodes(canonical, gone).cache(), P.survivors(nodes, gone).cache()
    pcg = {r["cand_id"]: r["pcg"] for r in R.pairwise_connectivity(R.components(cut, left)).collect()}
    reach = {r["cand_id"]: r["max_reach"] for r in R.max_reach(R.reach_within(cut, left, 3)).collect()}
    assert {r["cand_id"]: (r["pcg"], r["max_reach"]) for r in scored.collect()} == {c: (pcg[c], reach[c]) for c in pcg} and set(pcg) == {0, 1}
    assert "packed#" in scored._jdf.queryExecution().optimizedPlan().toString()
