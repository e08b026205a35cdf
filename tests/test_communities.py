"""Louvain: known optima, plain fixed points, graphs found together as alone, nodes without edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cutweave.operators import community as C, graph as G
from cutweave.operators.louvain import louvain, louvain_by_graph

pytestmark = pytest.mark.usefixtures("tiny")

# Zachary's karate club, whose greatest modularity is 0.4198.
KARATE = [
    (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 1), (6, 1), (7, 1), (7, 5), (7, 6), (8, 1), (8, 2), (8, 3), (8, 4), (9, 1), (9, 3), (10, 3), (11, 1), (11, 5),
    (11, 6), (12, 1), (13, 1), (13, 4), (14, 1), (14, 2), (14, 3), (14, 4), (17, 6), (17, 7), (18, 1), (18, 2), (20, 1), (20, 2), (22, 1), (22, 2), (26, 24), (26, 25),
    (28, 3), (28, 24), (28, 25), (29, 3), (30, 24), (30, 27), (31, 2), (31, 9), (32, 1), (32, 25), (32, 26), (32, 29), (33, 3), (33, 9), (33, 15), (33, 16), (33, 19),
    (33, 21), (33, 23), (33, 24), (33, 30), (33, 31), (33, 32), (34, 9), (34, 10), (34, 14), (34, 15), (34, 16), (34, 19), (34, 20), (34, 21), (34, 23), (34, 24),
    (34, 27), (34, 28), (34, 29), (34, 30), (34, 31), (34, 32), (34, 33),
]


def frame(spark, pairs):
    return G.canonical_edges(spark.createDataFrame(pairs, "src long, dst long"), keep_loops=False)


def planted():
    """Twelve groups of ten, as in a season's schedule: most games within a group, some without."""
    r = random.Random(12)
    inside = [(a, b) for g in range(12) for a, b in itertools.combinations(range(10 * g, 10 * g + 10), 2) if r.random() < 0.8]
    return inside + [tuple(sorted(r.sample(range(120), 2))) for _ in range(200)]


def plain_q(pairs, comm):
    m, d = len(pairs), {}
    for p in pairs:
        for n in p:
            d[comm[n]] = d.get(comm[n], 0) + 1
    return sum(comm[a] == comm[b] for a, b in pairs) / m - sum((k / (2 * m)) ** 2 for k in d.values())


def test_quality(spark):
    e = frame(spark, KARATE)
    assert C.modularity(e, louvain(e, seed=1)).first()[0] >= 0.41
    pairs = sorted({tuple(sorted(p)) for p in planted() if p[0] != p[1]})
    e = frame(spark, pairs)
    got = {r["node"]: r["comm"] for r in louvain(e, seed=1).collect()}
    assert plain_q(pairs, got) >= plain_q(pairs, {n: n // 10 for n in range(120)}) - 1e-9


@pytest.fixture(scope="module")
def many(spark):
    """Three graphs in one table, and each one's edges; the second is the first with edges gone and a node alone."""
    pairs = sorted({tuple(sorted(p)) for p in KARATE})
    graphs = [pairs, [p for i, p in enumerate(pairs) if i % 9 and 12 not in p] + [(5, 27)], [(a, b) for a, b in itertools.combinations(range(6), 2)]]
    return graphs, spark.createDataFrame([(g, *p) for g, x in enumerate(graphs) for p in x], "g int, src long, dst long")


def test_graphs_found_together_are_as_alone(spark, many):
    graphs, table = many
    start = spark.createDataFrame([(n, 1 if n < 15 else 15) for n in range(35)], "node long, comm long")
    nodes = spark.createDataFrame([(g, n) for g in range(3) for n in range(36)], "g int, node long")
    got = {}
    for r in louvain(table, 3, start, ("g",), nodes).collect():
        got.setdefault(r["g"], {})[r["node"]] = r["comm"]
    for g, pairs in enumerate(graphs):
        alone = {r["node"]: r["comm"] for r in louvain(frame(spark, pairs), 3, start, nodes=nodes.where(F.col("g") == g).select("node")).collect()}
        assert got[g] == alone and set(alone) == set(range(36))  # nodes without edges, too
        linked = {n for p in pairs for n in p}
        assert all(alone[n] == n for n in set(range(36)) - linked) and all(alone[n] in linked for n in linked)
        assert all(min(m for m in alone if alone[m] == c) == c for c in alone.values())
        q = plain_q(pairs, alone)
        around = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in linked}
        for n in linked:  # no single node gains by a move, and no two communities by a merge
            assert all(plain_q(pairs, alone | {n: alone[x]}) <= q + 1e-9 for x in around[n])
        for a, b in {(alone[a], alone[b]) for a, b in pairs}:
            assert plain_q(pairs, {n: a if c == b else c for n, c in alone.items()}) <= q + 1e-9


def test_starts_at_what_changed(spark, many):
    """From communities that are at a fixed point, only what is near a change moves."""
    _, table = many
    e = table.where("g = 0").select("src", "dst")
    base = louvain(e, 1)
    changed = e.where("not (src = 1 and dst = 2)").withColumn("cand_id", F.lit(0))
    ends = spark.createDataFrame([(0, 1), (0, 2)], "cand_id int, node long")
    now = louvain(changed, 1, base, ("cand_id",), None, ends)
    assert C.modularity(changed, now, ("cand_id",)).first()["q"] >= C.modularity(changed.drop("cand_id"), base).first()["q"] - 1e-9
    same = louvain(e.withColumn("cand_id", F.lit(0)), 1, base, ("cand_id",), None, ends.limit(0))
    assert sorted(map(tuple, same.select("node", "comm").collect())) == sorted(map(tuple, base.collect()))


def table_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_graph_a_task_finds_the_same(spark, many):
    """The third graph has no active nodes, and is looked at nevertheless, beside graphs that move."""
    _, table = many
    start = spark.createDataFrame([(n, n % 4) for n in range(0, 35, 2)], "node long, comm long")
    nodes = spark.createDataFrame([(g, n) for g in range(4) for n in range(36)], "g int, node long")
    few = spark.createDataFrame([(0, 1), (0, 2), (1, 34), (1, 12)], "g int, node long")
    for began, every, active in [(None, None, None), (start, nodes, few)]:
        assert table_of(louvain_by_graph(table, 5, began, ("g",), every, active)) == table_of(louvain(table, 5, began, ("g",), every, active))


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    loops = spark.createDataFrame([(3, 3), (4, 4)], "src long, dst long")
    one = spark.createDataFrame([(7, 9)], "src long, dst long")
    for find in (louvain, louvain_by_graph):
        assert find(none).count() == 0
        assert table_of(find(loops)) == [(3, 3), (4, 4)]
        assert table_of(find(one)) == [(7, 7), (9, 7)]
