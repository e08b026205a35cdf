"""Queries take all rows of their tables: each test fails where a cap, a filter or a sample comes back."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cutweave.jobs.queries import QUERIES
from cutweave.operators import evolve as V
from cutweave.oracles.sql import SQL
from tests.test_oracles import duck, plain  # noqa: F401


def rows(df):
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()), key=repr)


# populations: every event of every user is a gene


@pytest.mark.parametrize("name", ["crossover", "mutate", "repair_duplicates", "de_mutation", "eda_resample", "resolve_conflicts"])
def test_population_is_whole(spark, sf, duck, name):  # noqa: F811
    got = QUERIES[name](spark, sf)
    if name != "eda_resample":
        assert got.count() == duck.execute("select count(*) from events").fetchone()[0]
    assert rows(got) == sql_rows(duck, SQL[name])


def test_decode_phenotype_takes_every_event(spark, sf):
    got = QUERIES["decode_phenotype"](spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert got.count() == events.count()
    assert got.select("cand_id").distinct().count() == events.select("user_id").distinct().count()


def test_decode_phenotype_starts_again_when_all_nodes_are_used(spark):
    mm = spark.createDataFrame([(10, 0.0), (11, 1.0)], "node long, x double")
    g = spark.createDataFrame([(0, i, 0.9) for i in range(5)], "cand_id int, pos int, x double")
    assert [r["node"] for r in V.decode_phenotype(g, mm).orderBy("pos").collect()] == [11, 10, 11, 10, 11]


# distances of embeddings: all ordered pairs, of the changed graph against the base


def test_distance_shift_blocks_is_distance_shift_of_all_pairs(spark):
    import random

    from cutweave.operators import community as C

    r = random.Random(3)
    base = spark.createDataFrame([(i, [r.random() for _ in range(6)]) for i in range(90)], "node long, vec array<double>")
    emb = spark.createDataFrame([(i, [r.random() for _ in range(6)]) for i in range(90) if i != 40], "node long, vec array<double>")
    full = emb.union(spark.createDataFrame([(40, [0.0] * 6)], "node long, vec array<double>"))
    want = C.distance_shift(C.pairwise_distance(full), C.pairwise_distance(base)).first()[0]
    for block in (7, 1000):
        assert C.distance_shift_blocks(emb, base, block).first()[0] == pytest.approx(want, abs=1e-9)
    assert C.distance_shift_blocks(base, base, 20).first()[0] == pytest.approx(0, abs=1e-9)


def test_distance_corr_compares_the_graphs_embeddings(spark, sf, monkeypatch):
    from cutweave.operators import community as C

    taken = []
    monkeypatch.setattr(C, "distance_shift_blocks", lambda emb, base, f=C.distance_shift_blocks: taken.extend([emb, base]) or f(emb, base))
    got = QUERIES["distance_corr"](spark, sf).first()[0]
    emb, base = taken
    from cutweave.sources.fixtures import copart

    e = copart(spark, sf, "disc")
    assert base.count() == e.select("src").union(e.select("dst")).distinct().count()  # no node is left out
    assert 0 < got < 1
    want = C.distance_shift(C.pairwise_distance(base.select("node").join(emb, "node", "left").select("node", F.coalesce("vec", F.array(*[F.lit(0.0)] * 6)).alias("vec"))), C.pairwise_distance(base)).first()[0]
    assert got == pytest.approx(want, abs=2e-6)


# every entry of the matrix, every neighbour of a hub


def test_adjacency_to_edges_has_every_entry(spark, sf, duck):  # noqa: F811
    got = QUERIES["adjacency_to_edges"](spark, sf)
    assert rows(got) == sql_rows(duck, SQL["adjacency_to_edges"])
    assert got.where("src div 64 <> dst div 64").count() > 0


def test_neighbor_lists_name_every_neighbour(spark, sf):
    from cutweave.operators.graph import adjacency
    from cutweave.sources.fixtures import copart

    lists = {}
    for r in QUERIES["neighbor_lists"](spark, sf).orderBy("node", "chunk").collect():
        lists.setdefault((r["node"], r["degree"]), []).extend(int(x) for x in r["nbrs"].split(","))
    want = {}
    for r in adjacency(copart(spark, sf, "all")).collect():
        want.setdefault(r["src"], []).append(r["dst"])
    assert lists == {(n, len(x)): sorted(x) for n, x in want.items()}
    assert max(d for _, d in lists) > 50


def test_neighbor_lists_of_a_star(spark):
    from cutweave.operators.graph import neighbor_lists

    star = spark.range(1, 1001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    hub = [r["nbrs"] for r in neighbor_lists(star, 50).where("node = 0").orderBy("chunk").collect()]
    assert sum(hub, []) == list(range(1, 1001)) and len(hub) == 20 and max(map(len, hub)) == 50


# jobs: the whole pool of additions, and distances of all pairs


def test_pairs_are_drawn_from_all_that_are_not_linked(spark):
    """Every unlinked pair of a ring with chords, at any distance, comes once to a candidate that wants all."""
    from cutweave.operators import graph as G

    ring = [(i, j) for i in range(12) for j in (i + 1, i + 2) if j < 12]
    e = spark.createDataFrame(ring, "src long, dst long")
    idx = G.dense_rank_ids(G.node_set(e), "node")
    got = [tuple(r) for r in G.draw_pairs(idx, e, 2, 100, 7).collect()]
    want = {(i, j) for i in range(12) for j in range(i + 1, 12)} - set(ring)
    for c in (0, 1):
        own = [r[2:] for r in got if r[0] == c]
        assert len(own) == len(set(own)) and set(own) == want
    few = [tuple(r) for r in G.draw_pairs(idx, e, 2, 5, 7).collect()]
    assert sorted(few) == sorted(r for r in got if r[1] < 5)  # the first of the same order
    odd = G.draw_pairs(idx, e, 1, 3, 7, lambda t: t.where("(src + dst) % 2 = 1")).collect()
    assert len(odd) == 3 and all((r["src"] + r["dst"]) % 2 for r in odd)
    assert G.draw_pairs(idx, e, 1, 3, 7, lambda t: t.where("false")).count() == 0


def test_pair_numbers(spark):
    from cutweave.operators.graph import unranked

    got = spark.range(45).select(*(c.alias(n) for c, n in zip(unranked(F.col("id")), "ij"))).collect()
    assert [tuple(r) for r in got] == [(i, j) for j in range(10) for i in range(j)]
    n = 3_000_000_000
    k = n * (n - 1) // 2
    big = spark.createDataFrame([(k - 1,), (k,), (k + n - 1,), (k + n,)], "id long").select(*(c.alias(x) for c, x in zip(unranked(F.col("id")), "ij")))
    assert [tuple(r) for r in big.collect()] == [(n - 2, n - 1), (0, n), (n - 1, n), (0, n + 1)]


def test_permutations(spark):
    from cutweave.functions.rand import permuted

    for n in (1, 2, 7, 100):
        rows = spark.range(3 * n).select((F.col("id") % 3).alias("c"), permuted(F.floor(F.col("id") / 3), n, 5, F.col("id") % 3, "t").alias("x")).collect()
        assert all(sorted(r["x"] for r in rows if r["c"] == c) == list(range(n)) for c in range(3))
    assert len({tuple(r["x"] for r in rows if r["c"] == c) for c in range(3)}) == 3


def test_draws_list_no_pool(spark):
    """Ten million genes in seconds: plans of first populations, repairs and conflicts read no pool."""
    import time

    pool = spark.range(10_000_000).select(F.col("id").alias("idx"))
    began = time.time()
    p = V.init_population(pool, 20, 50, 1)
    bad = p.withColumn("gene", F.when(F.col("pos") % 5 == 0, F.lit(3)).otherwise(F.col("gene")))
    fixed = V.repair_duplicates(bad, pool, 1)
    assert fixed.groupBy("cand_id").agg(F.countDistinct("gene").alias("n"), F.count("*").alias("k")).where("n = 50 and k = 50").count() == 20
    same = V.resolve_conflicts(bad.withColumn("gene", F.col("pos").cast("long")), pool, 1)
    assert same.groupBy("cand_id").agg(F.array_sort(F.collect_list("gene")).alias("s")).select("s").distinct().count() == 20
    assert time.time() - began < 60
    for df in (p, fixed, same):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (0, 10000000" not in plan and "Cross" not in plan


def test_cda_eda_scores_all_pairs(spark):
    """Two nodes' distances move on the smallest graphs too, where 5 in 100 of the pairs were none."""
    from cutweave.jobs import evolution as J
    from cutweave.operators import community as C

    seen, whole = [], C.distance_shift_blocks

    def spy(emb, base, **k):  # what a fitness writes is gone once it is scored
        seen.append((emb.collect(), base, whole(emb, base, **k).collect()))
        return whole(emb, base, **k)

    C.distance_shift_blocks = spy
    try:
        run = J.cda_eda(spark, spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 3)], "src long, dst long"), 1, pop=3)
    finally:
        C.distance_shift_blocks = whole
    rows, base, shifts = seen[0]
    assert base.count() == 5
    at = {(r["cand_id"], r["node"]): r["vec"] for r in rows}
    zero = [0.0] * 6
    for cand, shift in shifts:
        mine = spark.createDataFrame([(i, at.get((cand, i), zero)) for i in range(5)], "node long, vec array<double>")
        assert shift == pytest.approx(C.distance_shift(C.pairwise_distance(mine), C.pairwise_distance(base)).first()[0], abs=1e-9)
    assert max(r["fitness"] for r in run.fitness.collect()) > 0


def test_decode_phenotype_keeps_the_node_table_off_the_driver(spark, monkeypatch):
    """30 candidates' rows against 20000 nodes of 4 values: the result of looking at all nodes, without collecting them."""
    import numpy as np

    mm = spark.range(20000).select("id", (F.col("id") * 7919 % 4 / 3).alias("x")).withColumnRenamed("id", "node")
    g = spark.range(90).select((F.col("id") % 3).cast("int").alias("cand_id"), F.floor(F.col("id") / 3).cast("int").alias("pos"), (F.col("id") * 37 % 100 / 100).alias("x"))
    xs = np.array([i * 7919 % 4 / 3 for i in range(20000)])
    want = {}
    for c in range(3):
        free = np.ones(20000, bool)
        for r in sorted((r for r in g.collect() if r["cand_id"] == c), key=lambda r: r["pos"]):
            d = np.where(free, np.abs(xs - r["x"]), np.inf)
            i = min(np.flatnonzero(d <= d.min() + 1e-12).tolist(), key=lambda k: (xs[k], k))
            free[i], want[c, r["pos"]] = False, i
    taken = []
    frame = type(mm)
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): [taken.append(out := f(self)), out][1])
    got = V.decode_phenotype(g, mm)
    assert sum(len(out) for out in taken) < 100  # values and ranges, no nodes
    assert {(r["cand_id"], r["pos"]): r["node"] for r in got.collect()} == want
