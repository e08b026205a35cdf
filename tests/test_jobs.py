"""Each named job on a small graph: its candidates' fitness against a plain version, its history, and runs cut and resumed."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.jobs import evolution as J
from cutweave.operators import community as C, evolve as V, graph as G, linkpred as L, nodeclass as N, perturb as P
from cutweave.operators.louvain import louvain

pytestmark = pytest.mark.usefixtures("tiny")

#: Two cliques of five and a tail, by a bridge.
PAIRS = sorted({(i, j) for a in (0, 5) for i, j in itertools.combinations(range(a, a + 5), 2)} | {(4, 5), (9, 10), (10, 11), (11, 12)})
NODES = range(13)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(PAIRS, "src long, dst long").cache()


def genes(run):
    out = {}
    for r in J.decode(run.population, run.problem.pool).collect():
        out.setdefault(r["cand_id"], []).append(r.asDict())
    return out


def fitness(run):
    return {r["cand_id"]: r["fitness"] for r in run.fitness.collect()}


def checked(run, generations, side):
    best = [r[2] for r in run.log]
    assert [r[1] for r in run.log] == list(range(generations + 1)) and all(r[3] for r in run.log)
    assert best == sorted(best, reverse=side == "min")
    fit = fitness(run)
    assert sorted(fit) == list(range(run.problem.pop)) and best[-1] == (min if side == "min" else max)(fit.values())
    return fit, genes(run)


def near(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def reach(pairs, nodes, hops):
    """The nodes within so many hops of each node, itself included."""
    adj, out = near(pairs), {}
    for n in nodes:
        seen = edge = {n}
        for _ in range(hops):
            edge = set().union(*(adj.get(x, set()) for x in edge)) - seen if edge else edge
            seen = seen | edge
        out[n] = seen
    return out


def without(gone):
    return [p for p in PAIRS if not set(p) & gone], [n for n in NODES if n not in gone]


def plain_pcg(gone):
    return sum(len(s) - 1 for s in reach(*without(gone), 13).values()) / 2


def test_cutoff(spark, edges):
    run = J.cutoff(spark, edges, 1, pop=4, pool_runs=2, pool_generations=1)
    fit, rows = checked(run, 1, "min")
    assert run.problem.select == "rotary" and all(fit[c] == plain_pcg({g["node"] for g in rows[c]}) and len({g["node"] for g in rows[c]}) == run.problem.budget for c in rows)


def test_sixdst(spark, edges):
    run = J.sixdst(spark, edges, 1, pop=4, rate=0.2, pool_runs=2)
    fit, rows = checked(run, 1, "min")
    for c, f in fit.items():
        got = reach(*without({g["node"] for g in rows[c]}), 6).values()
        assert f in (max(map(len, got)), max(map(len, got)) - 1)  # counted with or without the node itself
    assert len({max(map(len, reach(*without({g["node"] for g in rows[c]}), 6).values())) - f for c, f in fit.items()}) == 1


def test_tde(spark, edges):
    run = J.tde(spark, edges, 1, pop=4, rate=0.2)
    fit, rows = checked(run, 1, "max")
    assert all(len({g["node"] for g in rows[c]}) == run.problem.budget for c in rows) and all(-1 <= f <= 1 for f in fit.values())


def plain_nmi(a, b):
    both = [(a[n], b[n]) for n in a]
    h = lambda xs: -sum(k / len(xs) * math.log(k / len(xs)) for k in (xs.count(x) for x in set(xs)))
    x, y = [p for p, _ in both], [q for _, q in both]
    return 1.0 if h(x) + h(y) < 1e-15 else 2 * (h(x) + h(y) - h(both)) / (h(x) + h(y))


def plain_q(pairs, comm):
    m, d = len(pairs), {}
    for p in pairs:
        for n in p:
            d[comm[n]] = d.get(comm[n], 0) + 1
    return sum(comm[a] == comm[b] for a, b in pairs) / m - sum((k / (2 * m)) ** 2 for k in d.values())


def partitions(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cand_id"], {})[r["node"]] = r["comm"]
    return out


def changed_pairs(rows):
    gone = {(min(g["src"], g["dst"]), max(g["src"], g["dst"])) for g in rows if g["op"] == "del"}
    new = {(min(g["src"], g["dst"]), max(g["src"], g["dst"])) for g in rows if g["op"] == "add"}
    return sorted((set(PAIRS) - gone) | new)


def test_cgn(spark, edges):
    run = J.cgn(spark, edges, 1, pop=4, rate=0.3)
    fit, rows = checked(run, 1, "min")
    base = {r["node"]: r["comm"] for r in louvain(edges, 1024).collect()}
    kinds = {g["op"] for r in rows.values() for g in r}
    assert "del" in kinds and all(base[g["src"]] == base[g["dst"]] and (g["src"], g["dst"]) in PAIRS for r in rows.values() for g in r if g["op"] == "del")
    assert all(base[g["src"]] != base[g["dst"]] and (g["src"], g["dst"]) not in PAIRS for r in rows.values() for g in r if g["op"] == "add")
    e = spark.createDataFrame([(c, a, b) for c in rows for a, b in changed_pairs(rows[c])], "cand_id int, src long, dst long")
    ends = spark.createDataFrame([(c, g["src"], g["dst"]) for c in rows for g in rows[c]], "cand_id int, src long, dst long")
    now = partitions(J.communities_after(e, ends, G.node_set(edges), spark.createDataFrame(list(base.items()), "node long, comm long"), 1024))
    assert all(set(now[c]) == set(NODES) and f == pytest.approx(plain_nmi(now[c], base), abs=1e-6) for c, f in fit.items())
    best = min(fit, key=lambda c: (fit[c], c))
    assert json.loads(run.log[-1][4])["q"] == pytest.approx(plain_q(changed_pairs(rows[best]), now[best]), abs=1e-6)  # of the communities after


def test_qattack(spark, edges):
    run = J.qattack(spark, edges, 1, pop=4, rate=0.2)
    fit, rows = checked(run, 1, "max")
    base = {r["node"]: r["comm"] for r in louvain(edges, 1024).collect()}
    after = {}
    for c, r in rows.items():
        gone = {tuple(sorted((g["node"], g["remove_node"]))) for g in r}
        after[c] = sorted((set(PAIRS) - gone) | {tuple(sorted((g["node"], g["add_node"]))) for g in r})
    e = spark.createDataFrame([(c, a, b) for c in after for a, b in after[c]], "cand_id int, src long, dst long")
    ends = spark.createDataFrame([(c, g["node"], g[k]) for c in rows for g in rows[c] for k in ("add_node", "remove_node")], "cand_id int, src long, dst long")
    now = partitions(J.communities_after(e, ends, G.node_set(edges), spark.createDataFrame(list(base.items()), "node long, comm long"), 1024))
    assert all(f == pytest.approx(math.exp(-plain_q(after[c], now[c])), abs=1e-6) for c, f in fit.items())


def plain_shift(before, after):
    def dists(pairs):
        a = np.zeros((13, 13))
        for x, y in pairs:
            a[x, y] = a[y, x] = 1
        p = a / (a.sum(1) + 1)[:, None]
        u, s, _ = np.linalg.svd((p + p @ p) / 2)
        v = u[:, :6] * np.sqrt(s[:6])
        return np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)).ravel()

    return 1 - abs(np.corrcoef(dists(before), dists(after))[0, 1])


def test_cda_eda(spark, edges):
    run = J.cda_eda(spark, edges, 1, pop=4, rate=0.2)
    fit, rows = checked(run, 1, "max")
    assert run.log[-1][4] and "nmi" in run.log[-1][4]
    one = J.fitness_of(run.problem, spark.createDataFrame([(0, 0, 4, 5)], "cand_id int, pos int, src long, dst long"))
    assert one == pytest.approx(plain_shift(PAIRS, [p for p in PAIRS if p != (4, 5)]), abs=0.1)  # few rounds of iteration
    emb = {(r["cand_id"], r["node"]): r["vec"] for r in C.lowrank_embedding(edges.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("cand_id"))), 6, 30, 1, ("cand_id",)).collect()}
    d = [np.array([[math.dist(emb[c, i], emb[c, j]) for j in NODES] for i in NODES]) for c in (0, 1)]
    assert np.allclose(d[0], d[1], atol=1e-6)


def plain_ra(pairs):
    adj = near(pairs)
    return {(a, b): sum(1 / len(adj[w]) for w in adj.get(a, set()) & adj.get(b, set())) for a, b in itertools.combinations(NODES, 2)}


@pytest.mark.parametrize("name", ["lpa_eda", "lpa_ga"])
def test_lpa(spark, edges, name):
    run = getattr(J, name)(spark, edges, 1, pop=4, rate=0.3)
    fit, rows = checked(run, 1, "max")
    split = {(r["src"], r["dst"]): r["split"] for r in G.edge_train_test_split(edges, 0.2, 1024).collect()}
    train, test = {p for p in split if split[p] == "train"}, {p for p in split if split[p] == "test"}
    for c, f in fit.items():
        dels = {(g["src"], g["dst"]) for g in rows[c] if g["op"] == "del"}
        adds = {(g["src"], g["dst"]) for g in rows[c] if g["op"] == "add"}
        ra = plain_ra(sorted((train - dels) | adds))
        neg = [p for p in ra if (p not in train or p in dels) and p not in adds and p not in test]
        want = math.exp(-(sum(ra[p] for p in test) / len(test) - sum(ra[p] for p in neg) / len(neg)))
        assert f == pytest.approx(want, abs=1e-6)
        kinds = [g["op"] for g in sorted(rows[c], key=lambda g: g["pos"])]
        k = run.problem.budget // 2
        assert kinds == ["del"] * k + ["add"] * k and len(dels) == len(adds) == k
        assert dels <= train and not adds & (train | test)  # no addition names a hidden edge
    hops = {p: next((h for h in range(1, 14) if p[1] in reach(sorted(train), [p[0]], h)[p[0]]), 99) for c in rows for g in rows[c] if g["op"] == "add" for p in [(g["src"], g["dst"])]}
    assert max(hops.values()) > 2  # additions at any distance


def test_fitness_by_change_is_lpa_fitness(spark, edges):
    split = G.edge_train_test_split(edges, 0.25, 5)
    train, test = (split.where(F.col("split") == s).select("src", "dst").cache() for s in ("train", "test"))
    t = [tuple(r) for r in train.collect()]
    changes = spark.createDataFrame([(0, "del", *t[0]), (0, "add", 0, 12), (1, "add", 3, 7), (1, "del", *t[3]), (1, "add", *test.first()), (2, "del", *t[1]), (2, "del", *t[1])], "cand_id int, op string, src long, dst long")
    e = P.apply_edge_changes(train, changes)
    scores = L.resource_allocation(train)
    want = {r[0]: r[1] for r in L.lpa_fitness(e, train, changes, test, 0.0, 13).select("cand_id", "fitness").collect()}
    got = {r[0]: r[1] for r in L.lpa_fitness_by_change(train, changes, test, scores, L.base_sums(train, test, scores), 13).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_precision_ranks_every_pair(spark):
    train = [(0, 1), (1, 2), (3, 4), (5, 6)]
    for test in ([(0, 2), (0, 3), (0, 4), (5, 7)], [(0, 3)], [(6, 7), (4, 7), (0, 2), (0, 7), (1, 7)]):
        frames = [spark.createDataFrame(x, "src long, dst long") for x in (train, test)]
        ra = {p: s for p, s in plain_ra(train).items() if max(p) < 8}
        ranked = sorted((p for p in itertools.combinations(range(8), 2) if p not in train), key=lambda p: (-round(ra[p], 9), p))
        row = L.precision_at_l(L.resource_allocation(frames[0]), *frames, spark.range(8).withColumnRenamed("id", "node")).first()
        assert (row["l"], row["hits"]) == (len(test), len(set(ranked[: len(test)]) & set(test)))


@pytest.fixture(scope="module")
def classed(spark, edges):
    """Labels follow the cliques; each label has a feature of its own, and all share one."""
    labels = spark.createDataFrame([(n, int(n >= 5), ("train", "test", "val")[n % 3]) for n in NODES], "node long, label int, split string")
    features = spark.createDataFrame([(n, int(n >= 5), 1.0) for n in NODES] + [(n, 2, 1.0) for n in NODES], "node long, feat int, value double")
    return J.labelled(edges, features, labels, 3)


def plain_logits(g, pairs, xw):
    nodes = sorted({n for n, _ in xw})
    a = np.eye(len(nodes))
    for x, y in pairs:
        a[nodes.index(x), nodes.index(y)] = a[nodes.index(y), nodes.index(x)] = 1
    d = a.sum(1) ** -0.5
    m = d[:, None] * a * d[None]
    return nodes, m @ m @ np.array([[xw.get((n, c), 0.0) for c in (0, 1)] for n in nodes])


def test_nca_ga(spark, classed):
    run = J.nca_ga(spark, classed, 1, pop=3, rate=0.1)
    fit, rows = checked(run, 1, "max")
    xw = {(r["node"], r["feat"]): r["value"] for r in classed.xw.collect()}
    labels = {r["node"]: (r["label"], r["split"]) for r in classed.labels.collect()}
    for c, f in fit.items():
        gone = {(g["src"], g["dst"]) for g in rows[c]}
        nodes, z = plain_logits(classed, [p for p in PAIRS if p not in gone], xw)
        loss = [math.log(np.exp(z[i]).sum()) - z[i][labels[n][0]] for i, n in enumerate(nodes) if labels[n][1] == "test"]
        assert f == pytest.approx(np.mean(loss), abs=1e-6)
    told = json.loads(run.log[-1][4])
    best = max(fit, key=lambda c: (fit[c], -c))
    nodes, z0 = plain_logits(classed, PAIRS, xw)
    _, z1 = plain_logits(classed, [p for p in PAIRS if p not in {(g["src"], g["dst"]) for g in rows[best]}], xw)
    test = [i for i, n in enumerate(nodes) if labels[n][1] == "test"]
    assert told["accuracy"] == pytest.approx(np.mean([z1[i].argmax() == labels[nodes[i]][0] for i in test]), abs=1e-6)
    assert told["asr"] == pytest.approx(np.mean([z1[i].argmax() != z0[i].argmax() for i in test]), abs=1e-6)


def test_gani(spark, classed):
    run = J.gani(spark, classed, 1, pop=3, injected=2, ratio=0.7)
    after = [r for r in run.log if r[0].startswith("gani-after")]
    assert [r[1] for r in after] == [1, 2] and all({"accuracy", "asr"} == set(json.loads(r[4])) for r in after) and run.problem.name == "gani1"
    assert run.graph.labels.count() == 15 and run.graph.edges.where("dst >= 13").count() >= 2
    xw = {(r["node"], r["feat"]): r["value"] for r in run.graph.xw.collect()}
    pairs = [tuple(r) for r in run.graph.edges.select("src", "dst").collect()]
    nodes, z = plain_logits(run.graph, pairs, xw)
    labels = {r["node"]: (r["label"], r["split"]) for r in run.graph.labels.collect()}
    test = [i for i, n in enumerate(nodes) if labels[n][1] == "test"]
    wrong = sum(np.round(z[i], 9).argmax() != labels[nodes[i]][0] for i in test)
    assert json.loads(after[-1][4])["accuracy"] == pytest.approx(1 - wrong / len(test), abs=1e-6) and -after[-1][2] <= wrong
    pool = [r["node"] for r in run.problem.pool.orderBy("idx").collect()]
    assert len(pool) == len(set(pool)) and 0 < len(pool) <= classed.labels.count() + 1 and run.problem.budget <= len(pool)


def test_rescoring_is_scoring_anew(spark, classed):
    """Deletions, additions, both, an edge that is there or isn't, an end in common, and a new node."""
    xw = classed.xw.union(spark.createDataFrame([(13, 0, 0.7), (13, 1, -0.2)], "node long, feat int, value double"))
    nodes = spark.range(14).withColumnRenamed("id", "node")
    base = N.propagated(classed.edges, nodes, xw)
    rows = [(0, "del", 4, 5), (0, "del", 0, 1), (1, "add", 12, 0), (1, "del", 9, 10), (2, "add", 0, 1), (2, "del", 1, 7), (3, "del", 0, 1), (3, "add", 1, 0), (4, "add", 3, 13), (4, "add", 13, 8), (5, "del", 10, 9), (5, "del", 10, 11)]
    changes = spark.createDataFrame(rows, "cand_id int, op string, src long, dst long")
    got = {(r["cand_id"], r["node"], r["class"]): r["logit"] for r in N.rescored(base, changes).collect()}
    flat = {(r["node"], r["feat"]): r["value"] for r in xw.collect()}
    _, before = plain_logits(None, PAIRS, flat)
    for c in range(6):
        pairs = (set(PAIRS) - {tuple(sorted(r[2:])) for r in rows if r[0] == c and r[1] == "del"}) | {tuple(sorted(r[2:])) for r in rows if r[0] == c and r[1] == "add"}
        _, z = plain_logits(None, sorted(pairs), flat)
        for n in range(14):
            for k in (0, 1):
                assert got.get((c, n, k), before[n][k]) == pytest.approx(z[n][k], abs=1e-9)
    assert not [x for x in got if x[0] in (2, 3)] and len({n for c, n, _ in got if c == 5}) < 14
    labels = classed.labels
    cands = changes.select("cand_id").distinct()
    z = N.rescored(base, changes)
    wrong = {r[0]: r[1] for r in N.misclassified_after(base, z, cands, labels, "test").select("cand_id", "fitness").collect()}
    loss = {r[0]: r[1] for r in N.loss_after(base, z, cands, labels, "test").select("cand_id", "loss").collect()}
    full = N.propagate(xw, N.gcn_normalize(P.apply_edge_changes(classed.edges, changes), nodes.crossJoin(cands), keys=("cand_id",)), 2, ("cand_id",)).select("cand_id", "node", F.col("feat").alias("class"), F.col("value").alias("logit"))
    assert wrong == {r[0]: r[1] for r in N.sga_fitness(N.predict_class(full, ("cand_id",)), labels, "test", ("cand_id",)).select("cand_id", "fitness").collect()}
    assert loss == pytest.approx({r[0]: r[1] for r in N.nll_loss(full, labels, "test", ("cand_id",)).select("cand_id", "loss").collect()}, abs=1e-9)


def degree_problem(spark, edges, select="roulette"):
    deg = G.degrees(edges)
    pool = G.rank_by(deg, F.desc("degree"), F.asc("node")).select((F.col("rank") - 1).alias("idx"), "node", "degree")
    return J.Problem("degree", "max", pool, 3, 5, J.fitness_from_pandas(lambda pdf: pdf["degree"].sum()), select=select)


def test_cut_off_runs_go_on_from_their_path(spark, edges, tmp_path):
    p = degree_problem(spark, edges, "rotary")
    whole = J.evolve(p, 3, seed=2)
    path = f"file://{tmp_path}/run"
    J.evolve(p, 2, seed=2, path=path)  # and then the driver is lost
    again = J.evolve(degree_problem(spark, edges, "rotary"), 1, seed=2, resume=J.resume(p, path, spark))
    assert again.log == whole.log and sorted(map(tuple, again.population.collect())) == sorted(map(tuple, whole.population.collect()))
    assert J.resume(p, path, spark).generation == 3
    assert [x.name for x in (tmp_path / "run" / "state").iterdir()] == ["3"]  # past generations are dropped


#: Each job's arguments but generations, small.
SMALL = {"sixdst": dict(pop=3, rate=0.2, pool_runs=2), "cutoff": dict(pop=3, pool_runs=2, pool_generations=1), "tde": dict(pop=3, rate=0.2), "cgn": dict(pop=3, rate=0.2), "qattack": dict(pop=3, rate=0.2), "cda_eda": dict(pop=3, rate=0.2), "lpa_eda": dict(pop=3, rate=0.2), "lpa_ga": dict(pop=3, rate=0.2), "nca_ga": dict(pop=3, rate=0.1), "gani": dict(pop=3, injected=2)}


#: One of each kind of loop by default; CUTWEAVE_ALL=1 runs all ten.
CUT = sorted(SMALL) if os.environ.get("CUTWEAVE_ALL") else ["cgn", "gani", "lpa_ga", "nca_ga", "tde"]


@pytest.mark.parametrize("name", CUT)
def test_every_job_goes_on_where_it_was_cut_off(spark, edges, classed, tmp_path, name):
    graph = classed if name in ("nca_ga", "gani") else edges
    job, path = getattr(J, name), f"file://{tmp_path}/{name}"
    job(spark, graph, 1, path=path, **(SMALL[name] | ({"injected": 1} if name == "gani" else {})))  # and then the driver is lost
    again = job(spark, graph, 2, path=path, again=True, **SMALL[name])
    whole = job(spark, graph, 2, **SMALL[name])
    last = lambda run: [(r[1], r[2], r[3]) for r in run.log if r[0] == run.log[-2][0]]
    if name != "gani":
        assert [r[:4] for r in again.log] == [r[:4] for r in whole.log] and again.log[-1] == whole.log[-1]
        assert sorted(map(str, again.population.collect())) == sorted(map(str, whole.population.collect()))
    else:
        assert sum(r[0].startswith("gani-after") for r in again.log) == 2 and {r[0] for r in again.log} == {r[0] for r in whole.log} and last(again)
    assert J.evolve(again.problem, 0, resume=again).log == again.log


def test_a_run_can_be_continued_twice(spark, edges):
    start = J.evolve(degree_problem(spark, edges), 1, seed=5)
    a, b = J.evolve(start.problem, 2, seed=5, resume=start), J.evolve(start.problem, 2, seed=5, resume=start)
    assert a.log == b.log and sorted(map(tuple, a.population.collect())) == sorted(map(tuple, b.population.collect()))
    assert start.population.count() == 15


def test_tables_do_not_pile_up(spark, edges, tmp_path, monkeypatch):
    """The shared folder holds as many tables after five generations as after two, metrics of reach and components included."""
    from cutweave import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    held = lambda: len(os.listdir(tmp_path))
    p = J.cutoff_problem(spark, edges, pop=3)
    p.report_every = 1
    run = J.evolve(p, 2, seed=3)
    at = held()
    run = J.evolve(p, 3, seed=3, resume=run)
    assert held() <= at + 2  # those of the run that was continued, and of the one that came out


def test_batches_score_as_one_job_does(spark, edges):
    p = J.cutoff_problem(spark, edges, pop=5)
    assert p.batch is None or p.batch >= 5
    pop = J.init_state(p, 4).population
    want = sorted(map(tuple, J.score(p, pop).collect()))
    p.batch = 2
    assert sorted(map(tuple, J.score(p, pop).collect())) == want
    assert J.batch_of(edges) == J.BATCH_ROWS // len(PAIRS)


def test_restarts(spark, edges):
    history, best = J.restarts(degree_problem(spark, edges), 1, 2, seed=7)
    rows = history.collect()
    assert {r["run_id"] for r in rows} == {"degree-7", "degree-8"} and len(rows) == 4
    assert best.log[-1][2] == max(r["best_fitness"] for r in rows)
    alone = J.evolve(degree_problem(spark, edges), 1, seed=8)
    assert [tuple(r) for r in rows if r["run_id"] == "degree-8"] == alone.log


def plain(run):
    return run.log, sorted(map(tuple, run.population.collect())), sorted(map(tuple, run.fitness.collect()))


@pytest.mark.parametrize("select, side", [("roulette", "max"), ("rotary", "min"), ("eda", "max")])
def test_runs_side_by_side_are_those_alone(spark, edges, select, side):
    p = degree_problem(spark, edges, select)
    p.side, p.batch = side, 4  # batches that go across runs
    both = J.evolve(p, 1, seeds=(3, 11))
    one = J.evolve(p, 1, seed=11)
    assert plain(J.alone(both, 11)) == plain(one)
    if select == "rotary":
        assert plain(J.evolve(p, 1, seed=11, resume=J.alone(both, 11))) == plain(J.evolve(p, 1, seed=11, resume=one))


def test_runs_side_by_side_go_on_from_their_path(spark, edges, tmp_path):
    p = degree_problem(spark, edges)
    p.metrics = lambda c: c.agg(F.sum("degree").alias("all"))
    path = f"file://{tmp_path}/runs"
    J.restarts(p, 1, 3, seed=9, path=path)  # and then the driver is lost
    history, best = J.restarts(p, 2, 3, seed=9, path=path, again=True)
    whole, best_whole = J.restarts(p, 2, 3, seed=9)
    without = lambda rows: sorted(tuple(r)[:4] for r in rows.collect())
    assert without(history) == without(whole) and len(without(whole)) == 9  # metrics: at the end of each call
    assert plain(best)[1:] == plain(best_whole)[1:]
    last = {r["run_id"]: r["metrics"] for r in whole.where("generation = 2").collect()}
    assert set(last) == {"degree-9", "degree-10", "degree-11"} and all(last.values())


def test_runs_with_steps_of_their_own_go_in_turn(spark, edges):
    p = degree_problem(spark, edges)
    p.mutate = lambda pop, seed, g: V.mutate(pop, 0.5, 4, seed, g)
    with pytest.raises(ValueError, match="steps of its own"):
        J.evolve(p, 1, seeds=(1, 2))
    history, best = J.restarts(p, 1, 2, seed=1)
    assert {r["run_id"] for r in history.collect()} == {"degree-1", "degree-2"}
    assert best.log[-1][2] == max(r["best_fitness"] for r in history.collect())


def test_as_many_jobs_for_many_runs_as_for_one(spark, edges):
    """Spark jobs of a generation don't grow with the runs."""
    p = degree_problem(spark, edges)
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, **how):
        run = J.evolve(p, 0, **how)
        spark.sparkContext.setJobGroup(group, group)
        J.evolve(p, 1, seed=5, resume=run)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    one, six = jobs("one", seed=5), jobs("six", seeds=range(5, 11))
    assert 0 < six <= 1.5 * one


def test_pool_of_searches_side_by_side(spark, edges):
    """The pool that small searches in turn would give."""
    p = J.cutoff_problem(spark, edges, pop=3)
    got = sorted(map(tuple, J.searched_pool(spark, edges, p, 6, 2, 1, seed=4).select("idx", "node").collect()))
    best = []
    for r in (1, 2):
        run = J.evolve(p, 1, seed=4 + 7919 * r)
        top = run.fitness.orderBy("fitness", "cand_id").first()["cand_id"]
        best += [(r, x["node"]) for x in J.decode(run.population.where(f"cand_id = {top}"), p.pool).collect()]
    rows = spark.createDataFrame(best, "cand_id int, node long")
    want = V.gene_pool_cutoff(rows, G.degree_rank(edges), 6)
    assert got == sorted(map(tuple, want.select("idx", "node").collect()))


def test_report_has_the_gene_and_metrics_of_the_best(spark):
    import json

    from cutweave.operators.reports import export_report

    h = spark.createDataFrame([("r", 1, 5.0, 2.0, "1,2", None), ("r", 2, 3.0, 2.0, "3,4", '{"pcg":1}')], "run_id string, generation int, fitness double, iter_ms double, best_gene string, metrics string")
    got = json.loads(export_report(h).first()["report"])
    assert got["best_gene"] == "3,4" and got["metrics"] == '{"pcg":1}' and got["best_fitness"] == 3.0


def test_injected_features(spark):
    f = spark.createDataFrame([(1, 0, 1.0), (4, 1, 2.0)], "node long, feat int, value double")
    row = spark.createDataFrame([(0, 0.5), (2, 0.25)], "feat int, value double")
    got = sorted(map(tuple, P.inject_features(f, f.select("node"), row).collect()))
    assert got == [(1, 0, 1.0), (4, 1, 2.0), (5, 0, 0.5), (5, 2, 0.25)]


def test_fitted_classifier_tells_the_labels(classed):
    weights = {(r["feat"], r["class"]): r["w"] for r in classed.weights.collect()}
    assert len(weights) == 2 * 4 and -1 in {f for f, _ in weights}
    z = N.propagated(classed.edges, classed.labels.select("node"), classed.xw).logits
    assert N.accuracy(N.predict_class(z), classed.labels, "test").first()["accuracy"] == 1.0


def test_distances_of_stated_nodes(spark):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "node long, vec array<double>")
    got = sorted(map(tuple, C.pairwise_distance(emb, spark.createDataFrame([(2,), (4,)], "node long")).collect()))
    assert got == [(a, b, float(abs(a - b))) for a in (2, 4) for b in range(5)]
