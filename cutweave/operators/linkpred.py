"""Link prediction: resource allocation over wedges, precision, AUC by histogram, and fitness with incremental rescoring.

Scores exist for pairs with a common neighbour alone; all other pairs score 0 and are counted, never listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cutweave.operators.graph import adjacency, dense_rank_ids, node_set, rank_by
from cutweave.session import materialise


def _wedges(edges: DataFrame, keys: tuple[str, ...] = (), pivots: DataFrame | None = None) -> DataFrame:
    """keys, src < dst, w, part = 1 / degree of w, of every wedge (about ``pivots`` alone, if given: keys, w). A hub's
    wedges are its degree squared: AQE splits its side of the join."""
    a = adjacency(edges.where("src <> dst"), keys)
    d = a.groupBy(*keys, F.col("src").alias("w")).agg(F.count("*").alias("degree"))
    arms = a.select(*keys, F.col("src").alias("w"), F.col("dst").alias("x"))
    if pivots is not None:
        arms = arms.join(pivots.select(*keys, "w").distinct(), [*keys, "w"], "left_semi")
    left = arms.join(d, [*keys, "w"])
    return left.select(*keys, "w", F.col("x").alias("src"), (1.0 / F.col("degree")).alias("part")).join(arms.withColumnRenamed("x", "dst"), [*keys, "w"]).where("src < dst")


def resource_allocation(edges: DataFrame, pairs: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, score: the sum of 1 / degree over common neighbours, of all pairs that have one, or of ``pairs``
    with 0 for those that have none."""
    ra = _wedges(edges, keys).groupBy(*keys, "src", "dst").agg(F.sum("part").alias("score"))
    if pairs is None:
        return ra
    on = [*(k for k in keys if k in pairs.columns), "src", "dst"]
    return pairs.select(*on).join(ra, on, "left").fillna(0.0, ["score"])


def precision_at_l(scores: DataFrame, train: DataFrame, test: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: l = number of test pairs, hits among the l best-scored pairs outside ``train`` (ties by pair), precision.

    Every pair of ``nodes`` (default: those of train and test) has a rank. The pairs without a common neighbour score 0
    and follow the scored ones in order of pair; they are never listed: a test pair's rank among them is its number among
    all pairs less the scored and the observed pairs before it.
    """
    nodes = nodes if nodes is not None else node_set(train.select("src", "dst").union(test.select("src", "dst")))
    l, n = test.count(), nodes.count()  # noqa: E741
    free = scores.where("score > 0").join(train.select("src", "dst"), ["src", "dst"], "left_anti")
    top = free.orderBy(F.desc(F.round("score", 9)), "src", "dst").limit(l)
    hits = top.join(test.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("hits"))
    room = free.agg((F.lit(l) - F.count("*")).alias("room"))  # of the cut, for pairs that score 0
    known = free.select("src", "dst").union(train.select("src", "dst")).distinct().withColumn("known", F.lit(1))
    rows = known.unionByName(test.select("src", "dst").join(known, ["src", "dst"], "left_anti").withColumn("known", F.lit(0)))
    ranked = rank_by(rows, F.asc("src"), F.asc("dst"))
    unscored = rank_by(ranked.where("known = 0").drop("rank").join(ranked.select("src", "dst", F.col("rank").alias("among")), ["src", "dst"]), F.asc("src"), F.asc("dst"))
    at = dense_rank_ids(nodes, "node")
    i, j = at.select(F.col("node").alias("src"), F.col("idx").alias("i")), at.select(F.col("node").alias("dst"), F.col("idx").alias("j"))
    number = F.expr(f"i * (2 * {n}L - i - 1) div 2 + j - i")  # of a pair among all, from 1
    zero = unscored.join(i, "src").join(j, "dst").select((number - (F.col("among") - F.col("rank"))).alias("rank")).crossJoin(F.broadcast(room)).where("rank <= room").agg(F.count("*").alias("more"))
    both = hits.crossJoin(zero).select((F.col("hits") + F.col("more")).alias("hits"))
    return both.select(F.lit(l).cast("long").alias("l"), "hits", (F.col("hits") / F.lit(max(l, 1))).alias("precision"))


def auc(scores: DataFrame, train: DataFrame, test: DataFrame, n_nodes: int) -> DataFrame:
    """One row, auc: the chance that a test pair outscores a pair neither observed nor tested, ties half. From a
    histogram of negatives' scores and its running sum; a test pair that is observed scores -1."""
    known = train.select("src", "dst").union(test.select("src", "dst")).distinct()
    neg = scores.join(known, ["src", "dst"], "left_anti").groupBy(F.round("score", 9).alias("score")).agg(F.count("*").alias("c"))
    total = F.lit(n_nodes * (n_nodes - 1) // 2)
    zero = known.agg(F.count("*").alias("k")).crossJoin(neg.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("s"))).select(F.lit(0.0).alias("score"), (total - F.col("k") - F.col("s")).alias("c"))
    hist = neg.union(zero).withColumn("below", F.coalesce(F.sum("c").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seen = train.select("src", "dst", F.lit(-1.0).alias("seen"))
    pos = test.join(scores, ["src", "dst"], "left").join(seen, ["src", "dst"], "left").select(F.round(F.coalesce("seen", "score", F.lit(0.0)), 9).alias("score")).groupBy("score").agg(F.count("*").alias("n"))
    # a histogram of distinct scores: a running sum places each test score among the negatives'
    both = hist.select("score", "c", F.lit(0).cast("long").alias("n")).union(pos.select("score", F.lit(0).cast("long"), "n")).groupBy("score").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    both = both.withColumn("below", F.coalesce(F.sum("c").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return both.agg((F.sum(F.col("n") * (F.col("below") + F.col("c") / 2)) / F.sum("n") / F.sum("c")).alias("auc"))


def lpa_fitness(edges: DataFrame, original: DataFrame, changes: DataFrame, test: DataFrame, ratio: float = 0.0, nodes: int | None = None) -> DataFrame:
    """cand_id, fitness = exp(-(pos - neg - ratio cnt)): pos the mean score of test pairs; neg that of pairs which are
    not edges of the candidate's graph (test pairs aside); cnt those of them that reach the best test score, all of them
    if that is 0.

    ``edges``: the candidates' graphs (cand_id, src, dst); ``original``: the graph before; ``changes``: cand_id, op,
    src, dst; negatives = (original non-edges + deleted) - added, without test pairs.
    """
    n = nodes if nodes is not None else original.select(F.explode(F.array("src", "dst"))).distinct().count()
    ra = resource_allocation(edges, keys=("cand_id",))
    c = changes.select("cand_id", "op", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    t = test.select("src", "dst").withColumn("t", F.lit(1))
    o = original.select("src", "dst").withColumn("o", F.lit(1))
    d, a = c.where("op = 'del'").drop("op").withColumn("d", F.lit(1)), c.where("op = 'add'").drop("op").withColumn("a", F.lit(1))
    tag = lambda x: x.join(o, ["src", "dst"], "left").join(d, ["cand_id", "src", "dst"], "left").join(a, ["cand_id", "src", "dst"], "left")
    negative = (F.col("o").isNull() | F.col("d").isNotNull()) & F.col("a").isNull()
    rows = tag(ra.join(t, ["src", "dst"], "left")).select("cand_id", F.round("score", 9).alias("score"), F.col("t").isNotNull().alias("is_t"), (F.col("t").isNull() & negative).alias("is_n"))
    n_t = test.count()
    per = rows.groupBy("cand_id").agg(F.sum(F.when(F.col("is_t"), F.col("score"))).alias("st"), F.max(F.when(F.col("is_t"), F.col("score"))).alias("mt"), F.sum(F.when(F.col("is_n"), F.col("score"))).alias("sn"))
    cnt = rows.join(per.select("cand_id", "mt"), "cand_id").where("is_n and score >= coalesce(mt, 0)").groupBy("cand_id").agg(F.count("*").alias("cnt"))
    # size of the negatives: all pairs, less original edges, plus deleted ones, less added non-edges, less test pairs among them
    moved = tag(c.select("cand_id", "src", "dst").distinct()).join(t, ["src", "dst"], "left").where("t is null").groupBy("cand_id").agg(F.sum(F.when(F.col("o").isNotNull() & F.col("d").isNotNull() & F.col("a").isNull(), 1).otherwise(0)).alias("back"), F.sum(F.when(F.col("o").isNull() & F.col("a").isNotNull(), 1).otherwise(0)).alias("taken"))
    base = original.select("src", "dst").union(test.select("src", "dst")).distinct().count()
    j = edges.select("cand_id").distinct().join(per, "cand_id", "left").join(cnt, "cand_id", "left").join(moved, "cand_id", "left").fillna(0, ["cnt", "back", "taken"]).fillna(0.0, ["st", "sn"])
    size = F.lit(n * (n - 1) // 2 - base) + F.col("back") - F.col("taken")
    reach = F.when(F.coalesce("mt", F.lit(0.0)) > 0, F.col("cnt")).otherwise(size)  # no test pair scores: all negatives reach 0
    return j.select("cand_id", F.exp(-(F.col("st") / max(n_t, 1) - F.col("sn") / size - ratio * reach)).alias("fitness"))


def affected_pairs(edges: DataFrame, scores: DataFrame, changes: DataFrame) -> DataFrame:
    """cand_id, src, dst, old, new of the pairs whose score a candidate's changes (cand_id, op, src, dst; deletions come
    first) alter, nulls meaning 0. ``edges`` and ``scores`` are the original graph's.

    A changed edge alters the wedges about its two ends alone. Only those pivots are joined to the graph, and only their arms
    and degrees are taken, before and after: new = old - before + after. A pivot's arms of both are one list, so that a wedge
    is met once, and goes at once where it counts the same. No candidate's whole graph is made.
    """
    both = lambda t: t.select("cand_id", "op", F.explode(F.array(F.struct(F.col("src").alias("w"), F.col("dst").alias("x")), F.struct(F.col("dst").alias("w"), F.col("src").alias("x")))).alias("e")).select("cand_id", "op", "e.w", "e.x").where("w <> x")
    moved = both(changes).groupBy("cand_id", "w", "x").agg(F.max((F.col("op") == "add").cast("int")).alias("add"))
    pivots = moved.select("cand_id", "w").distinct()
    before = adjacency(edges.where("src <> dst")).select(F.col("src").alias("w"), F.col("dst").alias("x")).join(pivots, "w").select("cand_id", "w", "x", F.lit(1).alias("b"))
    arms = before.join(moved, ["cand_id", "w", "x"], "full").select("cand_id", "w", "x", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("add", "b").alias("a")).where("a + b > 0")
    of = W.partitionBy("cand_id", "w")
    arms = materialise(arms.withColumns({"db": F.sum("b").over(of), "da": F.sum("a").over(of)}), "arms")
    left, right = (arms.select("cand_id", "w", F.col("x").alias(c), F.col("a").alias(f"a_{c}"), F.col("b").alias(f"b_{c}"), *more) for c, more in (("src", ["da", "db"]), ("dst", [])))
    now = F.when(F.expr("a_src + a_dst = 2"), 1.0 / F.col("da")).otherwise(0.0)
    part = now - F.when(F.expr("b_src + b_dst = 2"), 1.0 / F.col("db")).otherwise(0.0)
    wedges = left.join(right, ["cand_id", "w"]).where("src < dst").select("cand_id", "src", "dst", part.alias("part")).where("part <> 0")
    delta = wedges.groupBy("cand_id", "src", "dst").agg(F.sum("part").alias("delta")).where("abs(delta) > 1e-12")
    return delta.join(scores, ["src", "dst"], "left").select("cand_id", "src", "dst", F.coalesce("score", F.lit(0.0)).alias("old"), (F.coalesce("score", F.lit(0.0)) + F.col("delta")).alias("new"))


def base_sums(train: DataFrame, test: DataFrame, scores: DataFrame) -> tuple[float, float]:
    """The sums of scores of test pairs, and of the pairs neither observed nor tested, in the graph before any change."""
    st = test.select("src", "dst").distinct().join(scores, ["src", "dst"]).agg(F.sum("score")).first()[0]
    known = train.select("src", "dst").union(test.select("src", "dst"))
    sn = scores.join(known, ["src", "dst"], "left_anti").agg(F.sum("score")).first()[0]
    return float(st or 0.0), float(sn or 0.0)


def lpa_fitness_by_change(train: DataFrame, changes: DataFrame, test: DataFrame, scores: DataFrame, sums: tuple[float, float], nodes: int) -> DataFrame:
    """cand_id, fitness: ``lpa_fitness`` with a ratio of 0, from the ``scores`` of the graph before and their ``base_sums``:
    only pairs whose score a candidate alters, and its changed pairs, are looked at."""
    pairs = ["src", "dst"]
    c = changes.select("cand_id", "op", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    moved = c.groupBy("cand_id", *pairs).agg(F.max((F.col("op") == "del").cast("int")).alias("d"), F.max((F.col("op") == "add").cast("int")).alias("a"))
    delta = affected_pairs(train, scores, changes)
    rows = delta.join(moved, ["cand_id", *pairs], "full").join(scores, pairs, "left").fillna(0, ["d", "a"])
    rows = rows.withColumn("old", F.coalesce("old", "score", F.lit(0.0))).withColumn("new", F.coalesce("new", "old"))
    mark = lambda t, name: t.select(*pairs).distinct().withColumn(name, F.lit(1))
    rows = rows.join(mark(train, "o"), pairs, "left").join(mark(test, "t"), pairs, "left").fillna(0, ["o", "t"])
    before = (F.col("o") == 0) & (F.col("t") == 0)
    after = ((F.col("o") == 0) | (F.col("d") == 1)) & (F.col("a") == 0) & (F.col("t") == 0)
    count = lambda b: b.cast("long")
    per = rows.groupBy("cand_id").agg(
        F.sum(F.when(F.col("t") == 1, F.col("new") - F.col("old")).otherwise(0.0)).alias("st"),
        F.sum(F.when(after, F.col("new")).otherwise(0.0) - F.when(before, F.col("old")).otherwise(0.0)).alias("sn"),
        F.sum(count(after) - count(before)).alias("size"),
    )
    known = train.select(*pairs).union(test.select(*pairs)).distinct().count()
    n_t = max(test.count(), 1)
    size = F.lit(nodes * (nodes - 1) // 2 - known) + F.coalesce("size", F.lit(0))
    all_of = changes.select("cand_id").distinct().join(per, "cand_id", "left").fillna(0.0, ["st", "sn"])
    return all_of.select("cand_id", F.exp(-((F.col("st") + sums[0]) / n_t - (F.col("sn") + sums[1]) / size)).alias("fitness"))
