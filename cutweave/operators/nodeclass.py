"""Node classification: normalised adjacency, propagation, logits, losses, attack metrics, and injected nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cutweave.operators.graph import adjacency, degrees, rank_by
from cutweave.session import dealt_by_fewer_keys, discard, materialise, scope


def gcn_normalize(edges: DataFrame, nodes: DataFrame, power: float = -0.5, self_loops: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, value of D^p (A + I) D^p; a degree of 0 gives 0, not infinity."""
    a = adjacency(edges.where("src <> dst"), keys)
    if self_loops:
        a = a.unionAll(nodes.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst")))
    d = a.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("d"))
    s = lambda c, o: d.select(*keys, F.col("node").alias(c), F.pow("d", F.lit(power)).alias(o))
    return a.join(s("src", "x"), [*keys, "src"]).join(s("dst", "y"), [*keys, "dst"]).select(*keys, F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("x") * F.col("y")).alias("value"))


def row_normalize_features(features: DataFrame) -> DataFrame:
    """node, feat, value / row sum; rows that sum to 0 are left 0."""
    s = features.groupBy("node").agg(F.sum("value").alias("s"))
    return features.join(s, "node").select("node", "feat", F.when(F.col("s") == 0, 0.0).otherwise(F.col("value") / F.col("s")).alias("value"))


#: Node ids of one range, whose arms one task turns into sums; the most of them, where there are many nodes. The longer a
#: range, the more of a node's arms meet in it and are one row of sums.
SPAN, LONGEST = 4096, 32768


def span_of(nodes: int, tasks: int) -> int:
    """A range's ids for so many nodes: two ranges for each task that runs at once, within SPAN and LONGEST."""
    return min(LONGEST, max(SPAN, nodes // (2 * tasks)))


def _span(c: str, span: int = SPAN) -> Column:
    """A node's range. Never null, so that no filter on it makes the arms of two hops differ: their shuffle is one."""
    return F.coalesce(F.expr(f"{c} div {span}"), F.lit(-1).cast("long")).alias("_span")


def _wide(features: DataFrame, width: int, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """keys, node, _g and ``width`` columns: the features _g x width and on of a node, side by side (null: no such entry)."""
    names = [f"_f{i}" for i in range(width)]
    entry = lambda i: F.sum(F.when(F.pmod("feat", F.lit(width)) == i, F.col("value"))).alias(names[i])
    return features.groupBy(*[k for k in keys if k in features.columns], "node", F.floor(F.col("feat") / width).alias("_g")).agg(*(entry(i) for i in range(width))), names


def _long(x: DataFrame, names: list[str], kind: str, keys: tuple[str, ...]) -> DataFrame:
    """``_wide`` undone: keys, node, feat, value."""
    long = x.select(*keys, "node", "_g", F.posexplode(F.array(*names)).alias("_i", "value")).where("value is not null")
    return long.select(*keys, "node", (F.col("_g") * len(names) + F.col("_i")).cast(kind).alias("feat"), "value")


def _met(arms: DataFrame, x: DataFrame, on: list[str], span: int = SPAN) -> DataFrame:
    """Arms (row, col, _span), dealt by ``_span``, with the rows of ``x`` at their ``col``. One task has all arms of a range of
    ids: where near ids are linked to the same nodes, it adds up their rows before it sends them on."""
    return arms.join(x.withColumnRenamed("node", "col").withColumn("_span", _span("col", span)).repartition("_span"), [*on, "_span", "col"])


def propagate(features: DataFrame, norm: DataFrame, hops: int, keys: tuple[str, ...] = (), width: int = 32) -> DataFrame:
    """keys, node, feat, value of A^hops X: a join and an aggregate a hop. ``width`` features side by side are one row, so an
    arm moves a row for that many."""
    if not hops:
        return features
    x, names = _wide(features, width, keys)
    arms = norm.select(*keys, "row", "col", "value", _span("col")).repartition("_span")
    for _ in range(hops):
        j = _met(arms, x, [k for k in keys if k in x.columns])
        x = j.groupBy(*keys, F.col("row").alias("node"), "_g").agg(*(F.sum(F.col("value") * F.col(c)).alias(c) for c in names))
    return _long(x, names, dict(features.dtypes)["feat"], keys)


def propagate_graph(features: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int, width: int = 32, written: bool = False) -> DataFrame:
    """node, feat, value: ``propagate`` over ``gcn_normalize(edges, nodes)``, whose values are never listed. They are a
    product of two nodes' factors, so rows are scaled before and after a hop, and an arm is two ids alone.

    ``written``: each hop is written, and what was shuffled for it is dropped then, the arms too. They stay dealt by ranges of
    ids in its join; a plan that runs later is dealt out by range and id, which scatters a node's arms over all tasks, and each
    sends on a row of sums for the node. For graphs whose sums are not to fill the disks."""
    if not hops:
        return features
    with scope() as own:
        x, names = _wide(features, width, ())
        arms = adjacency(edges.where("src <> dst")).unionAll(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
        span = span_of(nodes.count(), edges.sparkSession.sparkContext.defaultParallelism) if written else SPAN
        arms = arms.select(F.col("src").alias("row"), F.col("dst").alias("col"), _span("dst", span))
        scale = materialise(arms.groupBy(F.col("row").alias("node")).agg((1 / F.sqrt(F.count("*"))).alias("_s")), "scale")
        arms, last = arms.repartition("_span"), None
        for i in range(hops):
            # the factor before this hop, and that after the hop before
            by = F.col("_s") * F.col("_s") if i else F.col("_s")
            x = x.join(scale, "node").select("node", "_g", *((F.col(c) * by).alias(c) for c in names))
            x = _met(arms, x, [], span).groupBy(F.col("row").alias("node"), "_g").agg(*(F.sum(c).alias(c) for c in names))
            if i == hops - 1:
                x = x.join(scale, "node").select("node", "_g", *((F.col(c) * F.col("_s")).alias(c) for c in names))
            if written:
                with dealt_by_fewer_keys(edges.sparkSession):
                    x = materialise(x, "hop")
                if last is not None:
                    discard(last)
                last = x
        own.keep(x if written else scale)
    return _long(x, names, dict(features.dtypes)["feat"], ())


def linear_logits(features: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, class, logit = X W. ``weights``: feat, class, w, small beside the features."""
    return features.join(weights, "feat").groupBy(*keys, "node", "class").agg(F.sum(F.col("value") * F.col("w")).alias("logit"))


def gcn_forward(features: DataFrame, edges: DataFrame, nodes: DataFrame, layers: list[DataFrame], final_activation: bool = False) -> DataFrame:
    """node, class, logit of stacked layers A (X W) with ELU between them. X W first: what then moves has W's width."""
    x = features
    for i, w in enumerate(layers):
        z = propagate_graph(linear_logits(x, w).select("node", F.col("class").alias("feat"), F.col("logit").alias("value")), edges, nodes, 1, width=8, written=True)
        if i < len(layers) - 1 or final_activation:
            z = z.withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(F.exp("value") - 1))
        x = z
    return x.select("node", F.col("feat").alias("class"), F.col("value").alias("logit"))


def predict_class(logits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, pred: the class of the greatest logit (to 9 places), the least on ties."""
    return logits.groupBy(*keys, "node").agg(F.max_by("class", F.struct(F.round("logit", 9), -F.col("class"))).alias("pred"))


def nll_loss(logits: DataFrame, labels: DataFrame, split: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, loss: minus the mean log-softmax at the label, over the nodes of a split."""
    j = logits.join(labels.where(F.col("split") == split).select("node", "label"), "node")
    top = j.groupBy(*keys, "node").agg(F.max("logit").alias("top"), F.max(F.when(F.col("class") == F.col("label"), F.col("logit"))).alias("own"))
    z = j.join(top, [*keys, "node"]).groupBy(*keys, "node").agg(F.sum(F.exp(F.col("logit") - F.col("top"))).alias("z"), F.first("top").alias("top"), F.first("own").alias("own"))
    loss = F.avg(F.col("top") + F.log("z") - F.col("own")).alias("loss")
    return z.groupBy(*keys).agg(loss) if keys else z.agg(loss)


def sga_fitness(pred: DataFrame, labels: DataFrame, split: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, fitness: minus the number of misclassified nodes of a split."""
    j = pred.join(labels.where(F.col("split") == split), "node")
    f = (-F.count_if(F.col("pred") != F.col("label"))).alias("fitness")
    return j.groupBy(*keys).agg(f) if keys else j.agg(f)


def accuracy(pred: DataFrame, labels: DataFrame, split: str, keys: tuple[str, ...] = ()) -> DataFrame:
    j = pred.join(labels.where(F.col("split") == split), "node")
    f = F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy")
    return j.groupBy(*keys).agg(f) if keys else j.agg(f)


def attack_success_rate(before: DataFrame, after: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """One row, asr: the share of a split's nodes whose prediction changed."""
    j = labels.where(F.col("split") == split).select("node").join(before.select("node", F.col("pred").alias("a")), "node").join(after.select("node", F.col("pred").alias("b")), "node")
    return j.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("asr"))


def fit_node_classifier(features: DataFrame, labels: DataFrame, n_feats: int, split: str = "train", max_iter: int = 50, reg: float = 1e-3) -> DataFrame:
    """feat, class, w (and feat -1 for the bias) of a multinomial logistic regression on propagated features, fitted by
    Spark's own solver. Returns weights as a table; ``n_feats`` times classes of them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features.join(labels.where(F.col("split") == split).select("node", "label"), "node").groupBy("node", "label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feat").cast("int"), "value"))).alias("m"))
    dense = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(n_feats - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("features"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial").fit(dense)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    out = [(f, c, float(w[c, f])) for c in range(w.shape[0]) for f in range(w.shape[1])] + [(-1, c, float(x)) for c, x in enumerate(b)]
    return features.sparkSession.createDataFrame(out, "feat int, class int, w double")


def homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, degree, same, homophily = same / d (0 for none), decrease = same / (d^2 + d), attached = same / ((d + 1)^2 +
    d + 1), rank from 1 by decrease descending, ties by node."""
    l = labels.select("node", "label")  # noqa: E741
    a = adjacency(edges.where("src <> dst"))
    j = a.join(l.select(F.col("node").alias("src"), F.col("label").alias("x")), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("y")), "dst")
    s = j.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    d = l.select("node").join(s, "node", "left").fillna(0, ["degree", "same"])
    z = lambda n, by: F.when(F.col("degree") == 0, 0.0).otherwise(n / by)
    d = d.withColumn("homophily", z(F.col("same"), F.col("degree"))).withColumn("decrease", z(F.col("same"), F.col("degree") * F.col("degree") + F.col("degree")))
    return d.withColumn("attached", F.col("same") / ((F.col("degree") + 1) * (F.col("degree") + 1) + F.col("degree") + 1))


def label_feature_profile(features: DataFrame, labels: DataFrame, top: int = 100) -> DataFrame:
    """label, feat, n (nonzeros), mean over them, rank by n within the label (ties by feat); the first ``top``."""
    g = features.where("value <> 0").join(labels.select("node", "label"), "node").groupBy("label", "feat").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "feat"))).where(F.col("rank") <= top)


def injected_node_features(profile: DataFrame, features: DataFrame, label: int) -> DataFrame:
    """feat, value: the label's first floor(mean nonzeros a node) features, at their means."""
    n = features.where("value <> 0").groupBy("node").count().agg(F.floor(F.avg("count")).alias("k"))
    return profile.where(F.col("label") == label).crossJoin(F.broadcast(n)).where("rank <= k").select("feat", F.col("mean").alias("value"))


def degree_budget(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, budget: min(d, 2 (mean + 1)), or mean div 2 where that is 0, then at most 2 mean; mean = floor(2m / n)."""
    d = degrees(edges, nodes, loops=1)
    mean = d.agg(F.floor(F.sum("degree") / F.count("*")).alias("mean"))
    b = F.least(F.col("degree"), 2 * (F.col("mean") + 1))
    return d.crossJoin(F.broadcast(mean)).select("node", F.least(F.when(b == 0, F.expr("mean div 2")).otherwise(b), 2 * F.col("mean")).cast("long").alias("budget"))


def potential_edges(homo: DataFrame, labels: DataFrame, label: int) -> DataFrame:
    """node, decrease, rank of the nodes of other labels, by decrease descending, then node."""
    other = homo.join(labels.where(F.col("label") != label).select("node"), "node").select("node", F.round("decrease", 9).alias("decrease"))
    return rank_by(other, F.desc("decrease"), F.asc("node"))


def rank_single_links(losses: DataFrame, homo: DataFrame, ratio: float) -> DataFrame:
    """node, loss, rank: by (loss, decrease descending, node), the first floor(n ratio)."""
    r = rank_by(losses.join(homo.select("node", F.round("decrease", 9).alias("decrease")), "node"), F.asc("loss"), F.desc("decrease"), F.asc("node"))
    n = r.agg(F.floor(F.count("*") * ratio).alias("k"))
    return r.crossJoin(F.broadcast(n)).where("rank <= k").select("node", "loss", "rank")


@dataclass
class Propagated:
    """A graph's two hops, kept: degrees with the self-loop (node, d), the normalised matrix (row, col, value), and X, A X
    and A A X in one row a node (node, _x0 on, _h0 on, _z0 on), ``width`` classes side by side."""

    degree: DataFrame
    norm: DataFrame
    rows: DataFrame
    width: int

    def names(self, kind: str) -> list[str]:
        return [f"_{kind}{i}" for i in range(self.width)]

    @property
    def beside(self) -> DataFrame:
        """node, and a column a class, of the logits."""
        return self.rows.select("node", *(F.col(z).alias(f) for z, f in zip(self.names("z"), self.names("f"))))

    @property
    def logits(self) -> DataFrame:
        return _apart(self.beside, self.width)


def _apart(t: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, class, logit, of rows with a column a class."""
    long = t.select(*keys, "node", F.posexplode(F.array(*(f"_f{i}" for i in range(width)))).alias("class", "logit"))
    return long.where("logit is not null")


def _beside(t: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``_apart`` undone; rows with a column a class are taken as they are."""
    if "class" not in t.columns:
        return t
    return _wide(t.select(*keys, "node", F.col("class").alias("feat"), F.col("logit").alias("value")), width, keys)[0].drop("_g")


def propagated(edges: DataFrame, nodes: DataFrame, x: DataFrame) -> Propagated:
    """Two hops over normalised edges, written. A node of ``nodes`` without edges keeps its own X."""
    norm = materialise(gcn_normalize(edges, nodes), "norm")
    degree = materialise(norm.groupBy(F.col("row").alias("node")).agg(F.count("*").alias("d")), "degree")
    width = int(x.agg(F.max("feat")).first()[0] or 0) + 1
    wide, names = _wide(x, width, ())
    arms = norm.select("row", "col", "value", _span("col")).repartition("_span")
    hop = lambda t: _met(arms, t, []).groupBy(F.col("row").alias("node")).agg(*(F.sum(F.col("value") * F.col(c)).alias(c) for c in names))
    as_ = lambda t, kind: t.select("node", *(F.col(c).alias(c.replace("f", kind)) for c in names))
    wide = wide.drop("_g")
    h = materialise(hop(wide), "hop")
    rows = as_(hop(h), "z").join(as_(h, "h"), "node", "left").join(as_(wide, "x"), "node", "left")
    return Propagated(degree, norm, materialise(rows, "hops"), width)


def rescored(base: Propagated, changes: DataFrame) -> DataFrame:
    """cand_id, node, class, logit: ``rescored_rows``, a row a class."""
    return _apart(rescored_rows(base, changes), base.width, ("cand_id",))


def rescored_rows(base: Propagated, changes: DataFrame) -> DataFrame:
    """cand_id, node, and a column a class (null: no logit), of the nodes whose two-hop logits a candidate's changes (cand_id, op, src, dst; an edge
    that is deleted and added stays) alter: what ``propagate`` gives on the candidate's own graph.

    With A' = A + D and H = A X: A'A'X = A H + D H + A (D X) + D (D X). D has entries in the rows and columns of the changes'
    ends alone, D X in the rows of their neighbours, and the rest within two hops; the graph is never copied for a candidate.
    """
    c = changes.select("cand_id", "op", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").groupBy("cand_id", "src", "dst").agg(F.max("op").alias("last"), F.min("op").alias("first"))
    c = c.select("cand_id", "src", "dst", (F.col("first") == "add").alias("there"))  # 'add' sorts before 'del'
    both = c.select("cand_id", "src", "dst", "there").union(c.select("cand_id", F.col("dst"), F.col("src"), "there"))
    held = base.norm.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.lit(True).alias("was"))
    both = materialise(both.join(held, ["src", "dst"], "left").select("cand_id", "src", "dst", "there", F.coalesce("was", F.lit(False)).alias("was")).where("there <> was"), "flips")
    ends = both.groupBy("cand_id", F.col("src").alias("node")).agg(F.sum(F.when(F.col("there"), 1).otherwise(-1)).alias("more"))
    ends = materialise(ends.join(base.degree, "node").select("cand_id", "node", "d", (F.col("d") + F.col("more")).alias("d1")), "ends")
    old = base.norm.join(ends.select("cand_id", F.col("node").alias("row")), "row").select("cand_id", "row", "col", F.lit(1).alias("a0"), F.lit(1).alias("a1"))
    flips = both.select("cand_id", F.col("src").alias("row"), F.col("dst").alias("col"), F.col("was").cast("int").alias("a0"), F.col("there").cast("int").alias("a1"))
    rows = old.join(flips.select("cand_id", "row", "col"), ["cand_id", "row", "col"], "left_anti").union(flips)
    side = lambda n, out: ends.select("cand_id", F.col("node").alias(n), F.col("d1").alias(out))
    rows = rows.join(ends.select("cand_id", F.col("node").alias("row"), F.col("d").alias("x0"), F.col("d1").alias("x1")), ["cand_id", "row"]).join(base.degree.select(F.col("node").alias("col"), F.col("d").alias("y0")), "col").join(side("col", "y1"), ["cand_id", "col"], "left")
    change = F.col("a1") / F.sqrt(F.col("x1") * F.coalesce("y1", "y0")) - F.col("a0") / F.sqrt(F.col("x0") * F.col("y0"))
    cell = lambda r, c: F.struct(F.col(r).alias("row"), F.col(c).alias("col"))
    cells = F.when(F.col("y1").isNull(), F.array(cell("row", "col"), cell("col", "row"))).otherwise(F.array(cell("row", "col")))
    d = materialise(rows.select("cand_id", change.alias("value"), F.explode(cells).alias("at")).select("cand_id", "at.row", "at.col", "value"), "delta")
    xs, hs = base.names("x"), base.names("h")
    near = base.rows.select(F.col("node").alias("col"), *xs, *hs)
    times = lambda cols: [(F.col("value") * F.col(c)).alias(c) for c in cols]
    first = d.join(near, "col").select("cand_id", F.col("row").alias("node"), *times(xs + hs))  # D X and D H
    first = materialise(first.groupBy("cand_id", "node").agg(*(F.sum(c).alias(c) for c in xs + hs)), "delta-x")
    dx = first.select("cand_id", F.col("node").alias("col"), *xs)
    on = lambda m, *by: m.join(dx, [*by, "col"]).select("cand_id", F.col("row").alias("node"), *times(xs))
    dz = first.select("cand_id", "node", *hs).union(on(base.norm)).union(on(d, "cand_id"))
    dz = dz.groupBy("cand_id", "node").agg(*(F.sum(c).alias(c) for c in hs))
    add = lambda i: F.coalesce(F.col(f"_z{i}") + F.col(f"_h{i}"), f"_z{i}", f"_h{i}").alias(f"_f{i}")
    return dz.join(base.rows.select("node", *base.names("z")), "node", "left").select("cand_id", "node", *(add(i) for i in range(base.width)))


def node_losses(logits: DataFrame, width: int, labels: DataFrame, split: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, loss: minus the log-softmax at the label of each node of a split, from a column a class."""
    j = logits.join(labels.where(F.col("split") == split).select("node", "label"), "node")
    every = F.array(*(f"_f{i}" for i in range(width)))
    j = j.select(*keys, "node", every.alias("all"), F.array_max(every).alias("top"), F.get(every, F.col("label").cast("int")).alias("own"))
    z = F.aggregate(F.filter("all", lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return j.select(*keys, "node", (F.col("top") + F.log(z) - F.col("own")).alias("loss"))


def _pred(width: int) -> Column:
    """``predict_class`` of a row with a column a class."""
    every = F.array(*(F.round(f"_f{i}", 9) for i in range(width)))
    return (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("pred")


def loss_after(base: Propagated, changed: DataFrame, cands: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """cand_id, loss: ``nll_loss`` of every candidate, from the base's and the nodes that ``rescored`` gives."""
    was = materialise(node_losses(base.beside, base.width, labels, split), "losses")
    now = node_losses(_beside(changed, base.width, ("cand_id",)), base.width, labels, split, ("cand_id",))
    moved = now.join(was.withColumnRenamed("loss", "_was"), "node").groupBy("cand_id").agg(F.sum(F.col("loss") - F.col("_was")).alias("more"))
    total = was.agg(F.sum("loss").alias("sum"), F.count("*").alias("n"))
    return cands.select("cand_id").join(moved, "cand_id", "left").crossJoin(F.broadcast(total)).select("cand_id", ((F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("loss"))


def misclassified_after(base: Propagated, changed: DataFrame, cands: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """cand_id, fitness: ``sga_fitness`` of every candidate, likewise."""
    right = labels.where(F.col("split") == split).select("node", "label")
    was = base.beside.select("node", _pred(base.width)).join(right, "node").select("node", (F.col("pred") != F.col("label")).cast("long").alias("_was"))
    was = materialise(was, "wrong")
    now = _beside(changed, base.width, ("cand_id",)).select("cand_id", "node", _pred(base.width)).join(right, "node").select("cand_id", "node", (F.col("pred") != F.col("label")).cast("long").alias("now"))
    moved = now.join(was, "node").groupBy("cand_id").agg(F.sum(F.col("now") - F.col("_was")).alias("more"))
    total = was.agg(F.coalesce(F.sum("_was"), F.lit(0)).alias("sum"))
    return cands.select("cand_id").join(moved, "cand_id", "left").crossJoin(F.broadcast(total)).select("cand_id", (-(F.col("sum") + F.coalesce("more", F.lit(0)))).alias("fitness"))


def attack_report(base: Propagated, changed: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """One row, accuracy and asr, of the one candidate of ``changed``."""
    was = materialise(base.beside.select("node", _pred(base.width)), "before")
    now = materialise(_beside(changed, base.width).select("node", _pred(base.width).alias("_now")), "after")
    now = was.join(now, "node", "left").select("node", F.coalesce("_now", "pred").alias("pred"))
    return accuracy(now, labels, split).crossJoin(attack_success_rate(was, now, labels, split)).select(F.round("accuracy", 6).alias("accuracy"), F.round("asr", 6).alias("asr"))
