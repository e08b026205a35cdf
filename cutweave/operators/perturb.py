"""Perturbations: apply every candidate's change to the graph in one job. All results carry cand_id.

A candidate's changes are small beside the graph. The lists are joined by their keys; Spark broadcasts them where their
size, which it knows from their files, is under its threshold, and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def for_candidates(edges: DataFrame, cands: DataFrame) -> DataFrame:
    """Every edge once for each cand_id of ``cands``: the work is their product, so candidates come in batches."""
    return edges.select("src", "dst").crossJoin(cands.select("cand_id").distinct())


def remove_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """cand_id, src, dst of the edges that survive. ``removed``: cand_id, node; unknown nodes are ignored."""
    gone = removed.select("cand_id", "node").distinct()
    e = for_candidates(edges, removed)
    e = e.join(gone.withColumnRenamed("node", "src"), ["cand_id", "src"], "left_anti")
    return e.join(gone.withColumnRenamed("node", "dst"), ["cand_id", "dst"], "left_anti").select("cand_id", "src", "dst")


def survivors(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """cand_id, node: all nodes that a candidate leaves, isolated ones too."""
    gone = removed.select("cand_id", "node").distinct()
    return nodes.select("node").crossJoin(removed.select("cand_id").distinct()).join(gone, ["cand_id", "node"], "left_anti").select("cand_id", "node")


def _canonical(df: DataFrame, *more: str) -> DataFrame:
    return df.select("cand_id", *more, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def delete_edges(edges: DataFrame, dels: DataFrame) -> DataFrame:
    """cand_id, src, dst without the edges of ``dels`` (cand_id, src, dst, in either direction)."""
    d = _canonical(dels)
    cands = dels.select("cand_id").distinct()
    gone = d.groupBy("src", "dst").agg(F.collect_set("cand_id").alias("_gone"))
    # an edge meets its deletions once, and becomes a row for each candidate only then
    e = edges.select("src", "dst").join(gone, ["src", "dst"], "left").crossJoin(F.broadcast(cands))
    return e.where(~F.coalesce(F.array_contains("_gone", F.col("cand_id")), F.lit(False))).select("cand_id", "src", "dst")


def apply_edge_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Deletes, then adds: an edge that is in both survives. ``changes``: cand_id, op ('del' or 'add'), src, dst."""
    c = _canonical(changes, "op")
    left = for_candidates(edges, changes).join(c.where("op = 'del'").drop("op"), ["cand_id", "src", "dst"], "left_anti").select("cand_id", "src", "dst")
    return left.union(c.where("op = 'add'").select("cand_id", "src", "dst")).distinct()


def rewire_changes(rewires: DataFrame) -> DataFrame:
    """Each rewire (cand_id, pos, node, add_node, remove_node) as a deletion and an addition."""
    change = lambda op, other: F.struct(F.lit(op).alias("op"), F.col("node").alias("src"), F.col(other).alias("dst"))
    return rewires.select("cand_id", F.explode(F.array(change("del", "remove_node"), change("add", "add_node"))).alias("c")).select("cand_id", "c.*")


def apply_rewires(edges: DataFrame, rewires: DataFrame) -> DataFrame:
    return apply_edge_changes(edges, rewire_changes(rewires))


def inject_node(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """cand_id, src, dst with one new node, max + 1, linked to each target of a candidate (cand_id, node)."""
    new = F.broadcast(nodes.agg((F.max("node") + 1).alias("new")))
    links = targets.select("cand_id", "node").distinct().crossJoin(new).select("cand_id", F.col("node").alias("src"), F.col("new").alias("dst"))
    return for_candidates(edges, targets).select("cand_id", "src", "dst").union(links)


def inject_features(features: DataFrame, nodes: DataFrame, row: DataFrame) -> DataFrame:
    """node, feat, value: ``features`` and those of one new node, max + 1 of ``nodes``, from ``row`` (feat, value)."""
    new = F.broadcast(nodes.agg((F.max("node") + 1).alias("node")))
    return features.select("node", "feat", "value").union(row.crossJoin(new).select("node", "feat", "value"))


def decode_genes(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """cand_id, pos, node of genes that are indexes into ``pool`` (idx, node)."""
    return candidates.join(pool.select(F.col("idx").alias("gene"), "node"), "gene").select("cand_id", "pos", "node")
