"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutweave.session import materialise


def _state(edges: DataFrame, keys: list[str]) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _meet(edges: DataFrame, least: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with the least neighbour of their ``u``. The node is an expression on the right, so that Spark deals out the
    minima anew, and not as they were aggregated: a join of two plain shuffles is one whose hot keys it can split."""
    return edges.join(least.select(*keys, F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m"), [*keys, "u"])


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One round on edges (u > v). Large: each larger neighbour of a node goes to the least of its neighbourhood.
    Small: each smaller neighbour, and the node itself, does."""
    if large:
        both = edges.select(*keys, "u", "v").union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = _meet(both, least, keys).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        joined = _meet(edges, least, keys)
        out = joined.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(*keys, "u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def star_components(edges: DataFrame, keys: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """(keys, node, comp): the least node of each node's component, for every node with an edge to another.

    ``edges`` has columns keys, src, dst in either direction; self-loops and rows with a null end are ignored; an
    empty table gives an empty result. Every round is a join and an aggregate with map-side combine, written to the
    shared folder, so no component is ever gathered in one task. Raises if ``max_rounds`` pass without a fixed point.
    """
    keys = list(keys or [])
    e = edges.where("src is not null and dst is not null and src <> dst").select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialise(e, "components")
    state = _state(e, keys)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        e = materialise(_star(_star(e, keys, True), keys, False), "components")
        new = _state(e, keys)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(*keys, F.col("v"), F.col("v")).distinct())
