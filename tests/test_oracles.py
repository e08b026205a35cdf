"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cutweave.jobs.queries import QUERIES
from cutweave.oracles.sql import SQL

#: One of each family by default; CUTWEAVE_ALL=1 runs all.
SOME = ["parse_edge_lines", "csr_to_edges", "node_index", "degree_rank", "edge_split", "ego_features", "apply_edge_changes", "components", "pcg", "reach6", "modularity", "lp_auc", "lpa_fitness", "affected_pairs", "nll_loss", "roulette_select", "repair_duplicates", "elitism", "benchmark_compare", "stream_running_best", "stream_upsert"]
NAMES = sorted(SQL) if os.environ.get("CUTWEAVE_ALL") else SOME


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_entry():
    import __spark_entry__ as entry

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
