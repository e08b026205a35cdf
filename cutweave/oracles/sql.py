"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from cutweave.sources.fixtures import FILTERS

SQL: dict[str, str] = {}


def graph(kind: str, e: str = "e") -> str:
    """CTEs: e (src < dst), adj (both ways), n (node), deg (node, degree)."""
    return f"""li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {FILTERS[kind]}),
        {e} AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
        adj AS (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}),
        n AS (SELECT DISTINCT src AS node FROM adj),
        deg AS (SELECT src AS node, count(*) AS degree FROM adj GROUP BY src)"""


def key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def u(*parts: str) -> str:
    return f"(('0x' || substr({key(*parts)}, 1, 8))::BIGINT / 4294967296.0)"


def permuted(i: str, n: str, *parts: str) -> str:
    """Swap-or-not, as in functions/rand.py."""
    y = f"((floor({u(*parts, 'r', chr(39) + 'k' + chr(39))} * {n})::BIGINT - x) % {n} + {n}) % {n}"
    return f"list_reduce(range(16), lambda x, r: CASE WHEN {u(*parts, 'r', f'greatest(x, {y})')} < 0.5 THEN {y} ELSE x END, ({i})::BIGINT)"


def cands(n: int) -> str:
    return f"c AS (SELECT unnest(range({n}))::INTEGER AS cand_id)"


REMOVED = f"{cands(4)}, rm AS (SELECT cand_id, node FROM c, n WHERE {u(chr(39) + 'rm' + chr(39), 'cand_id', 'node')} < 0.1)"
CUT = f"""{REMOVED},
        se AS (SELECT cand_id, src, dst FROM c, e WHERE NOT EXISTS (FROM rm WHERE rm.cand_id = c.cand_id AND (rm.node = src OR rm.node = dst))),
        sn AS (SELECT cand_id, node FROM c, n WHERE NOT EXISTS (FROM rm WHERE rm.cand_id = c.cand_id AND rm.node = n.node)),
        sa AS (SELECT cand_id, src, dst FROM se UNION ALL SELECT cand_id, dst, src FROM se)"""
COMPS = f"{graph('sparse')}, {CUT}, r(cand_id, node, m) AS (SELECT cand_id, node, node FROM sn UNION SELECT r.cand_id, r.node, sa.dst FROM r JOIN sa ON sa.cand_id = r.cand_id AND sa.src = r.m), comp AS (SELECT cand_id, node, min(m) AS comp FROM r GROUP BY ALL)"
SIZES = f"{COMPS}, size AS (SELECT cand_id, comp, count(*) AS size FROM comp GROUP BY ALL)"


def changes(table: str, pop: int = 3) -> str:
    """ch: the changes of fixture edge_changes over an edge table, and th, its distance-two pairs."""
    k = ("cand_id", "src", "dst")
    return f"""cc AS (SELECT unnest(range({pop}))::INTEGER AS cand_id),
        ca AS (SELECT src, dst FROM {table} UNION ALL SELECT dst, src FROM {table}),
        th AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM ca a JOIN ca b ON a.src = b.src AND a.dst < b.dst),
        ch AS (SELECT cand_id, 'del' AS op, src, dst FROM cc, {table} WHERE {u("'del'", *k)} < 0.05
               UNION ALL SELECT cand_id, 'add', src, dst FROM cc, th WHERE {u("'add'", *k)} < 0.02)"""


BRAND = "regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER"
LAB = f"""lab AS (SELECT p_partkey AS node, {BRAND} % 5 AS label, CASE WHEN {u("'split'", 'p_partkey')} < 0.4 THEN 'train' WHEN {u("'split'", 'p_partkey')} < 0.6 THEN 'val' ELSE 'test' END AS split FROM part)"""
FEAT = f"feat AS (SELECT p_partkey AS node, unnest([floor((p_size - 1) / 10)::INTEGER, {BRAND} + 5]) AS feat, 1.0::DOUBLE AS value FROM part)"
WTS = f"wt AS (SELECT feat, class, {u(chr(39) + 'w' + chr(39), 'feat', 'class')} - 0.5 AS w FROM (SELECT DISTINCT feat FROM feat), (SELECT unnest(range(5))::INTEGER AS class))"
BRANDS = f"cb AS (SELECT p_partkey AS node, {BRAND}::BIGINT AS comm FROM part)"
TYPES = "ct AS (SELECT p_partkey AS node, ('0x' || substr(md5(p_type), 1, 6))::BIGINT AS comm FROM part)"
NORM = """pn AS (SELECT p_partkey AS node FROM part), al AS (SELECT src, dst FROM adj UNION ALL SELECT node, node FROM pn),
        dl AS (SELECT src AS node, count(*) AS d FROM al GROUP BY src),
        norm AS (SELECT al.src AS row, al.dst AS col, x.d ** -0.5 * y.d ** -0.5 AS value FROM al JOIN dl x ON x.node = al.src JOIN dl y ON y.node = al.dst)"""
LOGITS = f"""{graph('all')}, {LAB}, {FEAT}, {WTS}, {NORM},
        z0 AS (SELECT node, class, sum(value * w) AS x FROM feat JOIN wt USING (feat) GROUP BY ALL),
        z1 AS (SELECT row AS node, class, sum(value * x) AS x FROM norm JOIN z0 ON z0.node = col GROUP BY ALL),
        z AS (SELECT row AS node, class, sum(value * x) AS logit FROM norm JOIN z1 ON z1.node = col GROUP BY ALL),
        pred AS (SELECT node, class AS pred FROM z QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(logit, 9) DESC, class) = 1),
        pred0 AS (SELECT node, class AS pred FROM z0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(x, 9) DESC, class) = 1)"""
HOMO = f"""{graph('all')}, {LAB},
        hs AS (SELECT src AS node, count(*) AS degree, count(*) FILTER (x.label = y.label) AS same FROM adj JOIN lab x ON x.node = src JOIN lab y ON y.node = dst GROUP BY src),
        hd AS (SELECT node, coalesce(degree, 0) AS degree, coalesce(same, 0) AS same FROM lab LEFT JOIN hs USING (node)),
        homo AS (SELECT *, CASE WHEN degree = 0 THEN 0.0 ELSE same / degree END::DOUBLE AS homophily, CASE WHEN degree = 0 THEN 0.0 ELSE same / (degree * degree + degree) END::DOUBLE AS decrease, same / ((degree + 1) * (degree + 1) + degree + 1) AS attached FROM hd)"""
SPLIT = f"""{graph('disc')},
        hk AS (SELECT src, dst, {key('5', 'src', 'dst')} AS k FROM e),
        sp AS (SELECT src, dst, row_number() OVER (ORDER BY k) <= floor(0.2 * (SELECT count(*) FROM hk)) AS is_test FROM hk),
        train AS (SELECT src, dst FROM sp WHERE NOT is_test), test AS (SELECT src, dst FROM sp WHERE is_test)"""


def ra(table: str, out: str = "ra", keys: str = "") -> str:
    k = keys + ", " if keys else ""
    j = f" AND a.{keys} = b.{keys}" if keys else ""
    return f"""ra_{out} AS (SELECT {k}src, dst FROM {table} UNION ALL SELECT {k}dst, src FROM {table}),
        rd_{out} AS (SELECT {k}src AS w, count(*) AS degree FROM ra_{out} GROUP BY ALL),
        {out} AS (SELECT {'a.' + k if keys else ''}a.dst AS src, b.dst AS dst, sum(1.0 / degree) AS score FROM ra_{out} a JOIN ra_{out} b ON a.src = b.src AND a.dst < b.dst{j} JOIN rd_{out} d ON d.w = a.src{' AND d.' + keys + ' = a.' + keys if keys else ''} GROUP BY ALL)"""


RUNS = """runs AS (SELECT 'alg' || user_id % 5 || '|ds' || user_id % 7 || '|' || event_type AS run_id, (props ->> '$.k')::BIGINT AS fitness, value AS iter_ms,
        row_number() OVER (PARTITION BY user_id % 5, user_id % 7, event_type ORDER BY ts, event_id)::INTEGER AS generation FROM events)"""
CALLS = """calls AS (SELECT event_id AS call_id, (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 3600 AS iter, user_id % 8 AS worker, value AS compute_ms, (props ->> '$.k')::DOUBLE AS overhead_ms, event_type = 'error' AS failed, user_id % 3 AS retries FROM events)"""
REPORTS = """ev AS (SELECT user_id, date_trunc('hour', ts) AS hr, min((props ->> '$.k')::DOUBLE) AS best_fitness, round(sum(value) / 1000, 6) AS iter_seconds, round(avg(value), 6) AS ms, count(*) AS n FROM events GROUP BY ALL),
        rep AS (SELECT user_id || '-' || strftime(hr, '%Y%m%d%H') AS run_id, 'alg' || user_id % 5 AS algorithm_id, 'ds' || user_id % 7 AS dataset, CASE WHEN n % 2 = 0 THEN 'S' ELSE 'M' END AS resolved_mode, user_id % 2 = 0 AS remote, best_fitness, iter_seconds, CASE WHEN user_id % 11 <> 0 THEN ms END AS iter_avg_ms, hr AS started_at FROM ev),
        repk AS (SELECT *, concat_ws('|', algorithm_id, dataset, resolved_mode, CASE WHEN remote THEN '1' ELSE '0' END) AS key FROM rep),
        seen AS (SELECT *, min(iter_avg_ms) OVER b AS ms0, min(iter_seconds) OVER b AS s0, min(iter_avg_ms) OVER a AS ms1, min(iter_seconds) OVER a AS s1 FROM repk
                 WINDOW b AS (PARTITION BY key ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY key ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING)),
        cmp AS (SELECT *, CASE WHEN iter_avg_ms IS NOT NULL AND ms0 > 0 THEN 'ms' WHEN iter_seconds IS NOT NULL AND s0 > 0 THEN 's' END AS unit, CASE WHEN iter_avg_ms IS NOT NULL AND ms0 > 0 THEN (iter_avg_ms - ms0) / ms0 WHEN iter_seconds IS NOT NULL AND s0 > 0 THEN (iter_seconds - s0) / s0 END AS ratio FROM seen)"""
EPOP = "ep AS (SELECT user_id::INTEGER AS cand_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS pos, event_id AS gene FROM events)"
NAT = "f AS (SELECT c_nationkey::INTEGER AS cand_id, count(*)::DOUBLE AS fitness FROM customer GROUP BY ALL)"


def pop(n: int, p: int = 8, b: int = 12) -> str:
    return f"pp AS (SELECT cand_id, pos, floor({u(chr(39) + 'pop' + chr(39), 'cand_id', 'pos')} * {n})::BIGINT AS gene FROM (SELECT unnest(range({p}))::INTEGER AS cand_id), (SELECT unnest(range({b}))::INTEGER AS pos))"


IDX = "idx AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n)"
RANK = "rk AS (SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM deg)"
LOOPED = "lo AS (SELECT least(l_partkey, l_suppkey * 3) AS src, greatest(l_partkey, l_suppkey * 3) AS dst, l_returnflag AS f FROM lineitem)"
HIST = lambda parity: f"(SELECT user_id * 10 + length(event_type) AS id, max(event_id) AS created_at, arg_max(value, event_id) AS best_score FROM events WHERE event_id % 2 = {parity} GROUP BY ALL)"

# A
SQL["parse_edge_lines"] = f"WITH {graph('sparse')} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, src AS src_id, dst AS dst_id FROM e UNION ALL SELECT 'n' || n_nationkey, '5', NULL, NULL FROM nation"
SQL["csv_edges"] = f"WITH {graph('sparse')} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM e"
SQL["parse_adjlist"] = f"WITH {graph('sparse')} SELECT src AS node, dst AS nbr FROM adj UNION ALL SELECT -n_nationkey - 1, NULL FROM nation"
SQL["parse_gml"] = f"WITH {graph('sparse')} SELECT 'node' AS kind, node AS a, node % 9 AS b, 'p' || node AS label FROM n UNION ALL SELECT 'edge', src, dst, NULL FROM e"
SQL["adjacency_to_edges"] = f"WITH {graph('all')} SELECT src, dst, 1.0::DOUBLE AS value FROM adj"
SQL["csr_to_edges"] = f"WITH {graph('sparse')} SELECT src, dst, 1.0::DOUBLE AS value FROM adj"
SQL["labelled_graph_stats"] = f"WITH {graph('all')}, {LAB}, {FEAT} SELECT count(*) AS n_nodes, max(label)::BIGINT + 1 AS n_classes, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, (SELECT max(feat)::BIGINT + 1 FROM feat) AS n_feats, (SELECT count(*) FROM adj) AS n_edges FROM lab"
SQL["node_split"] = f"WITH k AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {key('7', 'p_partkey')}) AS r, count(*) OVER () AS n FROM part) SELECT node, CASE WHEN r <= floor(0.1 * n) THEN 'train' WHEN r <= floor(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM k"
REG = "reg AS (SELECT p_brand AS name, count(*) AS nodes, min(p_type) AS task, max(p_type) AS top FROM part GROUP BY p_brand)"
SQL["list_datasets"] = f"WITH {REG} SELECT name, task, nodes, CASE WHEN nodes % 2 = 0 THEN task || ',' || top || '+' ELSE task END AS tasks FROM reg"
SQL["datasets_for"] = f"WITH {REG} SELECT name, nodes FROM reg WHERE name IN (SELECT p_brand FROM part WHERE p_size % 5 = 1)"
SQL["report_roundtrip"] = f"WITH {REPORTS} SELECT strftime(started_at, '%Y%m%d') AS day, count(*) AS runs, round(sum(iter_seconds), 6) AS seconds FROM rep GROUP BY 1"
# B
SQL["canonical_edges"] = f"WITH {LOOPED} SELECT DISTINCT src, dst FROM lo"
SQL["symmetric_edges"] = f"WITH {LOOPED} SELECT src, dst FROM lo UNION SELECT dst, src FROM lo"
SQL["node_index"] = f"WITH {graph('all')}, {IDX} SELECT node AS a, idx AS b, 'node' AS kind FROM idx UNION ALL SELECT x.idx, y.idx, 'edge' FROM e JOIN idx x ON x.node = src JOIN idx y ON y.node = dst"
SQL["graph_stats"] = f"WITH {graph('all')} SELECT (SELECT count(*) FROM n) AS n, count(*) AS m, greatest(1, floor((SELECT count(*) FROM n) * 0.1))::BIGINT AS k, greatest(1, floor((SELECT count(*) FROM n) * 0.25))::BIGINT AS selected_genes FROM e"
SQL["degrees"] = f"WITH {graph('all')} SELECT p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN deg ON node = p_partkey"
SQL["degree_rank"] = f"WITH {graph('all')}, {RANK} SELECT node, degree, round(degree / ((SELECT count(*) FROM n) - 1), 6) AS centrality, rank FROM rk"
MM = "mm AS (SELECT node, CASE WHEN (SELECT max(degree) = min(degree) FROM deg) THEN 1.0 ELSE (degree - (SELECT min(degree) FROM deg)) / (SELECT max(degree) - min(degree) FROM deg) END::DOUBLE AS x FROM deg)"
SQL["minmax_degree"] = f"WITH {graph('all')}, {MM} SELECT node, round(x, 6) AS x FROM mm"
SQL["neighbor_lists"] = f"WITH {graph('all')}, r AS (SELECT src, count(*) AS degree, min(dst) AS lo, max(dst) AS hi FROM adj GROUP BY src) SELECT src AS node, degree, ((dst - lo) * ceil(degree / 50.0)::BIGINT // (hi - lo + 1))::INTEGER AS chunk, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM adj JOIN r USING (src) GROUP BY ALL"
SQL["gene_pool_nodes"] = f"WITH {graph('all')} SELECT node, degree AS n_nbrs, (SELECT count(*) FROM part) - degree - 1 AS n_non_nbrs FROM deg WHERE degree > 0 AND degree < (SELECT count(*) FROM part) - 1"
PICK = lambda seed, nodes: f"pk AS (SELECT DISTINCT a.node, b.node AS nbr FROM {nodes} a, (SELECT unnest([0, 1]) AS r), {nodes} b WHERE b.idx = floor({u(str(seed), 'a.node', 'r', chr(39) + 'non' + chr(39))} * (SELECT count(*) FROM {nodes})) AND a.node <> b.node AND NOT EXISTS (FROM adj WHERE src = a.node AND dst = b.node))"
SQL["non_neighbor_sample"] = f"WITH {graph('all')}, {IDX}, {PICK(11, 'idx')} SELECT node, nbr FROM pk"
SQL["non_edges"] = f"WITH {graph('disc')}, th AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM adj a JOIN adj b ON a.src = b.src AND a.dst < b.dst) SELECT (SELECT count(*) FROM th ANTI JOIN e USING (src, dst)) AS scored, (count(*) * (count(*) - 1) // 2 - (SELECT count(*) FROM e))::BIGINT AS non_edges FROM n"
SQL["non_edges_from"] = f"WITH {graph('all')} SELECT DISTINCT least(a.p_partkey, b.p_partkey) AS src, greatest(a.p_partkey, b.p_partkey) AS dst FROM part a, part b WHERE a.p_partkey % 100 = 0 AND a.p_partkey <> b.p_partkey AND NOT EXISTS (FROM e WHERE e.src = least(a.p_partkey, b.p_partkey) AND e.dst = greatest(a.p_partkey, b.p_partkey))"
SQL["two_hop_pairs"] = f"WITH {graph('disc')} SELECT a.dst AS src, b.dst AS dst, count(*) AS common FROM adj a JOIN adj b ON a.src = b.src AND a.dst < b.dst GROUP BY ALL"
SQL["edge_split"] = f"WITH {SPLIT.replace(graph('disc'), graph('all'))} SELECT src, dst, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM sp"
SQL["edge_set_ops"] = f"WITH {graph('disc', 'x')}, l2 AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {FILTERS['sparse']}), y AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l2 a JOIN l2 b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) SELECT 'union' AS op, * FROM (FROM x UNION FROM y) UNION ALL SELECT 'minus', * FROM (FROM x EXCEPT FROM y) UNION ALL SELECT 'intersect', * FROM (FROM x INTERSECT FROM y)"
EGO = lambda size: f"""h1 AS (SELECT src AS ego, dst AS node, 1 AS hop FROM adj), sh AS (SELECT ego FROM h1 GROUP BY ego HAVING count(*) < {size}),
        h2 AS (SELECT DISTINCT h1.ego, a.dst AS node, 2 AS hop FROM h1 SEMI JOIN sh USING (ego) JOIN adj a ON a.src = h1.node WHERE a.dst <> h1.ego),
        hh AS (FROM h1 UNION ALL (SELECT h2.* FROM h2 ANTI JOIN h1 USING (ego, node))),
        eg0 AS (SELECT ego, node, row_number() OVER (PARTITION BY ego ORDER BY hop, node)::INTEGER AS pos FROM hh QUALIFY pos <= {size}),
        eg AS (FROM eg0 UNION ALL SELECT ego, ego, max(pos) + 1 FROM eg0 GROUP BY ego)"""  # noqa: E731
SQL["ego_sample"] = f"WITH {graph('disc')}, {EGO(6)} SELECT * FROM eg"
SQL["ego_features"] = f"WITH {graph('disc')}, {EGO(5)} SELECT x.ego, x.pos AS i, y.pos AS j, (CASE WHEN x.pos = 1 THEN dy.degree WHEN y.pos = 1 THEN dx.degree ELSE 1 END)::BIGINT AS value FROM eg x JOIN eg y ON x.ego = y.ego JOIN adj ON src = x.node AND dst = y.node JOIN deg dx ON dx.node = x.node JOIN deg dy ON dy.node = y.node UNION ALL SELECT ego, pos, pos, degree FROM eg JOIN deg USING (node)"
WALK = f"""rn AS (SELECT src AS node, dst AS nxt, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS rank, count(*) OVER (PARTITION BY src) AS degree FROM adj),
        wk(start, step, node) AS (SELECT node, 0, node FROM n UNION ALL SELECT start, step + 1, nxt FROM wk JOIN rn ON rn.node = wk.node AND rank = floor({u('3', 'start', 'step + 1')} * degree) WHERE step < 4)"""
SQL["random_walks"] = f"WITH RECURSIVE {graph('all')}, {WALK} SELECT start, step, node FROM wk"
SQL["rwr_subgraph"] = f"WITH RECURSIVE {graph('all')}, {WALK}, fs AS (SELECT start, node, min(step) AS step FROM wk WHERE node <> start GROUP BY ALL) SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY step, node)::INTEGER AS pos FROM fs QUALIFY pos < 4 UNION ALL SELECT node, node, 4 FROM n"
# C
SQL["remove_nodes"] = f"WITH {graph('disc')}, {CUT} SELECT * FROM se"
DEL = "NOT EXISTS (FROM ch WHERE ch.cand_id = cc.cand_id AND op = 'del' AND ch.src = e.src AND ch.dst = e.dst)"
SQL["delete_edges"] = f"WITH {graph('all')}, {changes('e')} SELECT cand_id, src, dst FROM cc, e WHERE {DEL}"
CHANGED = f"cg AS (SELECT cand_id, src, dst FROM cc, e WHERE {DEL} UNION SELECT cand_id, src, dst FROM ch WHERE op = 'add')"
SQL["apply_edge_changes"] = f"WITH {graph('disc')}, {changes('e')}, {CHANGED} SELECT * FROM cg"
REWIRES = lambda seed, out: f"""non AS (SELECT node, node + 1 AS nbr FROM n WHERE node + 1 IN (FROM n) AND NOT EXISTS (FROM adj WHERE src = n.node AND dst = n.node + 1)),
        c3 AS (SELECT unnest(range(3))::INTEGER AS cand_id),
        {out}p AS (SELECT cand_id, pos, node FROM (SELECT cand_id, pos, {permuted('pos', 'nn', str(seed), 'cand_id', chr(39) + 'node' + chr(39))} AS idx FROM c3, (SELECT unnest(range(10))::INTEGER AS pos), (SELECT count(DISTINCT node) AS nn FROM non) WHERE pos < nn) JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT node FROM non)) USING (idx)),
        {out} AS (SELECT cand_id, pos, node, arg_min(nbr, {key(str(seed), 'cand_id', 'node', 'nbr', chr(39) + 'add' + chr(39))}) AS add_node, (SELECT arg_min(dst, {key(str(seed), 'cand_id', 'node', 'dst', chr(39) + 'rem' + chr(39))}) FROM adj WHERE src = {out}p.node) AS remove_node FROM {out}p JOIN non USING (node) GROUP BY ALL)"""  # noqa: E731
SQL["init_rewires"] = f"WITH {graph('disc')}, {REWIRES(2, 'rw')} SELECT cand_id, pos, node, add_node, remove_node FROM rw"
SQL["apply_rewires"] = f"""WITH {graph('disc')}, {REWIRES(2, 'rw')}, fin AS (SELECT cand_id, src, dst FROM c3, e WHERE NOT EXISTS (FROM rw WHERE rw.cand_id = c3.cand_id AND least(node, remove_node) = src AND greatest(node, remove_node) = dst) UNION SELECT cand_id, least(node, add_node), greatest(node, add_node) FROM rw)
        SELECT cand_id, count(*) AS m, sum(src)::BIGINT AS s, sum(dst)::BIGINT AS t FROM fin GROUP BY ALL"""
SQL["inject_node"] = f"WITH {graph('sparse')}, {cands(3)}, t AS (SELECT cand_id, node FROM c, n WHERE {u(chr(39) + 'rm' + chr(39), 'cand_id', 'node')} < 0.02) SELECT cand_id, src, dst FROM (SELECT DISTINCT cand_id FROM t), e UNION ALL SELECT cand_id, node, (SELECT max(node) + 1 FROM n) FROM t"
SQL["decode_genes"] = f"WITH {graph('disc')}, {IDX}, {pop(200)} SELECT cand_id, pos, node FROM pp JOIN idx ON idx.idx = gene"
# D
SQL["components"] = SQL["components_small"] = f"WITH RECURSIVE {COMPS} SELECT * FROM comp"
SQL["pcg_candidates"] = f"WITH RECURSIVE {SIZES} SELECT cand_id, sum(size * (size - 1) // 2)::BIGINT AS pcg FROM size GROUP BY ALL"
SQL["largest_component"] = f"WITH RECURSIVE {SIZES} SELECT cand_id, max(size) AS largest, count(*) AS components FROM size GROUP BY ALL"
SQL["pcg"] = f"""WITH RECURSIVE {graph('sparse')}, {RANK}, k AS (SELECT count(*) AS n, (SELECT count(*) FROM e) AS m, greatest(1, floor(count(*) * 0.1))::BIGINT AS k FROM n),
        g AS (SELECT 0 AS side, node FROM n UNION ALL SELECT 1, node FROM n WHERE node NOT IN (SELECT node FROM rk, k WHERE rank <= k)),
        r(side, node, m) AS (SELECT side, node, node FROM g UNION SELECT r.side, r.node, dst FROM r JOIN adj ON src = r.m JOIN g ON g.side = r.side AND g.node = dst),
        cs AS (SELECT side, c, count(*) AS s FROM (SELECT side, node, min(m) AS c FROM r GROUP BY ALL) GROUP BY ALL)
        SELECT n, m, k, (SELECT sum(s * (s - 1) // 2) FROM cs WHERE side = 0)::BIGINT AS pcg_before, (SELECT sum(s * (s - 1) // 2) FROM cs WHERE side = 1)::BIGINT AS pcg_after FROM k"""
REACH = lambda h: f"{graph('sparse')}, {CUT}, r(cand_id, node, m, d) AS (SELECT cand_id, node, node, 0 FROM sn UNION SELECT r.cand_id, r.node, sa.dst, d + 1 FROM r JOIN sa ON sa.cand_id = r.cand_id AND sa.src = r.m WHERE d < {h}), rc AS (SELECT cand_id, node, count(DISTINCT m) AS reach FROM r GROUP BY ALL)"
SQL["reach6"] = f"WITH RECURSIVE {REACH(6)} SELECT cand_id, max(reach) AS max_reach FROM rc GROUP BY ALL"
SQL["reach9"] = f"WITH RECURSIVE {REACH(9)} SELECT * FROM rc"
SQL["reach17"] = f"WITH RECURSIVE {REACH(17)} SELECT cand_id, max(reach) AS max_reach FROM rc GROUP BY ALL"
QMOD = lambda edges, k="": f"""ce AS (SELECT {k}a.comm AS a, b.comm AS b FROM {edges} JOIN cb a ON a.node = src JOIN cb b ON b.node = dst),
        cx AS (SELECT {k}c, count(*) AS d, sum(i) AS m_c FROM (SELECT {k}a AS c, (a = b)::INT AS i FROM ce UNION ALL SELECT {k}b, 0 FROM ce) GROUP BY ALL),
        cm AS (SELECT {k}count(*) AS m FROM ce GROUP BY ALL)"""  # noqa: E731
SQL["modularity"] = f"WITH {graph('all')}, {BRANDS}, {QMOD('e')} SELECT round(sum(m_c / m - (d / (2 * m)) ** 2), 6) AS q FROM cx, cm"
SQL["q_fitness"] = f"WITH {graph('disc')}, {BRANDS}, {QMOD('e')} SELECT round(sum(m_c / m - (d / (2 * m)) ** 2), 6) AS q, round(exp(-sum(m_c / m - (d / (2 * m)) ** 2)), 6) AS fitness FROM cx, cm"
SQL["modularity_candidates"] = f"WITH {graph('all')}, {CUT}, {BRANDS}, {QMOD('se', 'cand_id, ')} SELECT cand_id, round(sum(m_c / m - (d / (2 * m)) ** 2), 6) AS q FROM cx JOIN cm USING (cand_id) GROUP BY ALL"
LP = ", ".join(f"l{i} AS (SELECT node, comm FROM (SELECT a.src AS node, l.comm, count(*) AS k FROM adj a JOIN l{i - 1} l ON l.node = a.dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY k DESC, comm) = 1)" for i in (1, 2, 3))
SQL["label_propagation"] = f"WITH {graph('all')}, l0 AS (SELECT node, node AS comm FROM n), {LP} SELECT * FROM l3"
SQL["nmi"] = f"WITH {BRANDS}, {TYPES}, t AS (SELECT cb.comm AS x, ct.comm AS y, count(*) / (SELECT count(*) FROM part) AS p FROM cb JOIN ct USING (node) GROUP BY ALL), hx AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT x, sum(p) AS p FROM t GROUP BY x)), hy AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT y, sum(p) AS p FROM t GROUP BY y)), hj AS (SELECT -sum(p * ln(p)) AS h FROM t) SELECT round(2 * (hx.h + hy.h - hj.h) / (hx.h + hy.h), 6) AS nmi FROM hx, hy, hj"
SQL["walk_matrix"] = f"WITH {graph('disc')}, p AS (SELECT src, dst, 1.0 / (degree + 1) AS p FROM adj JOIN deg ON node = src), q AS (FROM p UNION ALL SELECT a.src, b.dst, a.p * b.p FROM p a JOIN p b ON a.dst = b.src) SELECT src AS row, dst AS col, round(sum(p) / 2, 9) AS value FROM q GROUP BY ALL"
SQL["resource_allocation"] = f"WITH {graph('ret')}, {ra('e')} SELECT src, dst, round(score, 6) AS score FROM ra"
SQL["precision_at_l"] = f"WITH {SPLIT}, {ra('train')}, al AS (SELECT a.node AS src, b.node AS dst FROM n a, n b WHERE a.node < b.node), top AS (SELECT al.src, al.dst FROM al ANTI JOIN train USING (src, dst) LEFT JOIN ra USING (src, dst) ORDER BY round(coalesce(score, 0), 9) DESC, al.src, al.dst LIMIT (SELECT count(*) FROM test)) SELECT (SELECT count(*) FROM test) AS l, count(*) AS hits, round(count(*) / (SELECT count(*) FROM test), 6) AS precision FROM top SEMI JOIN test USING (src, dst)"
SQL["lp_auc"] = f"""WITH {SPLIT}, {ra('train')}, neg AS (SELECT round(score, 9) AS s, count(*) AS c FROM ra ANTI JOIN e USING (src, dst) GROUP BY ALL),
        zero AS (SELECT 0.0 AS s, (SELECT count(*) * (count(*) - 1) // 2 FROM n) - (SELECT count(*) FROM e) - (SELECT sum(c) FROM neg) AS c), nn AS (FROM neg UNION ALL FROM zero),
        pos AS (SELECT round(coalesce(score, 0), 9) AS s, count(*) AS k FROM test LEFT JOIN ra USING (src, dst) GROUP BY ALL)
        SELECT round(sum(k * (coalesce((SELECT sum(c) FROM nn WHERE nn.s < pos.s), 0) + coalesce((SELECT sum(c) FROM nn WHERE nn.s = pos.s), 0) / 2)) / sum(k) / (SELECT sum(c) FROM nn), 6) AS auc FROM pos"""
TRAIN_CHANGED = "cg AS (SELECT cand_id, src, dst FROM cc, train WHERE NOT EXISTS (FROM ch WHERE ch.cand_id = cc.cand_id AND op = 'del' AND ch.src = train.src AND ch.dst = train.dst) UNION SELECT cand_id, src, dst FROM ch WHERE op = 'add')"
SQL["lpa_fitness"] = f"""WITH {SPLIT}, {changes('train')}, {TRAIN_CHANGED}, {ra('cg', 'ra', 'cand_id')},
        al AS (SELECT cand_id, a.node AS src, b.node AS dst FROM cc, n a, n b WHERE a.node < b.node),
        sc AS (SELECT al.*, round(coalesce(score, 0), 9) AS score, EXISTS (FROM test t WHERE t.src = al.src AND t.dst = al.dst) AS is_t,
                      (NOT EXISTS (FROM train t WHERE t.src = al.src AND t.dst = al.dst) OR EXISTS (FROM ch WHERE op = 'del' AND ch.cand_id = al.cand_id AND ch.src = al.src AND ch.dst = al.dst))
                      AND NOT EXISTS (FROM ch WHERE op = 'add' AND ch.cand_id = al.cand_id AND ch.src = al.src AND ch.dst = al.dst) AS neg FROM al LEFT JOIN ra USING (cand_id, src, dst)),
        mt AS (SELECT cand_id, max(score) AS mt FROM sc WHERE is_t GROUP BY ALL)
        SELECT cand_id, round(exp(-(avg(score) FILTER (is_t) - avg(score) FILTER (neg AND NOT is_t) - 0.001 * count(*) FILTER (neg AND NOT is_t AND score >= mt))), 6) AS fitness FROM sc JOIN mt USING (cand_id) GROUP BY ALL"""
SQL["affected_pairs"] = f"""WITH {graph('disc')}, {changes('e')}, {CHANGED}, {ra('e', 'r0')}, {ra('cg', 'r1', 'cand_id')},
        both_ AS (SELECT cand_id, src, dst, coalesce(r0.score, 0) AS old, coalesce(r1.score, 0) AS new FROM (SELECT cand_id, src, dst FROM r1 UNION SELECT cand_id, src, dst FROM cc, r0) LEFT JOIN r0 USING (src, dst) LEFT JOIN r1 USING (cand_id, src, dst))
        SELECT cand_id, src, dst, round(old, 6) AS old, round(new, 6) AS new FROM both_ WHERE abs(new - old) > 1e-12"""
SQL["gcn_norm"] = f"WITH {graph('all')}, {NORM} SELECT row, col, round(value, 9) AS value FROM norm"
SQL["feature_row_norm"] = f"WITH {FEAT}, f AS (SELECT node, feat, (feat % 3)::DOUBLE AS value FROM feat) SELECT node, feat, round(CASE WHEN s = 0 THEN 0 ELSE value / s END, 6) AS value FROM f JOIN (SELECT node, sum(value) AS s FROM f GROUP BY ALL) USING (node)"
SQL["propagate2"] = f"WITH {graph('all')}, {FEAT}, {NORM}, x1 AS (SELECT row AS node, feat, sum(norm.value * feat.value) AS value FROM norm JOIN feat ON node = col GROUP BY ALL) SELECT row AS node, feat, round(sum(norm.value * x1.value), 6) AS value FROM norm JOIN x1 ON node = col GROUP BY ALL"
SQL["linear_logits"] = f"WITH {FEAT}, {WTS} SELECT node, class, round(sum(value * w), 6) AS logit FROM feat JOIN wt USING (feat) GROUP BY ALL"
SQL["gcn_forward"] = f"""WITH {LOGITS}, w2 AS (SELECT f AS feat, c AS class, {u(chr(39) + 'w2' + chr(39), 'f', 'c')} - 0.5 AS w FROM (SELECT unnest(range(5))::INTEGER AS f), (SELECT unnest(range(5))::INTEGER AS c)),
        a1 AS (SELECT node, class AS feat, CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END AS x FROM z1), b2 AS (SELECT node, w2.class, sum(x * w) AS x FROM a1 JOIN w2 USING (feat) GROUP BY ALL)
        SELECT row AS node, class, round(sum(value * x), 6) AS logit FROM norm JOIN b2 ON node = col GROUP BY ALL"""
SQL["predict_class"] = f"WITH {LOGITS} SELECT * FROM pred"
SQL["nll_loss"] = f"WITH {LOGITS}, ls AS (SELECT node, ln(sum(exp(logit))) - max(CASE WHEN class = label THEN logit END) AS l FROM z JOIN lab USING (node) WHERE split = 'test' GROUP BY ALL) SELECT round(avg(l), 6) AS loss FROM ls"
SQL["sga_fitness"] = f"WITH {LOGITS} SELECT -count(*) FILTER (pred <> label) AS fitness FROM pred JOIN lab USING (node) WHERE split = 'test'"
SQL["accuracy"] = f"WITH {LOGITS} SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM pred JOIN lab USING (node) WHERE split = 'test'"
SQL["asr"] = f"WITH {LOGITS} SELECT round(avg((a.pred <> b.pred)::INT), 6) AS asr FROM pred0 a JOIN pred b USING (node) JOIN lab USING (node) WHERE split = 'test'"
SQL["homophily"] = f"WITH {HOMO} SELECT node, degree, same, round(homophily, 6) AS homophily, round(decrease, 6) AS decrease, round(attached, 6) AS attached FROM homo"
PROF = "pf AS (SELECT label, feat, count(*) AS n, avg(value) AS mean, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, feat)::INTEGER AS rank FROM feat JOIN lab USING (node) WHERE value <> 0 GROUP BY label, feat)"
SQL["label_feature_profile"] = f"WITH {LAB}, {FEAT}, {PROF} SELECT label, feat, n, round(mean, 6) AS mean, rank FROM pf WHERE rank <= 10"
SQL["injected_features"] = f"WITH {LAB}, {FEAT}, {PROF} SELECT feat, mean AS value FROM pf WHERE label = 2 AND rank <= (SELECT floor(avg(c)) FROM (SELECT count(*) AS c FROM feat WHERE value <> 0 GROUP BY node))"
SQL["degree_budget"] = f"WITH {graph('all')}, d AS (SELECT p_partkey AS node, coalesce(degree, 0) AS d FROM part LEFT JOIN deg ON node = p_partkey), m AS (SELECT floor(sum(d) / count(*))::BIGINT AS mean FROM d) SELECT node, least(CASE WHEN least(d, 2 * (mean + 1)) = 0 THEN mean // 2 ELSE least(d, 2 * (mean + 1)) END, 2 * mean)::BIGINT AS budget FROM d, m"
SQL["potential_edges"] = f"WITH {HOMO} SELECT node, round(decrease, 6) AS decrease, row_number() OVER (ORDER BY round(decrease, 9) DESC, node) AS rank FROM homo JOIN lab USING (node) WHERE lab.label <> 1"
SQL["single_link_rank"] = f"WITH {HOMO}, r AS (SELECT node, (degree % 4)::DOUBLE AS loss, row_number() OVER (ORDER BY degree % 4, round(decrease, 9) DESC, node) AS rank FROM homo) SELECT * FROM r WHERE rank <= floor((SELECT count(*) FROM homo) * 0.3)"
# E
SQL["init_population"] = f"WITH {graph('disc')}, {cands(4)}, k AS (SELECT count(*) AS n FROM n) SELECT cand_id, pos, {permuted('pos', 'k.n', '1', 'cand_id', chr(39) + 'init' + chr(39))} AS gene FROM c, k, (SELECT unnest(range(20))::INTEGER AS pos)"
SQL["draw_population"] = f"WITH {graph('disc')}, {cands(6)}, d AS (SELECT cand_id, floor({u('1', 'cand_id', 'k', chr(39) + 'draw' + chr(39))} * (SELECT count(*) FROM n))::BIGINT AS gene, min(k) AS k FROM c, (SELECT unnest(range(56)) AS k) GROUP BY ALL) SELECT cand_id, (row_number() OVER (PARTITION BY cand_id ORDER BY k) - 1)::INTEGER AS pos, gene FROM d QUALIFY pos < 20".replace("min(k) AS k FROM", "k AS k0 FROM").replace(" GROUP BY ALL) SELECT cand_id, (row_number", "), dd AS (SELECT cand_id, gene, min(k0) AS k FROM d GROUP BY ALL) SELECT cand_id, (row_number").replace("gene FROM d QUALIFY", "gene FROM dd QUALIFY")
TWO = "th AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM adj a JOIN adj b ON a.src = b.src AND a.dst < b.dst), ne AS (SELECT th.* FROM th ANTI JOIN e USING (src, dst))"
NUMBERED = lambda t, out: f"{out} AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS idx, count(*) OVER () AS n FROM {t})"
DRAWN = lambda t, op, seed: f"SELECT cand_id, '{op}' AS op, pos, src, dst FROM (SELECT *, {permuted('pos', 'nn', str(seed), 'cand_id', chr(39) + op + chr(39))} AS idx FROM {op}_at, (SELECT max(n) AS nn FROM {t}) WHERE pos < nn) JOIN {t} USING (idx)"
SQL["init_edge_population"] = f"WITH {graph('disc')}, {TWO}, {cands(3)}, {NUMBERED('e', 'ds')}, {NUMBERED('ne', 'ads')}, m AS (SELECT cand_id, pos, floor({u('4', 'cand_id', chr(39) + 'mix' + chr(39))} * 15) AS n_add FROM c, (SELECT unnest(range(15))::INTEGER AS pos)), add_at AS (FROM m WHERE pos < n_add), del_at AS (FROM m WHERE pos < 15 - n_add) SELECT cand_id, op, src, dst FROM ({DRAWN('ds', 'del', 4)} UNION ALL {DRAWN('ads', 'add', 4)})"
SQL["init_link_population"] = f"WITH {SPLIT}, ta AS (SELECT src, dst FROM train UNION ALL SELECT dst, src FROM train), th AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM ta a JOIN ta b ON a.src = b.src AND a.dst < b.dst), ne AS (SELECT th.* FROM th ANTI JOIN train USING (src, dst)), {cands(3)}, {NUMBERED('train', 'ds')}, {NUMBERED('ne', 'ads')}, add_at AS (SELECT cand_id, pos FROM c, (SELECT unnest(range(10))::INTEGER AS pos)), del_at AS (FROM add_at) {DRAWN('ds', 'del', 4)} UNION ALL {DRAWN('ads', 'add', 4)}"
ROUL = lambda w, kind, out: f"{out}w AS (SELECT cand_id, {w} AS w FROM f), {out}c AS (SELECT cand_id, w, sum(w) OVER (ORDER BY cand_id) AS hi, sum(w) OVER () AS total FROM {out}w), {out} AS (SELECT draw, min(cand_id) AS cand_id, '{kind}' AS kind FROM dr, {out}c WHERE w > 0 AND x * total >= hi - w AND (x * total < hi OR hi = total) GROUP BY draw)"
SQL["roulette_select"] = f"WITH {NAT}, dr AS (SELECT d AS draw, {u('3', 'd', chr(39) + 'sel' + chr(39))} AS x FROM (SELECT unnest(range(200))::INTEGER AS d)), {ROUL('max(fitness) OVER () - fitness', 'shift', 'a')}, {ROUL('fitness', 'raw', 'b')} FROM a UNION ALL FROM b"
SQL["rotary_table"] = f"WITH {NAT}, x AS (SELECT cand_id, (fitness - min(fitness) OVER ()) / (max(fitness) OVER () - min(fitness) OVER ()) AS x FROM f), y AS (SELECT cand_id, x, 'normal' AS pattern FROM x UNION ALL SELECT cand_id, 1 - x, 'inverted' FROM x UNION ALL SELECT cand_id, 1 - x, 'trans' FROM x), z AS (SELECT cand_id, pattern, x / sum(x) OVER (PARTITION BY pattern) AS p FROM y) SELECT cand_id, round(p, 6) AS p, round(sum(p) OVER (PARTITION BY pattern ORDER BY cand_id), 6) AS cumulative, pattern FROM z"
SQL["crossover"] = f"WITH {EPOP} SELECT cand_id, pos, CASE WHEN {u('9', '0', 'cand_id', 'pos', chr(39) + 'x' + chr(39))} < 0.4 THEN gene + 1000000 ELSE gene END AS gene FROM ep"
SQL["mutate"] = f"WITH {EPOP} SELECT cand_id, pos, CASE WHEN {u('9', '0', 'cand_id', 'pos', chr(39) + 'm' + chr(39))} < 0.3 THEN floor({u('9', '0', 'cand_id', 'pos', chr(39) + 'g' + chr(39))} * 777)::BIGINT ELSE gene END AS gene FROM ep"
SQL["edge_mutation"] = f"""WITH {graph('sparse')}, {changes('e')}, dp AS (SELECT 'del' AS top, row_number() OVER (ORDER BY src, dst) - 1 AS idx, src AS s, dst AS d FROM e), ap AS (SELECT 'add' AS top, row_number() OVER (ORDER BY src, dst) - 1 AS idx, src AS s, dst AS d FROM (SELECT th.* FROM th ANTI JOIN e USING (src, dst))), pl AS (FROM dp UNION ALL FROM ap),
        cp AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY op, src, dst)::INTEGER AS pos FROM ch),
        ct AS (SELECT *, {u('6', 'cand_id', 'pos', chr(39) + 'm' + chr(39))} < 0.3 AS hit, CASE WHEN {u('6', 'cand_id', 'pos', chr(39) + 'op' + chr(39))} < 0.5 THEN 'add' ELSE 'del' END AS top FROM cp),
        ci AS (SELECT *, floor({u('6', 'cand_id', 'pos', chr(39) + 'g' + chr(39))} * (SELECT count(*) FROM pl WHERE pl.top = ct.top)) AS idx FROM ct)
        SELECT cand_id, pos, CASE WHEN hit AND s IS NOT NULL THEN ci.top ELSE op END AS op, CASE WHEN hit AND s IS NOT NULL THEN s ELSE src END AS src, CASE WHEN hit AND s IS NOT NULL THEN d ELSE dst END AS dst FROM ci LEFT JOIN pl ON pl.top = ci.top AND pl.idx = ci.idx"""
SQL["rewire_mutation"] = f"""WITH {graph('disc')}, {REWIRES(2, 'rw')}, {REWIRES(8, 'fr').split('),', 2)[2].strip()}, m AS (SELECT rw.*, {u('6', 'rw.cand_id', 'rw.pos', chr(39) + 'm' + chr(39))} < 0.5 AS hit, floor({u('6', 'rw.cand_id', 'rw.pos', chr(39) + 'k' + chr(39))} * 3) AS kind FROM rw)
        SELECT m.cand_id, m.pos, CASE WHEN hit AND kind = 0 AND w.node IS NOT NULL THEN w.node ELSE m.node END AS node,
               CASE WHEN hit AND kind = 0 AND w.node IS NOT NULL THEN w.add_node WHEN hit AND kind = 1 AND q.node IS NOT NULL THEN q.add_node ELSE m.add_node END AS add_node,
               CASE WHEN hit AND kind = 0 AND w.node IS NOT NULL THEN w.remove_node WHEN hit AND kind = 2 AND q.node IS NOT NULL THEN q.remove_node ELSE m.remove_node END AS remove_node
        FROM m LEFT JOIN fr w ON w.cand_id = m.cand_id AND w.pos = m.pos LEFT JOIN fr q ON q.cand_id = m.cand_id AND q.node = m.node"""
UNUSED = lambda wanted, pop, n, out, *parts: f"""{out} AS (SELECT cand_id, gene, j FROM (SELECT cand_id, j, {permuted('j', 'nn', *parts)} AS gene FROM (SELECT cand_id, nn, unnest(range(least(k, nn))) AS j FROM {wanted}, (SELECT {n} AS nn))) ANTI JOIN {pop} USING (cand_id, gene))"""
REPAIR = lambda pop_sql, n, seed: f"""p AS ({pop_sql}), q AS (SELECT *, row_number() OVER (PARTITION BY cand_id, gene ORDER BY pos) AS k FROM p),
        ho AS (SELECT cand_id, pos, gene, row_number() OVER (PARTITION BY cand_id ORDER BY pos) AS i FROM q WHERE k > 1),
        wa AS (SELECT cand_id, count(*) AS k FROM q GROUP BY cand_id HAVING max(k) > 1), {UNUSED('wa', 'p', n, 'un', str(seed), '0', 'cand_id', chr(39) + 'rep' + chr(39))},
        fe AS (SELECT cand_id, gene AS g, row_number() OVER (PARTITION BY cand_id ORDER BY j) AS i FROM un),
        fx AS (SELECT cand_id, pos, gene FROM q WHERE k = 1 UNION ALL SELECT cand_id, pos, coalesce(g, gene) FROM ho LEFT JOIN fe USING (cand_id, i))"""  # noqa: E731
SQL["repair_duplicates"] = f"WITH {EPOP}, {REPAIR('SELECT cand_id, pos, gene % 15 AS gene FROM ep', '(SELECT count(DISTINCT s_suppkey % 40) FROM supplier)', 2)} SELECT * FROM fx"
SQL["resolve_conflicts"] = f"""WITH {EPOP}, {REPAIR('SELECT cand_id, pos, gene % 4 AS gene FROM ep', '(SELECT count(DISTINCT s_suppkey % 12) FROM supplier)', 2)},
        st AS (SELECT cand_id, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS s, count(*) + 1 AS k FROM fx GROUP BY ALL), du AS (SELECT cand_id, k FROM st QUALIFY row_number() OVER (PARTITION BY s ORDER BY cand_id) > 1),
        {UNUSED('du', 'fx', '(SELECT count(DISTINCT s_suppkey % 12) FROM supplier)', 'lack', '2', 'cand_id', chr(39) + 'conf' + chr(39))}, nw AS (SELECT cand_id, arg_min(gene, j) AS g FROM lack GROUP BY cand_id)
        SELECT cand_id, pos, CASE WHEN pos = 0 AND g IS NOT NULL THEN g ELSE gene END AS gene FROM fx LEFT JOIN nw USING (cand_id)"""
SQL["de_mutation"] = f"WITH {EPOP}, x AS (SELECT cand_id, pos, gene % 100 / 100 AS x FROM ep) SELECT cand_id, pos, round(least(1.0, greatest(0.0, x + 0.5 * (x * x - (1 - x)))), 6) AS x FROM x"
SQL["encode_genotype"] = f"WITH {graph('disc')}, {IDX}, {MM}, {pop(200)} SELECT cand_id, pos, round(x, 6) AS x FROM pp JOIN idx ON idx.idx = gene JOIN mm USING (node)"
SQL["eda_resample"] = f"""WITH {EPOP}, p AS (SELECT cand_id, pos, gene % 50 AS gene FROM ep), f AS (SELECT cand_id, (sum(gene) % 97)::DOUBLE AS fitness FROM p GROUP BY ALL), dr AS (SELECT d AS draw, {u('4', 'd', chr(39) + 'sel' + chr(39))} AS x FROM (SELECT unnest(range(15))::INTEGER AS d)), {ROUL('fitness - min(fitness) OVER ()', 'x', 'a')},
        k AS (SELECT gene, count(*) AS w FROM a JOIN p USING (cand_id) GROUP BY ALL), c AS (SELECT unnest(range(5))::INTEGER AS cand_id)
        SELECT cand_id, (row_number() OVER (PARTITION BY cand_id ORDER BY -ln(1 - {u('4', 'cand_id', 'gene', chr(39) + 'eda' + chr(39))}) / w, gene) - 1)::INTEGER AS pos, gene FROM c, k QUALIFY pos < 8"""
SQL["elitism"] = f"WITH {NAT}, b AS (SELECT 0 AS origin, * FROM f UNION ALL SELECT 1, s_nationkey::INTEGER, (count(*) * 14)::DOUBLE FROM supplier GROUP BY ALL) SELECT *, (row_number() OVER (ORDER BY fitness, origin, cand_id) - 1)::INTEGER AS rank FROM b QUALIFY rank < 20"
SQL["sga_elitism"] = f"""WITH {HOMO}, {pop(200, 12, 5)}, f AS (SELECT cand_id, floor(sum(gene) / 200)::DOUBLE AS fitness FROM pp GROUP BY ALL), el AS (SELECT (cand_id >= 6)::INTEGER AS origin, cand_id, fitness, (row_number() OVER (ORDER BY fitness, cand_id >= 6, cand_id) - 1)::INTEGER AS rank FROM f QUALIFY rank < 8),
        s AS (SELECT cand_id, round(sum(decrease), 6) AS score FROM pp JOIN homo ON homo.node = gene GROUP BY ALL), j AS (SELECT el.*, coalesce(score, 0) AS score, fitness = (SELECT arg_min(fitness, rank) FROM el) AS top FROM el LEFT JOIN s USING (cand_id))
        SELECT origin, cand_id, fitness, rank, score, top AND row_number() OVER (PARTITION BY top ORDER BY score, rank) = 1 AS best FROM j"""
FILL = lambda size: f"re AS (SELECT node, (SELECT count(*) FROM ch0) + row_number() OVER (ORDER BY rank) - 1 AS idx FROM rk ANTI JOIN ch0 USING (node) QUALIFY idx < {size}), al AS (SELECT node, idx FROM ch0 UNION ALL SELECT node, idx FROM re)"
SQL["gene_pool_cutoff"] = f"WITH {graph('disc')}, {IDX}, {RANK}, {pop(60)}, ch0 AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) - 1 AS idx FROM pp JOIN idx ON idx.idx = gene GROUP BY node QUALIFY row_number() OVER (ORDER BY count(*) DESC, node) <= 25), {FILL(50)} SELECT node, idx FROM al"
SQL["random_cutoff"] = f"WITH {graph('all')} SELECT node, row_number() OVER (ORDER BY {key('3', 'node', chr(39) + 'pool' + chr(39))}) - 1 AS idx FROM n QUALIFY idx < 40"
SQL["reach_cutoff"] = f"WITH RECURSIVE {graph('sparse')}, {RANK}, r(node, m, d) AS (SELECT node, node, 0 FROM n UNION SELECT r.node, dst, d + 1 FROM r JOIN adj ON src = r.m WHERE d < 9), rc AS (SELECT node, count(DISTINCT m) AS reach FROM r GROUP BY ALL), ch0 AS (SELECT node, row_number() OVER (ORDER BY reach DESC, node) - 1 AS idx FROM rc QUALIFY idx < 20), {FILL(40)} SELECT node, idx FROM al"
SQL["community_edge_pools"] = f"WITH {graph('disc')}, {BRANDS}, ix AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM cb), {PICK(3, 'ix')}, bt AS (SELECT DISTINCT least(node, nbr) AS src, greatest(node, nbr) AS dst FROM pk) SELECT 'inside' AS kind, src, dst FROM e JOIN cb a ON a.node = src JOIN cb b ON b.node = dst WHERE a.comm = b.comm UNION ALL SELECT 'between', src, dst FROM bt JOIN cb a ON a.node = src JOIN cb b ON b.node = dst WHERE a.comm <> b.comm"
# G
SQL["running_best"] = f"WITH {RUNS} SELECT run_id, generation, fitness, min(fitness) OVER (PARTITION BY run_id ORDER BY generation) AS best FROM runs"
SQL["best_metrics"] = f"WITH {RUNS} SELECT run_id, generation, fitness, round(iter_ms, 6) AS iter_ms FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY fitness, generation) = 1"
SQL["curves"] = f"WITH {RUNS} SELECT run_id, string_agg(fitness::VARCHAR, ',' ORDER BY generation) AS fitness, count(*) AS n FROM runs GROUP BY run_id"
SQL["run_summary"] = f"WITH {RUNS} SELECT run_id, count(*) AS iterations, round(sum(iter_ms) / 1000, 6) AS seconds, round(sum(iter_ms) / count(*), 6) AS avg_ms, round(count(*) / (sum(iter_ms) / 1000), 6) AS throughput FROM runs GROUP BY run_id"
SQL["load_run_reports"] = f"WITH {REPORTS} SELECT * EXCLUDE (started_at) FROM rep"
SQL["run_trends"] = f"WITH {REPORTS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY started_at DESC, run_id DESC) AS k FROM repk QUALIFY k <= 5) SELECT key, count(*) AS runs, round(avg(iter_avg_ms), 6) AS mean_ms, round(avg(best_fitness), 6) AS mean_fitness, 0::BIGINT AS regressions, arg_min(run_id, k) AS last_run FROM l GROUP BY key"
SQL["benchmark_compare"] = f"WITH {REPORTS} SELECT run_id, key, unit, round(ratio, 6) AS ratio, coalesce(ratio > 0.25, false) AS regressed, round(ms1, 6) AS best_iter_avg_ms, round(s1, 6) AS best_iter_seconds, iter_avg_ms AS last_iter_avg_ms, iter_seconds AS last_iter_seconds FROM cmp"
SQL["trends_with_regressions"] = f"WITH {REPORTS} SELECT key, count(*) AS runs, count(*) FILTER (ratio > 0.25) AS regressions FROM (FROM cmp QUALIFY row_number() OVER (PARTITION BY key ORDER BY started_at DESC, run_id DESC) <= 20) GROUP BY key"
SQL["upsert_history"] = f"SELECT * FROM (SELECT 0 AS o, * FROM {HIST(0)} UNION ALL SELECT 1, * FROM {HIST(1)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, o DESC) = 1".replace("SELECT * FROM (SELECT 0", "SELECT id, created_at, best_score FROM (SELECT 0", 1)
SQL["page_history"] = f"SELECT * FROM {HIST('event_id % 2')} ORDER BY created_at, id LIMIT 20 OFFSET 40"
SQL["delete_history"] = f"SELECT * FROM {HIST(0)} WHERE id NOT IN (SELECT id FROM {HIST(1)} WHERE id % 3 = 0)"
SQL["latest_state"] = "SELECT user_id % 5 AS algorithm, event_type AS dataset, event_id AS task_id, floor(value)::BIGINT AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY algorithm, dataset ORDER BY floor(value) DESC, event_id DESC) = 1"
SQL["resource_rows"] = "SELECT user_id AS server, round(avg(value), 4) AS cpu, max(value) AS memory, count(*) AS gpu_count, round(avg((props ->> '$.k')::DOUBLE) FILTER (event_type <> 'error'), 6) AS gpu_util FROM events GROUP BY user_id"
SQL["comm_stats"] = f"WITH {CALLS}, o AS (SELECT worker AS rank, CASE WHEN failed THEN 'reduce' ELSE 'gather' END AS op, compute_ms AS ms FROM calls) SELECT rank, op, round(sum(ms), 4) AS total, count(*) AS calls, round(avg(ms), 6) AS avg FROM o GROUP BY ROLLUP (rank, op)"
SQL["comm_overall"] = f"WITH {CALLS} SELECT round(avg(compute_ms), 6) AS avg, count(*) AS calls FROM calls WHERE worker <> 0"
ITERS = f"{CALLS}, it AS (SELECT iter, sum(compute_ms) AS compute, sum(overhead_ms) AS overhead, max(compute_ms) AS max_compute, max(overhead_ms) AS max_overhead, count(DISTINCT worker) AS workers, count(*) AS calls FROM calls GROUP BY iter)"
SQL["iteration_stats"] = f"WITH {ITERS} SELECT iter, round(compute, 4) AS compute, round(overhead, 4) AS overhead, max_compute, max_overhead, workers, calls FROM it"
SQL["overhead_guard"] = f"WITH {ITERS}, w AS (SELECT iter, sum(overhead) OVER g / sum(compute) OVER g AS ratio, sum(calls) OVER g AS n FROM it WINDOW g AS (ORDER BY iter ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT iter, round(ratio, 6) AS ratio, ratio > 1.0 AND n >= 8 AS tripped FROM w"
SQL["stragglers"] = f"WITH {CALLS}, t AS (SELECT iter, worker, sum(compute_ms + overhead_ms) AS total FROM calls GROUP BY ALL), m AS (SELECT iter, median(total) AS median FROM t WHERE total > 0 GROUP BY iter HAVING count(*) >= 2) SELECT iter, worker, round(total, 4) AS total, round(median, 4) AS median FROM t JOIN m USING (iter) WHERE total > greatest(50.0, 1.5 * median)"
SQL["recovery_percentiles"] = f"WITH {CALLS}, r AS (SELECT worker, overhead_ms AS v, row_number() OVER (PARTITION BY worker ORDER BY overhead_ms) - 1 AS r, count(*) OVER (PARTITION BY worker) AS n FROM calls WHERE failed AND overhead_ms IS NOT NULL) SELECT worker, max(v) FILTER (r = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95, max(v) AS max FROM r GROUP BY worker"
SQL["transport_rates"] = f"WITH {CALLS} SELECT worker, round(avg(failed::INT), 6) AS failure_rate, round(avg(retries), 6) AS retries_per_call, round(avg(overhead_ms) FILTER (failed), 6) AS mean_recovery FROM calls GROUP BY worker"
SQL["worker_stats"] = f"WITH {CALLS}, l AS (SELECT worker, 'compute_ms' AS phase, compute_ms AS ms FROM calls UNION ALL SELECT worker, 'overhead_ms', overhead_ms FROM calls), g AS (SELECT worker, phase, sum(ms) AS total, avg(ms) AS avg FROM l GROUP BY ALL) SELECT worker, phase, round(total, 4) AS total, round(avg, 6) AS avg, round(total / sum(total) OVER (PARTITION BY worker), 6) AS share FROM g"
SQL["export_report"] = f"""WITH {RUNS}, b AS (SELECT run_id, fitness, generation FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY fitness, generation) = 1), g AS (SELECT run_id, count(*) AS k, string_agg(fitness::VARCHAR, ',' ORDER BY generation) AS h, sum(iter_ms) AS t FROM runs GROUP BY ALL)
        SELECT run_id, '{{"best_fitness":' || b.fitness || ',"generation":' || b.generation || ',"iterations":' || k || ',"history":[' || h || ']}}' AS report, round(t / 1000, 6) AS seconds, round(t / k, 6) AS avg_ms FROM g JOIN b USING (run_id)"""
# H
SQL["stream_observer"] = f"WITH {RUNS} SELECT run_id, generation, fitness::DOUBLE AS fitness FROM runs"
SQL["stream_running_best"] = f"WITH {RUNS} SELECT run_id, min(fitness)::DOUBLE AS best, max(generation) AS generation FROM runs GROUP BY run_id"
SQL["stream_resource_windows"] = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y%m%d%H') AS start, 's' || user_id % 4 AS server, count(*) AS n, round(avg(value), 6) AS cpu, round(avg(value / 2), 6) AS memory, round(avg((props ->> '$.k')::DOUBLE), 6) AS gpu FROM events GROUP BY ALL"
SQL["stream_upsert"] = "SELECT user_id * 10 + length(event_type) AS id, max(event_id) AS created_at, arg_max(value, event_id) AS best_score FROM events GROUP BY ALL"
