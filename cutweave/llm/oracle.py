"""DuckDB SQL of the queries that SQL can express."""

SQL = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.m)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op5_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
        rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT DISTINCT rid, j FROM win JOIN rep USING (h), unnest(range(i, i + 35)) AS r(j)),
        words AS (SELECT rid, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(j)),
        kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN hit USING (rid, j) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)""",
    "op8_decontaminate": r"""
        WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        bl AS (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM bl, unnest(range(1, len(w) - m + 2)) AS r(i)),
        dw AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM bl) AS s, unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m),
        h AS (SELECT dw.rid, dw.i, dw.m, bw.item FROM dw JOIN bw USING (m, win)),
        n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + m)) AS r(j) GROUP BY rid),
        k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)""",
    "op11_spelling": r"""
        WITH RECURSIVE crc AS MATERIALIZED (
            SELECT list(v ORDER BY x) AS t FROM (SELECT x, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x) AS v FROM range(256) AS r(x))),
        run AS (
            SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
        named AS (SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM run),
        hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM named, crc),
        v AS MATERIALIZED (
            SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
            WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
        d AS MATERIALIZED (SELECT w, k, substr(w, 1, k - 1) || substr(w, k + 1) AS s FROM v, unnest(range(1, length(w) + 1)) AS r(k)),
        one AS (SELECT a.w AS x, b.w AS y FROM d a JOIN d b ON a.k = b.k AND a.s = b.s AND a.w <> b.w UNION SELECT d.w, v.w FROM d JOIN v ON v.w = d.s UNION SELECT v.w, d.w FROM d JOIN v ON v.w = d.s),
        best AS (SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS y, max(n) AS m FROM one JOIN v ON v.w = y GROUP BY x),
        f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN y END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON x = v.w),
        up AS (SELECT w, w AS root, 0 AS steps FROM f UNION ALL SELECT up.w, f.form, steps + 1 FROM up JOIN f ON f.w = up.root WHERE f.form IS NOT NULL)
        SELECT w AS word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT w, arg_max(root, steps) AS root FROM up GROUP BY w) USING (w)""",
    "op13_suffix_dedup": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        win AS (SELECT rid, i, md5(array_slice(b, i, i + 399)) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS r(i) WHERE octet_length(b) >= 400),
        hit AS (SELECT rid, i FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
        part AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit)),
        span AS (SELECT rid, min(i) AS s, max(i) + 400 AS e FROM part GROUP BY rid, g),
        piece AS (
            SELECT rid, s AS o, substr(hex(b), 2 * p - 1, 2 * (s - p)) AS x FROM (SELECT rid, s, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 1) AS p FROM span) JOIN d USING (rid)
            UNION ALL SELECT rid, 2147483647, substr(hex(b), 2 * p - 1) FROM (SELECT rid, max(e) AS p FROM span GROUP BY rid) JOIN d USING (rid)),
        kept AS (SELECT rid, string_agg(x, '' ORDER BY o) AS x FROM piece GROUP BY rid),
        gone AS (SELECT rid, sum(e - s) AS n, count(*) AS n_spans FROM span GROUP BY rid)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid) LEFT JOIN gone USING (rid)""",
}
