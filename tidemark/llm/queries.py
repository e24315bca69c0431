"""The named queries of this package and, where SQL can express one, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import op9_decontaminate
from tidemark.llm.filter_audit import op12_filter_audit
from tidemark.llm.isolation import op4_isolation_rules
from tidemark.llm.katz import op13_katz
from tidemark.llm.neardup import op7_minhash
from tidemark.llm.packing import op6_packing
from tidemark.llm.pii import op5_pii
from tidemark.llm.prefix_trie import op11_prefix_trie
from tidemark.llm.quality_cnn import op10_quality_cnn
from tidemark.llm.sharding import op2_sharding
from tidemark.llm.substrings import op1_substring_dedup
from tidemark.llm.token_files import op8_token_files
from tidemark.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_sharding,
        op3_toxicity,
        op4_isolation_rules,
        op5_pii,
        op6_packing,
        op7_minhash,
        op8_token_files,
        op9_decontaminate,
        op10_quality_cnn,
        op11_prefix_trie,
        op12_filter_audit,
        op13_katz,
    )
}

#: of the other queries, SQL cannot express models, tokenizers or placements; they are tested against brute force
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM win) WHERE first_doc < doc_id
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
    """,
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)
), reach AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), top AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(top.y, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(top.y, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN top ON top.x = w.doc_id
    """,
    "op9_decontaminate": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
  FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS its
  FROM benchmark
), i AS (  -- of 13 tokens with two changed, four neighbours are whole; of 8 to 12 with one changed as well
  SELECT *, row_number() OVER () AS n, CASE WHEN len(its) < 8 THEN len(its) ELSE 4 END AS g, least(len(its), 13) AS width,
         CASE WHEN len(its) >= 13 THEN 2 WHEN len(its) >= 8 THEN 1 ELSE 0 END AS may
  FROM b WHERE len(its) > 0
), item_grams AS (
  SELECT n, g, p, array_to_string(its[p:p + g - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(its) - g + 2)) AS p FROM i)
), doc_grams AS (
  SELECT r, g, p, array_to_string(ts[p:p + g - 1], ' ') AS gram
  FROM (SELECT r, ts, g, unnest(range(1, len(ts) - g + 2)) AS p FROM d, (SELECT DISTINCT g FROM i))
), diagonals AS (
  SELECT DISTINCT r, n, x.p - y.p AS diagonal FROM doc_grams x JOIN item_grams y USING (g, gram)
), aligned AS (
  SELECT r, n, diagonal, greatest(0, -diagonal) AS low, width, may, len(its) AS length,
         list_transform(range(greatest(0, -diagonal), least(len(its), len(ts) - diagonal)), lambda k: CASE WHEN ts[k + diagonal + 1] = its[k + 1] THEN 1 ELSE 0 END) AS eq
  FROM diagonals JOIN d USING (r) JOIN i USING (n)
), good AS (
  SELECT *, list_filter(range(0, len(eq) - width + 1), lambda k: list_sum(eq[k + 1:k + width]) >= width - may) AS hits FROM aligned WHERE len(eq) >= width
), span AS (
  SELECT r, n, low + diagonal + hits[1] AS start, low + diagonal + hits[-1] + width AS stop, list_sum(eq[hits[1] + 1:hits[-1] + width]) AS matched, length
  FROM good WHERE len(hits) > 0
)
SELECT d.doc_id, item_id, CAST(best.start AS INTEGER) AS start, CAST(best.stop AS INTEGER) AS stop, CAST(-best.missed AS INTEGER) AS matched, CAST(best.length AS INTEGER) AS length
FROM (
  SELECT r, item_id, min({'missed': -matched, 'start': start, 'stop': stop, 'length': length}) AS best
  FROM span JOIN i USING (n) GROUP BY r, item_id
) JOIN d USING (r)
    """,
    "op11_prefix_trie": r"""
WITH o AS (
  SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS i, c
  FROM (SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t,
               length(coalesce(text, '')) AS c FROM conversations WHERE conv_id IS NOT NULL)
), bits(n, v) AS (  -- the table of crc32
  SELECT n, list_reduce(list_prepend(CAST(n AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(3988292384::UBIGINT, v // 2) ELSE v // 2 END)
  FROM range(256) x(n)
), lookup AS (SELECT list(v ORDER BY n) AS vs FROM bits
), own AS (
  SELECT conv_id, conv_id - conv_id % 100 AS lead, size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                    lambda v, b: xor(v // 256, vs[CAST(xor(v % 256, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT conv_id, count(*) AS size FROM o GROUP BY conv_id), lookup
), r AS (
  SELECT own.conv_id AS c, i AS d, t, o.c AS p FROM own JOIN o ON o.conv_id = lead WHERE i <= h
  UNION ALL
  SELECT own.conv_id, least(h, coalesce(l.size, 0)) + i - h, t, o.c
  FROM own JOIN o USING (conv_id) LEFT JOIN (SELECT conv_id AS lead, size FROM own) l USING (lead) WHERE i > h
), s AS (
  SELECT c, list(t ORDER BY d) AS ts, list(p ORDER BY d) AS ps FROM r GROUP BY c
  UNION ALL SELECT conv_id, [], [] FROM own ANTI JOIN r ON r.c = own.conv_id
), m AS (  -- members of each node; a node is told by its depth and the digest of its turns
  SELECT c, d, len(ts) AS length, CASE WHEN d > 0 THEN ps[d] ELSE 0 END AS p, sha256(array_to_string(ts[1:d], ',')) AS k,
         CASE WHEN d > 0 THEN sha256(array_to_string(ts[1:d - 1], ',')) END AS up
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM s)
), n AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(p) AS p,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = d), '')) AS ends
  FROM m GROUP BY d, k
), kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL
), v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)
), below AS (  -- each node counts for its least member at all smaller depths
  SELECT m.d, m.k, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.p) AS saved
  FROM m JOIN v ON v.conv_id = m.c AND v.d >= m.d GROUP BY ALL
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN below b ON b.d = v.d AND b.k = v.k LEFT JOIN v u ON u.d = v.d - 1 AND u.k = v.up
    """,
    "op12_filter_audit": r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < d.doc_id THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, failed, count(*) AS n, sum(q) AS q, sum(t) AS t FROM f GROUP BY ALL
), met AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, q, t, failed,
         contains(failed, substr(filter_order, step, 1)) AS fails,
         len(list_filter(range(1, step), lambda i: contains(failed, substr(filter_order, i, 1)))) > 0 AS before
  FROM c, orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5
), steps AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT before), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND before), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
         coalesce(sum(q) FILTER (fails AND NOT before), 0) AS good_lost, coalesce(sum(t) FILTER (fails AND NOT before), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
    """,
}
