"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm.bpe import op4_bpe
from graphloom.llm.dual_tree import op13_centroid_clustering
from graphloom.llm.exact_dedup import op11_exact_dedup
from graphloom.llm.katz_packed import op1_katz
from graphloom.llm.near_dedup import op3_near_dedup
from graphloom.llm.packing import op7_packing
from graphloom.llm.prefix_trie import op12_prefix_trie
from graphloom.llm.quality_classifier import op9_quality_classifier
from graphloom.llm.quality_rules import STOP_WORDS, op10_quality_rules
from graphloom.llm.toxicity import op6_toxicity
from graphloom.llm.url_filter import op8_url_filter
from graphloom.llm.vector_search import op2_top_k
from graphloom.llm.warc import op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_katz, op2_top_k, op3_near_dedup, op4_bpe, op5_warc, op6_toxicity, op7_packing, op8_url_filter, op9_quality_classifier, op10_quality_rules,
        op11_exact_dedup, op12_prefix_trie, op13_centroid_clustering,
    )
}

WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: Lloyd's rounds: a numbers the centroids' components, each round assigns all vectors and moves the centroids.
_ROUND = """
        d{r} AS (SELECT vec_id, v.x, a.c, list_sum(list_transform(list_zip(v.x, a.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN a{r} a),
        n{r} AS (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY vec_id, x),"""
_MOVE = """
        m{r} AS (SELECT c, list(s ORDER BY i) AS x FROM (SELECT c, i, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM n{r}) GROUP BY c, i) GROUP BY c),
        a{s} AS (SELECT a.c, coalesce(m.x, a.x) AS x FROM a{r} a LEFT JOIN m{r} m USING (c)),"""

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, turn FROM conversations WHERE conv_id IS NOT NULL), o AS (SELECT c, list(x ORDER BY turn NULLS FIRST) AS x FROM t GROUP BY c),
        h AS (SELECT c, x, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
              lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h FROM o),
        r AS (SELECT h.c, list_concat(coalesce(b.x, [])[1:h.h], h.x[h.h + 1:]) AS x FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
        p AS (SELECT c, len(x) = d AS ends, d, x[1:d] AS p FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM r)),
        n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN c END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY p, d),
        q AS (SELECT p.c, p.d, n.conv_id AS m FROM p JOIN n ON p.p = n.p AND p.d = n.d),
        k AS (SELECT n.conv_id, n.d, q.m AS parent, n_convs, ends_sha256, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(p[n.d].t) ELSE 0 END AS own FROM n LEFT JOIN q ON q.c = n.conv_id AND q.d = n.d - 1),
        kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM k WHERE d > 0 GROUP BY 1, 2), f AS (SELECT k.*, coalesce(kids.n, 0) AS n_children FROM k LEFT JOIN kids USING (conv_id, d)),
        s AS (SELECT q.m AS conv_id, q.d, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM f JOIN q ON q.c = f.conv_id AND q.d <= f.d GROUP BY 1, 2)
        SELECT conv_id, f.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s USING (conv_id, d)""",
    "op13_centroid_clustering": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        a0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < 16),"""
    + "".join((_ROUND + _MOVE).format(r=r, s=r + 1) for r in range(3))
    + _ROUND.format(r=3)
    + """
        e AS (SELECT c, sha256(array_to_string(x, ',')) AS h FROM a3)
        SELECT vec_id, n.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM n3 n JOIN e USING (c)""",
    "op3_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
        k AS (SELECT s, min(doc_id) AS c FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT c, len(s) AS n, unnest(s) AS x FROM k),
        l AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        comp(c, label) USING KEY (c) AS (SELECT c, c FROM k UNION SELECT l.b, min(x.label) FROM comp x JOIN l ON l.a = x.c JOIN recurring.comp r ON r.c = l.b WHERE x.label < r.label GROUP BY l.b)
        SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept FROM s LEFT JOIN k ON s.s = k.s LEFT JOIN comp ON k.c = comp.c""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
              array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32 + 1)::INT, 1)), '') AS payload_digest FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op10_quality_rules": f"""
        WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, {WORDS.format(text="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
        g AS (SELECT id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 5),
        r AS (SELECT id, count(DISTINCT i + k) AS n FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) JOIN range(5) o(k) ON n > 1 GROUP BY 1),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
              (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, greatest(len(w), 1)::DOUBLE AS nw,
              len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&<>]'))) AS symbol_words, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS shouts,
              len(list_filter(w, lambda x: x = '|')) AS pipes, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS alphas FROM w LEFT JOIN r USING (id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 200000 AND word_chars / nw BETWEEN 2 AND 14 AND symbol_words / nw <= 0.3 AND shouts / nw <= 0.5
            AND pipes / nw <= 0.25 AND stops / nw >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND alphas / greatest(word_chars, 1) >= 0.5 AS kept FROM b""",
    "op2_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
}
