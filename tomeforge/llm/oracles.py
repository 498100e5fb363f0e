"""DuckDB SQL for the queries that SQL can express in full."""

from __future__ import annotations

from .quality import BOILERPLATE

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EMBEDDING = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT p.vec_id, (SELECT count(*) FROM link WHERE link.a = p.vec_id) AS n_links, component_id, p.vec_id = component_id AS kept FROM part p
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS r, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS t,
  coalesce(lag(role) OVER w = role, false) AS joined, coalesce(lead(role) OVER w = role, false) AS more FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN joined THEN 10 ELSE 13 + r END + t + CASE WHEN more THEN 0 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS.format('t')} AS w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
b AS (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT *, {WORDS.format('b')} AS lw, length(regexp_replace(b, '[^#*$%&|<>]', '', 'g')) AS sy, length(regexp_replace(b, '[^|·»›]', '', 'g')) AS bars FROM b WHERE b <> ''),
l AS (SELECT doc_id, line, len(lw) AS n,
  (NOT regexp_matches(b, '[a-zß-öø-ÿ]') AND upper(b) = b AND lower(b) <> b AND len(lw) >= 3)
  OR (length(b) <= 160 AND regexp_matches(lower(b), '{"|".join(BOILERPLATE)}'))
  OR (sy + bars > 0 AND (2 * sy >= len(lw) OR bars >= 3 OR (NOT regexp_matches(b, '[.!?:;…。！？"''’”»)\]]$') AND sy > 0 AND 8 * sy >= len(lw))))
  OR len(list_filter(range(1, len(lw) - 4), lambda i: lw[i] = lw[i + 1] AND lw[i] = lw[i + 2] AND lw[i] = lw[i + 3] AND lw[i] = lw[i + 4] AND lw[i] = lw[i + 5])) > 0 AS bad FROM m),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS lost FROM l GROUP BY 1),
y AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.4 * n_words AS kept FROM y
"""

MERKLE = r"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS name, row_number() OVER () AS r FROM documents),
e AS (SELECT *, crc32_even AND text IS NOT NULL AS cut FROM (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 2 = 0, false) AS crc32_even FROM d)),
f AS (SELECT r, doc_id, source, cut, coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS bare FROM e),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN cut THEN sha256(head || strlen(bare) || ':' || bare) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS found FROM f),
n AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM l),
tree AS (SELECT g, 0 AS level, i, size, leaf AS h FROM n
  UNION ALL SELECT g, level + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE size > 1 GROUP BY g, level, i // 3, size),
sub AS (SELECT g, level AS top, h AS subroot FROM tree WHERE size = 1),
whole AS (SELECT 0 AS level, g AS i, (SELECT count(*) FROM sub) AS size, subroot AS h FROM sub
  UNION ALL SELECT level + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM whole WHERE size > 1 GROUP BY level, i // 3, size),
root AS (SELECT h AS root FROM whole WHERE size = 1),
steps AS (SELECT n.r, t.level, n.g, n.i, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < own), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > own), '') AS b
    FROM (SELECT *, unnest(range(0, 40)) AS level, i // CAST(pow(3, level) AS BIGINT) AS own FROM n) n JOIN tree t ON t.g = n.g AND t.level = n.level AND t.size > 1 AND t.i // 3 = n.own // 3 GROUP BY ALL
  UNION ALL SELECT n.r, 100 + w.level, n.g, n.i, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i < own), ''), coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i > own), '')
    FROM (SELECT *, unnest(range(0, 40)) AS level, g // CAST(pow(3, level) AS BIGINT) AS own FROM n) n JOIN whole w ON w.level = n.level AND w.size > 1 AND w.i // 3 = n.own // 3 GROUP BY ALL),
path AS (SELECT r, list({'a': a, 'b': b} ORDER BY level) AS p FROM steps GROUP BY r),
done AS (SELECT n.doc_id, n.leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(p, lambda x: x.a || x.b), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'a': found, 'b': ''}, coalesce(p, [])), lambda x, y: {'a': sha256(y.a || x.a || y.b), 'b': ''}).a AS folded_root
    FROM n JOIN sub USING (g) CROSS JOIN root LEFT JOIN path USING (r))
SELECT *, folded_root = root AS verified FROM done
"""

ORACLES = {"op1_embedding": EMBEDDING, "op3_chat": CHAT, "op8_quality": QUALITY, "op12_merkle": MERKLE}
