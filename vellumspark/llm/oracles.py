"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "list_filter(regexp_split_to_array({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_SPACE = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP2 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS window FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM b)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS window FROM (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2)::BIGINT)) AS p FROM d, (SELECT DISTINCT k FROM b))),
hit AS MATERIALIZED (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.window = bw.window),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SPACE.format(_LOWER.format("text"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 4 THEN len(w) || ' ' || array_to_string(w, ' ') ELSE array_to_string(w[p:p + 3], ' ') END) AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 2)::BIGINT)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(nx.n) + any_value(ny.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
g AS MATERIALIZED (SELECT * FROM v WHERE n > 0 AND isfinite(n)),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a) k USING (vec_id)
"""

_CONTROL = "\\\\|<\\|turn\\|>|<\\|text\\|>|</s>|<s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|endoftext\\|>"
_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '" + _CONTROL + "'))"

OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length('<|turn|><|text|></s>') + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars FROM c GROUP BY conv_id
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

_FRAMED = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_LEAF = f"sha256({_FRAMED} || coalesce(strlen({{0}}) || ':' || {{0}}, '-'))"
#: Crc32 of the bytes of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
_RUNS = "{0} AS (SELECT g, level, idx // 8 AS run, list(digest ORDER BY idx) AS kids FROM {1} WHERE n > 1 GROUP BY ALL)"
_NODES = "{0} AS (SELECT g, 0 AS level, idx, n, digest FROM {1} UNION ALL SELECT g, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY g, level, idx // 8, n)"
_FOLD = "{0} AS (SELECT * FROM {1} UNION ALL SELECT f.* REPLACE (f.level + 1 AS level, f.idx // 8 AS idx, f.proof || array_to_string(kids[1:idx % 8], '') || array_to_string(kids[idx % 8 + 2:], '') AS proof, sha256(array_to_string(kids[1:idx % 8], '') || f.cur || array_to_string(kids[idx % 8 + 2:], '')) AS cur) FROM {0} f JOIN {2} r ON f.g = r.g AND f.level = r.level AND f.idx // 8 = r.run)"

OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format("text")} AS digest, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
{_NODES.format("x", "b")}, {_RUNS.format("xr", "x")},
s AS MATERIALIZED (SELECT g AS lang, digest, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM x WHERE n = 1),
{_NODES.format("y", "s")}, {_RUNS.format("yr", "y")},
lf AS (SELECT g, 0 AS level, idx, doc_id, g AS lang, digest AS leaf, coalesce(changed, digest) AS cur, '' AS proof FROM b), {_FOLD.format("fx", "lf", "xr")},
ll AS (SELECT '' AS g, 0 AS level, s.idx, fx.doc_id, s.digest AS subroot, leaf, cur, proof FROM fx JOIN s ON fx.lang = s.lang JOIN x ON x.g = fx.g AND x.level = fx.level AND x.n = 1), {_FOLD.format("fy", "ll", "yr")}
SELECT doc_id, leaf, subroot, y.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = y.digest AS verified FROM fy JOIN y ON y.level = fy.level AND y.n = 1
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
w AS (SELECT x, max(page_id) AS last FROM p WHERE strlen(x) >= 1000 GROUP BY x)
SELECT page_id, strlen(p.x)::BIGINT AS payload_bytes, sha1(p.x) AS payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to FROM p LEFT JOIN w ON p.x = w.x
"""

ORACLE_SQL = {"op2_decontamination": OP2, "op5_ngram_jaccard_join": OP5, "op8_embedding_near_dedup": OP8, "op10_chat_formatting": OP10, "op11_fill_middle": OP11, "op12_merkle_manifest": OP12, "op13_warc": OP13}
