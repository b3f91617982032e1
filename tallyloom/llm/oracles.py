"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_VECTORS = f"(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE})"
# Sums run from the first component to the last, as in the query.
_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, v: s + v)"



def _components(nodes: str, edges: str) -> str:
    """CTEs: ``best(node, root)``, the smallest node reachable over ``edges(a, b)``, given both ways."""
    return f"""reach(node, root) AS (SELECT node, node FROM ({nodes}) UNION SELECT e.b, r.root FROM reach r JOIN {edges} e ON e.a = r.node WHERE r.root < e.b),
best AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

_PARTS, _ENTRIES = 16, 64


def _nearest(name: str, books: str) -> str:
    """CTE: each part's nearest entry and its squared distance, ties to the lower index."""
    far = "list_sum(list_transform(list_zip(x.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"{name} AS (SELECT rn, part, best % 256 AS entry, best // 256 AS far FROM (SELECT rn, x.part, min(CAST({far} AS BIGINT) * 256 + b.entry) AS best FROM points x JOIN {books} b ON b.part = x.part GROUP BY rn, x.part))"


def _means(name: str, books: str, assigned: str) -> str:
    """CTE: entries replaced by the floors of their parts' means; unused ones stay."""
    return f"""{name}_m AS (SELECT part, entry, list(v ORDER BY pos) AS p FROM (SELECT part, entry, pos, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT a.part, a.entry, unnest(p) AS v, unnest(range(len(p))) AS pos FROM {assigned} a JOIN points USING (rn, part)) GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT part, entry, coalesce(m.p, b.p) AS p FROM {books} b LEFT JOIN {name}_m m USING (part, entry))"""


_NO_SPACE = "[^\\x20\\x09-\\x0D]"
#: Inserts that can lead from one state of the grammar to another: (state, edits, cost, next, rows made).
_INSERTS = "(0, '', 0, 0, ''), (0, 'I', 3, 2, 'user:\n'), (0, 'II', 6, 3, 'user:\nassistant:\n'), (1, '', 0, 1, ''), (1, 'I', 3, 2, 'user:\n'), (1, 'II', 6, 3, 'user:\nassistant:\n'), (2, '', 0, 2, ''), (2, 'I', 3, 3, 'assistant:\n'), (3, '', 0, 3, ''), (3, 'I', 3, 2, 'user:\n')"

ORACLE_SQL: dict[str, str] = {
    "op1_vp_tree": f"""
WITH v AS {_VECTORS},
p AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format(a="q.e", b="c.e")} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20""",
    "op2_phrase_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
again AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM k JOIN again USING (h)), (SELECT unnest(generate_series(0, 34)) AS j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.pos = words.pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
{_components("SELECT doc_id AS node FROM d", "e")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, root AS component_id, root = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN best ON node = d.doc_id""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(generate_series(0, length(x) // 2 - 100)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k),
starts AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM f WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE coalesce(head, '') || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_embedding_links": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt({_DOT.format(a="e", b="e")})) AS e FROM {_VECTORS} WHERE label IS NOT NULL),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE {_DOT.format(a="x.e", b="y.e")} >= 0.93),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
{_components("SELECT DISTINCT vec_id AS node FROM embeddings", "e")}
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, root AS component_id, root = m.vec_id AS kept FROM embeddings m LEFT JOIN n ON n.a = m.vec_id JOIN best ON node = m.vec_id""",
    "op11_vector_codes": f"""
WITH v AS (SELECT vec_id, label, e, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS rn FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))))),
points AS (SELECT rn, part, e[part * (len(e) // {_PARTS}) + 1:(part + 1) * (len(e) // {_PARTS})] AS p FROM v, (SELECT unnest(range({_PARTS})) AS part)),
b0 AS (SELECT part, rn - 1 AS entry, p FROM points WHERE rn <= {_ENTRIES}),
{_nearest("a1", "b0")},
{_means("b1", "b0", "a1")},
{_nearest("a2", "b1")},
{_means("b2", "b1", "a2")},
{_nearest("a3", "b2")},
s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM (SELECT part, entry, unnest(p) AS v, unnest(range(len(p))) AS pos FROM b2)),
c AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a3 GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (rn), s""",
    "op12_dialogue_repair": f"""
WITH RECURSIVE k AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
w AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda x: [unicode(x), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) % 20 AS way FROM k),
d AS (SELECT c, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN way = 3 THEN [1, 2] ELSE [1] END) AS copy FROM w WHERE way <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
r AS (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '{_NO_SPACE}') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
ins(a, edits, cost, z, made) AS (VALUES {_INSERTS}),
keep(a, initial, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
way(c, i, a, z, edits, cost, made) AS (
SELECT c, i, ins.a, ins.z, ins.edits || 'D', ins.cost + 4, ins.made FROM r, ins
UNION ALL SELECT c, i, ins.a, CASE WHEN ins.z = 2 THEN 3 ELSE 2 END, ins.edits || 'R', ins.cost + 3 + CASE WHEN fault = '' THEN 0 ELSE 3 END, ins.made || CASE WHEN ins.z = 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10) FROM r, ins WHERE fault IN ('', 'truncated')
UNION ALL SELECT c, i, ins.a, keep.z, ins.edits || 'K', ins.cost + CASE WHEN fault = '' THEN 0 ELSE 3 END, ins.made || role || ':' || text || chr(10) FROM r JOIN keep USING (initial) JOIN ins ON ins.z = keep.a WHERE fault IN ('', 'truncated')),
p(c, i, a, cost, edits, made) AS (SELECT DISTINCT c, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM k
UNION ALL SELECT c, i, z, b.cost, b.edits, b.made FROM (SELECT p.c, way.i, way.z, min(struct_pack(cost := p.cost + way.cost, edits := p.edits || way.edits, made := p.made || way.made)) AS b FROM p JOIN way ON way.c = p.c AND way.i = p.i + 1 AND way.a = p.a GROUP BY p.c, way.i, way.z)),
f AS (SELECT p.c, min(struct_pack(cost := p.cost + ins.cost, edits := p.edits || ins.edits, made := p.made || ins.made)) AS b FROM p LEFT JOIN (SELECT c, max(i) AS m FROM r GROUP BY c) l ON l.c = p.c JOIN ins ON ins.a = p.a WHERE p.i = coalesce(m, 0) AND ((p.a IN (0, 3) AND ins.edits = '') OR (p.a IN (1, 2) AND ins.z = 3)) GROUP BY p.c),
t AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.edits AS audit, sha256(left(b.made, greatest(length(b.made) - 1, 0))) AS repaired_sha256 FROM (SELECT DISTINCT c, conv_id FROM k) o LEFT JOIN f USING (c) LEFT JOIN t USING (c)""",
    "op13_url_cascade": """
WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, b, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT n, arg_max(h || b, length(h || b)) AS rule, arg_max(verdict, length(h || b)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)""",
}
