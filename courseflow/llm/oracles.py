"""DuckDB statements for the queries of this folder that SQL can express."""

from __future__ import annotations

#: A word is a run of characters other than space and U+0009 to U+000D.
_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '<s>', ''))) // 3
    + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + length(role) + 23 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""

_OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM g JOIN r ON g.doc_id = r.doc_id GROUP BY g.doc_id, len(g.s)
"""

_OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS least FROM x GROUP BY win),
c AS (
  SELECT x.doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone
  FROM x JOIN f USING (win) WHERE least < x.doc_id GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""


_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"


def _op12(rounds: int = 10) -> str:
    """k-means, a pair of tables a round."""
    near = "SELECT row_id, min_by(c, d * 8 + c) AS c, min(d) AS d FROM (SELECT k.row_id, c.c, {d} AS d FROM k, c{r} c) GROUP BY row_id"
    parts = ["""
k AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT v, row_number() OVER (ORDER BY CASE WHEN vec_id IS NULL THEN 1 ELSE 0 END, sha256('3:' || vec_id), v) - 1 AS c FROM k) WHERE c < 8)"""]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(d=_DISTANCE, r=r)})")
        parts.append(f"""m{r} AS MATERIALIZED (
  SELECT c, list(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS v
  FROM (SELECT a.c, i, CAST(sum(k.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN k ON k.row_id = a.row_id, range(1, 65) t(i) GROUP BY a.c, i) GROUP BY c)""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)")
    parts.append(f"f AS MATERIALIZED ({near.format(d=_DISTANCE, r=rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT k.vec_id, CAST(f.c AS INTEGER) AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN k ON k.row_id = f.row_id JOIN c{rounds} c ON c.c = f.c
"""


def _op13(levels: int = 12, above: int = 8) -> str:
    """The trees level by level, for up to 3**levels rows a source and 3**above sources; a tree of one node stays as it is."""
    fields = ("doc_id", "source", "lang", "n_chars", "{text}")
    leaf = "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in fields) + "))"
    crc = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384))"
    parts = [f"""
d AS MATERIALIZED (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, source, {leaf.format(text='text')} AS leaf, {leaf.format(text='changed')} AS other FROM d),
g AS MATERIALIZED (
  SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM l),
n0 AS MATERIALIZED (SELECT s, p, n, leaf AS h FROM g)"""]

    def level(name: str, k: int) -> None:
        parts.append(f"""
r{name}{k} AS MATERIALIZED (
  SELECT s, p // 3 AS up, any_value(n) AS n, list(h ORDER BY p) AS hs FROM {name}{k} WHERE n > 1 GROUP BY s, p // 3)""")
        parts.append(f"""
{name}{k + 1} AS MATERIALIZED (
  SELECT s, up AS p, (n + 2) // 3 AS n, sha256(array_to_string(hs, '')) AS h FROM r{name}{k}
  UNION ALL SELECT s, p, n, h FROM {name}{k} WHERE n = 1)""")

    for k in range(levels):
        level("n", k)
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS s, s AS p, count(*) OVER () AS n, h FROM n{levels})")
    for k in range(above):
        level("t", k)
    # q: each leaf's proof and fold so far, with its place on the level.
    parts.append("q0 AS MATERIALIZED (SELECT doc_id, leaf, other AS f, '' AS proof, s, p FROM g)")
    steps = [("n", k, "q.s", "q.p") for k in range(levels)] + [("t", k, "0", "q.p") for k in range(above)]
    for i, (name, k, tree, place) in enumerate(steps):
        q = f"q{i}" if i != levels else "(SELECT doc_id, leaf, f, proof, s, s AS p FROM q%d)" % i
        parts.append(f"""
q{i + 1} AS MATERIALIZED (
  SELECT q.doc_id, q.leaf, CASE WHEN r.hs IS NULL THEN q.f ELSE sha256(array_to_string(r.hs[:q.p % 3] || [q.f] || r.hs[q.p % 3 + 2:], '')) END AS f,
    CASE WHEN r.hs IS NULL THEN q.proof ELSE q.proof || array_to_string(r.hs[:q.p % 3] || r.hs[q.p % 3 + 2:], '') END AS proof, q.s, CASE WHEN r.hs IS NULL THEN q.p ELSE q.p // 3 END AS p
  FROM {q} q LEFT JOIN r{name}{k} r ON r.s = {tree} AND r.up = {place} // 3)""")
    return "WITH " + ",".join(parts) + f"""
SELECT q.doc_id, q.leaf, n.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = t.h AS verified
FROM q{len(steps)} q JOIN n{levels} n ON n.s = q.s CROSS JOIN t{above} t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": _OP2, "op4_chat_format": _OP4, "op5_jaccard_join": _OP5, "op7_substring_dedup": _OP7, "op12_centroid_clustering": _op12(), "op13_merkle_manifest": _op13()}
