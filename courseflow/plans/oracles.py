"""DuckDB statements of rows equal to the registered queries."""

from __future__ import annotations

from courseflow.plans import compile_oracles

RUNS = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
runs AS (
  SELECT event_id AS run_seq, 'run_' || event_id AS run_id, 'deck_' || (user_id % 20) AS deck_id,
    ['weak', 'average', 'strong'][user_id % 3 + 1] AS student_profile,
    ['explain_back', 'short_qa', 'confusion_report', 'coverage_check'][event_id % 4 + 1] AS task_type,
    CASE WHEN k % 13 = 0 THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    ['s' || (k % 7 + 1), 's' || (k % 5 + 1)] AS slide_refs, k % 13 <> 0 AS answered,
    'Answer ' || event_type || ' ' || repeat('x', k * 4) AS main_answer,
    list_filter([CASE WHEN event_type = 'click' THEN 'terminology_overload' END, CASE WHEN event_type = 'error' THEN 'model_output_failure' END,
      CASE WHEN value < 20 THEN 'pace_jump' END, CASE WHEN k % 10 = 0 THEN '' END], lambda x: x IS NOT NULL) AS confusion,
    CASE WHEN value > 50 THEN ['term_' || (k % 6)] ELSE CAST([] AS VARCHAR[]) END AS prerequisite,
    CASE WHEN k % 3 = 0 THEN ['flag_' || (k % 4)] ELSE CAST([] AS VARCHAR[]) END AS misconception,
    CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['s' || (k % 7 + 1)] END AS evidence
  FROM e),
done AS (SELECT *, CASE WHEN len(evidence) > 0 THEN evidence ELSE slide_refs END AS cited FROM runs WHERE answered),
tags AS (
  SELECT deck_id, student_profile, 'confusion' AS kind, unnest(confusion) AS tag, run_seq, 0 AS lp, unnest(range(len(confusion))) AS pos FROM done
  UNION ALL SELECT deck_id, student_profile, 'prerequisite', unnest(prerequisite), run_seq, 1, unnest(range(len(prerequisite))) FROM done
  UNION ALL SELECT deck_id, student_profile, 'misconception', unnest(misconception), run_seq, 2, unnest(range(len(misconception))) FROM done),
occurrences AS (
  SELECT * FROM tags UNION ALL
  SELECT deck_id, student_profile, 'weak_topic', tag, run_seq, lp, pos FROM tags WHERE student_profile = 'weak' AND kind <> 'misconception'),
counts AS (SELECT deck_id, kind, tag, count(*) AS n, min(run_seq * 1000 + lp * 100 + pos) AS seen FROM occurrences GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY deck_id, kind ORDER BY n DESC, seen) AS rank FROM counts),
labels AS (
  SELECT deck_id, kind, coalesce(string_agg(tag || ' (' || n || ')', '|' ORDER BY rank) FILTER (WHERE tag <> ''), '') AS labels,
    coalesce(list(tag || ' (' || n || ')' ORDER BY rank) FILTER (WHERE tag <> ''), []) AS items
  FROM ranked WHERE rank <= 5 GROUP BY ALL),
slide_counts AS (
  SELECT deck_id, slide_id, count(*) AS n, min(run_seq * 10 + pos) AS seen
  FROM (SELECT deck_id, run_seq, unnest(cited) AS slide_id, unnest(range(len(cited))) AS pos FROM done) GROUP BY ALL),
slide_ranks AS (
  SELECT deck_id, slide_id, CASE WHEN slide_id IN ('s1', 's2', 's3', 's4', 's5') THEN 'Slide title ' || slide_id[2:] ELSE slide_id END AS slide_title, n,
    row_number() OVER (PARTITION BY deck_id ORDER BY n DESC, seen) AS rank FROM slide_counts),
firsts AS (SELECT deck_id, student_profile, min(run_seq) AS first_seq FROM done GROUP BY ALL),
cites AS (SELECT *, unnest(list_distinct(evidence)) AS slide_id FROM done),
types AS (
  SELECT deck_id, slide_id, array_to_string(list_filter([CASE WHEN bool_or(len(confusion) > 0) THEN 'confusion' END,
    CASE WHEN bool_or(len(misconception) > 0) THEN 'misconception' END, CASE WHEN bool_or(len(prerequisite) > 0) THEN 'prerequisite' END], lambda x: x IS NOT NULL), '|') AS issue_types
  FROM cites GROUP BY ALL),
affected AS (
  SELECT deck_id, slide_id, string_agg(student_profile, '|' ORDER BY first_seq) AS affected_profiles
  FROM (SELECT DISTINCT deck_id, slide_id, student_profile FROM cites) JOIN firsts USING (deck_id, student_profile) GROUP BY ALL),
targets AS (
  SELECT r.deck_id, r.slide_id, r.rank, r.n AS priority, coalesce(issue_types, '') AS issue_types, coalesce(affected_profiles, '') AS affected_profiles,
    '[P' || n || '] slide:' || r.slide_id || ' - Slide ' || slide_title || ' appears in ' || n || ' issue-linked run(s).' AS label
  FROM slide_ranks r LEFT JOIN types USING (deck_id, slide_id) LEFT JOIN affected USING (deck_id, slide_id) WHERE r.rank <= 5),
scored AS (
  SELECT *, 100 * (len(confusion) + len(prerequisite) + len(misconception)) + length(CASE WHEN length(main_answer) <= 300 THEN main_answer ELSE rtrim(main_answer[1:297]) || '...' END) + 20 * len(evidence) AS score FROM done),
represented AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, student_profile ORDER BY score DESC, run_seq) AS nth FROM scored) JOIN firsts USING (deck_id, student_profile) WHERE nth = 1),
signals AS (
  SELECT d.deck_id,
    coalesce((SELECT items FROM labels l WHERE l.deck_id = d.deck_id AND kind = 'weak_topic'), []) AS weak_topics,
    coalesce((SELECT items FROM labels l WHERE l.deck_id = d.deck_id AND kind = 'confusion'), []) AS repeated_confusion_points,
    coalesce((SELECT items FROM labels l WHERE l.deck_id = d.deck_id AND kind = 'misconception'), []) AS misconception_clusters,
    coalesce((SELECT items FROM labels l WHERE l.deck_id = d.deck_id AND kind = 'prerequisite'), []) AS missing_prerequisite_patterns,
    (SELECT list(label ORDER BY rank) FROM targets t WHERE t.deck_id = d.deck_id) AS recommended_revision_targets, count(*) AS n_runs,
    (SELECT list(run_id ORDER BY first_seq) FROM represented p WHERE p.deck_id = d.deck_id) AS representative_run_ids
  FROM done d GROUP BY d.deck_id),
raw_issues AS (
  SELECT deck_id, 'weak_topic' AS issue_type, 0 AS ks, unnest(weak_topics) AS issue_text, unnest(range(len(weak_topics))) AS pos, weak_topics AS wt, repeated_confusion_points AS rc, misconception_clusters AS mc, missing_prerequisite_patterns AS mp FROM signals
  UNION ALL SELECT deck_id, 'confusion', 1, unnest(repeated_confusion_points), unnest(range(len(repeated_confusion_points))), weak_topics, repeated_confusion_points, misconception_clusters, missing_prerequisite_patterns FROM signals
  UNION ALL SELECT deck_id, 'misconception', 2, unnest(misconception_clusters), unnest(range(len(misconception_clusters))), weak_topics, repeated_confusion_points, misconception_clusters, missing_prerequisite_patterns FROM signals
  UNION ALL SELECT deck_id, 'missing_prerequisite', 3, unnest(missing_prerequisite_patterns), unnest(range(len(missing_prerequisite_patterns))), weak_topics, repeated_confusion_points, misconception_clusters, missing_prerequisite_patterns FROM signals),
scored_issues AS (
  SELECT *, CASE WHEN issue_type = 'weak_topic' THEN issue_text ELSE coalesce(list_filter(wt, lambda t: contains(lower(issue_text), lower(t)))[1], wt[1], 'unknown') END AS topic,
    CASE issue_type WHEN 'confusion' THEN 75 WHEN 'misconception' THEN 80 WHEN 'missing_prerequisite' THEN 88 ELSE 60
      + CASE WHEN len(list_filter(rc, lambda i: contains(lower(i), lower(issue_text)))) > 0 THEN 10 ELSE 0 END
      + CASE WHEN len(list_filter(mc, lambda i: contains(lower(i), lower(issue_text)))) > 0 THEN 10 ELSE 0 END
      + CASE WHEN len(mp) > 0 THEN 5 ELSE 0 END END AS score FROM raw_issues),
issues AS (
  SELECT deck_id, issue_type, ks, pos, topic, issue_text, CAST(score AS BIGINT) AS score,
    CASE WHEN score >= 85 THEN 'critical' WHEN score >= 75 THEN 'high' WHEN score >= 65 THEN 'medium' ELSE 'low' END AS severity,
    row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, ks, pos) AS rank FROM scored_issues),
named_issues AS (
  SELECT i.*, 'ISS_' || lpad(CAST(rank AS VARCHAR), 3, '0') AS issue_id, ['weak_topics', 'repeated_confusion_points', 'misconception_clusters', 'missing_prerequisite_patterns'][ks + 1] AS source_field,
    ['s1', 's2', 's3', 's4', 's5'] AS slide_refs, coalesce(recommended_revision_targets[1:3], []) AS targets, representative_run_ids,
    ['Topic ' || chr(39) || issue_text || chr(39) || ' appears in weak_topics and is repeatedly problematic.', 'Students repeatedly confused about: ' || issue_text, 'Recurring misconception: ' || issue_text, 'Missing prerequisite knowledge: ' || issue_text][ks + 1] AS rationale
  FROM issues i JOIN signals USING (deck_id)),
every_rec AS (
  SELECT deck_id, slide_refs AS target_slide_refs, targets AS target_knowledge_ids, representative_run_ids, rationale, CASE issue_type WHEN 'missing_prerequisite' THEN 'add_prerequisite_slide' WHEN 'misconception' THEN 'add_misconception_warning' WHEN 'confusion' THEN 'add_example' ELSE 'mark_for_kb_review' END AS action,
    least(100, score + CASE issue_type WHEN 'missing_prerequisite' THEN 9 WHEN 'misconception' THEN 8 WHEN 'confusion' THEN 8 ELSE 6 END) AS score, rank AS seq, issue_id AS source_issue_ids, NULL AS fixed FROM named_issues
  UNION ALL SELECT deck_id, any_value(targets), CAST([] AS VARCHAR[]), any_value(representative_run_ids), 'Multiple issue types across same section.', 'regenerate_deck_section', 68, count(*) + 1, string_agg(issue_id, '|' ORDER BY rank) FILTER (WHERE rank <= 3), 'medium' FROM named_issues GROUP BY deck_id HAVING count(*) >= 4),
best_rec AS (
  SELECT *, min(seq) OVER (PARTITION BY deck_id, action) AS first_seq, row_number() OVER (PARTITION BY deck_id, action ORDER BY score DESC, seq) AS nth FROM every_rec),
recs AS (
  SELECT deck_id, array_to_string(target_slide_refs, '|') AS target_slide_refs, array_to_string(target_knowledge_ids, '|') AS target_knowledge_ids, array_to_string(representative_run_ids, '|') AS representative_run_ids, rationale, action, score, coalesce(fixed, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END) AS priority, source_issue_ids,
    row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, first_seq) AS rank FROM best_rec WHERE nth = 1)"""

QA = """
answers AS (
  SELECT 'bench_' || l_suppkey AS benchmark_id, 'q_' || l_partkey AS question_id, CASE WHEN l_linestatus = 'O' THEN 'after' ELSE 'before' END AS stage, bool_and(l_returnflag <> 'R') AS is_correct
  FROM lineitem GROUP BY ALL)"""

UNITS = """
units AS (
  SELECT p_partkey, 'ku_' || p_partkey AS knowledge_id, p_name AS title, 'About ' || p_name AS summary, 'The ' || p_type || ' ' || p_name || ' of ' || p_brand || '.' AS body_text,
    p_brand AS module_tag, 'week_' || (p_size % 12) AS week_tag, [p_type, p_brand] AS topic_tags, ['easy', 'medium', 'hard'][p_size % 3 + 1] AS difficulty_level,
    ['concept', 'example', 'caution', 'prerequisite', 'other'][p_size % 5 + 1] AS pedagogical_role, CASE WHEN p_partkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS approval_status,
    CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'pdf' END AS source_type, 1 + p_size % 3 AS version_number, 1704067200 + p_partkey AS updated_s, 1704067200 + p_partkey % 50 AS created_s,
    ['src_' || (p_partkey % 200), 'src_' || p_size] AS source_ref, CASE WHEN p_partkey % 4 = 0 THEN ['ku_' || (p_partkey + 1), 'ku_missing'] ELSE CAST([] AS VARCHAR[]) END AS prerequisite_links
  FROM part),
edges AS (
  SELECT unnest(source_ref) AS source, knowledge_id AS target, 'derived_from' AS edge_type FROM units
  UNION ALL SELECT source, target, 'prerequisite' FROM (SELECT unnest(prerequisite_links) AS source, knowledge_id AS target FROM units) WHERE source IN (SELECT knowledge_id FROM units))"""


APPROVALS = """, approvals AS (
  SELECT 'req_' || s_suppkey AS request_id, CASE WHEN s_suppkey % 5 = 0 THEN 'archived' ELSE 'approved' END AS target_status, unnest(['ku_' || s_suppkey, 'ku_' || (s_suppkey * 2 + 1), 'ku_none', 'ku_' || s_suppkey]) AS knowledge_id, unnest([0, 1, 2, 3])::BIGINT AS pos FROM supplier)
"""

NODES = """
nodes AS (
  SELECT 'src_' || doc_id AS node_id, 'source' AS node_type, 'doc_' || doc_id || '.txt' AS label, NULL AS summary, 'text' AS source_type, lang AS module_tag, source AS week_tag, 'tester' AS uploader,
    NULL AS approval_status, NULL AS pedagogical_role, CAST([] AS VARCHAR[]) AS topic_tags, CAST([] AS VARCHAR[]) AS source_ref, 1704067200 + doc_id AS updated_at FROM documents
  UNION ALL SELECT knowledge_id, 'knowledge_unit', title, summary, NULL, module_tag, week_tag, NULL, approval_status, pedagogical_role, topic_tags, source_ref, updated_s FROM units)
"""


def seen(search: str, passes: str) -> str:
    """Visible nodes: units that pass and are found; sources that pass and are found or lead to a visible unit."""
    found = f"contains(lower(concat_ws(' ', label, node_id, coalesce(summary, ''), coalesce(array_to_string(topic_tags, ' '), ''), coalesce(source_type, ''))), trim({search}))"
    return f""", shown AS (SELECT node_id FROM nodes WHERE node_type = 'knowledge_unit' AND {passes} AND {found}),
seen AS (SELECT node_id FROM shown UNION SELECT node_id FROM nodes WHERE node_type = 'source' AND {passes} AND ({found} OR node_id IN (SELECT source FROM edges WHERE edge_type = 'derived_from' AND target IN (SELECT node_id FROM shown))))
"""


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _score(query: str, candidate: str) -> str:
    """Match score of a topic against one text, as a CASE."""
    q, c = _norm(query), _norm(candidate)
    return f"""CASE WHEN {q} = '' THEN 0 WHEN {c} = '' THEN NULL WHEN {c} = {q} THEN 0 WHEN contains({c}, {q}) THEN 1
      WHEN len(list_filter(string_split({q}, ' '), lambda w: NOT list_contains(string_split({c}, ' '), w))) = 0 THEN 2 END"""


REQUESTS = """
requests AS (
  SELECT 'r' || k AS request_id, CASE WHEN k % 32 = 0 AND k % 10 <> 4 OR k % 1000 IN (203, 404) THEN NULL WHEN k % 40 = 17 THEN '' WHEN k % 50 = 9 THEN 'none' ELSE 'Brand#' || (k % 25 + 1) END AS module,
    CASE WHEN k % 6 = 1 THEN 'week_' || (k % 12) WHEN k % 7 = 3 THEN '' END AS week,
    (['ring', 'red', 'blue,gear', '!!!', '', 'economy widget', 'small ring, hot', 'an', 'o', 'old bolt,anvil'])[k % 10 + 1] AS topic,
    CASE k % 5 WHEN 2 THEN 'easy' WHEN 4 THEN 'hard' END AS difficulty_level, (['lesson', 'quiz', 'deck', NULL])[k % 4 + 1] AS generation_target
  FROM (SELECT c_custkey AS k FROM customer)),
topics AS (SELECT request_id, trim(t) AS t FROM (SELECT request_id, unnest(string_split(topic, ',')) AS t FROM requests) WHERE trim(t) <> ''),
fits AS (
  SELECT r.request_id, r.topic, u.* FROM requests r JOIN units u ON u.approval_status = 'approved'
    AND (coalesce(r.module, '') = '' OR r.module = u.module_tag) AND (coalesce(r.week, '') = '' OR r.week = u.week_tag)
    AND (coalesce(r.difficulty_level, '') = '' OR r.difficulty_level = u.difficulty_level)),
scores AS (
  SELECT request_id, knowledge_id, min(least({title}, least({tag1}, {tag2}) + 3)) AS topic_score
  FROM fits JOIN topics USING (request_id) GROUP BY ALL),
bundle AS (
  SELECT f.request_id, f.knowledge_id, topic_score, source_ref, row_number() OVER (PARTITION BY f.request_id ORDER BY coalesce(topic_score, 9999),
    CASE pedagogical_role WHEN 'concept' THEN 0 WHEN 'example' THEN 1 WHEN 'caution' THEN 2 WHEN 'prerequisite' THEN 3 ELSE 99 END, p_partkey DESC, f.knowledge_id) AS position
  FROM fits f LEFT JOIN scores USING (request_id, knowledge_id) WHERE topic_score IS NOT NULL OR f.topic = '')""".replace("{title}", _score("t", "title")).replace("{tag1}", _score("t", "topic_tags[1]")).replace("{tag2}", _score("t", "topic_tags[2]"))

def embedding(text: str) -> str:
    """64 values: the first four bytes of SHA-256(text, index) / 2^32."""
    return f"list_transform(range(64), lambda i: ('0x' || substr(sha256(encode({text}) || unhex(format('{{:04x}}', i))), 1, 8))::UBIGINT / 4294967296.0)"


def unit_text(x: str = "") -> str:
    return f"'Title: ' || {x}title || chr(10) || 'Summary: ' || {x}summary || chr(10) || 'Body: ' || {x}body_text[1:3000] || chr(10) || 'Topic Tags: ' || array_to_string({x}topic_tags, ', ') || chr(10) || 'Pedagogical Role: ' || {x}pedagogical_role"


HITS = f"""
scopes AS (SELECT r.*, list_filter(list_transform(string_split(topic, ','), lambda t: trim(t)), lambda t: t <> '') AS scope FROM requests r),
asked AS (SELECT *, array_to_string(list_filter([coalesce(module, ''), coalesce(week, ''), array_to_string(scope, ', '), coalesce(generation_target, '')], lambda x: x <> ''), ' | ') AS query_text FROM scopes WHERE len(scope) > 0),
vectors AS (SELECT *, {embedding("query_text")} AS q FROM asked),
unit_vectors AS (SELECT u.*, {embedding(unit_text())} AS v FROM units u WHERE approval_status = 'approved'),
unit_hits AS (
  SELECT request_id, knowledge_id, score, rank FROM (
    SELECT request_id, knowledge_id, scope, list_cosine_similarity(q, v) AS score, row_number() OVER (PARTITION BY request_id ORDER BY list_cosine_similarity(q, v) DESC, knowledge_id) AS rank
    FROM vectors r JOIN unit_vectors u ON (r.module IS NULL OR r.module = u.module_tag) AND (r.week IS NULL OR r.week = u.week_tag) AND (r.difficulty_level IS NULL OR r.difficulty_level = u.difficulty_level))
  WHERE rank <= greatest(8, 4 * len(scope))),
mixed AS (
  SELECT f.*, topic_score, rank - 1 AS semantic_rank, row_number() OVER (PARTITION BY f.request_id ORDER BY coalesce(topic_score, 9999),
    CASE pedagogical_role WHEN 'concept' THEN 0 WHEN 'example' THEN 1 WHEN 'caution' THEN 2 WHEN 'prerequisite' THEN 3 ELSE 99 END, coalesce(rank - 1, 9999), p_partkey DESC, f.knowledge_id) AS position
  FROM fits f LEFT JOIN scores USING (request_id, knowledge_id) LEFT JOIN unit_hits USING (request_id, knowledge_id) WHERE topic_score IS NOT NULL OR f.topic = '' OR rank IS NOT NULL)"""

CHUNK_HITS = f"""
chunk_vectors AS (SELECT c.*, 'src::' || c.source_id || '::chunk::' || chunk_index AS chunk_id, lang, source, {embedding("chunk_text")} AS v FROM chunks c JOIN documents d ON c.source_id = 'src_' || d.doc_id),
chunk_hits AS (
  SELECT * FROM (SELECT r.request_id, c.*, list_cosine_similarity(q, v) AS score, row_number() OVER (PARTITION BY r.request_id ORDER BY list_cosine_similarity(q, v) DESC, chunk_id) AS rank
    FROM vectors r JOIN chunk_vectors c ON (r.module IS NULL OR r.module = c.lang) AND (r.week IS NULL OR r.week = c.source)) WHERE rank <= 24)"""


def supporting(bundle: str) -> str:
    return f"""
supporting AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS position FROM chunk_hits WHERE (request_id, source_id) IN (SELECT request_id, unnest(source_ref) FROM {bundle})) WHERE position <= 8)
"""


CHUNKS = r"""
stripped AS (SELECT 'src_' || doc_id AS source_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t FROM documents),
starts AS (SELECT source_id, t, unnest(range(0, greatest(0, CAST(ceil((length(t) - 1000) / 900.0) AS BIGINT)) * 900 + 1, 900)) AS s FROM stripped WHERE t <> ''),
pieces AS (SELECT source_id, s AS char_start, least(s + 1000, length(t)) AS char_end, regexp_replace(regexp_replace(substring(t, s + 1, 1000), '^\s+', ''), '\s+$', '') AS chunk_text FROM starts),
chunks AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY char_start) - 1 AS chunk_index FROM pieces WHERE chunk_text <> '')"""

PAGES = """
pages AS (SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, coalesce(text, '') AS text FROM documents)"""


def oracle_sql() -> dict[str, str]:
    r, q, u, c, p = (f"WITH {x}\n" for x in (RUNS, QA, UNITS, CHUNKS, PAGES))
    hits = f"WITH {UNITS},{REQUESTS},{HITS}\n"
    bundle, n = f"WITH {UNITS},{REQUESTS}\n", f"WITH {UNITS},{NODES}"
    search = f"(SELECT *, least(list_min([{_score("'ring'", 'title')}, {_score("'red widget'", 'title')}]), 3 + list_min(list_filter([{_score("'ring'", 'topic_tags[1]')}, {_score("'ring'", 'topic_tags[2]')}, {_score("'red widget'", 'topic_tags[1]')}, {_score("'red widget'", 'topic_tags[2]')}], lambda x: x IS NOT NULL))) AS topic_score FROM units)"
    return compile_oracles.oracle_sql() | {
        "tag_counts": r + "SELECT deck_id, kind, tag, n FROM counts",
        "tag_counts_by_profile": r + "SELECT deck_id, student_profile, kind, tag, count(*) AS n FROM tags GROUP BY ALL",
        "tag_counts_all_levels": r + "SELECT deck_id, coalesce(student_profile, 'all') AS student_profile, kind, tag, count(*) AS n FROM tags GROUP BY GROUPING SETS ((deck_id, kind, tag), (deck_id, student_profile, kind, tag))",
        "weak_topics_top5": r + "SELECT deck_id, labels FROM labels WHERE kind = 'weak_topic'",
        "top_labels_all": r + "SELECT deck_id, kind, labels FROM labels",
        "tag_shares": r + "SELECT deck_id, kind, tag, round(n * 100.0 / greatest(max(n) OVER (PARTITION BY deck_id, kind), 1), 6)::DOUBLE AS bar, round(least(1.0, 0.25 + 0.18 * n), 6)::DOUBLE AS heat FROM counts",
        "slide_issue_counts": r + "SELECT deck_id, slide_id, slide_title, n, rank FROM slide_ranks",
        "revision_targets": r + "SELECT deck_id, slide_id, priority, issue_types, affected_profiles, label FROM targets",
        "representative_evidence": r + """SELECT deck_id, student_profile, run_id, score, CASE WHEN length(main_answer) <= 300 THEN main_answer ELSE rtrim(main_answer[1:297]) || '...' END AS main_answer,
  array_to_string(evidence, '|') AS evidence_slide_refs, row_number() OVER (PARTITION BY deck_id ORDER BY first_seq) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, student_profile ORDER BY score DESC, run_seq) AS nth FROM scored) JOIN firsts USING (deck_id, student_profile) WHERE nth = 1""",
        "evidence_refs": r + "SELECT deck_id, run_id, 0::BIGINT AS pos, array_to_string(cited, '|') AS slide_refs, task_type, student_profile FROM done",
        "flatten_runs": r + "SELECT run_id, status, CASE WHEN answered THEN main_answer END AS answer_text, CASE WHEN answered THEN array_to_string(confusion, '|') ELSE 'none' END AS confusion_tags, CASE WHEN answered AND len(evidence) > 0 THEN array_to_string(evidence, '|') ELSE array_to_string(slide_refs, '|') END AS evidence_slides, run_id || '~' || array_to_string(CASE WHEN answered AND len(evidence) > 0 THEN evidence ELSE slide_refs END, '+') || '~' || task_type || '~' || student_profile AS evidence_ref, CASE WHEN status = 'failed' THEN CASE WHEN answered THEN main_answer ELSE 'Run failed.' END WHEN answered THEN 'none' ELSE 'No answer yet.' END AS error_message FROM runs",
        "evaluation_grid": r + "SELECT deck_id, student_profile, task_type, 5::BIGINT AS n FROM (SELECT DISTINCT deck_id FROM runs), (VALUES ('weak'), ('average'), ('strong')) p(student_profile), (VALUES ('explain_back'), ('short_qa'), ('confusion_report'), ('coverage_check')) t(task_type) WHERE task_type <> 'coverage_check' OR student_profile = 'strong'",
        "job_status": r + "SELECT deck_id, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, bool_and(status IN ('completed', 'failed')) AS complete FROM runs GROUP BY deck_id",
        "profile_coverage": r + """SELECT deck_id, tag, CASE WHEN len(p) = 3 THEN 'all profiles' WHEN p = ['weak'] THEN 'weak only' ELSE array_to_string(list_reverse(p), ' + ') END AS coverage, runs
FROM (SELECT deck_id, tag, list_sort(list(DISTINCT student_profile)) AS p, count(DISTINCT run_seq) AS runs FROM tags WHERE kind = 'confusion' GROUP BY ALL)""",
        "cohort_signal": r + "SELECT deck_id, 'signal_' || deck_id AS signal_id, " + ", ".join(f"array_to_string({x}, '|') AS {x}" for x in ("weak_topics", "repeated_confusion_points", "misconception_clusters", "missing_prerequisite_patterns", "recommended_revision_targets", "representative_run_ids")) + ", n_runs FROM signals",
        "merged_signal": r + "SELECT deck_id, 'signal_' || deck_id AS signal_id, " + ", ".join(f"array_to_string({x}, '|') AS {x}" for x in ("weak_topics", "repeated_confusion_points", "misconception_clusters", "missing_prerequisite_patterns", "recommended_revision_targets", "representative_run_ids")) + ", n_runs FROM signals",
        "signal_fields": r + """SELECT deck_id, CASE kind WHEN 'weak_topic' THEN 'weak_topic_counts' ELSE kind || '_tag_counts' END AS field, '' AS profile, row_number() OVER (PARTITION BY deck_id, kind ORDER BY n DESC, seen) AS position, tag AS label, n FROM counts
UNION ALL SELECT deck_id, kind || '_by_profile', student_profile, row_number() OVER (PARTITION BY deck_id, kind, student_profile ORDER BY n DESC, seen), tag, n
  FROM (SELECT deck_id, kind, student_profile, tag, count(*) AS n, min(run_seq * 1000 + lp * 100 + pos) AS seen FROM tags GROUP BY ALL)
UNION ALL SELECT deck_id, 'slide_issue_counts', '', rank, slide_id, n FROM slide_ranks""",
        "issue_evidence": r + "SELECT deck_id, issue_id, run_id, array_to_string(cited, '|') AS slide_refs, task_type, student_profile FROM done JOIN named_issues i USING (deck_id)",
        "proposal_evidence": r + "SELECT deck_id, action AS recommended_action, run_id, array_to_string(cited, '|') AS slide_refs, task_type, student_profile FROM done JOIN recs USING (deck_id) WHERE priority IN ('high', 'critical')",
        "signal_completeness": r + "SELECT deck_id, " + ", ".join(f"len({x}) > 0 AS has_{x}" for x in ("weak_topics", "repeated_confusion_points", "misconception_clusters", "missing_prerequisite_patterns")) + " FROM signals",
        "issues_ranked": r + "SELECT deck_id, issue_type, topic, issue_text, score, severity, rank, source_field, array_to_string(slide_refs, '|') AS slide_refs, array_to_string(representative_run_ids, '|') AS representative_run_ids, rationale FROM named_issues",
        "recommendations": r + "SELECT deck_id, action, score, priority, source_issue_ids, rank, target_slide_refs, target_knowledge_ids, representative_run_ids, rationale FROM recs",
        "proposals": r + "SELECT deck_id, action AS recommended_action, priority AS suggested_priority, score, source_issue_ids AS based_on_issue_ids, target_knowledge_ids, representative_run_ids, rationale FROM recs WHERE priority IN ('high', 'critical')",
        "unknown_actions": r + "SELECT deck_id, action || '_x' AS action FROM recs WHERE rank % 2 = 0",
        "trace_totals": "SELECT 'deck_' || l_orderkey AS deck_id, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS elapsed, CAST(sum(l_partkey) AS BIGINT) AS prompt_tokens, CAST(sum(l_suppkey) AS BIGINT) AS completion_tokens FROM lineitem GROUP BY l_orderkey",
        "normalized_issues": r + f"""SELECT deck_id, 'ISS_' || lpad(CAST(row_number() OVER (PARTITION BY deck_id ORDER BY seq) AS VARCHAR), 3, '0') AS issue_id, norm, issue_type, topic, description, affected_slides, source_evidence, merged
FROM (SELECT deck_id, {_norm('issue_text')} AS norm, min(ks * 100 + pos) AS seq, arg_min(issue_type, ks * 100 + pos) AS issue_type, arg_min(topic, ks * 100 + pos) AS topic, arg_min(issue_text, ks * 100 + pos) AS description,
  any_value(array_to_string(slide_refs, '|')) AS affected_slides, any_value(array_to_string(representative_run_ids, '|')) AS source_evidence, count(*) AS merged FROM named_issues GROUP BY ALL)""",
        "regenerate_hints": r + "SELECT deck_id, action, target_slide, 'Apply ' || replace(action, '_', ' ') || ' to ' || target_slide || '.' AS hint FROM (SELECT DISTINCT deck_id, action, unnest(string_split(target_slide_refs, '|')) AS target_slide FROM recs WHERE priority IN ('high', 'critical'))",
        "cohort_insight": r + """SELECT deck_id, weak_topic_rankings, coalesce(confusion_clusters, '') AS confusion_clusters, missing_prerequisites, 's1|s2|s3|s4|s5' AS affected_slide_refs
FROM (SELECT deck_id, string_agg(topic || '~' || severity || '~' || score, '|' ORDER BY rank) FILTER (WHERE nth = 1) AS weak_topic_rankings, coalesce(string_agg(issue_text, '|' ORDER BY rank) FILTER (WHERE issue_type = 'missing_prerequisite'), '') AS missing_prerequisites
  FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, topic ORDER BY rank) AS nth FROM named_issues) GROUP BY deck_id)
LEFT JOIN (SELECT deck_id, string_agg('CLU_C_' || lpad(CAST(nth AS VARCHAR), 3, '0') || '~' || issue_type || '~' || n, '|' ORDER BY nth) AS confusion_clusters
  FROM (SELECT deck_id, issue_type, count(*) AS n, row_number() OVER (PARTITION BY deck_id ORDER BY count(*) DESC, issue_type) AS nth FROM named_issues GROUP BY deck_id, issue_type HAVING count(*) >= 2) GROUP BY deck_id) USING (deck_id)""",
        "issue_clusters": r + """SELECT *, 'CLU_' || dimension || '_' || lpad(CAST(row_number() OVER (PARTITION BY deck_id, dimension ORDER BY n_issues DESC, value) AS VARCHAR), 3, '0') AS cluster_id
FROM (SELECT deck_id, dimension, value, count(*) AS n_issues, string_agg(issue_id, '|' ORDER BY issue_id) AS issue_ids
  FROM (SELECT deck_id, 'T' AS dimension, topic AS value, issue_id FROM named_issues UNION ALL SELECT deck_id, 'C', issue_type, issue_id FROM named_issues UNION ALL SELECT deck_id, 'S', unnest(slide_refs), issue_id FROM named_issues) GROUP BY ALL HAVING count(*) >= 2)""",
        "qa_passes": q + "SELECT benchmark_id, stage, count(*) FILTER (WHERE is_correct) AS correct_count, count(*) AS total, round(count(*) FILTER (WHERE is_correct) / count(*), 9) AS accuracy FROM answers GROUP BY ALL",
        "qa_delta": q + "SELECT *, after_correct - before_correct AS delta FROM (SELECT benchmark_id, count(*) FILTER (WHERE is_correct AND stage = 'before') AS before_correct, count(*) FILTER (WHERE is_correct AND stage = 'after') AS after_correct FROM answers GROUP BY ALL)",
        "qa_handoff": q + "SELECT benchmark_id, count(*) FILTER (WHERE stage = 'after' AND NOT is_correct) AS unresolved_count, coalesce(string_agg(question_id, '|' ORDER BY question_id) FILTER (WHERE stage = 'after' AND NOT is_correct), '') AS items FROM answers GROUP BY ALL",
        "source_listing": "SELECT 'src_' || doc_id AS source_id, 'doc_' || doc_id || '.txt' AS filename, source AS week_tag, 'sha256_' || sha256(coalesce(text, '')) AS hash FROM documents WHERE lang = 'en'",
        "source_registry": """SELECT page_id, filename, CASE WHEN x IN ('pdf') THEN 'pdf' WHEN x IN ('png', 'jpg', 'jpeg', 'webp') THEN 'image' WHEN x IN ('py', 'ipynb', 'js', 'ts', 'java', 'cpp', 'c', 'go', 'rs') THEN 'code'
  WHEN x IN ('txt', 'md', 'json', 'csv') THEN 'text' ELSE 'unknown' END AS source_type, hash
FROM (SELECT page_id, filename, lower(regexp_extract(filename, '\\.([^./]+)$', 1)) AS x, hash FROM (
  SELECT page_id, CASE WHEN f = '' THEN 'upload.bin' ELSE f END AS filename, hash FROM (
    SELECT page_id, regexp_replace(list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/?', '/'), '/')), '[^A-Za-z0-9._-]+', '_', 'g') AS f, 'sha256_' || sha256(coalesce(html, '')) AS hash FROM pages)))""".replace("\\\\", "\\"),
        "text_chunks": c + "SELECT source_id, chunk_index, char_start, char_end, md5(chunk_text) AS chunk_md5 FROM chunks",
        "chunk_summary": c + "SELECT source_id, count(*) AS chunk_count, max(char_end) AS extracted_char_count, min(length(chunk_text)) AS shortest, max(length(chunk_text)) AS longest FROM chunks GROUP BY source_id",
        "extraction_summary": p + "SELECT source_id, count(*) AS page_count, count(*) FILTER (WHERE text <> '') AS non_empty_page_count, CAST(sum(length(text)) AS BIGINT) AS page_char_sum, CAST(sum(length(text)) + 2 * greatest(count(*) FILTER (WHERE text <> '') - 1, 0) AS BIGINT) AS extracted_char_count FROM pages GROUP BY source_id",
        "topic_search": u + f"SELECT knowledge_id, title, CAST(topic_score AS BIGINT) AS topic_score FROM {search} WHERE approval_status = 'approved' AND topic_score IS NOT NULL",
        "text_query": u + f"SELECT knowledge_id, title, module_tag FROM units WHERE difficulty_level = 'easy' AND contains({_norm("title || ' ' || summary || ' ' || body_text")}, 'economy red')",
        "bulk_approval": u + f"SELECT knowledge_id, CASE WHEN moved THEN 'approved' ELSE approval_status END AS approval_status, moved FROM (SELECT *, approval_status = 'draft' AND coalesce({_score("'ring'", 'title')}, {_score("'ring'", 'topic_tags[1]')}, {_score("'ring'", 'topic_tags[2]')}) IS NOT NULL AS moved FROM units)",
        "knowledge_summary": u + "SELECT (SELECT count(*) FROM documents) AS sources, count(*) FILTER (WHERE approval_status = 'draft') AS drafts, count(*) FILTER (WHERE approval_status = 'approved') AS approved, 1704067200 + greatest(max(p_partkey), (SELECT max(doc_id) FROM documents)) AS latest_s FROM units",
        "unit_text_matches": u + f"SELECT search_id, knowledge_id FROM (SELECT 'q' || s_suppkey AS search_id, CASE WHEN s_suppkey % 100 = 57 THEN ' ?' ELSE (['Economy RED', 'small', 'of brand', 'an', 'o', 'PROMO-old ring', 'brand 2', 'ing of', 'zz', 'about hot gear'])[s_suppkey % 10 + 1] END AS q FROM supplier) JOIN (SELECT knowledge_id, {_norm("title || ' ' || summary || ' ' || body_text")} AS t FROM units) ON contains(t, {_norm('q')})",
        "document_text_matches": f"SELECT search_id, doc_id FROM (SELECT 'b' || item_id AS search_id, {_norm('substring(text, item_id % 30 + 1, CASE WHEN item_id % 50 = 0 THEN 2 ELSE 25 END)')} AS q FROM benchmark) JOIN (SELECT doc_id, {_norm("coalesce(text, '')")} AS t FROM documents) ON contains(t, q)",
        "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS nth FROM s) WHERE nth <= 8""",
        "vector_upsert": "SELECT id, document, write_seq FROM (SELECT 'ku::' || (vec_id % 100) || '::v1' AS id, 'document ' || vec_id AS document, vec_id AS write_seq, row_number() OVER (PARTITION BY vec_id % 100 ORDER BY vec_id DESC) AS nth FROM embeddings) WHERE nth = 1",
        "context_bundle": bundle + "SELECT request_id, position, knowledge_id, CAST(coalesce(topic_score, -1) AS BIGINT) AS topic_score FROM bundle",
        "bundle_sources": bundle + "SELECT request_id, source_id, row_number() OVER (PARTITION BY request_id ORDER BY doc_id, source_id) AS position FROM (SELECT DISTINCT request_id, unnest(source_ref) AS source_id FROM bundle) JOIN (SELECT doc_id, 'src_' || doc_id AS source_id FROM documents) USING (source_id)",
        "bundle_trace": bundle + """SELECT r.request_id, coalesce(len(ids), 0)::BIGINT AS n_units, md5(coalesce(array_to_string(ids, '|'), '')) AS units_md5, md5(coalesce(array_to_string(refs, '|'), '')) AS sources_md5, trim(topic) <> '' AS used_scope
FROM requests r LEFT JOIN (SELECT request_id, list(knowledge_id ORDER BY position) AS ids, list_sort(list_distinct(flatten(list(source_ref)))) AS refs FROM bundle GROUP BY 1) b ON r.request_id = b.request_id""",
        "hash_embedding": u + f"""SELECT knowledge_id, round(v[1] / n, 9) AS v0, round(v[64] / n, 9) AS v63, round(list_sum(v) / n, 6) AS total
FROM (SELECT knowledge_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT knowledge_id, {embedding(unit_text())} AS v FROM units))""",
        "unit_hits": hits + "SELECT request_id, knowledge_id, round(score, 6) AS score, rank FROM unit_hits",
        "context_bundle_semantic": hits + "SELECT request_id, position, knowledge_id, CAST(coalesce(topic_score, -1) AS BIGINT) AS topic_score, CAST(coalesce(semantic_rank, -1) AS BIGINT) AS semantic_rank FROM mixed",
        "supporting_chunks": f"WITH {UNITS},{REQUESTS},{HITS},{CHUNKS},{CHUNK_HITS},{supporting('bundle')}" + "SELECT request_id, chunk_id, source_id, 'text' AS source_type, chunk_index, char_start, char_end, position, md5(chunk_text) AS text_md5, round(score, 6) AS similarity_score FROM supporting",
        "bundle_served": f"WITH {UNITS},{REQUESTS},{HITS},{CHUNKS},{CHUNK_HITS},{supporting('mixed')}" + """, items AS (
  SELECT request_id, count(*) AS n, string_agg(knowledge_id || '~' || title || '~' || summary || '~' || body_text || '~' || pedagogical_role || '~' || array_to_string(topic_tags, '+') || '~' || array_to_string(prerequisite_links, '+') || '~' || array_to_string(source_ref, '+') || '~' || approval_status || '~' || version_number, '|' ORDER BY position) AS told,
    string_agg(knowledge_id, '|' ORDER BY position) AS ids FROM mixed GROUP BY request_id),
refs AS (SELECT request_id, string_agg('src_' || doc_id || '~doc_' || doc_id || '.txt~' || source, '|' ORDER BY doc_id) AS told FROM (SELECT DISTINCT request_id, unnest(source_ref) AS source_id FROM mixed) JOIN documents ON source_id = 'src_' || doc_id GROUP BY request_id),
found AS (SELECT request_id, string_agg(chunk_id || '~' || char_start, '|' ORDER BY position) AS told, string_agg(chunk_id, '|' ORDER BY position) AS ids FROM supporting GROUP BY request_id)
SELECT r.request_id, array_to_string(r.scope, ',') AS topic_scope, coalesce(i.n, 0) AS n_items, md5(coalesce(i.told, '')) AS items_md5, coalesce(f.told, '') AS chunks, md5(coalesce(s.told, '')) AS sources_md5, len(r.scope) > 0 AS vector_search_used,
  CASE WHEN len(r.scope) = 0 THEN '' WHEN i.n > 0 THEN 'knowledge_units|source_chunks' ELSE 'knowledge_units' END AS collections, coalesce(a.query_text, 'none') AS query_text, md5(coalesce(i.ids, '')) AS ids_md5, coalesce(f.ids, '') AS chunk_ids, coalesce(r.difficulty_level, 'none') AS difficulty
FROM scopes r LEFT JOIN asked a USING (request_id) LEFT JOIN items i USING (request_id) LEFT JOIN refs s USING (request_id) LEFT JOIN found f USING (request_id)""",
        "bulk_filtered": u + f"SELECT knowledge_id, title FROM units WHERE approval_status = 'draft' AND week_tag = 'week_3' AND pedagogical_role = 'concept' AND coalesce({_score("'ring'", 'title')}, {_score("'ring'", 'topic_tags[1]')}, {_score("'ring'", 'topic_tags[2]')}, {_score("'red'", 'title')}, {_score("'red'", 'topic_tags[1]')}, {_score("'red'", 'topic_tags[2]')}) IS NOT NULL ORDER BY p_partkey DESC LIMIT 7",
        "approval_outcome": u + APPROVALS + """SELECT request_id, pos, a.knowledge_id, reason IS NULL AS approved, coalesce(reason, 'none') AS reason FROM (
  SELECT a.*, CASE WHEN target_status <> 'approved' THEN 'Only draft -> approved transitions are supported in the MVP' WHEN approval_status IS NULL THEN 'Knowledge unit not found' WHEN approval_status <> 'draft' THEN 'Only draft knowledge units can be approved' END AS reason
  FROM approvals a LEFT JOIN units u USING (knowledge_id)) a""",
        "skipped_ids": u + APPROVALS + f"SELECT request_id, pos, knowledge_id FROM approvals WHERE knowledge_id NOT IN (SELECT knowledge_id FROM units WHERE approval_status = 'draft' AND coalesce({_score("'ring'", 'title')}, {_score("'ring'", 'topic_tags[1]')}, {_score("'ring'", 'topic_tags[2]')}) IS NOT NULL)",
        "unit_lookup": u + "SELECT i.knowledge_id, u.title IS NOT NULL AS found, coalesce(u.title, 'none') AS title FROM (SELECT 'ku_' || (s_suppkey * 40) AS knowledge_id FROM supplier) i LEFT JOIN units u USING (knowledge_id)",
        "selected_profiles": "SELECT request_id, pos - 1 AS pos, student_profile FROM (SELECT n_nationkey AS request_id, unnest([p, 'none', 'strong', p]) AS student_profile, unnest([1, 2, 3, 4])::BIGINT AS pos FROM (SELECT n_nationkey, ['weak', 'average', 'strong'][n_nationkey % 3 + 1] AS p FROM nation)) WHERE student_profile IN (SELECT ['weak', 'average', 'strong'][user_id % 3 + 1] FROM events)",
        "job_runs": r + "SELECT job_id, pos, run_id, status FROM (SELECT 'job_' || o_orderkey AS job_id, unnest(['run_' || o_orderkey, 'run_' || o_custkey, 'run_none', 'run_' || o_orderkey]) AS run_id, unnest([0, 1, 2, 3])::BIGINT AS pos FROM orders) JOIN runs USING (run_id)",
        "json_lists": u + "SELECT knowledge_id, dumped, CASE WHEN ends_with(knowledge_id, '5') OR ends_with(knowledge_id, '6') OR dumped = '[]' THEN '' ELSE array_to_string(topic_tags, '|') END AS loaded FROM (SELECT knowledge_id, topic_tags, CASE WHEN ends_with(knowledge_id, '7') THEN '[]' ELSE CAST(to_json(topic_tags) AS VARCHAR) END AS dumped FROM units)",
        "handoff_items": q + """SELECT benchmark_id, 'high' AS priority, question_id AS target_ref, 'incorrect_after_support|content_revision_candidate' AS issue_types, ['weak', 'average', 'strong'][n % 3 + 1] AS affected_profiles,
  'Student still answered incorrectly after QA support in the after pass.' AS reason, 'Revise the related slide content to address the missed concepts, then regenerate or update the question support materials.' AS suggestion, question_id, 'Question ' || n AS prompt, 'Said ' || (n % 11) AS student_answer, 'Key ' || (n % 7) AS correct_answer,
  'Student still answered incorrectly after QA support.' AS failure_reason, 'concept_' || (n % 5) AS missed_concepts, 'Update the slide explanation, add a clearer worked example, and tighten terminology around the missed concepts.' AS recommended_followup, 's' || (n % 7 + 1) AS slide_refs
FROM (SELECT *, CAST(question_id[3:] AS BIGINT) AS n FROM answers WHERE stage = 'after' AND NOT is_correct)""",
        "normalized_answers": """SELECT 'q_' || l_orderkey || '_' || l_linenumber AS question_id, round(CASE WHEN l_linenumber % 4 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, CAST(l_tax * 30 - 0.5 AS DOUBLE))) END, 6) AS confidence,
  CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 5 = 0 THEN 'No answer returned.' ELSE 'said ' || l_partkey END AS student_answer,
  CASE WHEN l_returnflag <> 'R' THEN '' WHEN l_partkey % 2 = 0 THEN 'missed_' || (l_partkey % 9) WHEN l_partkey % 3 = 0 THEN 'tag_' || (l_partkey % 4) ELSE 'concept_gap' END AS missed_concepts,
  CASE WHEN l_suppkey % 2 = 0 THEN 's' || (l_suppkey % 6) WHEN l_suppkey % 3 = 0 THEN 'q' || (l_suppkey % 8) ELSE 's1' END AS evidence_slide_refs FROM lineitem""",
        "model_answers": r + """SELECT conv_id || ':' || turn AS run_id, true AS is_fallback, 'model_output_failure' AS confusion_tags, 's1' AS evidence FROM conversations
UNION ALL SELECT run_id, false, array_to_string(confusion, '|'), array_to_string(evidence, '|') FROM done""",
        "graph_nodes": n + "SELECT node_id, node_type, label, summary, source_type, module_tag, week_tag, uploader, approval_status, pedagogical_role, array_to_string(topic_tags, '|') AS topic_tags, array_to_string(source_ref, '|') AS source_ref, updated_at FROM nodes",
        "graph_edges": u + "SELECT source, target, edge_type, edge_type || ':' || source || '->' || target AS edge_id FROM edges",
        "graph_neighbours": u + "SELECT node_id, count(*) AS degree, min(neighbour) AS first_neighbour FROM (SELECT source AS node_id, target AS neighbour FROM edges UNION SELECT target, source FROM edges) WHERE node_id <> neighbour GROUP BY node_id",
        "visible_nodes": n + seen("' 12'", "(node_type = 'source' AND source_type = 'text' OR node_type = 'knowledge_unit' AND approval_status = 'approved')") + "SELECT node_id FROM seen",
        "visible_edges": n + seen("'about red'", "(node_type = 'source' OR approval_status = 'approved')") + "SELECT source, target, edge_type FROM edges WHERE source IN (SELECT node_id FROM seen) AND target IN (SELECT node_id FROM seen)",
        "visible_in_week": n + seen("''", "week_tag = 'week_3' AND (node_type = 'source' OR pedagogical_role = 'concept')") + "SELECT node_id FROM seen",
        "top_topics": u + "SELECT tag, count(*) AS n FROM (SELECT unnest(topic_tags) AS tag FROM units) GROUP BY tag ORDER BY n DESC, tag LIMIT 5",
        "facets": n + "SELECT " + ", ".join(f"string_agg(DISTINCT {x}, '|' ORDER BY {x}) FILTER (WHERE {x} <> '') AS {x}" for x in ("module_tag", "week_tag", "pedagogical_role", "source_type")) + " FROM nodes",
    }
