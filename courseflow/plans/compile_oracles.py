"""DuckDB statements of the compile, chunk and contents queries, written from their rules with joins and windows."""

from __future__ import annotations

from courseflow.functions import text as fx

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def flat(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def clean_line(x: str) -> str:
    f = flat(x)
    return rf"CASE WHEN regexp_matches({f}, '^\[\s*[ivxlcdmIVXLCDM0-9]+\s*\]$') OR regexp_matches({f}, '(?i)^copyright ©') OR regexp_matches({f}, '(?i)^created from ') THEN '' ELSE {f} END"


def clean_block(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{BREAK}'), lambda z: {clean_line('z')}), lambda z: z <> ''), chr(10))"


def slug(x: str) -> str:
    s = f"array_to_string(regexp_extract_all(lower({x}), '[A-Za-z0-9]+')[1:10], '_')"
    return f"CASE WHEN {s} = '' THEN 'unit' ELSE {s} END"


def truncate(x: str, most: int) -> str:
    return f"CASE WHEN length({strip(x)}) <= {most} THEN {strip(x)} ELSE {strip(f'''regexp_replace(({strip(x)})[1:{most}], ' [^ ]*$', '')''')} || '...' END"


def summary(x: str) -> str:
    two = rf"array_to_string(string_split(regexp_replace({flat(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')"
    return f"CASE WHEN {flat(x)} = '' THEN 'Auto-generated summary is unavailable.' ELSE {truncate(two, 360)} END"


def tags(title: str, chapter: str | None = None) -> str:
    """All candidate tags in order, repeats included; ``first_tags`` takes the distinct first six."""
    stop = ", ".join(f"'{w}'" for w in [*fx.STOP_WORDS, *fx.GENERIC_TAGS])
    words = f"list_filter(list_transform(regexp_extract_all(lower({title}), '[A-Za-z0-9][A-Za-z0-9-]+'), lambda w: replace(w, '-', '_')), lambda w: length(w) >= 4 AND w NOT IN ({stop}))"
    slugs = f"[{slug(title)}]" if chapter is None else f"list_filter([CASE WHEN coalesce({title}, '') <> '' THEN {slug(title)} END, CASE WHEN coalesce({chapter}, '') <> '' THEN {slug(chapter)} END], lambda w: w IS NOT NULL)"
    return f"list_concat({slugs}, {words})"


def first_tags(candidates: str) -> str:
    return f"array_to_string(list_filter({candidates}, lambda w, i: list_position({candidates}, w) = i)[1:6], '|')"


def role(title: str, chapter: str = "false") -> str:
    return f"CASE WHEN regexp_matches(lower({title}), '{fx.CAUTION}') THEN 'caution' WHEN regexp_matches(lower({title}), '{fx.EXAMPLE}') THEN 'example' WHEN {chapter} AND regexp_matches(lower({title}), '{fx.INTRODUCTORY}') THEN 'prerequisite' ELSE 'concept' END"


COMPILED = rf"""
headed AS (
  SELECT doc_id, 'src_' || doc_id AS source_id, 'doc_' || doc_id || '.txt' AS filename, lang, source,
    array_to_string(list_transform(string_split(coalesce(text, ''), '. '), lambda p, i: CASE WHEN (i - 1) % 3 = 0 THEN '# ' || p ELSE p END), chr(10)) AS text
  FROM documents),
raw_lines AS (SELECT source_id, regexp_split_to_array(text, '{BREAK}') AS a FROM headed),
lines AS (SELECT source_id, unnest(range(len(a))) AS pos, {strip("unnest(a)")} AS line FROM raw_lines),
marked AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+(.+)$') AS hash, regexp_matches(line, '^#{{1,6}}\s+(.+)$') OR regexp_matches(line, '^[A-Z][A-Za-z0-9 ,:()/_-]{{2,88}}$') AS head FROM lines),
islands AS (SELECT *, sum(head::INT) OVER (PARTITION BY source_id ORDER BY pos) AS island, {clean_line("line")} AS said FROM marked),
parts AS (
  SELECT source_id, island, coalesce(max(CASE WHEN head AND hash THEN {strip(r"regexp_extract(line, '^#{1,6}\s+(.+)$', 1)")} WHEN head THEN line END), 'Section 1') AS title,
    coalesce(string_agg(said, chr(10) ORDER BY pos) FILTER (WHERE NOT head AND said <> ''), '') AS body
  FROM islands GROUP BY source_id, island HAVING bool_or(NOT head AND line <> '')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY island) AS entry FROM parts),
sections AS (SELECT *, 'text_section_' || entry || '_' || {slug("title")} AS key FROM numbered WHERE length(body) >= 120),
stripped AS (SELECT source_id, filename, {strip("text")} AS t FROM headed WHERE source_id NOT IN (SELECT source_id FROM sections)),
cut AS (SELECT source_id, filename, t, unnest(range(0, greatest(0, CAST(ceil((length(t) - 2200) / 2000.0) AS BIGINT)) * 2000 + 1, 2000)) AS s FROM stripped WHERE t <> ''),
pieces AS (SELECT source_id, filename, s, {strip("substring(t, s + 1, 2200)")} AS c FROM cut),
whole AS (SELECT source_id, filename, c, row_number() OVER (PARTITION BY source_id ORDER BY s) AS entry FROM pieces WHERE c <> ''),
chunked AS (SELECT source_id, entry, 'chunk_unit_' || entry AS key, filename || ' chunk unit ' || entry AS title, {clean_block("c")} AS body FROM whole),
both_routes AS (
  SELECT source_id, entry, key, title, body, 7000 AS most, {role("title")} AS role FROM sections
  UNION ALL SELECT source_id, entry, key, title, body, 5000, 'concept' FROM chunked WHERE body <> ''),
compiled AS (
  SELECT source_id, entry, key, title, {summary("body")} AS summary, CASE most WHEN 7000 THEN {truncate("body", 7000)} ELSE {truncate("body", 5000)} END AS body_text, {tags("title")} AS candidates, role AS pedagogical_role,
    lag(key) OVER (PARTITION BY source_id ORDER BY entry) AS prerequisite_key
  FROM both_routes),
known AS (SELECT source_id, title FROM compiled WHERE length(title) % 2 = 0),
fresh AS (SELECT * FROM compiled WHERE (source_id, title) NOT IN (SELECT source_id, title FROM known)),
stored AS (
  SELECT 'ku_' || substring(sha256(source_id || chr(31) || key), 1, 16) AS knowledge_id, f.*, h.lang AS module_tag, h.source AS week_tag
  FROM fresh f JOIN headed h USING (source_id))"""

BOOK = rf"""
numbered_pages AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents),
opened AS (
  SELECT source || '#' || ((page - 1) // 30) AS source_id, (page - 1) % 30 + 1 AS n, (page - 1) // 30 % 3 + 1 AS front, coalesce(text, '') AS text,
    string_split({flat("regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g')")}, ' ')[1:4] AS words FROM numbered_pages),
titled AS (SELECT *, CASE WHEN n % 5 = 1 THEN 'Chapter ' || n || ': ' ELSE '' END || array_to_string(words, ' ') AS heading FROM opened),
book AS (
  SELECT source_id, 1 AS page_number, 'Table of Contents' || chr(10) || string_agg(heading || ' ' || n, chr(10) ORDER BY n) || chr(10) || 'Index 99' AS text FROM titled WHERE array_to_string(words, '') <> '' GROUP BY source_id
  UNION ALL SELECT source_id, n + front + CASE WHEN n % 11 = 0 THEN 1000 ELSE 0 END, CASE WHEN n % 4 = 0 THEN '' ELSE '[ ' || n || ' ]' || chr(10) END || array_to_string(words, ' ') || chr(10) || text FROM titled),
book_lines AS (SELECT source_id, page_number, unnest(regexp_split_to_array(text, '{BREAK}')) AS raw, unnest(range(len(regexp_split_to_array(text, '{BREAK}')))) AS pos FROM book),
gaps AS (SELECT source_id, page_number - CAST(regexp_extract({strip("raw")}, '^\[\s*(\d+)\s*\]$', 1) AS BIGINT) AS gap, page_number * 100 + pos AS seen FROM book_lines WHERE pos < 6 AND regexp_matches({strip("raw")}, '^\[\s*(\d+)\s*\]$')),
offsets AS (SELECT source_id, gap FROM (SELECT source_id, gap, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, min(seen)) AS nth FROM gaps WHERE gap BETWEEN 0 AND 40 GROUP BY source_id, gap) WHERE nth = 1),
early AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY page_number) AS nth FROM book_lines) WHERE nth <= 40),
said AS (SELECT source_id, page_number, pos, {clean_line("raw")} AS line FROM early),
from_page AS (SELECT source_id, min(page_number) AS first_page FROM said WHERE contains(line, 'Table of Contents') GROUP BY source_id),
inside AS (
  SELECT source_id, line, row_number() OVER (PARTITION BY source_id ORDER BY page_number, pos) AS place
  FROM said JOIN from_page USING (source_id) WHERE page_number >= first_page AND line NOT IN ('', 'Table of Contents')),
toc AS (
  SELECT *, coalesce(sum(regexp_matches(line, '\d+$')::INT) OVER (PARTITION BY source_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM (SELECT i.*, coalesce((SELECT min(j.place) FROM inside j WHERE j.source_id = i.source_id AND regexp_matches(j.line, '^Index\s+\d+$')), 1000000000) AS last FROM inside i) WHERE place <= last),
merged AS (SELECT source_id, island, string_agg(line, ' ' ORDER BY place) AS line FROM toc GROUP BY ALL),
entries AS (
  SELECT *, row_number() OVER w AS entry, sum(is_chapter::INT) OVER w AS c, sum((NOT is_chapter)::INT) OVER w AS s
  FROM (SELECT source_id, island, trim(regexp_extract(line, '^(.+?)\s+(\d+)$', 1)) AS title, CAST(regexp_extract(line, '^(.+?)\s+(\d+)$', 2) AS BIGINT) AS printed, starts_with(trim(regexp_extract(line, '^(.+?)\s+(\d+)$', 1)), 'Chapter ') AS is_chapter
    FROM merged WHERE regexp_matches(line, '^(.+?)\s+(\d+)$')) WHERE title <> '' AND lower(title) NOT IN ('preface', 'index')
  WINDOW w AS (PARTITION BY source_id ORDER BY island)),
keyed AS (SELECT *, CASE WHEN is_chapter THEN 'chapter_' || c || '_' ELSE 'section_' || s || '_' END || {slug("title")} AS key, CASE WHEN is_chapter THEN trim(regexp_replace(title, '^.*?: ', '')) ELSE title END AS anchor FROM entries),
chapters AS (SELECT source_id, c, key AS chapter_key, anchor AS chapter_title FROM keyed WHERE is_chapter),
placed AS (SELECT k.*, chapter_key, chapter_title, printed + gap AS pdf_page FROM keyed k JOIN offsets USING (source_id) LEFT JOIN chapters h ON k.source_id = h.source_id AND k.c = h.c)"""


#: The search for titles goes from entry to entry, as each begins where the one before ended.
LOCATED = rf"""
cleaned AS (SELECT source_id, page_number, {clean_block("text")} AS text FROM book),
page_starts AS (SELECT source_id, page_number, coalesce(sum(length(text) + 2) OVER (PARTITION BY source_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM cleaned),
whole AS (SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM cleaned GROUP BY source_id),
wanted AS (
  SELECT p.source_id, p.entry, p.anchor, o.begin AS own, coalesce(f.begin, length(w.text)) AS following, w.text, '\b' || array_to_string(regexp_extract_all(p.anchor, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)?'), '\s+') || '\b' AS pattern
  FROM (SELECT *, lead(pdf_page) OVER (PARTITION BY source_id ORDER BY entry) AS next_page FROM placed) p JOIN whole w USING (source_id)
  LEFT JOIN page_starts o ON p.source_id = o.source_id AND p.pdf_page = o.page_number LEFT JOIN page_starts f ON p.source_id = f.source_id AND p.next_page = f.page_number),
found AS (
  SELECT source_id, 0::BIGINT AS entry, 0::BIGINT AS free, CAST(NULL AS BIGINT) AS start FROM whole
  UNION ALL
  SELECT source_id, entry, CASE WHEN hit THEN greatest(free, low + length(regexp_extract(part, '(?is)^(.*?)' || pattern)))  ELSE free END, CASE WHEN hit THEN low + length(regexp_extract(part, '(?is)^(.*?)' || pattern, 1)) END
  FROM (SELECT *, regexp_matches(part, '(?i)' || pattern) AS hit FROM (
    SELECT w.source_id, w.entry, f.free, w.pattern, greatest(f.free, coalesce(w.own, f.free)) AS low, w.text[greatest(f.free, coalesce(w.own, f.free)) + 1 : least(length(w.text), greatest(w.following + 20000, coalesce(w.own, f.free) + 30000))] AS part
    FROM found f JOIN wanted w ON f.source_id = w.source_id AND w.entry = f.entry + 1))),
bodies AS (
  SELECT p.*, {clean_block("body")} AS body FROM placed p JOIN (
    SELECT source_id, entry, text[start + 1 : coalesce(lead(start) OVER (PARTITION BY source_id ORDER BY entry), length(text))] AS body FROM found JOIN whole USING (source_id) WHERE start IS NOT NULL) b USING (source_id, entry)),
kept AS (SELECT *, {tags("anchor", "chapter_title")} AS candidates FROM bodies WHERE length(body) >= 80),
toc_units AS (
  SELECT source_id, entry, key, title, {first_tags("candidates")} AS topic_tags, {role("title", "is_chapter")} AS pedagogical_role, md5({truncate("body", 9000)}) AS body_md5,
    CASE WHEN is_chapter THEN lag(key) OVER (PARTITION BY source_id, is_chapter ORDER BY entry) WHEN chapter_key IS NOT NULL THEN coalesce(lag(key) OVER (PARTITION BY source_id, is_chapter, chapter_key ORDER BY entry), chapter_key) END AS prerequisite_key
  FROM kept)"""

PAGES = rf"""
page_rows AS (SELECT source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, coalesce(text, '') AS text FROM documents),
ranges AS (SELECT source_id, page_number, coalesce(sum(length(text) + 2) OVER (PARTITION BY source_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin, length(text) AS n FROM page_rows WHERE text <> ''),
joined AS (SELECT source_id, {strip("string_agg(text, chr(10) || chr(10) ORDER BY page_number)")} AS t FROM page_rows WHERE text <> '' GROUP BY source_id),
starts AS (SELECT source_id, t, unnest(range(0, greatest(0, CAST(ceil((length(t) - 1000) / 900.0) AS BIGINT)) * 900 + 1, 900)) AS s FROM joined WHERE t <> ''),
pieces AS (SELECT source_id, s AS char_start, least(s + 1000, length(t)) AS char_end, {strip("substring(t, s + 1, 1000)")} AS chunk_text FROM starts),
chunks AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY char_start) - 1 AS chunk_index FROM pieces WHERE chunk_text <> ''),
paged AS (
  SELECT c.source_id, chunk_index, char_start, char_end, any_value(chunk_text) AS chunk_text, min(page_number) AS page_start, max(page_number) AS page_end
  FROM chunks c LEFT JOIN ranges r ON c.source_id = r.source_id AND char_start <= begin + n AND char_end >= begin GROUP BY ALL)"""

SLIDES = rf"""
slide_lines AS (SELECT source AS deck_id, 's' || doc_id AS slide_id, list_filter(list_transform(regexp_split_to_array(text, '{BREAK}'), lambda x: {strip("x")}), lambda x: x <> '') AS lines FROM documents),
words AS (
  SELECT slide_id, unnest(w) AS w, unnest(range(len(w))) AS pos
  FROM (SELECT slide_id, list_transform(regexp_split_to_array(replace(array_to_string(lines, ' '), '/', ' '), '\s+'), lambda t: regexp_replace(t, '^[ ,.:;()]+|[ ,.:;()]+$', '', 'g')) AS w FROM slide_lines)),
firsts AS (SELECT slide_id, arg_min(w, pos) AS w, min(pos) AS pos FROM words WHERE length(w) >= 4 AND regexp_matches(w, '^[\p{{L}}\p{{N}}]') GROUP BY slide_id, lower(w)),
terms AS (SELECT slide_id, list(w ORDER BY pos) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY pos) AS nth FROM firsts) WHERE nth <= 6 GROUP BY slide_id),
slides AS (
  SELECT deck_id, l.slide_id, coalesce(lines[1], 'Slide ' || l.slide_id) AS title, lines[2:6] AS key_points, coalesce(terms, []) AS terms,
    list_filter(lines[2:], lambda x: contains(lower(x), 'example') OR contains(lower(x), 'e.g.'))[1:3] AS examples, array_to_string(lines, chr(10)) AS raw_text
  FROM slide_lines l LEFT JOIN terms t ON l.slide_id = t.slide_id),
grid AS (
  SELECT s.*, p AS student_profile, t AS task_type, lower(concat_ws(' ', title, array_to_string(key_points, ' '), array_to_string(terms, ' '), array_to_string(examples, ' '), raw_text)) AS blob
  FROM slides s, (VALUES ('weak'), ('average'), ('strong')) a(p), (VALUES ('explain_back'), ('short_qa'), ('confusion_report'), ('coverage_check')) b(t) WHERE t <> 'coverage_check' OR p = 'strong'),
tagged AS (
  SELECT deck_id, student_profile, task_type, 'confusion' AS kind, unnest([CASE WHEN contains(blob, 'supervised') THEN 'label_usage' END, CASE WHEN contains(blob, 'pattern') THEN 'pattern_definition' END,
    CASE WHEN task_type = 'confusion_report' AND NOT contains(blob, 'example') THEN 'needs_worked_example' END, CASE student_profile WHEN 'weak' THEN 'terminology_overload' WHEN 'average' THEN 'pace_jump' END]) AS tag FROM grid
  UNION ALL SELECT deck_id, student_profile, task_type, 'prerequisite', unnest(list_distinct([CASE WHEN contains(blob, 'model') OR contains(blob, 'algorithm') THEN 'basic_statistics' END, CASE WHEN student_profile = 'weak' THEN terms[1] END])) FROM grid
  UNION ALL SELECT deck_id, student_profile, task_type, 'misconception', unnest([CASE WHEN task_type = 'coverage_check' THEN 'missing_boundary_conditions' END, CASE WHEN student_profile = 'strong' THEN 'oversimplified_explanation' END,
    CASE WHEN student_profile = 'strong' AND len(examples) = 0 THEN 'missing_counterexample' END]) FROM grid)"""


def oracle_sql() -> dict[str, str]:
    c = f"WITH {COMPILED}\n"
    return {
        "text_sections": c + "SELECT source_id, entry AS section_index, key, title, md5(body) AS body_md5, lag(key) OVER (PARTITION BY source_id ORDER BY entry) AS prerequisite_key FROM sections",
        "compiled_units": c + f"SELECT source_id, entry, key, title, md5(summary) AS summary_md5, md5(body_text) AS body_md5, {first_tags('candidates')} AS topic_tags, pedagogical_role, prerequisite_key FROM compiled",
        "new_units": c + "SELECT source_id, count(*) AS n, min(title) AS first_title FROM fresh GROUP BY source_id",
        "unit_prerequisites": c + f"""SELECT s.knowledge_id, s.source_id, s.title, s.module_tag, s.week_tag, 'draft' AS approval_status, 'intro_undergrad' AS difficulty_level, 'text' AS source_type, s.source_id AS source_ref,
  coalesce(p.knowledge_id, '') AS prerequisite_links FROM stored s LEFT JOIN stored p ON s.source_id = p.source_id AND s.prerequisite_key = p.key""",
        "compile_status": c + """SELECT h.source_id, count(k.key) AS generated, count(f.key) AS stored, CASE WHEN count(k.key) = 0 THEN 'stub' WHEN count(f.key) = 0 THEN 'existing' ELSE 'stored' END AS status
FROM headed h LEFT JOIN compiled k ON h.source_id = k.source_id LEFT JOIN (SELECT * FROM compiled WHERE source_id NOT LIKE '%7') f ON k.source_id = f.source_id AND k.key = f.key GROUP BY h.source_id""",
        "compile_summary": c + "SELECT source_id, count(*) AS generated_unit_count, string_agg(title, '|' ORDER BY entry) FILTER (WHERE nth <= 20) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY entry) AS nth FROM compiled) GROUP BY source_id",
        "existing_units": c + "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY knowledge_id) AS position, knowledge_id, title FROM stored",
        "chunk_pages": f"WITH {PAGES}\nSELECT source_id, chunk_index, page_start, page_end FROM paged",
        "chunk_manifest": f"WITH {PAGES}\nSELECT 'src::' || source_id || '::chunk::' || chunk_index AS chunk_id, source_id, 'pdf' AS source_type, 'books' AS module_tag, '' AS week_tag, chunk_index, char_start, char_end, page_start, page_end, md5(chunk_text) AS text_md5 FROM paged",
        "structured_slides": f"WITH {SLIDES}\nSELECT deck_id, slide_id, title, len(key_points)::BIGINT AS n_key_points, array_to_string(terms, '|') AS terms, len(examples)::BIGINT AS n_examples FROM slides",
        "rule_tags": f"WITH {SLIDES}\nSELECT deck_id, student_profile, task_type, kind, tag, count(*) AS n FROM tagged WHERE tag <> '' GROUP BY ALL",
        "printed_offsets": f"WITH {BOOK}\nSELECT source_id, gap AS printed_offset FROM offsets",
        "toc_units": f"WITH RECURSIVE {BOOK},{LOCATED}\nSELECT source_id, entry, key, title, topic_tags, pedagogical_role, prerequisite_key, body_md5 FROM toc_units",
        "routed_units": f"""WITH owners AS (SELECT concat_ws('#', source, CAST(n // 30 AS VARCHAR)) AS book, 'src_' || doc_id AS owner FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 30 = 0),
contents AS MATERIALIZED (SELECT owner AS source_id, t.* EXCLUDE (source_id) FROM (WITH RECURSIVE {BOOK},{LOCATED}\nSELECT * FROM toc_units) t JOIN owners ON t.source_id = book),
plain AS (SELECT * FROM (WITH {COMPILED}\nSELECT source_id, entry, key, title, {first_tags('candidates')} AS topic_tags, pedagogical_role, prerequisite_key, md5(body_text) AS body_md5 FROM compiled))
SELECT source_id, entry, key, title, topic_tags, pedagogical_role, prerequisite_key, body_md5 FROM contents
UNION ALL SELECT source_id, entry, key, title, topic_tags, pedagogical_role, prerequisite_key, body_md5 FROM plain WHERE source_id NOT IN (SELECT source_id FROM contents)""",
        "toc_entries": f"WITH {BOOK}\nSELECT source_id, entry, CASE WHEN is_chapter THEN 'chapter' ELSE 'section' END AS kind, key, title, anchor, chapter_key, pdf_page FROM placed",
    }
