"""Reading, writing and registering: what goes out must come back."""

import json

from courseflow.functions import text as fx
from courseflow.operators import analytics, chunks, graph, qa, retrieval, signals
from courseflow.operators import compile as comp
from courseflow.sources import tables
from courseflow.streaming import incremental
from pyspark.sql import functions as F

UNIT = {"title": "T", "summary": "S", "body_text": "B", "module_tag": "", "week_tag": "w9", "topic_tags": ["t"], "difficulty_level": "hard", "pedagogical_role": "concept", "source_type": "", "source_ref": [], "approval_status": "approved", "prerequisite_links": ["ku_x"], "learning_outcome_links": ["lo"]}


def test_register_files(spark, tmp_path):
    (tmp_path / "a b.PDF").write_bytes(b"x")
    (tmp_path / "c.py").write_bytes(b"print()")
    rows = {r.filename: r for r in tables.register_files(spark, str(tmp_path), "m", "me", F.current_timestamp(), "w1").collect()}
    assert rows["c.py"].source_type == "code" and rows["c.py"].week_tag == "w1" and rows["c.py"].hash.startswith("sha256_")
    assert len({r.source_id for r in rows.values()}) == 2 and all(r.storage_path for r in rows.values())
    assert sorted(r.source_type for r in rows.values()) == ["code", "pdf"]


def test_texts_are_read_with_invalid_bytes_replaced(spark, tmp_path):
    for name, raw in (("a.txt", "é\n".encode()), ("b.txt", b"x\xffy"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r.text for r in tables.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é\n", "b.txt": "x�y", "c.txt": None}


def test_empty_uploads_have_a_row_and_the_hash_of_no_bytes(spark, tmp_path):
    import hashlib

    from courseflow.sources import files

    (tmp_path / "deep").mkdir()
    for name, raw in (("empty.txt", b""), ("deep/b.txt", b"b"), ("deep/empty.md", b""), (".hidden", b"x"), ("_SUCCESS", b"")):
        (tmp_path / name).write_bytes(raw)
    found = files.read_files(spark, str(tmp_path), 2)
    assert found.rdd.getNumPartitions() == 2
    plain = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).collect()}
    got = {r.path: bytes(r.content) for r in found.collect()}
    assert len(got) == 3 and plain.items() <= got.items()
    rows = {r.filename: r for r in tables.register_files(spark, str(tmp_path), "m", "me", F.current_timestamp()).collect()}
    assert rows["empty.txt"].hash == "sha256_" + hashlib.sha256(b"").hexdigest() == rows["empty.md"].hash and rows["empty.txt"].source_id != rows["empty.md"].source_id


def test_database_tables_are_read_in_ranges_and_merged(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    first = spark.range(1, 101).selectExpr("id", "cast(id * 2 as int) as n")
    tables.write_database(first, url, "numbers", driver=driver)
    back = tables.read_database(spark, url, "numbers", "id", 5, driver=driver)
    assert back.rdd.getNumPartitions() == 5 and sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(1, 101)]
    change = spark.range(91, 121).selectExpr("id", "cast(-id as int) as n")
    for _ in range(2):  # a repeated write changes nothing
        tables.merge_database(change, url, "numbers", "id", driver=driver)
    want = [(i, 2 * i if i < 91 else -i) for i in range(1, 121)]
    assert sorted(map(tuple, tables.read_database(spark, url, "numbers", driver=driver).collect())) == want


def test_pages_come_back_and_are_complete(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, None), ("b", 1, "x" * 7)], "source_id string, page_number int, text string")
    tables.write_pages(pages, str(tmp_path / "p"))
    back = tables.read_pages(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == [("a", 1, 3, "one"), ("a", 2, 0, ""), ("b", 1, 7, "x" * 7)]
    expected = spark.createDataFrame([("a", 2), ("b", 2)], "source_id string, page_count int")
    assert [r.source_id for r in tables.complete_sources(back, expected).collect()] == ["a"]
    assert tables.complete_sources(back, expected.where("source_id = 'a'")).count() == 2


def test_chunk_manifest_has_the_fields_of_its_source(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 1500), ("a", 2, "y" * 200)], "source_id string, page_number int, text string")
    sources = spark.createDataFrame([("a", "pdf", "m", None)], "source_id string, source_type string, module_tag string, week_tag string")
    rows = chunks.chunk_manifest(chunks.page_chunks(pages), sources).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.week_tag, r.page_start, r.page_end) for r in rows] == [("src::a::chunk::0", "", 1, 1), ("src::a::chunk::1", "", 1, 2)]


def test_long_texts_are_cut_like_short_ones(spark):
    text = "".join(chr(97 + i % 23) + (" " if i % 7 == 0 else "") for i in range(150_000)) + "  "
    rows = chunks.text_chunks(spark.createDataFrame([("s", text)], "source_id string, text string")).orderBy("chunk_index").collect()
    whole = text.strip()
    at = list(range(0, max(0, -(-(len(whole) - 1000) // 900)) * 900 + 1, 900))
    assert [(r.char_start, r.char_end, r.chunk_text) for r in rows] == [(a, min(a + 1000, len(whole)), whole[a : a + 1000].strip()) for a in at]


def test_explicit_units_bring_their_own_fields(spark, tmp_path):
    other = {**UNIT, "title": "U", "module_tag": "own", "week_tag": None, "source_type": "code", "source_ref": ["s8", "s9"]}
    (tmp_path / "c.json").write_text(json.dumps({"source_id": "s1", "compiled_units": [UNIT, other]}, indent=1))
    compiled = tables.read_json(spark, str(tmp_path), tables.COMPILED_UNITS, multi_line=True)
    assert [r.title for r in tables.explode_units(compiled).orderBy("pos").collect()] == ["T", "U"]
    sources = spark.createDataFrame([("s1", "m", "w", "pdf")], "source_id string, module_tag string, week_tag string, source_type string").withColumn("created_at", F.current_timestamp())
    rows = {r.key: r for r in comp.stored_units(comp.explicit_units(compiled), sources).collect()}
    one, two = rows["manual_1"], rows["manual_2"]
    assert (one.module_tag, one.week_tag, one.source_type, one.source_ref) == ("m", "w9", "pdf", ["s1"])
    assert (two.module_tag, two.week_tag, two.source_type, two.source_ref) == ("own", "w", "code", ["s8", "s9"])
    assert all(r.approval_status == "draft" and r.version_number == 1 and r.prerequisite_links == ["ku_x"] and r.difficulty_level == "hard" and r.created_at == r.updated_at for r in rows.values())
    made = comp.explicit_units(compiled).select("source_id", "entry", "key", "title", "summary", "body_text", "topic_tags", "pedagogical_role")
    payload = json.loads(comp.compile_payloads(made, sources).first().payload)
    assert payload["source_id"] == "s1" and [u["title"] for u in payload["compiled_units"]] == ["T", "U"]


def test_generated_links_follow_explicit_ones(spark):
    sources = spark.createDataFrame([("s", "m", "w", "text")], "source_id string, module_tag string, week_tag string, source_type string").withColumn("created_at", F.current_timestamp())
    units = spark.createDataFrame([("s", 1, "k1", "A", None, ["ku_1"]), ("s", 2, "k2", "B", "k1", ["ku_1", "ku_1"]), ("s", 3, "k3", "C", "gone", None)], "source_id string, entry int, key string, title string, prerequisite_key string, prerequisite_links array<string>")
    full = units.withColumns({c: F.lit("x") for c in ("summary", "body_text", "pedagogical_role")}).withColumn("topic_tags", F.array(F.lit("x")))
    rows = {r.key: r for r in comp.stored_units(full, sources).collect()}
    assert rows["k1"].prerequisite_links == ["ku_1"] and rows["k2"].prerequisite_links == ["ku_1", rows["k1"].knowledge_id] and rows["k3"].prerequisite_links == []


def test_signals_are_stored_as_text_and_appended(spark, tmp_path):
    rows = [("g1", "d1", ["k"], ["a (2)"], [], None, ["r1", "r2"])]
    df = spark.createDataFrame(rows, "signal_id string, tested_deck_id string, related_knowledge_ids array<string>, weak_topics array<string>, repeated_confusion_points array<string>, misconception_clusters array<string>, evidence_refs array<string>").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    path = str(tmp_path / "signals")
    for _ in range(2):
        tables.store_signals(df, path)
    assert spark.read.parquet(path).first().weak_topics == '["a (2)"]'
    back = tables.load_signals(spark, path).collect()
    assert len(back) == 2 and back[0].evidence_refs == ["r1", "r2"] and back[0].misconception_clusters == []


def test_database_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, said string")
    tables.write_database(df, url, "units", **driver)
    tables.write_database(df.limit(1), url, "units", **driver)
    assert sorted(r.n for r in tables.read_database(spark, url, "units", **driver).collect()) == [1, 1, 2]


def _decks(spark, tmp_path):
    deck = {"deck_id": "d", "module_tag": "m", "week_tag": "w", "topic_tags": ["t"], "slides": [{"slide_id": f"s{i}", "title": f"T{i}", "key_points": [f"k{i}"], "terms": [], "examples": [], "raw_text": "r"} for i in (1, 2)]}
    (tmp_path / "decks.json").write_text(json.dumps(deck))
    return tables.read_json(spark, str(tmp_path / "decks.json"), tables.DECKS)


def test_request_payloads(spark, tmp_path):
    decks = _decks(spark, tmp_path)
    slides = tables.explode_slides(decks)
    assert [(r.slide_pos, r.slide_id) for r in slides.orderBy("slide_pos").collect()] == [(0, "s1"), (1, "s2")]
    grid = signals.evaluation_grid(slides.select("deck_id", "slide_id"))
    runs = tables.run_payloads(decks, grid).collect()
    body = json.loads(next(r.payload for r in runs if r.slide_id == "s2" and r.task_type == "short_qa"))
    assert len(runs) == 20 and body["slide"]["title"] == "T2" and body["topic_tags"] == ["t"]
    questions = spark.createDataFrame([("d", "q1", "why", ["s2"]), ("d", "q2", "how", [])], "deck_id string, question_id string, prompt string, slide_refs array<string>")
    stages = spark.createDataFrame([("before", "no"), ("after", "help")], "stage string, support string")
    asked = {(r.question_id, r.stage): json.loads(r.payload) for r in tables.qa_payloads(questions, slides, stages).collect()}
    assert len(asked) == 4 and [s["slide_id"] for s in asked["q1", "after"]["slides"]] == ["s2"] and asked["q1", "after"]["slides"][0]["key_points"] == ["k2"]
    assert [s["slide_id"] for s in asked["q2", "before"]["slides"]] == ["s1", "s2"] and "support" not in asked["q2", "before"] and asked["q1", "after"]["support"] == "help"


def test_analytics_documents(spark, tmp_path):
    row = ("d", ["t1"], ["c t1"], ["m"], ["p"], ["r1", "r2"], ["run"])
    s = spark.createDataFrame([row], "deck_id string, weak_topics array<string>, repeated_confusion_points array<string>, misconception_clusters array<string>, missing_prerequisite_patterns array<string>, recommended_revision_targets array<string>, evidence_refs array<string>")
    decks = spark.createDataFrame([("d", ["s1", "s2"])], "deck_id string, slide_refs array<string>")
    found = analytics.issues(s, decks)
    assert all(r.slide_refs == ["s1", "s2"] and r.evidence_refs == ["run"] for r in found.collect())
    recs = analytics.recommendations(found)
    tables.write_documents(analytics.export_documents(s, found, recs), str(tmp_path / "out"))
    line = json.loads(json.loads(spark.read.text(str(tmp_path / "out")).first().value)["document"])
    assert [i["issue_type"] for i in line["issues"]] == ["missing_prerequisite", "misconception", "weak_topic", "confusion"] or len(line["issues"]) == 4
    assert {r["action"] for r in line["recommendations"]} >= {"add_prerequisite_slide", "regenerate_deck_section"} and line["proposal_candidates"][0]["rationale"].startswith("Missing prerequisite")
    section = next(r for r in line["recommendations"] if r["action"] == "regenerate_deck_section")
    assert section["target_slide_refs"] == ["r1", "r2"] and section["source_issue_ids"] == ["ISS_001", "ISS_002", "ISS_003"]


def test_records_are_replaced_by_id(spark, tmp_path):
    path = str(tmp_path / "records")
    batch = lambda rows: spark.createDataFrame(rows, "id string, document string, write_seq long")
    incremental.upsert_records(batch([("a", "1", 1), ("b", "1", 1)]), path, buckets=4)  # no table yet
    incremental.upsert_records(batch([("a", "2", 2), ("c", "2", 2)]), path, buckets=4)
    incremental.upsert_records(batch([]), path, buckets=4)
    assert sorted((r.id, r.document) for r in incremental.stored_records(spark, path, batch([]).schema).collect()) == [("a", "2"), ("b", "1"), ("c", "2")]


def test_units_are_stored_where_no_table_is_yet(spark, tmp_path):
    batch = spark.createDataFrame([("s", "k", "One")], "source_id string, key string, title string")
    for _ in range(2):
        incremental.append_new_units(batch, str(tmp_path / "units"))
    assert spark.read.parquet(str(tmp_path / "units")).count() == 1


def test_only_touched_decks_are_refreshed(spark, tmp_path):
    from courseflow.plans import queries
    from courseflow.sources import bindings

    sf = "/root/testdata/sf0.001"
    runs, slides = bindings.runs(spark, sf), bindings.slides(spark, sf)
    got = incremental.refresh_decks(runs.where("deck_id in ('deck_3', 'deck_7')").limit(1000), runs, slides)
    want = queries._signals(spark, sf).where("deck_id in ('deck_3', 'deck_7')")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2


def test_graph_direction_filters_and_order(spark):
    sources = spark.createDataFrame([("s1", "a.txt", "text", "m", "w1", "u", 2), ("s2", "ring.pdf", "pdf", "m", "w1", "u", 1), ("s3", "c.txt", "text", "n", "w1", "u", 3)], "source_id string, filename string, source_type string, module_tag string, week_tag string, uploader string, created_at int")
    units = spark.createDataFrame([("k1", "The ring", "about", "m", "w1", "approved", "concept", ["t"], ["s1", "s3"], ["k2", "kx"], 9), ("k2", "Other", "a ring", "m", "w2", "draft", "example", [], ["s2"], [], 8)], "knowledge_id string, title string, summary string, module_tag string, week_tag string, approval_status string, pedagogical_role string, topic_tags array<string>, source_ref array<string>, prerequisite_links array<string>, updated_at int")
    nodes, edges = graph.nodes(sources, units), graph.edges(units)
    assert {(r.source, r.target, r.edge_type) for r in edges.collect()} == {("s1", "k1", "derived_from"), ("s3", "k1", "derived_from"), ("s2", "k2", "derived_from"), ("k2", "k1", "prerequisite")}
    shown = lambda **f: {r.node_id for r in graph.visible(nodes, edges, **f)[0].collect()}
    assert shown(search=" RING ", module="m") == {"k1", "k2", "s1", "s2"}  # a linked source of another module stays hidden
    assert shown(search="ring", status="approved") == {"k1", "s1", "s3", "s2"}  # a source that is found needs no link
    assert shown(source_type="pdf", role="concept") == {"k1", "s2"} and shown(week="w2") == {"k2"}
    assert [r.node_id for r in graph.ordered(nodes).collect()] == ["s2", "s1", "s3", "k2", "k1"]
    facets = graph.facets(nodes).first()
    assert facets.module_tag == ["m", "n"] and facets.source_type == ["pdf", "text"] and facets.pedagogical_role == ["concept", "example"]


def test_requests_without_a_module_come_in_any_number(spark):
    units = spark.createDataFrame([(f"k{i}", f"title {i}", "s", "b", "m", "w", ["x"], "easy", "concept", "approved", ["s1"], 1) for i in range(20)], "knowledge_id string, title string, summary string, body_text string, module_tag string, week_tag string, topic_tags array<string>, difficulty_level string, pedagogical_role string, approval_status string, source_ref array<string>, updated_at int")
    asked = spark.range(10_300).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit(None).cast("string").alias("module"), F.lit("").alias("week"), F.concat(F.lit("title "), (F.col("id") % 20).cast("string")).alias("topic"), F.lit(None).cast("string").alias("difficulty_level"))
    rows = retrieval.matches(asked, units)
    exact = rows.where("topic_score = 0")
    assert exact.count() == 10_300 and exact.where("u_title <> topic").count() == 0


def test_contents_without_a_printed_page_number_are_no_route(spark):
    body = "This body is long enough to be kept as a unit of its own, since it has more than one hundred and twenty characters in its only line."
    pages = spark.createDataFrame([("b", 1, f"Table of Contents\nAlpha 1\nIndex 9\nAlpha\n{body}")], "source_id string, page_number int, text string")
    texts = pages.select("source_id", "text")
    assert comp.toc_units(pages).count() == 0
    units = comp.compiled_units(texts, pages).collect()
    assert units and all(u.key.startswith("text_section_") for u in units)


def test_hash_embedding_equals_built_in_functions_and_takes_a_hook(spark):
    import pandas as pd

    df = spark.createDataFrame([("a",), ("é\n",), (None,)], "t string")
    for r in df.select(fx.hash_embedding(F.col("t")).alias("a"), fx.plain_hash_embedding(F.col("t")).alias("b")).collect():
        assert r.a == r.b or max(abs(x - y) for x, y in zip(r.a, r.b)) < 1e-12
    own = fx.embedding(F.col("t"), lambda texts: pd.Series([[float(len(t or ""))] for t in texts]))
    assert [r.v for r in df.select(own.alias("v")).collect()] == [[1.0], [2.0], [0.0]]


def test_unknown_questions_and_names(spark):
    runs = spark.createDataFrame([("r1", "done"), ("r2", "done")], "run_id string, status string")
    jobs = spark.createDataFrame([("j", ["r2", "x", "r1", "r2"])], "job_id string, run_ids array<string>")
    assert [(r.pos, r.run_id) for r in signals.job_runs(jobs, runs).orderBy("pos").collect()] == [(0, "r2"), (2, "r1"), (3, "r2")]
    records = spark.createDataFrame([("b", "after", "q1", False, "weak", "p", "s", "c", ["m"], ["s1"])], "benchmark_id string, stage string, question_id string, is_correct boolean, student_profile string, prompt string, student_answer string, correct_answer string, missed_concepts array<string>, evidence_slide_refs array<string>")
    item = qa.handoff_items(records).first()
    assert item.priority == "high" and item.affected_profiles == ["weak"] and item.slide_refs == ["s1"]
