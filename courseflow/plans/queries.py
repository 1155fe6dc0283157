"""Registered queries: library operators over the bound test tables, results flattened to plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.functions import text as fx
from courseflow.operators import analytics, chunks, deck_state, graph, postings, qa, retrieval, signals
from courseflow.operators import compile as comp
from courseflow.sources import bindings as b
from courseflow.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def _joined(name: str, sep: str = "|") -> Column:
    return F.array_join(name, sep).alias(name)


def tag_counts(s: SparkSession, d: str) -> DataFrame:
    return signals.tag_counts(b.runs(s, d)).select("deck_id", "kind", "tag", "n")


def tag_counts_by_profile(s: SparkSession, d: str) -> DataFrame:
    return signals.tag_counts_by_profile(b.runs(s, d)).select("deck_id", "student_profile", "kind", "tag", "n")


def tag_counts_all_levels(s: SparkSession, d: str) -> DataFrame:
    return signals.tag_counts_all_levels(b.runs(s, d)).select("deck_id", F.coalesce("student_profile", F.lit("all")).alias("student_profile"), "kind", "tag", "n")


def weak_topics_top5(s: SparkSession, d: str) -> DataFrame:
    return signals.top_labels(signals.tag_counts(b.runs(s, d))).where("kind = 'weak_topic'").select("deck_id", _joined("labels"))


def top_labels_all(s: SparkSession, d: str) -> DataFrame:
    return signals.top_labels(signals.tag_counts(b.runs(s, d))).select("deck_id", "kind", _joined("labels"))


def tag_shares(s: SparkSession, d: str) -> DataFrame:
    return signals.tag_shares(signals.tag_counts(b.runs(s, d))).select("deck_id", "kind", "tag", F.round("bar", 6).alias("bar"), F.round("heat", 6).alias("heat"))


def slide_issue_counts(s: SparkSession, d: str) -> DataFrame:
    return signals.slide_issue_counts(b.runs(s, d), b.slides(s, d)).select("deck_id", "slide_id", "slide_title", "n", F.col("rank").cast("long").alias("rank"))


def revision_targets(s: SparkSession, d: str) -> DataFrame:
    return signals.revision_targets(b.runs(s, d), b.slides(s, d)).select("deck_id", "slide_id", "priority", _joined("issue_types"), _joined("affected_profiles"), "label")


def representative_evidence(s: SparkSession, d: str) -> DataFrame:
    return signals.representative_evidence(b.runs(s, d)).select("deck_id", "student_profile", "run_id", F.col("score").cast("long").alias("score"), "main_answer", _joined("evidence_slide_refs"), F.col("position").cast("long").alias("position"))


def evidence_refs(s: SparkSession, d: str) -> DataFrame:
    return signals.evidence_refs(b.runs(s, d)).select("deck_id", "run_id", F.col("pos").cast("long").alias("pos"), _joined("slide_refs"), "task_type", "student_profile")


def flatten_runs(s: SparkSession, d: str) -> DataFrame:
    return signals.flatten_runs(b.runs(s, d)).select("run_id", "status", "answer_text", F.coalesce(F.array_join("confusion_tags", "|"), F.lit("none")).alias("confusion_tags"), F.coalesce(F.array_join("evidence_slides", "|"), F.lit("none")).alias("evidence_slides"), F.transform("evidence_refs", lambda r: F.concat_ws("~", r["run_id"], F.array_join(r["slide_refs"], "+"), r["task_type"], r["student_profile"])).getItem(0).alias("evidence_ref"), F.coalesce("error_message", F.lit("none")).alias("error_message"))


def evaluation_grid(s: SparkSession, d: str) -> DataFrame:
    return signals.evaluation_grid(b.slides(s, d)).groupBy("deck_id", "student_profile", "task_type").agg(F.count("*").alias("n"))


def rule_tags(s: SparkSession, d: str) -> DataFrame:
    grid = signals.evaluation_grid(signals.structured_slides(b.page_slides(s, d)))
    tags = signals.rule_tags(grid)
    kinds = {"confusion": "confusion_tags", "prerequisite": "missed_prerequisites", "misconception": "misconception_flags"}
    of_kind = lambda kind, name: F.transform(name, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag")))
    every = F.concat(*[of_kind(kind, name) for kind, name in kinds.items()])
    each = tags.select("deck_id", "student_profile", "task_type", F.explode(every).alias("t")).select("deck_id", "student_profile", "task_type", "t.*")
    return each.groupBy("deck_id", "student_profile", "task_type", "kind", "tag").agg(F.count("*").alias("n"))


def structured_slides(s: SparkSession, d: str) -> DataFrame:
    return signals.structured_slides(b.page_slides(s, d)).select("deck_id", "slide_id", "title", F.size("key_points").cast("long").alias("n_key_points"), _joined("terms"), F.size("examples").cast("long").alias("n_examples"))


def job_status(s: SparkSession, d: str) -> DataFrame:
    return signals.job_status(b.runs(s, d))


def profile_coverage(s: SparkSession, d: str) -> DataFrame:
    return analytics.profile_coverage(b.runs(s, d)).select("deck_id", "tag", "coverage", "runs")


def _signals(s: SparkSession, d: str) -> DataFrame:
    return signals.cohort_signal(b.runs(s, d), b.slides(s, d))


def cohort_signal(s: SparkSession, d: str) -> DataFrame:
    lists = ("weak_topics", "repeated_confusion_points", "misconception_clusters", "missing_prerequisite_patterns", "recommended_revision_targets")
    return _signals(s, d).select("deck_id", "signal_id", *[_joined(c) for c in lists], _joined("representative_run_ids"), "n_runs")


def _merged_state(s: SparkSession, d: str) -> DataFrame:
    """The decks' state as it grows by three batches of runs, written before it is read several times."""
    runs = b.runs(s, d)
    parts = [deck_state.state(runs.where(F.col("run_seq") % 3 == i)) for i in range(3)]
    return tables.written(deck_state.merged(deck_state.merged(parts[0], parts[1]), parts[2]), "deck_state")


def merged_signal(s: SparkSession, d: str) -> DataFrame:
    lists = ("weak_topics", "repeated_confusion_points", "misconception_clusters", "missing_prerequisite_patterns", "recommended_revision_targets")
    return deck_state.cohort_signal(_merged_state(s, d), b.slides(s, d)).select("deck_id", "signal_id", *[_joined(c) for c in lists], _joined("representative_run_ids"), "n_runs")


def signal_fields(s: SparkSession, d: str) -> DataFrame:
    return deck_state.signal_fields(_merged_state(s, d), b.slides(s, d)).select("deck_id", "field", "profile", F.col("position").cast("long").alias("position"), "label", "n")


def issue_evidence(s: SparkSession, d: str) -> DataFrame:
    return analytics.evidence_of(_issues(s, d), "issue_id", signals.evidence_refs(b.runs(s, d))).select("deck_id", "issue_id", "run_id", _joined("slide_refs"), "task_type", "student_profile")


def proposal_evidence(s: SparkSession, d: str) -> DataFrame:
    made = analytics.proposals(analytics.recommendations(_issues(s, d)))
    return analytics.evidence_of(made, "recommended_action", signals.evidence_refs(b.runs(s, d))).select("deck_id", "recommended_action", "run_id", _joined("slide_refs"), "task_type", "student_profile")


def signal_completeness(s: SparkSession, d: str) -> DataFrame:
    return analytics.completeness(_signals(s, d))


def _issues(s: SparkSession, d: str) -> DataFrame:
    return analytics.issues(_signals(s, d), signals.deck_slides(b.slides(s, d)))


def issues_ranked(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d).select("deck_id", "issue_type", "topic", "issue_text", F.col("score").cast("long").alias("score"), "severity", F.col("rank").cast("long").alias("rank"), "source_field", _joined("slide_refs"), _joined("representative_run_ids"), "rationale")


def recommendations(s: SparkSession, d: str) -> DataFrame:
    return analytics.recommendations(_issues(s, d)).select("deck_id", "action", F.col("score").cast("long").alias("score"), "priority", _joined("source_issue_ids"), F.col("rank").cast("long").alias("rank"), _joined("target_slide_refs"), _joined("target_knowledge_ids"), _joined("representative_run_ids"), "rationale")


def proposals(s: SparkSession, d: str) -> DataFrame:
    return analytics.proposals(analytics.recommendations(_issues(s, d))).select("deck_id", "recommended_action", "suggested_priority", F.col("score").cast("long").alias("score"), _joined("based_on_issue_ids"), _joined("target_knowledge_ids"), _joined("representative_run_ids"), "rationale")


def unknown_actions(s: SparkSession, d: str) -> DataFrame:
    recs = analytics.recommendations(_issues(s, d))
    renamed = recs.withColumn("action", F.when(F.col("rank") % 2 == 0, F.concat("action", F.lit("_x"))).otherwise(F.col("action")))
    return analytics.unknown_actions(renamed).select("deck_id", "action")


def issue_clusters(s: SparkSession, d: str) -> DataFrame:
    return analytics.issue_clusters(_issues(s, d)).select("deck_id", "dimension", "value", "n_issues", _joined("issue_ids"), "cluster_id")


def normalized_issues(s: SparkSession, d: str) -> DataFrame:
    return analytics.normalized_issues(_issues(s, d)).select("deck_id", "issue_id", "norm", "issue_type", "topic", "description", _joined("affected_slides"), _joined("source_evidence"), "merged")


def regenerate_hints(s: SparkSession, d: str) -> DataFrame:
    return analytics.regenerate_hints(analytics.recommendations(_issues(s, d)))


def cohort_insight(s: SparkSession, d: str) -> DataFrame:
    found = _issues(s, d)
    told = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws("~", *[x[f].cast("string") for f in fields])), "|").alias(name)
    return analytics.cohort_insight(found, analytics.issue_clusters(found)).select("deck_id", told("weak_topic_rankings", "topic", "severity", "score"), told("confusion_clusters", "cluster_id", "label", "issue_count"), _joined("missing_prerequisites"), _joined("affected_slide_refs"))


def trace_totals(s: SparkSession, d: str) -> DataFrame:
    step = F.struct(F.expr("cast(l_quantity as bigint)").alias("elapsed"), F.col("l_partkey").cast("long").alias("prompt_tokens"), F.col("l_suppkey").cast("long").alias("completion_tokens"))
    results = b.read(s, d, "lineitem").groupBy(F.expr("concat('deck_', l_orderkey)").alias("deck_id")).agg(F.collect_list(step).alias("trace"))
    return analytics.trace_totals(results)


def qa_passes(s: SparkSession, d: str) -> DataFrame:
    return qa.pass_results(b.qa_answers(s, d)).select("benchmark_id", "stage", "correct_count", "total", F.round("accuracy", 9).alias("accuracy"))


def qa_delta(s: SparkSession, d: str) -> DataFrame:
    return qa.improvement(b.qa_answers(s, d))


def qa_handoff(s: SparkSession, d: str) -> DataFrame:
    return qa.handoff(b.qa_answers(s, d)).select("benchmark_id", "unresolved_count", _joined("items"))


def handoff_items(s: SparkSession, d: str) -> DataFrame:
    lists = ("issue_types", "affected_profiles", "missed_concepts", "slide_refs")
    rows = qa.handoff_items(b.qa_records(s, d))
    return rows.select(*[_joined(c) if c in lists else c for c in rows.columns])


def normalized_answers(s: SparkSession, d: str) -> DataFrame:
    return qa.normalized_answers(b.raw_answers(s, d)).select("question_id", F.round("confidence", 6).alias("confidence"), "student_answer", _joined("missed_concepts"), _joined("evidence_slide_refs"))


def source_registry(s: SparkSession, d: str) -> DataFrame:
    pages = b.read(s, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://[^/]*/?", "/")
    name = fx.sanitize_filename(path)
    return pages.select("page_id", name.alias("filename"), fx.infer_source_type(name).alias("source_type"), fx.content_hash(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("hash"))


def source_listing(s: SparkSession, d: str) -> DataFrame:
    return retrieval.list_sources(b.sources(s, d), module="en", source_type="text").select("source_id", "filename", "week_tag", "hash")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return tables.spread(b.read(s, d, "documents").select(F.expr("concat('src_', doc_id)").alias("source_id"), "text"))


def text_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.text_chunks(_texts(s, d)).select("source_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5("chunk_text").alias("chunk_md5"))


def chunk_summary(s: SparkSession, d: str) -> DataFrame:
    return chunks.chunking_summary(chunks.text_chunks(_texts(s, d))).select("source_id", "chunk_count", F.col("extracted_char_count").cast("long").alias("extracted_char_count"), F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"))


def chunk_pages(s: SparkSession, d: str) -> DataFrame:
    found = chunks.page_chunks(b.page_texts(s, d))
    return found.select("source_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "page_start", "page_end")])


def chunk_manifest(s: SparkSession, d: str) -> DataFrame:
    pages = b.page_texts(s, d)
    books = pages.select("source_id").distinct().select("source_id", F.lit("pdf").alias("source_type"), F.lit("books").alias("module_tag"), F.lit(None).cast("string").alias("week_tag"))
    rows = chunks.chunk_manifest(chunks.page_chunks(pages), books)
    return rows.select("chunk_id", "source_id", "source_type", "module_tag", "week_tag", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end", "page_start", "page_end")], F.md5("chunk_text").alias("text_md5"))


def extraction_summary(s: SparkSession, d: str) -> DataFrame:
    return chunks.extraction_summary(b.page_texts(s, d))


def text_sections(s: SparkSession, d: str) -> DataFrame:
    return chunks.sections(b.headed_texts(s, d)).select("source_id", F.col("section_index").cast("long").alias("section_index"), "key", "title", F.md5("body").alias("body_md5"), "prerequisite_key")


def _compiled(s: SparkSession, d: str) -> DataFrame:
    return comp.compiled_units(b.headed_texts(s, d))


def _fresh(s: SparkSession, d: str) -> DataFrame:
    units = _compiled(s, d)
    known = units.where(F.length("title") % 2 == 0).select("title", F.array("source_id").alias("source_ref"))
    return comp.new_units(units, known)


def compiled_units(s: SparkSession, d: str) -> DataFrame:
    return _compiled(s, d).select("source_id", F.col("entry").cast("long").alias("entry"), "key", "title", F.md5("summary").alias("summary_md5"), F.md5("body_text").alias("body_md5"), _joined("topic_tags"), "pedagogical_role", "prerequisite_key")


def new_units(s: SparkSession, d: str) -> DataFrame:
    return _fresh(s, d).groupBy("source_id").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


def unit_prerequisites(s: SparkSession, d: str) -> DataFrame:
    return comp.stored_units(_fresh(s, d), b.sources(s, d)).select("knowledge_id", "source_id", "title", "module_tag", "week_tag", "approval_status", "difficulty_level", "source_type", _joined("source_ref"), _joined("prerequisite_links"))


def compile_status(s: SparkSession, d: str) -> DataFrame:
    units = _compiled(s, d)
    known = units.where("source_id like '%7'").select("title", F.array("source_id").alias("source_ref"))
    return comp.compile_status(b.sources(s, d), units, comp.new_units(units, known))


def compile_summary(s: SparkSession, d: str) -> DataFrame:
    return comp.compile_summary(_compiled(s, d)).select("source_id", "generated_unit_count", _joined("titles"))


def existing_units(s: SparkSession, d: str) -> DataFrame:
    return comp.existing_units(comp.stored_units(_fresh(s, d), b.sources(s, d))).select("source_id", F.col("position").cast("long").alias("position"), "knowledge_id", "title")


def _book(s: SparkSession, d: str) -> DataFrame:
    """Books with a table of contents derived from ``documents``: page 1 lists every page's first words. A
    source is as many books of 30 pages as it needs, so every document takes part. Books differ in their pages before
    number 1; every fourth page has no printed number; pages 11 and 22 are bound in far behind the place that is listed."""
    start = F.regexp_extract("text", r"^[^A-Za-z]*((?:[A-Za-z]+[^A-Za-z]*){0,4})", 1)  # as far as four words go
    pages = b.page_texts(s, d).withColumn("words", F.split(fx.collapse(F.regexp_replace(start, "[^A-Za-z ]", " ")), " "))
    book = F.floor((F.col("page_number") - 1) / 30)
    numbered = pages.withColumn("n", (F.col("page_number") - 1) % 30 + 1).withColumn("front", book % 3 + 1).withColumn("source_id", F.concat_ws("#", "source_id", book.cast("string")))
    titled = numbered.withColumn("heading", F.concat(F.when(F.col("n") % 5 == 1, F.concat(F.lit("Chapter "), "n", F.lit(": "))).otherwise(F.lit("")), F.array_join("words", " ")))
    index = titled.where("array_join(words, '') <> ''").groupBy("source_id").agg(F.concat(F.lit("Table of Contents\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("heading", F.lit(" "), "n").alias("line")))), lambda x: x["line"]), "\n"), F.lit("\nIndex 99")).alias("text")).withColumn("page_number", F.lit(1))
    printed = F.when(F.col("n") % 4 == 0, "").otherwise(F.concat(F.lit("[ "), "n", F.lit(" ]\n")))
    place = F.col("n") + F.col("front") + F.when(F.col("n") % 11 == 0, 1000).otherwise(0)
    bodies = titled.select("source_id", F.concat(printed, F.array_join("words", " "), F.lit("\n"), "text").alias("text"), place.cast("int").alias("page_number"))
    return index.select("source_id", "page_number", "text").unionByName(bodies.select("source_id", "page_number", "text"))


def toc_entries(s: SparkSession, d: str) -> DataFrame:
    return comp.toc_entries(_book(s, d)).select("source_id", F.col("entry").cast("long").alias("entry"), "kind", "key", "title", "anchor", "chapter_key", "pdf_page")


def printed_offsets(s: SparkSession, d: str) -> DataFrame:
    return comp.printed_offset(_book(s, d)).select("source_id", F.col("printed_offset").cast("long").alias("printed_offset"))


def toc_units(s: SparkSession, d: str) -> DataFrame:
    return comp.toc_units(_book(s, d)).select("source_id", F.col("entry").cast("long").alias("entry"), "key", "title", _joined("topic_tags"), "pedagogical_role", "prerequisite_key", F.md5("body_text").alias("body_md5"))


def routed_units(s: SparkSession, d: str) -> DataFrame:
    """Every document is a source with its text; the first document of each book also has the book's pages."""
    owners = b.book_owners(s, d)
    pages = _book(s, d).withColumnRenamed("source_id", "book").join(owners, "book").drop("book")
    return comp.compiled_units(b.headed_texts(s, d), pages).select("source_id", F.col("entry").cast("long").alias("entry"), "key", "title", _joined("topic_tags"), "pedagogical_role", "prerequisite_key", F.md5("body_text").alias("body_md5"))


def topic_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search(b.units(s, d), topic="ring, red widget", approval_status="approved").select("knowledge_id", "title", F.col("topic_score").cast("long").alias("topic_score"))


def text_query(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search(b.units(s, d), q="Economy RED", difficulty_level="easy").select("knowledge_id", "title", "module_tag")


def unit_text_matches(s: SparkSession, d: str) -> DataFrame:
    rows = b.units(s, d).select(F.col("knowledge_id").alias("id"), F.concat_ws(" ", "title", "summary", "body_text").alias("text"))
    return postings.text_matches(rows, b.unit_searches(s, d)).select("search_id", F.col("id").alias("knowledge_id"))


def document_text_matches(s: SparkSession, d: str) -> DataFrame:
    rows = tables.spread(b.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return postings.text_matches(rows, b.text_searches(s, d)).select("search_id", F.col("id").alias("doc_id"))


def bulk_approval(s: SparkSession, d: str) -> DataFrame:
    units = b.units(s, d)
    chosen = retrieval.bulk_selection(units, topic="ring")
    done = retrieval.approve(units, chosen, F.expr("timestamp '2025-01-01 00:00:00'"))
    return done.select("knowledge_id", "approval_status", (F.col("updated_at") == F.expr("timestamp '2025-01-01 00:00:00'")).alias("moved"))


def knowledge_summary(s: SparkSession, d: str) -> DataFrame:
    return retrieval.knowledge_summary(b.sources(s, d), b.units(s, d)).select("sources", "drafts", "approved", F.unix_timestamp("latest").alias("latest_s"))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    e = b.read(s, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    records = e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))
    return retrieval.vector_topk(asked, records, 8, {"label": "label"}).select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    u = b.units(s, d)
    text = fx.embedding_text(F.col("title"), F.col("summary"), F.col("body_text"), F.col("topic_tags"), F.col("pedagogical_role"))
    v = u.select("knowledge_id", fx.hash_embedding(text).alias("v"))
    return v.select("knowledge_id", F.round(F.get("v", F.lit(0)), 9).alias("v0"), F.round(F.get("v", F.lit(63)), 9).alias("v63"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    e = b.read(s, d, "embeddings").select(F.expr("concat('ku::', vec_id % 100, '::v1')").alias("id"), F.expr("concat('document ', vec_id)").alias("document"), F.col("vec_id").alias("write_seq"))
    return tables.upsert(e.where("write_seq % 2 = 0"), e.where("write_seq % 2 = 1"))


def _asked(s: SparkSession, d: str, semantic: bool = True) -> tuple[DataFrame, DataFrame]:
    """The different requests, and who asks them; what an answer is generated for counts for semantic search alone."""
    requests = b.requests(s, d)
    return retrieval.once(requests if semantic else requests.drop("generation_target"))


def context_bundle(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d, semantic=False)
    rows = retrieval.bundle(asks, b.units(s, d)).select("request_id", F.col("position").cast("long").alias("position"), "knowledge_id", F.coalesce("topic_score", F.lit(-1)).cast("long").alias("topic_score"))
    return retrieval.answered(rows, asking)


def unit_hits(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d)
    rows = retrieval.unit_hits(asks, b.units(s, d)).select(F.col("query_id").alias("request_id"), F.col("id").alias("knowledge_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
    return retrieval.answered(rows, asking)


def _semantic_bundle(s: SparkSession, d: str, asks: DataFrame) -> DataFrame:
    return retrieval.bundle(asks, b.units(s, d), tables.written(retrieval.unit_hits(asks, b.units(s, d)), "unit-hits"))


def context_bundle_semantic(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d)
    rows = _semantic_bundle(s, d, asks).select("request_id", F.col("position").cast("long").alias("position"), "knowledge_id", F.coalesce("topic_score", F.lit(-1)).cast("long").alias("topic_score"), F.coalesce("semantic_rank", F.lit(-1)).cast("long").alias("semantic_rank"))
    return retrieval.answered(rows, asking)


def bundle_sources(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d, semantic=False)
    rows = retrieval.bundle_sources(retrieval.bundle(asks, b.units(s, d)), b.sources(s, d)).select("request_id", "source_id", F.col("position").cast("long").alias("position"))
    return retrieval.answered(rows, asking)


def bundle_trace(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d, semantic=False)
    rows = retrieval.assemble(asks, retrieval.bundle(asks, b.units(s, d))).select("request_id", F.size("unit_ids").cast("long").alias("n_units"), F.md5(F.array_join("unit_ids", "|")).alias("units_md5"), F.md5(F.array_join("source_ids", "|")).alias("sources_md5"), "used_scope")
    return retrieval.answered(rows, asking)


def _chunk_rows(s: SparkSession, d: str) -> DataFrame:
    about = b.sources(s, d).select("source_id", "source_type", "module_tag", "week_tag")
    return chunks.text_chunks(_texts(s, d)).join(about, "source_id")


def _supporting(s: SparkSession, d: str, asks: DataFrame, bundled: DataFrame) -> DataFrame:
    pieces = tables.written(_chunk_rows(s, d), "chunks")  # searched, and shown
    refs = bundled.select("request_id", F.explode("source_ref").alias("source_id"))
    return retrieval.supporting_chunks(retrieval.chunk_hits(asks, pieces), pieces, refs)


def supporting_chunks(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d)
    rows = _supporting(s, d, asks, retrieval.bundle(asks, b.units(s, d))).select("request_id", "chunk_id", "source_id", "source_type", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end", "position")], F.md5("chunk_text").alias("text_md5"), "similarity_score")
    return retrieval.answered(rows, asking)


def bundle_served(s: SparkSession, d: str) -> DataFrame:
    asks, asking = _asked(s, d)
    bundled = tables.written(_semantic_bundle(s, d, asks), "bundles")  # used four times
    out = retrieval.served(asks, bundled, b.sources(s, d), _supporting(s, d, asks, bundled))
    item = lambda u: F.concat_ws("~", *[u[c] for c in ("knowledge_id", "title", "summary", "body_text", "pedagogical_role")], *[F.array_join(u[c], "+") for c in ("topic_tags", "prerequisite_links", "source_ref")], u["approval_status"], u["version_number"].cast("string"))
    digest = lambda name, f: F.md5(F.array_join(F.transform(name, f), "|"))
    t = "retrieval_trace."
    rows = out.select("request_id", F.array_join("topic_scope", ",").alias("topic_scope"), F.size("approved_context_bundle").cast("long").alias("n_items"), digest("approved_context_bundle", item).alias("items_md5"), F.array_join(F.transform("supporting_source_chunks", lambda c: F.concat_ws("~", c["chunk_id"], c["char_start"].cast("string"))), "|").alias("chunks"), digest("source_registry_refs", lambda r: F.concat_ws("~", r["source_id"], r["filename"], r["week_tag"])).alias("sources_md5"), F.col(t + "vector_search_used").alias("vector_search_used"), F.array_join(t + "vector_collections_queried", "|").alias("collections"), F.coalesce(t + "semantic_query_text", F.lit("none")).alias("query_text"), F.md5(F.array_join(t + "approved_knowledge_ids", "|")).alias("ids_md5"), F.array_join(t + "supporting_chunk_ids", "|").alias("chunk_ids"), F.coalesce(t + "metadata_filters.difficulty_level", F.lit("none")).alias("difficulty"))
    return retrieval.answered(rows, asking)


def bulk_filtered(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bulk_selection(b.units(s, d), week="week_3", topic="red,ring", pedagogical_role="concept", limit=7).select("knowledge_id", "title")


def approval_outcome(s: SparkSession, d: str) -> DataFrame:
    return retrieval.approval_outcome(b.approval_requests(s, d), b.units(s, d)).select("request_id", F.col("pos").cast("long").alias("pos"), "knowledge_id", "approved", F.coalesce("reason", F.lit("none")).alias("reason"))


def skipped_ids(s: SparkSession, d: str) -> DataFrame:
    chosen = retrieval.bulk_selection(b.units(s, d), topic="ring")
    return retrieval.skipped(b.approval_requests(s, d), chosen).select("request_id", F.col("pos").cast("long").alias("pos"), "knowledge_id")


def unit_lookup(s: SparkSession, d: str) -> DataFrame:
    ids = b.read(s, d, "supplier").select(F.expr("concat('ku_', s_suppkey * 40)").alias("knowledge_id"))
    return retrieval.look_up(b.units(s, d), ids, "knowledge_id").select("knowledge_id", "found", F.coalesce("title", F.lit("none")).alias("title"))


def selected_profiles(s: SparkSession, d: str) -> DataFrame:
    names = "array(element_at(array('weak', 'average', 'strong'), cast(n_nationkey % 3 + 1 as int)), 'none', 'strong', element_at(array('weak', 'average', 'strong'), cast(n_nationkey % 3 + 1 as int)))"
    asked = b.read(s, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.expr(names).alias("names"))
    return signals.select_requested(asked, b.runs(s, d).select("student_profile").distinct(), "student_profile").select("request_id", F.col("pos").cast("long").alias("pos"), "student_profile")


def job_runs(s: SparkSession, d: str) -> DataFrame:
    jobs = b.read(s, d, "orders").select(F.expr("concat('job_', o_orderkey)").alias("job_id"), F.expr("array(concat('run_', o_orderkey), concat('run_', o_custkey), 'run_none', concat('run_', o_orderkey))").alias("run_ids"))
    return signals.job_runs(jobs, b.runs(s, d)).select("job_id", F.col("pos").cast("long").alias("pos"), "run_id", "status")


def json_lists(s: SparkSession, d: str) -> DataFrame:
    u = b.units(s, d).select("knowledge_id", fx.dump_list(F.when(F.col("knowledge_id").endswith("7"), None).otherwise(F.col("topic_tags"))).alias("dumped"))
    said = F.when(F.col("knowledge_id").endswith("5"), "{\"a\": 1}").when(F.col("knowledge_id").endswith("6"), "no list").otherwise(F.col("dumped"))
    return u.select("knowledge_id", "dumped", F.array_join(fx.load_list(said), "|").alias("loaded"))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.nodes(b.sources(s, d), b.units(s, d))


def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    fields = ("node_id", "node_type", "label", "summary", "source_type", "module_tag", "week_tag", "uploader", "approval_status", "pedagogical_role")
    return _nodes(s, d).select(*fields, _joined("topic_tags"), _joined("source_ref"), F.unix_timestamp("updated_at").alias("updated_at"))


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(b.units(s, d))


def graph_neighbours(s: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(graph.edges(b.units(s, d))).groupBy("node_id").agg(F.count("*").alias("degree"), F.min("neighbour").alias("first_neighbour"))


def visible_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.visible(_nodes(s, d), graph.edges(b.units(s, d)), search=" 12", status="approved", source_type="text")[0]


def visible_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.visible(_nodes(s, d), graph.edges(b.units(s, d)), search="About red", status="approved")[1].select("source", "target", "edge_type")


def visible_in_week(s: SparkSession, d: str) -> DataFrame:
    return graph.visible(_nodes(s, d), graph.edges(b.units(s, d)), week="week_3", role="concept")[0]


def top_topics(s: SparkSession, d: str) -> DataFrame:
    return graph.top_topics(b.units(s, d))


def facets(s: SparkSession, d: str) -> DataFrame:
    return graph.facets(_nodes(s, d)).select(*[_joined(c) for c in ("module_tag", "week_tag", "pedagogical_role", "source_type")])


def model_answers(s: SparkSession, d: str) -> DataFrame:
    said = b.read(s, d, "conversations").select(F.expr("concat(conv_id, ':', turn)").alias("run_id"), F.col("text").alias("payload"), F.array(F.lit("s1")).alias("slide_refs"))
    made = b.runs(s, d).where("answer is not null").select("run_id", F.to_json("answer").alias("payload"), "slide_refs")
    return tables.parse_answers(said.unionByName(made)).select("run_id", "is_fallback", F.array_join("answer.confusion_tags", "|").alias("confusion_tags"), F.array_join("answer.evidence_slide_refs", "|").alias("evidence"))


def queries() -> dict[str, Query]:
    found = [
        weak_topics_top5, tag_counts, tag_counts_by_profile, tag_counts_all_levels, top_labels_all, tag_shares, slide_issue_counts, revision_targets, representative_evidence, evidence_refs, flatten_runs, evaluation_grid, rule_tags, structured_slides, job_status, profile_coverage, cohort_signal, merged_signal, signal_fields, issue_evidence, proposal_evidence, signal_completeness,
        issues_ranked, recommendations, proposals, unknown_actions, trace_totals, issue_clusters, normalized_issues, regenerate_hints, cohort_insight, qa_passes, qa_delta, qa_handoff, handoff_items, normalized_answers, source_registry, source_listing, text_chunks, chunk_summary, chunk_pages, chunk_manifest, extraction_summary, text_sections, compiled_units, new_units, unit_prerequisites, compile_status, compile_summary, existing_units, printed_offsets, toc_entries, toc_units, routed_units,
        topic_search, text_query, unit_text_matches, document_text_matches, bulk_approval, knowledge_summary, vector_topk, hash_embedding, vector_upsert, unit_hits, context_bundle, context_bundle_semantic, bundle_sources, bundle_trace, supporting_chunks, bundle_served, bulk_filtered, approval_outcome, skipped_ids, unit_lookup, selected_profiles, job_runs, json_lists, graph_nodes, graph_edges, graph_neighbours, visible_nodes, visible_edges, visible_in_week, top_topics, facets, model_answers,
    ]
    return {f.__name__: f for f in found}
