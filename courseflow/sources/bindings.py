"""The test tables in the shape of the library's tables: pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.functions import text as fx
from courseflow.sources import tables

BASE = "timestamp '2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation runs from ``events``; some without an answer, some lists empty, some tags empty."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    answer = """
        if(k % 13 = 0, null, named_struct(
          'main_answer', concat('Answer ', event_type, ' ', repeat('x', k * 4)),
          'confusion_tags', filter(array(if(event_type = 'click', 'terminology_overload', null), if(event_type = 'error', 'model_output_failure', null), if(value < 20, 'pace_jump', null), if(k % 10 = 0, '', null)), x -> x is not null),
          'missed_prerequisites', if(value > 50, array(concat('term_', k % 6)), cast(array() as array<string>)),
          'misconception_flags', if(k % 3 = 0, array(concat('flag_', k % 4)), cast(array() as array<string>)),
          'evidence_slide_refs', if(k % 4 = 0, cast(array() as array<string>), array(concat('s', k % 7 + 1)))))"""
    return e.select(
        F.col("event_id").alias("run_seq"),
        F.expr("concat('run_', event_id)").alias("run_id"),
        F.expr("concat('deck_', user_id % 20)").alias("deck_id"),
        F.expr("element_at(array('weak', 'average', 'strong'), cast(user_id % 3 + 1 as int))").alias("student_profile"),
        F.expr("element_at(array('explain_back', 'short_qa', 'confusion_report', 'coverage_check'), cast(event_id % 4 + 1 as int))").alias("task_type"),
        F.expr("case when k % 13 = 0 then 'pending' when event_type = 'error' then 'failed' else 'completed' end").alias("status"),
        F.expr("array(concat('s', k % 7 + 1), concat('s', k % 5 + 1))").alias("slide_refs"),
        F.expr(answer).alias("answer"),
        F.expr("cast(array() as array<struct<run_id: string, slide_refs: array<string>, task_type: string, student_profile: string>>)").alias("evidence_refs"),
    )


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the first five slides of every deck; slides six and seven have none."""
    decks = runs(spark, sf_dir).select("deck_id").distinct()
    return decks.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("deck_id", F.expr("concat('s', n)").alias("slide_id"), F.expr("concat('Slide title ', n)").alias("title"), F.col("n").alias("slide_pos"))


def page_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides from the lines of ``documents``: deck = source, slide = document."""
    lines = F.filter(F.transform(F.split("text", fx.LINE_BREAKS), fx.trim_ws), lambda x: x != "")
    return read(spark, sf_dir, "documents").select(F.col("source").alias("deck_id"), F.concat(F.lit("s"), "doc_id").alias("slide_id"), lines.alias("lines"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.expr("concat('src_', doc_id)").alias("source_id"), F.expr("concat('doc_', doc_id, '.txt')").alias("filename"), F.lit("text").alias("source_type"), F.col("lang").alias("module_tag"), F.col("source").alias("week_tag"), F.lit("tester").alias("uploader"), fx.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), F.expr(f"timestampadd(SECOND, cast(doc_id as int), {BASE})").alias("created_at"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge units from ``part``."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.expr("concat('ku_', p_partkey)").alias("knowledge_id"),
        F.col("p_name").alias("title"),
        F.expr("concat('About ', p_name)").alias("summary"),
        F.expr("concat('The ', p_type, ' ', p_name, ' of ', p_brand, '.')").alias("body_text"),
        F.col("p_brand").alias("module_tag"),
        F.expr("concat('week_', p_size % 12)").alias("week_tag"),
        F.expr("array(p_type, p_brand)").alias("topic_tags"),
        F.expr("element_at(array('easy', 'medium', 'hard'), cast(p_size % 3 + 1 as int))").alias("difficulty_level"),
        F.expr("element_at(array('concept', 'example', 'caution', 'prerequisite', 'other'), cast(p_size % 5 + 1 as int))").alias("pedagogical_role"),
        F.expr("if(p_partkey % 2 = 0, 'approved', 'draft')").alias("approval_status"),
        F.expr("array(concat('src_', p_partkey % 200), concat('src_', p_size))").alias("source_ref"),
        F.expr("if(p_partkey % 4 = 0, array(concat('ku_', p_partkey + 1), 'ku_missing'), cast(array() as array<string>))").alias("prerequisite_links"),
        F.expr("if(p_size % 2 = 0, 'text', 'pdf')").alias("source_type"),
        F.expr("1 + p_size % 3").alias("version_number"),
        F.expr(f"timestampadd(SECOND, cast(p_partkey as int), {BASE})").alias("updated_at"),
        F.expr(f"timestampadd(SECOND, cast(p_partkey % 50 as int), {BASE})").alias("created_at"),
    )


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before/after answers from ``lineitem``, one row a (benchmark, stage, question)."""
    rows = read(spark, sf_dir, "lineitem").select(F.expr("concat('bench_', l_suppkey)").alias("benchmark_id"), F.expr("concat('q_', l_partkey)").alias("question_id"), F.expr("if(l_linestatus = 'O', 'after', 'before')").alias("stage"), F.expr("l_returnflag <> 'R'").alias("is_correct"))
    return rows.groupBy("benchmark_id", "question_id", "stage").agg(F.bool_and("is_correct").alias("is_correct"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one ``source`` as the pages of a book. Pages are counted without their texts."""
    d = read(spark, sf_dir, "documents")
    order = W.partitionBy("source").orderBy("doc_id")
    numbers = d.select(F.col("doc_id").alias("of"), F.col("source").alias("source_id"), F.row_number().over(order).alias("page_number"))
    return tables.spread(d.select("doc_id", "text")).join(numbers, F.col("doc_id") == F.col("of")).select("source_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def book_owners(spark: SparkSession, sf_dir: str, pages: int = 30) -> DataFrame:
    """(book, source_id): books of so many documents of a ``source``, and the source id of the first of each."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    numbered = d.withColumn("n", n).where(F.col("n") % pages == 0)
    return numbered.select(F.concat_ws("#", "source", F.floor(F.col("n") / pages).cast("string")).alias("book"), F.expr("concat('src_', doc_id)").alias("source_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic requests, one a row of ``customer``, with null, empty, several and unreadable values."""
    k = "c_custkey"
    topics = "'ring', 'red', 'blue,gear', '!!!', '', 'economy widget', 'small ring, hot', 'an', 'o', 'old bolt,anvil'"
    return read(spark, sf_dir, "customer").select(
        F.expr(f"concat('r', {k})").alias("request_id"),
        F.expr(f"case when {k} % 32 = 0 and {k} % 10 <> 4 or {k} % 1000 in (203, 404) then null when {k} % 40 = 17 then '' when {k} % 50 = 9 then 'none' else concat('Brand#', {k} % 25 + 1) end").alias("module"),
        F.expr(f"case when {k} % 6 = 1 then concat('week_', {k} % 12) when {k} % 7 = 3 then '' end").alias("week"),
        F.expr(f"element_at(array({topics}), cast({k} % 10 + 1 as int))").alias("topic"),
        F.expr(f"case {k} % 5 when 2 then 'easy' when 4 then 'hard' end").alias("difficulty_level"),
        F.expr(f"element_at(array('lesson', 'quiz', 'deck', null), cast({k} % 4 + 1 as int))").alias("generation_target"),
    )


def unit_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text searches for units, one a row of ``supplier``: two words, one, parts of words, and now and then nothing."""
    words = "array('Economy RED', 'small', 'of brand', 'an', 'o', 'PROMO-old ring', 'brand 2', 'ing of', 'zz', 'about hot gear')"
    return read(spark, sf_dir, "supplier").select(F.expr("concat('q', s_suppkey)").alias("search_id"), F.expr(f"if(s_suppkey % 100 = 57, ' ?', element_at({words}, cast(s_suppkey % 10 + 1 as int)))").alias("q"))


def text_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for documents, one a row of ``benchmark``: a stretch of its text, of two characters for every 50th."""
    return read(spark, sf_dir, "benchmark").select(F.expr("concat('b', item_id)").alias("search_id"), F.expr("substring(text, cast(item_id % 30 + 1 as int), if(item_id % 50 = 0, 2, 25))").alias("q"))


def headed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as texts with headings: whole texts, every third sentence on a line of its own as one."""
    sentences = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    return tables.spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.expr("concat('src_', doc_id)").alias("source_id"), F.expr("concat('doc_', doc_id, '.txt')").alias("filename"), F.array_join(sentences, "\n").alias("text"))


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa_answers`` with what was asked and said, derived from the question."""
    n = "cast(substring(question_id, 3) as long)"
    return qa_answers(spark, sf_dir).select("*", F.expr(f"element_at(array('weak', 'average', 'strong'), cast({n} % 3 + 1 as int))").alias("student_profile"), F.expr(f"concat('Question ', {n})").alias("prompt"), F.expr(f"concat('Said ', {n} % 11)").alias("student_answer"), F.expr(f"concat('Key ', {n} % 7)").alias("correct_answer"), F.expr(f"array(concat('concept_', {n} % 5))").alias("missed_concepts"), F.expr(f"array(concat('s', {n} % 7 + 1))").alias("evidence_slide_refs"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers from ``lineitem`` before they are normalized: missing, blank and out-of-range fields."""
    none = "cast(array() as array<string>)"
    return read(spark, sf_dir, "lineitem").select(
        F.expr("concat('q_', l_orderkey, '_', l_linenumber)").alias("question_id"), F.expr("l_returnflag <> 'R'").alias("is_correct"),
        F.expr("if(l_linenumber % 4 = 0, null, cast(l_tax * 30 - 0.5 as double))").alias("confidence"), F.expr("case when l_linenumber % 3 = 0 then '  ' when l_linenumber % 5 = 0 then null else concat(' said ', l_partkey, ' ') end").alias("student_answer"),
        F.expr(f"if(l_partkey % 2 = 0, array(concat('missed_', l_partkey % 9)), {none})").alias("missed_concepts"), F.expr(f"if(l_partkey % 3 = 0, array(concat('tag_', l_partkey % 4)), {none})").alias("concept_tags"),
        F.expr(f"if(l_suppkey % 2 = 0, array(concat('s', l_suppkey % 6)), {none})").alias("evidence_slide_refs"), F.expr(f"if(l_suppkey % 3 = 0, array(concat('q', l_suppkey % 8)), {none})").alias("slide_refs"), F.lit("s1").alias("first_slide"))


def approval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from ``supplier`` to approve units, some unknown, some twice, some to another status."""
    ids = "array(concat('ku_', s_suppkey), concat('ku_', s_suppkey * 2 + 1), 'ku_none', concat('ku_', s_suppkey))"
    return read(spark, sf_dir, "supplier").select(F.expr("concat('req_', s_suppkey)").alias("request_id"), F.expr("if(s_suppkey % 5 = 0, 'archived', 'approved')").alias("target_status"), F.expr(ids).alias("ids"))
