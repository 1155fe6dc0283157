"""Reading and writing the library's tables, and registering files as sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from courseflow.functions import text as fx
from courseflow.sources.files import read_files

SOURCES = "source_id string, filename string, source_type string, module_tag string, week_tag string, uploader string, hash string, storage_path string, created_at timestamp"
PAGE_TEXTS = "source_id string, page_number int, char_count int, text string"
UNIT = "struct<title string, summary string, body_text string, module_tag string, week_tag string, topic_tags array<string>, difficulty_level string, pedagogical_role string, source_type string, source_ref array<string>, approval_status string, prerequisite_links array<string>, learning_outcome_links array<string>>"
COMPILED_UNITS = f"source_id string, compiled_units array<{UNIT}>"
SLIDE = "struct<slide_id string, title string, key_points array<string>, terms array<string>, examples array<string>, raw_text string>"
DECKS = f"deck_id string, module_tag string, week_tag string, topic_tags array<string>, slides array<{SLIDE}>"
ANSWER = "struct<main_answer string, confidence double, confusion_tags array<string>, missed_prerequisites array<string>, misconception_flags array<string>, evidence_slide_refs array<string>>"
SIGNALS = "signal_id string, tested_deck_id string, related_knowledge_ids array<string>, weak_topics array<string>, repeated_confusion_points array<string>, misconception_clusters array<string>, evidence_refs array<string>, created_at timestamp"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where that is empty, a local session gets a temporary
    folder, and a cluster, whose executors would not share one, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="courseflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: what is used several times is computed once, and its lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD = 8  # scan partitions, of at most spark.sql.files.maxPartitionBytes each


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan gives fewer partitions than there are: for work within the row that costs more
    than an exchange of the rows. A scan of more than ``SPREAD`` partitions (1 GB by default) stays as it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < cores and parts <= SPREAD else df


def register_files(spark: SparkSession, path: str, module_tag: str, uploader: str, created_at: Column, week_tag: str | None = None) -> DataFrame:
    """One ``sources`` row for each file under ``path``."""
    files = read_files(spark, path)
    name = fx.sanitize_filename(F.col("path"))
    return files.select(fx.prefixed_id("src", F.col("path"), F.sha2("content", 256)).alias("source_id"), name.alias("filename"), fx.infer_source_type(name).alias("source_type"), F.lit(module_tag).alias("module_tag"), F.lit(week_tag).cast("string").alias("week_tag"), F.lit(uploader).alias("uploader"), fx.content_hash(F.col("content")).alias("hash"), F.col("path").alias("storage_path"), created_at.alias("created_at"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8, invalid bytes replaced; the text of an empty file is null."""
    return read_files(spark, path).select("path", F.nullif(F.make_valid_utf8(F.col("content").cast("string")), F.lit("")).alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PAGE_TEXTS).withColumn("text", F.coalesce("text", F.lit("")))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page texts (source_id, page_number, text) as JSON lines with their number of characters."""
    text = F.coalesce("text", F.lit(""))
    pages.select("source_id", "page_number", F.length(text).alias("char_count"), text.alias("text")).write.json(path)


def complete_sources(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources whose page rows reach the expected number (source_id, page_count), or have none expected."""
    counts = pages.groupBy("source_id").agg(F.count("*").alias("pages"))
    return counts.join(expected, "source_id", "left").where("page_count is null or pages >= page_count").select("source_id", "pages")


def explode_units(compiled: DataFrame) -> DataFrame:
    return compiled.select("source_id", F.posexplode("compiled_units").alias("pos", "unit")).select("source_id", "pos", "unit.*")


def explode_slides(decks: DataFrame) -> DataFrame:
    return decks.select("deck_id", F.posexplode("slides").alias("slide_pos", "slide")).select("deck_id", "slide_pos", "slide.*")


def parse_answers(payloads: DataFrame) -> DataFrame:
    """(…, answer) from (payload, slide_refs): a payload that breaks the schema gets the fallback answer."""
    schema = T._parse_datatype_string(ANSWER[7:-1])
    schema = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = payloads.withColumn("_read", read)
    bad = F.col("_read").isNull() | F.col("_read._bad").isNotNull() | F.col("_read.main_answer").isNull()
    none = F.array().cast("array<string>")
    fine = F.struct(F.col("_read.main_answer").alias("main_answer"), F.col("_read.confidence").alias("confidence"), *[F.coalesce(F.col(f"_read.{c}"), none).alias(c) for c in ("confusion_tags", "missed_prerequisites", "misconception_flags", "evidence_slide_refs")])
    fallback = F.struct(F.lit("Model output could not be read.").alias("main_answer"), F.lit(0.0).alias("confidence"), F.array(F.lit("model_output_failure")).alias("confusion_tags"), none.alias("missed_prerequisites"), none.alias("misconception_flags"), F.col("slide_refs").alias("evidence_slide_refs"))
    return rows.withColumn("answer", F.when(bad, fallback).otherwise(fine)).withColumn("is_fallback", bad).drop("_read")


def run_payloads(decks: DataFrame, grid: DataFrame) -> DataFrame:
    """(deck_id, slide_id, task_type, payload): the JSON request of each run for offline inference."""
    slides = explode_slides(decks).join(decks.select("deck_id", "module_tag", "week_tag", "topic_tags"), "deck_id")
    body = F.to_json(F.struct("deck_id", "module_tag", "week_tag", "topic_tags", "task_type", F.struct("slide_id", "title", "key_points", "terms", "examples", "raw_text").alias("slide")))
    return grid.join(slides, ["deck_id", "slide_id"]).select("deck_id", "slide_id", "student_profile", "task_type", body.alias("payload"))


def qa_payloads(questions: DataFrame, slides: DataFrame, stages: DataFrame) -> DataFrame:
    """(question_id, stage, payload): a question with its slides, all of the deck's if it names none; the
    support text goes along in the after stage only. ``stages`` holds (stage, support)."""
    fields = [c for c in ("slide_id", "title", "key_points", "terms", "examples", "raw_text") if c in slides.columns]
    wanted = F.expr("q.deck_id = s.deck_id and (coalesce(size(q.slide_refs), 0) <= 0 or array_contains(q.slide_refs, s.slide_id))")
    context = questions.alias("q").join(slides.alias("s"), wanted, "left").groupBy("q.deck_id", "q.question_id", "q.prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("s.slide_pos", F.struct(*[f"s.{c}" for c in fields]).alias("slide")))), lambda x: x["slide"]).alias("slides"))
    staged = context.withColumn("st", F.explode(F.array(F.lit("before"), F.lit("after")))).join(F.broadcast(stages.limit(2)), F.col("st") == F.col("stage"))
    support = F.when(F.col("stage") == "after", F.col("support"))
    return staged.select("deck_id", "question_id", "stage", F.to_json(F.struct("question_id", "prompt", "slides", support.alias("support"))).alias("payload"))


def store_signals(signals: DataFrame, path: str) -> None:
    """Appends cohort signals with their lists as JSON text."""
    lists = [f.name for f in signals.schema if isinstance(f.dataType, T.ArrayType)]
    signals.withColumns({c: fx.dump_list(F.col(c)) for c in lists}).write.mode("append").parquet(path)


def load_signals(spark: SparkSession, path: str) -> DataFrame:
    lists = [f.name for f in T._parse_datatype_string(SIGNALS) if isinstance(f.dataType, T.ArrayType)]
    return spark.read.parquet(path).withColumns({c: fx.load_list(F.col(c)) for c in lists})


def _quoted(spark: SparkSession, url: str, *names: str) -> list[str]:
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return [dialect.quoteIdentifier(name) for name in names]


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int | None = None, **options: str) -> DataFrame:
    """A table of a database. With a numeric ``key`` it is read in ``parts`` ranges between the key's bounds, which are asked
    for first; rows without a key come with the first range."""
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    if key is None:
        return reader(dbtable=table).load()
    (own,) = _quoted(spark, url, key)
    low, high = reader(query=f"SELECT min({own}) AS low, max({own}) AS high FROM {table}").load().first()
    ranges = reader(dbtable=table)
    if low is not None:
        n = parts or spark.sparkContext.defaultParallelism
        ranges = ranges.options(partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(n))
    return ranges.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def merge_database(df: DataFrame, url: str, table: str, key: str, **options: str) -> None:
    """Puts the rows of ``df`` in the place of those of equal ``key``, so that a repeated write changes nothing. Tasks write to
    a staging table; one transaction of the database then moves its rows. ``table`` has the columns of ``df``."""
    spark, staging = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    columns, (own,) = ", ".join(_quoted(spark, url, *df.columns)), _quoted(spark, url, key)
    write_database(df, url, staging, "errorifexists", **options)
    properties = spark._jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        statement.executeUpdate(f"DELETE FROM {table} WHERE {own} IN (SELECT {own} FROM {staging})")
        statement.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}")
        statement.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_documents(df: DataFrame, path: str) -> None:
    """One nested JSON document a row, as lines of text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "write_seq") -> DataFrame:
    """Last write of each key, newest ``order`` first; a later row of equal order wins by its document."""
    best = W.partitionBy(key).orderBy(F.desc(order), F.desc("document"))
    return old.unionByName(new).withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
