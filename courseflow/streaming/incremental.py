"""Incremental forms of the jobs, on Structured Streaming file sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from courseflow.functions import text as fx
from courseflow.operators import compile as comp
from courseflow.operators import deck_state, signals
from courseflow.sources import tables
from courseflow.streaming import versions


def stream_sources(spark: SparkSession, path: str, out: str, checkpoint: str, module_tag: str, uploader: str) -> StreamingQuery:
    """Appends a ``sources`` row for each new file under ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    name = fx.sanitize_filename(F.col("path"))
    rows = files.select(fx.prefixed_id("src", F.col("path"), F.sha2("content", 256)).alias("source_id"), name.alias("filename"), fx.infer_source_type(name).alias("source_type"), F.lit(module_tag).alias("module_tag"), F.lit(None).cast("string").alias("week_tag"), F.lit(uploader).alias("uploader"), fx.content_hash(F.col("content")).alias("hash"), F.col("path").alias("storage_path"), F.col("modificationTime").alias("created_at"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new_units(batch: DataFrame, units_path: str) -> None:
    """foreachBatch: stores only units whose (source, title) is not yet in the table."""
    spark = batch.sparkSession
    stored = _stored(spark, units_path, "source_ref array<string>, title string")
    comp.new_units(batch, stored).withColumn("source_ref", F.array("source_id")).write.mode("append").parquet(units_path)


def upsert_records(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """foreachBatch: replaces vector records by id. Only the buckets that the batch touches are rewritten, and readers of
    ``stored_records`` see all of a batch or nothing."""
    versions.merge(batch, path, "id", tables.upsert, buckets)


def stored_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return versions.load(spark, path, schema)


def update_decks(runs: DataFrame, batch_id: int, path: str, buckets: int = 64) -> None:
    """foreachBatch: adds a batch of runs to the decks' state at ``path``. Earlier runs are not read, and a batch that is
    delivered again is not counted again. A run counts when it has its answer, and should come once with it."""
    versions.merge(deck_state.state(runs), path, "deck_id", deck_state.merged, buckets, batch_id)


def deck_signals(path: str, slides: DataFrame, decks: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Signals from the state at ``path``, of all decks or of ``decks``, whose buckets alone are read then."""
    schema = deck_state.schema()
    found = versions.load(slides.sparkSession, path, schema) if decks is None else versions.load_keys(decks, path, "deck_id", schema, buckets)
    return deck_state.cohort_signal(found, slides)


def refresh_decks(batch: DataFrame, runs: DataFrame, slides: DataFrame) -> DataFrame:
    """Signals of only the decks that a batch of runs touches, from all their runs (``update_decks`` keeps a state instead)."""
    touched = batch.select("deck_id").distinct()
    return signals.cohort_signal(runs.join(touched, "deck_id", "left_semi"), slides.join(touched, "deck_id", "left_semi"))


def unchunked(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources that have no chunks yet."""
    return texts.join(chunks.select("source_id").distinct(), "source_id", "left_anti")
