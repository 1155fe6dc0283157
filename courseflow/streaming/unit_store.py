"""Units in a table bucketed by (source_id, title), so that unseen titles are found without moving the stored ones.

A unit has a row for each source that it refers to; the row of its own source (``own``) holds its columns. Rows lie in
folders by the hash of their source, and a batch reads the folders of its own sources alone. One append stores a batch, and
a batch that is delivered again finds its titles stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def _part(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def open_store(spark: SparkSession, name: str, path: str, columns: str, buckets: int = 64) -> None:
    """Names the store at ``path`` as table ``name`` of the session's catalog; a new one gets ``columns`` (DDL, without
    source_id, title and source_ref) beside its key."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (source_id STRING, title STRING, own BOOLEAN, source_ref ARRAY<STRING>, {columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (source_id, title) SORTED BY (source_id, title) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def unseen(batch: DataFrame, name: str) -> DataFrame:
    """Units (source_id, title, …) that the store has not under that title for that source; one without a title is
    always unseen. Only the batch is shuffled, to the store's buckets."""
    parts = [r["part"] for r in batch.select(_part(F.col("source_id")).alias("part")).distinct().collect()]  # at most PARTS numbers
    known = batch.sparkSession.table(name).where(F.col("part").isin(parts)).select("source_id", "title")
    return batch.join(known.hint("merge"), ["source_id", "title"], "left_anti")


def append_unseen(batch: DataFrame, name: str) -> None:
    """foreachBatch: stores the unseen units of a batch; one without ``source_ref`` refers to its own source."""
    table = batch.sparkSession.table(name)
    held = batch.persist()
    try:
        fresh = unseen(held, name)
        refs = F.col("source_ref") if "source_ref" in batch.columns else F.lit(None).cast("array<string>")
        every = fresh.withColumn("source_ref", F.coalesce(F.when(F.size(refs) > 0, refs), F.array("source_id")))
        others = F.array_except(F.array_distinct("source_ref"), F.array("source_id"))
        rows = every.withColumn("_ref", F.explode(F.concat(F.array("source_id"), others))).withColumn("own", F.col("_ref").eqNullSafe(F.col("source_id")))
        own = [f.name for f in table.schema if f.name not in ("source_id", "title", "own", "part")]
        values = [(F.when(F.col("own"), F.col(c)) if c in every.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in own]
        out = rows.select(F.col("_ref").alias("source_id"), "title", "own", *values, _part(F.col("_ref")).alias("part"))
        out.select(*table.columns).write.mode("append").insertInto(name)
    finally:
        held.unpersist()


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The units, one row each."""
    return spark.table(name).where("own").drop("own", "part")
