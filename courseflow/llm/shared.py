"""Scratch tables and column helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 2 << 20
STRETCH = 64 << 20  # bytes that a task reads or writes of its own files, about


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Where that setting is empty, a local session
    gets a temporary folder; on a cluster, where executors would not share it, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="courseflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/courseflow/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends there,
    so a lost executor costs one read and no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python in Arrow batches of bounded bytes, however long its texts are.
    A smaller bound of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = df.sparkSession.conf.get(name, None)
    if own is None or not 0 < int(own) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks of about STRETCH bytes each, as many as the session's shuffles have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // STRETCH))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added while a column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def words_regex() -> str:
    """Fixed value: a word is a run of characters other than space and U+0009 to U+000D."""
    return r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as none, in built-in functions only."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), words_regex(), "w")
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")).cast("long")
