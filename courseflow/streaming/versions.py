"""A table in buckets whose new versions are written beside the old ones and published by one small file.

``data/<version>/bucket=<n>`` holds rows; ``manifest/<number>.json`` names the version of each bucket. A writer reads the
newest manifest, writes the buckets that change under a new version, and creates the next manifest, which fails if another
writer has created it first. Until then readers see the old rows, wherever the writer stops; after it, all the new ones.
A manifest also holds the number of the last micro-batch, so that a batch which is delivered again changes nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has published since this one read the table."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def newest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Number of the newest whole manifest, 0 if there is none, and the version of each bucket."""
    return _newest(spark, path)[:2]


def _newest(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int | None]:
    """The same, and the number of the last micro-batch."""
    system, place = _file_system(spark, f"{path.rstrip('/')}/manifest")
    if not system.exists(place):
        return 0, {}, None
    names = sorted((s.getPath().getName() for s in system.listStatus(place) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        text = "".join(r["value"] for r in spark.read.text(f"{path.rstrip('/')}/manifest/{name}").collect())  # a line of at most a bucket each
        try:
            told = json.loads(text)
        except ValueError:  # its writer stopped
            continue
        batch = told.pop("batch", None)
        return int(name.partition(".")[0]), {int(b): v for b, v in told.items()}, batch
    return int(names[0].partition(".")[0]) if names else 0, {}, None


def publish(spark: SparkSession, path: str, number: int, versions: dict[int, str], batch: int | None = None) -> None:
    """Creates manifest ``number``."""
    system, place = _file_system(spark, f"{path.rstrip('/')}/manifest/{number:012d}.json")
    if system.exists(place):
        raise Conflict(f"manifest {number} is there already")
    try:
        out = system.create(place, False)
    except Exception as e:
        raise Conflict(f"manifest {number} is there already") from e
    out.write(bytearray(json.dumps(versions | ({} if batch is None else {"batch": batch})).encode()))
    out.close()


def load(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, str] | None = None) -> DataFrame:
    """The rows of the newest version, or of ``versions``."""
    versions = newest(spark, path)[1] if versions is None else versions
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{v}/bucket={b}" for b, v in sorted(versions.items())])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _touched(df: DataFrame, bucket: Column) -> list[int]:
    return [r["bucket"] for r in df.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers


def load_keys(keys: DataFrame, path: str, key: str, schema: T.StructType, buckets: int = 64) -> DataFrame:
    """The rows of some keys, from their buckets alone. ``buckets`` is that of ``merge``."""
    versions = newest(keys.sparkSession, path)[1]
    kept = {b: versions[b] for b in _touched(keys, _bucket(key, buckets)) if b in versions}
    return load(keys.sparkSession, path, schema, kept).join(keys.select(key).distinct(), key, "left_semi")


def merge(batch: DataFrame, path: str, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, batch_id: int | None = None) -> None:
    """Puts ``combine(old rows, batch)`` in place of the buckets that the batch's keys fall in. Nothing is done if the table
    has seen ``batch_id`` or a later one; such a table belongs to one streaming query, whose numbers ascend."""
    spark, schema = batch.sparkSession, batch.schema
    number, versions, last = _newest(spark, path)
    if batch_id is not None and last is not None and batch_id <= last:
        return
    keyed = batch.withColumn("bucket", _bucket(key, buckets)).persist()
    try:
        touched = _touched(keyed, F.col("bucket"))
        if not touched:
            return
        old = load(spark, path, schema, {b: versions[b] for b in touched if b in versions})
        version = uuid.uuid4().hex
        merged = combine(old, keyed.drop("bucket")).withColumn("bucket", _bucket(key, buckets))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/data/{version}")
        publish(spark, path, number + 1, versions | dict.fromkeys(touched, version), last if batch_id is None else batch_id)
    finally:
        keyed.unpersist()
