"""Mixing sources to target weights as a time-varying curriculum, in built-in functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all
documents; none gets over ``CAP`` times its own words, the excess going to the others by weight. Each
source's documents, in the order of a hash of their key, form a stream that is read again from its start
until the target is met, so a document is taken up to three times and one document a source in part
(``boundary="whole"`` takes that one whole if at least half of it is due).

Curriculum: at training time t in [0, 1] a source is wanted at the rate 1 + ramp * (2t - 1), ramp by its
weight; the integral of that rate is its cumulative demand, and inverting it at the middle of each taken
span gives the span's training position. Placements are range-sorted by position.

Prefix sums run over (source, hash bucket) first, so that a source holding a third of all rows is dealt
over many tasks. Defined cases: null text has size 0 and is never taken; a null source is a source; a
null key hashes as empty; repeated rows are separate documents, and texts of one key are ordered by size and hash; an empty table gives no rows; further
columns ride along in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm.shared import free_name, materialise, n_words

#: Weights by rank, and the most a source may be repeated.
WEIGHTS, CAP = (5, 2, 1), 3
#: How much later (positive) or earlier (negative) a weight's documents come: -1 to 1.
RAMPS = {5: -0.5, 2: 0.0, 1: 0.5}
LEAST_DIGITS, BUCKET_ROWS = 3, 50_000  # a source has 16 ** 3 buckets at least, and no more than about so many rows in each


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from rows with (source, size); one row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    everyone = W.partitionBy(F.lit(1))
    level = everyone.orderBy(F.col("limit") / F.col("weight"), "rank")
    known = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * CAP).withColumn("total", F.sum("source_size").over(everyone))
    # If the sources of lower limit per weight stay at their limits, the others share what is left by weight.
    held = F.coalesce(F.sum("limit").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rate = (F.col("total") - held) / F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing))
    rated = known.withColumn("rate", rate.cast("double"))
    fits = F.when(F.col("limit") >= F.col("rate") * F.col("weight"), F.col("rate"))
    first = F.first(fits, ignorenulls=True).over(level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("limit").cast("double"), first * F.col("weight"))
    return rated.select("source", "source_size", "weight", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def bucket_digits(rows: int) -> int:
    """Hexadecimal digits of a key's hash that name its bucket, so that no table size makes buckets large."""
    digits = LEAST_DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def stream(docs: DataFrame) -> DataFrame:
    """Each document with its source's target and its place ``begin`` in the source's stream."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("hash"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    return _stream(sized.withColumn("bucket", F.substring("hash", 1, bucket_digits(sized.count()))))


def _stream(sized: DataFrame) -> DataFrame:
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = buckets.select("source", "bucket", before.alias("before")).alias("p").join(source_targets(buckets).alias("t"), F.expr("p.source <=> t.source")).select("p.*", "source_size", "weight", "target")
    within = W.partitionBy("source", "bucket").orderBy("hash", "size", "text_hash")  # whatever order the rows come in
    rows = sized.withColumn("nth", F.row_number().over(within)).withColumn("inner", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = rows.alias("r").join(places.alias("p"), F.expr("r.source <=> p.source and r.bucket = p.bucket"))
    return joined.select("r.doc_id", "r.source", "r.bucket", "nth", "size", "source_size", "weight", "target", (F.col("before") + F.col("inner")).alias("begin"))


def _position(share: Column) -> Column:
    """Training time at which the cumulative demand of a source reaches ``share`` of its target."""
    ramp = F.element_at(F.create_map(*[F.lit(x) for w, r in RAMPS.items() for x in (w, float(r))]), F.col("weight"))
    # demand(t) = t (1 - ramp) + ramp t^2; its inverse, in the form that has no division by zero:
    return 2 * share / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share))


def placements(docs: DataFrame, boundary: str = "split") -> DataFrame:
    """One row for each taken copy, with ``taken`` words and ``position``, and one with null ``copy``
    for a document that is not taken; range-sorted by position."""
    rows = stream(docs)
    due = F.floor("target").cast("long")
    copies = F.sequence(F.lit(0), F.lit(CAP))
    begin = F.col("begin") + F.col("copy") * F.col("source_size")
    taken = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), due - begin))
    if boundary == "whole":
        taken = F.when(taken * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    each = rows.withColumn("copy", F.explode(copies)).withColumn("taken", taken).withColumn("middle", (begin + F.col("taken") / 2) / F.greatest(due, F.lit(1)))
    each = each.where("taken > 0 or copy = 0").withColumn("position", F.when(F.col("taken") > 0, _position(F.least("middle", F.lit(1.0)))))
    out = each.select("doc_id", "source", "bucket", "nth", "size", "source_size", "target", F.when(F.col("taken") > 0, F.col("copy")).alias("copy"), "taken", "position")
    return out.orderBy("position", "doc_id", "source", "bucket", "nth", "copy")


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target and the words that the written mix takes of it."""
    placed = materialise(placements(docs), "mix-placed")
    per = placed.groupBy("doc_id", "source", "bucket", "nth").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("copy").alias("copies"), F.min("position").alias("first_position"))
    return per.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, repeated as taken, with all their columns, in training order."""
    rank, key, source, bucket, nth, position, copy = (free_name(docs, f"mix_{x}") for x in ("rank", "key", "source", "bucket", "nth", "position", "copy"))
    digits = bucket_digits(docs.count())
    key_of = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    same = W.partitionBy("source", F.substring(F.col(f"`{key}`"), 1, digits)).orderBy(F.col(f"`{key}`"), n_words(F.col("text")), F.xxhash64("text"))
    numbered = docs.withColumn(key, key_of).withColumn(rank, F.row_number().over(same))
    chosen = placements(docs, "whole").where("copy is not null").select(F.col("source").alias(source), F.col("bucket").alias(bucket), F.col("nth").alias(nth), F.col("position").alias(position), F.col("copy").alias(copy))
    joined = numbered.join(chosen, F.expr(f"source <=> `{source}` and substring(`{key}`, 1, {digits}) = `{bucket}` and `{rank}` = `{nth}`"))
    return joined.orderBy(f"`{position}`", f"`{copy}`", f"`{key}`").select(*[F.col(f"`{c}`") for c in docs.columns])
