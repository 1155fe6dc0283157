"""Removal of passages that a document of a smaller id also has, by a count-min prefilter.

A window is ``k`` consecutive words of one document. Pass one sketches the hashes of all windows in
partitions and merges the sketches; pass two groups only the windows estimated to repeat, exactly, on 96
bits of hash; windows that also start in a document of smaller id mark their words, and the marked words
go. Windows are judged on the input.

Defined cases: null or empty text has no words and stays as it is; rows with a null doc_id neither lose
words nor make others lose any; rows that share a doc_id are one document of several texts, none smaller;
texts of fewer than k words keep all; ties do not occur; an empty table gives no rows; further columns
pass through ``remove_passages`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from courseflow.llm import sketch
from courseflow.llm import textblock as tb
from courseflow.llm.shared import free_name, materialise, text_batches

WINDOW, SKETCH_ROWS = 13, 2
HOT, HOT_SHARE = 200, 20_000  # a window that occurs so often, and is so large a part of all, is counted first
RESULT = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeated_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, marks): the windows of each document that also start in one of smaller id, each packed
    as first word << 32 | 32 bits of its hash.

    Windows that are a large part of all (there can be ``HOT_SHARE`` of them at most) are counted first, so
    that every task knows their least doc_id; the others meet under their hash in a window function."""
    docs = text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    words = (docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // 6
    hot = max(HOT, words // HOT_SHARE)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in tb.parts(batch, "text"):
            words = tb.Words(*tb.texts(part.column("text")))
            yield words.window_hash(words.windows(k), k)

    bits = sketch.repeated(docs, hashes, SKETCH_ROWS, sketch.width_for(words), hot)
    heavy = _heavy(docs, k, bits[-1], hot) if bits[-1].any() else np.zeros(0, HEAVY)
    shared = docs.sparkSession.sparkContext.broadcast((bits[:SKETCH_ROWS], heavy))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy = shared.value
        for batch in batches:
            for part in tb.parts(batch, "text"):
                words, at, a, ids = _windows(part, k)
                keep = np.flatnonzero(sketch.may_repeat(a, bits))
                at, a, ids = at[keep], a[keep], ids[keep]
                b = _second(words, at, k)
                known = np.zeros(len(a), bool)
                if len(heavy):
                    i = np.minimum(np.searchsorted(heavy["a"], a), len(heavy) - 1)
                    known = (heavy["a"][i] == a) & (heavy["b"][i] == b)
                    keep = np.flatnonzero(~known | (ids > heavy["least"][i]))
                    at, a, ids, b, known = at[keep], a[keep], ids[keep], b[keep], known[keep]
                mark = ((at - words.first[words.row[at]]).astype(np.int64) << 32) | b
                # Where the least doc_id is known the hash has done its work; any value spreads these rows.
                a = np.where(known, tb.mix(mark.view(np.uint64) ^ tb.mix(ids.view(np.uint64), 2), 9), a)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(mark), pa.array(ids), pa.array(known)], ["a", "mark", "doc_id", "known"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(emit, "a long, mark long, doc_id long, known boolean").repartition(parts, "a").select("a", F.expr("cast(mark & 4294967295 as long)").alias("b"), "mark", "doc_id", "known")  # b travels within the mark
    later = dealt.withColumn("least", F.min("doc_id").over(W.partitionBy("a", "b", "known"))).where("known or doc_id > least").select("doc_id", "mark")
    return later.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


HEAVY = np.dtype([("a", np.uint64), ("b", np.uint32), ("least", np.int64)])


def _windows(part: pa.RecordBatch, k: int) -> tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a part, first word, hash and doc_id of each window."""
    words = tb.Words(*tb.texts(part.column("text")))
    at = words.windows(k)
    return words, at, words.window_hash(at, k), part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[words.row[at]]


def _second(words: tb.Words, at: np.ndarray, k: int) -> np.ndarray:
    return (words.window_hash(at, k, 1) >> np.uint64(32)).astype(np.uint32)


def _heavy(docs: DataFrame, k: int, bits: np.ndarray, hot: int) -> np.ndarray:
    """(a, b, least) of the windows that occur ``hot`` times or more, in the order of a: as each of them is so large a part
    of all windows, no more than HOT_SHARE rows come to the driver, whatever the table's size."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch, "text"):
                words, at, a, ids = _windows(part, k)
                keep = np.flatnonzero(sketch.may_be_hot(a, shared.value))
                b = _second(words, at[keep], k)
                order = np.lexsort((b, a[keep]))
                a, b, ids = a[keep][order], b[order], ids[keep][order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                least = np.minimum.reduceat(ids, first) if len(a) else ids
                yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].astype(np.int64)), pa.array(least), pa.array(np.diff(np.append(first, len(a))))], ["a", "b", "least", "n"])

    counted = docs.mapInArrow(count, "a long, b long, least long, n long").groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where(F.col("n") >= hot)
    rows = [(r["a"] & (2**64 - 1), r["b"], r["least"]) for r in counted.collect()]
    return np.sort(np.array(rows, HEAVY), order=["a", "b"])


def _strip(text: pa.Array, marks: pa.Array, k: int) -> pa.StructArray:
    words = tb.Words(*tb.texts(text))
    n, cover = np.diff(words.first), np.zeros(len(words.hash) + 1, np.int32)
    values = marks.values.to_numpy(zero_copy_only=False) if len(marks) and len(marks.values) else np.zeros(0, np.int64)
    bounds = marks.offsets.to_numpy()
    lengths = np.diff(bounds)
    values = values[bounds[0] : bounds[-1]] if len(bounds) else values
    if len(values):
        row = np.repeat(np.arange(len(n)), lengths)
        first = values >> 32
        fits = first + k <= n[row]
        at = words.first[row[fits]] + first[fits]
        same = (words.window_hash(at, k, 1) >> np.uint64(32)) == (values[fits] & 0xFFFFFFFF).astype(np.uint64)
        np.add.at(cover, at[same], 1)
        np.add.at(cover, at[same] + k, -1)
    kept = np.cumsum(cover[:-1]) == 0
    start, length, row = words.start[kept], (words.end - words.start)[kept] + 1, words.row[kept]
    ends = np.cumsum(length)
    index = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    out = words.raw[np.minimum(index, max(len(words.raw) - 1, 0))]
    out[ends - 1] = 32
    bounds = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(n) + 1))]
    pieces = [out[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    removed = n - np.bincount(row, minlength=len(n))
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces]), pa.array([p.decode() for p in pieces], pa.string())], [f.split()[0] for f in RESULT.split(", ")])


def annotate(docs: DataFrame, k: int = WINDOW, into: str = "substring_dedup", with_text: bool = True) -> DataFrame:
    """``docs`` with a struct column: words, words removed, and the kept words joined by one space.

    A bit filter of the marked ids, of bounded size, splits the rows: those it excludes have no mark and
    are done where they are read, only the others are shuffled to their marks."""
    into, marks = free_name(docs, into), free_name(docs, "dedup_marks")
    own = free_name(docs, "dedup_id")
    found = materialise(repeated_windows(docs, k).withColumnRenamed("doc_id", own), "marks")
    numbers = lambda column: column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    wanted = found.select(own)
    bits = sketch.members(wanted, lambda batch: numbers(batch.column(0)), 2 * wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(RESULT))])

    def finish(part: pa.RecordBatch, found_marks: pa.Array, keep: list[int]) -> pa.RecordBatch:
        done = _strip(part.column("text"), found_marks, k)
        if not with_text:
            done = pa.StructArray.from_arrays([*done.flatten()[:3], pa.nulls(len(done), pa.string())], [f.name for f in done.type])
        return pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], done], [*[part.schema.names[i] for i in keep], into])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sketch.may_repeat(numbers(batch.column("doc_id")), shared.value)))

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch.filter(pa.array(~sketch.may_repeat(numbers(batch.column("doc_id")), shared.value))), "text"):
                none = pa.ListArray.from_arrays(pa.array(np.zeros(part.num_rows + 1, np.int32)), pa.array([], pa.int64()))
                yield finish(part, none, list(range(part.num_columns)))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch, "text"):
                yield finish(part, part.column(marks), [i for i, c in enumerate(part.schema.names) if c != marks])

    docs = text_batches(docs)
    few = docs.mapInArrow(marked, docs.schema)
    joined = few.join(found.withColumnRenamed("marks", marks), F.col("doc_id").cast("long") == F.col(f"`{own}`"), "left").drop(own).withColumn(marks, F.coalesce(F.col(f"`{marks}`"), F.array().cast("array<long>")))
    return docs.mapInArrow(unmarked, schema).unionByName(joined.mapInArrow(strip, schema))


def substring_digest(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    return annotate(docs.select("doc_id", "text"), k, "r", with_text=False).select("doc_id", "r.n_words", "r.n_removed", "r.kept_sha256")


def remove_passages(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed: a text that loses words becomes its kept words joined
    by one space, any other text stays as it was."""
    into = free_name(docs, "substring_dedup")
    done = annotate(docs, k, into)
    text = F.when(F.col(f"`{into}`.n_removed") > 0, F.col(f"`{into}`.kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).drop(into)
