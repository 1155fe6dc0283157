"""SimHash near-duplicates: fingerprints of word shingles, compared by bit slices.

Equal fingerprints are one node, of the least doc_id. Two of them that differ in at most ``RADIUS`` of 64 bits
agree wholly in one of RADIUS + 1 stretches of bits, so each fingerprint goes to one bucket a stretch. A bucket
of more than ``BUCKET`` fingerprints is split again: its members agree in those bits, so two near ones agree in
one of RADIUS + 1 stretches of the other bits, too. That ends by itself: what agrees in all but 13 bits has at
most 2**13 different members. No bucket is cut, and none is compared as a whole by one query.

A task reads whole buckets in order and stores the fingerprints of 64 rows as 64 vertical planes, one word a
bit. Every row meets the words of its bucket from its own on; the planes go one by one through two carry-save
counters and an overflow mark, which hold the distances of 64 rows at once, and a word is abandoned when all
its rows exceed the radius. A bucket returns a forest of its links, never more rows than it has.

Defined cases: null text or no words: fingerprint zero, linked like any other; fewer than ``k`` words: the
whole sequence is the one shingle; rows with a null doc_id have a fingerprint, link nothing and have a null
component; rows that share a doc_id are one document of several fingerprints; an empty table gives no rows;
ties of set and unset bits give 0; further columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseflow.llm import textblock as tb
from courseflow.llm.jaccard_join import connected, forest
from courseflow.llm.shared import free_name, materialise, text_batches

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
BUCKET = 1 << 14
ITEMS = 1 << 18  # pairs of a row and a word of 64 rows that are counted at once
PIECE = 1 << 15  # shingles whose bits are added at once
ROUND = 8  # planes between two looks at what can be abandoned


def _spaced(raw: np.ndarray, words: tb.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a block with one space after each, and where each begins and ends there."""
    length = words.end - words.start
    end = np.cumsum(length + 1)
    at = np.repeat(words.start - (end - length - 1), length + 1) + np.arange(end[-1] if len(end) else 0)
    out = raw[np.minimum(at, max(len(raw) - 1, 0))]
    out[end - 1] = 32
    return out.tobytes(), end - length - 1, end - 1


def fingerprints_of(text: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    raw, at = tb.texts(text)
    raw = tb.lower_ascii(raw)
    words = tb.Words(raw, at, hashed=False)
    n = np.diff(words.first)
    joined, begin, end = _spaced(raw, words)
    shingles = np.where(n >= k, n - k + 1, n > 0)
    row = np.repeat(np.arange(len(n)), shingles)
    first = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.minimum(n[row], k) - 1
    set_, out = np.zeros((len(n), BITS), np.int64), np.zeros(len(n), tb.U)
    for i in range(0, len(row), PIECE):
        a, b, r = begin[first[i : i + PIECE]].tolist(), end[last[i : i + PIECE]].tolist(), row[i : i + PIECE]
        h = np.array([xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a, b)], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        set_[r[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    out[:] = np.packbits(2 * set_ > shingles[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text"), k).view(np.int64))], ["doc_id", "fp"])

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, fp long")


def split_mask(used: int, radius: int = RADIUS) -> list[int]:
    """``used`` with each of radius + 1 stretches of the bits that it leaves."""
    free = [i for i in range(BITS) if not used >> i & 1]
    cut = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [used | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bucketed(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(used, bucket, fp): buckets of at most ``most`` fingerprints, of which every two near ones share one."""
    masks, rows, done = [0], prints.select("fp", F.lit(0).cast("long").alias("used")), []
    while True:
        into = {m: split_mask(m, radius) for m in masks}
        wider = F.array().cast("array<long>")
        for m, finer in into.items():
            wider = F.when(F.col("used") == _signed(m), F.array(*[F.lit(_signed(x)).cast("long") for x in finer])).otherwise(wider)
        each = rows.select("fp", F.explode(wider).alias("used")).select("used", F.col("used").bitwiseAND(F.col("fp")).alias("bucket"), "fp")
        masks = sorted({x for finer in into.values() for x in finer})
        if most >= 1 << (BITS - min(m.bit_count() for m in masks)):
            done.append(each)
            break
        each = materialise(each, "buckets")
        size = each.groupBy("used", "bucket").agg(F.count("*").alias("n"))
        large = materialise(size.where(F.col("n") > most).select("used", "bucket"), "large-buckets")
        if not large.limit(1).count():
            done.append(each)
            break
        done.append(each.join(large, ["used", "bucket"], "left_anti"))
        rows = each.join(large, ["used", "bucket"], "left_semi").select("fp", "used")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


class Planes:
    """Rows of fingerprints as words of 64 rows: ``plane[b]`` holds bit b of all rows."""

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        padded = np.zeros(-(-self.n // 64) * 64, tb.U)
        padded[: self.n] = prints
        bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # row, bit from the highest
        self.plane = np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(">u8").astype(tb.U)  # bit, word; row 0 is a word's highest bit

    def near(self, prints: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For items of a fingerprint and a word: which item and which row of the word are within the radius (3 at
        most); and how many planes were read in all."""
        item, full, read = np.arange(len(word)), ~tb.U(0), 0
        one, two, over = (np.zeros(len(word), tb.U) for _ in range(3))
        for b in range(BITS):
            differs = self.plane[b][word] ^ (tb.U(0) - ((prints >> tb.U(BITS - 1 - b)) & tb.U(1)))
            carry = one & differs
            one ^= differs
            over |= two & carry
            two ^= carry
            read += len(word)
            if b % ROUND == ROUND - 1:
                beyond = over | (one & two if radius == 2 else two if radius == 1 else one | two if radius == 0 else tb.U(0))
                alive = np.flatnonzero(beyond != full)
                if len(alive) < len(word):
                    item, word, prints, one, two, over = (x[alive] for x in (item, word, prints, one, two, over))
        beyond = over | (one & two if radius == 2 else two if radius == 1 else one | two if radius == 0 else tb.U(0))
        rows = np.unpackbits((~beyond).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at, lane = np.nonzero(rows)
        other = word[at] * 64 + lane
        fits = other < self.n
        return item[at[fits]], other[fits], read


def links_in(prints: np.ndarray, last: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among ``prints``, in the order of buckets; row i's bucket ends before row ``last[i]``."""
    planes, found = Planes(prints), ([], [])
    words = (last - 1) // 64 - np.arange(len(prints)) // 64 + 1
    ends = np.cumsum(words)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, ITEMS):
        nth = np.arange(lo, min(lo + ITEMS, int(ends[-1])))
        row = np.searchsorted(ends, nth, "right")
        word = row // 64 + nth - (ends[row] - words[row])
        item, other, _ = planes.near(prints[row], word, radius)
        a, b = prints[row[item]].view(np.int64), prints[other].view(np.int64)
        tree = forest(a[a != b], b[a != b])
        found[0].append(tree[0]), found[1].append(tree[1])
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found[0]), np.concatenate(found[1]))


def links(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(a, b): links among the fingerprints of ``prints`` (fp, all different) that join all that are near."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            used, bucket, fp = rows
            starts = np.flatnonzero(np.concatenate([[True], (used[1:] != used[:-1]) | (bucket[1:] != bucket[:-1])]))
            last = np.append(starts[1:], len(fp))
            several = np.repeat(last - starts > 1, last - starts)  # a row alone in its bucket has none to meet
            sizes = (last - starts)[last - starts > 1]
            a, b = links_in(fp[several].view(tb.U), np.repeat(np.cumsum(sizes), sizes), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("used", "bucket", "fp"))]
            used, bucket, _ = held
            whole = np.flatnonzero((used != used[-1]) | (bucket != bucket[-1])) if len(used) else []
            if len(whole) >= most:
                cut = int(whole[-1]) + 1
                yield done([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield done(held)

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bucketed(prints, radius, most).repartition(parts, "used", "bucket").sortWithinPartitions("used", "bucket")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a document."""
    table = materialise(fingerprints(docs, k), "fingerprints")
    known = table.where("doc_id is not null")
    classes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    found = materialise(links(classes.select("fp"), radius, most), "fingerprint-links")
    ends = found.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    edges = ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    several = known.join(repeated, "doc_id").join(classes, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = connected(materialise(edges.unionByName(several), "fingerprint-edges"))
    moved = classes.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    placed = table.join(materialise(moved, "fingerprint-components"), F.col("fp") == F.col("of"), "left")  # a written table, so that a frequent fingerprint can be split in the join
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without those that a linked document of smaller id stands for; all columns stay, as do
    rows with a null doc_id."""
    other = free_name(docs, "doc_id_gone")
    gone = components(docs, k, radius).where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(f"`{other}`"), "left_anti")
