"""Token ids in raw binary shards with a minimal perfect hash index.

Layout of a store: ``shard-NNNNN.ids`` holds the ids of its documents one after the other, little-endian
unsigned 16-bit (32-bit for vocabularies over 65,536), documents in ascending key order across shards;
``index-NNNNN.mph`` maps the keys of one hash bucket to (fingerprint, shard, byte offset, ids, global
start). A key is (doc_id, ordinal among rows of that doc_id). Each bucket's perfect hash places a key at
the first level where it is alone in its slot; its rank among set bits is its slot in the table, so a
look-up costs a few probes whatever the size, and the stored fingerprint rejects foreign keys.

Defined cases: null text encodes as empty and still gets the end id; a null key sorts first and has its
own entry; repeated keys are kept, ordered by text; an empty table gives a store without shards; further
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm import textblock as tb
from courseflow.llm.files import open_ranges, write_whole
from courseflow.llm.shared import STRETCH, materialise, scratch, tasks_for, text_batches

END_ID = 2
KEYS_PER_BUCKET = 200_000
GAMMA, LEVELS = 2.0, 64
SLOT_BITS, MOST_KNOWN, LONGEST = 20, 700_000, 48  # known pieces: at most 34 MB of text, about 80 MB in all
PART = 3 << 17  # bytes of text that are encoded at once, about
_HEAD = struct.Struct("<4sIQ")
_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n", "<i8"), ("start", "<i8")])


class Lists:
    """Arrays one after the other, which grow in place."""

    def __init__(self, kind):
        self.values, self.first, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.first[self.n]), self.n + len(sizes)
        if at + len(values) > len(self.values):
            self.values = np.concatenate([self.values[:at], np.zeros(at + 2 * len(values), self.values.dtype)])
        if n + 1 > len(self.first):
            self.first = np.concatenate([self.first[: self.n + 1], np.zeros(2 * n, np.int64)])
        self.values[at : at + len(values)] = values
        self.first[self.n + 1 : n + 1] = at + np.cumsum(sizes)
        self.n = n

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the numbered arrays in a row, and their sizes."""
        first = self.first[numbers]
        sizes = self.first[numbers + 1] - first
        return self.values[ranges(first, sizes)], sizes


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of text encoded once while it is known.

    A byte-level pre-tokenizer splits wherever white space follows another character, and neither side of
    such a place changes how the other is encoded; added tokens hold no white space. So a text is cut
    there into pieces of leading white space and what follows. Known pieces are found by a 64-bit hash in
    a table of slots and compared byte by byte; longer ones than ``LONGEST`` are always encoded anew. New
    pieces are encoded in one text, for the library takes long over many short ones, and told apart by the
    bytes of their tokens; those that may not follow another piece are encoded each as a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character for each byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(token.content.encode())
        self.ids, self.bytes = Lists(np.uint32), Lists(np.uint8)
        self.hash, self.again = np.zeros(MOST_KNOWN, np.uint64), np.zeros(MOST_KNOWN, bool)
        self._forget(np.zeros(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Leaves only the pieces of these numbers."""
        self.slots, self.number = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        ids, pieces = self.ids.take(kept), self.bytes.take(kept)
        self.ids, self.bytes = Lists(np.uint32), Lists(np.uint8)
        self.again[:] = False
        self._learn(self.hash[kept], *ids, *pieces)

    def _learn(self, h: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, raw: np.ndarray, n_bytes: np.ndarray) -> None:
        first = self.ids.n
        self.ids.append(ids, n_ids)
        self.bytes.append(raw, n_bytes)
        self.hash[first : first + len(h)] = h
        self._settle(h, np.arange(first, first + len(h), dtype=np.int32))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is not known."""
        out, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            there = self.slots[slot]
            hit = there == h[left]
            out[left[hit]] = self.number[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _settle(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct new hashes into free slots: of several hashes for one slot one stays, the others move on."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.slots[slot] == 0)
            self.slots[slot[free]] = h[free]
            here = self.slots[slot] == h
            self.number[slot[here]] = numbers[here]
            h, numbers, slot = h[~here], numbers[~here], (slot[~here] + 1) & ((1 << SLOT_BITS) - 1)

    def _encoded(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has."""
        joint = np.flatnonzero(tb.SEPARATOR[raw[start]] & solid(raw, stop - 1))
        ends = np.cumsum(stop[joint] - start[joint])
        text = raw[ranges(start[joint], stop[joint] - start[joint])].tobytes().decode()
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        at = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends)  # the last token of each piece
        sizes = np.zeros(len(start), np.int64)
        sizes[joint] = np.diff(at + 1, prepend=0)
        if len(joint) < len(start):
            alone = np.setdiff1d(np.arange(len(start)), joint)
            own, sizes[alone] = self._alone(raw, start[alone], stop[alone])
            first, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint32)
            out[ranges(first[joint], sizes[joint])], out[ranges(first[alone], sizes[alone])] = ids, own
            ids = out
        return ids, sizes

    def _alone(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, part = np.concatenate([[0], np.cumsum(end - start)]), raw[ranges(start, end - start)]
        texts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(part)).to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text, the end id included."""
        start = cuts(raw, at)
        stop = np.append(start[1:], len(raw))
        h = np.maximum(tb.quick_hash(raw, start, stop), np.uint64(1))
        number = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(stop - start <= LONGEST)
        number[short] = self._find(h[short])
        if self.ids.n + (number[short] < 0).sum() > MOST_KNOWN:
            self._forget(np.flatnonzero(self.again[: self.ids.n])[-MOST_KNOWN // 2 :])  # what was met once goes first
            number[short] = self._find(h[short])
        self.again[number[short[number[short] >= 0]]] = True
        new = short[number[short] < 0]
        if len(new):
            distinct, first = (x[: MOST_KNOWN - self.ids.n] for x in np.unique(h[new], return_index=True))  # of a giant text not all
            first = new[first]
            size = stop[first] - start[first]
            self._learn(distinct, *self._encoded(raw, start[first], stop[first]), raw[ranges(start[first], size)], size)
            number[new] = self._find(h[new])
        number[short[~self._same(raw, start[short], stop[short], number[short])]] = -1
        known, other = self.ids.n, np.flatnonzero(number < 0)
        if len(other):  # for this call only
            number[other] = known + np.arange(len(other), dtype=np.int32)
            self.ids.append(*self._encoded(raw, start[other], stop[other]))
        ids, sizes = self.ids.take(number)
        self.ids.n = known
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, at)]
        return np.insert(ids, stops[1:], np.uint32(end)), np.diff(stops) + 1

    def _same(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the known piece of its number."""
        known, sizes = self.bytes.take(number)
        same = sizes == stop - start
        if not same.all():
            return same & (number < 0)  # a hash met twice, which is not to be expected: encode the whole call anew
        differ = np.flatnonzero(raw[ranges(start, sizes)] != known)
        same[np.searchsorted(np.cumsum(sizes), differ, "right")] = False
        return same


def solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is surely no white space: of the longer characters those that
    begin like a white space of Unicode are not."""
    last, one, two = raw[at], raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
    odd = (one == 0xC2) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE3) & (one == 0x80))
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~odd)


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start: at texts, and at white space after a character that is surely none."""
    space = np.flatnonzero(tb.SEPARATOR[raw[1:]]) + 1
    cut = np.zeros(len(raw) + 1, bool)
    cut[at[:-1]] = cut[space[solid(raw, space - 1)]] = True
    return np.flatnonzero(cut[:-1])


_encoders: dict[str, Encoder] = {}


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int = END_ID, vocabulary: int = 50_257) -> DataFrame:
    """Writes shards and index; returns the records (doc_id, ordinal, shard, offset, n, start)."""
    spark, item = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, records = TaskContext.get().partitionId(), []
        encoder = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encoder

        def payload():
            at, last, ordinal = 0, None, -1
            for batch in batches:
                for part in tb.parts(batch, "text", PART):
                    ids, n = encoder.encode(*tb.texts(part.column("text")), end)
                    offset = at + np.concatenate([[0], np.cumsum(n)[:-1]]) * np.dtype(item).itemsize
                    ordinals = []
                    for key in part.column("doc_id").to_pylist():
                        ordinal = ordinal + 1 if last == (key,) else 0
                        last = (key,)
                        ordinals.append(ordinal)
                    records.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ordinals, pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(offset.astype(np.int64)), pa.array(n)], ["doc_id", "ordinal", "shard", "offset", "n"]))
                    raw = ids.astype(item).tobytes()
                    at += len(raw)
                    yield raw

        source = payload()
        first = next(source, None)
        if first is not None:
            write_whole(f"{path}/shard-{shard:05d}.ids", (x for s in ([first], source) for x in s))
        yield from records

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = tasks_for(spark, size // 2)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    records = materialise(text_batches(ranged).mapInArrow(write_shard, "doc_id long, ordinal long, shard int, offset long, n long"), "token-records")
    before = records.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a shard
    size = np.dtype(item).itemsize
    records = records.join(before, "shard").withColumn("start", F.col("before") + F.expr(f"offset div {size}")).drop("before")
    buckets = max(1, -(-records.count() // KEYS_PER_BUCKET))

    def write_index(key, pdf: pd.DataFrame) -> pd.DataFrame:
        entries = np.zeros(len(pdf), _ENTRY)
        for name in ("shard", "offset", "n", "start"):
            entries[name] = pdf[name].to_numpy()
        raw = build_index(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64), entries)
        write_whole(f"{path}/index-{int(key[0]):05d}.mph", [raw])
        return pd.DataFrame({"bucket": [int(key[0])], "keys": [len(pdf)]})

    written = _hashed(records, buckets).groupBy("bucket").applyInPandas(write_index, "bucket long, keys long")
    spark.createDataFrame([(buckets, item)], "buckets long, item string").coalesce(1).write.json(f"{path}/meta")
    materialise(written, "token-buckets")
    return records


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    a, b = F.xxhash64("doc_id", "ordinal"), F.xxhash64(F.lit(17), "ordinal", "doc_id")
    return keys.withColumn("a", a).withColumn("b", b).withColumn("bucket", F.pmod("a", F.lit(buckets)))


def _slot(a: np.ndarray, b: np.ndarray, level: int, m: int) -> np.ndarray:
    return (tb.mix(a ^ tb.mix(b, level), level) % np.uint64(m)).astype(np.int64)


def build_index(a: np.ndarray, b: np.ndarray, entries: np.ndarray) -> bytes:
    """Minimal perfect hash of the distinct 128-bit keys (a, b) with one table entry a key."""
    entries["fingerprint"] = (tb.mix(b, 99) >> np.uint64(32)).astype(np.uint32)
    left, sizes, bits, places, base = np.arange(len(a)), [], [], np.zeros(len(a), np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        m = max(64, int(GAMMA * len(left)) + 63 & ~63)
        slot = _slot(a[left], b[left], level, m)
        alone = np.bincount(slot, minlength=m) == 1
        settled = alone[slot]
        places[left[settled]] = base + slot[settled]
        sizes.append(m)
        bits.append(alone)
        base += m
        left = left[~settled]
    if len(left):
        raise ValueError("equal keys in one index bucket")
    packed = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
    table = entries[np.argsort(places)]
    return _HEAD.pack(b"MPH1", len(sizes), len(a)) + np.array(sizes, "<i8").tobytes() + packed.tobytes() + table.tobytes()


class Index:
    """One bucket's perfect hash, loaded."""

    def __init__(self, raw: bytes):
        magic, levels, n = _HEAD.unpack_from(raw)
        if magic != b"MPH1":
            raise ValueError("not an index file")
        self.sizes = np.frombuffer(raw, "<i8", levels, _HEAD.size)
        at, total = _HEAD.size + 8 * levels, int(self.sizes.sum())
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8, total // 8, at)).astype(bool)
        self.rank = np.cumsum(self.bits) - self.bits
        self.table = np.frombuffer(raw, _ENTRY, n, at + total // 8)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entries for the keys, and whether each is a key of this index."""
        slot, base, left = np.full(len(a), -1, np.int64), 0, np.arange(len(a))
        for level, m in enumerate(self.sizes):
            at = base + _slot(a[left], b[left], level, int(m))
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + int(m)
        found = slot >= 0
        entry = self.table[np.maximum(slot, 0)] if len(self.table) else np.zeros(len(a), _ENTRY)
        return entry, found & (entry["fingerprint"] == (tb.mix(b, 99) >> np.uint64(32)).astype(np.uint32))


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ordinal, shard, offset, n, start) of the keys that the store holds."""
    meta = spark.read.schema("buckets long, item string").json(f"{path}/meta").first()

    def probe(key, pdf: pd.DataFrame) -> pd.DataFrame:
        with open_ranges(f"{path}/index-{int(key[0]):05d}.mph") as f:
            index = Index(f.read())
        entry, found = index.find(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64))
        out = pdf[["doc_id", "ordinal"]].assign(**{k: entry[k] for k in ("shard", "offset", "n", "start")})
        return out[found]

    return _hashed(keys, meta["buckets"]).groupBy("bucket").applyInPandas(probe, "doc_id long, ordinal long, shard int, offset long, n long, start long")


def read_ids(spark: SparkSession, path: str, found: DataFrame, digest: bool = False) -> DataFrame:
    """The ids of looked-up keys, or their CRC-32 as 32-bit integers; rows of a shard in file order."""
    item = np.dtype(spark.read.schema("buckets long, item string").json(f"{path}/meta").first()["item"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, object] | None = None
        for batch in batches:
            values = []
            for shard, offset, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "n")]):
                if opened is None or opened[0] != shard:
                    opened = (shard, open_ranges(f"{path}/shard-{shard:05d}.ids"))
                ids = np.frombuffer(opened[1].read_at(n * item.itemsize, offset), item)
                values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids)
            last = pa.array(values, pa.int64()) if digest else pa.array(values, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "ordinal", "start", "n")], last], ["doc_id", "ordinal", "start", "n", "ids_crc32" if digest else "ids"])

    size = (found.agg(F.sum("n").alias("n")).first()["n"] or 0) * item.itemsize
    ordered = found.repartition(tasks_for(spark, size), "shard", F.expr(f"offset div {STRETCH // 16}")).sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(read, f"doc_id long, ordinal long, start long, n long, {'ids_crc32 long' if digest else 'ids array<int>'}")


def keys_of(docs: DataFrame) -> DataFrame:
    """One (doc_id, ordinal) key for each row."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("rows"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("ordinal"))


def token_store_digest(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Encodes and writes all documents, then reads every one back by its key."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_store(docs, tokenizer, path)
    rows = read_ids(spark, path, materialise(look_up(spark, path, keys_of(docs)), "token-places"), digest=True)
    return rows.select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
