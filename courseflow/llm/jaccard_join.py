"""Self-join of documents by Jaccard similarity of their word n-gram sets, as a blocked sparse product.

The incidence matrix has a row a document and a column an n-gram (a 64-bit hash). Its product with itself
holds the overlap of every two rows; size-derived bounds leave out most of it:

* Rows of equal sets are one class, of which one representative takes part.
* A row of n n-grams reaches similarity t only with rows that share ceil(t n) of them, so they share one of
  its first n - ceil(t n) + 1 in any fixed order of the columns (its keys). The order is by how often a
  count-min sketch saw a column: once, a few times, often; within that by hash. Columns seen once take up
  keys and match nothing, so a document with enough text of its own has no key to be shuffled.
* Two rows meet only under a common key and if their sizes allow the similarity.
* Each row with keys has marks, a bit for one or two columns: the parity of its columns in each cell. Marks of two rows differ in no more
  cells than the rows do in columns, which bounds the overlap from above. Marks travel to where rows meet, at
  an eighth of a byte or so a column; the columns follow only of rows that this bound leaves.

Rows that meet and may link are multiplied in blocks over all their columns, and the accumulated overlap decides. First
every row meets, of the smallest rows under its keys, the HUBS with which it shares most keys; after these
links are joined to components, rows that share a key and near sizes but not a component are multiplied tile by tile (all
links between components are found, those within a component are not needed), and each product of two
tiles returns a forest of its links, never more rows than the tiles have.

Defined cases: null text or no words: empty set, linked with nothing; fewer than k words: the whole
sequence is the one n-gram; rows with a null doc_id are linked with nothing and have a null component;
rows that share a doc_id are one document that has several sets; an empty table gives no rows; ties are
met by the exact comparison in integers; further columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm import sketch
from courseflow.llm import textblock as tb
from courseflow.llm.shared import free_name, materialise, text_batches

WORDS, PERCENT = 4, 85
HUBS = 3  # smallest rows that each row meets first; the comparison across components finds what is left
TILE_ROWS, TILE_GRAMS = 1024, 400_000  # rows that are multiplied as one block, about
DENSE = 8192  # products of a column's two counts above which it is multiplied densely
PART = 1 << 19  # bytes of text that are cut into n-grams at once, about
MARK_BITS = 64, 1 << 16  # cells of a row's marks: the next power of two above its columns, within these
FEW = 32  # a column seen less often comes before more frequent ones


class Sets:
    """Distinct n-gram hashes of the rows of a block of texts, sorted within each row."""

    def __init__(self, text: pa.Array, k: int):
        raw, at = tb.texts(text)
        words = tb.Words(tb.lower_ascii(raw), at)
        n = np.diff(words.first)
        grams, rows = [], []
        whole = words.windows(k)
        grams.append(words.window_hash(whole, k)), rows.append(words.row[whole])
        for few in range(1, k):
            short = np.flatnonzero(n == few)
            grams.append(words.window_hash(words.first[short], few, 100 + few)), rows.append(short)
        h, row = np.concatenate(grams), np.concatenate(rows)
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row, self.rows = h[new], row[new], len(n)
        self.n = np.bincount(self.row, minlength=len(n))
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def signature(self, seed: int) -> np.ndarray:
        total = np.zeros(len(self.hash) + 1, tb.U)
        np.cumsum(tb.mix(self.hash, seed), out=total[1:])
        return tb.mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(tb.U), seed)

    def marks(self) -> pa.BinaryArray:
        """For every row the parity of its columns in as many cells as its size calls for."""
        width = mark_width(self.n)
        first = np.concatenate([[0], np.cumsum(width)])
        cell = (tb.mix(self.hash, 5) & (width - 1).astype(tb.U)[self.row]).astype(np.int64) + first[self.row]
        odd = np.packbits((np.bincount(cell, minlength=first[-1]) & 1).astype(bool))
        return pa.Array.from_buffers(pa.binary(), self.rows, [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(odd)])

    def keys(self, percent: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): the first columns of every row, without those seen once."""
        cell = sketch.cells(self.hash, 0, sketch.width_of(bits))
        again, often = sketch.bit(bits[0], cell), sketch.bit(bits[1], cell)
        first = np.where(100 * self.n >= percent * (self.n + 1), self.n - -(-percent * self.n // 100) + 1, 0)  # of small sets only equal ones link
        chosen = np.zeros(len(self.hash), bool)
        for group in (~again, again & ~often, again & often):
            total = np.concatenate([[0], np.cumsum(group)])
            nth = total[1:] - total[self.first[self.row]]
            chosen |= group & (nth <= first[self.row])
            first = np.maximum(first - (total[self.first[1:]] - total[self.first[:-1]]), 0)
        at = np.flatnonzero(chosen & again)
        return self.row[at], self.hash[at]


def mark_width(n: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.clip(n, *MARK_BITS))).astype(np.int64)


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Lists of 64-bit values by row; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _mapped(docs: DataFrame, k: int, finish, schema: str, wanted=None) -> DataFrame:
    """Rows that ``finish(part, sets)`` makes of the texts of ``docs``, of those alone that ``wanted(batch)`` tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch if wanted is None else batch.filter(pa.array(wanted(batch))), "text", PART):
                yield finish(part, Sets(part.column("text"), k))

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig_a, sig_b): size and 128-bit hash of each document's set."""

    def sign(part: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *_size_and_hash(sets)], ["doc_id", "n", "sig_a", "sig_b"])

    return _mapped(docs, k, sign, "doc_id long, n long, sig_a long, sig_b long")


def _size_and_hash(sets: Sets) -> list[pa.Array]:
    return [pa.array(sets.n.astype(np.int64)), *[pa.array(sets.signature(seed).view(np.int64)) for seed in (1, 2)]]


def row_keys(docs: DataFrame, k: int, percent: int, grams: int, reps: DataFrame) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, keys, marks) of the documents that have keys, among those in ``reps`` (node) and few others, as exact
    copies make no column more frequent; ``grams`` is the sum of their sizes."""
    rows, some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _passing(reps)
    width = sketch.width_for(grams // 2)
    load = grams / 2**width
    often = max(FEW, math.ceil(load + 6 * math.sqrt(load)) + 1)  # what chance alone puts in few cells

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in tb.parts(batch.filter(pa.array(some(batch))), "text", PART):
            yield Sets(part.column("text"), k).hash

    bits = sketch.repeated(text_batches(rows), hashes, 1, width, often)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # two bits a cell: 64 MB at most

    def cut(part: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        row, key = sets.keys(percent, shared.value)
        batch = pa.RecordBatch.from_arrays([part.column("doc_id"), *_size_and_hash(sets), _lists(row, key, sets.rows), sets.marks()], ["doc_id", "n", "sig_a", "sig_b", "keys", "marks"])
        return batch.filter(pa.array(np.bincount(row, minlength=sets.rows) > 0))

    return _mapped(rows, k, cut, "doc_id long, n long, sig_a long, sig_b long, keys array<long>, marks binary", some)


def _passing(wanted: DataFrame) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Which rows of a batch with doc_id are of the documents in ``wanted`` (node), or of few others: a bit filter of bounded size."""
    ids = lambda batch, name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    bits = sketch.members(wanted, lambda batch: ids(batch, "node"), wanted.count())
    shared = wanted.sparkSession.sparkContext.broadcast(bits)
    return lambda batch: sketch.may_repeat(ids(batch, "doc_id"), shared.value)


def gram_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, grams): the rows of the incidence matrix of the documents in ``wanted`` (node). A bit filter of
    the wanted ids, of bounded size, keeps most other texts from being cut up; texts are not shuffled."""
    def read(part: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.n.astype(np.int64)), _lists(sets.row, sets.hash, sets.rows)], ["node", "n", "grams"])

    return _mapped(docs.where("doc_id is not null"), k, read, "node long, n long, grams array<long>", _passing(wanted)).join(wanted, "node", "left_semi")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of edges (a, b). Every round takes the
    least label among neighbours and jumps to the label's label; rounds are written tables."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = better.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old")
        done = materialise(step, "labels")
        labels = done.select("node", "component")
        if not done.where("component <> old").limit(1).count():
            return labels


def _links(n: np.ndarray, m: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return (common > 0) & (100 * common >= percent * (n + m - common))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and their bounds."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].view(np.uint64), bounds - bounds[0]


def _hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: blocks of rows times the row of their hub a."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "m"))
            (x, at), (y, to) = _flat(batch.column("x")), _flat(batch.column("y"))
            # A run of rows with the same hub set is one block.
            hubs = [x[at[i] : at[i + 1]] for i in range(len(a))]
            first = [i for i in range(len(a)) if not i or a[i] != a[i - 1] or not np.array_equal(hubs[i], hubs[i - 1])]
            common = np.zeros(len(a), np.int64)
            for lo, hi in zip(first, [*first[1:], len(a)]):
                hub, cells = hubs[lo], y[to[lo] : to[hi]]
                hit = hub[np.minimum(np.searchsorted(hub, cells), len(hub) - 1)] == cells
                common[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), np.diff(to[lo : hi + 1])), hit, hi - lo)
            good = _links(n, m, common, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), "n", F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("grams").alias("y"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "n", "m", "x", "y")
    return text_batches(rows).mapInArrow(multiply, "a long, b long").distinct()


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a document."""
    signed = materialise(signatures(docs, k), "signatures")
    known = signed.where("doc_id is not null and n > 0")
    same = ["n", "sig_a", "sig_b"]
    classes = materialise(known.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")  # plain tables, so that large classes can be split in the join
    members = materialise(known.join(classes, same).select("doc_id", "rep", *same).distinct(), "members")
    grams = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    reps = members.where("doc_id = rep").select("doc_id", *same)
    keys = row_keys(docs, k, percent, grams, classes.select(F.col("rep").alias("node"))).join(reps, ["doc_id", *same], "left_semi")
    rows = materialise(keys.select(F.col("doc_id").alias("node"), "n", "keys", "marks"), "keys")
    keyed, marked = rows.select(F.explode("keys").alias("key"), "node", "n"), Rows(docs, k, rows.select("node", "n", "marks"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node < last").select("key", "hub")
    shared = materialise(keyed.join(hubs, "key"), "shared-keys")
    stars = shared.where(f"node <> hub.node and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)").groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("agree"))
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("agree"), "a"))
    stars = materialise(stars.withColumn("nth", best).where(f"nth <= {HUBS}").select("a", "b"), "stars")
    near = materialise(_near(stars, marked.marks, percent), "near-stars")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
    extra = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    edges = materialise(_hub_links(near, marked.sets(near.select(F.explode(F.array("a", "b")).alias("node"))), percent).unionByName(extra), "edges")
    joined = connected(edges)
    late = materialise(_across(shared, joined, marked, stars, percent), "late-edges")
    if late.limit(1).count():
        joined = connected(edges.unionByName(late))
    placed = members.groupBy("doc_id").agg(F.min("rep").alias("node")).join(joined, "node", "left").select("doc_id", F.least("doc_id", F.coalesce("component", "node")).alias("component_id"))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (key, n), each twice, under a key of its band of sizes and of the next one: sizes that allow the
    similarity are at most one band apart, so that rows with such sizes have a key in common and most others none."""
    scale = 1 / max(1.001 * math.log(100 / percent), 1e-3) if percent > 0 else 0.0  # a little wider than the bound: logarithms are rounded
    band = F.floor(F.log("n") * F.lit(scale))
    return rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("key", F.xxhash64("key", "band")).drop("band")


class Rows:
    """Rows of the incidence matrix: marks (node, n, marks) of those with keys, and the columns of those that are asked for."""

    def __init__(self, docs: DataFrame, k: int, marks: DataFrame):
        self.docs, self.k, self.marks = docs, k, marks

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, n, grams) of the rows in ``wanted`` (node), written."""
        return materialise(gram_sets(self.docs, materialise(wanted.distinct(), "wanted"), self.k), "sets")


def _at_most(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of rows of n and rows of m columns, from their marks x and y as rows of words."""
    return (n + m - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)) // 2


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Marks (rows, words) as those of fewer cells: a cell is the low bits of a hash, so halves fall together."""
    while x.shape[-1] > words:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    return x


def _near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the similarity, as far as their marks tell."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "m"))
            x, y = ([np.frombuffer(v, "<u8") for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            most = [_at_most(n[i], m[i], _folded(x[i], len(y[i])), _folded(y[i], len(x[i]))) for i in range(len(a))]
            good = _links(n, m, np.array(most, np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    left = marks.select(F.col("node").alias("a"), "n", F.col("marks").alias("x"))
    right = marks.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("marks").alias("y"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "n", "m", "x", "y")
    return text_batches(met).mapInArrow(test, "a long, b long").distinct()


def _across(shared: DataFrame, joined: DataFrame, marked: Rows, tested: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of rows that share a key and near sizes but not a component.

    Rows are dealt to tiles of bounded size, by the most common of their keys and apart from the component
    of most rows there; of two tiles that share a key the marks are compared, and if these leave a link possible, the tiles
    are multiplied in one piece. A key of two rows that are a pair (a, b) of ``tested`` has nothing left to find."""
    rows = _banded(shared.select("key", "node", "n"), percent).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = rows.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    major = counted.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("parts > 1")
    pair = (F.col("rows") == 2) & (F.col("lo") == F.col("a")) & (F.col("hi") == F.col("b"))
    major = major.join(tested, pair, "left_anti").select("key", "rows", "grams", F.col("top.component").alias("major"))
    major = materialise(major, "open-keys")  # a plain table, so that a frequent key can be split in the join
    open_ = rows.join(major, "key").groupBy("node", "component").agg(F.max(F.struct("rows", "grams", "key", "major")).alias("most"), F.collect_set("key").alias("keys"))
    piece = F.expr(f"pmod(xxhash64(node), ceil(greatest(most.rows / {TILE_ROWS}, most.grams / {TILE_GRAMS})))")
    dealt = materialise(open_.withColumn("tile", F.xxhash64("most.key", F.expr("component = most.major"), piece)).drop("most"), "open-rows")
    keys = dealt.select("tile", "component", F.explode("keys").alias("key")).groupBy("key", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = keys.select("key", *[F.col(c).alias(f"{c}_y") for c in ("tile", "lo", "hi")])
    meet = keys.join(other, "key").where("tile <= tile_y and not (lo = hi and lo_y = hi_y and lo = lo_y)").select("tile", "tile_y").distinct()
    placed = dealt.select("node", "component", "tile")
    told = materialise(_tiles(placed.join(marked.marks, "node"), "marks", _packed_marks), "tile-marks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = [Marks(x[i]).may_link(Marks(y[i]), percent) for i in range(len(x))]
            yield batch.select(["tile", "tile_y"]).filter(pa.array(good, pa.bool_()))

    met = materialise(text_batches(_sides(meet, told)).mapInArrow(compare, "tile long, tile_y long"), "near-tiles")
    near = placed.join(met.select(F.explode(F.array("tile", "tile_y")).alias("tile")).distinct(), "tile", "left_semi")
    near = materialise(near, "near-rows")
    tiles = materialise(_tiles(near.join(marked.sets(near.select("node")), "node"), "grams", _packed), "tiles")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = Tile(batch.column("x")[i].as_py()).links(Tile(batch.column("y")[i].as_py()), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return text_batches(_sides(met, tiles)).mapInArrow(multiply, "a long, b long").distinct()


def _tiles(rows: DataFrame, cells: str, pack) -> DataFrame:
    """(tile, rows): the rows (tile, node, n, component, cells) of each tile in one value."""
    grouped = rows.groupBy("tile").agg(F.collect_list(F.struct("node", "n", "component", cells)).alias("rows"))
    return text_batches(grouped).mapInArrow(pack, "tile long, rows binary")


def _sides(meet: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, tile_y, x, y): the pairs of ``meet`` (tile, tile_y) with what both tiles hold."""
    return meet.join(tiles.withColumnRenamed("rows", "x"), "tile").join(tiles.select(F.col("tile").alias("tile_y"), F.col("rows").alias("y")), "tile_y").select("tile", "tile_y", "x", "y")


def _packed_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile as 64-bit integers: number of rows; n, component, words of marks by row; all words."""
    for batch in batches:
        payload = []
        for i in range(batch.num_rows):
            table = batch.column("rows").slice(i, 1).flatten()
            marks = table.field("marks").to_pylist()
            by_row = [table.field(c).to_numpy(zero_copy_only=False) for c in ("n", "component")]
            payload.append(np.concatenate([[len(marks)], *by_row, [len(x) // 8 for x in marks]]).astype("<i8").tobytes() + b"".join(marks))
        yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(payload, pa.binary())], ["tile", "rows"])


class Marks:
    """The marks of some rows, those of one width together."""

    def __init__(self, packed: bytes):
        head = np.frombuffer(packed, "<i8")
        rows = int(head[0])
        n, component, words = head[1 : 1 + 3 * rows].reshape(3, -1)
        first = 1 + 3 * rows + np.cumsum(words) - words
        flat = head.view("<u8")
        self.groups = []
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            self.groups.append((n[at], component[at], flat[first[at][:, None] + np.arange(w)]))

    def may_link(self, other: Marks, percent: int) -> bool:
        """Whether a row of this tile and one of the other, of different components, may reach the similarity."""
        for n, c, x in self.groups:
            for m, d, y in other.groups:
                fewer, step = min(x.shape[1], y.shape[1]), max(1, (1 << 20) // y.size)
                folded = _folded(y, fewer)
                for at in range(0, len(n), step):  # about a million words at a time
                    some = slice(at, at + step)
                    most = _at_most(n[some, None], m[None, :], _folded(x[some], fewer)[:, None, :], folded[None, :, :])
                    if (_links(n[some, None], m[None, :], most, percent) & (c[some, None] != d[None, :])).any():
                        return True
        return False


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile as 64-bit integers: numbers of rows and cells; node, n, component by row; row, gram by cell."""
    for batch in batches:
        payload = []
        for i in range(batch.num_rows):
            table = batch.column("rows").slice(i, 1).flatten()
            grams, bounds = _flat(table.field("grams"))
            by_row = [table.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "component")]
            payload.append(np.concatenate([[len(table), len(grams)], *by_row, np.repeat(np.arange(len(table)), np.diff(bounds)), grams.view(np.int64)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(payload, pa.binary())], ["tile", "rows"])


class Tile:
    """Some rows of the incidence matrix, its cells in the order of their columns."""

    def __init__(self, packed: bytes):
        head = np.frombuffer(packed, "<i8")
        rows = int(head[0])
        self.node, self.n, self.component = head[2 : 2 + 3 * rows].reshape(3, -1)
        row, gram = head[2 + 3 * rows :].reshape(2, -1)
        order = np.argsort(gram, kind="stable")
        self.row, gram = row[order], gram[order]
        self.column, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))

    def overlaps(self, other: Tile) -> np.ndarray:
        """How many columns each row of this tile shares with each of the other."""
        _, i, j = np.intersect1d(self.column, other.column, assume_unique=True, return_indices=True)
        n, m = self.first[i + 1] - self.first[i], other.first[j + 1] - other.first[j]
        total, shape = np.zeros((len(self.n), len(other.n)), np.int32), (len(self.n), len(other.n))
        dense = np.flatnonzero(n * m > DENSE)
        for at in range(0, len(dense), 2048):
            some = dense[at : at + 2048]
            total += (self._block(i[some]) @ other._block(j[some]).T).astype(np.int32)
        few = np.flatnonzero(n * m <= DENSE)
        cells = np.cumsum((n * m)[few])
        for at in range(0, int(cells[-1]) if len(few) else 0, 1 << 21):  # about two million products at a time
            some = few[np.searchsorted(cells, at, "right") : np.searchsorted(cells, at + (1 << 21), "right")]
            size = (n * m)[some]
            which = np.repeat(np.arange(len(some)), size)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x = self.row[self.first[i[some]][which] + nth // m[some][which]]
            y = other.row[other.first[j[some]][which] + nth % m[some][which]]
            total += np.bincount(x * shape[1] + y, minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)
        return total

    def _block(self, columns: np.ndarray) -> np.ndarray:
        n = self.first[columns + 1] - self.first[columns]
        ends = np.cumsum(n)
        at = np.repeat(self.first[columns] - (ends - n), n) + np.arange(ends[-1])
        out = np.zeros((len(self.n), len(columns)), np.float32)
        out[self.row[at], np.repeat(np.arange(len(columns)), n)] = 1
        return out

    def links(self, other: Tile, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(root, node): a forest of the links between components, each node under the least node of its tree."""
        linked = _links(self.n[:, None], other.n[None, :], self.overlaps(other), percent)
        linked &= self.component[:, None] != other.component[None, :]
        x, y = np.nonzero(linked)
        return forest(self.node[x], other.node[y])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node): a forest of the links a - b, each node under the least node of its tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a linked document of smaller id stands for; all columns stay.
    Of rows that repeat a doc_id one stays, the one of least text hash; rows with a null doc_id all stay."""
    other = free_name(docs, "doc_id_gone")
    gone = components(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(f"`{other}`"), "left_anti")
    nth = free_name(docs, "nth_row")
    numbered = left.withColumn(nth, F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return numbered.where(F.col("doc_id").isNull() | (F.col(f"`{nth}`") == 1)).drop(nth)
