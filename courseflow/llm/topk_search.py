"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(256 * x). Candidates are dealt in blocks; each block holds, for every
dimension, posting segments of the rows whose component falls in one quantised level. For a query, a
segment's impact is its least contribution above the dimension's least, so impacts are not negative and
segments are processed in descending impact, adding it to the accumulators of their rows. What a row can
still gain is at most, for each dimension, the larger of the level's width and the largest impact left.
Processing stops only when that bound proves that few rows can still be among the k best; those possible
members are rescored exactly. Blocks meet query blocks over an explicit key, and the k best of each block
are merged for each query.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows
with a null id; of rows that repeat a vec_id the least vector counts; missing components of shorter
vectors count as zero; vectors with a component beyond 2**24 after scaling are packed in blocks of their own,
whose scores are summed in Python integers without the index (a score that 64 bits cannot hold is null, its
rank right); ties go to the smaller vec_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm.shared import materialise, text_batches

BLOCK, QUERY_BLOCK, LEVELS = 16_384, 256, 32
CHECK_EVERY, FEW = 96, 256
NARROW, WIDE_BLOCK = 1 << 24, 256


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, wide): integer vectors, as doubles that hold them exactly, of the rows that take part, one row a vec_id."""
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are integers
    x = F.transform("embedding", lambda e: whole(e.cast("double") * 256))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double") * 256) == float("inf")))
    fine = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("wide", F.exists("v", lambda e: F.abs(e) > NARROW))


def blocks(vectors: DataFrame, size: int, narrow: int, wide: int) -> DataFrame:
    """(block, ids, matrix, dims, texts): rows packed by hash of their id, ``size`` a block on average, and WIDE_BLOCK a block
    where they are wide: then ``texts`` has their integers in decimal, and there is no matrix."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        dims = max((len(v) for v in pdf["v"]), default=0)
        row = {"block": [int(key[0])], "ids": [pdf["vec_id"].to_numpy().tobytes()], "matrix": [b""], "dims": [dims], "texts": [None]}
        if pdf["wide"].iloc[0]:
            return pd.DataFrame(row | {"texts": ["\n".join(" ".join(str(int(c)) for c in v) for v in pdf["v"])]})
        matrix = np.zeros((len(pdf), dims), np.int32)
        for i, v in enumerate(pdf["v"]):
            matrix[i, : len(v)] = v
        return pd.DataFrame(row | {"matrix": [matrix.tobytes()]})

    own = _count(narrow, size)
    number = F.when(F.col("wide"), own + F.pmod(F.xxhash64("vec_id"), F.lit(max(1, _count(wide, WIDE_BLOCK))))).otherwise(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, own)))).alias("block")
    return vectors.select(number, "vec_id", "v", "wide").groupBy("block").applyInPandas(pack, "block long, ids binary, matrix binary, dims int, texts string")


def _count(rows: int, size: int) -> int:
    return -(-rows // size)


def integers(row: dict, prefix: str = "") -> list[list[int]]:
    """The rows of a packed block as Python integers."""
    if row[f"{prefix}texts"] is not None:
        return [[int(c) for c in v.split()] for v in row[f"{prefix}texts"].split("\n")]
    n = len(row[f"{prefix}ids"]) // 8
    return np.frombuffer(row[f"{prefix}matrix"], np.int32).reshape(n, row[f"{prefix}dims"]).tolist()


def sort_key(score: int) -> str:
    """A text that sorts like the score."""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return "1" + key if score >= 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))


def plain_search(query_id: int, query: list[int], ids: np.ndarray, rows: list[list[int]], k: int) -> list[tuple[int, int]]:
    """The k best (id, score) in integers of any size."""
    scored = ((-sum(a * b for a, b in zip(query, row)), int(i)) for i, row in zip(ids, rows) if i != query_id)
    return [(i, -s) for s, i in heapq.nsmallest(k, scored)]


class ImpactIndex:
    """Posting segments of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.dim, self.low, self.high, self.rows = [], [], [], []
        for d in range(matrix.shape[1]):
            column = matrix[:, d]
            least = int(column.min())
            width = max(1, -(-(int(column.max()) - least + 1) // LEVELS))
            level = (column - least) // width
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for rows in np.split(order, cuts):
                values = column[rows]
                self.dim.append(d), self.low.append(int(values.min())), self.high.append(int(values.max())), self.rows.append(rows)
        self.dim, self.low, self.high = np.array(self.dim, np.int64), np.array(self.low, np.int64), np.array(self.high, np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and exact scores; rows of the query's own id are left out."""
        n, dims = self.matrix.shape
        own = self.ids == query_id
        possible = np.flatnonzero(~own)
        if len(self.dim) and len(possible) > k:
            possible = self._members(query[: dims], own, k)
        score = self.matrix[possible].astype(np.int64) @ query[:dims]
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible][best], score[best]

    def _members(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best, once the bound proves that no other row can."""
        a, b = q[self.dim] * self.low, q[self.dim] * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        floor = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, least)
        gain, top = least - floor[self.dim], most - floor[self.dim]
        order = np.argsort(-gain, kind="stable")
        width = np.zeros(len(q), np.int64)
        np.maximum.at(width, self.dim, most - least)
        total = np.zeros(len(own), np.int64)
        total[own] = np.iinfo(np.int64).min // 2
        rows = self.rows
        few = max(FEW, len(own) // 64)
        possible = np.flatnonzero(~own)
        for done in range(0, len(order), CHECK_EVERY):
            for s in order[done : done + CHECK_EVERY]:
                if gain[s]:
                    total[rows[s]] += gain[s]
            left = order[done + CHECK_EVERY :]
            open_ = width.copy()
            np.maximum.at(open_, self.dim[left], top[left])
            slack = int(open_.sum())
            bar = np.partition(total, len(total) - k)[len(total) - k]  # the k-th best has at least this
            possible = np.flatnonzero((total + slack >= bar) & ~own)
            if len(possible) <= few:
                break
        return possible


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: (query_id, rank, vec_id, score)."""
    vectors = materialise(quantised(embeddings), "topk-vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    counts = vectors.agg(F.count_if(~F.col("wide")).alias("n"), F.count_if(is_query & ~F.col("wide")).alias("q"), F.count_if("wide").alias("w"), F.count_if(is_query & F.col("wide")).alias("wq")).first()
    data = blocks(vectors, BLOCK, counts["n"], counts["w"])
    query_blocks, data_blocks = (max(1, _count(n, size) + _count(w, WIDE_BLOCK)) for n, size, w in ((counts["q"], QUERY_BLOCK, counts["wq"]), (counts["n"], BLOCK, counts["w"])))
    # Queries go to every data block. Data blocks are only repeated, for groups of query blocks, while there
    # are fewer of them than the session's shuffles have tasks.
    groups = min(query_blocks, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // data_blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = blocks(vectors.where(is_query), QUERY_BLOCK, counts["q"], counts["wq"]).select(F.pmod("block", F.lit(groups)).alias("group"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dims").alias("q_dims"), F.col("texts").alias("q_texts")).withColumn("block", numbers(data_blocks))
    tasks, keys = min(10_000, data_blocks * groups), ["block", "group"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                if r["texts"] is not None or r["q_texts"] is not None:
                    rows = integers(r)
                    hits = [(int(q), *hit) for q, v in zip(q_ids, integers(r, "q_")) for hit in plain_search(int(q), v, ids, rows, k)]
                else:
                    if held != r["block"]:
                        held, index = r["block"], ImpactIndex(ids, np.frombuffer(r["matrix"], np.int32).reshape(len(ids), r["dims"]))
                    queries = np.zeros((len(q_ids), max(r["q_dims"], r["dims"])), np.int64)
                    queries[:, : r["q_dims"]] = np.frombuffer(r["q_matrix"], np.int32).reshape(len(q_ids), r["q_dims"])
                    hits = [(int(q), int(i), int(s)) for q, v in zip(q_ids, queries) for i, s in zip(*index.search(int(q), v, k))]
                q, i, s = zip(*hits) if hits else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array([x if abs(x) < 1 << 63 else None for x in s], pa.int64()), pa.array([sort_key(x) for x in s], pa.string())], ["query_id", "vec_id", "score", "key"])

    pairs = data.withColumn("group", numbers(groups)).repartition(tasks, *keys).hint("merge").join(asked.repartition(tasks, *keys), keys)  # comes sorted by block
    best = text_batches(pairs.select("block", "ids", "matrix", "dims", "texts", "q_ids", "q_matrix", "q_dims", "q_texts")).mapInArrow(search, "query_id long, vec_id long, score long, key string")
    order = W.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
