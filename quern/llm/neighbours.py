"""Nearest neighbours by a block matrix join on int8 tiles.

Queries are a stated set of rows; every row is a candidate, but a query's own row is not one of its
candidates. Queries are cut into blocks of bounded bytes, and a block is broadcast at a time; candidates
are dealt evenly to tasks and never copied. In a task, each batch of candidates is a tile with the
block's queries: vectors are quantised to int8 with a scale each; the product of the int8 matrices
(exact, in float32) gives every distance with an error of at most the two vectors' quantisation errors.
A pair whose least possible distance is above the k-th smallest greatest possible distance of the tile,
or above the k-th smallest distance that the task has found so far, is out; all others are recomputed in
double precision from the original vectors. So the k nearest of a task are exact. Tasks' lists, k
entries a query, are merged by heaps, first those of 64 tasks, then all of a query.

Work is queries times rows, as the query set states. The table is dealt once a block, and a block holds
tens of thousands of queries; each block's result is checkpointed before the next, and a lost task is
computed again alone. Equal queries (key and vector) are asked once and answered for each of their rows.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take no
part, nor do rows with a null key; vectors of different lengths are not compared; repeated rows are
rows of their own, also as candidates of one another; equal distances are ordered by key; an empty
table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, materialise, read

K = 10
#: Rows of a tile, and those that a task takes at most; fewer as long as cores would be idle.
ROWS, TASK_ROWS = 8192, 131072
#: Queries whose bounds a task holds at once.
AT_ONCE = 256
#: Bytes of a block of queries, with their lists.
BLOCK_BYTES = 64 << 20
MERGED = 64


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 matrix, scales, norms of the quantisation errors)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    rest = x - q * scale[:, None]
    return q, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: up to 1,024 components at a time stay below 2^24."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in the order of the components."""
    d = rows - query
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def by_length(table: pa.Table | pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length of ``x``: the matrix of the vectors that take part, then their ``columns``."""
    x = table.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts, others = np.cumsum(sizes) - sizes, [np.asarray(table.column(c)) for c in columns]
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        m = flat[starts[at][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        yield m[ok], *(c[at[ok]] for c in others)


class Nearest:
    """The ``k`` nearest rows that have been seen for each query of one matrix."""

    def __init__(self, y: np.ndarray, k: int):
        self.y, self.k = y, k
        self.scores, self.ids = np.full((len(y), k), np.inf), np.zeros((len(y), k), np.int64)
        self.found = np.zeros(len(y), np.int64)
        with np.errstate(all="ignore"):
            self.q, self.s, self.e = quantised(y)
            self.square = self.s * self.s * (self.q.astype(np.float64) ** 2).sum(axis=1)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        """One tile: every query against the rows ``x``."""
        if len(x) == 0:
            return
        with np.errstate(all="ignore"):
            q, s, e = quantised(x)
            square = s * s * (q.astype(np.float64) ** 2).sum(axis=1)
            for start in range(0, len(self.y), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                near = self.square[part, None] + square[None, :]
                scale = np.sqrt(near)
                near = np.sqrt(np.maximum(near - 2 * self.s[part, None] * s[None, :] * product(self.q[part], q), 0))
                slack = self.e[part, None] + e[None, :] + 1e-6 * scale
                low, high = near - slack, near + slack
                low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
                # a list that is not full ends with infinity
                least = np.where(self.found[part] < self.k, np.inf, self.scores[part, -1])
                if len(x) > self.k:
                    least = np.minimum(least, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
                near_enough = low <= least[:, None]
                for i in np.flatnonzero(near_enough.any(axis=1)).tolist():
                    self._merge(start + i, x, ids, np.flatnonzero(near_enough[i]))

    def _merge(self, i: int, x: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        n = int(self.found[i])
        scores = np.append(self.scores[i, :n], distances(x[at], self.y[i]))
        best = heapq.nsmallest(self.k, zip(scores.tolist(), np.append(self.ids[i, :n], ids[at]).tolist(), strict=True))
        self.found[i] = n = len(best)
        self.scores[i, :n], self.ids[i, :n] = zip(*best, strict=True)


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K, rows: int = ROWS, queries: int | None = None) -> DataFrame:
    """(query_id, rank, ``key``, score): the k nearest candidates of each row for which ``is_query`` holds.

    ``rows`` are those of a tile; a block has at most about ``queries`` queries, if given, and ``BLOCK_BYTES``."""
    spark = vectors.sparkSession
    element = vectors.schema[vector].dataType.elementType
    x = F.col(vector) if isinstance(element, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>")
    found = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id IS NOT NULL AND size(x) > 0")
    asked = materialise(found.where("asks").groupBy("id", "x").agg(F.count("*").alias("copies")))
    n, size = asked.agg(F.count("*"), F.sum(8 * F.size("x") + 32 * (k + 1) + 64)).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES), -(-n // queries) if queries else 1)
    n_rows = vectors.count()
    tasks = max(1, -(-n_rows // TASK_ROWS), min(-(-n_rows // rows), 4 * spark.sparkContext.defaultParallelism))
    # a query's own row is found at distance 0, so one more than k is looked for
    found = found.select("id", "x").repartition(tasks)
    results = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)) == number).toArrow() if n else None
        shared = spark.sparkContext.broadcast(list(by_length(block, "id", "copies")) if block else [])
        one = _answers(found, shared, k, rows)
        results.append(materialise(one) if blocks > 1 else one)
        if blocks > 1:
            shared.unpersist()
    answers = reduce(DataFrame.union, results).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return answers.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "one")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.ids").alias(key), F.col("one.scores").alias("score"))


def _answers(found: DataFrame, shared, k: int, rows: int) -> DataFrame:
    """(place, query_id, copies, ids, scores) for each query of one block."""
    fields = {"length": T.LongType(), "place": T.LongType(), "query_id": T.LongType(), "copies": T.LongType(), "task": T.LongType(), "ids": T.ArrayType(T.LongType()), "scores": T.ArrayType(T.DoubleType())}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = {y.shape[1]: (Nearest(y, k + 1), ids, copies) for y, ids, copies in shared.value}
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for x, ids in by_length(batch.slice(start, rows), "id"):
                    if x.shape[1] in block:
                        block[x.shape[1]][0].add(x, ids)
        task = TaskContext.get().partitionId()
        for length, (near, ids, copies) in block.items():
            for start in range(0, len(ids), 4096):
                at = start + np.flatnonzero(near.found[start : start + 4096])
                lists = [[v[i, : near.found[i]].tolist() for i in at.tolist()] for v in (near.ids, near.scores)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((np.full(len(at), length), at, ids[at], copies[at], np.full(len(at), task), *lists), arrow_type(schema), strict=True)], schema=arrow_type(schema))

    def merged(last: bool):
        def merge(table: pa.Table) -> pa.Table:
            lists = [list(zip(d, i, strict=True)) for d, i in zip(table.column("scores").to_pylist(), table.column("ids").to_pylist(), strict=True)]
            best = [x for x, _ in zip(heapq.merge(*lists), range(k + 1), strict=False)]
            first = {c: table.column(c)[0].as_py() for c in ("length", "place", "query_id", "copies", "task")}
            if last:
                if (own := (0.0, first["query_id"])) in best:
                    best.remove(own)
                best = best[:k]
            return pa.table([*([v] for v in first.values()), [[i for _, i in best]], [[d for d, _ in best]]], schema=arrow_type(schema))

        return merge

    lists = found.mapInArrow(search, schema).withColumn("task", F.expr(f"task div {MERGED}")).groupBy("length", "place", "task").applyInArrow(merged(False), schema)
    return lists.groupBy("length", "place").applyInArrow(merged(True), schema).drop("length", "task")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.e, c.e), lambda z: (c_[1] - c_[2]) * (c_[1] - c_[2]))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
""".replace("c_[", "z[")
