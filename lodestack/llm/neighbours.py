"""Operator 4: nearest neighbours by largest inner product, as a block matrix join.

Vectors are packed into blocks of int8 codes with a scale each.  A tile is a block of the stated query
set against a block of all rows: the codes' product gives every inner product with a bound on its error
from quantisation, and only pairs that can still be among a query's nearest are computed again in double
precision and merged into its heap.  Query blocks go to every group of candidate blocks; what moves grows with
the query set times the number of groups, never with the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, stage

BLOCK_ROWS = 2048
TILES_AT_ONCE = 4
HELD_BLOCKS = 32


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as double arrays; None if null, empty, zero, or holding null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.float64))).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out: list[np.ndarray | None] = []
    for b, e in zip(begins.tolist(), ends.tolist()):
        v = flat[b:e]
        out.append(v if e > b and np.isfinite(v).all() and v.any() else None)
    return out


def _blocks(df: DataFrame, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """Rows packed in blocks: ids, vectors, int8 codes, and per vector its scale, norm and error's norm.

    Vectors keep 32 bits if the column has them; all is computed in double precision.
    """
    source = only(df, id_col, vector_col)
    narrow = source.schema[1].dataType.simpleString() == "array<float>"

    def packed(key: int, dim: int, ids: list[int], vs: list[np.ndarray]) -> dict:
        x = np.array(vs)
        scale = np.abs(x).max(1) / 127
        code = np.rint(x / scale[:, None]).astype(np.int8)
        off = np.linalg.norm(x - code * scale[:, None], axis=1)
        return {
            "block": key,
            "dim": dim,
            "ids": np.array(ids, np.int64).tobytes(),
            "vectors": (x.astype(np.float32) if narrow else x).tobytes(),
            "codes": code.tobytes(),
            "facts": np.stack([scale, np.linalg.norm(x, axis=1), off]).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), vectors_of(b.column(1))):
                if i is None or v is None:
                    continue
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i), vs.append(v)
                if len(ids) == rows:
                    yield pa.RecordBatch.from_pylist([packed(key, len(v), ids, vs)], SCHEMA)
                    key += 1
                    del held[len(v)]
        for dim, (ids, vs) in held.items():
            yield pa.RecordBatch.from_pylist([packed(key, dim, ids, vs)], SCHEMA)
            key += 1

    return source.mapInArrow(run, "block long, dim int, ids binary, vectors binary, codes binary, facts binary")


SCHEMA = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("facts", pa.binary())]
)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _vectors(block: dict) -> np.ndarray:
    """A block's vectors, as they are held."""
    rows = len(block["ids"]) // 8 * block["dim"]
    return np.frombuffer(block["vectors"], np.float32 if len(block["vectors"]) == 4 * rows else np.float64).reshape(-1, block["dim"])


def _tile(q: dict, c: dict, best: list[list], k: int) -> None:
    """Merge a tile's pairs into ``best``: per query (-score, id), ascending."""
    dim = q["dim"]
    qi, ci = np.frombuffer(q["ids"], np.int64), np.frombuffer(c["ids"], np.int64)
    qx, cx = _vectors(q), _vectors(c)
    qs, qn, qe = np.frombuffer(q["facts"]).reshape(3, -1)
    cs, cn, ce = np.frombuffer(c["facts"]).reshape(3, -1)
    qc, cc = np.frombuffer(q["codes"], np.int8).reshape(-1, dim), np.frombuffer(c["codes"], np.int8).reshape(-1, dim)
    wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # either holds the products of codes exactly
    near = (qc.astype(wide) @ cc.astype(wide).T).astype(np.float64) * qs[:, None] * cs
    bound = (qe[:, None] * cn + (qn + qe)[:, None] * ce) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn
    near[qi[:, None] == ci] = -np.inf  # a query's own row
    low = near - bound
    _, times = np.unique(ci, return_counts=True)
    need = k * int(times.max())  # so many rows have k different ids
    floor = np.full(len(qi), -np.inf) if need >= len(ci) else -np.partition(-low, need - 1, axis=1)[:, need - 1]
    held = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best])
    row, col = np.nonzero((near + bound >= np.maximum(floor, held)[:, None]) & (near > -np.inf))
    score = _inner(qx[row].astype(np.float64), cx[col].astype(np.float64))
    cuts = np.searchsorted(row, np.arange(len(qi) + 1))
    for i in range(len(qi)):
        s, e = cuts[i], cuts[i + 1]
        if s == e:
            continue
        merged: list[tuple[float, int]] = []
        seen: set[int] = set()
        for one in heapq.merge(best[i], sorted(zip((-score[s:e]).tolist(), ci[col[s:e]].tolist()))):
            if one[1] not in seen:
                seen.add(one[1])
                merged.append(one)
                if len(merged) == k:
                    break
        best[i] = merged


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of each query's ``k`` nearest other ids.

    ``queries`` is a condition on ``df`` that states the query set.  Nearness is the inner product in double
    precision; ties go to the smaller id.  All true neighbours are found: bounds only rule pairs out that cannot be
    among them.  Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, take no part.  Vectors of different lengths are not compared.  Repeated rows of an id count once, by their
    best score.  Fewer candidates than ``k`` are all returned; an empty table gives no rows.
    """
    spark = df.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batch_rows(spark, block_rows):
        c = stage(_blocks(df, id_col, vector_col, block_rows), "candidates")
        q = stage(_blocks(df.where(queries), id_col, vector_col, block_rows // 2), "queries")
    left = c.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    right = q.select(*[F.col(x).alias("q_" + x) for x in q.columns], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_g"))
    # Spark's estimate of the query blocks leaves their copies out, and a broadcast would bring them all to the driver.
    tiles = left.join(right.hint("merge"), (F.col("g") == F.col("q_g")) & (F.col("dim") == F.col("q_dim")))
    names = [x.name for x in SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bytes, list[list]]] = {}
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def flush() -> Iterator[pa.RecordBatch]:
            for ids, lists in best.values():
                rows = [(i, v, -s) for i, b in zip(np.frombuffer(ids, np.int64).tolist(), lists) for s, v in b]
                if rows:
                    a, v, s = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], schema=schema)
            best.clear()

        for b in batches:
            for t in range(b.num_rows):
                row = b.slice(t, 1).to_pylist()[0]
                one, two = {n: row["q_" + n] for n in names}, {n: row[n] for n in names}
                if one["block"] not in best:
                    if len(best) == HELD_BLOCKS:
                        yield from flush()
                    best[one["block"]] = (one["ids"], [[] for _ in range(len(one["ids"]) // 8)])
                _tile(one, two, best[one["block"]][1], k)
        yield from flush()

    with batch_rows(spark, TILES_AT_ONCE):
        found = stage(tiles.mapInArrow(run, "query_id long, vec_id long, score double"), "nearest")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
