"""Exact top-k inner products by columnar branch and bound.

Vectors are kept in blocks, dimension by dimension. A block of queries meets a block of candidates: scores
accumulate over one group of dimensions after another; after each, the rest of a score is at most the product
of the remaining norms, and candidates that can't reach the k-th best lower bound any more are compacted away.
Each task keeps a running best k of each query, which also prunes its later blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import mapped, session

#: Rows of a block of candidates and of queries, components of either at most, and dimensions accumulated at a time.
BLOCK, QUERIES, CELLS, GROUP = 8192, 256, 1 << 20, 16
SCALE = 1024


def _block(rows: int):
    """Blocks (d, block, ids, data) of the vectors of a partition, data dimension by dimension."""

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, {}

        def emit(d, got):
            nonlocal number
            number += 1
            ids = np.array([g[0] for g in got], np.int64)
            x = np.array([g[1] for g in got], np.int64).reshape(len(got), d)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part << 32 | number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["d", "block", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                got = held.setdefault(len(v), [])
                got.append((i, v))
                if len(got) >= max(1, min(rows, CELLS // max(1, len(v)))):
                    yield emit(len(v), held.pop(len(v)))
        for d, got in held.items():
            yield emit(d, got)

    return run


def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray):
    """For each query (scores, ids) of the candidates that may be among its k highest. queries: (q, d) integers;
    data: (d, n); floor: scores that k candidates seen before reach already."""
    d, n = data.shape
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * d
    kind = np.float64 if big < 2**52 else np.int64  # doubles add such integers exactly
    q, x = queries.astype(kind), data.astype(kind)
    cuts = [*range(0, d, GROUP), d] if d else [0]
    # norms of what remains from each cut on, a little too large rather than too small
    rest_q = [np.sqrt((queries[:, c:].astype(np.float64) ** 2).sum(1)) * (1 + 1e-9) for c in cuts]
    tail = np.zeros((len(cuts), n))
    for j in range(len(cuts) - 2, -1, -1):
        tail[j] = tail[j + 1] + (data[cuts[j] : cuts[j + 1]].astype(np.float64) ** 2).sum(0)
    rest_x = np.sqrt(tail) * (1 + 1e-9)
    first = q[:, : cuts[1]] @ x[: cuts[1]] if d else np.zeros((len(q), n))
    out = []
    for i in range(len(q)):
        alive, s, least = np.flatnonzero(ids != own[i]), None, float(floor[i])
        s = first[i][alive]
        for j in range(1, len(cuts)):
            if j > 1:
                s = s + q[i, cuts[j - 1] : cuts[j]] @ x[cuts[j - 1] : cuts[j], alive]
            slack = rest_q[j][i] * rest_x[j][alive] + 1e-6
            if len(s) > k:
                least = max(least, float(np.partition(s - slack, len(s) - k)[len(s) - k]))
            keep = s + slack >= least
            alive, s = alive[keep], s[keep]
        out.append((s.astype(np.int64), ids[alive]))
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k highest integer
    inner products with other vectors of floor(SCALE * x), ties to the smaller vec_id.

    Rows with a null vec_id, and vectors that are null or hold a null or a non-finite component, take no part.
    Vectors meet those of their own length only. Candidates with the query's vec_id are its own. Further columns
    are ignored. Queries and candidates meet in blocks, all against all; a block of queries is copied to each of
    the shuffle partitions."""
    spark = vectors.sparkSession
    session(spark)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "d int, block long, ids binary, data binary"
    cand = mapped(v, _block(BLOCK), schema).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    ask = mapped(v.where(F.col("vec_id") % every == 0), _block(QUERIES), schema)
    ask = ask.select(F.col("d").alias("e"), F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("s"))
    pairs = cand.join(ask, (F.col("d") == F.col("e")) & (F.col("slot") == F.col("s"))).select("d", "qb", "qids", "qdata", "block", "ids", "data").sortWithinPartitions("qb", "block")

    def run(batches):
        now, own, q, top = None, None, None, []

        def emit():
            rows = [(int(o), int(i), int(s)) for o, (ss, ii) in zip(own, top) for s, i in zip(ss, ii)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

        for b in batches:
            for d, qb, qids, qdata, ids, data in zip(*[b.column(c).to_pylist() for c in ("d", "qb", "qids", "qdata", "ids", "data")]):
                if qb != now:
                    if now is not None:
                        yield emit()
                    now, own = qb, np.frombuffer(qids, np.int64)
                    q = np.frombuffer(qdata, np.int64).reshape(d, len(own)).T
                    top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
                ids = np.frombuffer(ids, np.int64)
                floor = np.array([s[k - 1] if len(s) >= k else -np.inf for s, _ in top])
                for i, (s, w) in enumerate(best(q, own, ids, np.frombuffer(data, np.int64).reshape(d, len(ids)), k, floor)):
                    s, w = np.concatenate((top[i][0], s)), np.concatenate((top[i][1], w))
                    order = np.lexsort((w, -s))[:k]
                    top[i] = (s[order], w[order])
        if now is not None:
            yield emit()

    found = mapped(pairs, run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
