"""Exact top-k inner products by the threshold algorithm.

Rows are cut into blocks of bounded size and queries into blocks of bounded
size; each pair of blocks is one group.  Within it every dimension has a list
of the rows sorted by that component.  A query walks all lists in parallel
from the end that its own component favours, scores each row it meets, and
stops when no unseen row can beat its kth result.

Defined cases: vectors that are null, or hold a null or a non-finite
component, take no part, nor do those whose length differs from the most
common one; rows of equal id and vector count once; rows that share an id but
not a vector are candidates each, and share one ranking as queries; ties go to
the smaller id; with fewer than k candidates all are returned; an empty table
gives no rows.  Scores are exact up to 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, ship

RESULT = "query_id long, vec_id long, score long"


def threshold_search(
    rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows, itself left out.

    ``rows`` and ``queries`` are integer-valued and sorted by nothing;
    ``ids`` must ascend, so that positions break ties as ids do.
    """
    n, dims = rows.shape
    exact = np.float32 if _largest(rows) * _largest(queries) * dims < 2**23 else np.float64
    data = rows.astype(exact)
    lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)  # ascending, a list per dimension
    values = np.take_along_axis(rows.T, lists, 1)
    out_q, out_r, out_s = [], [], []
    seen = np.zeros(n, np.int64)
    for number, (q, own) in enumerate(zip(queries, query_ids, strict=True), 1):
        weight, down = q.astype(exact), q > 0
        used = np.flatnonzero(q)
        best = np.zeros(0, np.int64)
        best_s = np.zeros(0, np.int64)
        depth, step = 0, 4
        while depth < n:
            to = min(n, depth + step)
            near = np.concatenate(
                [lists[used[down[used]], n - to : n - depth].ravel(), lists[used[~down[used]], depth:to].ravel()]
            ) if len(used) else np.arange(depth, to)
            near = near[seen[near] != number]
            seen[near] = number
            near = np.unique(near)
            if len(near) * 4 > n:
                score = (data @ weight)[near]
            else:
                score = data[near] @ weight
            score = score.astype(np.int64)
            other = ids[near] != own
            near, score = np.append(best, near[other]), np.append(best_s, score[other])
            if len(near) > k:
                cut = -np.partition(-score, k - 1)[k - 1]
                good = score >= cut
                near, score = near[good], score[good]
                order = np.lexsort((ids[near], -score))[:k]
                near, score = near[order], score[order]
            best, best_s = near, score
            depth, step = to, step * 4
            if len(best) == k and len(used):
                heads = np.where(down, values[:, n - to], values[:, to - 1]).astype(np.float64)
                # An unseen row is, in each list, behind the place reached.
                if float(heads @ q.astype(np.float64)) < best_s.min():
                    break
        out_q.append(np.full(len(best), own))
        out_r.append(ids[best])
        out_s.append(best_s)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_r), join(out_s)


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = 16_384,
    query_block: int = 2_048,
) -> DataFrame:
    """Each query's ``k`` best other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x).  ``is_query`` is a condition on the
    id.  ``block`` and ``query_block`` bound a group's rows; a row is copied
    once per query block, and a query once per row block.
    """
    double = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), double.alias("x"))
    sound = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & (F.size("x") > 0)
    sound &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(sound).select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(scale))).alias("x"))
    rows = materialize(rows.dropDuplicates(["vec_id", "x"]), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    rows = rows.where(F.size("x") == common.d)
    row_blocks, query_blocks = -(-int(common.n) // block), max(1, -(-int(common.q) // query_block))
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)))
    dealt = dealt.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.where(is_query).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    ship(vectors.sparkSession)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left = left.sort_values("vec_id", kind="stable")
        matrix = lambda f: np.array(f["x"].tolist(), np.int64)
        q, r, s = threshold_search(matrix(left), left["vec_id"].to_numpy(), matrix(right), right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": r, "score": s})

    found = dealt.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
