"""Exact top-k search by block-at-a-time pruning.

Vectors become integers, floor(64 * x). They are dealt by range of vec_id into block groups and, within a group, into
document-range blocks of BLOCK vectors; a block keeps a forward index (its vectors) and, for each component, the largest
and smallest value. The bound of a query on a block is the sum over components of the larger product of the query's
value with either. Each query takes blocks in descending order of bound and stops when the next bound lies below its k-th
score so far; equal bounds are still scored, for ties go by vec_id.

Queries and blocks form a grid: a cell holds one group of queries and one group of blocks, both of bounded size, so no
task grows with the input and more machines take more cells. The same bounds, of whole block groups, choose the cells:
each query group first takes the cell with the greatest bound; its k-th scores then rule out every cell whose bounds all
lie below them, before a vector is shuffled to it, and go along as thresholds to the cells that are left. Where bounds
rule nothing out (vectors without order in their vec_ids), the cells are query groups times block groups, which an exact
search over all rows needs. Each cell returns a query's k best; they are merged by a rank per query.

Defined cases: vectors null or with null or non-finite components take no part; rows of one vec_id are one vector's
(such a row is no candidate of its own vec_id; differing vectors of one vec_id are queries of their own, merged by
rank); vectors shorter than others count as zero beyond their end; fewer than k candidates give as many rows; components
and scores beyond 64 bits count as the nearest 64-bit integer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window

from casebook.llm.shared import written

BLOCK, QUERY_GROUP, BLOCK_GROUP = 256, 2048, 32768
#: Block groups whose bounds are held by one task when cells are chosen.
BOUND_GROUP = 1024
#: Components that one task's block group holds at most.
GROUP_VALUES = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>): the vectors that take part."""
    wide = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad).select("vec_id", F.transform("e", lambda x: F.floor(x * 64)).alias("v"))


def _matrix(rows) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(list(rows), np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _kind(a: np.ndarray, b: np.ndarray):
    """A type in which inner products of rows of two matrices are exact: floats, 64-bit or unbounded integers."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    most = top(a) * top(b) * max(1, a.shape[1])
    return np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object


def _clipped(x: np.ndarray) -> np.ndarray:
    """64-bit integers, the nearest where a value is none."""
    return (np.clip(x, LEAST, MOST) if x.dtype == object else x).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray, kind) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, as 64-bit integers."""
    return _clipped(a.astype(kind) @ b.astype(kind).T)


def _padded(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The bound of each query on each block, of which the components' largest and smallest values are given."""
    kind = _kind(queries, np.concatenate([high, low]))
    q = queries.astype(kind)
    return _clipped(np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK):
    """(query row, vec_id, score) of each query's k best among ``vectors`` (sorted by id), own id left out; of scores below
    ``floor``, a score for each query, none need come."""
    queries, vectors = _padded(queries, vectors)
    n, edges = len(queries), range(0, len(vectors), block)
    high = np.stack([vectors[a : a + block].max(0) for a in edges])
    low = np.stack([vectors[a : a + block].min(0) for a in edges])
    bound = bounds(queries, high, low)
    order = np.argsort(~bound, axis=1, kind="stable")  # ~ turns the order round without overflow
    sorted_bound = np.take_along_axis(bound, order, 1)
    floor = np.full(n, LEAST) if floor is None else floor
    top_score = np.full((n, k), LEAST, np.int64)
    top_id = np.full((n, k), MOST, np.int64)
    filled = np.zeros((n, k), bool)
    kinds = [_kind(queries, vectors[a : a + block]) for a in edges]
    least = lambda rows: np.maximum(np.where(filled[rows, -1], top_score[rows, -1], LEAST), floor[rows])
    at, step, blocks = 0, 1, len(high)
    active = np.flatnonzero(sorted_bound[:, 0] >= floor)
    while at < blocks and len(active):
        turn = order[active, at : at + step]
        open_ = sorted_bound[active, at : at + step] >= least(active)[:, None]
        for b in np.unique(turn[open_]):
            rows = active[((turn == b) & open_).any(1)]
            part = slice(b * block, (b + 1) * block)
            own = ids[part]
            score = _products(queries[rows], vectors[part], kinds[b])
            valid = (own[None, :] != query_ids[rows][:, None]) & (score >= least(rows)[:, None])
            if len(own) > k:  # of one block the k best and all ties with the k-th
                score_ = np.where(valid, score, LEAST)
                cut = np.partition(score_, len(own) - k, axis=1)[:, len(own) - k]
                valid &= score >= cut[:, None]
            some = valid.any(1)
            rows, score, valid = rows[some], score[some], valid[some]
            if not len(rows):
                continue
            cols = np.flatnonzero(valid.any(0))
            score, valid, own = score[:, cols], valid[:, cols], own[cols]
            s = np.concatenate([top_score[rows], score], 1)
            i = np.concatenate([top_id[rows], np.broadcast_to(own, score.shape)], 1)
            f = np.concatenate([filled[rows], valid], 1)
            best = np.lexsort((i, ~s, ~f), axis=1)[:, :k]
            top_score[rows], top_id[rows], filled[rows] = (np.take_along_axis(x, best, 1) for x in (s, i, f))
        at += step
        step = min(step * 2, 16)
        if at < blocks:
            active = active[sorted_bound[active, at] >= least(active)]
    row, col = np.nonzero(filled)
    return row, top_id[row, col], top_score[row, col]


def _group_bounds(slim: DataFrame) -> DataFrame:
    """(h, high, low): of each block group the largest and smallest value of every component. Short vectors end in zeros."""
    size = slim.groupBy("h").agg(F.count("*").alias("size"))
    values = slim.select("h", F.posexplode("v").alias("i", "x")).groupBy("h", "i").agg(F.max("x").alias("high"), F.min("x").alias("low"), F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    whole = values.join(size, "h").select("h", "i", *(F.when(F.col("n") < F.col("size"), f(c, zero)).otherwise(F.col(c)).alias(c) for c, f in (("high", F.greatest), ("low", F.least))))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])
    return whole.groupBy("h").agg(side("high").alias("high"), side("low").alias("low"))


def _cells(asked: DataFrame, sides: DataFrame) -> DataFrame:
    """(g, h, bound): of each query group and block group that is still open the greatest bound. ``asked`` has ``floor``,
    a score below which a query wants nothing."""

    def run(q, d):
        import pandas as pd

        if not len(q) or not len(d):
            return pd.DataFrame({"g": [], "h": [], "bound": []})
        queries, high, low = _padded(_matrix(q["v"]), _matrix(d["high"]), _matrix(d["low"]))
        bound = bounds(queries, high, low)
        floor = q["floor"].to_numpy(np.int64)
        open_ = (bound >= floor[:, None]).any(0)
        return pd.DataFrame({"g": q["g"].iloc[0], "h": d["h"][open_], "bound": bound.max(0)[open_]})

    across, down = asked.agg(F.max("g")).first()[0] or 0, sides.agg(F.max("h")).first()[0] or 0
    left = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(down // BOUND_GROUP))))
    right = sides.select("*", (F.col("h") / BOUND_GROUP).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(across))).alias("g"))
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(lambda q, d: run(q, d), "g int, h int, bound bigint")


def _searched(asked: DataFrame, slim: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """RESULT of the cells (g, h)."""

    def cell(q, d):
        import pandas as pd

        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        d = d.sort_values("vec_id", kind="stable")
        ids = q["vec_id"].to_numpy(np.int64)
        row, vec, score = search(ids, _matrix(q["v"]), d["vec_id"].to_numpy(np.int64), _matrix(d["v"]), k, q["floor"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": score})

    own = [(F.col(c) + 0).alias(c) for c in ("g", "h")]  # columns of this side alone, for both sides come from the cells
    left = asked.join(cells, "g").select(*own, "vec_id", "v", "floor")
    right = slim.join(cells, "h").select(*own, "vec_id", "v")
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(lambda q, d: cell(q, d), RESULT)


def _grouped(rows: DataFrame, groups: int, name: str) -> DataFrame:
    """``rows`` by range of vec_id, in a written table with the number of each row's group, below ``groups``."""
    table = written(rows.repartitionByRange(groups, "vec_id").withColumn("at", F.spark_partition_id()), "topk-groups")
    parts = (table.agg(F.max("at")).first()[0] or 0) + 1
    return table.withColumn(name, F.floor(F.col("at") * min(groups, parts) / parts).cast("int")).drop("at")


def top_k(vectors: DataFrame, query_divisor: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by ``query_divisor``."""
    vectors = quantized(vectors)
    is_query = F.col("vec_id") % query_divisor == 0
    n, queries, width = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    rows = max(BLOCK, min(BLOCK_GROUP, GROUP_VALUES // max(1, width or 1)))
    across, down = max(1, math.ceil(queries / QUERY_GROUP)), max(1, math.ceil(n / rows))
    slim = _grouped(vectors, down, "h")
    asked = _grouped(vectors.where(is_query), across, "g").withColumn("floor", F.lit(LEAST))
    if down == 1:
        found = _searched(asked, slim, asked.select("g").distinct().withColumn("h", F.lit(0)), k)
    else:
        sides = written(_group_bounds(slim), "topk-bounds")
        first = written(_cells(asked, sides).groupBy("g").agg(F.max_by("h", F.struct("bound", "h")).alias("h")), "topk-cells")
        seeds = written(_searched(asked, slim, first, k), "topk-seeds")
        kth = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
        asked = asked.join(kth, "vec_id", "left").select("vec_id", "v", "g", F.coalesce("kth", "floor").alias("floor"))
        rest = written(_cells(asked, sides).join(first, ["g", "h"], "left_anti").select("g", "h"), "topk-cells")
        found = seeds.unionByName(_searched(asked, slim, rest, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for every query of the whole table."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
