"""Exact top-k inner products over integer vectors.

Vectors are cut into blocks by descending length. Block 0, the longest vectors, gives every query a
first k-th score. A later block is visited by a query only if query length times the block's greatest
length can reach that score. Inside a block, vectors go by descending length in rotated coordinates
(singular vectors of all data): the sum over the leading coordinates plus the product of the residual
lengths bounds the whole product, and only pairs whose bound reaches the k-th score are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.store import saved

FOUND = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class SearchConfig:
    """``leading``: rotated coordinates summed before the bound is asked; blocks in rows."""

    k: int = 20
    leading: int = 16
    block: int = 8192
    query_block: int = 1024
    step: int = 512


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: components floor(scale * x). Null or non-finite ones and null ids are left out.

    Rows that share an id count as one, with the smallest of their vectors.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return good.groupBy("vec_id").agg(F.min(v).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; a shorter vector is filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, from the sum of outer products (width x width numbers)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            part = matrix(batch.column(0), width)
            total += part.T @ part
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (i.ravel(), j.ravel(), total.ravel()))), ["i", "j", "x"])

    parts = vectors.select("v").mapInArrow(products, "i long, j long, x double")
    gram = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r.i, r.j] = r.x
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, rows: np.ndarray,
    turn: np.ndarray, config: SearchConfig,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of ``rows`` per query, as positions of queries, ids and scores. ``least``: a k-th score known before."""
    length = np.sqrt((rows * rows).sum(1))
    order = np.lexsort((ids, -length))
    ids, rows, length = ids[order], rows[order], length[order]
    lead = config.leading
    q, c = queries @ turn, rows @ turn
    query_length = np.sqrt((queries * queries).sum(1))
    q_rest = np.sqrt(np.maximum((q[:, lead:] ** 2).sum(1), 0))
    c_rest = np.sqrt(np.maximum((c[:, lead:] ** 2).sum(1), 0))
    slack = 1e-9 * (1 + query_length * (length[0] if len(length) else 0))  # rounding of the rotated sums
    least = least.copy()
    who = np.zeros(0, np.int64)
    hit_id, hit = np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(ids), config.step):
        b = a + config.step
        live = np.flatnonzero(query_length * length[a] >= least - slack)
        if not len(live):
            break
        bound = q[live, :lead] @ c[a:b, :lead].T + np.outer(q_rest[live], c_rest[a:b])
        open_ = bound >= (least - slack)[live, None]
        open_ &= query_ids[live, None] != ids[None, a:b]
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        if len(i) * 8 > open_.size:
            score = (queries[live] @ rows[a:b].T)[i, j]
        else:
            score = np.einsum("ij,ij->i", queries[live[i]], rows[a + j])
        i = live[i]
        good = score >= least[i]
        who, hit_id = np.concatenate((who, i[good])), np.concatenate((hit_id, ids[a + j[good]]))
        hit = np.concatenate((hit, score[good]))
        place = np.lexsort((hit_id, -hit, who))
        who, hit_id, hit = who[place], hit_id[place], hit[place]
        first = np.searchsorted(who, np.arange(len(queries)))
        rank = np.arange(len(who)) - first[who]
        top = rank < config.k
        who, hit_id, hit, rank = who[top], hit_id[top], hit[top], rank[top]
        last = rank == config.k - 1
        least[who[last]] = np.maximum(least[who[last]], hit[last])
    return who, hit_id, hit


def top_k(vectors: DataFrame, query: Column, scale: int = 64, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products per query row, ties to the smaller id.

    ``query`` says which rows of ``vectors`` (vec_id, embedding) are queries; a query is not its own
    candidate. Fewer than k candidates give all of them; an empty table gives an empty one. Scores are
    exact while squared lengths stay below 2^53. Shorter vectors count as filled up with zeros.
    """
    table = whole_vectors(vectors, scale)
    length2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    table = saved(table.withColumn("length2", length2))
    total = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not total.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(table, total.width)
    parts = -(-total.n // config.block)
    placed = table.repartitionByRange(parts, F.desc("length2"), "vec_id").withColumn("block", F.spark_partition_id())
    placed = saved(placed)
    longest = {r.block: r.m for r in placed.groupBy("block").agg(F.max("length2").alias("m")).collect()}
    bounds = [float(np.sqrt(longest[b])) for b in sorted(longest)]  # one number per block
    asked = placed.filter(query)
    n_query_blocks = max(1, -(-asked.count() // config.query_block))
    asked = asked.select(
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("q"),
        F.sqrt(F.col("length2").cast("double")).alias("query_length"),
        F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int").alias("query_block"),
    )
    first = sorted(longest)[0]
    head = _cells(
        asked.withColumn("least", F.lit(None).cast("double")).withColumn("block", F.lit(first)),
        placed.filter(F.col("block") == first).withColumn("query_block", _all(n_query_blocks)),
        turn, config,
    )
    head = saved(head)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = head.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == config.k)
    kth = kth.select("query_id", F.col("score").cast("double").alias("least"))
    wanted = asked.join(kth, "query_id", "left")
    blocks = sorted(longest)[1:]
    if blocks:
        table_of = F.lit([[float(b), x] for b, x in zip(blocks, bounds[1:], strict=True)])
        reach = F.filter(
            table_of,
            lambda x: F.col("least").isNull() | (F.col("query_length") * x[1] * (1 + 1e-12) >= F.col("least")),
        )
        wanted = wanted.withColumn("block", F.explode(F.transform(reach, lambda x: x[0].cast("int"))))
        wanted = saved(wanted)
        cells = saved(wanted.select("query_block", "block").distinct())
        rest = _cells(wanted, placed.join(cells, "block"), turn, config)
        head = head.unionByName(rest)
    ranked = head.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _all(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _cells(queries: DataFrame, rows: DataFrame, turn: np.ndarray, config: SearchConfig) -> DataFrame:
    """Search every (query block, block) cell; both sides hold a bounded number of rows in it."""
    width = len(turn)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": [], "vec_id": [], "score": []}, pa.schema([(c, pa.int64()) for c in names]))
        query_ids = left.column("query_id").to_numpy()
        least = left.column("least").to_numpy().astype(np.float64)
        who, ids, score = search_block(
            query_ids, matrix(left.column("q"), width), np.where(np.isnan(least), -np.inf, least),
            right.column("vec_id").to_numpy(), matrix(right.column("v"), width), turn, config,
        )
        return pa.table([query_ids[who], ids, score.astype(np.int64)], names)

    names = ["query_id", "vec_id", "score"]
    left = queries.select("query_block", "block", "query_id", "q", "least").groupBy("query_block", "block")
    right = rows.select("query_block", "block", "vec_id", "v").groupBy("query_block", "block")
    return left.cogroup(right).applyInArrow(cell, FOUND)
