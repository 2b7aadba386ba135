"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection per tile, tree merging.

The query set is packed into tiles in the shared folder and visited in blocks of at most `block_mb`; a block,
and only a block, is sent to the tasks, so what is sent has a fixed bound. Each task multiplies tiles of the block's
queries with tiles of its shard, so a product has at most tile x tile scores, and keeps a top list per query; the lists of all shards meet in two levels (query and salt,
then query), so no task gathers more than k rows per shard or salt.

Nulls: vectors that are null, or hold a null or non-finite component, and rows without id take no part.
Vectors are only compared with vectors of the same length. Ties: the smaller id ranks first. Rows with the
query's id are the query's own and never candidates. Repeated query rows each get a list. Empty tables give no
rows. Scores outside the long range are cut to its ends. Vectors of any length are taken whole. Extra columns of any
name are ignored: only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import dropped, in_parts, materialise, table

#: Score of "no candidate"; real scores are cut to more than this.
NONE = -(2**63)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows held as doubles, as 64-bit numbers."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(q) @ whole(c).T, NONE + 1, 2**63 - 1).astype(np.int64)


def vectors(ids: pa.Array, col: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dims, ids and floor(scale * x) of the rows that take part, by length."""
    there = pc.and_(pc.is_valid(ids), pc.is_valid(col)).to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    offsets, flat = col.offsets.to_numpy(), col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    number = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[there]):
        rows = np.flatnonzero(there & (size == d))
        m = flat[offsets[rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(axis=1)
        yield int(d), number[rows][ok], np.floor(m[ok] * scale)


class TopLists:
    """The k best of what was shown so far, for each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, tile: int = 2048):
        self.own, self.q, self.k, self.tile = ids, q, k, tile
        self.score, self.id = np.full((len(q), k), NONE, np.int64), np.zeros((len(q), k), np.int64)

    def show(self, ids: np.ndarray, c: np.ndarray) -> None:
        """A tile of candidates, to one tile of queries after the other."""
        for at in range(0, len(self.q), self.tile):
            self._show(slice(at, at + self.tile), ids, c)

    def _show(self, part: slice, ids: np.ndarray, c: np.ndarray) -> None:
        s = product(self.q[part].astype(np.float64), c)
        s[self.own[part, None] == ids[None, :]] = NONE
        best, who_best = self.score[part], self.id[part]  # views
        floor = best[:, -1].copy()
        reach = (s >= floor[:, None]) & (s != NONE)
        if reach.sum() > 32 * s.shape[0] and s.shape[1] > self.k:  # partial selection: the k-th value of the tile
            floor = np.maximum(floor, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k])
            reach = (s >= floor[:, None]) & (s != NONE)
        row, at = np.nonzero(reach)
        if not len(row):
            return
        old = np.repeat(np.arange(len(s)), self.k)
        row, score, who = np.concatenate([old, row]), np.concatenate([best.ravel(), s[row, at]]), np.concatenate([who_best.ravel(), ids[at]])
        order = np.lexsort((who, ~score, row))  # ~: descending
        row, score, who = row[order], score[order], who[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        best[row[keep], place[keep]], who_best[row[keep], place[keep]] = score[keep], who[keep]


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, tile: int = 2048, block_mb: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k best rows of `candidates`."""
    spark = queries.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, tile):
            found = [x for x in vectors(b.column(0), b.column(1), scale) if len(x[1])]
            wide = [bool(len(m) and np.abs(m).max(initial=0) > 2**24) for _, _, m in found]  # others are exact in 32 bits
            body = [m.astype(np.float64 if w else np.float32).tobytes() for (_, _, m), w in zip(found, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in found], pa.int32()), pa.array([i.tobytes() for _, i, _ in found], pa.binary()), pa.array(body, pa.binary()), pa.array(wide, pa.bool_())], names=["dims", "ids", "v", "wide"])

    tiles = materialise(queries.select(id_col, vec_col).mapInArrow(pack, "dims int, ids binary, v binary, wide boolean"), "topk-queries")
    outs: list[DataFrame] = []

    def against(block: list) -> None:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists: dict[int, TopLists] = {}
            for d in {x[0] for x in sent.value}:
                ids = np.concatenate([np.frombuffer(i, np.int64) for e, i, _, _ in sent.value if e == d])
                lists[d] = TopLists(ids, np.concatenate([np.frombuffer(v, np.float64 if w else np.float32).reshape(-1, d) if d else np.zeros((len(i) // 8, 0)) for e, i, v, w in sent.value if e == d]), k, tile)
            for b in in_parts(batches, tile):
                for d, ids, m in vectors(b.column(0), b.column(1), scale):
                    if d in lists:
                        lists[d].show(ids, m)
            shard = TaskContext.get().partitionId()
            for d, t in lists.items():
                row, at = np.nonzero(t.score != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(row.astype(np.int32)), pa.array(t.own[row]), pa.array(t.id[row, at]), pa.array(t.score[row, at]), pa.array(np.full(len(row), shard % 64, np.int32))], names=["dims", "q", "query_id", "vec_id", "score", "salt"])

        lists = candidates.select(id_col, vec_col).mapInArrow(run, "dims int, q int, query_id long, vec_id long, score long, salt int")
        for keys in (["dims", "q", "salt"], ["dims", "q"]):
            w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
            lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        outs.append(materialise(lists.select("query_id", "rank", "vec_id", "score"), "topk"))
        sent.unpersist()

    block, held = [], 0
    for r in tiles.toLocalIterator():
        block.append((r.dims, bytes(r.ids), bytes(r.v), r.wide))
        held += len(r.ids) + len(r.v)
        if held >= block_mb << 20:
            against(block)
            block, held = [], 0
    if block or not outs:
        against(block)
    dropped(tiles)
    return spark.read.schema(outs[0].schema).parquet(*[t.scratch_path for t in outs])


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return top_k(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "embedding")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
