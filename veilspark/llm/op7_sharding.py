"""Sharding by best-fit-decreasing bin packing: groups of equal texts are indivisible.

Groups are hashed to tasks and, sorted by size within each, packed best-fit-decreasing into bins of a 64th of a
shard; a group above that is a bin of its own. The bins - at most about 128 per shard and one per task, whatever
the corpus size - are then packed best-fit-decreasing into the shards, at the smallest capacity found by
bisection with which all of them fit. Remaining capacities are held in a balanced tree (a treap).

Rows of one group are numbered by task and place in the task, so that a group of any size is counted in parallel.

Nulls: a null text is empty; a null id is kept. Repeated rows are rows of their own, in one shard. A group
larger than a shard's share has a shard of its own as far as possible. Ties go by group hash. Empty tables give
no rows. Texts of any length are measured and hashed whole. Extra columns of any name are ignored: only the id and
the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import materialise, table


class Tree:
    """A treap of (key, value) pairs: insert, remove, and the smallest pair at or above a key."""

    def __init__(self) -> None:
        self.root, self.seed = None, 1

    def _split(self, t, x):
        if t is None:
            return None, None
        if t[0] < x:
            a, b = self._split(t[3], x)
            t[3] = a
            return t, b
        a, b = self._split(t[2], x)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, pair: tuple) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        a, b = self._split(self.root, pair)
        self.root = self._merge(self._merge(a, [pair, self.seed >> 20, None, None]), b)

    def take(self, least: tuple) -> tuple | None:
        """Removes and returns the smallest pair that is not below `least`."""
        t, found = self.root, None
        while t is not None:
            if t[0] < least:
                t = t[3]
            else:
                found, t = t[0], t[2]
        if found is None:
            return None
        a, b = self._split(self.root, found)
        b, rest = self._split(b, (*found, 0))  # only `found` is below this
        self.root = self._merge(a, rest)
        return found


class BestFit:
    """Bins of a fixed capacity; each size enters the bin with the tightest room, else a new bin."""

    def __init__(self, capacity: int, most: int | None = None):
        self.capacity, self.most, self.bins, self.room = capacity, most, 0, Tree()

    def place(self, size: int) -> int | None:
        if size > self.capacity and self.most is None:
            self.bins += 1
            return self.bins - 1
        found = self.room.take((size, -1))
        if found is None:
            if size > self.capacity or self.bins == self.most:
                return None
            found, self.bins = (self.capacity, self.bins), self.bins + 1
        left, at = found
        self.room.insert((left - size, at))
        return at


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Each item's shard, items in the order given (decreasing): the smallest capacity that best-fit can do with."""

    def tried(capacity: int) -> list[int] | None:
        fit, out = BestFit(capacity, shards), []
        for s in sizes:
            at = fit.place(s)
            if at is None:
                return None
            out.append(at)
        return out

    low = max([-(-sum(sizes) // shards), *sizes[:1]])
    high, best = low, tried(low)
    while best is None:
        low, high = high + 1, high + max(high // 64, 1)
        best = tried(high)
    while low < high and high - low > sum(sizes) // shards // 10_000:
        mid = (low + high) // 2
        if (x := tried(mid)) is not None:
            high, best = mid, x
        else:
            low = mid + 1
    return best


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, finer: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row per document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            k = []
            for g in b.column(3).to_pylist():
                k.append(at := seen.get(g, 0))
                seen[g] = at + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(k, pa.int64())], names=["doc_id", "size", "text_crc32", "g", "part", "k"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"))
    rows = materialise(rows.mapInArrow(placed, f"doc_id {kind}, size long, text_crc32 long, g binary, part int, k long"), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    spread = rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    by = Window.partitionBy("g")
    spread = spread.select("g", "part", F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "n", F.sum("n").over(by).alias("rows"), "size")
    spread = materialise(spread.select("g", "part", (F.col("upto") - F.col("n")).alias("first"), "rows", (F.col("rows") * F.col("size")).alias("bytes")), "groups")
    capacity = max(1, -(-total // (shards * finer)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fit, filled = TaskContext.get().partitionId(), BestFit(capacity), {}
        for b in batches:
            bins, base = [], []
            for n, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                bins.append(at := fit.place(size))
                base.append(filled.get(at, 0))
                filled[at] = base[-1] + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(bins), task, np.int32)), pa.array(bins, pa.int32()), pa.array(base, pa.int64())], names=["g", "rows", "bytes", "task", "bin", "base"])

    tasks = max(1, count // 200_000)
    groups = spread.where("first = 0").select("g", "rows", "bytes")
    packed = materialise(groups.repartition(tasks, "g").sortWithinPartitions(F.desc("bytes"), "g").mapInArrow(local, "g binary, rows long, bytes long, task int, bin int, base long"), "bins")
    bins = sorted(((r["bytes"], r["rows"], r["task"], r["bin"]) for r in packed.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()), key=lambda x: (-x[0], x[2], x[3]))
    where, used, known = into_shards([x[0] for x in bins], shards), [0] * shards, []
    for (_, n, task, at), s in zip(bins, where, strict=True):
        known.append((task, at, s, used[s]))
        used[s] += n
    known = spark.createDataFrame(known, "task int, bin int, shard int, slot0 long")
    each = spread.join(packed.join(F.broadcast(known), ["task", "bin"]).select("g", "shard", (F.col("slot0") + F.col("base")).alias("at")), "g")
    each = each.select("g", "part", "shard", (F.col("at") + F.col("first")).alias("at"))
    return rows.join(each, ["g", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("k")).alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
