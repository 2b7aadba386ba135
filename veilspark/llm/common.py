"""What the operators of this subpackage share: tables in the shared folder, words, prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six (fixed value of the contracts).
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: a folder of our own in local mode, as in tests, and
    an error on a cluster, whose executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back. `dropped` removes it again."""
    path = f"{shared_dir(df.sparkSession)}/veilspark/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `materialise` that no lazy result depends on."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches (at most 64 MB each by Spark's own bound) cut to at most so many rows: what a task makes of a
    batch's texts stays small. Nothing in the session is changed."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_count(text):
    """Number of words of a text column; null counts 0."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")
    body = F.trim(body)
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def rows_of(docs: DataFrame):
    """All columns of docs as one struct named _row, so that their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group: str, order: list[str], value: str, name: str, out: str = "before") -> DataFrame:
    """Adds `out`: the sum of `value` (long) over the rows of the same group that come earlier in `order`.

    Two passes: a range sort deals rows so that a group of any size spreads over tasks, each task keeps a
    running sum per group and the table is written; then the tasks' totals are summed up (a row per task and
    group) and added. Null groups form one group. Rows that tie in `order` count one after the other.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    gi, vi = df.columns.index(group), df.columns.index(value)

    def run(batches):
        import numpy as np

        part, last, total, begun = TaskContext.get().partitionId(), None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(gi).to_pylist()
            v = b.column(vi).to_numpy(zero_copy_only=False)
            edge = np.fromiter((x != y for x, y in zip(g[1:], g[:-1], strict=True)), bool, len(g) - 1)
            starts = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(g)]])
            local = np.empty(len(g), np.int64)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if not begun or g[s] != last:
                    begun, last, total = True, g[s], 0
                run = np.cumsum(v[s:e])
                local[s:e] = total + run - v[s:e]
                total += int(run[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local"])

    n = partitions(df.sparkSession)
    keys = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    t = materialise(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), name)
    w = "partition by g order by part rows between unbounded preceding and 1 preceding"
    base = t.groupBy(F.col(group).alias("g"), "part").agg(F.sum(value).alias("s")).select("g", F.col("part").alias("p"), F.expr(f"coalesce(sum(s) over ({w}), 0L)").alias("base"))
    j = t.join(base, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")), "left")
    return j.select(*df.columns, (F.col("base") + F.col("local")).cast("long").alias(out))
