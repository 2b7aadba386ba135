"""Mixing sources to target weights: weighted fair queueing.

Targets: sources in code point order (null last) weigh `weights`, repeating; together they take `share` of all
words. A target stops at `cap` times its source's words, and the excess goes to the others by weight: a level, words
for a unit of weight, is shared out anew among the sources that it doesn't fill until it fills no more (Newton's
method on a concave line of pieces, a few passes over a row per source, of exact whole numbers). Sources are numbered
by a prefix sum over ranges, so no step gathers them.

Queueing: each source's documents are put in a hashed order, up to `cap` times over; a copy's virtual finish
time is its source's words so far over the source's target. All copies are range-sorted by finish time and cut
where the total is spent. Both sums are two-pass prefix sums, so no source meets in one task.

Nulls: a null text has 0 words; null sources form one source, the last; a null id is kept. Repeated rows are
documents of their own. Ties in finish time go by hash, id and copy. Empty tables give no rows. A source without
words has target 0. Reruns agree, whatever the number of tasks. Texts of any length are counted whole. Extra columns
of any name are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialise, rows_of, running_sum, table, word_count


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size, target from a row per source with its words."""
    ranked = running_sum(sizes.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one")), "all", ["source"], "one", "sources")
    ranked = materialise(ranked.select("source", "source_size", (F.col("before") % len(weights)).cast("int").alias("turn")), "weighed")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)
    # by turn, at most as many rows as weights: sources that a level leaves unfilled, words, words of those it fills
    total = sum(r["s"] or 0 for r in ranked.groupBy("turn").agg(F.sum("source_size").alias("s")).collect())
    level, filled = 0.0, -1
    while True:
        open_ = F.col("source_size") * cap > level * weight if filled >= 0 else F.lit(True)
        found = ranked.groupBy("turn").agg(F.count_if(open_).alias("n"), F.sum(F.when(~open_, F.col("source_size"))).alias("s"), F.count_if(~open_).alias("full")).collect()
        left = sum(weights[r["turn"]] * r["n"] for r in found)
        if sum(r["full"] for r in found) == filled or not left:
            break
        filled = sum(r["full"] for r in found)
        level = (share * total - cap * sum(r["s"] or 0 for r in found)) / left
    most = F.col("source_size").cast("double") * cap
    return ranked.select("source", "source_size", (F.least(F.lit(level) * weight, most) if left else most).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid_col: str | None = None, **how) -> DataFrame:
    """rid, doc_id, size, source_size, target, taken, copies: a row per document."""
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    base = docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("h"))
    base = materialise(base, "sizes")
    goal = materialise(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    queued = running_sum(base, "source", ["h", "doc_id", "rid"], "size", "queues")
    cap = how.get("cap", 2)
    timed = queued.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    line = running_sum(timed.select("rid", "size", "h", "doc_id", "copy", finish.alias("finish"), F.lit(0).alias("all")), "all", ["finish", "h", "doc_id", "rid", "copy"], "size", "line")
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    taken = line.where(F.col("before") + F.col("size") <= total).groupBy("rid").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    named = base.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return named.join(taken, "rid", "left").select("rid", "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    kept = materialise(docs.select(rows_of(docs), F.monotonically_increasing_id().alias("_rid")), "to-mix")
    plain = kept.select("_rid", *[F.col("_row")[c].alias(to) for c, to in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    plan = mix(plain, rid_col="_rid", **how).where("copies > 0").select(F.col("rid").alias("_rid"), "copies")
    return kept.join(plan, "_rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
