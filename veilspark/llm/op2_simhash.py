"""SimHash near-dedup: tiled exact comparison with exclusive-or and bit counts.

A fingerprint bit is 1 if it is set in over half of the hashes of a document's word shingles. Distinct
fingerprints are dealt into tiles by population count; tiles whose counts differ by more than the radius are
never paired, as each differing bit moves the count by one. Inside a pair of tiles the same holds for blocks of
64 fingerprints and the population counts of their bytes, 16- and 32-bit parts: blocks whose counts are further
apart than the radius are skipped, all others are compared bit by bit. A pair of tiles returns a spanning
forest of its links, at most one row per fingerprint, never all pairs of a group; a large-star/small-star
iteration joins the forests into components.

Nulls: a null text has no words (fingerprint zero). Rows without id are fingerprinted and may bridge others, but
give no component id; a component without any id has a null one. Repeated rows stay repeated, but where one document of
a component is kept only one of them stays: ties of the smallest id go to the smallest text hash. Empty tables give no
rows. Texts of any length are read whole. Extra columns of any name are ignored where documents are compared and kept
where documents are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import dropped, in_parts, materialise, partitions, rows_of, table

BLOCK = 64


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of all words where there are fewer."""
    import xxhash

    one = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(one, seed)] if words else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(one[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    over = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * over > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, size: int, seed: int) -> int:
    """SimHash of one text: lower-cased in A-Z, words split at white space of ASCII, shingles of `size` words."""
    return majority(shingle_hashes(text.lower().split(), size, seed))


def fingerprints(docs: DataFrame, keep: list, text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """The columns `keep` (strings or columns) and fp, the fingerprint as a signed long."""
    df = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            fp = np.array([fingerprint(x or b"", size, seed) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return df.mapInArrow(run, schema)


def _sorted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered so that blocks are narrow in their parts' counts; blocks, and their counts' ends."""
    by = np.bitwise_count(a.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    parts = [by.reshape(-1, k, 8 // k).sum(2, dtype=np.int16) for k in (2, 4, 8)]
    order = np.lexsort([p[:, i] for p in reversed(parts) for i in range(p.shape[1])])
    a, c = a[order], np.concatenate(parts, axis=1)[order]
    fill = -len(a) % BLOCK  # the last one again and again: it only meets itself once more
    a, c = np.concatenate([a, np.repeat(a[-1:], fill)]), np.concatenate([c, np.repeat(c[-1:], fill, axis=0)])
    c = c.reshape(-1, BLOCK, c.shape[1])
    return a, c.min(1), c.max(1)


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (`radius` differing bits or fewer) within a, or between a and b."""
    a, low_a, high_a = _sorted(a)
    same = b is None
    b, low_b, high_b = (a, low_a, high_a) if same else _sorted(b)
    both = a if same else np.concatenate([a, b])
    parent, shift = np.arange(len(both)), 0 if same else len(a)
    blocks_a, blocks_b = a.reshape(-1, BLOCK), b.reshape(-1, BLOCK)
    for at in range(0, len(blocks_a), 16):
        gap = np.maximum(low_a[at : at + 16, None] - high_b[None], low_b[None] - high_a[at : at + 16, None])
        np.maximum(gap, 0, out=gap)
        near = np.logical_and.reduce([gap[:, :, s].sum(2) <= radius for s in (slice(0, 2), slice(2, 6), slice(6, 14))])
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i <= j], j[i <= j]
        for k in range(0, len(i), 128):
            ii, jj = i[k : k + 128], j[k : k + 128]
            n, x, y = np.nonzero(np.bitwise_count(blocks_a[ii][:, :, None] ^ blocks_b[jj][:, None, :]) <= radius)
            parent = _joined(parent, ii[n] * BLOCK + x, jj[n] * BLOCK + y + shift)
    child = np.flatnonzero((parent != np.arange(len(parent))) & (both != both[parent]))
    return both[child], both[parent[child]]


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union by hooking larger roots to smaller ones and halving paths, for whole arrays of links at once."""
    while len(u):
        ru, rv = parent[u], parent[v]
        more = ru != rv
        if not more.any():
            break
        u, v = u[more], v[more]
        np.minimum.at(parent, np.maximum(ru, rv)[more], np.minimum(ru, rv)[more])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def forests(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp), enough to join what is linked."""
    ones = F.bit_count(F.col("fp")).cast("int")
    count = {r["ones"]: r["count"] for r in fps.groupBy(ones.alias("ones")).count().collect()}  # 65 rows at most
    subs = {p: -(-n // tile) for p, n in count.items()}
    of = F.create_map(*[F.lit(x) for kv in (subs or {0: 1}).items() for x in kv])
    dealt = fps.withColumn("p", ones).withColumn("s", F.pmod(F.xxhash64("fp", F.lit(7)), of[F.col("p")]).cast("int"))
    tiles = dealt.groupBy("p", "s").agg(F.collect_list("fp").alias("fps"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, s, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body, me = fps.values.to_numpy().tobytes(), (p, s)
                for q in range(p - radius, p + radius + 1):
                    for other in ((q, t) for t in range(subs.get(q, 0))):
                        (p1, s1), (p2, s2) = min(me, other), max(me, other)
                        yield pa.RecordBatch.from_pydict({"p1": pa.array([p1], pa.int32()), "s1": pa.array([s1], pa.int32()), "p2": pa.array([p2], pa.int32()), "s2": pa.array([s2], pa.int32()), "first": [me <= other], "fps": [body]})

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("first", ascending=False)
        u, v = links(*[np.frombuffer(x, np.uint64) for x in g.fps], *[None] * (2 - len(g)), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    pairs = tiles.mapInArrow(pair, "p1 int, s1 int, p2 int, s2 int, first boolean, fps binary")
    return pairs.groupBy("p1", "s1", "p2", "s2").applyInPandas(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each linked node and the smallest node of its component (which has no row of its own)."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return e
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, old = materialise(small, "edges"), e
        dropped(old)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, tile: int = 65536) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id: a row per document."""
    base = materialise(fingerprints(docs, [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th")], text_col, size), "fingerprints")
    per = materialise(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(forests(per.select("fp"), radius, tile))
    rooted = per.join(roots, per.fp == roots.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    linked = rooted.join(roots.select(F.col("v").alias("root")).distinct(), "root", "left_semi")
    named = linked.groupBy("root").agg(F.min("least").alias("known"))
    per_fp = rooted.join(named, "root", "left").select("fp", F.coalesce("known", "least").alias("component_id"))
    return base.join(per_fp, "fp").select("doc_id", "th", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs with one document of each component: the smallest id, and of equal ids the smallest text hash."""
    found = simhash_components(docs, id_col, text_col, **how)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    return _firsts(docs, found.select(group.alias("g"), "doc_id", "th"), id_col, text_col)


def _firsts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that come first in their group; found has g, doc_id, th."""
    best = found.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("b")).select(F.col("b.doc_id").alias("_k"), F.col("b.th").alias("_t"))
    best = materialise(best, "kept")
    own = docs.select(rows_of(docs), F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"))
    out = own.join(best, F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_t")), "left_semi")
    return out.dropDuplicates(["_i", "_h"]).select("_row.*")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further bits of the same hashes (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _by_text(df: DataFrame, schema: str, make: Callable[[list[bytes]], tuple]) -> DataFrame:
    """df without its last column, a text, and with what `make` says of the text's words."""
    import pyspark.sql.types as T

    new = T.StructType.fromDDL(schema)
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 500):
            made = [make((x or b"").lower().split()) for x in b.column(b.num_columns - 1).to_pylist()]
            more = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *new.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], *new.fields]))


def _tiles(count: list[tuple[int, int, int]], tile: int) -> list[tuple[int, int, int, int]]:
    """band, first and last population count, number of parts: runs of population counts of one band with at most `tile`
    rows; a single population count with more is dealt into parts."""
    out: list[tuple[int, int, int, int]] = []
    held = 0
    for band, p, n in sorted(count):
        if out and out[-1][0] == band and held + n <= tile:
            out[-1], held = (band, out[-1][1], p, 1), held + n
        else:
            out.append((band, p, p, -(-n // tile)))
            held = n
    return out


def near_forests(nodes: DataFrame, radius: int, wide: int, least: float, tile: int) -> DataFrame:
    """u, v: a spanning forest, from each pair of tiles, of the nodes (node, fp, fp2, k) whose fingerprints differ in at
    most `radius` bits, both fingerprints in at most `wide`, and whose counts of shingles k allow a similarity of `least`.

    Bands of k are as wide as `least` allows, so partners lie in the same or the next band; tiles of a band hold runs
    of population counts, and pairs of tiles whose counts differ by more than the radius are skipped.
    """
    spark = nodes.sparkSession
    band = F.floor(F.log("k") / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    dealt = nodes.withColumn("band", band).withColumn("ones", F.bit_count("fp").cast("int"))
    # 65 rows a band at most, and bands grow with the logarithm of the longest text
    tiles = _tiles([tuple(r) for r in dealt.groupBy("band", "ones").count().collect()], tile)
    which = [(b, p, t, parts) for t, (b, low, high, parts) in enumerate(tiles) for p in range(low, high + 1)]
    known = spark.createDataFrame(which, "band int, ones int, t int, parts int")
    dealt = dealt.join(F.broadcast(known), ["band", "ones"]).withColumn("s", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    held = dealt.groupBy("t", "s").agg(F.collect_list(F.struct("node", "fp", "fp2", "k")).alias("rows"))
    of_band: dict[int, list[int]] = {}
    for t, x in enumerate(tiles):
        of_band.setdefault(x[0], []).append(t)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, s, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body, me = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.values.flatten()]).astype(np.int64).tobytes(), (t, s)
                at, low, high, _ = tiles[t]
                for u in (u for near in (at - 1, at, at + 1) for u in of_band.get(near, ())):
                    if max(tiles[u][1] - high, low - tiles[u][2]) <= radius:
                        for other in ((u, part) for part in range(tiles[u][3])):
                            (t1, s1), (t2, s2) = min(me, other), max(me, other)
                            yield pa.RecordBatch.from_pydict({"t1": pa.array([t1], pa.int32()), "s1": pa.array([s1], pa.int32()), "t2": pa.array([t2], pa.int32()), "s2": pa.array([s2], pa.int32()), "first": [me <= other], "rows": [body]})

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.int64).reshape(4, -1) for x in g.sort_values("first", ascending=False)["rows"]]
        parts = [x[:, np.argsort(x[3], kind="stable")] for x in parts]
        same, a, b = len(parts) == 1, parts[0], parts[-1]
        both, shift = a[0] if same else np.concatenate([a[0], b[0]]), 0 if same else a.shape[1]
        fa, fb, parent = a[1].view(np.uint64), b[1].view(np.uint64), np.arange(len(both))
        for at in range(0, a.shape[1], 64):
            upto = min(at + 64, a.shape[1])
            low, high = np.searchsorted(b[3], [int(least * a[3][at]) - 1, int(a[3][upto - 1] / least) + 2])
            low = max(low, at) if same else low
            i, j = np.nonzero(np.bitwise_count(fa[at:upto, None] ^ fb[None, low:high]) <= radius)
            i, j = i + at, j + low
            ok = np.bitwise_count(fa[i] ^ fb[j]).astype(np.int64) + np.bitwise_count((a[2][i] ^ b[2][j]).view(np.uint64)) <= wide
            ok &= np.minimum(a[3][i], b[3][j]) >= least * np.maximum(a[3][i], b[3][j]) - 1e-9
            if same:
                ok &= i < j
            parent = _joined(parent, i[ok], j[ok] + shift)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"u": both[child], "v": both[parent[child]]})

    pairs = held.mapInArrow(pair, "t1 int, s1 int, t2 int, s2 int, first boolean, rows binary")
    return pairs.groupBy("t1", "s1", "t2", "s2").applyInPandas(compare, "u long, v long").distinct()


def exact_links(a: list[np.ndarray], b: list[np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent as places in a, then b) of pairs within a, or between a and b, of sorted sets of
    hashes whose Jaccard similarity reaches `least`. Elements that two sets or more hold become bits."""
    sets = [*a, *(b or [])]
    n, size = len(a), np.array([len(x) for x in sets])
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, number, held = np.unique(every, return_inverse=True, return_counts=True)
    shared = held > 1
    number, of = (np.cumsum(shared) - 1)[number[shared[number]]], of[shared[number]]
    order = np.argsort(number, kind="stable")
    number, of = number[order], of[order]
    common = np.zeros((n, len(sets) - n if b is not None else n), np.int32)
    for at in range(0, int(shared.sum()), 8192):
        s, e = np.searchsorted(number, [at, at + 8192])
        bits = np.zeros((len(sets), min(8192, int(shared.sum()) - at + 63) // 64 * 64), bool)
        bits[of[s:e], number[s:e] - at] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        left, right = words[:n], words[n:] if b is not None else words
        step = max(1, (1 << 21) // max(1, right.size))
        for k in range(0, n, step):
            common[k : k + step] += np.bitwise_count(left[k : k + step, None] & right[None]).sum(2, dtype=np.int32)
    total = size[:n, None] + (size[n:] if b is not None else size)[None]
    i, j = np.nonzero(common >= least * (total - common) - 1e-9)
    parent = _joined(np.arange(len(sets)), i, j + (n if b is not None else 0))
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return child, parent[child]


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, radius: int = 18, wide: int = 32, tile: int = 16384, block: int = 100_000, small: int = 2_000_000) -> DataFrame:
    """The rows of docs with one document of each group of near copies, as near_dedup returns them.

    Near copies share at least `least` of the shingles that either has (Jaccard, `size` words). Texts of the same words
    are one node. The tiled comparison, wide enough for that and with a second fingerprint, joins nodes that may be
    near copies to clusters, returning a forest; within a cluster every pair is counted exactly, again returning a
    forest. Clusters with more than `block` shingles are dealt into blocks that meet pair by pair, small ones share
    tasks, so neither the pairs of a group are emitted nor a group gathered in one task.
    """
    text = F.col(text_col).cast("string").cast("binary").alias("_text")

    def signature(words: list[bytes]) -> tuple:
        import xxhash

        h = np.unique(shingle_hashes(words, size, 42))
        signed = np.array([xxhash.xxh64_intdigest(b" ".join(words), 1), majority(h), majority(_mixed(h))], np.uint64).view(np.int64)
        return *signed.tolist(), len(h)

    base = materialise(_by_text(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), text), "wh long, fp long, fp2 long, k long", signature), "signatures")
    nodes = materialise(base.groupBy("wh").agg(F.min("th").alias("node"), *[F.min(c).alias(c) for c in ("fp", "fp2", "k")]), "nodes")
    joined = components(near_forests(nodes.where("k > 0").select("node", "fp", "fp2", "k"), radius, wide, least, tile))
    member = joined.union(joined.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("cluster"))
    member = member.join(nodes.select("node", "k"), "node")
    blocks = member.groupBy("cluster").agg(F.ceil(F.sum("k") / block).cast("int").alias("blocks"))
    member = materialise(member.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")), "members")
    count, shingles = member.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    units = max(4 * partitions(docs.sparkSession), -(-int(shingles) // block))
    wanted = member.select(F.col("node").alias("th"), "cluster", "blocks", "own")
    if count <= small:  # the size is checked: texts stay where they are
        wanted = F.broadcast(wanted)
    shingled = _by_text(docs.select(F.xxhash64(text_col).alias("th"), text).join(wanted, "th").select("th", "cluster", "blocks", "own", "_text"), "sh binary", lambda w: (np.unique(shingle_hashes(w, size, 42)).tobytes(),))
    sets = materialise(shingled.dropDuplicates(["th"]), "shingles")
    # a cluster in one block goes to a unit shared with others; else a block meets each block of its cluster
    unit = F.struct(F.pmod(F.xxhash64("cluster", F.lit(9)), F.lit(units)).cast("long").alias("of"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("cluster").alias("of"), F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    sent = sets.select("cluster", "th", "sh", "own", F.explode(F.when(F.col("blocks") > 1, meets).otherwise(F.array(unit))).alias("x")).select("x.*", "cluster", "th", "sh", "own")

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        cross = g.i.iloc[0] != g.j.iloc[0]
        for _, c in g.groupby("cluster"):
            c = c.sort_values("own", kind="stable")
            ids, held = c.th.to_numpy(), [np.frombuffer(x, np.uint64) for x in c.sh]
            n = int((c.own == c.own.iloc[0]).sum()) if cross else len(c)
            if n < len(c) or not cross:
                child, parent = exact_links(held[:n], held[n:] if cross else None, least)
                u.append(ids[child])
                v.append(ids[parent])
        return pd.DataFrame({"u": np.concatenate([np.zeros(0, np.int64), *u]), "v": np.concatenate([np.zeros(0, np.int64), *v])})

    roots = components(sent.groupBy("of", "i", "j").applyInPandas(verify, "u long, v long"))
    named = nodes.select("wh", "node").join(roots.withColumnRenamed("u", "node"), "node", "left").select("wh", F.coalesce("v", "node").alias("g"))
    return _firsts(docs, base.join(named, "wh").select("g", "doc_id", "th"), id_col, text_col)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
