"""Substring dedup with a count-min prefilter.

Every task deals its documents into units of a bounded number of words, stores a unit as one row, and makes a
count-min sketch of it: `depth` rows of saturating counters, some 50 to a key, kept as sorted cells since most are
zero. A window's key is the smallest hash of the shorter runs of words inside of it: equal windows have equal keys, so
a key's count is never below its windows', and neighbouring windows share keys, which makes about 0.3 of them. The
sketches are merged by ranges of cells; a window is estimated repeated if the minimum over the rows is two or more,
so none that is repeated is lost. The second pass sends 128-bit hashes of the windows so marked, once per unit, each
with its unit's smallest id, and groups them exactly; what goes back is whether the unit's id is the corpus' smallest.
Of documents with the same words only the one with the smallest id takes part in that; the others go whole. A unit
sends a window once, however often it occurs, and no list of occurrences meets in one task.

A word is removed if a window over it also starts in a document with a smaller id. Nulls: a null text has no
words; rows without id keep all words and remove none. Repeated rows (same id, a tie) don't remove each other's words.
Texts below `size` words are kept. Empty tables give no rows. Very long texts stay whole, in one unit. Extra columns of
any name are ignored: only the id, an integer, and the text are read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import dropped, in_parts, materialise, table

NOTHING = hashlib.sha256(b"").hexdigest()
#: What the first pass writes, what a unit sends, and what it decides.
FIRST = pa.schema([("kind", pa.string()), ("unit", pa.int64()), ("row", pa.int32()), ("range", pa.int32()), ("body", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("place", pa.int32())])
PART = ("kind", "unit", "range", "body")
DONE = ("doc_id", "sha", "n_removed", "kept_sha", "kept_text")
#: Odd multipliers of the window hashes and of the sketch's rows (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ROWS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes per word."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each column of each run of `size` word hashes: polynomials, put together by doubling."""
    out = np.empty((max(0, len(h) - size + 1), h.shape[1]), np.uint64)
    for k, m in enumerate(MULTIPLIERS[: h.shape[1]] if len(out) else ()):
        power, width, acc, have = np.uint64(m), 1, None, 0
        part = h[:, k].copy()
        left = size
        with np.errstate(over="ignore"):
            while left:
                if left & 1:  # the run so far, then this part
                    acc = part if acc is None else acc[: len(part) - have] * power + part[have:]
                    have += width
                left >>= 1
                if left:
                    part = part[: len(part) - width] * power + part[width:]
                    power, width = power * power, width * 2
        x = acc[: len(out)]
        out[:, k] = x ^ (x >> np.uint64(29))
        with np.errstate(over="ignore"):
            out[:, k] *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] ^= out[:, k] >> np.uint64(32)
    return out


def keys(h: np.ndarray, size: int) -> np.ndarray:
    """Of each run of `size` word hashes: the smallest hash of the runs of five eighths of that inside of it."""
    short = max(1, size * 5 // 8)
    inner, n = windows(h[:, :1], short)[:, 0], max(0, len(h) - size + 1)
    out = inner[:n]
    for k in range(1, size - short + 1):
        out = np.minimum(out, inner[k : k + n])
    return out


def squeezed(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(bytes(planes))


def unsqueezed(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(sorted_cells: np.ndarray) -> bytes:
    return squeezed(np.diff(sorted_cells, prepend=np.uint64(0)))


def among(a: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of a are in a sorted array."""
    at = np.searchsorted(of, a)
    at[at == len(of)] = 0
    return of[at] == a if len(of) else np.zeros(len(a), bool)


def put(x: object, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(x, 5))


def got(b: bytes) -> object:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def framed(rows: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    """Of objects, so that a frame without rows converts like any other."""
    return pd.DataFrame(rows, columns=list(names), dtype=object)


class Plan:
    """The sketch's width and the number of ranges for a corpus of at most so many words."""

    def __init__(self, words: int, unit_words: int, size: int, depth: int):
        self.size, self.depth, self.unit_words = size, depth, unit_words
        self.bits = min(62, max(20, int(16 * max(words, 1) - 1).bit_length()))
        self.ranges = max(1, -(-words // (8 * unit_words)))

    def cells(self, key: np.ndarray, row: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key * np.uint64(ROWS[row])
        return (x ^ (x >> np.uint64(31))) * np.uint64(MULTIPLIERS[1]) >> np.uint64(64 - self.bits)

    def pieces(self, top: np.ndarray, bits: int, *arrays: np.ndarray) -> Iterator[tuple]:
        """The parts of arrays, sorted like `top`, that fall into each range of its values."""
        edges = [(r << bits) // self.ranges for r in range(1, self.ranges)]
        cuts = [0, *np.searchsorted(top, np.array(edges, np.uint64)).tolist(), len(top)]
        for r, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if e > s:
                yield (r, *[a[s:e] for a in arrays])

    def sketch(self, of: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        """row, range, cells of a unit's texts, given each one's keys: which counters aren't zero, and which are two or more."""
        key = np.concatenate([np.unique(x) for x in of])
        key.sort()
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count, key = np.diff(np.append(edge, len(key))), key[edge]  # in how many texts of the unit
        for row in range(self.depth):
            cell = self.cells(key, row)
            order = np.argsort(cell)
            cell = cell[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            many, cell = np.add.reduceat(count[order], first) > 1, cell[first]
            for r, c, m in self.pieces(cell, self.bits, cell, many):
                yield row, r, put((gaps(c), np.packbits(m).tobytes()))


class Unit:
    """Documents of a task until they hold enough words."""

    def __init__(self, plan: Plan, part: int):
        self.plan, self.number, self.words = plan, part << 32, 0
        self.ids: list[int] = []
        self.shas: list[bytes] = []
        self.texts: list[bytes] = []
        self.keys: list[np.ndarray] = []

    def add(self, i: int, sha: bytes, text: bytes, words: list[bytes]) -> int:
        self.ids.append(i)
        self.shas.append(sha)
        self.texts.append(text)
        self.keys.append(keys(word_hashes(words), self.plan.size))
        self.words += len(words)
        return len(self.ids) - 1

    def rows(self) -> list[dict]:
        """The unit and its sketch; the next unit begins."""
        if not self.ids:
            return []
        out = [{"kind": "text", "unit": self.number, "body": put((self.ids, self.shas, self.texts), 3)}]
        out += [{"kind": "cells", "unit": self.number, "row": row, "range": r, "body": body} for row, r, body in self.plan.sketch(self.keys)]
        self.number, self.words, self.ids, self.shas, self.texts, self.keys = self.number + 1, 0, [], [], [], []
        return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, unit_words: int = 1_000_000, depth: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: a row per document. kept_text is set only where a part was removed."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    text = F.col(text_col).cast("string").cast("binary")
    # words and the space behind them take two bytes at least
    most = int(docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]) // 2
    plan = Plan(most, unit_words, size, depth)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(plan, TaskContext.get().partitionId())
        for b in in_parts(batches, 100):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or b"").split()
                sha = hashlib.sha256(b" ".join(words)).digest()
                held = i is not None and len(words) >= size
                rows.append({"kind": "doc", "unit": unit.number, "doc_id": i, "n_words": len(words), "sha": sha, "place": unit.add(i, sha, t, words) if held else None})
                if unit.words >= unit_words:
                    rows += unit.rows()
            yield pa.RecordBatch.from_pylist(rows, FIRST)
        yield pa.RecordBatch.from_pylist(unit.rows(), FIRST)

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(first, "kind string, unit long, row int, range int, body binary, doc_id long, n_words long, sha binary, place int")
    made = materialise(made, "units", "none", partition_by="kind")
    seen = made.where("kind = 'doc'").select("doc_id", "n_words", "sha", "unit", "place")
    firsts = seen.where("place is not null").groupBy("sha").agg(F.min(F.struct("doc_id", "unit", "place")).alias("b")).select("sha", F.col("b.doc_id").alias("first"), "b.unit", "b.place")
    firsts = materialise(firsts, "firsts")
    texts = made.where("kind = 'text'").select("unit", "body")

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for body in g.body:
            steps, many = got(body)
            c = np.cumsum(unsqueezed(steps, np.uint64), dtype=np.uint64)
            parts.append((c, np.unpackbits(np.frombuffer(many, np.uint8), count=len(c)).astype(bool)))
        every = np.concatenate([c for c, _ in parts] + [c[m] for c, m in parts])
        every.sort()
        again = np.unique(every[1:][every[1:] == every[:-1]])
        hits = [c[np.isin(c, again, assume_unique=True)] for c, _ in parts]
        return pd.DataFrame({"unit": g.unit, "row": g.row, "range": g.range, "body": [gaps(c) if len(c) else None for c in hits]})

    # counters of two or more, as far as a unit has them; and the places of its documents that take part
    marks = made.where("kind = 'cells'").select("unit", "row", "range", "body").groupBy("row", "range").applyInPandas(merged, "unit long, row int, range int, body binary").where("body is not null")
    own = firsts.groupBy("unit").agg(F.sort_array(F.collect_list("place")).alias("places"))  # a unit's documents at most
    back = marks.withColumn("places", F.lit(None).cast("array<int>")).unionByName(own.select("unit", F.lit(-1).alias("row"), F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("body"), "places"))

    def exact(key: tuple, unit: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        empty, mine = framed([], PART), back[back.row == -1]
        if not len(unit) or not len(mine) or len(mine) == len(back):
            return empty
        ids, shas, texts = got(unit.body.iloc[0])
        back = back.sort_values(["row", "range"])
        marked = [np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(unsqueezed(b, np.uint64), dtype=np.uint64) for b in back.body[back.row == row]]]) for row in range(depth)]
        hs, of, at = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        places = sorted(mine.places.iloc[0], key=lambda p: ids[p])  # texts are in order of id
        for k, p in enumerate(places):
            h = word_hashes(texts[p].split())
            own, hit = keys(h, size), np.ones(max(0, len(h) - size + 1), bool)
            for row in range(depth):  # the minimum over the rows is two or more
                hit &= among(plan.cells(own, row), marked[row])
            hit = np.flatnonzero(hit)
            if len(hit):
                hs.append(windows(h, size)[hit])
                of.append(np.full(len(hit), k, np.int32))
                at.append(hit.astype(np.int32))
        h, of, at = np.concatenate(hs), np.concatenate(of), np.concatenate(at)
        if not len(h):
            return empty
        order = np.lexsort((of, h[:, 1], h[:, 0]))
        h, of, at = h[order], of[order], at[order]
        new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
        edge, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.array([ids[p] for p in places], np.int64)[of[edge]]
        rest, number = np.unique(of, return_inverse=True)
        rest = [places[k] for k in rest]
        number, back_order = number.astype(np.int32), np.lexsort((at, number))  # by text and place, which compresses better
        rows = [("text", int(key[0]), -1, put(([(ids[p], shas[p]) for p in rest], [texts[p] for p in rest], squeezed(number[back_order]), squeezed(at[back_order]), squeezed(group[back_order].astype(np.int32)), squeezed(least)), 3))]
        h = h[edge]
        for r, a, b, i in plan.pieces(h[:, 0], 64, h[:, 0], h[:, 1], least):
            rows.append(("hashes", int(key[0]), r, put((squeezed(np.ascontiguousarray(a)), squeezed(np.ascontiguousarray(b)), squeezed(i)))))
        return framed(rows, PART)

    chosen = texts.groupBy("unit").cogroup(back.groupBy("unit")).applyInPandas(exact, "kind string, unit long, range int, body binary")
    chosen = materialise(chosen, "windows", "none", partition_by="kind")
    seen = materialise(seen.select("doc_id", "n_words", "sha"), "words")
    dropped(made)

    def smallest(g: pd.DataFrame) -> pd.DataFrame:
        parts = [tuple(unsqueezed(x, k) for x, k in zip(got(b), (np.uint64, np.uint64, np.int64), strict=True)) for b in g.body]
        a, b, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((i, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        least = i[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        first = np.empty(len(i), bool)
        first[order] = i[order] == least
        bits = np.split(first, np.cumsum([len(p[0]) for p in parts])[:-1])
        return pd.DataFrame({"unit": g.unit, "range": g.range, "size": [len(x) for x in bits], "bits": [put(np.packbits(x).tobytes()) for x in bits]})

    answers = chosen.where("kind = 'hashes'").select("unit", "range", "body").groupBy("range").applyInPandas(smallest, "unit long, range int, size int, bits binary")

    def removed(key: tuple, own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return framed([], DONE)
        names, texts, of, at, group, least = got(own.body.iloc[0])
        of, at, group, least = unsqueezed(of, np.int32), unsqueezed(at, np.int32), unsqueezed(group, np.int32), unsqueezed(least, np.int64)
        back = back.sort_values("range")
        first = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(got(b), np.uint8), count=n).astype(bool) for n, b in zip(back["size"], back.bits, strict=True)]])
        ids = np.array([i for i, _ in names], np.int64)
        out = (ids[of] > least[group]) | ~first[group]
        of, at = of[out], at[out]
        rows = []
        for k in np.unique(of).tolist():
            words = texts[k].split()
            s, e = np.searchsorted(of, [k, k + 1])
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, at[s:e], 1)
            np.add.at(cover, at[s:e] + size, -1)
            keep = np.cumsum(cover)[:-1] == 0
            kept = b" ".join([w for w, x in zip(words, keep.tolist(), strict=True) if x])
            rows.append((*names[k], int((~keep).sum()), hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace")))
        return framed(rows, DONE)

    last = chosen.where("kind = 'text'").select("unit", "body").groupBy("unit").cogroup(answers.groupBy("unit")).applyInPandas(removed, "doc_id long, sha binary, n_removed long, kept_sha binary, kept_text string")
    last = materialise(last, "removed")
    dropped(chosen)
    full = seen.join(firsts.select("sha", "first"), "sha", "left")
    copy = F.col("doc_id") > F.col("first")
    part = last.select(F.col("doc_id").alias("_i"), F.col("sha").alias("_s"), "n_removed", "kept_sha", "kept_text")
    out = full.join(part, (F.col("doc_id") == F.col("_i")) & (F.col("sha") == F.col("_s")), "left")
    kept = F.lower(F.hex(F.coalesce("kept_sha", "sha")))
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(NOTHING)).otherwise(kept).alias("kept_sha256"), F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
