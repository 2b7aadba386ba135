"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document's features are its words and their character n-grams of 3 and 4 bytes, hashed to learned vectors,
and three markers: a word repeated at once, a word pair seen before, a line seen before. The vectors are
averaged and a softmax gives the label. The average is linear in the vectors, so a trained model is folded to
one number per bucket, and a word's sum is computed once and remembered (a bounded memory per worker).

Training takes at most `rows` labelled documents, those with the smallest hash of the id, one text for an id and of
a text its `features` most frequent buckets (documented bounds: the classifier needs no more, and the driver gets at
most rows x features x 6 bytes); all texts are read and scored whole. The fold crc32(id) mod 4 = 2 never trains.

Nulls: a null text is empty and scores as the label's share; null labels are ignored; a document with several
labels takes their rounded mean (a tie is label 1); a null id is scored, held out as false. Repeated rows are scored
again; of different texts with one id the one with the smallest hash trains. At exactly `least` a document is
predicted 1. Without training rows of both labels each score is their share (0.5 without any). Empty tables give no
rows. Extra columns of any name are ignored by `classify` and kept by `accepted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import in_parts, rows_of, table

BUCKETS = 1 << 14
#: Buckets after the hashed ones, and how often a marker counts.
MARKERS, WEIGHT = 3, 12
CACHE = 300_000


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, and the place of each word's first one; a word of n bytes has 2 n."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    begin = np.cumsum(length + 2) - length - 2
    of = np.repeat(np.arange(len(words)), length + 2)
    three = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * np.uint32(2654435761)
    four = (raw[:-3] * 29791 + raw[1:-2] * 961 + raw[2:-1] * 31 + raw[3:]) * np.uint32(2246822519)
    start = np.cumsum(2 * length) - 2 * length
    out = np.empty(int(2 * length.sum()), np.int32)
    out[start] = [zlib.crc32(w) & (BUCKETS - 1) for w in words]
    for ids, n, shift in ((three, 3, 1), (four, 4, None)):
        at = np.flatnonzero(of[: len(ids)] == of[n - 1 :])
        w = of[at]
        place = start[w] + at - begin[w] + (shift if shift is not None else 1 + length[w])
        out[place] = (ids[at] >> np.uint32(18)).astype(np.int32)
    return out, start


def markers(words: list[bytes], text: bytes) -> list[int]:
    """How often a word repeats at once, a word pair was seen before, a line was seen before."""
    lines = [x for x in text.split(b"\n") if x]
    return [sum(map(eq, words, words[1:])), max(0, len(words) - 1 - len(set(zip(words, words[1:], strict=False)))), len(lines) - len(set(lines))]


def counted(text: bytes, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent buckets and how often the text has each, for training; markers always."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    count = np.bincount(grams(words)[0], minlength=BUCKETS + MARKERS)
    count[BUCKETS:] = [WEIGHT * m for m in markers(words, text)]
    at = np.flatnonzero(count)
    if len(at) > features:
        at = np.sort(at[np.lexsort((at, -count[at], at < BUCKETS))[:features]])
    return at.astype(np.int32), count[at].astype(np.float32)


def trained(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 12, epochs: int = 8, batch: int = 64, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """The folded model: a number per bucket, and a constant. log-odds of label 1 = mean of the numbers + constant."""
    share = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 0.01, 0.99)) if len(labels) else 0.5
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS + MARKERS), float(bias[1])
    e = rng.normal(0, 0.1, (BUCKETS + MARKERS, dims)).astype(np.float32)
    w = rng.normal(0, 0.5, (dims, 2)).astype(np.float32)
    ge, gw = np.full(len(e), 1e-6, np.float32), np.full_like(w, 1e-6)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            x = np.zeros((len(at), len(e)), np.float32)
            for i, k in enumerate(at.tolist()):
                ids, n = rows[k]
                x[i, ids] = n / max(n.sum(), 1)
            z = x @ e
            p = z @ w + bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p /= len(at)
            dw, de = z.T @ p, x.T @ (p @ w.T)
            gw += dw * dw
            ge += (de * de).mean(1)
            w -= rate * 0.2 * dw / np.sqrt(gw)
            e -= rate * de / np.sqrt(ge)[:, None]
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts with a folded model."""

    def __init__(self, model: np.ndarray, bias: float):
        self.model, self.bias, self.known = model, bias, {}

    def _learn(self, words: list[bytes]) -> None:
        ids, start = grams(words)
        self.known.update(zip(words, np.add.reduceat(self.model[ids], start).tolist(), strict=True))

    def score(self, text: bytes) -> float:
        words = text.split()
        x = self.bias
        if words:
            try:
                total = sum([self.known[w] for w in words])
            except KeyError:
                fresh = {w for w in words if w not in self.known}
                if len(self.known) + len(fresh) > CACHE:
                    self.known.clear()
                    fresh = set(words)
                self._learn(list(fresh))
                total = sum([self.known[w] for w in words])
            marks = markers(words, text)
            n = 2 * sum(map(len, words)) + WEIGHT * sum(marks)
            total += WEIGHT * sum(m * v for m, v in zip(marks, self.model[BUCKETS:].tolist(), strict=True))
            x += total / n
        return 1 / (1 + float(np.exp(-np.clip(x, -500, 500))))


def held_out(id_col):
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 5000, features: int = 4096) -> tuple[np.ndarray, float]:
    """A model from at most `rows` labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 100):
            found = [counted(x or b"", features) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary())], names=["id", "label", "ids", "n"])

    picked = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").cast("binary").alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_id"))
    picked = picked.groupBy("_id").agg(F.min_by(F.struct("_label", "_t"), F.struct(F.xxhash64("_t"), "_t")).alias("x")).select(F.col("_id").cast("string").alias("id"), "x._label", "x._t")
    got = sorted(picked.mapInArrow(counts, "id string, label int, ids binary, n binary").collect(), key=lambda r: r["id"])  # a row per id, at most `rows`
    return trained([(np.frombuffer(r["ids"], np.uint16).astype(np.int32), np.frombuffer(r["n"], np.float32)) for r in got], np.array([r["label"] for r in got], np.int64))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list, text_col: str = "text") -> DataFrame:
    """The columns `keep` and score."""
    df = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*model)
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s.score(x or b"") for x in b.column(b.num_columns - 1).to_pylist()], pa.float64())], names=[*b.schema.names[:-1], "score"])

    return df.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", least: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document."""
    out = scored(docs, fit(docs, labels, id_col, **how), [F.col(id_col).alias("doc_id")])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    out = scored(docs, fit(docs, labels, id_col, text_col), [rows_of(docs)], text_col)
    return out.where(F.col("score") >= least).select("_row.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
