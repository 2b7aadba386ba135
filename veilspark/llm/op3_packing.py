"""Packing: concatenate and cut, by two passes of prefix sums.

The first pass tokenizes once and writes each document's ids (two bytes each where the vocabulary allows) with
its offset inside its task's run; the tasks' totals, a row per task, give each run's global offset. The second
pass cuts at fixed windows of `width` ids: a document that crosses a border gives a record on either side.
Sequences are full but for the last one.

Nulls: a null text is empty and gives the end id alone; a null id stays null. Repeated rows are packed again.
Empty tables give no rows. Texts of any length are tokenized whole. There are no ties: documents follow one another as
the tasks read them. Extra columns of any name are ignored: only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import in_parts, materialise, table

#: Kept per Python worker: tokenizer and ids of words seen, by vocabulary file.
_STATE: dict = {}
CACHE = 500_000
#: Python splits at the first four, the vocabulary's rule does not; the last two change with their neighbours when
#: lower-cased, or get longer. A text with one of them is encoded as a whole.
ODD = "\x1c\x1d\x1e\x1f\u03a3\u0130"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next after 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose pieces never cross white space, with a bounded memory of words.

    White space is dropped and letters are lower-cased by the vocabulary's own rules, so the ids of a text are
    those of its lower-cased words, one after another. A word of letters alone is a single piece and goes to the
    merge rules at once; with one point or comma behind it, it is two pieces; all others take the full way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.merge, self.kind = self.t.model.tokenize, np.uint32 if self.t.get_vocab_size() > 1 << 16 else np.uint16
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.known: dict[str, bytes] = {}

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._raw(self.t.encode(text, add_special_tokens=False).ids)

    def _word(self, w: str) -> bytes:
        if w.isalpha():
            spelled = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            return self._raw([x.id for x in self.merge(spelled)])
        if w[-1] in ".," and w[:-1].isalpha():
            return self._of(w[:-1]) + self._of(w[-1])
        return self._whole(w)

    def _of(self, w: str) -> bytes:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[w] = self._word(w)
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            text = text or ""
            if any(c in text for c in ODD) or not is_normalized("NFC", text):
                out.append(self._whole(text))
                continue
            words, known = text.lower().split(), self.known
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                out.append(b"".join(map(self._of, words)))
        return out


def tokenizer(path: str | None) -> WordTokenizer:
    if path not in _STATE:
        import public_tokenizers

        _STATE[path] = WordTokenizer(path or public_tokenizers.path("word_bpe_49k.json"))
    return _STATE[path]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, at = tokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], t.kind).tobytes()
        for b in in_parts(batches, 256):
            ids = [x + end for x in t.ids(b.column(1).to_pylist())]
            n = np.fromiter((len(x) // len(end) for x in ids), np.int64, len(ids))
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(before), pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), t.kind is np.uint32))], names=["doc_id", "ids", "n", "before", "part", "wide"])

    kind = docs.schema[id_col].dataType.simpleString()
    tokens = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, ids binary, n long, before long, part int, wide boolean"), "tokens")
    totals = sorted((r["part"], r["total"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())  # a row per task
    base, at = {}, 0
    for part, total in totals:
        base[part], at = at, at + total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 256):
            part = b.column(4).to_numpy(zero_copy_only=False)
            n, first = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False) + np.array([base[p] for p in part.tolist()], np.int64)
            rows, starts, crcs = [], [], []
            for k, (ids, wide) in enumerate(zip(b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True)):
                raw = ids if wide else np.frombuffer(ids, np.uint16).astype("<u4").tobytes()
                edges = [0, *range(int(width - first[k] % width), int(n[k]), width), int(n[k])]
                rows += [k] * (len(edges) - 1)
                starts += edges[:-1]
                crcs += [zlib.crc32(memoryview(raw)[4 * s : 4 * e]) for s, e in zip(edges, edges[1:], strict=False)]
            rows, starts = np.array(rows, np.int64), np.array(starts, np.int64)
            last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
            ends = np.where(last, n[rows], np.roll(starts, -1)) if len(rows) else starts
            place = first[rows] + starts
            out = [b.column(0).take(pa.array(rows)), pa.array(starts), pa.array(ends - starts), pa.array(np.array(crcs, np.int64)), pa.array(n[rows]), pa.array(place // width), pa.array(place % width)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.select("doc_id", "ids", "n", "before", "part", "wide").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
