"""Secret scans: base patterns, and a character convolutional network over every other candidate and its context.

Findings of the base patterns always stay. Any other run of 16 or more token characters that has a digit and a
letter is a candidate, as is what base findings leave of a run, and the whole token of which a finding is only a
part (the rest of a mixed secret). The network scores each part of a candidate between separators by itself, and
the candidate as a whole, with what stands before and after; long ones by windows over all their characters, of
which the highest probability counts. Of overlapping parts that reach the threshold the most probable is reported.

It is trained in numpy on labelled findings: base findings of the corpus and generated secrets of other formats
(label 1); candidates of the corpus that are plain by rule - words, short numbers and separators - and generated
addresses, versions, paths and words (label 0), set into contexts of the corpus. Values are split by hash: half
train, a quarter calibrates the output (Platt) and sets the threshold, which is the highest that keeps the required
recall there, and a quarter that took no part in either gives `held_out_recall` and `held_out_false`.

Nothing of this is a sample: each different labelled window of all documents (values in their context, so that a copy
counts once) takes part, and is the context of generated ones. Windows are dealt by hash into shards; in each of
`EPOCHS` rounds a task goes once over its shard, from the network that is the mean of all shards of the round before.
Outputs lie on a grid, so that counts by output, summed over the shards, calibrate and examine exactly. The result
depends on the set of windows alone, and not on how rows are dealt to tasks.

Every candidate of every whole text is scored. Nulls: a null text is empty; a null id is kept. Repeated
rows are scanned again. Texts and candidates of any length are read whole. Ties: of equally probable overlapping
parts the longer, then the first is reported. Without training findings generated ones train alone. Empty tables
give no rows. Extra columns of any name are ignored by `scan` and kept by `redacted`.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import dropped, in_parts, materialise, table

#: Base kinds in the order in which equal starts are listed; the network's findings come last (fixed values).
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: A part of a candidate between separators, and what separates.
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
SEPARATOR = re.compile(r"[/.=]")
#: Words, numbers of up to four digits and separators: no secret.
PLAIN = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}(?:[/_.=+-]+|$))+")
WITHIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_-"
BEFORE, INSIDE, AFTER = 24, 56, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Labelled windows of the corpus in a shard, about; generated ones of a shard at least, and for each of the corpus.
SHARD, EXTRA, EACH = 2000, 8000, 4
#: Rounds of training; steps of the output for a unit of log odds, and its bound.
EPOCHS, GRID, BOUND = 12, 1024, 50


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the base findings."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def merged(base: list[tuple[int, int, int]]) -> list[list[int]]:
    """Base findings put together, by start: start, end, whether an assignment is among them."""
    taken: list[list[int]] = []
    for b, k, e in base:
        if taken and b <= taken[-1][1]:
            taken[-1][1:] = max(taken[-1][1], e), taken[-1][2] or k == 0
        else:
            taken.append([b, e, k == 0])
    return taken


def scorable(run: str) -> bool:
    return len(run) >= 16 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def runs(text: str, taken: list[list[int]]) -> Iterator[tuple[int, int, list[list[int]]]]:
    """Runs of token characters, and the base findings that each touches."""
    starts, ends = [x[0] for x in taken], [x[1] for x in taken]
    for m in CANDIDATE.finditer(text):
        yield m.start(), m.end(), taken[bisect_right(ends, m.start()) : bisect_left(starts, m.end())]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Further runs that may be secrets, and what base findings leave of others; none touches a base finding."""
    out = []
    for s, e, cuts in runs(text, merged(base)):
        for b, upto, _ in [*cuts, [e, e, False]]:
            if scorable(text[s:b]):
                out.append((s, b))
            s = upto
    return out


def around(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of which a base finding, no assignment, is only a part."""
    out = []
    for s, e, cuts in runs(text, merged(base)):
        for k, (b, upto, assigned) in enumerate(cuts):
            before, after = text[s:b], text[upto : cuts[k + 1][0] if k + 1 < len(cuts) else e]
            left, right = len(before) - len(before.rstrip(WITHIN)), len(after) - len(after.lstrip(WITHIN))
            if not assigned and left + right and scorable(text[b - left : upto + right]):
                out.append((b - left, upto + right))
            s = upto
    return out


def window(text: str, s: int, e: int) -> bytes:
    """What the network sees: characters before, the part from s to e or its first ones, characters after, a byte each."""
    e = min(e, s + INSIDE)
    seen = text[max(0, s - BEFORE) : s].rjust(BEFORE, "\0") + text[s:e].ljust(INSIDE, "\0") + text[e : e + AFTER].ljust(AFTER, "\0")
    return bytes(o if (o := ord(c)) < 127 else 127 for c in seen)


def steps(s: int, e: int) -> list[tuple[int, int]]:
    """Windows over all of s to e, half overlapping."""
    return [(s, e)] if e - s <= INSIDE else [(p, p + INSIDE) for p in (*range(s, e - INSIDE, INSIDE // 2), e - INSIDE)]


def pieces(text: str, s: int, e: int) -> Iterator[tuple[int, int, bytes]]:
    """What of a candidate is scored: start, end, a window of it. Its parts between separators; the whole, if it is
    short; else each window that no part holds, rounded out to separators."""
    parts = [(m.start(), m.end()) for m in PART.finditer(text, s, e)]
    for a, b in parts:
        yield from ((a, b, window(text, *w)) for w in steps(a, b))
    if parts == [(s, e)]:
        return
    edges = [s, *(m.end() for m in SEPARATOR.finditer(text, s, e)), e] if e - s > INSIDE else [s, e]
    for a, b in steps(s, e):
        if e - s <= INSIDE or not any(x <= a and b <= y for x, y in parts):
            first, last = edges[bisect_right(edges, a) - 1], edges[bisect_left(edges, b)]
            yield first, last if last == e else last - 1, window(text, a, b)


def chosen(scored: list[tuple[int, int, float]], threshold: float) -> list[tuple[int, int]]:
    """Of the parts that reach the threshold the most probable one, then the next that overlaps none chosen, and so on."""
    best: dict[tuple[int, int], float] = {}
    for s, e, q in scored:
        if q >= threshold:
            best[s, e] = max(q, best.get((s, e), 0.0))
    starts: list[int] = []
    out: list[tuple[int, int]] = []
    for s, e in sorted(best, key=lambda x: (-best[x], x[0] - x[1], x[0])):
        k = bisect_left(starts, s)
        if (k == len(out) or e <= out[k][0]) and (k == 0 or out[k - 1][1] <= s):
            starts.insert(k, s)
            out.insert(k, (s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


class CharNet:
    """Embedding, one convolution, maximum over places, a dense layer, a sigmoid."""

    def __init__(self, seed: int = 11, dims: int = 8, span: int = 5, filters: int = 32):
        r = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "emb": r.normal(0, 0.3, (128, dims)), "conv": r.normal(0, 0.2, (span * (dims + 1), filters)), "cb": np.zeros(filters),
            "dense": r.normal(0, 0.2, (2 * filters, 16)), "db": np.zeros(16), "out": r.normal(0, 0.3, (16, 1)), "ob": np.zeros(1),
        }
        self.p = {k: w.astype(np.float32) for k, w in self.p.items()}
        self.m, self.v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        self.t = 0
        self.scale, self.shift, self.threshold, self.recall, self.false = 1.0, 0.0, 0.5, 0.0, 0.0
        self.inside = np.zeros(WIDTH, np.float32)
        self.inside[BEFORE : BEFORE + INSIDE] = 1

    def _forward(self, x: np.ndarray) -> tuple:
        p, n = self.p, WIDTH - self.span + 1
        e = np.concatenate([p["emb"][x], np.broadcast_to(self.inside[None, :, None], (*x.shape, 1))], 2)
        cols = np.concatenate([e[:, k : k + n] for k in range(self.span)], 2)
        a = cols @ p["conv"] + p["cb"]
        parts = (a[:, : BEFORE - 2], a[:, BEFORE - 2 :])  # the context before, and the rest
        at = [z.argmax(1) for z in parts]
        top = np.concatenate([np.take_along_axis(z, i[:, None], 1)[:, 0] for z, i in zip(parts, at, strict=True)], 1)
        h0 = np.maximum(top, 0)
        h1 = np.maximum(h0 @ p["dense"] + p["db"], 0)
        return (h1 @ p["out"] + p["ob"])[:, 0], (cols, at, top, h0, h1)

    def epoch(self, x: np.ndarray, y: np.ndarray, r: int, seed: int, batch: int = 64, rate: float = 0.005) -> None:
        """Once over the windows, in their r-th order, by Adam."""
        letters, m, v, orders = np.eye(128, dtype=np.float32), self.m, self.v, np.random.default_rng(seed)
        order = [orders.permutation(len(x)) for _ in range(r + 1)][r]
        for at in np.array_split(order, max(1, len(x) // batch)):
            z, (cols, tops, top, h0, h1) = self._forward(x[at])
            d = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[at])[:, None] / len(at)).astype(np.float32)
            g = {"out": h1.T @ d, "ob": d.sum(0)}
            d1 = (d @ self.p["out"].T) * (h1 > 0)
            g |= {"dense": h0.T @ d1, "db": d1.sum(0)}
            d0 = (d1 @ self.p["dense"].T) * (top > 0)
            f, rows = len(self.p["cb"]), np.arange(len(at))[:, None]
            da = np.zeros((*cols.shape[:2], f), np.float32)
            for k, (i, off) in enumerate(zip(tops, (0, BEFORE - 2), strict=True)):
                da[rows, i + off, np.arange(f)[None]] += d0[:, k * f : (k + 1) * f]
            g |= {"conv": np.tensordot(cols, da, ((0, 1), (0, 1))), "cb": da.sum((0, 1))}
            dc = (da @ self.p["conv"].T).reshape(*cols.shape[:2], self.span, -1)[..., :-1]
            de = np.zeros((len(at), WIDTH, dc.shape[3]), np.float32)  # each character's gradient over the places it takes
            for k in range(self.span):
                de[:, k : k + cols.shape[1]] += dc[:, :, k]
            ge = letters[x[at].ravel()].T @ de.reshape(-1, dc.shape[3])
            g["emb"], self.t = ge, self.t + 1
            for k, w in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w -= rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(v[k] / (1 - 0.999**self.t)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([w.ravel() for of in (self.p, self.m, self.v) for w in of.values()]).astype(np.float32)

    def mean(self, states: list[tuple[int, int, np.ndarray]]) -> None:
        """Becomes the mean of networks: how many windows each has seen, its steps, its state."""
        flat, at = sum(n * w.astype(float) for n, _, w in states) / sum(n for n, _, _ in states), 0
        for of in (self.p, self.m, self.v):
            for k, w in of.items():
                of[k], at = flat[at : at + w.size].reshape(w.shape).astype(np.float32), at + w.size
        self.t = max(t for _, t, _ in states)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration, as steps of the grid."""
        out = [np.rint(np.clip(self._forward(x[k : k + 512])[0], -BOUND, BOUND) * GRID).astype(np.int64) for k in range(0, len(x), 512)]
        return np.concatenate([np.zeros(0, np.int64), *out])

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt's logistic regression of the label on the output, and the highest threshold that keeps the recall;
        n windows have output z and label y."""
        at, share, a, b = z / GRID / 4, n / n.sum(), 1.0, 0.0
        for _ in range(300):
            q = 1 / (1 + np.exp(-np.clip(a * at + b, -50, 50)))
            a, b = a - 0.5 * float(((q - y) * at * share).sum()), b - 0.5 * float(((q - y) * share).sum())
        self.scale, self.shift = a / 4, b
        order = np.argsort(z[y == 1], kind="stable")
        upto = np.cumsum(n[y == 1][order])
        self.threshold = float(self._calibrated(z[y == 1][order][[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]])[0])

    def examined(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Recall, and the share of harmless ones found, on windows that neither trained nor calibrated."""
        hit = (self._calibrated(z) >= self.threshold) * n
        self.recall, self.false = (float(hit[y == k].sum() / n[y == k].sum()) for k in (1, 0))

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (z / GRID) + self.shift, -50, 50)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.outputs(x))


def as_rows(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)


UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ANY = UPPER + LOWER + DIGIT
#: Formats of secrets: what is said literally, and how many characters of which alphabet follow.
FORMATS = (
    (("ghp_", 36, ANY),), (("sk-", 40, ANY),), (("xoxb-", 11, DIGIT), ("-", 24, ANY)), (("", 40, ANY + "+/"),), (("", 32, "0123456789ABCDEF"),),
    (("AKIA", 16, UPPER + DIGIT),), (("", 40, "0123456789abcdef"),), (("eyJ", 33, ANY), (".", 40, ANY)), (("", 22, ANY),), (("sk_live_", 24, ANY),), (("AIza", 35, ANY + "_-"),),
)


class Maker:
    """Secrets of known formats, and harmless look-alikes."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[k] for k in self.r.integers(len(alphabet), size=n))

    def number(self, n: int) -> int:
        return int(self.r.integers(n))

    def word(self) -> str:
        w = self.pick(LOWER, 2 + self.number(9))
        return (w, w, w, w.capitalize(), w.upper())[self.number(5)]

    def secret(self, kind: int | None = None) -> str:
        return "".join(said + self.pick(alphabet, n) for said, n, alphabet in FORMATS[self.number(len(FORMATS)) if kind is None else kind])

    def plain(self) -> str:
        """Words and short numbers between separators: addresses, paths, names, versions, dates."""
        kind = self.number(4)
        if kind == 0:
            return f"20{10 + self.number(20)}-0{1 + self.number(9)}-{10 + self.number(18)}T{10 + self.number(14)}"
        separators = ("/", "./", "-", "_", ".", "/_-.")[self.number(6)]
        out = ""
        while len(out) < 16 or self.number(5) > 1 and len(out) < INSIDE:
            out += self.word() + (str(self.number(10 ** (1 + self.number(4)))) if self.number(3) == 0 else "") + separators[self.number(len(separators))]
        return out[:-1] if kind > 1 else out + self.word()


def generated(contexts: list[bytes], n: int, seed: int = 13) -> tuple[list[bytes], list[int], list[str]]:
    """Windows of findings (1) and of harmless look-alikes (0), set into contexts, and the values that decide the split."""
    make = Maker(seed)
    prose = lambda: " ".join(make.word() for _ in range(WIDTH // 3)).encode()[:WIDTH]
    windows, labels, values = [], [], []
    for k in range(n):
        pair, label = divmod(k, 2)
        # three of five pairs stand in contexts of the corpus, in turn: EACH a context, all serve
        context = contexts[(pair // 5 * 3 + pair % 5) % len(contexts)] if contexts and pair % 5 < 3 else prose() if make.number(5) else bytes(WIDTH)
        own = make.secret() if label else make.plain()
        value, before, after = own, context[:BEFORE], context[-AFTER:]
        if label and make.number(10) < 3 or not label and make.number(20) == 0:
            lead = (b"key: ", b"SECRET=", b'token = "', b"password=", b"auth ")[make.number(5)]
            before = (before + lead)[-BEFORE:]
        elif make.number(5) < 2:  # in a longer run, as a part of its own or met by a window that begins before it
            run, lead = make.plain() + "/", make.number(2) * make.number(INSIDE // 2)
            value, before = (run[-lead:] if lead else "") + own, run[: len(run) - lead].encode()[-BEFORE:].rjust(BEFORE, b"\0")
            after = ("/" + make.plain()).encode()[:AFTER].ljust(AFTER, b"\0") if make.number(2) else after
        elif b"=" in before or b":" in before:
            before = before.replace(b"=", b" ").replace(b":", b" ")
        windows.append(before + value[:INSIDE].encode().ljust(INSIDE, b"\0") + after)
        labels.append(label)
        values.append(own)
    return windows, labels, values


def shard(found: list[tuple[int, bytes]], k: int = 0, extra: int = EXTRA) -> tuple[bytes, bytes, bytes]:
    """Labelled windows of the corpus with generated ones in their contexts: windows, labels, parts (0: calibrate,
    1: examine, 2 and 3: train), a byte each."""
    windows, labels, values = generated([w for _, w in found], max(extra, EACH * len(found)), 13 + k)
    values = [*(v.encode() for v in values), *(w[BEFORE : BEFORE + INSIDE].rstrip(b"\0") for _, w in found)]
    part = bytes(hashlib.md5(v).digest()[0] // 64 for v in values)  # the same value is never on two sides
    return b"".join([*windows, *(w for _, w in found)]), bytes([*labels, *(x for x, _ in found)]), part


def arrays(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    windows, labels, parts = row
    return as_rows([windows]), np.frombuffer(labels, np.uint8), np.frombuffer(parts, np.uint8)


def trained(net: CharNet, row: tuple, k: int, r: int) -> tuple[int, int, np.ndarray]:
    """A shard's round, from net: windows seen, steps, state."""
    own, (x, y, part) = copy.deepcopy(net), arrays(row)
    own.epoch(x[part > 1], y[part > 1].astype(float), r, 12 + k)
    return int((part > 1).sum()), own.t, own.state()


def tallied(net: CharNet, row: tuple) -> np.ndarray:
    """Of a shard's windows that didn't train: part, label, output, how many."""
    x, y, part = arrays(row)
    rows, n = np.unique(np.stack([part[part < 2], y[part < 2], net.outputs(x[part < 2])], 1).astype(np.int64), axis=0, return_counts=True)
    return np.column_stack([rows, n])


def fitted(step: Callable, tally: Callable, recall: float = 0.99) -> CharNet:
    """A network: step gives the shards' states after a round, tally the counts of outputs over all shards."""
    net = CharNet()
    for r in range(EPOCHS):
        net.mean(step(net, r))
    part, y, z, n = np.array(sorted(map(tuple, tally(net))), np.int64).T
    net.calibrate(z[part == 0], y[part == 0], n[part == 0], recall)
    net.examined(z[part == 1], y[part == 1], n[part == 1])
    return net


def learn(found: list[tuple[int, bytes]], recall: float = 0.99, extra: int = EXTRA) -> CharNet:
    """A network from labelled windows and generated ones, in one shard."""
    row = shard(found, extra=extra)
    return fitted(lambda net, r: [trained(net, row, 0, r)], lambda net: tallied(net, row), recall)


def shards(found: DataFrame) -> DataFrame:
    """k, windows, labels, parts: a row per shard, of all different labelled windows of `findings`, as a table."""
    each = materialise(found.select(F.explode(F.arrays_zip("labels", "windows")).alias("x")).select("x.labels", "x.windows").distinct(), "labelled")
    count = max(1, -(-each.count() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for k, own in itertools.groupby(rows, key=lambda x: x[0]):
            made = shard([(label, bytes(w)) for _, label, w in own if w is not None], k)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["k", "windows", "labels", "parts"])

    dealt = each.select(F.expr(f"cast(pmod(xxhash64(windows, labels), {count}) as int)").alias("k"), "labels", "windows")
    every = found.sparkSession.range(count).select(F.col("id").cast("int").alias("k"), F.expr("cast(null as int)"), F.expr("cast(null as binary)"))  # shards without a window
    # a file per shard, or nearly so: the rounds read them in as many tasks
    dealt = dealt.union(every).repartitionByRange(count, "k").sortWithinPartitions("k", "labels", "windows")
    out = materialise(dealt.mapInArrow(run, "k int, windows binary, labels binary, parts binary"), "shards")
    dropped(each)
    return out


def _train(found: DataFrame) -> CharNet:
    rows = shards(found)

    def step(net: CharNet, r: int) -> list[tuple[int, int, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    n, t, state = trained(net, row, k, r)
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((k, pa.int32()), (n, pa.int64()), (t, pa.int64()), (state.tobytes(), pa.binary()))], names=["k", "n", "t", "state"])

        got = rows.mapInArrow(run, "k int, n long, t long, state binary").collect()
        return [(x.n, x.t, np.frombuffer(x.state, np.float32)) for x in sorted(got, key=lambda x: x.k)]

    def tally(net: CharNet) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in tallied(net, row).T], names=["part", "label", "z", "n"])

        return rows.mapInArrow(run, "part long, label long, z long, n long").groupBy("part", "label", "z").agg(F.sum("n")).collect()

    net = fitted(step, tally)
    dropped(rows)
    return net


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans, windows with their places, and all labelled windows, each once a document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "starts", "ends", "seen", "labels", "windows")}
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = candidates(text, base)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                seen = [x for c in [*more, *around(text, base)] for x in pieces(text, *c)]
                values = [(1, e - len(ASSIGN.match(text, s)[2]) if k == 0 else s, e) for s, k, e in base]
                plain = [(0, s, e) for s, e in more if PLAIN.fullmatch(text, s, e)]
                known = dict.fromkeys((k, window(text, s, e)) for k, s, e in values + plain)
                out["base"].append(joined(base))
                for name, part in zip(("starts", "ends", "seen"), zip(*seen, strict=True) if seen else ((), (), ()), strict=True):
                    out[name].append(list(part))
                out["windows"].append([w for _, w in known])
                out["labels"].append([k for k, _ in known])
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, starts array<long>, ends array<long>, seen array<binary>, labels array<int>, windows array<binary>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row per document; threshold, held_out_recall,
    held_out_false: what the network was found to be, on each row."""
    found = materialise(findings(docs, id_col, text_col), "findings")
    net = _train(found)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            base, starts, ends, seen = (b.column(k).to_pylist() for k in range(4, 8))
            q = iter(net.probability(as_rows([w for x in seen for w in x])).tolist())
            spans = []
            for old, ss, es in zip(base, starts, ends, strict=True):
                more = chosen([(s, e, next(q)) for s, e in zip(ss, es, strict=True)], net.threshold)
                known = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in old.split(",") if x)]
                spans.append(joined([*known, *((s, 3, e) for s, e in more)]) if more else old)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(spans)], names=[*names, "base_sha256", "spans"])

    out = found.select(*names, "base", "starts", "ends", "seen").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.select("*", *[F.lit(float(x)).alias(c) for c, x in (("threshold", net.threshold), ("held_out_recall", net.recall), ("held_out_false", net.false))])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "[SECRET]") -> DataFrame:
    """docs with every secret's value in the text replaced by a tag; texts without one are unchanged."""
    net = _train(findings(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            texts = b.column(at).to_pylist()
            for k, text in enumerate(texts):
                base = base_spans(text or "")
                seen = [x for c in [*candidates(text or "", base), *around(text or "", base)] for x in pieces(text, *c)]
                if not base and not seen:
                    continue
                q = net.probability(as_rows([w for _, _, w in seen])).tolist()
                more = chosen([(s, e, p) for (s, e, _), p in zip(seen, q, strict=True)], net.threshold)
                # of an assignment only the value goes
                cuts = sorted([*more, *((e - len(ASSIGN.match(text, s)[2]) if kind == 0 else s, e) for s, kind, e in base)])
                out, upto = [], 0
                for s, e in cuts:
                    if e <= upto:
                        continue
                    out += [text[upto : max(s, upto)], tag] if s >= upto else []
                    upto = e
                texts[k] = "".join([*out, text[upto:]])
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
