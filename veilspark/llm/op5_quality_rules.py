"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good, votes bad or abstains on a document. Measures of the same trait belong to one rule, so that
rules may be taken as independent within a class: it votes bad if one of its measures is outside of the wide
range, good if all known ones are inside of the narrow range, and abstains otherwise. Documents with the same
votes are alike, so the corpus is reduced to counts of vote patterns (at most 3 to the number of rules, whatever
the corpus size). Expectation-maximisation on these counts estimates the shares of good documents and of each kind of
junk - a kind begins as what one rule sees, since kinds exclude each other and rules on junk aren't independent -
and how often each rule votes bad in each class. The posterior probability of the good class alone decides on
documents that the base rules leave. Shares and rates on junk aren't bounded; what is held is that a rule votes
bad on at most ALARM of the good documents, so single votes no more frequent than that may be false alarms.

Nulls: a null text has no words and fails the base rules; a null id is kept. Repeated rows stay. Texts with equal
votes tie and get the same posterior; at exactly `least` a document is kept. Empty tables give no rows. Texts of
any length are read whole. Extra columns of any name are ignored: only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import in_parts, materialise, table

#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = frozenset(SYMBOLS.encode())
_ENDS = (b".", b"!", b"?", b"\xe3\x80\x82")
#: Each rule's measures, with the range in which one is good and the range outside of which it is bad.
RULES = {
    "words": {"word_length": ((3, 10), (2.2, 14))},
    "symbols": {"symbols_per_word": ((0, 0.02), (0, 0.1)), "marked_share": ((0, 0.02), (0, 0.1)), "lettered_share": ((0.9, 1), (0.7, 1))},
    "repetition": {"dup_char_share": ((0, 0.1), (0, 0.3)), "repeat_share": ((0, 0.1), (0, 0.3))},
    "shouting": {"upper_share": ((0, 0.2), (0, 0.5)), "bang_share": ((0, 0.1), (0, 0.4))},
    "sentences": {"words_per_end": ((1.5, 60), (1, 200))},
}
#: What is known of rules beforehand: one votes bad on so few good documents at most. Without such a bound classes
#: are only told apart by what rules do together, and junk that a single rule sees would pass for good.
ALARM = 0.005
#: Where expectation-maximisation begins: the share of good documents; how often a rule votes bad on good ones, on junk
#: of its own kind and on junk of another kind. This counts on as much as so many documents of each class.
SHARE, START, STRENGTH = 0.5, (ALARM, 0.9, 0.1), 2.0


def measures(text: str) -> tuple[list[int], dict[str, float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the measures that the text is long enough for."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    once = set(lines)
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : k + len(hit)] |= hit
            repeat = int(cover.sum())
    base = [n, chars, symbols, len(lines) - len(once), repeat]
    if not n:
        return base, {}
    raw = np.frombuffer(b"".join(words), np.uint8)
    upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
    marked = sum(not w.isdisjoint(_SYMBOL_BYTES) for w in map(frozenset, words)) if symbols else 0
    found = {"word_length": chars / n, "symbols_per_word": symbols / n, "marked_share": marked / n, "bang_share": sum(w.endswith(b"!!") for w in words) / n}
    found["lettered_share"] = (upper + lower + int((raw >= 128).sum())) / len(raw)
    if n >= 20:
        found["repeat_share"] = repeat / n
        found["words_per_end"] = n / max(1, sum(w.endswith(_ENDS) for w in words))
    if len(lines) >= 3:
        found["dup_char_share"] = 1 - sum(map(len, once)) / sum(map(len, lines))
    if upper + lower >= 20:
        found["upper_share"] = upper / (upper + lower)
    return base, found


def votes(found: dict[str, float]) -> int:
    """The votes as a number in base 3, a digit per rule: 0 bad, 1 abstains, 2 good."""
    out = 0
    for ranges in RULES.values():
        known = [(found[m], good, bad) for m, (good, bad) in ranges.items() if m in found]
        is_bad = any(not bad[0] <= x <= bad[1] for x, _, bad in known)
        is_good = known and all(good[0] <= x <= good[1] for x, good, _ in known)
        out = 3 * out + (0 if is_bad else 2 if is_good else 1)
    return out


def estimated(counts: dict[int, int], rules: int, rounds: int = 500) -> tuple[dict[int, float], float, np.ndarray]:
    """Each pattern's probability of quality, the share of good documents, and how often each rule that votes on a
    document votes bad, as [class, rule]: good documents first, then junk of each rule's kind.

    Votes are independent within a class, abstaining says nothing.
    """
    p = np.vstack([np.full((1, rules), START[0]), np.where(np.eye(rules, dtype=bool), *START[1:])])
    share = np.array([SHARE, *[(1 - SHARE) / max(rules, 1)] * rules])
    keys = sorted(counts)
    if not keys:
        return {}, SHARE, p
    v = np.array([[k // 3 ** (rules - 1 - i) % 3 for i in range(rules)] for k in keys])
    bad, good, n = (v == 0).astype(float), (v == 2).astype(float), np.array([counts[k] for k in keys], float)
    prior, first, q = STRENGTH * p, STRENGTH * share, np.zeros((len(keys), rules + 1))
    for _ in range(rounds):
        z = np.log(share) + bad @ np.log(p.T) + good @ np.log(1 - p.T)
        z = np.exp(z - z.max(1, keepdims=True))
        old, q = q, z / z.sum(1, keepdims=True)
        weight = (n[:, None] * q).T
        p = (weight @ bad + prior) / (weight @ (bad + good) + STRENGTH)
        p[0] = np.minimum(p[0], ALARM)
        share = (weight.sum(1) + first) / (n.sum() + STRENGTH)
        if np.abs(q - old).max() < 1e-9:
            break
    return dict(zip(keys, q[:, 0].tolist(), strict=True)), float(share[0]), p


def posteriors(counts: dict[int, int], rules: int) -> dict[int, float]:
    return estimated(counts, rules)[0]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, votes, posterior, kept: a row per document."""
    spark = docs.sparkSession
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            found = [measures(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([base[k] for base, _ in found], pa.int64()) for k in range(5)], pa.array([votes(m) for _, m in found], pa.int32())], names=["doc_id", *names, "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in names)}, votes int"), "votes")
    counts = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}  # at most 3 ** rules rows
    q = posteriors(counts, len(RULES))
    known = spark.createDataFrame([(k, float(x)) for k, x in q.items()], "votes int, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
    return out.select("doc_id", *names, "base_failed", "votes", "posterior", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
