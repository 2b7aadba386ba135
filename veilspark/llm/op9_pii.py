"""PII: base patterns, and information-theoretic sanitisation of the terms that reveal them. DataFrame and SQL functions only.

Base findings (email, ip, card, phone) are found with their places by marking matches and splitting at the
marks. The protected entities are the values so found. A term - a lower-cased run of four or more letters, of
letters with digits (three or more), or of two or three letters that begin with a capital, outside the findings -
co-occurs with the entities of its text, wherever both stand. Over all documents, which all four counts are of,

    disclosure(term, entity) = PMI(term; entity) / information content of the entity
                             = ln(joint * n / (n_term * n_entity)) / ln(n / n_entity),

which is 1 when the term occurs nowhere without the entity and 0 when it says nothing about it. A term is telling
if its disclosure reaches `threshold` and chance doesn't explain `joint`: were both independent, joint would be
Poisson with mean n_term * n_entity / n, and Chernoff's bound on reaching it, times the number of pairs weighed,
must be at most `chance`. Below `support` different texts an association isn't weighed: a single text proves none, and
two are mostly near copies of each other, which share all their rare words. Telling terms
are reported wherever they stand in the corpus (kind "term"), with their entity or without it, since there they
tell of it as well. In sanitised texts findings are generalised to their kind and such terms are removed.

Nulls: a null text is empty; a null id is kept. Repeated rows are found again. Ties: findings that begin at the same
place come in the order of the kinds. Empty tables give no rows. Texts of any length are read whole, at a cost near
their size. Extra columns of any name are ignored by `find` and kept by `sanitised`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import INSTEAD, MARKS, clusters, cut, matches
from veilspark.llm.common import materialise, rows_of, table

#: Kinds in the order in which equal starts are listed (fixed values).
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "A-Za-z0-9._%+-"
#: Java patterns. Each is the contract's, held to the place where the leftmost match must begin and possessive
#: where nothing that follows could match after giving characters back, so long runs cost no more than once.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Runs end where letters and digits do, and each is met once, so long ones cost no more than that.
TERM = r"(?<![\p{L}\p{N}])(?:(?=\p{N}*+\p{L})(?=\p{L}*+\p{N})[\p{L}\p{N}]{3,}+|\p{L}{4,}+|\p{Lu}\p{L}{1,2}+(?![\p{L}\p{N}]))"
SPAN = "array<struct<start:long,rank:int,end:long,value:string>>"


def luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[ -]", "")), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    value = found["value"]
    count = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": count.between(14, 19) & luhn(value),
        "phone": count.between(10, 15),
    }[kind]


def ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All base findings by start and kind."""
    found = []
    for rank, kind in enumerate(KINDS[:4]):
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){13}")
        if kind == "ip":
            hint = hint & text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
        shaped = ranked(F.filter(matches(text, PATTERNS[kind]), partial(holds, kind)), rank)
        found.append(F.when(hint, shaped).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["rank"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, threshold: float = 0.9, chance: float = 0.05, small: int = 300_000) -> DataFrame:
    """doc_id, th (hash of the text), base, spans: a row per document; both arrays of start, rank, end, value."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), base_spans(text).alias("base"), text.alias("t"))
    entities = F.array_distinct(F.transform("base", lambda x: F.concat_ws(":", x["rank"].cast("string"), F.lower(x["value"]))))
    base = materialise(base.select("doc_id", "th", "base", F.when(F.size("base") > 0, entities).alias("entities"), F.when(F.size("base") > 0, F.col("t")).alias("t")), "findings")
    n = base.count()
    # texts with findings, each once, with its number of documents
    full = base.where("t is not null").groupBy("th").agg(F.first("base").alias("base"), F.first("entities").alias("entities"), F.first("t").alias("t"), F.count("*").alias("w"))
    held = full.select("th", "w", F.explode("entities").alias("entity"))
    # an entity in fewer different texts than `support` can have no term: what stands in its texts isn't counted
    known = materialise(held.groupBy("entity").agg(F.sum("w").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"), "entities")
    held = held.join(known, "entity").select("th", "entity", "n_entity")
    named = full.join(held.select("th").distinct(), "th", "left_semi").select("th", "w", F.explode(F.array_distinct(F.transform(_terms(F.col("t"), F.col("base")), lambda x: F.lower(x["value"])))).alias("term"))
    named = materialise(named, "terms")
    # n_term is at least the documents in which the term stands with any of these entities (near), and joint at most n_entity.
    # Terms too frequent for all entities of a text are left out before they meet, pairs that fall short even so before
    # the count over the corpus: that loses nothing that could reach the threshold.
    near = named.groupBy("term").agg(F.sum("w").alias("near"))
    bound = held.groupBy("th").agg(F.max(F.col("n_entity") * F.pow(n / F.col("n_entity"), F.lit(1 - threshold))).alias("bound"))
    named = named.join(near, "term").join(bound, "th").where(F.col("near") <= F.col("bound") * (1 + 1e-9)).select("th", "w", "term", "near")
    joint = named.join(held, "th").groupBy("entity", "term").agg(F.sum("w").alias("joint"), F.count("*").alias("texts"), F.first("near").alias("near"), F.first("n_entity").alias("n_entity")).where(F.col("texts") >= support)
    most = F.col("joint") * F.pow(n / F.col("n_entity"), F.lit(1 - threshold)) * (1 + 1e-9)
    joint = materialise(joint.where((F.col("near") <= most) & (F.col("n_entity") < n)).drop("near", "texts"), "joint")
    pairs = joint.count()
    terms = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.translate(text, MARKS, INSTEAD), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))

    def standing(wanted: DataFrame) -> DataFrame:
        """The terms of all documents that are wanted; these are sent to the scan only if their checked number allows, about 100 bytes each."""
        wanted = materialise(wanted, "wanted")
        size = wanted.count()
        found = terms.join(F.broadcast(wanted) if size <= small else wanted, "term", "left_semi")
        return found if size else found.where("false")

    n_term = standing(joint.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_term"))
    known = joint.join(n_term, "term")
    expected = F.col("n_term") * F.col("n_entity") / n
    surprise = F.col("joint") * F.ln(F.col("joint") / expected) - F.col("joint") + expected
    disclosure = F.ln(F.col("joint") / expected) / F.ln(n / F.col("n_entity"))
    telling = known.where((disclosure >= threshold) & (F.col("joint") > expected) & (surprise >= F.ln(F.lit(max(pairs, 1) / chance)))).select("term").distinct()
    # all texts once more, for the few terms that tell: where they will have to be marked
    told = materialise(standing(telling).groupBy("doc_id", "th").agg(F.collect_set("term").alias("told")), "told")
    there = told.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "told")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    marked = own.join(there, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "th", "t", "told").dropDuplicates(["doc_id", "th"])
    marked = marked.join(base.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "base").dropDuplicates(["_d", "_t"]), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    more = marked.select(F.col("_d"), F.col("_t"), ranked(F.filter(_terms(F.col("t"), F.col("base")), lambda x: F.array_contains("told", F.lower(x["value"]))), 4).alias("more"))
    out = base.join(more, base.doc_id.eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return out.select("doc_id", "th", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("more").cast(SPAN)))).alias("spans"))


def _terms(text: Column, base: Column) -> Column:
    """Terms with their places, outside of the findings. Without findings all are; a text's findings are few, its terms many."""
    return F.filter(matches(text, TERM), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with findings generalised to their kind in brackets and disclosing terms removed."""
    found = find(docs, id_col, text_col, **how).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("spans").alias("_s")).dropDuplicates(["_d", "_t"])
    text, tags = F.col("_text"), F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "")])
    # of findings that overlap the first one's tag stands for all
    joined = F.transform(clusters(F.col("_s")), lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c[0]["rank"].alias("rank")))
    own = docs.select(rows_of(docs), F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64(F.coalesce("_text", F.lit(""))))
    out = own.join(found, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    fresh = cut(text, joined, lambda x: F.element_at(tags, x["rank"] + 1))
    return out.select(F.col("_row").withField(text_col, F.when(F.col("_s").isNull(), text).otherwise(fresh)).alias("_row")).select("_row.*")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return found.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS[:4])], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
