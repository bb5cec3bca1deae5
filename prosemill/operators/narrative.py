"""The narrative score: seven dimensions of 0 to 5 from phrases, paragraph lengths and line openings."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
COUNTED = {
    "stated-morals": ["the key takeaway", "the takeaway", "the lesson", "ultimately", "in conclusion", "it is important to", "remember that"],
    "performed-embodiment": ["i've seen", "i have seen", "in my experience", "as someone who", "i know firsthand", "we've all"],
    "vague-allusion": ["various", "a variety of", "many ways", "things", "stuff", "somewhere", "someone", "some people", "certain"],
}
MARKERS = {
    "no-concession-no-reader": ["but", "however", "although", "except", "unless", "tradeoff", "trade-off", "limitation", "risk", "reader", "user"],
    "flat-time": ["when", "after", "before", "then", "now", "today", "later", "previously", "next", "first", "finally"],
}
_WORDS = r"(?U)\S+"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORDS))


def narrative(docs: DataFrame) -> DataFrame:
    """(doc_id, words, total, band, and a column for each dimension) of documents (doc_id, text); a null text scores 0."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = _words(low)
    lens = F.filter(F.transform(F.split(low, r"\n\s*\n"), _words), lambda n: n >= 20)
    columns = {name.replace("-", "_"): F.least(F.lit(5), sum((F.regexp_count(low, F.lit(p)) for p in phrases), F.lit(0))) for name, phrases in COUNTED.items()}
    columns["tidy_structure"] = F.when((F.size(lens) >= 4) & (F.array_max(lens) <= F.array_min(lens) * 2), 3).otherwise(0)
    for name, marks in MARKERS.items():
        plain = "|".join(m for m in marks if "-" not in m)
        there = low.rlike(rf"(?<![a-z])(?:{plain})(?![a-z])") | F.lit(False)
        for m in marks:
            there = there | F.contains(low, F.lit(m)) if "-" in m else there
        columns[name.replace("-", "_")] = F.when((words >= 250) & ~there, 5).otherwise(0)
    base = docs.select("doc_id", "text", words.alias("words"), *[c.cast("int").alias(n) for n, c in columns.items()])
    rows = docs.select("doc_id", F.posexplode(F.split(low, "\n")).alias("i", "line")).where("trim(line) <> ''")
    # Openings are compared without regard to the case of ASCII letters.
    opening = F.translate(F.array_join(F.slice(F.filter(F.split(F.regexp_replace(F.trim("line"), r"^[-*0-9.) ]+", ""), r"(?U)\s+"), lambda w: w != ""), 1, 3), " "), string.ascii_uppercase, string.ascii_lowercase)
    by = W.partitionBy("doc_id").orderBy("i")
    again = rows.withColumn("o", opening).withColumn("same", ((F.octet_length("o") >= 10) & (F.col("o") == F.lag("o").over(by))).cast("int")).groupBy("doc_id").agg(F.least(F.lit(5), F.coalesce(F.sum("same"), F.lit(0))).cast("int").alias("machine_parallelism"))
    names = ["stated_morals", "tidy_structure", "machine_parallelism", "performed_embodiment", "vague_allusion", "no_concession_no_reader", "flat_time"]
    out = base.join(again, "doc_id", "left").fillna({"machine_parallelism": 0})
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.select("doc_id", "words", total.alias("total"), F.when(total <= 6, "low").when(total <= 15, "medium").otherwise("high").alias("band"), *names)


_ALL, _PUBLIC = ["docs", "marketing", "editorial", "microcopy"], ["marketing", "editorial"]
# What a reader asks of each dimension, and the kinds of text that it is asked of.
QUESTIONS = [
    ("stated-morals", "stated morals", "Does the document explain its lesson instead of letting evidence carry the point?", _ALL),
    ("tidy-structure", "tidy structure", "Does the shape feel over-balanced, with every section carrying the same weight?", _PUBLIC),
    ("machine-parallelism", "machine parallelism", "Do adjacent headings, bullets, or sentences repeat the same grammatical frame?", _ALL),
    ("performed-embodiment", "performed embodiment", "Does the text claim lived presence without concrete observed detail?", _PUBLIC),
    ("vague-allusion", "vague allusion", "Does the prose lean on unspecific references instead of named objects, actors, or constraints?", _ALL),
    ("no-concession-no-reader", "no concession / no reader", "Does it avoid tradeoffs, limitations, objections, or reader context?", _PUBLIC),
    ("flat-time", "flat time", "Does everything happen in a timeless present with no sequence, before/after, or revision?", _PUBLIC),
]


def asked(scores: DataFrame, register: str | None = None) -> DataFrame:
    """(doc_id, question, label, prompt, score): the questions that a document's scores (``narrative``) raise, those above 0; with a ``register``
    only those asked of such texts. A row a document and dimension, by one projection."""
    chosen = [q for q in QUESTIONS if register is None or register in q[3]]
    rows = [F.struct(F.lit(i).alias("question"), F.lit(label).alias("label"), F.lit(prompt).alias("prompt"), F.col(i.replace("-", "_")).alias("score")) for i, label, prompt, _ in chosen]
    return scores.select("doc_id", F.explode(F.filter(F.array(*rows), lambda q: q["score"] > 0)).alias("q")).select("doc_id", "q.*")
