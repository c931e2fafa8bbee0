"""Text measures of short questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did will
would could should may might shall can that this these those it its as if then than so not no nor yet both either
neither each any all most more some such what which who whom how when where why whether before after during while
until about into through over under between among within without against up down out off above below there here
""".split()

# Months in order of search, whole names first; a match inside a word counts.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_SHORT = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def tokens(text: Column) -> Column:
    """Runs of a-z of two letters or more, lower-cased, without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def temporal_order(text: Column) -> Column:
    """1 to 12 for a month, 3 per quarter, 12 per year after 2000 for a year, 12 and 6 for the end and middle of one; else NULL."""
    low = F.lower(text)
    out = None
    rules = [(low.contains(m), F.lit(i)) for names in (MONTHS, MONTHS_SHORT) for i, m in enumerate(names, 1)]
    rules += [(low.contains(f"q{q}"), F.lit(3 * q)) for q in range(1, 5)]
    year = F.regexp_extract(low, r"20(\d\d)", 1)
    rules += [(year != "", F.try_to_number(year, F.lit("99")).cast("int") * 12)]
    rules += [(low.contains("end of year") | low.contains("eoy"), F.lit(12)), (low.contains("mid-year") | low.contains("midyear"), F.lit(6))]
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.cast("long")


def tfidf(docs: DataFrame, id_: str, words: str) -> DataFrame:
    """id, term, weight: share of the words times ln(1 + N / (1 + documents with it))."""
    n = docs.agg(F.count("*").alias("docs"))
    each = docs.select(id_, F.size(words).alias("len"), F.explode(words).alias("term")).groupBy(id_, "len", "term").agg(F.count("*").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    return each.join(df, "term").join(F.broadcast(n)).select(id_, "term", (F.col("tf") / F.col("len") * F.log(1 + F.col("docs") / (1 + F.col("df")))).alias("weight"))


def pair_similarity(a: Column, b: Column) -> Column:
    """0.4 Jaccard + 0.6 cosine, the cosine's weights from a corpus of just the two: ln 2 for own words, ln(5/3) for shared."""
    own, shared = F.log(F.lit(2.0)), F.log(F.lit(5.0) / 3)

    def count(x: Column, w: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == w)) / F.size(x)

    def norm(x: Column, other: Column) -> Column:
        return F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, w: s + F.pow(count(x, w) * F.when(F.array_contains(other, w), shared).otherwise(own), 2))

    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + count(a, w) * count(b, w) * shared * shared)
    cosine = F.when((norm(a, b) == 0) | (norm(b, a) == 0), 0.0).otherwise(dot / F.sqrt(norm(a, b) * norm(b, a)))
    return 0.4 * jaccard(a, b) + 0.6 * cosine
