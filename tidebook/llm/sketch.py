"""Document fingerprints: a threshold-scaled sketch, with DataFrame functions only.

The hash of every run of five words is kept if it lies below a fixed fraction of
all hashes. Sketches of one fraction can be merged by union, and shares of common
hashes estimate containment between documents of very unequal length. Beside the
sketch stands the text's smallest hash, which is no part of it: it tells texts apart
none of whose hashes lies below.

Defined cases: a null text counts as empty; a text without words has an empty
sketch and no smallest hash, and fewer than five words are one shingle; of two empty
sketches the likeness is 1 if the smallest hashes are the same and 0 if not, of an empty
and another one 0. Rows that share a doc_id are each
fingerprinted, and stand together at that id's place: what precedes them is edited
with the smallest of their texts. Rows without doc_id have no next document: nothing
replaces their last quarter, and their likeness to the next is 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .tables import materialize

SHINGLE = 5
FRACTION = 1 / 4


def below(fraction: float) -> int:
    """Signed 64-bit hashes under this number are the fraction of all."""
    return -(1 << 63) + int((1 << 64) * fraction)


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """df with column out: the sorted sketch of text, and out_least: its smallest hash.

    Words, their hashes and the sketch are columns of their own in turn, so that none is worked out twice.
    """
    words, hashes, low = f"{out}_words", f"{out}_hashes", f"{out}_low"
    df = df.withColumn(words, F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    last = F.greatest(F.size(words) - shingle, F.lit(0))
    run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col(words), i + j) for j in range(shingle))))
    df = df.withColumn(hashes, F.when(F.size(words) > 0, run).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(low, F.filter(hashes, lambda h: h < F.lit(below(fraction))))
    return df.withColumn(out, F.array_sort(F.array_distinct(low))).withColumn(f"{out}_least", F.array_min(hashes)).drop(words, hashes, low)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together. Of the smallest hashes, the smaller one is theirs."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column, least_a: Column, least_b: Column) -> Column:
    """The estimated share of the smaller document's shingles that are also in the other."""
    smaller = F.least(F.size(a), F.size(b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, least_a.eqNullSafe(least_b).cast("double")).when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def as_text(sketch: Column, least: Column) -> Column:
    """Each hash's last eight hexadecimal digits, in order; of an empty sketch a minus and all digits of the smallest hash."""
    tail = F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    return F.when((F.size(sketch) == 0) & least.isNotNull(), F.concat(F.lit("-"), F.lower(F.hex(least)))).otherwise(tail)


def following(documents: DataFrame) -> DataFrame:
    """doc_id, next_id and k, a quarter of the (longest) text's length, for each different id; after the last comes the first.

    Ids are dealt into ranges and written; within a range the next is a window's, and the ranges' first ids, one
    for each partition, tell what follows their last ones.
    """
    spark = documents.sparkSession
    ids = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = sorted((r["first"], r["part"]) for r in ids.groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    turn = {part: firsts[(i + 1) % len(firsts)][0] for i, (_, part) in enumerate(firsts)}
    wrap = F.create_map(*(F.lit(x) for kv in turn.items() for x in kv)) if turn else F.create_map(F.lit(0), F.lit(0))
    inside = F.lead("doc_id").over(Win.partitionBy("part").orderBy("doc_id"))
    return ids.select("doc_id", F.coalesce(inside, wrap[F.col("part")]).cast("long").alias("next_id"), F.floor(F.col("n") / 4).cast("int").alias("k"))


def against_edited(documents: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text, edited, and sketch, edited_sketch and next_sketch, each with its smallest hash, of each document.

    The edited text has the first characters of the next document in place of its last quarter. Texts are dealt
    by doc_id once; only the few characters needed and a sketch go on to the preceding document.
    """
    every = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = every.where("doc_id is not null")
    order = materialize(following(rows), "order")
    preceding = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), "k")
    heads = with_sketch(rows.join(preceding, "doc_id"), "text", "next_sketch", fraction)
    heads = heads.select("prev_id", F.struct(F.left("text", F.col("k")).alias("head"), "next_sketch", "next_sketch_least").alias("next"))
    heads = heads.groupBy(F.col("prev_id").alias("doc_id")).agg(F.min("next").alias("next"))
    # Both joins take the same rows dealt by doc_id, so the texts are shuffled once.
    both = rows.join(heads, "doc_id", "left")
    both = both.unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    k = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - k), F.coalesce(F.left("next.head", k), F.lit("")))
    both = both.withColumn("edited", edited)
    both = with_sketch(with_sketch(both, "text", "sketch", fraction), "edited", "edited_sketch", fraction)
    return both.select("doc_id", "text", "edited", "sketch", "sketch_least", "edited_sketch", "edited_sketch_least", "next.next_sketch", "next.next_sketch_least")
