"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most 3
bits share at least 5 of them, so they share all bytes of at least one of 8 sets
of three positions (any five of eight positions hold three of the first four or
three of the last four). The index therefore lists fingerprints by (position set,
bytes); single bytes would list n/256 fingerprints each, and their pairs would
grow with the square of n. Within a list the shared positional bytes of each pair
are tallied, pairs with fewer than 5 are dropped, the rest are verified.

Lists that are too long are split by further positions: two more bytes, then
three of the six half-bytes left, after which 12 bits are free and no list can
hold more than 4096 different fingerprints. Nothing is dropped on the way, and a
list yields a spanning forest of its links, not its pairs.

Equal fingerprints are joined once, through the smallest doc_id that has them.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of all; repeated rows with one
id stand for that id, and `keep_one` keeps one of them; rows without an id are
documents like any other, and come last where one has to be named or kept; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .tables import free_name, materialize, numbered

SHINGLE = 3
SEED = 42
BITS = 3
#: Longest list that is compared as it is.
LIST = 1000
BYTES_SHARED = 8 - BITS


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A fingerprint for each text: bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    # Words end to end with one space between: every shingle is a slice.
    length = ends - starts
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.full(begin[-1], 0x20, np.uint8)
    word_of = np.repeat(np.arange(len(starts)), length)
    flat[np.arange(len(word_of)) + word_of] = data[np.arange(len(word_of)) + np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length)]
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    owner = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    stop = begin[np.minimum(at + shingle, first[1:][owner])] - 1
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], seed) for a, b in zip(begin[at].tolist(), stop.tolist(), strict=True)], W.U64)
    out = np.zeros(len(count), W.U64)
    edge = np.concatenate([[0], np.cumsum(n)])
    for bit in range(64):
        ones = W.sums(((h >> W.U64(bit)) & W.U64(1)).astype(np.int64), edge)
        out |= (2 * ones > n).astype(W.U64) << W.U64(bit)
    return out


def with_fingerprint(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns (of longs) in keep, and fp, the fingerprint as a signed long."""
    names = ["doc_id", *keep]

    def run(batches):
        for part in W.chunks(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fingerprints(*W.buffer(part.column("text"))).view(np.int64))], names=[*names, "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text").mapInArrow(run, ", ".join(f"`{c}` long" for c in [*names, "fp"]))


def mask(positions: tuple[int, ...], width: int) -> int:
    """A signed 64-bit mask over units of width bits."""
    m = sum(((1 << width) - 1) << (width * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _split(rows: DataFrame, masks: Column) -> DataFrame:
    """Rows (list id, fp, fixed bits) spread over longer keys: each mask adds bits to those fixed."""
    spread = rows.select("fp", F.explode(masks).alias("mask"))
    return spread.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _level(n: int) -> list[int]:
    triples = [mask(t, 8) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
    if n == 0:
        return triples
    fives = {mask(f, 8) for f in combinations(range(8), BYTES_SHARED)}
    if n == 1:
        return sorted(fives)
    out = set()
    for free in combinations(range(8), BITS):
        kept = [p for p in range(8) if p not in free]
        nibbles = [2 * p + k for p in free for k in (0, 1)]
        for three in combinations(nibbles, 3):
            out.add(mask(tuple(x for p in kept for x in (2 * p, 2 * p + 1)) + three, 4))
    return sorted(out)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is joined by links among these different fingerprints, each to the first of its part."""
    left, links = np.sort(fps), []
    shifts = (np.arange(8, dtype=W.U64) * W.U64(8))[None, :]
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            x = left.view(W.U64) ^ np.int64(todo.pop()).view(W.U64)
            # Count filter: positional bytes shared; then the bits themselves.
            near = (((x[:, None] >> shifts) & W.U64(255)) == 0).sum(1) >= BYTES_SHARED
            near[near] = np.bitwise_count(x[near]) <= BITS
            links += [(int(root), int(v)) for v in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return links


def _compare(lists: DataFrame) -> DataFrame:
    """Links (a, b) from lists (mask, key, fp) that lie sorted in their partitions."""

    def run(batches):
        held = np.zeros((0, 3), np.int64)

        def links(rows):
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1), [True]]))
            found = [p for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1 for p in forest(rows[a:b, 2])]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")])])
            cut = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1)).max(initial=-1)) + 1
            yield links(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield links(held)

    return lists.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """Links (a, b) that join every two of these different fingerprints (column fp) that differ in at most BITS bits, directly or through others."""
    spark = fps.sparkSession
    rows, out = fps.select("fp"), spark.createDataFrame([], "a long, b long")
    for level in range(3):
        lists = materialize(_split(rows, F.array(*(F.lit(m).cast("long") for m in _level(level)))), f"lists{level}")
        sizes = lists.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = lists.join(sizes, ["mask", "key"])
        most = longest if level < 2 else 1 << 62
        found = materialize(_compare(sized.where(F.col("n") <= most).select("mask", "key", "fp")), "links")
        out = found if level == 0 else out.unionAll(found)
        if level == 2:
            break
        rows = materialize(sized.where(F.col("n") > most).select("fp").distinct(), "long")
        if rows.isEmpty():
            break
    return out


def linked(fps: DataFrame) -> DataFrame:
    """fp and part for each different fingerprint (column fp): the same part for those that links join."""
    different = fps.select("fp").distinct()
    found = connected_components(links(different)).select(F.col("node").alias("fp"), F.col("component").alias("part"))
    return different.join(found, "fp", "left").select("fp", F.coalesce("part", "fp").alias("part"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links lead to (null if no document there has an id)."""
    marked = materialize(with_fingerprint(documents), "fingerprints")
    smallest = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    parts = materialize(linked(smallest), "parts")
    named = smallest.join(parts, "fp").groupBy("part").agg(F.min("head").alias("component_id"))
    return marked.join(parts.join(named, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id (rows without one come last), all columns as they were."""
    row = free_name(documents, "_row")
    rows = numbered(documents, row)
    marked = materialize(with_fingerprint(rows, row), "fingerprints")
    first = first_row(marked.join(linked(marked), "fp"), row, "part")
    return rows.join(first, row, "left_semi").select(*(F.col(f"`{c}`") for c in documents.columns))


def first_row(rows: DataFrame, row: str, by: str) -> DataFrame:
    """The row number of each group's first row: by doc_id, those without one last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    return rows.groupBy(by).agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
