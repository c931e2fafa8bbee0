"""Best-fit packing of tokenised documents into sequences: a linear grouping scheme.

Pieces longer than a small bound are sorted by length and cut into groups of
equal cardinality; every length is rounded up to the longest of its group. For
the few sizes left, configurations (how many of each size one sequence holds) are
optimised by column generation: a linear programme over configurations, whose
next column is a knapsack on the duals. Actual documents then take the rounded
places, and small pieces and all that is left over go by best fit into the gaps.

Everything is decided on the histogram of lengths, which has at most `capacity`
entries whatever the number of documents. Pieces of one length are numbered on
the executors, and a number is a place in the plan.

Defined cases: a null text counts as empty and is a document of the end token
alone; repeated rows are packed as often as they occur; an empty table gives no
rows. Columns beyond doc_id and text are never looked at.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import words as W
from .tables import materialize

CAPACITY = 2048
END = 0
#: Schemes to choose from: pieces over this share of the capacity are grouped and rounded, in so many groups.
SCHEMES = ((1 / 3, 20), (1 / 4, 30), (1 / 16, 60))
#: Runs of places that are sent to all executors (40 bytes each); a plan of more is a table that pieces are joined with.
SENT = 1_000_000
#: Numbers of pieces in a bucket of that table.
BUCKET = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict = {}


def encoder(name: str = "byte_bpe_50k"):
    """Ids of a batch of texts, as the tokenizers library gives them with the file name.json.

    The same vocabulary as ranks gives the same ids several times faster; texts that hold a special token's
    string, which the library reads as that token, go to the library itself.
    """
    if name not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        _encoders[name] = lambda text: exact.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
    return _encoders[name]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    n = len(ids)
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(documents: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k", end: int = END) -> DataFrame:
    """PIECES of each document: where it starts in the document's ids, its length and its checksum."""

    def run(batches):
        encode = encoder(name)
        for part in W.chunks(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                for k, (start, length) in enumerate(cut(ids, capacity)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


@dataclass
class Bin:
    """n sequences of the same content: (length, first number, how many a sequence)."""

    n: int
    room: int
    content: list[tuple[int, int, int]]


def knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    size, value = np.asarray(sizes)[order], values[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if m := fits[room]:
            worth = best[room - size[:m]] + value[:m]
            k = worth.argmax()
            if worth[k] > best[room] + 1e-12:
                best[room], pick[room] = worth[k], order[k]
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return best[capacity], counts


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations that together need no more than the demand, from the linear optimum.

    sizes: descending. Column generation with an explicit basis inverse; the multiples are rounded down.
    """
    if not sizes:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        value, column = knapsack(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.inv(basis) @ demand
    return [(basis[:, k].round().astype(int), int(x[k] + 1e-9)) for k in range(len(sizes)) if x[k] >= 1]


def groups(histogram: dict[int, int], large: float, n: int) -> list[list[tuple[int, int, int]]]:
    """Lengths over `large`, longest first, in n groups of as many pieces each: runs (length, first number, count)."""
    lengths = sorted((s for s in histogram if s > large), reverse=True)
    total = sum(histogram[s] for s in lengths)
    out: list[list[tuple[int, int, int]]] = []
    edges = [round(total * (k + 1) / n) for k in range(n)]
    passed, runs = 0, []
    for s in lengths:
        number, left = 0, histogram[s]
        while left:
            take = min(left, edges[0] - passed)
            if take:
                runs.append((s, number, take))
                number, left, passed = number + take, left - take, passed + take
            while edges and passed >= edges[0]:
                edges.pop(0)
                if runs:
                    out.append(runs)
                runs = []
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> list[Bin]:
    """Bins for all pieces of the histogram {length: pieces}, by the scheme that needs fewest sequences."""
    return min((scheme(histogram, capacity, large, n) for large, n in schemes), key=lambda bins: sum(b.n for b in bins))


def scheme(histogram: dict[int, int], capacity: int, large: float, n_groups: int) -> list[Bin]:
    """Linear grouping of the pieces over `large` of the capacity, then best fit."""
    histogram = {s: n for s, n in histogram.items() if n}
    bins = [Bin(n, 0, [(capacity, 0, 1)]) for s, n in histogram.items() if s == capacity]
    rest = {s: n for s, n in histogram.items() if s < capacity}
    grouped = groups(rest, large * capacity, n_groups)
    # Groups with the same longest piece are one size.
    merged: list[list[tuple[int, int, int]]] = []
    for g in grouped:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(list(g))
    sizes = [g[0][0] for g in merged]
    demand = np.array([sum(r[2] for r in g) for g in merged], float)
    queues = [list(g) for g in merged]
    for counts, times in configurations(sizes, demand, capacity):
        while times:
            # As many sequences as can be filled from the runs at hand, each place by pieces of one length.
            content, take = [], times
            for k in np.flatnonzero(counts):
                take = min(take, max(queues[k][0][2] // int(counts[k]), 1))
            for k in np.flatnonzero(counts):
                need = int(counts[k])
                if queues[k][0][2] >= need * take:
                    s, number, have = queues[k][0]
                    content.append((s, number, need))
                    queues[k][0] = (s, number + need * take, have - need * take)
                    if have == need * take:
                        queues[k].pop(0)
                else:  # a run's last pieces: take is 1
                    while need:
                        s, number, have = queues[k][0]
                        m = min(need, have)
                        content.append((s, number, m))
                        need -= m
                        queues[k][0] = (s, number + m, have - m)
                        if have == m:
                            queues[k].pop(0)
            bins.append(Bin(take, capacity - sum(s * m for s, _, m in content), content))
            times -= take
    left = [r for q in queues for r in q] + [(s, 0, n) for s, n in rest.items() if s <= large * capacity]
    return best_fit(bins, left, capacity)


def best_fit(bins: list[Bin], runs: list[tuple[int, int, int]], capacity: int) -> list[Bin]:
    """Put runs (length, first number, count), longest first, where they leave least room; open sequences as needed.

    Equal sequences are filled together, so the work depends on the number of runs and not of pieces.
    """
    by_room: dict[int, list[Bin]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    rooms = sorted(by_room)

    def put(b: Bin) -> None:
        if b.room not in by_room:
            by_room[b.room] = []
            rooms.insert(bisect_left(rooms, b.room), b.room)
        by_room[b.room].append(b)

    for s, number, count in sorted(runs, reverse=True):
        while count:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = min(capacity // s, count)
                n = count // each
                fresh = Bin(n, capacity, [])
            else:
                fresh = by_room[rooms[i]].pop()
                each = min(fresh.room // s, count)
                n = min(fresh.n, count // each)
                if n < fresh.n:
                    by_room[fresh.room].append(Bin(fresh.n - n, fresh.room, _rest(fresh.content, n)))
                if not by_room[rooms[i]]:
                    del by_room[rooms.pop(i)]
            put(Bin(n, fresh.room - s * each, [*fresh.content, (s, number, each)]))
            number, count = number + n * each, count - n * each
    return [b for room in sorted(by_room) for b in by_room[room]]


def _rest(content: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The content of the sequences that follow the first n."""
    return [(s, number + n * m, m) for s, number, m in content]


def places(bins: list[Bin]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, end, a sequence's share, first sequence, offset), by first number."""
    out: dict[int, list] = {}
    sequence = 0
    for b in bins:
        offset = 0
        for s, number, m in b.content:
            out.setdefault(s, []).append((number, number + b.n * m, m, sequence, offset))
            offset += s * m
        sequence += b.n
    return {s: np.array(sorted(rows), np.int64) for s, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    salted = materialize(salted, "pieces")
    # At most capacity x salts counts, whatever the number of pieces.
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Win.partitionBy("length").orderBy("salt").rowsBetween(Win.unboundedPreceding, -1)), F.lit(0)))
    before = materialize(before, "counts")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = places(plan(histogram, capacity))
    order = Win.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(order)).join(before.drop("n"), ["length", "salt"]).withColumn("number", F.col("before") + F.col("row") - 1)

    if sum(map(len, planned.values())) > SENT:
        return joined(numbered, planned)
    shared = spark.sparkContext.broadcast(planned)

    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                rows = shared.value[int(s)]
                at = rows[np.searchsorted(rows[:, 0], number[own], "right") - 1]
                turn = number[own] - at[:, 0]
                sequence[own] = at[:, 3] + turn // at[:, 2]
                offset[own] = at[:, 4] + turn % at[:, 2] * s
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return numbered.select(*columns).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def joined(numbered: DataFrame, planned: dict[int, np.ndarray]) -> DataFrame:
    """The numbered pieces with sequence_id and offset, by a join with the plan's runs on length and bucket of numbers.

    A run stands in every bucket that it reaches, so there are as many rows as runs and, beyond that, one for each bucket.
    """
    spark = numbered.sparkSession
    names = ["first", "end", "share", "sequence", "place"]
    rows = pa.concat_tables([pa.table({"length": np.full(len(r), s), **{c: r[:, k] for k, c in enumerate(names)}}) for s, r in planned.items()])
    runs = materialize(spark.createDataFrame(rows), "runs")
    runs = runs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    met = numbered.withColumn("bucket", F.floor(F.col("number") / BUCKET)).join(runs, ["length", "bucket"]).where("number >= first and number < end")
    turn = F.col("number") - F.col("first")
    sequence, within = F.col("sequence") + F.floor(turn / F.col("share")), F.col("place") + turn % F.col("share") * F.col("length")
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), within.cast("long").alias("offset"))
