"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Every pair of a good and a poor labelled document is a preference for the good
one. A document's strength is linear in features of its bytes and words;
training minimises the logistic loss of strength differences over all pairs. The
strength at a quantile of the labelled documents becomes the threshold.

No pair is formed. The loss of a difference is smooth, so within a cell of
strengths it is a polynomial to some ten digits, and a cell's documents act on
all others through their sums at the cell's nodes. One pass over the labelled
documents gives those sums, and with them the loss and its slope over all pairs.

Defined cases: a null text counts as empty and is scored like any other; equal
texts get equal scores; an empty table gives no rows; without labels of both
kinds every strength is zero and every score is the threshold itself, so nothing
is rejected. Of several rows with one id the one with the largest features is
learned from, of several labels the larger. Columns beyond those named are never
looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import fold, materialize

#: Pairs that are compared in one go where they are formed.
PAIRS = 1_000_000
N_FEATURES = 34
#: Weight of the penalty on large weights.
PENALTY = 1e-4
#: Nodes in each cell of strengths of width 1, as parts of it, and what takes Chebyshev polynomials to weights of the nodes.
NODES = 10
_AT = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_TO_NODES = np.linalg.inv(chebvander(_AT, NODES - 1))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text; all are shares, means or logarithms, so length alone moves few of them."""
    n = np.diff(offsets).astype(float)
    at = n + 60  # a few odd characters in a short text are no sign of anything
    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), b" ", b"\n", b".,;:'\"-?()", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
        kinds[list(chars)] = k
    kind = kinds[data]
    share = [W.sums(kind == k, offsets) / at for k in range(1, 11)]
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    m = np.diff(first).astype(float)
    per = np.maximum(m, 1)
    hashes = W.span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    owner = W.owners(first)
    doc = W.mix(np.arange(len(n), dtype=W.U64) + W.U64(1))

    def distinct(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner[np.unique(keys + doc[owner], return_index=True)[1]], minlength=len(n))

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    triples, at3 = W.windows(hashes, first, 3)
    count3 = np.maximum(np.bincount(owner[at3], minlength=len(n)), 1)
    last, head = data[np.maximum(ends - 1, 0)], data[starts]
    mean = W.sums(length, first) / per
    lines = share[5] * n + 1
    more = [
        np.log1p(n),
        np.log1p(m),
        mean,
        np.sqrt(np.maximum(W.sums(length**2, first) / per - mean**2, 0)),
        distinct(hashes, owner) / np.sqrt(per),
        distinct(hashes, owner) / per,
        W.sums(same, first) / per,
        distinct(triples, owner[at3]) / count3,
        W.sums(kinds[last] >= 7, first) / per,
        W.sums(last == 0x2E, first) / per,
        W.sums(last == 0x2C, first) / per,
        W.sums(kinds[head] == 1, first) / per,
        W.sums(length == 1, first) / per,
        W.sums(length > 20, first) / per,
        np.log1p(n / lines),
        n == 0,
        m <= 5,
    ]
    base = np.column_stack(share + more).astype(float)
    bent = np.sqrt(base[:, [0, 2, 7, 8, 9, 16, 12]])
    return np.nan_to_num(np.hstack([base, bent]))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the strengths that become 0.3 and half-way points of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        """Between 0 and 1, rising with strength; cut where the strength is the threshold."""
        z = self.strength(x) - self.threshold + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Sums over pairs: their number, the loss, its gradient, and a matrix near its second derivatives with no negative direction.
Sums = tuple[float, float, np.ndarray, np.ndarray]


def formed_pairs(z: np.ndarray, good: np.ndarray, w: np.ndarray, pairs: int = PAIRS) -> Sums:
    """The sums with each pair formed, so many at a time."""
    up, low = z[good], z[~good]
    loss, slope, bend = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    size = max(pairs // max(len(low), 1), 1)
    for one in (up[k : k + size] for k in range(0, len(up), size)):
        against = (low @ w)[None] - (one @ w)[:, None]
        p = 1 / (1 + np.exp(-against))
        q = p * (1 - p)
        loss += np.logaddexp(0, against).sum()
        slope += p.sum(0) @ low - p.sum(1) @ one
        across = one.T @ q @ low
        bend += (one.T * q.sum(1)) @ one + (low.T * q.sum(0)) @ low - across - across.T
    return float(len(up) * len(low)), loss, slope, bend


def cell_sums(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each kind and cell of strengths: count and features at the cell's nodes, and products of features.

    The key is twice the cell's number, and one more for good rows.
    """
    s = z @ w
    cell = np.floor(s)
    key = 2 * cell.astype(np.int64) + good
    share = chebvander(2 * (s - cell) - 1, NODES - 1) @ _TO_NODES
    ones = np.column_stack([np.ones(len(z)), z])
    order = np.argsort(key, kind="stable")
    upper = np.triu_indices(z.shape[1])
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(rows):
            yield int(key[rows[0]]), np.concatenate([(share[rows].T @ ones[rows]).ravel(), (z[rows].T @ z[rows])[upper]])


def pairs_of_cells(cells: dict[int, np.ndarray], n: int) -> Sums:
    """The sums from what cell_sums gives, for n features. In the matrix all rows of a cell lie in its middle."""
    upper = np.triu_indices(n)

    def side(kind: int) -> tuple[np.ndarray, ...]:
        keys = sorted(k for k in cells if k % 2 == kind)
        cell = np.array([k // 2 for k in keys], float)
        flat = np.array([cells[k] for k in keys])
        nodes = flat[:, : NODES * (n + 1)].reshape(len(keys), NODES, n + 1)
        square = np.zeros((len(keys), n, n))
        square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = flat[:, NODES * (n + 1) :]
        return (cell[:, None] + (_AT + 1) / 2).ravel(), nodes.reshape(-1, n + 1), cell, nodes.sum(1), square

    (at1, up, cell1, up_cell, up_square), (at0, low, cell0, low_cell, low_square) = side(1), side(0)
    against = at0[None] - at1[:, None]
    p = np.exp(-np.logaddexp(0, -against))
    loss = up[:, 0] @ np.logaddexp(0, against) @ low[:, 0]
    slope = (up[:, 0] @ p) @ low[:, 1:] - (p @ low[:, 0]) @ up[:, 1:]
    p = np.exp(-np.logaddexp(0, cell1[:, None] - cell0[None]))
    q = p * (1 - p)
    across = up_cell[:, 1:].T @ q @ low_cell[:, 1:]
    bend = np.tensordot(q @ low_cell[:, 0], up_square, 1) + np.tensordot(up_cell[:, 0] @ q, low_square, 1) - across - across.T
    return float(up_cell[:, 0].sum() * low_cell[:, 0].sum()), float(loss), slope, bend


def least(sums: Callable[[np.ndarray], Sums], n: int, steps: int = 100) -> np.ndarray:
    """The n weights of least mean loss and penalty, by Newton's steps, halved until the loss does not grow."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        pairs, loss, slope, bend = sums(w)
        return loss / pairs + PENALTY / 2 * w @ w, slope / pairs + PENALTY * w, bend / pairs + PENALTY * np.eye(n)

    w = np.zeros(n)
    loss, slope, bend = at(w)
    for _ in range(steps):
        step = np.linalg.solve(bend, slope)
        if slope @ step < 1e-10:
            break
        new = at(w - step)
        while new[0] > loss + 1e-10 and np.abs(step).max() > 1e-9:
            step = step / 2
            new = at(w - step)
        w, (loss, slope, bend) = w - step, new
    return w


def near_rank(n: int, share: float) -> tuple[int, int]:
    """First and last of the ranks within a hundredth of n around the quantile."""
    i, reach = int(np.ceil(share * (n - 1))), max(n // 100, 1)
    return max(i - reach, 0), min(i + reach, n - 1)


def train(x: np.ndarray, good: np.ndarray, quantile: float | None = None, pairs: int = PAIRS) -> Ranking:
    """Fit strengths to all pairs of a good and a poor row, formed so many at a time: for rows that are few.

    quantile: the share of documents to reject; None takes the share of poor ones among the rows.
    """
    good = good.astype(bool)
    mean, scale = x.mean(0) if len(x) else np.zeros(N_FEATURES), (x.std(0) if len(x) else np.ones(N_FEATURES)) + 1e-6
    if not len(x) or good.all() or not good.any():
        return Ranking(mean, scale, np.zeros(len(mean)), 0.0)
    z = standard(x, mean, scale)
    w = least(lambda w: formed_pairs(z, good, w, pairs), len(mean))
    lo, hi = near_rank(len(x), (~good).mean() if quantile is None else quantile)
    near = np.sort(z @ w)[lo : hi + 1]
    j = int(np.argmax(np.diff(near)))
    return Ranking(mean, scale, w, float((near[j] + near[j + 1]) / 2))


def with_features(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep, and x: the features as an array."""
    schema = documents.select(*keep).withColumn("x", F.lit(None).cast("array<double>")).schema

    def run(batches):
        for part in W.chunks(batches):
            x = features(*W.buffer(part.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), flat], names=[*keep, "x"])

    return documents.select(*keep, "text").mapInArrow(run, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: int) -> DataFrame:
    """At most `most` labelled documents of each label outside the held-out fold: (doc_id, label, text).

    They are chosen by a hash of the id, so the choice is the same whenever it is made. The ids are at most
    2 * most, so they are sent to all executors. Of several rows with one id the largest text counts, once.
    """
    known = labels.where((F.col(label).isin(0, 1)) & (fold(F.col("doc_id"), folds) != left_out)).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    picked = None
    for value in (0, 1):
        one = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = one if picked is None else picked.unionAll(one)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def labelled_features(documents: DataFrame, labels: DataFrame, folds: int, left_out: int) -> DataFrame:
    """Every labelled document outside the held-out fold, once: (label, x). The features travel, not the texts."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    rows = with_features(documents.where(fold(F.col("doc_id"), folds) != left_out), "doc_id")
    return rows.join(known, "doc_id").groupBy("doc_id", "label").agg(F.max("x").alias("x")).select("label", "x")


def matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("x").flatten()).reshape(part.num_rows, -1)


def summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """What sums(x, good) gives by key for batches of rows, added up over all rows, in the same order each time."""

    def parts(batches):
        total: dict[int, np.ndarray] = {}
        for part in batches:
            if part.num_rows:
                for key, values in sums(matrix(part), np.asarray(part.column("label")).astype(bool)):
                    total[key] = total[key] + values if key in total else values
        n = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["key", "part", "x"])

    def whole(group: pa.Table) -> pa.Table:
        one = group.sort_by("part").combine_chunks().to_batches()[0]
        return pa.table({"key": one.column("key")[:1], "x": pa.array([matrix(one).sum(0)], pa.list_(pa.float64()))})

    by_part = rows.mapInArrow(parts, "key long, part long, x array<double>")
    found = by_part.groupBy("key").applyInArrow(whole, "key long, x array<double>").toArrow()
    return {k: np.asarray(v.values) for k, v in zip(found["key"].to_pylist(), found["x"], strict=True)}


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0, quantile: float | None = None) -> Ranking:
    """What train gives for the features of every labelled document outside the held-out fold."""
    rows = materialize(labelled_features(documents, labels, folds, left_out), "features")

    def counts(x: np.ndarray, good: np.ndarray):
        for kind in (0, 1):
            yield kind, np.append(x[good == kind].sum(0), (good == kind).sum())

    by_kind = summed(rows, counts)
    poor, n = by_kind[0][-1] if 0 in by_kind else 0, sum(c[-1] for c in by_kind.values())
    if not n:
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean = sum(c[:-1] for c in by_kind.values()) / n
    scale = np.sqrt(summed(rows, lambda x, _: iter([(0, ((x - mean) ** 2).sum(0))]))[0] / n) + 1e-6
    if poor in (0, n):
        return Ranking(mean, scale, np.zeros(N_FEATURES), 0.0)
    w = least(lambda w: pairs_of_cells(summed(rows, lambda x, good: cell_sums(standard(x, mean, scale), good, w)), N_FEATURES), N_FEATURES)

    def strengths(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array(standard(matrix(part), mean, scale) @ w)], names=["s"])

    s = materialize(rows.mapInArrow(strengths, "s double"), "strengths")
    lo, hi = near_rank(int(n), poor / n if quantile is None else quantile)
    return Ranking(mean, scale, w, widest_step(s, value_at(s, lo), value_at(s, hi)))


def cell_of(low: float, high: float, cells: int):
    """Which of so many equal cells from low to high the value s lies in."""
    return F.floor((F.col("s") - low) / ((high - low) / cells))


def value_at(values: DataFrame, rank: int, cells: int = 1024) -> float:
    """The value s that has rank values before it in rising order: its cell is cut into cells until it is alone."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while high - low > sys.float_info.min * cells:
        inside = values.where(F.col("s").between(low, high)).groupBy(cell_of(low, high, cells))
        for cell in sorted(inside.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect(), key=lambda r: r.low):
            if rank < cell.n:
                low, high = cell.low, cell.high
                break
            rank -= cell.n
    return low


def widest_step(values: DataFrame, low: float, high: float, cells: int = 4096) -> float:
    """The middle of the widest step between neighbouring values s from low to high, of equal ones the first."""
    if high - low <= sys.float_info.min * cells:
        return low
    inside = values.where(F.col("s").between(low, high)).distinct().withColumn("cell", cell_of(low, high, cells))
    steps = inside.withColumn("next", F.lead("s").over(Window.partitionBy("cell").orderBy("s")))
    order = F.struct(F.col("next") - F.col("s"), -F.col("s"))
    found = steps.groupBy("cell").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max_by(F.struct("s", "next"), order).alias("step")).collect()
    found.sort(key=lambda r: r.low)
    pairs = [(r.step.s, r.step.next) for r in found if r.step.next is not None] + [(a.high, b.low) for a, b in zip(found, found[1:], strict=False)]
    a, b = max(pairs, key=lambda p: (p[1] - p[0], -p[0]))
    return (a + b) / 2


def score(documents: DataFrame, ranking: Ranking, cut: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with score and predicted (1 if score >= cut) of each whole text."""
    schema = documents.select(*keep).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        for part in W.chunks(batches):
            s = ranking.score(features(*W.buffer(part.column("text"))), cut)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    columns = list(dict.fromkeys([*keep, "text"]))
    return documents.select(*columns).mapInArrow(run, schema)


def keep_good(documents: DataFrame, ranking: Ranking, cut: float = 0.3) -> DataFrame:
    """The rows of documents, all columns, whose score is at least cut."""

    def run(batches):
        for part in W.chunks(batches):
            yield part.filter(pa.array(ranking.score(features(*W.buffer(part.column("text"))), cut) >= cut))

    return documents.mapInArrow(run, documents.schema)
