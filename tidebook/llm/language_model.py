"""Language-model scoring: context-tree weighting over bytes.

A byte is eight binary decisions, one for each bit after those before it. Each
decision has a tree over the preceding bytes; a node counts the decisions taken in
its context, estimates by Krichevsky and Trofimov, and weighs its own estimate
against its children's, half and half before the data. The weighted mixture over
all depths predicts a text's bytes one by one, in lower case, from the counts of
all training documents; a context never met ends its path. The end of a text is a
byte that no text has. The code length per byte is the score over minus the length.

How it runs: documents lie in blocks. A block lists its different byte runs and
tokens with their training counts; lists are dealt by key, counts are added over
all blocks, the tree is built part by part, and each block gets the values of its own
keys back. A part holds whole subtrees below contexts of two bytes; contexts that a
sample finds in more than a part's share of the text are dealt by their third byte, and
if need be by their fourth. The few levels above are summed over the parts and pass
through the driver: 255 nodes for each context of one byte, and for each of those that
are dealt deeper. The number of parts grows with the text; a task reads the lists of a
part one after the other and holds only what they have in common.

Defined cases: a null text counts as empty, which is one end; repeated rows are
learned from and scored as often as they occur; an empty table gives no rows;
without training documents every decision has probability one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import fold, materialize

DEPTH = 5
#: Bytes of text in a block.
BLOCK = 13 << 19
#: Bytes of text for each part, while there are no more than MOST parts; beyond, parts grow as the root of the text.
PART, MOST = 8 << 20, 4096
#: Bytes of text of which the sample is taken that tells how contexts are dealt; it bears on no result.
SAMPLE = 64 << 20
#: A byte that UTF-8 never has, for the end of a text and for what precedes its start.
END = 0xFF
HALF = np.log(0.5)


# -- bytes and tokens of a block ---------------------------------------------------------------------------------


def byte_runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (context, byte) of the texts as sorted numbers, where each position's is, and each text's first position.

    In a number the nearest context byte comes first, the byte itself last. Each text has one position more than
    bytes: its end. Numbers are found by tables over what is there, one byte at a time, without sorting the text.
    """
    n, lengths = len(offsets) - 1, np.diff(offsets)
    first = offsets + np.arange(n + 1)
    stream = np.full(first[-1], END, np.uint8)
    stream[np.arange(len(data)) + W.owners(offsets)] = W.LOWER[data]
    since = (np.arange(len(stream)) - np.repeat(first[:-1], lengths + 1)).astype(np.int32)
    codes = np.zeros(256, np.int64)
    alphabet = np.flatnonzero(np.bincount(stream, minlength=256) > 0)
    if not len(alphabet):
        alphabet = np.array([END])
    codes[alphabet] = np.arange(len(alphabet))
    end = int(codes[END])
    coded = codes[stream].astype(np.int32)
    ids, keys = np.zeros(len(stream), np.int32), np.zeros(1, W.U64)
    for back in [*range(1, depth + 1), 0]:  # nearest first, the byte itself last
        byte = coded
        if back:
            byte = np.full(len(coded), end, np.int32)
            byte[back:] = coded[:-back] if back < len(coded) else coded[:0]
            byte[since < back] = end
        at = ids.astype(np.int64) * len(alphabet) + byte
        there = np.zeros(len(keys) * len(alphabet), bool)
        there[at] = True
        new = np.flatnonzero(there)
        place = np.zeros(len(there), np.int32)
        place[new] = np.arange(len(new), dtype=np.int32)
        ids = place[at]
        keys = (keys[new // len(alphabet)] << W.U64(8)) | alphabet[new % len(alphabet)].astype(W.U64)
    return keys, ids, stream, first


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens of the texts by their hash, which of them each token is, and each text's first token.

    A text's last token is its end, whose hash is 0.
    """
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    n = len(offsets) - 1
    stops = first + np.arange(n + 1)
    h = np.zeros(stops[-1], W.U64)
    h[np.arange(len(starts)) + W.owners(first)] = W.span_hashes(data, starts, ends) | W.U64(1)
    keys, ids = np.unique(h, return_inverse=True)
    return keys, ids, stops


# -- the tree ----------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x: Stirling's series after moving x beyond 8."""
    x = np.asarray(x, float).copy()
    moved = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        moved[small] -= np.log(x[small])
        x[small] += 1
    r = 1 / (x * x)
    return moved + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


_FEW = 64
_FEW_KT = _kt(*np.divmod(np.arange(_FEW * _FEW, dtype=float), _FEW))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones; small counts from a table."""
    few = (zeros < _FEW) & (ones < _FEW)
    out = _FEW_KT[np.where(few, zeros * _FEW + ones, 0).astype(np.int64)]
    if not few.all():
        out[~few] = _kt(zeros[~few], ones[~few])
    return out


class Tree:
    """Nodes below contexts of `top` bytes, for sorted numbers (context, byte) with counts.

    For each depth, from the deepest, and each bit: which node every number passes, the nodes' zeros and ones, the
    share of the weight that is a node's own, and the logarithm of its weighted probability.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
        self.keys, self.top = keys, top
        self.symbol = (keys & W.U64(255)).astype(np.int64)
        self.levels: list[list[tuple]] = []
        for d in range(depth, top - 1, -1):
            short, at = ((keys >> W.U64(8 * (depth - d + 1))) << W.U64(8)) | (keys & W.U64(255)), np.arange(len(keys))
            n = counts.astype(float)
            if d < depth:
                short, at = np.unique(short, return_inverse=True)
                n = np.bincount(at, weights=counts, minlength=len(short))
            self.levels.append([self._level(short, at, n, bit) for bit in range(8)])

    def _level(self, short: np.ndarray, at: np.ndarray, n: np.ndarray, bit: int) -> tuple:
        name = short >> W.U64(8 - bit)
        new = np.append(True, name[1:] != name[:-1])[: len(name)]
        size = int(new.sum())
        node = (np.cumsum(new) - 1)[at]
        where = np.cumsum(new) - 1
        one = ((short >> W.U64(7 - bit)) & W.U64(1)).astype(bool)
        zeros = np.bincount(where, weights=np.where(one, 0, n), minlength=size)
        ones = np.bincount(where, weights=np.where(one, n, 0), minlength=size)
        kt = log_kt(zeros, ones)
        if not self.levels:
            return node, zeros, ones, np.ones(size), kt
        child, _, _, _, weighted = self.levels[-1][bit]
        parent = np.zeros(len(weighted), np.int64)
        parent[child] = node
        below = np.bincount(parent, weights=weighted, minlength=size)
        both = np.logaddexp(HALF + kt, HALF + below)
        return node, zeros, ones, np.exp(HALF + kt - both), both

    def so_far(self, bit: int) -> np.ndarray:
        """The bits of each number's byte before this one, after a leading 1."""
        return (1 << bit) | (self.symbol >> (8 - bit))

    def above(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the part adds to the nodes of one context byte less than `top`: node (context and bits so far), zeros, ones, weighted below."""
        near = (self.keys >> W.U64(8 * (depth - self.top + 2))).astype(np.int64)
        parts = []
        for bit in range(8):
            node, zeros, ones, _, weighted = self.levels[-1][bit]
            place = np.zeros(len(zeros), np.int64)
            place[node] = near * 256 + self.so_far(bit)
            parts.append((place, zeros, ones, weighted))
        place, *each = (np.concatenate(x) for x in zip(*parts, strict=True))
        there, at = np.unique(place, return_inverse=True)
        return there, *(np.bincount(at, weights=x, minlength=len(there)) for x in each)


@dataclass
class Crown:
    """The levels above all parts, by number of context bytes from 0 on: nodes (context and bits so far), sorted, with
    zeros, ones and the share of the weight that is a node's own."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def crown(rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Crown:
    """From the parts' sums (node, zeros, ones, weighted below) by number of context bytes."""
    levels, up = [], tuple(np.zeros(0) for _ in range(4))
    for level in range(max(rows, default=1), -1, -1):
        node, *each = (np.concatenate(x) for x in zip(rows.get(level, tuple(np.zeros(0) for _ in range(4))), up, strict=True))
        there, at = np.unique(node.astype(np.int64), return_inverse=True)
        zeros, ones, below = (np.bincount(at, weights=x, minlength=len(there)) for x in each)
        kt = log_kt(zeros, ones)
        weighted = np.logaddexp(HALF + kt, HALF + below)
        levels.append((there, zeros, ones, np.exp(HALF + kt - weighted)))
        # One context byte less: the farthest goes, the bits so far stay.
        up = ((there >> 16) * 256 + (there & 255), zeros, ones, weighted)
    return Crown(levels[::-1])


def predict(keys: np.ndarray, counts: np.ndarray, c: Crown, depth: int = DEPTH, top: int = 2) -> np.ndarray:
    """log10 of the probability of the byte in its context, for each number."""
    tree = Tree(keys, counts, depth, top)
    total = np.zeros(len(keys))
    for bit in range(8):
        one = ((tree.symbol >> (7 - bit)) & 1).astype(bool)
        q = np.full(len(keys), np.nan)
        path = [lv[bit][:4] for lv in tree.levels]
        for level in range(top - 1, -1, -1):
            nodes, *rest = c.levels[level]
            context = (keys >> W.U64(8 * (depth - level + 1))).astype(np.int64)
            path.append((np.searchsorted(nodes, context * 256 + tree.so_far(bit)), *rest))
        for node, zeros, ones, own in path:
            kt = ((np.where(one, ones[node], zeros[node])) + 0.5) / ((zeros + ones)[node] + 1)
            q = np.where(np.isnan(q), kt, own[node] * kt + (1 - own[node]) * q)
            q[(zeros + ones)[node] == 0] = np.nan  # a context never met ends the path above it
        total += np.log10(np.where(np.isnan(q), 0.5, q))
    return total


# -- the jobs ----------------------------------------------------------------------------------------------------

TEXT, TOKENS, RUNS = 0, 1, 2
LISTS = "block long, kind int, part int, a binary, b binary"


def squeeze(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), level)


def spread(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def pack(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on, which take less room together."""
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T, 3)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(spread(blob, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return pack(np.diff(keys, prepend=W.U64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, W.U64), dtype=W.U64)


@dataclass(frozen=True)
class Deal:
    """How keys are dealt. heavy: sorted contexts of two bytes, then of three, whose byte runs are dealt by one byte more.

    Part k * parts and those after it hold the subtrees below contexts of 2 + k bytes.
    """

    parts: int
    depth: int = DEPTH
    heavy: tuple[np.ndarray, ...] = ()

    def place(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The part of each key; tokens are dealt by hash."""
        if kind == TOKENS:
            return (W.mix(keys) % W.U64(self.parts)).astype(np.int64)
        deep, name = np.zeros(len(keys), np.int64), keys >> W.U64(8 * (self.depth - 1))
        for k, heavy in enumerate(self.heavy):
            more = (deep == k) & np.isin(keys >> W.U64(8 * (self.depth - 1 - k)), heavy)
            name = np.where(more, keys >> W.U64(8 * (self.depth - 2 - k)), name)
            deep[more] += 1
        return deep * self.parts + (W.mix(name) % W.U64(self.parts)).astype(np.int64)

    def top(self, part: int) -> int:
        return 2 + part // self.parts


def deal(documents: DataFrame, depth: int) -> Deal:
    """As many parts as the text needs; contexts are heavy that take more than two parts' share of a sample of the texts."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(size / PART)
    n = n if n <= MOST else math.ceil(math.sqrt(n * MOST))
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    names = "bytes int, context long, n long"

    def run(batches):
        for part in W.gathered(batches):
            keys, at, _, _ = byte_runs(*W.buffer(part.column("text")), 3)
            counts = np.bincount(at, minlength=len(keys))
            for length in (2, 3):
                context, where = np.unique(keys >> W.U64(8 * (4 - length)), return_inverse=True)
                total = np.bincount(where, weights=counts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(context), length, np.int32)), pa.array(context.astype(np.int64)), pa.array(total)], names=["bytes", "context", "n"])

    some = documents.where(F.pmod(F.xxhash64("text"), F.lit(max(1, size // SAMPLE))) == 0).select("text")
    seen = some.mapInArrow(run, names).groupBy("bytes", "context").agg(F.sum("n").alias("n"))
    total = seen.where("bytes = 2").agg(F.sum("n").alias("total"))
    rows = seen.join(F.broadcast(total)).where(F.col("n") * parts > 2 * F.col("total")).collect()  # at most `parts`
    heavy = tuple(np.array(sorted(r.context for r in rows if r.bytes == length), W.U64) for length in (2, 3))
    return Deal(parts, depth, heavy[: max(depth - 2, 0)])


def _lists(batch: pa.RecordBatch, number: int, left_out: int, how: Deal):
    data, offsets = W.buffer(batch.column("text"))
    rest = batch.column("rest").fill_null(left_out).to_numpy()
    learn = rest != left_out
    ids = batch.column("doc_id")
    about = np.concatenate([ids.fill_null(0).to_numpy().astype(np.int64), np.asarray(ids.is_null()).astype(np.int64), learn.astype(np.int64), offsets])
    rows = [(number, TEXT, -1, squeeze(data, 6), squeeze(about))]
    for kind in (TOKENS, RUNS):
        keys, at, first = _found(kind, data, offsets, how.depth)
        counts = np.bincount(at[learn[W.owners(first)]], minlength=len(keys))
        for p, own in _by_part(how.place(keys, kind)):
            rows.append((number, kind, p, pack_keys(keys[own]), pack(counts[own].astype(np.uint32))))
    return rows


def _by_part(part: np.ndarray):
    """Each part and the places of its keys, in order."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
        yield int(part[order[a]]), order[a:b]


def _found(kind: int, data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of a kind in the texts, which one each position has, and each text's first position."""
    if kind == TOKENS:
        return tokens(data, offsets)
    keys, at, _, first = byte_runs(data, offsets, depth)
    return keys, at, first


def lists(documents: DataFrame, folds: int, left_out: int, how: Deal, block: int = BLOCK) -> DataFrame:
    """LISTS: each block's texts (kind TEXT), and its different tokens and byte runs with training counts, by part."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), fold(F.col("doc_id"), folds).cast("int").alias("rest"))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, batch in enumerate(W.gathered(batches, size=block)):
            made = _lists(batch, (task << 24) | k, left_out, how)
            for i in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in made[i : i + 64]], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "kind", "part", "a", "b"])

    return rows.mapInArrow(run, LISTS)


class Counts:
    """Sorted keys with counts, to which lists are added; those that wait are merged once they outweigh what is there."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, W.U64), np.zeros(0), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(2 * len(self.keys), 1 << 20):
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting, strict=True))
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts, self.waiting, self.size = np.bincount(at, weights=counts, minlength=len(self.keys)), [], 0


def counted(found: DataFrame, how: Deal) -> DataFrame:
    """kind, part, a (keys), b (counts): over all blocks."""
    names = ["kind", "part", "a", "b"]

    def run(batches):
        own, total = None, Counts()

        def out():
            total.merge()
            return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([pack_keys(total.keys)], pa.binary()), pa.array([pack(total.counts)], pa.binary())], names=names)

        for batch in batches:
            for kind, part, a, b in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if own not in (None, (kind, part)):
                    yield out()
                    total = Counts()
                own = kind, part
                total.add(unpack_keys(a), unpack(b, np.uint32))
        if own:
            yield out()

    rows = found.select(*names).repartition(how.parts, "kind", "part").sortWithinPartitions("kind", "part")
    return materialize(rows.mapInArrow(run, "kind int, part int, a binary, b binary"), "counts")


def top_of(counts: DataFrame, how: Deal) -> Crown:
    names = ["level", "node", "zeros", "ones", "below"]

    def run(batches):
        for batch in batches:
            for part, a, b in zip(*(batch[c].to_pylist() for c in ("part", "a", "b")), strict=True):
                tree = Tree(unpack_keys(a), unpack(b, np.float64), how.depth, how.top(part))
                node, *each = tree.above(how.depth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree.top - 1, np.int32)), pa.array(node), *map(pa.array, each)], names=names)

    each = counts.where(F.col("kind") == RUNS).select("part", "a", "b").mapInArrow(run, "level int, node long, zeros double, ones double, below double")
    sums = each.groupBy("level", "node").agg(*(F.sum(c).alias(c) for c in names[2:])).toArrow()  # at most 65,536 + 255 * 2 * parts
    columns = [np.asarray(sums[c].combine_chunks()) for c in names]
    return crown({int(k): tuple(x[columns[0] == k] for x in columns[1:]) for k in np.unique(columns[0])})


def values(counts: DataFrame, top: Crown, how: Deal) -> DataFrame:
    """LISTS with block -1: keys and a token's training count, or a byte run's log10 probability."""
    shared = counts.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        for batch in batches:
            out = []
            for kind, part, a, b in zip(*(batch[c].to_pylist() for c in ("kind", "part", "a", "b")), strict=True):
                n = unpack(b, np.float64)
                out.append(pack(n if kind == TOKENS else predict(unpack_keys(a), n, shared.value, how.depth, how.top(part))))
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(out), pa.int64()), batch["kind"], batch["part"], batch["a"], pa.array(out, pa.binary())], names=["block", "kind", "part", "a", "b"])

    return counts.mapInArrow(run, LISTS)


def answers(found: DataFrame, known: DataFrame, how: Deal) -> DataFrame:
    """LISTS: b holds, for each block's list, the values of its keys in their order."""
    names = ["block", "kind", "part", "a", "b"]

    def run(batches):
        keys = value = None
        for batch in batches:
            rows = []
            for block, kind, part, a, b in zip(*(batch[c].to_pylist() for c in names), strict=True):
                own = unpack_keys(a)
                if block < 0:
                    keys, value = own, unpack(b, np.float64)
                else:
                    rows.append((block, kind, part, b"", pack(value[np.searchsorted(keys, own)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    asked = found.select("block", "kind", "part", "a", F.lit(None).cast("binary").alias("b"))
    rows = asked.unionByName(known).repartition(how.parts, "kind", "part").sortWithinPartitions("kind", "part", "block")
    return rows.mapInArrow(run, LISTS)


def _scored(group: pa.Table, how: Deal, n_all: float, n_different: float) -> pa.Table:
    rows = {(k, p): (a, b) for k, p, a, b in zip(*(group[c].to_pylist() for c in ("kind", "part", "a", "b")), strict=True)}
    text, about = rows[TEXT, -1]
    data, about = spread(text, np.uint8), spread(about, np.int64)
    n = (len(about) - 1) // 4
    ids, null, offsets = about[:n], about[n : 2 * n] > 0, about[3 * n :]
    out = {}
    for kind in (TOKENS, RUNS):
        keys, at, first = _found(kind, data, offsets, how.depth)
        value = np.zeros(len(keys))
        for p, own in _by_part(how.place(keys, kind)):
            value[own] = unpack(rows[kind, p][1], np.float64)
        out[kind] = value[at], first
    c, first = out[TOKENS]
    base = np.log10((c + 0.5) / (n_all + 0.5 * (n_different + 1)))
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=null),
            "n_tokens": np.diff(first).astype(np.int64),
            "n_known": W.sums(c > 0, first),
            "train_tokens": np.full(n, int(n_all), np.int64),
            "base_score": W.sums(base, first),
            "n_bytes": np.diff(offsets).astype(np.int64),
            "score": W.sums(*out[RUNS]),
        }
    )


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, n_bytes long, score double"


def score(documents: DataFrame, folds: int = 5, left_out: int = 1, depth: int = DEPTH, how: Deal | None = None) -> DataFrame:
    """SCORES of every document, learned from those outside the fold left out.

    score: log10 of the model's probability of the text. base_score: the same by tokens alone. how: the deal, which
    bears on no result.
    """
    deals = how or deal(documents, depth)
    every = materialize(lists(documents, folds, left_out, deals), "lists", partition_by="kind").select("block", "kind", "part", "a", "b")
    texts, found = every.where(F.col("kind") == TEXT), every.where(F.col("kind") != TEXT)
    counts = counted(found, deals)

    def total(batches):
        for batch in batches:
            each = [unpack(b, np.float64) for b in batch["b"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.sum() for x in each], pa.float64()), pa.array([float((x > 0).sum()) for x in each], pa.float64())], names=["n", "v"])

    sums = counts.where(F.col("kind") == TOKENS).select("b").mapInArrow(total, "n double, v double").agg(F.sum("n"), F.sum("v")).first()
    n_all, n_different = sums[0] or 0.0, sums[1] or 0.0
    known = values(counts, top_of(counts, deals), deals)
    return texts.unionByName(answers(found, known, deals)).groupBy("block").applyInArrow(lambda g: _scored(g, deals, n_all, n_different), SCORES)
