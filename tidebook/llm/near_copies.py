"""Near copies by word shingles: every two texts whose sets of 5-word shingles have a Jaccard likeness of 0.8 or more.

Texts with equal sets are one node, named by a hash of the set. SimHash comes first:
fingerprints of the sets go through the byte-position index of `simhash`, whose pairs
are verified on the shingles themselves. It joins most copies, but a likeness of 0.8
moves up to ten of 64 bits, which no number of shared bytes bounds. The rest is found by
an index that does have such a bound. If two sets of n and m shingles are that alike,
at least 0.8 n and 0.8 m of them are common, so in any one order of all shingles the
first n - ceil(0.8 n) + 1 of one and as many of the other have one in common. The
index lists nodes by those; what is alone in its list goes. The order puts shingles
last that a sample of the texts often has, which keeps lists short; whatever the
sample says, no pair is lost.

In a list, pairs are told apart by a fingerprint of 512 bits, each the parity of
the shingles that fall on it: it differs in no more bits than the sets do in
shingles, and likeness 0.8 means that they differ in at most (n + m) / 9. For long
texts that says little, so pairs are told apart once more by fingerprints of n bits or
more before they are sent any text. What passes is verified. First each node is held against one other of its list, then
each against the nearest of every other part that links have not joined to its
own, then against all that are still in other parts; so a large group of copies is
joined before its pairs are looked at.

Defined cases: as in `simhash`: words between spaces, ASCII letters in lower case;
fewer words than a shingle make one of all; null and empty texts have none and are
copies of one another; `keep_one` keeps one of repeated rows, and a row without
doc_id only where no other of its group has one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .simhash import first_row, links as simhash_links
from .tables import free_name, materialize, numbered

SHINGLE = 5
#: Of a fingerprint, in words of 64 bits.
WIDTH = 8
#: The bits of a byte, each in a byte of its own.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(W.U64).ravel()
#: One text of so many is in the sample; shingles seen there so often come last, at most so many (the most frequent).
SAMPLE, OFTEN, LAST = 16, 4, 100_000


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's different shingles end to end, and where each text's begin."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    hashes = W.span_hashes(data, starts, ends)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    owner = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    h = W.span_hashes(hashes, at, np.minimum(at + width, first[1:][owner]))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(count) + 1))


def parities(h: np.ndarray, edge: np.ndarray, width: np.ndarray) -> np.ndarray:
    """End to end, width words of 64 bits for each set (powers of two): the parity of the hashes that fall on each bit."""
    owner = W.owners(edge)
    bits = W.mix(h) & (64 * width - 1).astype(W.U64)[owner]
    out = np.zeros(width.sum(), W.U64)
    np.bitwise_xor.at(out, (np.cumsum(width) - width)[owner] + (bits >> W.U64(6)).astype(np.int64), W.U64(1) << (bits & W.U64(63)))
    return out


def majorities(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """SimHash of each set: bit i is 1 if it is set in over half of the hashes."""
    n = np.diff(edge)
    # Of 255 hashes at most, the counts of eight bits fit the eight bytes of one number.
    blocks = -(-n // 255)
    before = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(n)), blocks)
    at = edge[:-1][owner] + 255 * (np.arange(len(owner)) - before[owner])
    total = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        data = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts = np.add.reduceat(LANES[data[:, k]], at).view(np.uint8).reshape(-1, 8)
            total[full, 8 * k : 8 * k + 8] = np.add.reduceat(counts.astype(np.int64), before[full], axis=0)
    return np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(W.U64).ravel()


def _sets(documents: DataFrame, row: str) -> DataFrame:
    """row, doc_id, node, n, sim (SimHash), fp, the parities as bytes, and wide, those of as many bits as there are shingles (null: no more than in fp)."""

    def run(batches):
        for part in W.chunks(batches):
            h, edge = shingles(*W.buffer(part.column("text")))
            node = W.span_hashes(h, edge[:-1], edge[1:]).view(np.int64)
            n = np.diff(edge)
            fp = pa.array([x.tobytes() for x in parities(h, edge, np.full(len(n), WIDTH)).reshape(-1, WIDTH)], pa.binary())
            width = 1 << np.ceil(np.log2(np.maximum(-(-n // 64), WIDTH))).astype(np.int64)
            wide = np.split(parities(h, edge, width), np.cumsum(width)[:-1])
            wide = pa.array([x.tobytes() if len(x) > WIDTH else None for x in wide], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(node), pa.array(n), pa.array(majorities(h, edge).view(np.int64)), fp, wide], names=["row", "doc_id", "node", "n", "sim", "fp", "wide"])

    rows = documents.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, node long, n long, sim long, fp binary, wide binary")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes with equal or linked SimHash: each with the first of its SimHash, and those along the links."""
    first = materialize(nodes.groupBy("sim").agg(F.min("node").alias("first")), "simhashes")
    same = nodes.join(first, "sim").where("node <> first").select("node", "first")
    near = simhash_links(first.select(F.col("sim").alias("fp")))
    ends = [first.select(F.col("sim").alias(c), F.col("first").alias(f"at_{c}")) for c in ("a", "b")]
    linked = near.join(ends[0], "a").join(ends[1], "b").select(F.col("at_a").alias("node"), F.col("at_b").alias("first"))
    both = same.unionAll(linked)
    return both.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def _often(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and how often they are there."""

    def run(batches):
        for part in W.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(*W.buffer(part.column("text")))[0].view(np.int64))], names=["h"])

    seen = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c"))
    rows = seen.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "h").limit(LAST).collect()
    h, c = np.array([r.h for r in rows], np.int64).view(W.U64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _index(texts: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, node: each node under the shingles that come first in it, without those that only one node has."""

    def first(batches):
        known, times = often
        for part in W.chunks(batches):
            h, edge = shingles(*W.buffer(part.column("text")))
            owner, n = W.owners(edge), np.diff(edge)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, times[at], 0)
            order = np.lexsort((h, rank, owner))
            place = np.arange(len(h)) - edge[:-1][owner]
            kept = order[place < (n - (4 * n + 4) // 5 + 1)[owner]]
            node = part.column("node").to_numpy()[owner[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(node)], names=["h", "node"])

    def shared(batches):
        held = np.zeros((0, 2), np.int64)

        def some(rows):
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(rows) else rows
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["h", "node"])

        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in ("h", "node")])])
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                yield some(rows[:cut])
                held = rows[cut:]
        yield some(held)

    rows = texts.select("node", "text").mapInArrow(first, "h long, node long")
    return rows.repartition("h").sortWithinPartitions("h", "node").mapInArrow(shared, "h long, node long")


def _near(n: np.ndarray, fp: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Those of js whose size and fingerprint leave a likeness of 0.8 to i possible."""
    both = n[js] + n[i]
    js = js[9 * np.abs(n[js] - n[i]) <= both]
    return js[9 * np.bitwise_count(fp[js] ^ fp[i]).sum(1, dtype=np.int64) <= n[js] + n[i]]


FIRST, BEST, EVERY = range(3)
#: Lists of no more nodes are gone through together.
SHORT = 32


def _short(h: np.ndarray, n: np.ndarray, fp: np.ndarray, part: np.ndarray, what: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of short lists, as `_pairs` has them: each row with the one d places on, for every d."""
    leads = np.concatenate([[True], h[1:] != h[:-1]])
    found = []
    for d in range(1, SHORT):
        i = np.flatnonzero(h[d:] == h[:-d])
        if not len(i):
            break
        i = i[leads[i]] if what == FIRST else i[part[i] != part[i + d]]
        both = n[i] + n[i + d]
        far = np.maximum(np.abs(n[i] - n[i + d]), np.bitwise_count(fp[i] ^ fp[i + d]).sum(1, dtype=np.int64))
        good = 9 * far <= both
        found.append((i[good], i[good] + d, far[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
    if what == BEST:
        order = np.lexsort((far, part[j], i))
        i, j = i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (part[j[1:]] != part[j[:-1]])
        i, j = i[new], j[new]
    return i, j


def _pairs(lists: DataFrame, what: int) -> DataFrame:
    """Pairs (a, b), a < b, of lists (h, node, n, fp, part): FIRST of each list with the others, of each node with the BEST of each other part, or EVERY two of different parts."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def found(table):
            h, node, n, part = (table.column(c).to_numpy() for c in ("h", "node", "n", "part"))
            fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), W.U64).reshape(-1, WIDTH)
            edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            long = np.diff(edge) > SHORT
            rows = np.flatnonzero(~np.repeat(long, np.diff(edge)))
            i, j = _short(h[rows], n[rows], fp[rows], part[rows], what)
            a, b, size = [node[rows[i]]], [node[rows[j]]], len(i)
            for s, e in zip(edge[:-1][long].tolist(), edge[1:][long].tolist(), strict=True):
                js, turns = np.arange(s, e), 1
                if what != FIRST:
                    # The largest part comes last, and its nodes need no turn of their own.
                    own, at, sizes = np.unique(part[s:e], return_inverse=True, return_counts=True)
                    js = js[np.argsort(at == np.argmax(sizes), kind="stable")]
                    turns = e - s - int(sizes.max())
                for k in range(min(turns, e - s - 1)):
                    i, near = js[k], js[k + 1 :]
                    near = _near(n, fp, i, near if what == FIRST else near[part[near] != part[i]])
                    if what == BEST and len(near) > 1:
                        far = np.bitwise_count(fp[near] ^ fp[i]).sum(1, dtype=np.int64)
                        order = np.lexsort((far, part[near]))
                        near = near[order[np.unique(part[near][order], return_index=True)[1]]]
                    if len(near):
                        a.append(np.full(len(near), node[i]))
                        b.append(node[near])
                        size += len(near)
                        if size > 1 << 18:
                            yield out(a, b)
                            a, b, size = [], [], 0
            yield out(a, b)

        def out(a, b):
            x, y = np.concatenate(a), np.concatenate(b)
            rows = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return lists.select("h", "node", "n", "fp", "part").repartition("h").sortWithinPartitions("h", "node").mapInArrow(run, "a long, b long").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and wide fingerprints leave a likeness of 0.8 possible."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            differ = np.abs(na - nb)
            for k, (fa, fb) in enumerate(zip(batch.column("fa"), batch.column("fb"), strict=True)):
                x, y = (np.frombuffer(f.as_buffer(), W.U64) for f in (fa, fb))
                # A longer one folds to the shorter's width.
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(f.reshape(-1, width)) for f in (x, y))
                differ[k] = max(differ[k], np.bitwise_count(x ^ y).sum(dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(9 * differ <= na + nb))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("wide", "fp").alias(f"f{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles have a likeness of 0.8 or more."""
    pairs = materialize(_likely(pairs, nodes), "likely")
    # Only texts that have a pair travel.
    texts = materialize(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "met")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                ha, ea = shingles(*W.buffer(part.column("ta")))
                hb, eb = shingles(*W.buffer(part.column("tb")))
                common = np.array([len(np.intersect1d(ha[ea[i] : ea[i + 1]], hb[eb[i] : eb[i + 1]], assume_unique=True)) for i in range(part.num_rows)], np.int64)
                good = pa.array(5 * common >= 4 * (np.diff(ea) + np.diff(eb) - common))
                yield part.select(["a", "b"]).filter(good)

    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _components(documents: DataFrame, row: str) -> DataFrame:
    """row, doc_id and part of each row of documents: the same part for those that links join."""
    marked = materialize(_sets(documents, row), "sets")
    nodes = materialize(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("fp").alias("fp"), F.first("wide").alias("wide")), "nodes")
    # Sets of fewer than four are alike only if they are equal.
    large = nodes.where("n >= 4")
    texts = documents.select(F.col(row).alias("row"), "text").join(large.select("row", "node"), "row").select("node", "text")
    texts = materialize(texts, "texts")
    index = materialize(_index(texts, _often(texts)), "index")
    lists = index.join(large.select("node", "n", "fp"), "node")
    tried = materialize(_by_simhash(large).unionAll(_pairs(lists.withColumn("part", F.lit(0).cast("long")), FIRST)).distinct(), "pairs")
    links = materialize(_verified(tried, large, texts), "links")
    for what in (BEST, EVERY):
        parts = materialize(connected_components(links), "parts").withColumnRenamed("component", "part")
        rest = lists.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        # A list of one part has no pair left.
        left = rest.groupBy("h").agg((F.min("part") < F.max("part")).alias("open")).where("open").select("h")
        more = materialize(_pairs(rest.join(left, "h", "left_semi"), what).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(links.unionAll(_verified(more, large, texts)), "links")
        tried = tried.unionAll(more)
    parts = materialize(connected_components(links), "parts").withColumnRenamed("component", "part")
    return marked.join(parts, "node", "left").select("row", "doc_id", F.coalesce("part", "node").alias("part"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links lead to, of each row."""
    row = free_name(documents, "_row")
    found = materialize(_components(numbered(documents.select("doc_id", "text"), row), row), "components")
    return found.join(found.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("doc_id", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, all columns as they were."""
    row = free_name(documents, "_row")
    rows = numbered(documents, row)
    first = first_row(_components(rows, row), "row", "part").withColumnRenamed("row", row)
    return rows.join(first, row, "left_semi").select(*(F.col(f"`{c}`") for c in documents.columns))
