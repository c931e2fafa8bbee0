"""Benchmark decontamination: suffix arrays over the training text, searched for every test suffix.

Each shard of the documents sorts the suffixes of its word sequence. Every suffix
of every benchmark item is binary-searched there by its first words; the suffixes
in the ranges found are compared over the whole window length, by 128 bits that two
independent hashes make of its words. Runs of matching windows are the longest
verbatim matches, with their places in document and item; each item that has a window
has its own, and each place in it.

A window is `width` consecutive words of an item; an item with fewer words, but
at least one, is one window. A document is contaminated if a word of it lies in an
occurrence of a window and such words are at least `share` of its words.

Defined cases: null and empty texts have no words and no hits, on either side; a
repeated document or item is judged like its copy; items with equal ids count
once, and items without an id hit words but have no name to be listed by; empty tables give no rows (documents) or no hits (benchmark). `clean` keeps
every column of its input, whatever its name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import free_name, materialize, numbered

WIDTH = 13
#: Bytes of benchmark text that are sent to all executors at once; a larger benchmark takes one pass over the documents for each such block.
BLOCK_BYTES = 32 << 20
#: Words that the sort key of a suffix holds, 16 bits of each word's hash.
KEY_WORDS = 4
MATCHES = "array<struct<word: bigint, n_words: bigint, item_id: string, item_word: bigint>>"


@dataclass
class Suffixes:
    """Test suffixes, one for each window: its length and two hashes, sort key range, item and place in it; sorted by (length, hash)."""

    length: np.ndarray
    hash: np.ndarray
    check: np.ndarray
    low: np.ndarray
    high: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: list[str]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the number of words before each text."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.NOT_WORD)
    return W.span_hashes(data, starts, ends), W.span_hashes(data, starts, ends, 1), first


def sort_keys(hashes: np.ndarray) -> np.ndarray:
    """The first KEY_WORDS words from each position on as one number; words beyond the end count as 0."""
    key = np.zeros(len(hashes), W.U64)
    for j in range(KEY_WORDS):
        key[: max(len(hashes) - j, 0)] |= (hashes[j:] >> W.U64(48)) << W.U64(16 * (KEY_WORDS - 1 - j))
    return key


def suffixes(ids: list, texts: pa.Array, width: int = WIDTH) -> Suffixes:
    hashes, others, first = word_hashes(*W.buffer(texts))
    counts = np.diff(first)
    length = np.minimum(np.repeat(counts, counts), width)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    item = W.owners(first)
    key = sort_keys(hashes)
    # A word takes part as a window's first if the window ends within its item.
    keep = np.flatnonzero(place + length <= counts[item])
    length, item, place, key = length[keep], item[keep], place[keep], key[keep]
    h, check = np.zeros(len(keep), W.U64), np.zeros(len(keep), W.U64)
    for n in np.unique(length):
        own = length == n
        h[own] = W.span_hashes(hashes, keep[own], keep[own] + n)
        check[own] = W.span_hashes(others, keep[own], keep[own] + n, 1)
    free = W.U64(16) * (KEY_WORDS - np.minimum(length, KEY_WORDS)).astype(W.U64)
    low = (key >> free) << free
    high = low | ((W.U64(1) << free) - W.U64(1))
    order = np.lexsort((check, h, length))
    return Suffixes(length[order], h[order], check[order], low[order], high[order], item[order], place[order], list(ids))


def find(hashes: np.ndarray, others: np.ndarray, first: np.ndarray, tests: Suffixes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each window length: positions of matching windows, and the range of tests with that window."""
    if not len(hashes) or not len(tests.hash):
        return []
    key = sort_keys(hashes)
    order = np.argsort(key)  # the suffix array, as deep as the keys
    ranked = key[order]
    total_end = np.repeat(first[1:], np.diff(first))
    found = []
    for n in np.unique(tests.length):
        a, b = np.searchsorted(tests.length, [n, n + 1])
        low, where = np.unique(tests.low[a:b], return_index=True)
        high = tests.high[a:b][where]
        begin, end = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, high, "right")
        size = end - begin
        if not size.sum():
            continue
        inside = order[np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        inside = np.sort(inside[inside + n <= total_end[inside]])
        # Equal first hashes, then, among tests with one first hash (which are sorted by it), the second.
        h = W.span_hashes(hashes, inside, inside + n)
        inside = inside[np.isin(h, tests.hash[a:b])]
        if len(inside):
            pair = np.dtype([("h", W.U64), ("c", W.U64)])
            want, have = np.empty(len(inside), pair), np.empty(b - a, pair)
            want["h"], want["c"] = W.span_hashes(hashes, inside, inside + n), W.span_hashes(others, inside, inside + n, 1)
            have["h"], have["c"] = tests.hash[a:b], tests.check[a:b]
            lo, hi = (np.searchsorted(have, want, side) for side in ("left", "right"))
            hit = hi > lo
            if hit.any():
                found.append((inside[hit], lo[hit] + a, hi[hit] + a, int(n)))
    return found


def matches(hashes: np.ndarray, others: np.ndarray, first: np.ndarray, tests: Suffixes) -> tuple[list[set], list[list[dict]]]:
    """For each text: ids of the items with occurring windows, and the longest verbatim matches."""
    owner = W.owners(first)
    items: list[set] = [set() for _ in first[1:]]
    runs: list[list] = [[] for _ in first[1:]]
    for at, lo, hi, n in find(hashes, others, first, tests):
        # Every place in every item that has the window, in the order of what a longer match would go on with.
        size = hi - lo
        t = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        at = np.repeat(at, size)
        item, place = tests.item[t], tests.place[t]
        order = np.lexsort((at, at - place, item))
        at, item, place = at[order], item[order], place[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        heads = np.flatnonzero(fresh)
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
            doc, name = owner[at[i]], tests.ids[item[i]]
            if name is not None:
                items[doc].add(name)
            runs[doc].append({"word": int(at[i] - first[doc]), "n_words": int(n + j - i - 1), "item_id": name, "item_word": int(place[i])})
    return items, runs


def covered(runs: list[dict]) -> int:
    """Words in any of the runs."""
    total = end = 0
    for r in sorted(runs, key=lambda r: r["word"]):
        stop = r["word"] + r["n_words"]
        total += max(0, stop - max(end, r["word"]))
        end = max(end, stop)
    return total


def scan(documents: DataFrame, benchmark: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """row: the document's columns (without its text if so told), n_words, n_hit, items and matches.

    A benchmark of one block takes one pass. With more, each block is one pass that writes what it finds, and only
    that block is held while it runs; what was found is put together by row at last.
    """
    if not keep_text:
        documents = documents.select("doc_id", "text")
    first, *more = _counted(benchmark, width)
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    none = [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(MATCHES).alias("matches")]
    if not more:
        return _passed(documents.select(whole, *none), first(), keep_text)
    row = free_name(documents, "_row")
    rows = numbered(documents, row)
    found = None
    for block in (first, *more):
        own = _found(rows.select(F.col(row).alias("row"), "text"), block())
        found = materialize(own, "found") if found is None else found.unionAll(materialize(own, "found"))
    items, runs = free_name(rows, "_items"), free_name(rows, "_matches")
    each = found.groupBy(F.col("row").alias(row)).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias(items), F.flatten(F.collect_list("matches")).alias(runs))
    return _passed(rows.join(each, row, "left").select(whole, F.col(items).alias("items"), F.col(runs).alias("matches")), None, keep_text)


def _counted(benchmark: DataFrame, width: int) -> list[Callable[[], Suffixes]]:
    """For each block of the benchmark a function that makes its suffixes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))

    def make(k: int) -> Suffixes:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
        return suffixes(rows["item_id"].to_pylist(), pa.concat_arrays(rows["text"].chunks) if rows.num_rows else pa.array([], pa.string()), width)

    return [lambda k=k: make(k) for k in range(n)]


def _found(rows: DataFrame, tests: Suffixes) -> DataFrame:
    """row, items and matches of the rows (row, text) with a match."""
    shared = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches):
        kind = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())]))
        for part in W.chunks(batches):
            items, runs = matches(*word_hashes(*W.buffer(part.column("text"))), shared.value)
            hit = [k for k, r in enumerate(runs) if r]
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(hit, pa.int64())), pa.array([sorted(items[k]) for k in hit], pa.list_(pa.string())), pa.array([runs[k] for k in hit], kind)], names=["row", "items", "matches"])

    return rows.mapInArrow(run, f"row long, items array<string>, matches {MATCHES}")


def _passed(rows: DataFrame, tests: Suffixes | None, keep_text: bool) -> DataFrame:
    """rows (row, items, matches) with what `tests`, if any, has of them, counted."""
    shared = rows.sparkSession.sparkContext.broadcast(tests)
    row = rows.schema["row"].dataType
    kept = T.StructType([f for f in row.fields if keep_text or f.name != "text"])

    def run(batches):
        kinds = None
        for batch in batches:
            row = batch.column("row")
            fields = {row.type[i].name: row.field(i) for i in range(row.type.num_fields)}
            texts = pa.RecordBatch.from_arrays([fields["text"], pa.array(np.arange(batch.num_rows))], names=["text", "n"])
            kinds = kinds or (batch.schema.field("items").type, batch.schema.field("matches").type)
            for part in W.chunks(iter([texts])):
                here = batch.slice(part["n"][0].as_py(), part.num_rows)
                hashes, others, first = word_hashes(*W.buffer(part.column("text")))
                if shared.value is None:
                    items, runs = ([v or [] for v in here[c].to_pylist()] for c in ("items", "matches"))
                else:
                    items, runs = matches(hashes, others, first, shared.value)
                left = here.column("row")
                if not keep_text:
                    left = pa.StructArray.from_arrays([left.field(i) for i in range(left.type.num_fields) if left.type[i].name != "text"], names=[f.name for f in left.type if f.name != "text"])
                arrays = [left, pa.array([sorted(i) for i in items], kinds[0]), pa.array(runs, kinds[1]), pa.array(np.diff(first)), pa.array([covered(r) for r in runs], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "items", "matches", "n_words", "n_hit"])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", kept), rows.schema["items"], rows.schema["matches"]]).add("n_words", "long").add("n_hit", "long"))


def search(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items and matches of each document."""
    return scan(documents, benchmark, width, keep_text=False).select("row.doc_id", "n_words", "n_hit", "items", "matches")


def clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.05) -> DataFrame:
    """The rows of documents, all columns, that are not contaminated."""
    out = scan(documents, benchmark, width, keep_text=True)
    return out.where(~contaminated(share)).select("row.*")


def contaminated(share: float = 0.05) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words"))


