"""Substring dedup by recompression: long passages that occur before are removed, wherever they occur again.

Recompression replaces runs of one word, then pairs of neighbours, by new symbols,
in rounds; a pair is one whose left part falls in one half of the alphabet and the
right part in the other. A symbol's name is a hash of what it stands for, so names
agree over the whole corpus without asking anyone, and equal passages have equal
symbols but for a few at their ends. How far from a symbol the text can change it
is tracked with it (its context).

Symbols are counted over the corpus together with the words of their context, on
which they depend alone. A window that holds one which occurs once is no repeat.
Symbols in a row whose first occurrences lie in a row too, at one place, verify a
passage of any length at once. Only windows that neither settles, which are the first occurrence of what is
repeated and the ends of passages, are compared one by one, by 128 bits that two
independent hashes make of the words. Symbols have 64 bits: of n different ones about
n^2 / 2^65 pairs share a name by chance, and only a passage all of whose symbols do so at
one shift would be taken for another.

Windows are judged on the input, not on what is left. Defined cases: null and
empty texts have no words; texts shorter than a window lose nothing; rows with one
doc_id are copies of one document, and a place in it is not before itself; rows
without doc_id are kept whole and are nobody's earlier occurrence; an empty table
gives no rows. Columns beyond doc_id and text are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import join_hot, materialize

WINDOW = 20
#: After so many rounds a symbol stands for 3 to 4 words and, with its context, for about 10.
ROUNDS = 4
#: Shorter symbols are not counted: nearly every window holds a longer one.
LEAST = 3


@dataclass
class Symbols:
    """Of all texts in a batch, in order: name, first word, end, first word and end of the context, text.

    A context that reaches beyond its text ends outside of it, so that no window holds it.
    """

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    context_low: np.ndarray
    context_high: np.ndarray
    text: np.ndarray


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol is its text's first or last, and how far the context of the one before and after it reaches."""
    n = len(s.name)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = last[:-1] = s.text[1:] != s.text[:-1]
    before, after = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    return first, last, np.where(first, s.low - 1, s.context_low[before]), np.where(last, s.high + 1, s.context_high[after])


def runs(s: Symbols) -> Symbols:
    """Each maximal run of one symbol becomes a symbol. Both neighbours belong to the context: they end the run."""
    n = len(s.name)
    first, last, reach_low, reach_high = _neighbours(s)
    begins = first.copy()
    begins[1:] |= s.name[1:] != s.name[:-1]
    a = np.flatnonzero(begins)
    b = np.append(a[1:], n) - 1
    k = (b - a + 1).astype(W.U64)
    name = np.where(k > 1, W.mix(s.name[a] + W.mix(k)), s.name[a])
    return Symbols(name, s.low[a], s.high[b], np.minimum(s.context_low[a], reach_low[a]), np.maximum(s.context_high[b], reach_high[b]), s.text[a])


def pairs(s: Symbols, turn: int) -> Symbols:
    """Each left symbol with the right symbol after it becomes one. What stays alone has the neighbour that it could have joined in its context."""
    right = (W.mix(s.name + W.U64(turn + 1)) & W.U64(1)).astype(bool)
    first, last, reach_low, reach_high = _neighbours(s)
    joins = np.zeros(len(s.name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
    after = np.minimum(np.arange(len(s.name)) + 1, max(len(s.name) - 1, 0))
    name = np.where(joins, W.mix(s.name * W.U64(3) + W.mix(s.name[after] + W.U64(turn))), s.name)
    low = np.where(right, np.minimum(s.context_low, reach_low), s.context_low)
    low = np.where(joins, np.minimum(low, s.context_low[after]), low)
    high = np.where(right, s.context_high, np.maximum(s.context_high, reach_high))
    taken = np.zeros(len(s.name), bool)
    taken[1:] = joins[:-1]
    keep = ~taken
    return Symbols(name[keep], s.low[keep], np.where(joins, s.high[after], s.high)[keep], low[keep], high[keep], s.text[keep])


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    at = np.arange(len(hashes))
    s = Symbols(hashes, at, at + 1, at, at + 1, W.owners(first))
    if len(hashes):
        s = runs(s)
        for turn in range(rounds):
            s = pairs(s, turn)
    return s


def _words(column: pa.Array, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.buffer(column)
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    return W.span_hashes(data, starts, ends, which), first


def anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> Symbols:
    """The symbols to count: of some length, with a context that a window can hold. The name covers the context."""
    s = recompress(hashes, first)
    base, end = first[:-1][s.text], first[1:][s.text]
    keep = (s.high - s.low >= LEAST) & (s.context_low >= base) & (s.context_high <= end) & (s.context_high - s.context_low <= window)
    s = Symbols(*(x[keep] for x in (s.name, s.low, s.high, s.context_low, s.context_high, s.text)))
    place = (s.low - s.context_low) * (window + 1) + s.high - s.low
    s.name = W.mix(W.span_hashes(hashes, s.context_low, s.context_high) + W.mix(place.astype(W.U64)))
    return s


def occurrences(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """name, doc_id, low of every symbol that counts."""

    def run(batches):
        for part in W.chunks(batches):
            hashes, first = _words(part.column("text"))
            s = anchors(hashes, first, window)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[s.text]
            base = first[:-1][s.text]
            yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), pa.array(ids), pa.array((s.low - base).astype(np.int32))], names=["name", "doc_id", "low"])

    return documents.where("doc_id is not null").mapInArrow(run, "name long, doc_id long, low int")


def repeated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, low, from_doc, from_low: symbols that occur more than once, with their first occurrence.

    The counts alone go first; only what is repeated goes on with its places.
    """
    counts = occurrences(documents, window).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    again = materialize(occurrences(documents, window).join(materialize(counts, "names"), "name"), "repeated")
    first = again.groupBy("name").agg(F.min(F.struct("doc_id", "low")).alias("first"))
    return materialize(again.join(first, "name").select("doc_id", "low", F.col("first.doc_id").alias("from_doc"), F.col("first.low").alias("from_low")), "aligned")


def settle(ids: np.ndarray, column: pa.Array, known: list, window: int = WINDOW) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From texts and, for each, what `repeated` has of it: open windows (hash, hash, id, position) and covered (id, low, high)."""
    hashes, first = _words(column)
    s = anchors(hashes, first, window)
    n = len(hashes)
    base, end = first[:-1], first[1:]
    # What is known, at the symbols that it is known of; a symbol is found by its first word.
    sizes = np.array([len(k) for k in known], np.int64)
    flat = pa.concat_arrays([k.values for k in known if len(k)]) if sizes.sum() else None
    at_word = np.full(n + 1, -1)
    if flat is not None:
        low = flat.field("low").to_numpy() + np.repeat(base, sizes)
        at_word[low] = np.arange(len(low))
        from_doc, from_low = flat.field("from_doc").to_numpy(), flat.field("from_low").to_numpy().astype(np.int64)
    k = at_word[s.low]
    seen = k >= 0
    # Windows that hold a symbol which occurs once, with its context.
    killed = np.zeros(n + 1, np.int64)
    a, b = np.maximum(s.context_high - window, base[s.text]), s.context_low
    np.add.at(killed, a[~seen], 1)
    np.add.at(killed, b[~seen] + 1, -1)
    killed = np.cumsum(killed)[:n] > 0
    covered: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    whole = np.zeros(n + 1, np.int64)
    if flat is not None:
        shift = np.where(seen, from_low[k] - (s.low - base[s.text]), 0)
        source = np.where(seen, from_doc[k], 0)
        moved = seen & ((source != ids[s.text]) | (shift != 0))
        goes_on = np.zeros(len(k), bool)
        goes_on[1:] = moved[1:] & moved[:-1] & (s.text[1:] == s.text[:-1]) & (source[1:] == source[:-1]) & (shift[1:] == shift[:-1]) & (s.context_low[1:] <= s.context_high[:-1])
        heads = np.flatnonzero(moved & ~goes_on)
        stops = np.flatnonzero(moved & ~np.append(goes_on[1:], False))
        low, high, text = s.context_low[heads], s.context_high[stops], s.text[heads]
        long = high - low >= window
        low, high, text = low[long], high[long], text[long]
        covered = [ids[text], low - base[text], high - base[text]]
        # Windows without a word outside of covered passages.
        mask = np.zeros(n + 1, np.int64)
        np.add.at(mask, low, 1)
        np.add.at(mask, high, -1)
        whole[1:] = np.cumsum(np.cumsum(mask)[:n] > 0)
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(end, np.diff(first)))
    starts = starts[~killed[starts] & (whole[starts + window] - whole[starts] < window)] if n else starts
    h1 = W.span_hashes(hashes, starts, starts + window)
    h2 = W.span_hashes(_words(column, 1)[0], starts, starts + window, 1)
    owner = W.owners(first)[starts]
    return [h1.view(np.int64), h2.view(np.int64), ids[owner], starts - base[owner]], covered


def found(documents: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """h1, h2, doc_id, low, high: open windows with their hash, and covered passages without."""
    # Rows with one doc_id know the same, so it is a set: what is known of copies is no list as long as they are many.
    each = known.groupBy("doc_id").agg(F.collect_set(F.struct("low", "from_doc", "from_low")).alias("known"))

    def run(batches):
        for part in W.chunks(batches):
            lists = part.column("known").fill_null([])
            opened, covered = settle(part.column("doc_id").to_numpy(), part.column("text"), list(lists), window)
            blank = pa.nulls(len(covered[0]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([pa.array(opened[i]), blank]) for i in (0, 1)),
                    pa.array(np.concatenate([opened[2], covered[0]])),
                    pa.array(np.concatenate([opened[3], covered[1]]).astype(np.int32)),
                    pa.array(np.concatenate([opened[3] + window, covered[2]]).astype(np.int32)),
                ],
                names=["h1", "h2", "doc_id", "low", "high"],
            )

    return documents.where("doc_id is not null").join(each, "doc_id", "left").select("doc_id", "text", "known").mapInArrow(run, "h1 long, h2 long, doc_id long, low int, high int")


def passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, low, high: words low to high of a document occur earlier. Passages may overlap."""
    known = repeated(documents, window)
    places = materialize(found(documents, known, window), "places")
    opened = places.where("h1 is not null")
    # Partial minima first; then a window that very many places have is sent to them, not they to it.
    first = opened.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "low")).alias("first")).where("n > 1")
    later = join_hot(opened, materialize(first, "first"), ["h1", "h2"], "n").where("doc_id <> first.doc_id or low <> first.low")
    return later.select("doc_id", "low", "high").unionAll(places.where("h1 is null").select("doc_id", "low", "high"))


def dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = materialize(passages(rows, window), "passages")
    each = gone.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("gone"))

    def run(batches):
        for part in W.chunks(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column("text"), part.column("gone"), strict=True):
                words = (text.as_py() or "").encode().split()
                stay = np.ones(len(words), bool)
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans.values.field("low").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("high").to_numpy(), -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_words.append(len(stay))
                n_removed.append(len(stay) - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(each, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

