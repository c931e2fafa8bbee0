"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the concatenation of three embeddings, looked up by two hashes of the
word and one of its stem; filters of several widths slide over the words, each filter keeps its largest
response in the text, and a logistic layer joins them. The net is trained in
numpy on a bounded labelled sample and then scores every whole text on the
executors. A threshold for each language, told from the text's own function
words, is set on labelled rows that took no part in training; scores are shifted
so that every language's threshold falls on the same value.

Defined cases: a null text counts as empty; a text without words gets the score
of its bias alone; equal texts get equal scores; an empty table gives no rows;
without labels of both kinds the prior score is below the threshold for all.
Columns beyond those named are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import words as W
from .quality import labelled_sample
from .tables import materialize

#: Most labelled documents of each kind that training looks at, and most words of theirs; a text with over a 20th of those is left out.
SAMPLE, WORDS = 4000, 6_000_000
#: Most words of a text whose responses are held at once; a longer one goes piece by piece, which its largest responses allow.
PIECE = 100_000
BUCKETS = 1 << 16
DIM = 8
#: Bytes of a word's stem.
STEM = 5
#: Embeddings of a word: by two hashes of it and one of its stem.
HASHES = 3
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Common function words; the language with most of them is taken as the text's.
LANGUAGES = {
    "en": "the of and to in is that it was for with as on be at by this are from or",
    "de": "der die und das ist von den mit im zu auf für des dem nicht ein sich auch",
    "fr": "le la les et des est un une du dans pour que qui sur pas au avec par",
    "es": "el los las del y que en por con una su para es lo como más o",
}


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of each text as three bucket numbers, (words, 3), and where each text's words begin."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.NOT_WORD)
    h = W.span_hashes(data, starts, ends)
    stem = W.span_hashes(data, starts, np.minimum(ends, starts + STEM))
    return np.column_stack([h % W.U64(BUCKETS), (h >> W.U64(32)) % W.U64(BUCKETS), stem % W.U64(BUCKETS)]).astype(np.int32), first


def _language_table() -> np.ndarray:
    codes = np.zeros(BUCKETS, np.int8)
    for code, text in enumerate(LANGUAGES.values(), 1):
        data = np.frombuffer(text.encode(), np.uint8)
        codes[word_ids(data, np.array([0, len(data)]))[0][:, 0]] = code
    return codes


def languages(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0 to 3 as in LANGUAGES, 4 where there is no function word."""
    n = len(first) - 1
    codes = _language_table()[ids[:, 0]]
    counts = np.bincount(W.owners(first) * 5 + codes, minlength=5 * n).reshape(n, 5)[:, 1:]
    return np.where(counts.any(1), counts.argmax(1), len(LANGUAGES))


@dataclass
class Net:
    embedding: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))

    @classmethod
    def new(cls, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls([draw(BUCKETS, DIM) for _ in range(HASHES)], [draw(w, HASHES * DIM, FILTERS) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), draw(len(WIDTHS) * FILTERS))

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        return np.hstack([e[ids[:, k]] for k, e in enumerate(self.embedding)])

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Every filter at every word; x ends with as many empty words as the widest filter overhangs."""
        n = len(x) - max(WIDTHS) + 1
        return np.hstack([sum(x[j : n + j] @ f[j] for j in range(len(f))) for f in self.filters]) + self.bias

    def forward(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit, pooled responses, padded words and the responses of texts whose words are given.

        Each text is followed by empty words, so that no filter reaches into the next one.
        """
        pad = max(WIDTHS) - 1
        n = len(first) - 1
        place = np.arange(len(ids)) + W.owners(first) * (pad + 1)
        starts = first + np.arange(n + 1) * (pad + 1)
        x = np.zeros((starts[-1] + pad, HASHES * DIM), self.embedding[0].dtype)
        x[place] = self.look_up(ids)
        r = self.responses(x)
        for k in range(1, pad + 1):  # these reach into the next text
            r[starts[1:] - k] = -np.inf
        pooled = np.maximum(np.maximum.reduceat(r, starts[:-1], axis=0) if n else np.zeros((0, r.shape[1])), 0)
        return pooled @ self.out + self.out_bias, pooled, x, r

    def logits(self, ids: np.ndarray, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
        if not len(first) - 1 or np.diff(first).max() <= piece:
            return self.forward(ids, first)[0]
        # Pieces overlap by what the widest filter takes, and the larger response of two pieces is the text's.
        over, out = max(WIDTHS) - 1, np.zeros(len(first) - 1)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            pooled = [self.forward(ids[s : min(s + piece + over, b)], np.array([0, min(s + piece + over, b) - s]))[1] for s in range(a, max(b, a + 1), piece)]
            out[k] = (np.maximum.reduce(pooled) @ self.out + self.out_bias)[0]
        return out

    def score(self, ids: np.ndarray, first: np.ndarray, cut: float) -> np.ndarray:
        z = self.logits(ids, first) - self.thresholds[languages(ids, first)] + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _select(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[rows]
    begin = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(first[rows] - begin[:-1], size) + np.arange(begin[-1])], begin


def gradients(net: Net, ids: np.ndarray, first: np.ndarray, d: Callable[[np.ndarray], np.ndarray]) -> tuple[list, list[np.ndarray], float]:
    """Of a loss whose derivative by the texts' logits is d(logits): (rows, derivatives) of each embedding, derivatives of
    filters, bias and out, and that of the output's bias. Only a filter's largest response in a text has a part."""
    z, pooled, x, r = net.forward(ids, first)
    d = d(z).astype(x.dtype)
    pad = max(WIDTHS) - 1
    starts = first + np.arange(len(first)) * (pad + 1)
    best = np.stack([starts[i] + r[starts[i] : starts[i + 1]].argmax(0) for i in range(len(first) - 1)])
    g = (d[:, None] * net.out) * (pooled > 0)
    grads: list[np.ndarray] = [np.zeros_like(f) for f in net.filters]
    dx_at, dx = [], []
    for k, w in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        gk, at = g[:, own], best[:, own]
        for j in range(w):
            grads[k][j] = np.einsum("df,dfe->ef", gk, x[at + j])
            dx_at.append((at + j).ravel())
            dx.append((gk[:, :, None] * net.filters[k][j].T[None]).reshape(-1, HASHES * DIM))
    where, dx_all = np.concatenate(dx_at), np.concatenate(dx)
    real = np.full(len(x), -1)
    real[np.arange(len(ids)) + W.owners(first) * (pad + 1)] = np.arange(len(ids))
    source = real[where]
    live = (source >= 0) & np.abs(dx_all).any(1)
    source, dx_all = source[live], dx_all[live]
    embedded = []
    for e in range(HASHES):
        unique, inverse = np.unique(ids[source, e], return_inverse=True)
        total = np.zeros((len(unique), DIM), x.dtype)
        np.add.at(total, inverse, dx_all[:, e * DIM : (e + 1) * DIM])
        embedded.append((unique, total))
    return embedded, [*grads, g.sum(0), d @ pooled], float(d.sum())


def train(ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.08, drop: float = 0.5, seed: int = 5) -> Net:
    """Adagrad on the logistic loss; a fifth of the rows only sets the thresholds."""
    net, n = Net.new(seed), len(toxic)
    if not n or toxic.all() or not toxic.any():
        net.out[:] = 0
        net.thresholds[:] = 1.0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    aside, learn = order[: n // 5], order[n // 5 :]
    params = [*net.filters, net.bias, net.out]
    seen, seen_rows, seen_bias = [np.full(p.shape, 1e-3, np.float32) for p in params], [np.full(BUCKETS, 1e-3, np.float32) for _ in range(HASHES)], 1e-3
    weight = np.where(toxic, 0.5 / max(toxic[learn].mean(), 1e-3), 0.5 / max(1 - toxic[learn].mean(), 1e-3))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            part, begin = _select(ids, first, rows)
            # Words left out at random: the rest must do, so the net learns every sign there is.
            stay = rng.random(len(part)) >= drop
            begin = np.concatenate([[0], np.cumsum(W.sums(stay, begin))])
            loss = lambda z, rows=rows: (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[rows]) * weight[rows] / len(rows)
            embedded, grads, bias = gradients(net, part[stay], begin, loss)
            for e, s, (unique, total) in zip(net.embedding, seen_rows, embedded, strict=True):
                s[unique] += (total**2).mean(1)
                e[unique] -= rate * total / np.sqrt(s[unique])[:, None]
            for p, s, gradient in zip(params, seen, grads, strict=True):
                s += gradient**2
                p -= rate * gradient / np.sqrt(s)
            seen_bias += bias**2
            net.out_bias -= rate * bias / np.sqrt(seen_bias)
    calibrate(net, *_select(ids, first, aside), toxic[aside])
    return net


def threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap that it lies in."""
    order = np.argsort(-z, kind="stable")
    s, hit = z[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] - 1)


def calibrate(net: Net, ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, least: int = 10, trust: int = 60) -> None:
    """A language's own threshold, drawn towards that of all rows as if that rested on `trust` toxic rows more."""
    z, language = net.logits(ids, first), languages(ids, first)
    net.thresholds[:] = threshold(z, toxic) if toxic.any() and not toxic.all() else 0.0
    for k in range(len(LANGUAGES)):
        own = language == k
        n = toxic[own].sum()
        if n >= least and (~toxic[own]).sum() >= least:
            net.thresholds[k] = (n * threshold(z[own], toxic[own]) + trust * net.thresholds[-1]) / (n + trust)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1, most: int = SAMPLE, words: int = WORDS) -> Net:
    """Trained on the driver on at most `most` labelled rows of each label and `words` words of theirs, 12 bytes each."""
    sample = labelled_sample(documents, labels, "toxic", folds, left_out, most)

    def run(batches):
        for part in W.chunks(batches):
            ids, first = word_ids(*W.buffer(part.column("text")))
            blobs = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(np.diff(first)), blobs], names=["doc_id", "label", "n", "ids"])

    rows = materialize(sample.mapInArrow(run, "doc_id long, label int, n long, ids binary"), "sample")
    # In the order of a hash, until half of the words are taken.
    order = Win.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Win.unboundedPreceding, 0)
    rows = rows.where(F.col("n") <= words // 20).withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= words // 2).select("doc_id", "label", "ids").toArrow().sort_by("doc_id")
    blobs = rows["ids"].to_pylist()
    first = np.concatenate([[0], np.cumsum([len(b) // (4 * HASHES) for b in blobs])]).astype(np.int64)
    return train(np.frombuffer(b"".join(blobs), np.int32).reshape(-1, HASHES), first, np.asarray(rows["label"]) == 1)


def score(documents: DataFrame, net: Net, cut: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with score and predicted (1 if score >= cut) of each whole text."""
    schema = documents.select(*keep).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    shared = documents.sparkSession.sparkContext.broadcast(net)  # of a fixed size, about 6 MB

    def run(batches):
        for part in W.chunks(batches, size=1 << 20):
            s = shared.value.score(*word_ids(*W.buffer(part.column("text"))), cut).astype(float)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
