"""The pipeline's near-copy stage against brute force over 5-word shingles."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.test_text_operators import corpus, frame, groups, prose
from tidebook.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted(seed=4):
    """Rows of corpus(), copies with few words changed around the limit, chains of them, and a group that shares most words."""
    rng = random.Random(seed)
    texts = [r[1] for r in corpus(seed)]
    for n in (4, 5, 8, 9, 20, 60, 150, 400, 1500):
        for _ in range(4):
            words = prose(rng, n).split()
            texts.append(" ".join(words))
            for _ in range(5):
                for _ in range(rng.randint(0, max(1, n // 30))):
                    words[rng.randrange(len(words))] = rng.choice(["new", "word", "here"])
                texts.append(" ".join(words if rng.random() < 0.7 else [*words, "at", "last"]))
    base = prose(rng, 100)
    texts += [f"{base} {prose(rng, 9)}" for _ in range(60)]
    return [(i * 7 % 1009, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_near_dedup_finds_all_near_copies(spark):
    rows = planted()
    sets = {r[0]: shingles(r[1]) for r in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert sum(sets[a] != sets[b] for a, b in pairs) > 100
    want = groups(pairs, sets)
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_dedup_of_nothing(spark):
    docs = frame(spark, corpus()).limit(0)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 0


def test_fingerprints_of_sets():
    rng = np.random.default_rng(5)
    n = np.array([0, 1, 254, 255, 256, 0, 511, 2000, 0])
    edge = np.concatenate([[0], np.cumsum(n)])
    h = rng.integers(0, 1 << 63, n.sum()).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    width = np.full(len(n), 8)
    width[7] = 32
    wide = np.split(near_copies.parities(h, edge, width), np.cumsum(width)[:-1])
    narrow = near_copies.parities(h, edge, np.full(len(n), 8)).reshape(-1, 8)
    for i, sim in enumerate(near_copies.majorities(h, edge).tolist()):
        own = h[edge[i] : edge[i + 1]].tolist()
        assert sim == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))
        assert (np.bitwise_xor.reduce(wide[i].reshape(-1, 8)) == narrow[i]).all()
        bits = np.zeros(64 * width[i], int)
        np.add.at(bits, (near_copies.W.mix(h[edge[i] : edge[i + 1]]) % np.uint64(64 * width[i])).astype(int), 1)
        assert (np.unpackbits(wide[i].view(np.uint8), bitorder="little") == bits % 2).all()
