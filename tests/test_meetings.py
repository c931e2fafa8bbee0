"""Pairs of lines and of questions, by blocks, against plain loops."""

import random
import statistics

import pytest

from tidebook.operators import graph, meetings

LINES = "series string, ts long, event_id long, value double"


def lines(seed, names, n=400):
    rng = random.Random(seed)
    return [(rng.choice(names), 40 * i + rng.randrange(3), i, float(rng.randrange(-9, 9))) for i in range(n)]


@pytest.mark.parametrize(("per", "longest"), [(10_000, 10_000), (3, 10_000), (3, 15)])
def test_lines_meet_in_any_blocks(spark, per, longest):
    names, tol, within, last = "abcdefg", 200, 900, 7
    rows = lines(3, names)
    own = {s: sorted((t, i, v) for q, t, i, v in rows if q == s) for s in names}
    pairs = [(a, b) for a in names for b in names if a != b] + [("a", "nowhere"), ("nowhere", "a")]
    df, asked = spark.createDataFrame(rows, LINES), spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): (r.n, r.r) for r in meetings.correlations(asked, df, tol, per, longest).collect()}
    lags = {(r.a, r.b): r.lag_ms for r in meetings.lags(asked, df, within, within - 1, last, per, longest).collect()}
    met, behind = {}, {}
    for a, b in pairs:
        for t, _, x in own.get(a, ()):
            before = [(u, y) for u, _, y in own.get(b, ()) if u <= t + tol]
            if before and abs(before[-1][0] - t) <= tol:
                met.setdefault((a, b), []).append((x, before[-1][1]))
            until = [u for u, _, _ in own.get(b, ()) if u <= t + within - 1]
            if until and 0 < until[-1] - t < within:
                behind.setdefault((a, b), []).append(until[-1] - t)
    assert got == {k: (len(v), pytest.approx(statistics.correlation(*zip(*v, strict=True)))) for k, v in met.items()}
    assert lags == {k: sorted(v[-last:])[len(v[-last:]) // 2] for k, v in behind.items()}


def test_questions_of_equal_words_are_compared_once(spark):
    """Many markets of few questions: two bags are compared once, however many markets have them."""
    rows = [(i, f"c{i % 2}", ("red ring by march", "ring by march red", "old gear by may")[i % 3]) for i in range(300)]
    got = graph.similar_pairs(spark.createDataFrame(rows, "market long, category string, question string"), "market", 0.35)
    red = [i for i in range(300) if i % 3 < 2]
    want = {(a, b) for a in red for b in red if a < b} | {(a, b) for a in range(2, 300, 3) for b in range(2, 300, 3) if a < b}
    found = got.collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert all(r.kind == ("same_event" if (r.a - r.b) % 2 == 0 else "causal") for r in found)
    # The likeness stands in a written table of bags, of which there are two, before markets are paired.
    assert spark.read.parquet(*[f for f in got.inputFiles() if "/alike-" in f]).count() == 2
