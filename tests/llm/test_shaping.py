"""Whitening, chat formatting and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import math
import os
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import chat, fim, queries, whitening
from tidebook.llm.tables import configure

SF = "/root/testdata/sf0.001"


# ---- embedding whitening


def plain_whitening(vectors):
    """x of the usable vectors, n, S and the covariance as fractions, all by definition."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted(set(x))
    n = len(distinct)
    sums = [sum(v[i] for v in distinct) for i in range(len(distinct[0]))]
    mean = [Fraction(s, n) for s in sums]
    v = [[sum((a[i] - mean[i]) * (a[j] - mean[j]) for a in distinct) / n for j in range(len(sums))] for i in range(len(sums))]
    return x, n, sums, v


def check_whitening(spark, vectors, got):
    x, n, sums, v = plain_whitening(vectors)
    values, axes = np.linalg.eigh(np.array([[float(e) for e in row] for row in v]))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(sum(v[i][i] for i in range(len(v))))
    live = [k for k in range(min(4, len(values))) if values[k] > 1e-13 * trace]
    usable = [k for k, u in enumerate(vectors) if u is not None and all(c is not None and math.isfinite(c) for c in u)]
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i in usable for k in live)
    by = {(r.vec_id, r.component): r for r in got}
    for k in live:
        mine = np.array([by[i, k + 1].whitened for i in usable])
        want = np.array([sum((float(e - Fraction(s, n))) * axes[j, k] for j, (e, s) in enumerate(zip(u, sums, strict=True))) for u in x]) / math.sqrt(values[k])
        gap = min(abs(values[k] - values[m]) for m in range(len(values)) if m != k) / values[0] if len(values) > 1 else 1
        if gap > 1e-6:
            assert mine == pytest.approx(want, abs=1e-8) or mine == pytest.approx(-want, abs=1e-8)
        assert by[usable[0], k + 1].explained == pytest.approx(values[k] / trace, rel=1e-10)
    for i, u in zip(usable, x, strict=True):
        exact = sum((n * e - s) ** 2 for e, s in zip(u, sums, strict=True))
        assert {by[i, k + 1].deviation for k in live} == {exact if exact < 1 << 63 else None}
    assert {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-4 for r in got)


@pytest.mark.parametrize("size", [1, 1e3, 1e9, 1e15])
def test_whitening_is_the_plain_one(spark, size):
    configure(spark)
    rng = np.random.default_rng(int(size) % 97)
    vectors = (rng.normal(0, 1, (60, 5)) * [5, 3, 2, 1, 0.5] * size).tolist()
    vectors += [vectors[0]] * 40 + [None, [0.0, None, 1.0, 0.0, 0.0], [0.0, float("nan"), 1.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [-0.0, 0.0, -1e-9, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    check_whitening(spark, vectors, whitening.whiten(rows).collect())


def test_whitening_of_odd_tables(spark):
    configure(spark)
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    # Equal vectors have no direction; empty ones no components; two lengths are whitened apart.
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [])], schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.5]), (3, [5.0]), (4, [9.0]), (5, [9.0])], schema)).collect()
    assert {(r.vec_id, r.n, round(abs(r.whitened), 9)) for r in got} == {(1, 2, 1.0), (None, 2, 1.0), (3, 2, 1.0), (4, 2, 1.0), (5, 2, 1.0)}


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 1 << 19, 1 << 21, 1 << 40, 1 << 62):
        d = rng.integers(-top, top + 1, (whitening.ROWS, 3))
        d[0] = [-top, top, 0]
        parts = whitening.limbs(d)
        assert (sum(p.astype(np.int64).astype(object) * (1 << (whitening.BITS * k)) for k, p in enumerate(parts)) == d.astype(object)).all()
        exact = d.astype(object).T @ d.astype(object)
        assert (sum(p.astype(object) * (1 << (whitening.BITS * k)) for k, p in enumerate(whitening.products(d))) == exact).all()


def test_sums_are_the_same_however_rows_are_dealt(spark, monkeypatch):
    configure(spark)
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(v,) for v in rng.integers(-(1 << 40), 1 << 40, (300, 4)).tolist()], "x array<long>")
    x = np.array([r.x for r in rows.collect()], object)
    for parts in (1, 7):
        assert whitening.sums_of(rows.repartition(parts)) == {4: (300, x.sum(0).tolist())}
        gram = whitening.grams(rows.repartition(parts), {4: [5, 6, 7, 8]})[4]
        d = x - np.array([5, 6, 7, 8], object)
        assert gram == {(i, j): (d[:, i] * d[:, j]).sum() for i in range(4) for j in range(i, 4)}


# ---- chat formatting


def plain_chat(turns, template):
    """The formatted text, the loss text and where the order breaks, turn by turn."""
    out, loss, state, bad = "", "", template.start, None
    moves = {(s, r): t for s, r, t in template.moves}
    for k, (role, text) in enumerate(turns):
        for m in template.marks:
            text = (text or "").replace(m, template.escape + m)
        known = template.roles.get(role)
        mark = known.mark if known else template.other + ("-" if role is None else role.encode().hex().upper()) + "]: "
        out += mark + text + "\n" + template.close + "\n"
        loss += (turns[k][1] or "") if known and known.loss else ""
        state = moves.get((state, role), "broken")
        bad = k if state == "broken" and bad is None else bad
    return out, loss, state, bad


PIECES = ["### User: ", "### Assistant: ", "</turn>", "\\", "\n", "### [", "-]: ", "ä", "日本", "x", " ", "###", "<", "turn>", "\\### User: ", "</turn>\n"]


def test_chat_reads_back_what_it_wrote(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "]: ", "ü"]
    data, convs = [], {}
    for conv in [*range(150), None]:
        turns = [(rng.choice(roles[: rng.choice((2, 3, 8))]), rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))])) for _ in range(rng.randint(1, 9))]
        convs[conv] = turns
        data += [(conv, k, role, text, 1) for k, (role, text) in enumerate(turns)]
    convs[900] = [("user", "\\" * 5000 + "</turn>" * 300), ("assistant", "\\### Assistant: </turn> ok")]
    data += [(900, k, role, text, 1) for k, (role, text) in enumerate(convs[900])]
    rng.shuffle(data)
    template = chat.Template()
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segments int").repartition(3)
    done = chat.formatted(rows).withColumn("out", chat.joined(F.col("segments"))).withColumn("loss", chat.loss_text(F.col("segments"))).withColumn("turns", chat.turns_of(F.col("out")))
    got = {r.conv_id: r for r in done.collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        r = got[conv]
        assert (r.out, r.loss, r.state, r.first_bad) == plain_chat(turns, template)
        assert [(t.role, t.text) for t in r.turns] == [(role, text or "") for role, text in turns]
        assert r.n_turns == len(turns) and r.valid == (r.state == "answered")
    assert chat.formatted(rows.limit(0)).count() == 0


def test_chat_ties_and_other_templates(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    r = chat.formatted(rows).withColumn("out", chat.joined(F.col("segments"))).first()
    assert r.out == "### System: s\n</turn>\n" + "".join(f"### User: {t}\n</turn>\n" for t in "aab")
    assert (r.state, r.first_bad, r.valid) == ("broken", 2, False)
    own = chat.Template(roles={"q": chat.Turn("<q>"), "a": chat.Turn("<a>", True)}, other="<?", close="<end>", escape="~", moves=(("start", "q", "asked"), ("asked", "a", "start")), complete=("start",))
    rows = spark.createDataFrame([(1, 0, "q", "<a>~<end>"), (1, 1, "a", "~"), (2, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    done = chat.formatted(rows, own).withColumn("turns", chat.turns_of(chat.joined(F.col("segments")), own)).withColumn("loss", chat.loss_text(F.col("segments"), own))
    got = {r.conv_id: r for r in done.collect()}
    assert [t.text for t in got[1].turns] == ["<a>~<end>", "~"] and got[1].loss == "~" and got[1].valid and not got[2].valid
    for bad in ({"close": "### User: "}, {"close": "a\nb"}, {"close": "#"}, {"escape": "ab"}, {"close": ""}, {"close": " ###"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_runs_no_python(spark):
    plan = chat.formatted(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- fill in the middle


def plain_fim(doc_id, text, recipe, unit):
    lines = re.findall(unit, text or "")
    n, h = len(lines), hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in recipe.marks) or h3 % 100 >= recipe.rate:
        return n, "plain", None, None, text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h4 % 100 < recipe.spm
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("recipe", "unit"), [(fim.Recipe(), r"[^\n]*\n|[^\n]+"), (fim.Recipe(unit="word", seed=3, rate=60, spm=20), r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), (fim.Recipe(unit="char"), r"(?s).")])
def test_fill_in_middle_is_the_plain_one(spark, recipe, unit):
    configure(spark)
    rng = random.Random(9)
    parts = ["\n", "\n\n", " ", "word", "ü", "日本語", "😀", "<P", "S>", "\r\n", "\x0b", "é", "<", ">"]
    texts = [None, "", "\n", "a", "a\n", "\n" * 50, "has <S> in it", "<P", "<M>", "x\n" * 30000, "no break " * 20000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(k if k % 40 else None, t, "clash", 5) for k, t in enumerate(texts)] + [(7, texts[20], "clash", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    done = fim.transform(docs, recipe, keep=("doc_id", "text")).withColumn("back", fim.restored(F.col("output"), F.col("form"), recipe))
    got = sorted(tuple(str(v) for v in r) for r in done.collect())
    assert got == sorted(tuple(str(v) for v in (i, t, *plain_fim(i, t, recipe, unit), t or "")) for i, t, *_ in rows)
    assert fim.transform(docs.limit(0), recipe).count() == 0


def test_marks_must_not_overlap():
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"suffix": "x<P>"}, {"middle": "M<"}, {"middle": "aba"}):
        with pytest.raises(ValueError):
            fim.Recipe(**bad)
    fim.Recipe(prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")


# ---- queries


@pytest.mark.parametrize("name", ["op12_chat", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().select(got.columns).to_pylist()
    assert sorted(map(str, got.toArrow().to_pylist())) == sorted(map(str, want))


def test_whitening_query(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    check_whitening(spark, [vectors[i] for i in range(len(vectors))], got.collect())
