"""The graph of markets: similar questions, correlated prices, clusters; how moves travel along its edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import settled, written
from . import meetings, series

ORDER = ["ts", "event_id"]


def _telling_words(rows: DataFrame, least: float) -> DataFrame:
    """id, word: of each question the words, rarest first, of which one must be the rarest that it shares with a question as alike as `least`.

    If all shared words lie among those from a place on, the Jaccard index is at most their share of the words, and the
    cosine at most what it would be with all of them shared (Cauchy-Schwarz). Words from where both give less than `least`
    need not be met on. These are the most common ones.
    """
    own, shared = math.log(2) ** 2, math.log(5 / 3) ** 2
    each = rows.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("id", "n", "word").agg(F.count("*").alias("k"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    part = each.join(df, "word").select("id", F.struct("df", "word", F.pow(F.col("k") / F.col("n"), 2).alias("w2")).alias("x"))
    sorted_ = part.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x")).withColumn("n", F.size("x"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["w2"])

    def bound(i: Column) -> Column:
        rest = total(F.slice("x", i + 1, F.col("n"))) * shared
        return 0.4 * (F.col("n") - i) / F.col("n") + 0.6 * F.sqrt(rest / (rest + total(F.slice("x", F.lit(1), i)) * own))

    kept = F.filter("x", lambda x, i: bound(i) >= least - 1e-9)
    return sorted_.select("id", F.explode(F.transform(kept, lambda x: x["word"])).alias("word"))


def similar_pairs(markets: DataFrame, id_: str, least: float = 0.35) -> DataFrame:
    """a, b (a < b), shared, similarity of questions that share a word and are at least so alike.

    Questions of the same words are one bag. Bags meet on the words of `_telling_words`, so a word that many share seldom pairs them
    all; likeness is worked out once for two bags, and their questions are paired at the end.
    """
    rows = settled(markets.select(F.col(id_).alias("id"), "category", F.array_sort(X.tokens(F.col("question"))).alias("words")).where(F.size("words") > 0), "questions")
    bags = written(rows.groupBy("words").agg(F.min("id").alias("id")), "bags")
    each = _telling_words(bags, least)
    found = each.select(F.col("id").alias("a"), "word").join(each.select(F.col("id").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    both = found.unionByName(bags.select(F.col("id").alias("a"), F.col("id").alias("b"))).join(bags.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(bags.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    share = lambda x, y: F.size(F.filter(x, lambda w: F.array_contains(F.col(y), w))) / F.size(x)
    scored = both.select("a", "b", share("wa", "wb").alias("ab"), share("wb", "wa").alias("ba"), X.pair_similarity(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)
    turned = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", F.col("ab").alias("shared")))).otherwise(F.array(F.struct("a", "b", F.col("ab").alias("shared")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("shared"))))
    scored = written(scored.select(F.explode(turned).alias("x"), "similarity").select(F.col("x.a").alias("bag_a"), F.col("x.b").alias("bag_b"), "x.shared", "similarity"), "alike")
    of = rows.join(bags.withColumnRenamed("id", "bag"), "words")
    side = lambda s: of.select(F.col("bag").alias(f"bag_{s}"), F.col("id").alias(s), F.col("category").alias(f"c{s}"))
    pairs = scored.join(side("a"), "bag_a").join(side("b"), "bag_b").where("a < b")
    same = F.col("ca") == F.col("cb")
    s = F.col("similarity")
    kind = F.when((s >= 0.65) & same, "same_event").when((s >= 0.5) & same & (F.col("shared") >= 0.4), "complementary").when((s >= 0.45) & ~same, "causal").otherwise("semantic")
    return pairs.select("a", "b", "shared", "similarity", kind.alias("kind"))


def classes(markets: DataFrame) -> DataFrame:
    """markets with `class`, the smallest market that has the same question and category."""
    return markets.join(markets.groupBy("question", "category").agg(F.min("market").alias("class")), ["question", "category"])


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster: the smallest id of each connected part; nodes without an edge are their own.

    Labels fall to the smallest of the neighbours' and then to that label's own label, until none changes; each
    round is a written table.
    """
    edges = settled(edges)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, done = nodes.select("id", F.col("id").alias("cluster")), False
    while not done:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("cluster", F.coalesce("near", "cluster")).alias("mid"), F.col("cluster").alias("old"))
        up = new.select(F.col("id").alias("mid"), F.col("mid").alias("up"))
        labels = written(new.join(up, "mid").select("id", F.least("mid", "up").alias("cluster"), "old"), "clusters")
        done = labels.where("cluster <> old").isEmpty()
        labels = labels.drop("old")
    return labels


def descriptions(members: DataFrame, most: int = 5) -> DataFrame:
    """cluster, n, words: the words that at least half of its questions have (two at least), the most frequent first, or a stock phrase.

    members: cluster, market, question. Of equally frequent words the first by letter.
    """
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    each = members.select("cluster", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("word")).groupBy("cluster", "word").agg(F.count("*").alias("df"))
    kept = each.join(n, "cluster").where(F.col("df") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))
    ranked = kept.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("df"), "word"))).where(F.col("k") <= most)
    words = ranked.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("words"))
    return n.join(words, "cluster", "left").select("cluster", "n", F.coalesce("words", F.lit("related markets")).alias("words"))


def returns(prices: DataFrame, now: int, within: int, last: int = 500) -> DataFrame:
    """series, ts, event_id, change: steps between neighbouring prices over 0 of a series' last ones, not older than `within`."""
    rows = series.lagged(series.buffered(prices, ["series"], ORDER, last), ["series"], ORDER, {"was": "price"})
    return rows.where((F.col("was") > 0) & (F.col("price") > 0) & (F.col("ts") >= now - within)).select("series", *ORDER, (F.col("price") - F.col("was")).alias("change"))


def correlations(pairs: DataFrame, steps: DataFrame, tolerance: int, least: int = 5) -> DataFrame:
    """pairs (a, b) with correlation of their steps: each of a's meets the last one of b's that is not later than its time and the
    tolerance, if that is not earlier by more. 0 for fewer than `least` steps of either, or meetings, or where one does not vary.

    Blocks of pairs are worked on with their lines (`meetings`), so no pair's steps are moved for it alone.
    """
    pairs, steps = settled(pairs), settled(steps)
    enough = settled(steps.groupBy("series").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("series"), "enough")
    able = written(pairs.select("a", "b").join(enough.withColumnRenamed("series", "a"), "a").join(enough.withColumnRenamed("series", "b"), "b").distinct(), "able")
    found = meetings.correlations(able, steps.select("series", *ORDER, F.col("change").alias("value")), tolerance).select("a", "b", F.col("n").alias("_k"), F.col("r").alias("_r"))
    value = F.when(F.col("_k") >= least, F.col("_r"))
    return pairs.join(found, ["a", "b"], "left").withColumn("correlation", F.coalesce(value, F.lit(0.0))).drop("_k", "_r")


def update_lags(pairs: DataFrame, updates: DataFrame, within: int = 30_000, delay: int | None = None, last: int = 200) -> DataFrame:
    """a, b, lag_ms: the median (upper, by place) of the last lags by which b's books follow a's.

    An update of a is looked at after `delay` (default: just before `within` has passed); its lag is the time to b's latest
    update by then, if that comes later than a's and within the time. updates: series, ts, event_id.
    """
    delay = within - 1 if delay is None else delay
    return meetings.lags(written(pairs.select("a", "b").distinct(), "asked"), updates, within, delay, last)


#: Correlation from which a semantic relation is one of prices, and strength from which markets are clustered.
CORRELATED, CLUSTERED = 0.5, 0.30


def market_edges(pairs: DataFrame, steps: DataFrame, updates: DataFrame, tolerance: int = 10_000, within: int = 30_000) -> DataFrame:
    """source, target, kind, strength, correlation, lag_ms (0: none known): both directions of every related pair.

    pairs: as `similar_pairs` gives them. Correlation is worked out once a pair, from the smaller to the larger id.
    """
    rows = correlations(pairs.select("a", "b", "kind", "similarity"), steps, tolerance)
    kind = F.when((F.col("kind") == "semantic") & (F.abs("correlation") > CORRELATED), "correlated").otherwise(F.col("kind"))
    rows = rows.select("a", "b", kind.alias("kind"), (F.col("similarity") * F.when(F.col("kind") == "causal", 0.8).otherwise(1.0)).alias("strength"), "correlation")
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    both = settled(rows).withColumn("x", F.explode(ends)).select("x.source", "x.target", "kind", "strength", "correlation")
    lags = update_lags(both.select(F.col("source").alias("a"), F.col("target").alias("b")), updates, within)
    return both.join(lags.select(F.col("a").alias("source"), F.col("b").alias("target"), "lag_ms"), ["source", "target"], "left").withColumn("lag_ms", F.coalesce("lag_ms", F.lit(0)))


def edge_clusters(markets: DataFrame, edges: DataFrame) -> DataFrame:
    """market, cluster: markets joined by strong edges of one event, complements or correlated prices."""
    strong = edges.where((F.col("strength") >= CLUSTERED) & F.col("kind").isin("same_event", "complementary", "correlated") & (F.col("source") < F.col("target")))
    return clusters(markets.select(F.col("market").alias("id")), strong.select(F.col("source").alias("a"), F.col("target").alias("b"))).select(F.col("id").alias("market"), "cluster")


def cluster_scores(members: DataFrame) -> DataFrame:
    """cluster, n, violation (how far the prices over 0 are from adding up to 1; 0 for fewer than two) and score of clusters of two or more.

    members: cluster, market, mid.
    """
    agg = members.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("mid") > 0).alias("k"), F.sum(F.when(F.col("mid") > 0, F.col("mid"))).alias("total")).where("n >= 2")
    rows = agg.withColumn("violation", F.when(F.col("k") >= 2, F.abs(F.col("total") - 1)).otherwise(0.0))
    return rows.select("cluster", "n", "violation", (1 / (1 + 10 * F.col("violation"))).alias("score"))


def linked_pairs(edges: DataFrame, members: DataFrame, words: DataFrame, least: float = 0.4, telling: list[str] | None = None) -> DataFrame:
    """a, b (a < b), each once: the pairs of the edges, and of the clusters those that can share `least` of their words or one of whom has a telling word.

    members: market, cluster; words: market, words. A cluster's pairs are not all listed: two questions share the
    part `least` of the longer one's words only if they share one of the rarest that are left when so many less one are
    taken away, so they meet on these. Questions with a telling word meet others on any word that both have.
    """
    each = members.join(words.select("market", F.array_distinct("words").alias("words"), (F.size("words") > F.size(F.array_distinct("words"))).alias("again")), "market")
    each = each.select("cluster", "market", "again", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(df, "word").groupBy("cluster", "market", "again").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("x"))
    n = F.size("x")
    ranked = settled(ranked).withColumn("all", F.transform("x", lambda w: w["word"])).withColumn("rare", F.slice("all", F.lit(1), n - F.greatest(F.ceil(n * least - 1e-9), F.lit(1)).cast("int") + 1))
    by = lambda words, which, end: ranked.where(which).select("cluster", F.col("market").alias(end), F.explode(words).alias("word"))
    any_ = F.lit(True)
    # Words that a question repeats count as often as they are there, so such a question may meet any other on any word.
    looks = [("rare", any_, "rare", any_), ("all", F.col("again"), "all", any_)]
    if telling:
        marked = F.arrays_overlap("all", F.array(*map(F.lit, telling)))
        looks.append(("all", marked, "all", marked))
    found = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    for wa, ta, wb, tb in looks:
        found = found.unionByName(by(wa, ta, "a").join(by(wb, tb, "b"), ["cluster", "word"]).where("a <> b").select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def moves(prices: DataFrame, window: int = 500, least: int = 11, floor: float = 0.005) -> DataFrame:
    """series, event_id, ts, price, move, sigmas: changes of at least one rolling deviation (this change included) and the floor."""
    rows = series.lagged(prices, ["series"], ORDER, {"_was": "price"}).withColumn("move", F.col("price") - F.col("_was")).drop("_was")
    rows = series.framed(rows, ["series"], ORDER, window - 1, lambda f: {"sd": F.stddev_samp("move").over(f), "k": F.count("*").over(f)})
    found = rows.where((F.col("k") >= least) & (F.col("sd") > 0) & (F.abs("move") >= F.col("sd")) & (F.abs("move") >= floor))
    return found.select("series", "event_id", "ts", "price", "move", (F.abs("move") / F.col("sd")).alias("sigmas"))


def awaited(found: DataFrame, edges: DataFrame, prices: DataFrame, least: float = 0.2) -> DataFrame:
    """source, target, event_id, ts, move, sigmas, correlation, base: for each move the neighbours that it should reach, if they are
    correlated and have had a price by then (base)."""
    known = edges.where(F.abs("correlation") >= least).select(F.col("source").alias("series"), "target", "correlation")
    left = found.join(known, "series").select(F.col("series").alias("source"), F.col("target").alias("series"), *ORDER, "move", "sigmas", "correlation", F.lit(None).cast("double").alias("price"))
    points = prices.select("series", *ORDER, "price")
    line = left.withColumn("_left", F.lit(True)).unionByName(points, allowMissingColumns=True)
    # At one time and event the price stands after the question, so a move never sees itself.
    rows = series.carried(line, ["series"], ORDER, F.col("price"), "base").where("_left and base is not null")
    return rows.select("source", F.col("series").alias("target"), *ORDER, "move", "sigmas", "correlation", "base")


def propagation(pending: DataFrame, prices: DataFrame, now: int, within: int = 60_000, share: float = 0.1, parts: int = 64) -> DataFrame:
    """pending with status (resolved, expired, open), lag, efficiency (5 at most) and target_move.

    A move is resolved by the target's first later price that lies on the expected side of its base (the move's sign times
    that of the correlation) by at least a share of the move, not later than `within`. It is found in two steps: each
    target's line has its lowest and highest price in short stretches, which tell the first stretch that holds such a price;
    only the stretches at the ends, which lie within the time in part, can mislead, so they are looked at too.
    """
    step = max(within // parts, 1)
    wanted = F.signum("move") * F.signum("correlation")
    rows = pending.withColumns({"_up": wanted > 0, "_by": share * F.abs("move"), "_first": F.floor(F.col("ts") / step), "_last": F.floor((F.col("ts") + within) / step)})
    far = lambda lo, hi: F.when(F.col("_up"), hi - F.col("base") >= F.col("_by")).otherwise(F.col("base") - lo >= F.col("_by"))
    points = prices.select(F.col("series").alias("target"), F.col("ts").alias("_t"), F.col("event_id").alias("_e"), "price", F.floor(F.col("ts") / step).alias("_part"))
    ends = points.groupBy("target", "_part").agg(F.min("price").alias("_lo"), F.max("price").alias("_hi")).withColumn("_block", F.floor(F.col("_part") / parts))
    key = ["source", "target", "event_id"]
    blocks = rows.withColumn("_block", F.explode(F.array_distinct(F.array(*(F.floor((F.col("_first") + k) / parts) for k in (0, parts // 2, parts, parts + 1)))))) if parts > 1 else rows.withColumn("_block", F.explode(F.sequence("_first", "_last")))
    near = blocks.join(ends, ["target", "_block"]).where(F.col("_part").between(F.col("_first"), F.col("_last")) & far(F.col("_lo"), F.col("_hi")))
    inner = F.col("_part").between(F.col("_first") + 1, F.col("_last") - 1)
    looks = near.groupBy(*key).agg(F.array_compact(F.array(F.max(F.when(F.col("_part") == F.col("_first"), F.col("_part"))), F.min(F.when(inner, F.col("_part"))), F.max(F.when(F.col("_part") == F.col("_last"), F.col("_part"))))).alias("_looks"))
    looks = looks.select(*key, F.explode(F.array_distinct("_looks")).alias("_part"))
    later = (F.col("_t") > F.col("ts")) | ((F.col("_t") == F.col("ts")) & (F.col("_e") > F.col("event_id")))
    exact = rows.join(looks, key).join(points, ["target", "_part"]).where(later & (F.col("_t") <= F.col("ts") + within) & far(F.col("price"), F.col("price")) & (F.col("price") != F.col("base")))
    first = exact.groupBy(*key).agg(F.min(F.struct("_t", "_e", "price")).alias("_hit"))
    out = pending.join(first, key, "left")
    moved = F.col("_hit.price") - F.col("base")
    status = F.when(F.col("_hit").isNotNull(), "resolved").when(now - F.col("ts") > within, "expired").otherwise("open")
    return out.withColumns({"status": status, "lag": F.col("_hit._t") - F.col("ts"), "efficiency": F.least(F.abs(moved) / F.abs("move"), F.lit(5.0)), "target_move": moved}).drop("_hit")


def pair_stats(events: DataFrame, exec_ms: int, least: int = 3, last: int = 500) -> DataFrame:
    """source, target, n, p25, median, p75 and mean of the lag, median_efficiency, efficiency (mean), exploitable, updated: of a
    pair's last resolved moves. Quantiles are those by place."""
    pair = ["source", "target"]
    kept = settled(series.buffered(events.where("status = 'resolved'"), pair, ORDER, last))
    agg = kept.groupBy(*pair).agg(F.count("*").alias("n"), F.avg("efficiency").alias("efficiency"), F.avg("lag").alias("mean_lag"), F.max("ts").alias("updated")).where(F.col("n") >= least)
    places = series.quantiles(kept, pair, "lag", {"p25": (1, 4), "median": (1, 2), "p75": (3, 4)}).join(series.quantiles(kept, pair, "efficiency", {"median_efficiency": (1, 2)}), pair)
    return agg.join(places, pair).withColumn("exploitable", F.col("median") > exec_ms)


def propagation_report(events: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: pairs with a resolved move, resolved moves, open ones (by source move), pairs with statistics, exploitable ones."""
    a = events.agg(F.count_distinct(F.when(F.col("status") == "resolved", F.struct("source", "target"))).alias("pairs"), F.count_if(F.col("status") == "resolved").alias("events"), F.count_distinct(F.when(F.col("status") == "open", F.struct("source", "event_id"))).alias("open_moves"), F.count_if(F.col("status") == "expired").alias("expired"))
    b = stats.agg(F.count("*").alias("with_stats"), F.count_if("exploitable").alias("exploitable"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def edge_at_lag(events: DataFrame, stats: DataFrame, fee: float = 0.02) -> DataFrame:
    """source, target, edge: the targets' mean absolute move less the fee, over events whose lag lies within the quartiles."""
    rows = events.where("status = 'resolved'").join(stats.select("source", "target", "p25", "p75"), ["source", "target"]).where("lag between p25 and p75")
    return rows.groupBy("source", "target").agg(F.avg(F.abs("target_move") - fee).alias("edge"))
