"""Rolling and whole-series statistics, as-of joins, multiple-testing corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.shared import settled

HOUR = 3_600_000


def numbered(df: DataFrame, by: list[str], order: list[str], bucket: int, name: str) -> DataFrame:
    """df with name: a row's place in its key's order, from 0. The first of `order` is a number that cuts the line into buckets.

    Rows are numbered within a bucket; what precedes a bucket is a sum over its key's buckets, one row each. So no key is
    sorted as a whole.
    """
    rows = settled(df).withColumn("__span", F.floor(F.col(order[0]) / bucket))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.groupBy(*by, "__span").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rows = rows.join(sizes, [*by, "__span"]).withColumn(name, F.col("__before") + F.row_number().over(W.partitionBy(*by, "__span").orderBy(*order)) - 1)
    return rows.drop("__span", "__before")


def blocks(df: DataFrame, by: list[str], order: list[str], reach: int, bucket: int = HOUR, rows: int = 100_000) -> DataFrame:
    """df with _block and _own: a window over (by, _block) in this order sees, for rows with _own, the `reach` rows before.

    A block is so many rows of a key; the last `reach` of a block stand before the next one's again, with _own false.
    """
    rows = max(rows, reach)
    each = numbered(df, by, order, bucket, "__at").withColumn("_block", F.floor(F.col("__at") / rows))
    tail = (F.col("__at") % rows >= rows - reach).cast("boolean")
    again = F.explode(F.when(tail, F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")))))
    return each.withColumn("__x", again).withColumns({"_block": F.col("__x.b"), "_own": F.col("__x.own")}).drop("__x", "__at")


def lagged(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], n: int = 1, bucket: int = HOUR, ahead: bool = False) -> DataFrame:
    """df with, for each name in values, the column it names of the nth row before (ahead: after; null: none)."""
    sort = [f"_o{k}" if ahead else c for k, c in enumerate(order)]
    rows = df.withColumns({f"_o{k}": -F.col(c) for k, c in enumerate(order)}) if ahead else df
    w = W.partitionBy(*by, "_block").orderBy(*sort)
    out = blocks(rows, by, sort, n, bucket).withColumns({name: F.lag(c, n).over(w) for name, c in values.items()})
    return out.where("_own").drop("_block", "_own", *(sort if ahead else ()))


def buffered(df: DataFrame, by: list[str], order: list[str], last: int, bucket: int = HOUR) -> DataFrame:
    """The last so many rows of each key: a buffer of bounded length."""
    rows = numbered(df.withColumns({f"_o{k}": -F.col(c) for k, c in enumerate(order)}), by, [f"_o{k}" for k in range(len(order))], bucket, "__at")
    return rows.where(F.col("__at") < last).drop("__at", *(f"_o{k}" for k in range(len(order))))


def framed(df: DataFrame, by: list[str], order: list[str], n: int, make, bucket: int = HOUR) -> DataFrame:
    """df with the columns of make(frame), where frame holds a row and the n - 1 before it."""
    frame = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(-(n - 1), 0)
    return blocks(df, by, order, n - 1, bucket).withColumns(make(frame)).where("_own").drop("_block", "_own")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, bucket: int = HOUR, inclusive: bool = False) -> DataFrame:
    """df with name: the last value that is not null among the rows before (inclusive: and of this row).

    Within a bucket that is a window's; one row a bucket carries what came earlier.
    """
    rows = settled(df).withColumns({"__span": F.floor(F.col(order[0]) / bucket), "__v": value})
    last = rows.groupBy(*by, "__span").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__last"))
    earlier = F.last("__last", True).over(W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(last.withColumn("__earlier", earlier).drop("__last"), [*by, "__span"], "left")
    w = W.partitionBy(*by, "__span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.coalesce(F.last("__v", True).over(w), "__earlier")).drop("__span", "__v", "__earlier")


def summed(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, bucket: int = HOUR) -> DataFrame:
    """df with name: the sum of value up to and with this row."""
    rows = settled(df).withColumns({"__span": F.floor(F.col(order[0]) / bucket), "__v": value})
    before = F.sum("__s").over(W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1))
    sums = rows.groupBy(*by, "__span").agg(F.sum("__v").alias("__s")).withColumn("__before", before).drop("__s")
    w = W.partitionBy(*by, "__span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(sums, [*by, "__span"], "left").withColumn(name, F.coalesce("__before", F.lit(0)) + F.coalesce(F.sum("__v").over(w), F.lit(0))).drop("__span", "__v", "__before")


def trailing(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, span: int, bucket: int = HOUR) -> DataFrame:
    """df with name: the sum of value over the rows up to this one that are less than `span` older: running sums now and then."""
    ts = order[0]
    rows = settled(summed(df, by, order, value, "_upto", bucket))
    ends = rows.groupBy(*by, ts).agg(F.max_by("_upto", F.struct(*order)).alias("_then"))
    back = asof(rows.withColumn("_ts", F.col(ts)).withColumn(ts, F.col(ts) - span), ends, by, ts, "_then", bucket=bucket)
    return back.select(*(F.col("_ts").alias(c) if c == ts else c for c in df.columns), (F.col("_upto") - F.coalesce("_then", F.lit(0))).alias(name))


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, n: int, scale: float) -> DataFrame:
    """df with mean, sd and Sharpe ratio of each full window of n rows; rows without a full window are left out."""
    out = framed(df, by, order, n, lambda f: {"k": F.count("*").over(f), "mean": F.avg(value).over(f), "sd": F.stddev_samp(value).over(f)}).where(F.col("k") == n)
    return out.withColumn("sharpe", S.sharpe(F.col("mean"), F.col("sd"), scale)).drop("k")


def volatility(df: DataFrame, by: str, order: list[str], price: str) -> DataFrame:
    """by, volatility: sample deviation of log returns between neighbours that are both positive; 0 for fewer than 3 prices or 2 returns."""
    r = lagged(df, [by], order, {"last": price}).withColumn("r", F.when((F.col(price) > 0) & (F.col("last") > 0), F.log(F.col(price) / F.col("last"))))
    return r.groupBy(by).agg(F.when((F.count("*") < 3) | (F.count("r") < 2), 0.0).otherwise(F.coalesce(F.stddev_samp("r"), F.lit(0.0))).alias("volatility"))


def autocorrelation(df: DataFrame, by: str, order: list[str], value: str, lag: int = 1) -> DataFrame:
    """by, autocorrelation around the mean of the whole series; 0 for a short or flat one."""
    mean = df.groupBy(by).agg(F.avg(value).alias("mu"))
    d = df.join(mean, by).withColumn("d", F.col(value) - F.col("mu"))
    d = lagged(d, [by], order, {"e": "d"}, lag)
    agg = d.groupBy(by).agg(F.sum(F.col("d") * F.col("e")).alias("c"), F.sum(F.col("d") * F.col("d")).alias("v"), F.count("*").alias("n"))
    return agg.select(by, F.when((F.col("n") <= lag + 1) | (F.col("v") == 0), 0.0).otherwise(F.col("c") / F.col("v")).alias("autocorrelation"))


def regression(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, slope, intercept, r2, t of the slope and its upper-tail p; NaN for fewer than 3 points or a single x."""
    agg = df.groupBy(by).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    none = (F.col("n") < 3) | (F.col("sxx") == 0)
    slope = F.col("sxy") / F.col("sxx")
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    t = F.when(se == 0, F.when(slope == 0, 0.0).otherwise(F.signum(slope) * float("inf"))).otherwise(slope / se)
    out = agg.withColumns({"slope": slope, "intercept": F.col("my") - slope * F.col("mx"), "r2": F.when(F.col("syy") == 0, 0.0).otherwise(1 - rest / F.col("syy")), "t": t}).withColumn("p", S.t_p_value(F.col("t"), F.col("n") - 2))
    return out.select(by, *(F.when(none, S.NAN).otherwise(F.col(c)).alias(c) for c in ("slope", "intercept", "r2", "t", "p")))


def quantiles(df: DataFrame, by: list[str], value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """by, and for each name the value at place floor(n * a / b) of the sorted ones, counted from 0.

    Equal values are counted first, and a running sum over the different ones finds the place: no list of a key's values is made.
    """
    counts = settled(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy(value))
    rows = counts.join(counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by).withColumn("_upto", upto)
    at = {k: F.floor(F.col("_n") * a / b) for k, (a, b) in places.items()}
    return rows.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > place, F.col(value))).alias(k) for k, place in at.items()))


def adjusted(df: DataFrame, id_: str, p: str, parts: int = 64) -> DataFrame:
    """df with bh (step-up false discovery rate) and bonferroni; all of df is one family of tests.

    p-values lie in ranges of equal width. Ranks and minima are worked out within a range; the ranges' counts and
    minima, one row each, tell what comes before and after.
    """
    rows = df.withColumn("_part", F.least(F.floor(F.col(p) * parts), F.lit(parts - 1)).cast("int"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sizes.agg(F.sum("_n").alias("_m"), F.map_from_entries(F.collect_list(F.struct("_part", "_n"))).alias("_sizes"))
    before = F.aggregate(F.map_values(F.map_filter("_sizes", lambda k, _: k < F.col("_part"))), F.lit(0).cast("long"), lambda s, n: s + n)
    w = W.partitionBy("_part").orderBy(p, id_)
    rows = rows.join(F.broadcast(sums)).withColumn("raw", F.col(p) * F.col("_m") / (before + F.row_number().over(w)))
    least = rows.groupBy("_part").agg(F.min("raw").alias("_least")).agg(F.collect_list(F.struct("_part", "_least")).alias("_least"))
    later = F.array_min(F.transform(F.filter("_least", lambda x: x["_part"] > F.col("_part")), lambda x: x["_least"]))
    rows = rows.join(F.broadcast(least)).withColumn("bh", F.least(F.min("raw").over(w.rowsBetween(0, W.unboundedFollowing)), later, F.lit(1.0)))
    return rows.withColumn("bonferroni", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).select(*df.columns, "bonferroni", "bh")


def percentile_rank(df: DataFrame, by: str, value: str, parts: int = 256) -> DataFrame:
    """df with rank: the share of its group that is strictly less; a null value has no rank and does not count.

    Equal values are counted first; ranges of hashes would not keep their order, so values are cut into `parts` of equal
    width between the group's ends, and a part's rank starts where the parts before it end.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    ends = counts.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width * parts), F.lit(parts - 1))).otherwise(0)
    counts = counts.join(ends, by).withColumn("_part", part)
    before = F.sum("_s").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = counts.groupBy(by, "_part").agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_s")
    inside = F.sum("_c").over(W.partitionBy(by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.join(sums, [by, "_part"]).select(by, value, ((F.col("_before") + F.coalesce(inside, F.lit(0))) / F.col("_n")).alias("rank"))
    return df.join(ranks, [by, value], "left")


def asof(left: DataFrame, right: DataFrame, by: str | list[str], ts: str, value: str, direction: str = "backward", tolerance: int | None = None, bucket: int = 60_000) -> DataFrame:
    """left with value (of right) and value_ts at the latest time not after ts; with `forward` at the first not before it, with
    `nearest` at the closest one, ties to the later.

    Both sides are put on one time line per key and bucket; a look over one bucket's edge uses the last known value
    of earlier buckets, which is one row for each bucket. A key's line is thus never sorted in one task as a whole.
    """
    by = [by] if isinstance(by, str) else by
    key = [*by, "__span"]
    span = F.floor(F.col(ts) / bucket)
    left, right = settled(left), settled(right)
    r = right.select(*by, F.col(ts).cast("long").alias(ts), F.struct(F.col(ts).alias("ts"), F.col(value).alias("v")).alias("__at")).groupBy(*by, ts).agg(F.max("__at").alias("__at"))
    r = r.withColumn("__span", span)
    edges = r.groupBy(*key).agg(F.max_by("__at", ts).alias("__last"), F.min_by("__at", ts).alias("__first"))
    line = left.withColumn("__span", span).withColumn("__left", F.lit(1))
    spans = line.select(*key).distinct().join(edges, key, "full")
    earlier, later = W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by).orderBy("__span").rowsBetween(1, W.unboundedFollowing)
    spans = spans.select(*key, F.last("__last", True).over(earlier).alias("__before"), F.first("__first", True).over(later).alias("__after"))
    both = line.join(spans, key, "left").unionByName(r.select(*by, ts, "__span", "__at"), allowMissingColumns=True)
    up = W.partitionBy(*key).orderBy(F.col(ts), F.col("__left").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*key).orderBy(F.col(ts).desc(), F.col("__left").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    back, ahead = F.coalesce(F.last("__at", True).over(up), "__before"), F.coalesce(F.last("__at", True).over(down), "__after")
    if direction == "nearest":
        found = both.withColumns({"__back": back, "__ahead": ahead})
        nearer = F.col("__back").isNull() | ((F.col("__ahead.ts") - F.col(ts)) <= (F.col(ts) - F.col("__back.ts")))
        found = found.withColumn("__found", F.when(F.col("__ahead").isNotNull() & nearer, F.col("__ahead")).otherwise(F.col("__back")))
    else:
        found = both.withColumn("__found", ahead if direction == "forward" else back)
    if tolerance is not None:
        found = found.withColumn("__found", F.when(F.abs(F.col(ts) - F.col("__found.ts")) <= tolerance, F.col("__found")))
    return found.where("__left = 1").select(*left.columns, F.col("__found.v").alias(value), F.col("__found.ts").alias("value_ts"))


def price_at(asked: DataFrame, index: DataFrame, by: str, within: int, bucket: int = 60_000) -> DataFrame:
    """asked with price: the last one of the index (by, ts, seq, price) that is not later; 0 where that is more than `within` older or there is
    none at all, and the line's first price where all are later."""
    index = settled(index)
    points = index.groupBy(by, "ts").agg(F.max_by("price", "seq").alias("_price"))
    first = index.groupBy(by).agg(F.min_by("price", F.struct("ts", "seq")).alias("_first"))
    found = asof(asked, points, by, "ts", "_price", bucket=bucket).join(first, by, "left")
    price = F.when(F.col("value_ts").isNull(), F.col("_first")).when(F.col("ts") - F.col("value_ts") <= within, F.col("_price"))
    return found.select(*asked.columns, F.coalesce(price, F.lit(0.0)).alias("price"))


def spans_of(events: DataFrame, ts: str, state: str, end: int, first: str = "normal") -> DataFrame:
    """start, end, state: half-open spans between changes of one series; what precedes the first change is `first` from 0."""
    nxt = F.lead(ts).over(W.orderBy(ts))
    spans = events.select(F.col(ts).alias("start"), F.coalesce(nxt, F.lit(end)).alias("end"), F.col(state).alias("state"))
    head = events.agg(F.lit(0).cast("long").alias("start"), F.coalesce(F.min(ts), F.lit(end)).alias("end"), F.lit(first).alias("state"))
    return head.unionByName(spans).where(F.col("end") > F.col("start"))


def transitions(states: DataFrame, by: Column | str, order: str, state: str, domain: list[str]) -> DataFrame:
    """from_state, to_state, n and share of from_state, for all pairs of the domain."""
    spark = states.sparkSession
    steps = states.withColumn("from_state", F.lag(state).over(W.partitionBy(by).orderBy(order))).where("from_state is not null")
    counts = steps.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    one = spark.createDataFrame([(s,) for s in domain], "s string")
    grid = one.select(F.col("s").alias("from_state"), F.explode(F.array(*map(F.lit, domain))).alias("to_state"))
    full = grid.join(counts, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    all_ = F.sum("n").over(W.partitionBy("from_state"))
    return full.withColumn("share", F.when(all_ == 0, 0.0).otherwise(F.col("n") / all_))


def confirmed(states: DataFrame, by: str, order: str, state: str, ticks: int = 2, first: str = "normal") -> DataFrame:
    """states with current: the last state that was seen so many times in a row, at first `first`.

    A change waits until its state has come `ticks` times running, so the current state is that of the last run that
    got so long.
    """
    w = W.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = states.withColumn("_new", F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(upto))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(by, "_run").orderBy(order)))
    return rows.withColumn("current", F.coalesce(F.last(F.when(F.col("_k") >= ticks, F.col(state)), True).over(upto), F.lit(first))).drop("_new", "_run", "_k")


def durations(spans: DataFrame, domain: list[str]) -> DataFrame:
    """state, n, mean_ms of spans (start, end, state) that are over, for all states of the domain; 0 where there is none."""
    done = spans.groupBy("state").agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start")).alias("mean_ms"))
    one = spans.sparkSession.createDataFrame([(s,) for s in domain], "state string")
    return one.join(done, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_ms", F.lit(0.0)).alias("mean_ms"))
