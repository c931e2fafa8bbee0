"""URL filter: a tree of path templates for each host.

A url's path is a list of segments. Within its host and the template of what came
before, a segment that holds a small share of its parent's urls is variable and
becomes a wildcard of its shape (number, hexadecimal, word, other). Of branches that
stay apart, in the order of their share of block labels, each joins the group before it
unless a test of two proportions, on the counts of both, tells their labels or what
follows below them apart. The tree grows a segment at a time until no path goes on; a template that a single path has is
grown to that path's end at once. A template's
purity is its share of block labels, smoothed towards half as if by a few labels
of each kind; templates over the limit are rejected, and so are the urls that
fit them.

Labels come from rules (host, path prefix): a rule fits its host, all subdomains,
and every path that starts with its path; the longest rule wins and decides.

Defined cases: a null url or one without :// has empty host and path, fits no rule
and is allowed unless its own (empty) template is rejected; repeated pages are judged
alike; an empty table gives no rows. Columns beyond page_id and url are never
looked at.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .tables import join_hot, materialize, shared_dir


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Tree:
    """share: of its parent's urls that a literal segment needs. z: deviations from which two shares differ. prior:
    labels of each kind that every template starts with. reject: purity from which a template is rejected."""

    share: float = 0.01
    z: float = 1.96
    prior: float = 2.0
    reject: float = 0.7


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty if there is no ://."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def ruling(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The wildcard that a segment becomes if it is variable."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    body = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(body.rlike(r"^[0-9]+$"), "<n>").when(body.rlike(r"^[0-9A-Fa-f-]{8,}$"), "<x>").when(body.rlike(r"^[^0-9]+$"), "<w>").otherwise("<*>")
    return F.concat(kind, end)


COUNTS = ("urls", "blocked", "allowed", "variable")


def _differ(n1: Column, x1: Column, n2: Column, x2: Column, z: float) -> Column:
    """Whether x1 of n1 and x2 of n2 are different shares; half a case of each kind is added, so none is certain."""
    p1, p2 = (x1 + 0.5) / (n1 + 1), (x2 + 0.5) / (n2 + 1)
    p = (x1 + x2 + 1) / (n1 + n2 + 2)
    return F.abs(p1 - p2) > z * F.sqrt(p * (1 - p) * (1 / (n1 + 1) + 1 / (n2 + 1)))


def _merge(nodes: DataFrame, tree: Tree) -> DataFrame:
    """host, parent, segment, branch (what siblings that are alike are called) and paths (those that have the node).

    A parent has at most 1/share siblings here, so they are an array; a group's counts are those of all in it.
    """
    share = (F.col("blocked") + tree.prior) / (F.col("blocked") + F.col("allowed") + 2 * tree.prior)
    each = nodes.groupBy("host", "parent").agg(F.array_sort(F.collect_list(F.struct(share.alias("share"), "segment", *COUNTS, "paths"))).alias("nodes"))
    nobody = F.struct(F.lit(0).alias("group"), *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.array().cast("array<int>").alias("groups"))

    def step(acc: Column, x: Column) -> Column:
        labels, known = x["blocked"] + x["allowed"], acc["blocked"] + acc["allowed"]
        apart = (acc["group"] == 0) | ((labels > 0) != (known > 0)) | _differ(labels, x["blocked"], known, acc["blocked"], tree.z) | _differ(x["urls"], x["variable"], acc["urls"], acc["variable"], tree.z)
        group = acc["group"] + apart.cast("int")
        return F.struct(group.alias("group"), *(F.when(apart, x[c]).otherwise(acc[c] + x[c]).alias(c) for c in COUNTS), F.concat(acc["groups"], F.array(group)).alias("groups"))

    rows = each.withColumn("groups", F.aggregate("nodes", nobody, step)["groups"]).select("host", "parent", F.explode(F.arrays_zip("nodes", "groups")).alias("x"))
    rows = rows.select("host", "parent", "x.nodes.segment", "x.nodes.paths", F.col("x.groups").alias("group"))
    members = Win.partitionBy("host", "parent", "group")
    name = F.when(F.count("*").over(members) == 1, F.col("segment")).otherwise(F.concat(F.lit("("), F.min("segment").over(members), F.lit("|..)")))
    return rows.withColumn("branch", name).select("host", "parent", "segment", "branch", "paths")


def templates(pages: DataFrame, tree: Tree) -> tuple[DataFrame, DataFrame]:
    """(paths, templates) from pages with host, segments, verdict.

    paths: each different (host, segments), with its urls and template. templates: host, template, urls, blocked,
    allowed, purity, rejected, paths. The work on the tree is on counts of different paths; a level looks only at the
    paths that reach it, and a node that very many of them have is sent to them (`join_hot`). A path alone in its template
    has one node at every level below, so its rest is known: a long path costs no level for each of its segments.
    """
    paths = pages.groupBy("host", "segments").agg(F.count("*").alias("urls"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed"))
    live = materialize(paths.withColumn("template", F.lit("")), "paths")
    columns, level = live.columns, 0
    folder = f"{shared_dir(pages.sparkSession)}/grown-{uuid.uuid4().hex}"
    while True:
        live.where(F.size("segments") <= level).write.mode("append").parquet(folder)
        live = live.where(F.size("segments") > level)
        if live.isEmpty():
            break
        below = F.try_element_at("segments", F.lit(level + 2))
        live = live.withColumnRenamed("template", "parent").withColumns({"segment": F.element_at("segments", level + 1), "variable": F.col("urls") * F.coalesce(below.rlike("[0-9]"), F.lit(False)).cast("int")})
        nodes = live.groupBy("host", "parent", "segment").agg(*(F.sum(c).alias(c) for c in COUNTS), F.count("*").alias("paths"))
        nodes = materialize(nodes, "nodes")
        total = nodes.groupBy("host", "parent").agg(F.sum("urls").alias("all"), F.count("*").alias("n"))
        kept = join_hot(nodes, total, ["host", "parent"], "n").where((F.col("urls") >= tree.share * F.col("all")) & (F.col("urls") > 1))
        named = materialize(_merge(kept, tree), "named")
        step = F.concat(F.col("parent"), F.lit("/"), F.coalesce("branch", shape(F.col("segment"))))
        live = join_hot(live, named, ["host", "parent", "segment"], "paths", "left").withColumn("template", step).select(*columns)
        live, level = materialize(live, "paths"), level + 1
        shared = live.groupBy("host", "template").agg(F.count("*").alias("n"))
        live = materialize(join_hot(live, shared.withColumn("alone", F.col("n") == 1), ["host", "template"], "n"), "paths")
        rest = F.transform(F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments") - level, F.lit(0))), lambda x: F.concat(F.lit("/"), F.when(F.col("urls") > 1, x).otherwise(shape(x))))
        ended = live.where("alone").withColumn("template", F.concat("template", F.array_join(rest, "")))
        ended.select(*columns).write.mode("append").parquet(folder)
        live = live.where("not alone").select(*columns)
    done = pages.sparkSession.read.schema(live.schema).parquet(folder)
    judged = done.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("urls", "blocked", "allowed")), F.count("*").alias("paths"))
    purity = (F.col("blocked") + tree.prior) / (F.col("blocked") + F.col("allowed") + 2 * tree.prior)
    return done, materialize(judged.withColumn("purity", purity).withColumn("rejected", F.col("purity") >= tree.reject), "templates")


def judge(pages: DataFrame, rules: list[Rule], tree: Tree | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    tree = tree or Tree()
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("found", ruling(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.rule", "found.verdict")
    parsed = materialize(parsed.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")), "urls")
    paths, judged = templates(parsed, tree)
    judged = judged.select("host", "template", "purity", "rejected", "paths")
    looked = materialize(join_hot(paths.select("host", "segments", "template", "urls"), judged, ["host", "template"], "paths"), "looked")
    out = join_hot(parsed, looked, ["host", "segments"], "urls", "left")
    verdict = F.coalesce("verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
