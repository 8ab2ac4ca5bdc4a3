"""URL filters by a path-template tree.

Each host's paths form a tree of segments. Level by level a segment that is a number, or too rare among its siblings, becomes a
wildcard, so that paths fall under a few templates. Templates under one parent whose labelled shares do not differ
significantly from their parent's are merged. A template is rejected where its labelled purity, smoothed towards that of all
labelled pages (at most one half), is high. Explicit rules label the pages that they fit; the other pages get their template's verdict.
Counts are pre-aggregated by host and path, so a host with a third of all pages is no single group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

# The rules, (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEPTH = 6  # segments that are told apart; what follows them is one wildcard
LEAST = 5  # pages of a segment that may stand for itself
SHARE = 0.02  # of its siblings' pages that it must have
SIMILAR = 1.96  # standard errors within which a branch is like its parent
STRENGTH = 5.0  # labelled pages that the smoothing counts as
REJECT = 0.8
VARIABLE = r"^[0-9]+(\.[A-Za-z]+)?$|^[0-9A-Fa-f-]{12,}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a url; both empty for null and without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in longest]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)])
    return pick([h + p for h, p, _ in longest]), pick([v for _, _, v in longest])


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, ...) with the template of each and its parent's."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    now = paths.withColumns({"segments": segments, "template": F.lit(""), "parent": F.lit("")})
    now = now.withColumn("segments", F.transform("segments", lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s)))
    for depth in range(DEPTH):
        here = now.withColumn("segment", F.get("segments", F.lit(depth)))
        child = here.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("own"))
        among = child.groupBy("host", "template").agg(F.sum("own").alias("all"))
        named = child.join(among, ["host", "template"]).filter((F.col("own") >= LEAST) & (F.col("own") >= SHARE * F.col("all"))).select("host", "template", "segment", F.lit(True).alias("named"))
        here = here.join(named, ["host", "template", "segment"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("named"), F.col("segment")).otherwise("*"))
        now = here.withColumns({"parent": F.when(F.col("segment").isNull(), F.col("parent")).otherwise(F.col("template")), "template": F.when(F.col("segment").isNull(), F.col("template")).otherwise(step)})
        now = checkpointed(now.drop("segment", "named"))
    more = F.size("segments") > DEPTH
    return now.withColumns({"parent": F.when(more, F.col("template")).otherwise(F.col("parent")), "template": F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))}).drop("segments")


def purities(leaves: DataFrame) -> DataFrame:
    """(host, template, purity) from labelled counts (host, template, parent, bad, labelled) by template."""
    # One row. At most even, so that a template is not rejected without labelled pages of its own.
    total = leaves.agg(F.least(F.coalesce(F.sum("bad") / F.sum("labelled"), F.lit(0.0)), F.lit(0.5)).alias("prior"))
    above = Window.partitionBy("host", "parent")
    both = leaves.withColumns({"up_bad": F.sum("bad").over(above), "up_all": F.sum("labelled").over(above)})
    share = F.col("up_bad") / F.col("up_all")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / F.col("up_all")))
    alike = F.coalesce((F.col("labelled") > 0) & (F.abs(F.col("bad") / F.col("labelled") - share) <= SIMILAR * error), F.lit(False))
    both = both.withColumn("alike", F.when(F.col("labelled") > 0, alike).otherwise(F.lit(False)))
    merged = Window.partitionBy("host", "parent", "alike")
    pooled = lambda c: F.when(F.col("alike"), F.sum(c).over(merged)).otherwise(F.col(c))
    both = both.withColumns({"sum_bad": pooled("bad"), "sum_all": pooled("labelled")}).crossJoin(F.broadcast(total))
    return both.select("host", "template", ((F.col("sum_bad") + STRENGTH * F.col("prior")) / (F.col("sum_all") + STRENGTH)).alias("purity"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages`` (page_id, url).

    The verdict is the longest fitting rule's; without one it is block where the template's purity reaches REJECT, else allow.
    Null urls and urls without ``://`` have an empty host and path and form one template. Rows are judged one by one, so
    repeated rows and null page_ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = checkpointed(page.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    count = page.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.sum((F.coalesce(F.col("by_rule"), F.lit("")) == "block").cast("long")).alias("bad"))
    leaf = checkpointed(templates(count))
    sums = leaf.groupBy("host", "template", "parent").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    told = leaf.select("host", "path", "template").join(purities(sums), ["host", "template"])
    out = page.join(told, ["host", "path"])
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity")
