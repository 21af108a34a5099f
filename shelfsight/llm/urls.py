"""URL filter: explicit rules first, then a tree of path templates per host judged by its labelled pages.

The tree is built level by level on the distinct path shapes, not on pages: runs of digits and long hexadecimal runs are
wildcards from the start, and a branch whose share of bad pages does not differ from its siblings' joins the wildcard branch
(variable segments and similar branches). Whether it differs is told by the likelihood ratio of one share against two, held to a level
that grows with the number of branches tried, and never by fewer than ``LEAST_KNOWN`` labelled pages. Branches that behave
differently keep their literal segment, whatever their share of the pages. A path of any depth has its whole template: a shape that
is alone under its template so far ends there at once, so the levels are as many as shapes share. A template is rejected when its labelled purity, smoothed
towards its host and the host towards all pages, is below the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written

#: Fixed by the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

VARIABLE_RUN = r"[0-9a-fA-F]{16,}|[0-9]+"
SIMILAR_Z = 2.58
#: Labelled pages below which a branch cannot be told from its siblings.
LEAST_KNOWN = 5
SMOOTHING = 10.0
LEAST_PURITY = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and subdomains if the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with variable runs as wildcards."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), VARIABLE_RUN, "*"), "/")


def _information(bad: Column, known: Column, share: Column) -> Column:
    """known times the divergence of its share of bad pages from ``share``; nothing where there is none of a kind."""
    good = known - bad
    term = lambda n, p: F.when(n > 0, n * (F.log(n / known) - F.log(p))).otherwise(0.0)
    return F.when(known > 0, term(bad, share) + term(good, 1 - share)).otherwise(0.0)


def _differs(bad: Column, known: Column, all_bad: Column, all_known: Column, branches: Column, z: float) -> Column:
    """Whether two shares, of a branch and of its siblings, explain the labels better than one: log-likelihood ratio beyond z^2 / 2 and the log of the branches tried."""
    bad, known, all_bad, all_known = (c.cast("double") for c in (bad, known, all_bad, all_known))
    pooled = all_bad / all_known
    mixed = (all_bad > 0) & (all_bad < all_known) & (known >= LEAST_KNOWN) & (known < all_known)
    ratio = _information(bad, known, pooled) + _information(all_bad - bad, all_known - known, pooled)
    return F.when(mixed, ratio > z * z / 2 + F.log(branches.cast("double"))).otherwise(False)


def templates(shapes: DataFrame, similar_z: float = SIMILAR_Z) -> DataFrame:
    """(host, shape, template, known, bad) of every distinct path shape.

    ``shapes`` has host, shape (array of segments), pages, known, bad. One level of the tree at a time: the parent is the template built so far.
    """
    columns = ["host", "shape", "template", "known", "bad"]
    open_ = shapes.select("host", "shape", "known", "bad", F.lit("").alias("template"))
    done, level = [], 0
    while True:
        alone = open_.groupBy("host", "template").agg(F.count("*").alias("shapes")).where("shapes = 1")
        rest = F.array_join(F.slice("shape", level + 1, F.greatest(F.size("shape"), F.lit(1))), "/")
        done.append(written(open_.join(alone, ["host", "template"], "left_semi").withColumn("template", F.concat("template", F.lit("/"), rest)).select(*columns), "url-done"))
        shared = open_.join(alone, ["host", "template"], "left_anti").withColumn("segment", F.element_at("shape", level + 1))
        children = shared.groupBy("host", "template", "segment").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        parents = children.groupBy("host", "template").agg(F.sum("known").alias("p_known"), F.sum("bad").alias("p_bad"), F.count("*").alias("branches"))
        judged = children.join(parents, ["host", "template"])
        literal = _differs(F.col("bad"), F.col("known"), F.col("p_bad"), F.col("p_known"), F.col("branches"), similar_z) | (F.col("branches") == 1)
        named = judged.select("host", "template", "segment", F.when(literal, F.col("segment")).otherwise("*").alias("as"))
        grown = shared.join(named, ["host", "template", "segment"]).withColumn("template", F.concat("template", F.lit("/"), F.col("as")))
        grown = written(grown.select(*columns), "url-tree")
        level += 1
        done.append(grown.where(F.size("shape") <= level))
        open_ = grown.where(F.size("shape") > level)
        if open_.isEmpty():
            break
    tree = done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    return written(tree, "url-templates")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least_purity: float = LEAST_PURITY, smoothing: float = SMOOTHING) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every page.

    A labelled page is good when its quality is 1 and it is not toxic; labels of one page count once, the worse wins. A null url, or one
    without ``://``, has empty host and path and falls under the templates of the empty host. Without any labels the purity is 1
    and everything that no rule blocks is allowed. Repeated pages are judged alike, page_id may be null (then unlabelled).
    """
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("shape", segments(F.col("path")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad).alias("is_bad"))
    marked = parsed.join(known, parsed["page_id"] == known["doc_id"], "left")
    shapes = written(marked.groupBy("host", "shape").agg(
        F.count("*").alias("pages"), F.count("is_bad").alias("known"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad")), "url-shapes")
    tree = templates(shapes)
    total = shapes.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    overall = 1.0 - total["bad"] / total["known"] if total["known"] else 1.0
    smoothed = lambda good, n, prior: (good + smoothing * prior) / (n + smoothing)
    hosts = shapes.groupBy("host").agg(F.sum("known").alias("h_known"), F.sum("bad").alias("h_bad"))
    sums = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).join(hosts, "host")
    host_purity = smoothed(F.col("h_known") - F.col("h_bad"), F.col("h_known"), F.lit(overall))
    purity = sums.select("host", "template", smoothed(F.col("known") - F.col("bad"), F.col("known"), host_purity).alias("purity"))
    verdicts = tree.select("host", "shape", "template").join(purity, ["host", "template"])
    rule, decision = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parsed.join(verdicts, ["host", "shape"]).withColumn("rule", rule).withColumn("decision", decision)
    by_method = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decision", by_method).alias("verdict"), "template", "purity")
