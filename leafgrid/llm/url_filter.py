"""URL filters: prefix rules first, then a path-template tree per host.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
the path follows up to ``?``, ``#`` or the end. Of the rules that fit (the rule's host or a subdomain of
it, and the path starts with the rule's), the longest decides.

URLs that no rule fits are judged by their host's template tree, whose labels are the rules' own verdicts. Digit runs of a path become
``#``; its segments, all of them, lead from the host down the tree, level by level:

1. generalise: of a node with more than ``MAX_FAN`` children, those without labels become the wildcard ``*``;
2. merge: if two or more children of a node carry labels, those whose share of blocked URLs does not differ from the share of all (one-degree chi-squared
   test at 5%) become one wildcard branch, which the children without labels join; the others keep branches of their own;
3. reject: a URL takes the smoothed purity (blocked + 1) / (labelled + 2) of its template, or of the nearest node above with at least ``EVIDENCE``
   labelled URLs; from ``PURITY`` on it is blocked. Without such a node, host included, it is allowed.

Defined results: null URLs and URLs without ``://`` have empty host and path, fit no rule and are allowed;
repeated rows give repeated results; empty segments stay as they are; an empty table gives an empty result; extra columns are ignored.

Only counts per (host, shape) travel through the tree. All steps are partial aggregates and equi-joins keyed by node or by child, so the children of a
hot host are spread over tasks. A level costs a few jobs; a shape that is alone below its node is finished at once, so there are as many levels as paths that
share a prefix have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import ascii_lower, checkpointed

#: (verdict, rule); a rule is host/path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Children from which on a node is variable, and labelled URLs that a node needs to speak for what is below it.
MAX_FAN, EVIDENCE = 32, 8
#: Smoothed share of blocked URLs, in percent, from which a template is rejected.
PURITY = 90
#: Critical value of the chi-squared distribution, one degree of freedom, 5%.
CHI2 = 3.841459


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 2)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), else null; equally long rules go by code point."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    if out is None:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    return out


def _shape(path: Column) -> Column:
    """The path without its first slash, digit runs as '#'."""
    return F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "#")


def _similar(b: Column, n: Column, b_all: Column, n_all: Column) -> Column:
    """Whether b blocked of n labelled fit b_all of n_all (one-degree chi-squared test)."""
    apart = b * n_all - n * b_all
    return apart * apart <= F.lit(CHI2) * n * b_all * (n_all - b_all)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and the template that was applied."""
    host, path = parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), _shape(F.col("path")).alias("shape"))
    counts = judged.groupBy("host", "shape").agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count("ruled").alias("n"))
    blocked = (F.col("eb") + 1) * 100 >= (F.col("en") + 2) * PURITY
    leaves = template_tree(checkpointed(counts)).select("host", "shape", "template", F.when(blocked, "block").otherwise("allow").alias("learnt"))
    out = judged.join(leaves, ["host", "shape"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "learnt").alias("verdict"), "template")


def _evidence(b: str, n: str) -> list[Column]:
    """(eb, en) of a node, kept from above where it has too few labels."""
    enough = F.col(n) >= EVIDENCE
    return [F.when(enough, F.col(b)).otherwise(F.col("eb")).alias("eb"), F.when(enough, F.col(n)).otherwise(F.col("en")).alias("en")]


def template_tree(counts: DataFrame) -> DataFrame:
    """(host, shape, template, eb, en) of shapes with b blocked of n labelled URLs (host, shape, b, n): the template, and the labels of the nearest node that has enough."""
    none = F.lit(0).cast("long")
    hosts = counts.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
    alive = counts.withColumns({"eb": none, "en": none, "t": F.lit(""), "seg": F.split("shape", "/", -1)})
    alive = checkpointed(alive.join(hosts, "host").select("host", "shape", "b", "n", "t", "seg", *_evidence("hb", "hn")))
    done = None
    while True:
        node, child = ["host", "t"], ["host", "t", "s"]
        alive = alive.withColumn("s", F.get("seg", F.lit(0)))
        children = checkpointed(alive.groupBy(*child).agg(F.sum("b").alias("cb"), F.sum("n").alias("cn"), F.count(F.lit(1)).alias("shapes")))
        nodes = children.groupBy(*node).agg(
            F.count(F.lit(1)).alias("fan"), F.count_if(F.col("cn") > 0).alias("labelled"), F.sum("cb").alias("tb"), F.sum("cn").alias("tn"), F.sum("shapes").alias("below")
        )
        double = lambda *names: [F.col(c).cast("double") for c in names]
        similar = (F.col("labelled") >= 2) & _similar(*double("cb", "cn", "tb", "tn"))
        wild = (F.col("s") != "") & F.when(F.col("cn") > 0, similar).otherwise((F.col("fan") > MAX_FAN) | (F.col("labelled") >= 2))
        named = children.join(nodes, node).withColumn("t2", F.concat("t", F.lit("/"), F.when(wild, "*").otherwise(F.col("s"))))
        named = checkpointed(named.select(*child, "t2", "cb", "cn", (F.col("below") == 1).alias("alone")))
        merged = named.groupBy("host", "t2").agg(F.sum("cb").alias("mb"), F.sum("cn").alias("mn"))
        moved = alive.join(named.select(*child, "t2", "alone").join(merged, ["host", "t2"]), child)
        rest = F.slice("seg", F.lit(2), F.greatest(F.size("seg") - 1, F.lit(0)))
        # A shape that is alone below its node keeps its segments; all of its nodes have its own labels.
        whole = F.when(F.col("alone"), F.concat_ws("/", "t", F.array_join("seg", "/"))).otherwise(F.col("t2"))
        moved = checkpointed(moved.select("host", "shape", "b", "n", whole.alias("t"), F.when(F.col("alone"), F.slice("seg", 1, 0)).otherwise(rest).alias("seg"), *_evidence("mb", "mn")))
        over = moved.where(F.size("seg") == 0).select("host", "shape", F.col("t").alias("template"), "eb", "en")
        done = over if done is None else done.unionByName(over)
        alive = moved.where(F.size("seg") > 0)
        if alive.isEmpty():
            return done
