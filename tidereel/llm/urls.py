"""URL filters with a path-template tree.

Labels come from explicit host and path rules. For each host, paths become
templates: digits in a segment are a variable part, and sibling branches merge
into a wildcard unless their share of block labels differs from their parent's;
a branch without labels can't be told apart and merges like any other, so it is
judged by what is known of its like. A template is rejected by its smoothed
labelled purity: the share of block labels among its labelled pages and a few
pseudo-labels, of which as many are block as in the branch above; a host's are
half and half, so no host is condemned without labels of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (verdict, host and path). Fixed values of the contract; a longer rule wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Levels of the tree; deeper segments form one last level.
DEPTH = 6
#: A branch stays apart at this many standard errors and this many labelled pages; pseudo-labels from the branch above; share at which a template is rejected.
APART, SUPPORT, PRIOR, REJECT = 1.96, 5, 4.0, 0.75


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the longest rule that fits and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template_verdicts(shapes: DataFrame) -> DataFrame:
    """``shapes(host, shape, block, allow)`` to ``(host, shape, template, purity, reject)``.

    ``shape`` is the path with its digits generalised; there is one row for
    each host and shape, so hot hosts are summed up before they are shuffled.
    Segments beyond the sixth level form one last segment together. A host
    without any label has a purity of one half.
    """
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/", DEPTH)
    t = shapes.select("host", "shape", (F.col("block") + F.col("allow")).alias("n"), "block", parts.alias("seg"), F.lit("").alias("prefix"), F.lit(0.5).alias("up"))
    shrunk = lambda block, n: (F.col(block) + PRIOR * F.col("up")) / (F.col(n) + PRIOR)
    for d in range(DEPTH):
        child = F.get("seg", F.lit(d))
        branch = t.where(child.isNotNull()).groupBy("host", "prefix", child.alias("child")).agg(F.sum("n").alias("cn"), F.sum("block").alias("cb"))
        parent = branch.groupBy("host", "prefix").agg(F.sum("cn").alias("pn"), F.sum("cb").alias("pb"))
        share = (F.col("pb") + 0.5) / (F.col("pn") + 1.0)
        z = F.abs((F.col("cb") + 0.5) / (F.col("cn") + 1.0) - share) / F.sqrt(share * (1 - share) / F.greatest("cn", F.lit(1)))
        kept = branch.join(parent, ["host", "prefix"]).select("host", "prefix", "child", F.when((z >= APART) & (F.col("cn") >= SUPPORT), F.col("child")).otherwise("*").alias("name"))
        node = t.groupBy("host", "prefix").agg(F.sum("n").alias("nn"), F.sum("block").alias("nb"), F.first("up").alias("up")).select("host", "prefix", shrunk("nb", "nn").alias("share"))
        kept = kept.join(node, ["host", "prefix"])
        t = t.withColumn("child", F.coalesce(child, F.lit("\n"))).join(kept, ["host", "prefix", "child"], "left")
        ends = F.col("name").isNull()
        t = durable(t.select("host", "shape", "n", "block", "seg", F.when(ends, F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "name")).alias("prefix"), F.when(ends, F.col("up")).otherwise(F.col("share")).alias("up")))
    template = t.groupBy("host", "prefix").agg(F.sum("block").alias("tb"), F.sum("n").alias("tn"), F.first("up").alias("up"))
    judged = template.select("host", "prefix", shrunk("tb", "tn").alias("purity"))
    return t.join(judged, ["host", "prefix"]).select("host", "shape", F.col("prefix").alias("template"), "purity", (F.col("purity") >= REJECT).alias("reject"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, hidden: Column | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict, template, purity)`` for each row.

    A rule's verdict stands; else that of the template. Where ``hidden`` holds,
    a row counts as one without a rule, to try the templates on labels that
    they haven't seen. Urls without a host
    form a host of their own (the empty one). Repeated rows each keep their
    row; an empty table gives an empty result; urls of any length are taken
    whole; other columns may have any names.
    """
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (F.lit(False) if hidden is None else hidden).alias("hidden"))
    rows = rows.select("id", "host", "path", F.when(~F.col("hidden"), rule_of(F.col("host"), F.col("path"), rules)).alias("r"), F.regexp_replace("path", "[0-9]+", "<n>").alias("shape"))
    count = lambda v: F.count_if(F.col("r.verdict") == v)
    shapes = durable(rows.groupBy("host", "shape").agg(count("block").alias("block"), count("allow").alias("allow")))
    judged = template_verdicts(shapes)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("reject"), "block").otherwise("allow"))
    return rows.join(judged, ["host", "shape"]).select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op9_path_templates(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's url."""
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))
