"""URL filters: fixed rules first, then learned path templates per host.

Every host has a tree of path templates.  Its first level of generalisation is
the shape of a segment (numbers, hex strings, dates and file names become
wildcards).  Then, level by level over counts per host and shape, a node with
many children, none of them frequent, becomes one wildcard branch, and labelled
branches whose share of bad labels does not differ significantly from their
siblings' become one branch.  Out of the wildcard stay branches that a rule
decides, beside others that none does, and branches whose share of bad labels
differs significantly from their siblings': neither speaks for unlabelled ones.
A template is rejected if its share of bad labels, shrunk towards its host's and
the corpus's, is high; templates with hardly any labels, or merged ones whose
labels cover a small share of their urls or branches, are not judged.

All counting is by (host, shape), which tasks combine before they shuffle, so a
host with a third of the urls is a few rows.  Only path and label counts move;
pages meet their template by a join on (host, shape).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import pick, step

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Levels of the tree; deeper segments are one tail wildcard.
DEPTH = 8
#: A node is variable if it has at least this many children and its largest has at most this share of its urls.
FAN_OUT, SHARE = 20, 0.2
#: Standard deviations within which a branch is like its siblings; least labels for a template to be judged.
LIKE, LEAST_LABELS = 2.0, 5
#: Least share of a merged template's urls, and of its branches, that have labels for it to be judged.
COVER = 0.05
#: Weight of the prior in labels, and the shrunk share of bad labels above which a template is rejected.
PRIOR, LIMIT = 4.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or a url without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)  # up to the query or fragment
    host = F.translate(F.regexp_extract(before, r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(before, r"(?s)^[^/]*(/.*)?$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), else null."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first, as the outermost
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path's segments with variable ones as wildcards, at most DEPTH and a tail."""
    def segment(s):
        return (F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
                .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
                .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)))
                .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}")).otherwise(s))
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.transform(F.slice(segs, 1, DEPTH), segment)
    return F.when(F.size(segs) > DEPTH, F.concat(head, F.array(F.lit("{**}")))).otherwise(head)


def labelled_pages(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, shape, bad (1, 0 or null).

    Labels are (page_id, bad); without them, urls that a rule decides are the labelled ones.
    """
    rows = pick(pages, "page_id", "url")
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("rule_verdict"), shape(F.col("path")).alias("shape"))
    if labels is None:
        return rows.withColumn("bad", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("long")))
    known = pick(labels, "page_id", "bad").groupBy("page_id").agg((F.avg("bad") >= 0.5).cast("long").alias("bad"))
    return rows.join(known, "page_id", "left")


def templates(labelled: DataFrame) -> DataFrame:
    """host, shape, template, urls, labelled, bad, branches, known: every shape of a host with its template and that
    template's counts, also of its shapes and of those with labels."""
    counts = step(labelled.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"),
        F.count("rule").alias("r"))
        .withColumn("template", F.col("shape")), "shapes")
    deepest = counts.agg(F.max(F.size("shape")).alias("d")).first()["d"] or 0
    for level in range(1, deepest + 1):
        here = counts.filter(F.size("template") >= level).withColumn("above", F.slice("template", 1, level - 1)).withColumn("seg", F.element_at("template", level))
        branch = here.groupBy("host", "above", "seg").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"),
                                                          (2 * F.sum("r") >= F.sum("n")).alias("ruled"))
        # a branch is compared with all labelled ones beside it, so no two branches are ever paired
        node = branch.groupBy("host", "above").agg(
            F.count("*").alias("children"), F.count_if(F.col("l") >= LEAST_LABELS).alias("known"), F.max("n").alias("largest"), F.sum("n").alias("all"),
            F.every("ruled").alias("all_ruled"), F.sum(F.when(~F.col("ruled"), F.col("l"))).alias("ul"), F.sum(F.when(~F.col("ruled"), F.col("b"))).alias("ub"),
            F.sum(F.when(F.col("l") >= LEAST_LABELS, F.col("l"))).alias("nl"), F.sum(F.when(F.col("l") >= LEAST_LABELS, F.col("b"))).alias("nb"))
        p = F.col("nb") / F.col("nl")
        like = (F.col("l") >= LEAST_LABELS) & (F.col("known") > 1) & (F.abs(F.col("b") / F.col("l") - p) <= LIKE * F.sqrt(p * (1 - p) / F.col("l")))
        # against all labelled branches beside it that no rule decides; one without such branches beside it has nothing to be like
        others, pooled = F.col("ul") - F.col("l"), F.col("ub") / F.col("ul")
        unlike = (F.col("l") >= LEAST_LABELS) & ((others == 0) | (
            F.abs(F.col("b") / F.col("l") - (F.col("ub") - F.col("b")) / F.nullif(others, F.lit(0))) > LIKE * F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.nullif(others, F.lit(0))))))
        apart = F.when(F.col("all_ruled"), F.lit(False)).when(F.col("ruled"), F.lit(True)).otherwise(F.coalesce(unlike, F.lit(False)))
        variable = (F.col("children") >= FAN_OUT) & (F.col("largest") <= SHARE * F.col("all"))
        named = branch.join(node, ["host", "above"]).select(
            "host", "above", "seg", F.when(variable & ~apart, F.lit("{*}")).when(variable, F.col("seg")).when(like, F.lit("{~}")).otherwise(F.col("seg")).alias("now"))
        moved = here.join(named, ["host", "above", "seg"]).select(
            "host", "shape", "n", "l", "b", "r",
            F.concat("above", F.array("now"), F.slice("template", level + 1, DEPTH + 1)).alias("template"))
        counts = step(moved.unionByName(counts.filter(F.size("template") < level)), f"tree-{level}")
    per = counts.groupBy("host", "template").agg(F.sum("n").alias("urls"), F.sum("l").alias("labelled"), F.sum("b").alias("bad"),
                                               F.count("*").alias("branches"), F.count_if(F.col("l") > 0).alias("known"))
    return counts.select("host", "shape", "template").join(per, ["host", "template"])


def judged_templates(tree: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``tree`` and purity (shrunk share of bad labels), rejected."""
    per = tree.select("host", "template", "labelled", "bad").distinct()
    whole = per.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    corpus = (whole["b"] or 0) / whole["l"] if whole["l"] else 0.0
    hosts = per.groupBy("host").agg(((F.sum("bad") + F.lit(PRIOR * corpus)) / (F.sum("labelled") + F.lit(PRIOR))).alias("host_share"))
    purity = (F.col("bad") + PRIOR * F.col("host_share")) / (F.col("labelled") + PRIOR)
    covered = (F.col("branches") == 1) | ((F.col("labelled") >= COVER * F.col("urls")) & (F.col("known") >= COVER * F.col("branches")))
    return (tree.join(hosts, "host").withColumn("purity", purity)
            .withColumn("rejected", (F.col("labelled") >= LEAST_LABELS) & covered & (F.col("purity") > limit)))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity; a row per input row.

    A rule's verdict stands; else the template's (block if rejected).  Null urls and urls without ``://`` have
    empty host and path, and the template of the empty path of that host.
    """
    labelled = labelled_pages(pages, rules, labels)
    tree = step(judged_templates(step(templates(labelled), "templates"), limit).select(
        "host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "rejected"), "judged")
    return labelled.join(tree, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")
