"""URL filter by path-template trees.

The paths of a host form a tree of segments. Runs of digits become ``#`` at
once. Going down, the children of a node that their labels do not tell apart
from their siblings are merged into one wildcard branch ``*``; those that a
two-proportion test tells apart stay branches of their own. A template is what
remains of a path; it is rejected if the smoothed share of good ones among its
labelled pages is too small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table, without
from pairloom.workspace import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LABELS = 5  # labelled pages that a branch and its siblings need to be told apart
Z = 1.96
PRIOR_PAGES = 10.0  # weight of the overall share, in labelled pages
MIN_PURITY = 0.5
PRIOR_PURITY = 0.6  # of templates that inherit: above the bound, so little evidence blocks nothing
BROADCAST_TEMPLATES = 200_000  # at about 200 bytes each; more are joined by a shuffle

# (verdict, host and path) of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands after the first ``://``, A-Z lower-cased; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none does; of equally long ones the first by name."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, _, rest = rule.partition("/")
        of_site = (host == site) | host.endswith("." + site)
        fits.append(F.when(of_site & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _segments(path: Column) -> Column:
    """The segments of a path with every run of digits as ``#``; empty ones are left out."""
    found = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(found, lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def _level(shapes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The shapes with one more step of their template, and the labelled nodes (host, template, n, b) of this level.

    Counts are added up by partial aggregation; what is joined back are the
    steps that stay literal: those that labels tell apart, at most one for
    ``MIN_LABELS`` labelled pages, and the only children of their node.
    """
    shapes = shapes.withColumn("step", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
    children = shapes.groupBy("host", "template", "step").agg(
        F.sum("labelled").alias("n1"), F.sum("bad").alias("b1"), F.count("*").alias("shapes")
    )
    children = materialize(children, "url-children")
    nodes = children.groupBy("host", "template").agg(
        F.sum("n1").alias("n"), F.sum("b1").alias("b"), F.count("*").alias("kinds"),
        F.sum("shapes").alias("shapes"), F.min("step").alias("step"),
    )
    told = children.where(F.col("n1") >= MIN_LABELS).drop("shapes").join(nodes.select("host", "template", "n", "b"), ["host", "template"])
    told = told.withColumns({"n2": F.col("n") - F.col("n1"), "b2": F.col("b") - F.col("b1")}).where(F.col("n2") >= MIN_LABELS)
    pooled = (F.col("b1") + F.col("b2")) / (F.col("n1") + F.col("n2"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    apart = F.abs(F.try_divide("b1", "n1") - F.try_divide("b2", "n2")) > Z * spread
    only = nodes.where("kinds = 1")
    literal = told.where(apart).select("host", "template", "step", F.lit(False).alias("alone")).unionByName(
        only.select("host", "template", "step", (F.col("shapes") == 1).alias("alone"))
    )
    steps = shapes.join(literal, ["host", "template", "step"], "left")
    rest = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments"), F.lit(1))), "/")
    step = F.when(F.col("alone"), rest).when(F.col("alone").isNull(), F.lit("*")).otherwise(F.col("step"))
    ended = F.col("step") == ""
    template = F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), step))
    moved = steps.select(
        "host", "segments", "labelled", "bad", template.alias("template"), (ended | F.coalesce("alone", F.lit(False))).alias("done")
    )
    return moved, nodes.where("n > 0").select("host", "template", "n", "b")


def template_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (host, segments, labelled, bad, template), a row for each shape of a path on a host, and the
    labelled nodes (host, template, n, b) of the trees, templates included.

    ``pages`` has host, path and bad (null: not labelled). Pages are added up
    by shape first. The tree goes down until no shape has a further segment; a
    shape that is alone below its node is settled at once, so one very long path
    costs no levels of its own.
    """
    shapes = pages.groupBy("host", _segments(F.col("path")).alias("segments")).agg(
        F.count("bad").alias("labelled"), F.coalesce(F.sum(F.when(F.col("bad"), 1).otherwise(0)), F.lit(0)).alias("bad")
    )
    going = materialize(shapes.withColumn("template", F.lit("")), "url-shapes")
    settled, nodes, level = [], [], 0
    while not going.isEmpty():
        moved, labelled = _level(going, level)
        moved = materialize(moved, "url-shapes")
        settled.append(moved.where("done").drop("done"))
        nodes.append(labelled)
        going, level = moved.where("NOT done").drop("done"), level + 1
    empty = going.limit(0)
    for part in settled:
        empty = empty.unionByName(part)
    templates = empty.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).where("n > 0")
    for part in nodes:
        templates = templates.unionByName(part)
    # A template that ends at an inner node counts its own pages only, not the node's.
    return empty, templates.groupBy("host", "template").agg(F.min_by(F.struct("n", "b"), "n").alias("c")).select("host", "template", "c.n", "c.b")


def _inherited(shapes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, template, n, b): the counts of the nearest labelled node on the way up, the template itself included."""
    names = shapes.select("host", "template").distinct()
    parts = F.split("template", "/", -1)
    up = names.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(
        "above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")
    )
    found = up.join(labelled.withColumnRenamed("template", "above"), ["host", "above"])
    nearest = F.max_by(F.struct("n", "b", (F.col("above") == F.col("template")).alias("own")), "depth")
    return found.groupBy("host", "template").agg(nearest.alias("c")).select("host", "template", "c.n", "c.b", "c.own")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to ``pages``, in place of columns of these names.

    ``bad_col`` says which pages are labelled bad or good, null leaves a page
    unlabelled. The verdict is that of the longest rule, else that of the
    template: its purity is the share of good labelled pages, smoothed by
    ``PRIOR_PAGES`` pages with the overall share. A template without labels
    has the purity of the nearest node above it that has some, smoothed by as
    many pages of ``PRIOR_PURITY``; without any label up to its host it is
    allowed, with purity 1. Null and malformed urls have an empty host and path
    and are judged by their own template. Repeated rows stay repeated.
    """
    names = ("host", "path", "rule", "template", "purity", "verdict")
    split = without(pages, names).withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    counted = split.select("host", "path", F.col(bad_col).alias("bad"))
    totals = counted.agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("b")).first()
    overall = 1 - totals["b"] / totals["n"] if totals["n"] else 1.0
    shapes, labelled = template_tree(counted)
    prior = PRIOR_PAGES * F.when(F.col("own"), F.lit(overall)).otherwise(PRIOR_PURITY)
    purity = (F.col("n") - F.col("b") + prior) / (F.col("n") + PRIOR_PAGES)
    judged = _inherited(shapes, labelled).select("host", "template", purity.alias("purity"))
    site, shape, key = (fresh(split, name) for name in ("tree_host", "tree_segments", "page_segments"))
    tree = shapes.join(judged, ["host", "template"], "left").select(
        F.col("host").alias(site), F.col("segments").alias(shape), "template", F.coalesce("purity", F.lit(1.0)).alias("purity")
    )
    templates = materialize(tree, "url-templates")
    if templates.count() <= BROADCAST_TEMPLATES:
        templates = F.broadcast(templates)
    keyed = split.withColumn(key, _segments(F.col("path")))
    judged = keyed.join(templates, (F.col("host") == F.col(site)) & (F.col(key) == F.col(shape)))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for verdict, name in rules for x in (name, verdict)]) if rules else None
    by_template = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    judged = judged.withColumn("rule", rule)
    verdict = F.coalesce(F.try_element_at(by_rule, "rule"), by_template) if rules else by_template
    return judged.withColumn("verdict", verdict).drop(site, shape, key)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``bad`` to ``pages``: whether the document that the url names by its last number is of low quality or toxic."""
    doc = fresh(pages, "labelled_doc")
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.where(known & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(doc)).agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(url_path(F.col("url")), r"(\d+)[^/\d]*/?$", 1).try_cast("bigint")
    return without(pages, ["bad"]).join(marks, number == F.col(doc), "left").drop(doc)


def op4_url_verdicts(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(labelled_pages(pages, read_table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
