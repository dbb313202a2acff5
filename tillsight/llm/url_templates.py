"""URL filter: rules by host and path, and per host a tree of path templates judged by labelled purity.

Every host has a tree of path segments, grown for all hosts level by level:

1. Segments that vary by their form (numbers, dates, UUIDs, long hexadecimals) become ``{n}``, ``{d}``, ``{u}``,
   ``{h}``, their file ending kept.  What lies deeper than ``DEPTH`` segments becomes ``**``.
2. A segment rarer than ``MIN_ROWS`` below its node becomes ``*``.
3. A segment with ``MIN_LABELS`` labelled rows or more whose share of bad ones doesn't differ from that of the rest of its
   node (two-proportion test, ``Z`` standard errors) merges into ``*`` too.  One without enough labels stays apart:
   nothing shows that it is like the others.
4. A template (the segments that remain) is rejected if its smoothed purity, (bad + ``SMOOTH`` * ``PRIOR``) / (labelled +
   ``SMOOTH``), reaches ``REJECT``.  Templates without labels have the prior, so they pass.

Rows are first summed by host and generalised path, so a host with a third of all rows is a sum within tasks; the tree
works on these sums, and rows meet only the rejected paths.  The sums are written at each level.

A null url, or one without ``://``, has an empty host and path, and is judged like any other path of that host.
Repeated rows count as often as they occur and get the same verdict.  A path that itself holds ``*`` or ``{n}`` falls
into that template.  Columns of the input other than the named ones stay; those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm._tables import written

DEPTH = 8
MIN_ROWS, MIN_LABELS = 20, 10
Z = 2.576
SMOOTH, PRIOR, REJECT = 4.0, 0.2, 0.7

#: Forms of variable segments, tried in this order; an ending such as ``.html`` stays.
_END = r"(?=(?:\.[A-Za-z0-9]{1,5})?(?:/|$))"
FORMS = [
    (r"(?<=/)[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}" + _END, "{u}"),
    (r"(?<=/)[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?" + _END, "{d}"),
    (r"(?<=/)[0-9]+" + _END, "{n}"),
    (r"(?<=/)(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}" + _END, "{h}"),
]

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct of ``rule`` (host and path) and ``verdict`` of the longest rule that fits, else null.

    A rule (verdict, host, path) fits its host and all subdomains, if the path starts with its path.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def generalised(path: Column) -> Column:
    """The path with its variable segments replaced and everything below ``DEPTH`` segments as one."""
    for form, name in FORMS:
        path = F.regexp_replace(path, form, name.replace("{", r"\{"))
    parts = F.split(path, "/", DEPTH + 2)
    return F.when(F.size(parts) == DEPTH + 2, F.concat(F.array_join(F.slice(parts, 1, DEPTH + 1), "/"), F.lit("/**"))
                  ).otherwise(path)


def _level(state: DataFrame, depth: int) -> DataFrame:
    """Templates grown by the segment at ``depth`` (from 1): kept as it is, or ``*``."""
    grows = F.size("segments") > depth
    segment = F.when(grows, F.element_at("segments", depth + 1))
    now = state.withColumn("segment", segment)
    child = now.where(grows).groupBy("host", "template", "segment").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    node = child.groupBy("host", "template").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
    alike = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest) <= Z * error
    merges = F.when((F.col("labelled") >= MIN_LABELS) & (rest >= MIN_LABELS), alike).otherwise(F.lit(False))
    kept = (child.where(F.col("n") >= MIN_ROWS).join(node, ["host", "template"]).where(~merges)
            .select("host", "template", "segment", F.col("segment").alias("literal")))
    grown = F.concat("template", F.lit("/"), F.coalesce("literal", F.lit("*")))
    return now.join(kept, ["host", "template", "segment"], "left").select(
        "host", "path", "segments", F.when(grows, grown).otherwise(F.col("template")).alias("template"), "n", "bad",
        "labelled")


def grow(paths: DataFrame) -> DataFrame:
    """``host, path, template`` and the sums ``n, bad, labelled`` of every generalised path.

    ``paths`` has ``host``, ``path`` (generalised) and ``bad`` (boolean; null: not labelled) of every row.
    """
    summed = (paths.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"),
        F.count("bad").alias("labelled"))
        .select("host", "path", F.split("path", "/").alias("segments"), F.lit("").alias("template"), "n", "bad",
                "labelled"))
    state = written(summed, "url-paths")
    deepest = state.agg(F.max(F.size("segments"))).first()[0] or 1
    for depth in range(1, deepest):
        state = written(_level(state, depth), "url-paths")
    return state.drop("segments")


def templates(grown: DataFrame) -> DataFrame:
    """``host, template``, its sums, ``purity`` (smoothed share of bad rows) and whether it is ``rejected``."""
    purity = (F.col("bad") + SMOOTH * PRIOR) / (F.col("labelled") + SMOOTH)
    return (grown.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
            .withColumn("purity", purity).withColumn("rejected", F.col("purity") >= REJECT))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", bad: Column | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of every row's url.

    The verdict is the longest rule's, else ``block`` if the url's template is rejected, else ``allow``.
    Templates learn from ``bad`` (boolean column of ``pages``, null: no label) or, without it, from the rules: rows that
    one blocks are bad, all others good, since a rule about one branch tells nothing bad about the others.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    host, path = host_and_path(F.col(f"`{url}`"))
    label = F.lit(None).cast("boolean") if bad is None else bad
    row = pages.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), host.alias("host"), path.alias("path"),
                       label.alias("label"))
    row = row.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    learnt = F.coalesce(F.col("found.verdict") == "block", F.lit(False)) if bad is None else F.col("label")
    shape = generalised(F.col("path"))
    grown = grow(row.select("host", shape.alias("path"), learnt.alias("bad")))
    rejected = (grown.join(templates(grown).where("rejected"), ["host", "template"], "left_semi")
                .select(F.col("host").alias("bad_host"), F.col("path").alias("bad_path")))
    judged = row.join(rejected, (F.col("host") == F.col("bad_host")) & (shape == F.col("bad_path")), "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return judged.select(*[F.col(f"row.`{c}`") for c in kept], "host", "path", F.col("found.rule").alias("rule"),
                         verdict.alias("verdict"))
