"""URL filters: a sorted sweep of canonical keys over nested rule intervals.

A rule is a host and a path. With the host's labels reversed, all urls that a rule fits at one host
node lie in one interval of the sort order (node, path): the paths that start with the rule's. The
intervals of one node are nested or apart, so a sweep in key order that carries the rules open at the
latest rule start (its stack) finds, for every url, the rules that enclose it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fields, lower_ascii, n_ranges, range_of, shared_table, splitters

KINDS = "node string, path string, tie bigint"
BEFORE_ALL = -(2**63)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def _node(labels: Column, depth: Column) -> Column:
    return F.array_join(F.reverse(F.slice(labels, F.size(labels) - depth + 1, depth)), ".")


def _labels(host: Column) -> Column:
    return F.split(host, "\\.")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's node and path with the rules that enclose it, itself included, longest path first."""
    clean = (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    keyed = clean.withColumn("labels", _labels(F.col("host"))).select(
        _node(F.col("labels"), F.size("labels")).alias("node"), "path", "verdict",
        F.concat("host", "path").alias("rule"), F.size("labels").alias("depth"),
    )
    lengths = keyed.select("node", F.length("path").alias("n")).distinct()
    outer = keyed.select(
        "node", F.col("path").alias("start"), F.struct(F.length("path").alias("n"), "path", "verdict", "rule").alias("open")
    )
    return (
        keyed.join(lengths, "node")
        .where(F.col("n") <= F.length("path"))
        .withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n")))
        .join(outer, ["node", "start"])
        .groupBy("node", "path", "depth")
        .agg(F.sort_array(F.collect_list("open"), asc=False).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the page's path
    starts with the rule's; the longest rule (host and path together) wins, ``default`` holds without
    one. A null url or one without ``://`` has an empty host and path and fits no rule. Rules with a null
    or empty host are ignored; the same rule given with two verdicts takes the last in order (block before
    allow). Repeated pages stay as often as they are; an empty table gives no rows; other columns are not
    read. The number of suffixes of a host that are looked up is that of the deepest rule host.
    """
    host, path = url_parts(F.col("url"))
    rows = shared_table(
        fields(pages, page_id=page_id, url=url).select(
            F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")
        ),
        "urls",
    )
    stacks = shared_table(rule_stacks(rules), "url-rules")
    deepest = stacks.agg(F.max("depth")).first()[0] or 1
    labels = _labels(F.col("host"))
    keys = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))))).select(
        "row", "page_id", "host", _node(labels, F.col("depth")).alias("node"), "path", F.xxhash64("row").alias("tie")
    )
    n = keys.count()
    key = {c: F.col(c) for c in ("node", "path", "tie")}
    cuts = splitters(keys, key, F.lit(1.0), n, n_ranges(n))
    swept = _sweep(keys, stacks, key, cuts)
    fits = F.filter(
        "open.stack", lambda r: (F.col("open.node") == F.col("node")) & F.startswith(F.col("path"), r["path"])
    )
    best = F.get(fits, F.lit(0))
    found = swept.withColumn("best", F.when(best.isNotNull(), F.struct(F.length(best["rule"]).alias("n"), best["rule"].alias("rule"), best["verdict"].alias("verdict"))))
    return (
        found.groupBy("row", "page_id", "host", "path")
        .agg(F.max("best").alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def _sweep(keys: DataFrame, stacks: DataFrame, key: dict[str, Column], cuts: list[dict]) -> DataFrame:
    """The url keys, each with the latest rule start at or before it (``open``: node and stack)."""
    starts = stacks.select("node", "path", F.lit(BEFORE_ALL).alias("tie"), F.struct("node", "stack").alias("open"))
    starts = starts.withColumn("part", range_of(key, KINDS, cuts))
    # The last rule start before each range is open when its sweep begins.
    last = {r["part"]: r["m"] for r in starts.groupBy("part").agg(F.max(F.struct("node", "path")).alias("m")).collect()}
    carried, current = [], None
    for part in range(len(cuts) + 1):
        if part and current is not None:
            carried.append((part, current["node"], current["path"]))
        current = last.get(part, current)
    begun = keys.sparkSession.createDataFrame(carried, "part int, node string, path string")
    opened = starts.drop("part").join(begun, ["node", "path"]).unionByName(starts)
    urls = keys.withColumn("part", range_of(key, KINDS, cuts)).withColumn("is_url", F.lit(1))
    events = urls.unionByName(opened.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy("node", "path", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("is_url = 1")
