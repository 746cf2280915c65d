"""URL rules by sort-merge range joins, in DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot: `com.example.www.`. A rule's
host then covers the interval of keys that begin with its own key, and such intervals are nested or
apart. Hosts and rule hosts are sorted together by key, in ranges. The sweep over a range keeps a stack of
the open rule hosts: slot d holds the one of d labels opened last, and it is still open for a key that
begins with it. Each range starts with the stack that the ranges before it left.

The paths of a rule host are nested intervals in the same way. Paths of pages and of rules are sorted
together by rule host and path; the rule opened last before a page's path carries its stack, the rules
whose paths it begins with, and the first of these that the page's path begins with is the longest. So a
host of very many path rules costs a page no more than one of few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased; empty if there is none."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _carried(ranged: DataFrame, opened: dict[str, Column], order: list[str]) -> DataFrame:
    """`ranged(range, ...)` with columns of what was opened last, in the range or in those before it."""
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumns({name: F.last(value, ignorenulls=True).over(sweep) for name, value in opened.items()})
    place = F.struct(*order)
    left = ranged.withColumns(opened).groupBy("range").agg(*[F.max_by(name, F.when(F.col(name).isNotNull(), place)).alias(name) for name in opened])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = left.select("range", *[F.last(name, ignorenulls=True).over(before).alias(f"{name}_before") for name in opened])
    return swept.join(carried, "range").withColumns({name: F.coalesce(name, f"{name}_before") for name in opened})


def _ranged(events: DataFrame, *by: str) -> DataFrame:
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(events.repartitionByRange(n, *by).withColumn("range", F.spark_partition_id()))


def open_hosts(hosts: DataFrame, rule_hosts: DataFrame) -> DataFrame:
    """(key, host): for each distinct `hosts(key)` the keys of `rule_hosts(key)` that it begins with."""
    labels = F.size(F.split("key", r"\.", -1)) - 1
    depth = rule_hosts.agg(F.max(labels)).first()[0] or 0
    if not depth:
        return hosts.where(F.lit(False)).select("key", F.col("key").alias("host"))
    events = hosts.select("key", F.lit(1).alias("kind")).unionByName(rule_hosts.select("key", F.lit(0).alias("kind")))
    slots = {f"s{d}": F.when((F.col("kind") == 0) & (labels == d), F.col("key")) for d in range(1, depth + 1)}
    swept = _carried(_ranged(events, "key"), slots, ["key", "kind"])
    stack = F.filter(F.array(*slots), lambda s: F.col("key").startswith(s))
    return swept.where("kind = 1").select("key", F.explode(stack).alias("host"))


def with_stacks(rules: DataFrame) -> DataFrame:
    """`rules(host, path, r)` with stack: r of the rule and of those of its host whose paths its path begins
    with, the longest path first."""
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    shorter = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = rules.join(lengths, "host").select("host", "path", F.explode(shorter).alias("n")).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n")))
    above = rules.select("host", F.col("path").alias("prefix"), "r")
    stack = F.transform(F.sort_array(F.collect_list(F.struct("n", "r")), asc=False), lambda x: x["r"])
    return prefixes.join(above, ["host", "prefix"]).groupBy("host", "path").agg(stack.alias("stack"))


def longest(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best): for each distinct `paths(host, path)` the r of the longest of `rules(host, path,
    r)` that it begins with; paths without one have no row."""
    stacks = with_stacks(rules)
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = paths.select("host", "path", F.lit(1).alias("kind"), none.alias("stack")).unionByName(stacks.select("host", "path", F.lit(0).alias("kind"), "stack"))
    swept = _carried(_ranged(events, "host", "path"), {"open": F.when(F.col("kind") == 0, F.struct("host", "stack"))}, ["host", "path", "kind"])
    fits = F.filter("open.stack", lambda r: F.col("path").startswith(r["path"]))
    return swept.where((F.col("kind") == 1) & (F.col("open.host") == F.col("host"))).select("host", "path", F.get(fits, F.lit(0)).alias("best")).where("best is not null")


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules(host, path, verdict)`: a rule fits its host and all subdomains if the path begins with the
    rule's; of several the longest (host and path together, then the longer host) wins, of equal ones
    `block` before others. Where none fits, rule is null and the verdict is `default`. A null URL or
    one without `://` has an empty host and path. Rules with a null field or an empty host are not
    used. Repeated rows and null keys stay; columns of `pages` of the four names are replaced.
    """
    clash = [c for c in ("host", "path", "rule", "verdict", "__key", "__path") if c in pages.columns]
    rows = pages.drop(*clash).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn("__key", canonical(F.col("host")))
    usable = rules.where("host is not null and path is not null and verdict is not null and host <> ''")
    each = usable.select(canonical(_lower(F.col("host"))).alias("host"), "path", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("of_host"), (F.col("verdict") == "block").alias("blocks"), F.concat(_lower(F.col("host")), "path").alias("rule"), "path", "verdict").alias("r"))
    each = kept(each.groupBy("host", "path").agg(F.max("r").alias("r")))
    asked = kept(rows.select(F.col("__key").alias("key"), "path").distinct())
    open_now = open_hosts(asked.select("key").distinct(), each.select(F.col("host").alias("key")).distinct())
    probes = asked.join(open_now, "key")
    found = longest(probes.select("host", "path").distinct(), each)
    best = probes.join(found, ["host", "path"]).groupBy("key", "path").agg(F.max("best").alias("__best"))
    best = best.select(F.col("key").alias("__key"), F.col("path").alias("__path"), "__best")
    joined = rows.join(best, (rows["__key"] == best["__key"]) & (rows["path"] == best["__path"]), "left")
    return joined.select(*[rows[c] for c in rows.columns if c != "__key"], F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
