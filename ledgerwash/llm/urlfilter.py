"""URL rules by a sort-merge range join.

A rule (host, path) stands for its host and all subdomains, and for every path
that begins with its own. With the host's labels reversed, the rule is a prefix
``org.example/es/`` and so an interval of sorted keys; a URL has one key for each
ending of its host (``org``, ``org.example`` ...), and a rule fits if it is a prefix
of one of them. Rules and keys are sorted together and swept by a window: each
rule carries the stack of nested rules that are open where it starts, each key
takes over the last stack before it, and the innermost rule of it that still
contains the key is the answer (all strings between a prefix and a string that
has it have that prefix too). Over the endings of a host the longest rule wins.

The sweep runs over distinct (host, path) pairs, of which only keys whose host
ending has rules are shuffled. A host ending with many keys is swept in several
parts, each of which gets the ending's rules. Built-in functions only.

Null and malformed URLs (no ``://``) have empty host and path and are judged like
any other. Of rules with the same host and path, ``block`` goes before ``allow``.
Rules with null host, path or verdict are ignored, as are other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS_A_SWEEP = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """(ending, start, stack) per rule: the rules it lies in, outermost first,
    itself last."""
    own = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
           .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
           .withColumn("ending", F.array_join(_reversed(F.col("host")), ".")))
    lengths = own.select("ending", F.length("path").alias("size")).distinct()
    outer = own.select("ending", F.col("path").alias("prefix"),
                       F.struct(F.length("path").alias("size"), "host", "path", "verdict").alias("rule"))
    inner = own.select("ending", F.col("path").alias("start")).join(lengths, "ending").where("size <= length(start)")
    inner = inner.withColumn("prefix", F.expr("substring(start, 1, size)"))
    return inner.join(outer, ["ending", "prefix"]).groupBy("ending", "start").agg(
        F.array_sort(F.collect_list("rule")).alias("stack"))


def matched(places: DataFrame, rules: DataFrame, keys_a_sweep: int = KEYS_A_SWEEP) -> DataFrame:
    """(host, path, rule, verdict) of those distinct (host, path) pairs that a rule
    fits."""
    stacks = _stacks(rules)
    deepest = stacks.agg(F.max(F.size(F.split("ending", r"\.")))).first()[0] or 0
    labels = _reversed(F.col("host"))
    ends = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1))))
    keys = (places.select("host", "path").distinct()
            .withColumn("ending", F.explode(F.transform(ends, lambda k: F.array_join(F.slice(labels, 1, k), "."))))
            .join(stacks.select("ending").distinct(), "ending", "left_semi"))
    parts = keys.groupBy("ending").agg(F.ceil(F.count("*") / keys_a_sweep).cast("int").alias("parts"))
    events = keys.join(parts, "ending").select(
        "ending", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"), F.col("path").alias("at"),
        F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    opened = stacks.join(parts, "ending").select(
        "ending", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("start").alias("at"),
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    sweep = Window.partitionBy("ending", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Both sides may come hashed by ``ending`` alone, which would leave all parts of one in one task.
    dealt = opened.unionByName(events).repartition("ending", "part")
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    inside = F.filter("open", lambda r: F.startswith(F.col("at"), r["path"]))
    found = swept.select("host", F.col("at").alias("path"), F.try_element_at(inside, F.lit(-1)).alias("r")).where("r IS NOT NULL")
    best = F.max(F.struct(F.length(F.concat("r.host", "r.path")), F.concat("r.host", "r.path").alias("rule"),
                          F.col("r.verdict").alias("verdict")))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url",
           keys_a_sweep: int = KEYS_A_SWEEP) -> DataFrame:
    """Every row of ``pages`` (its columns, but for those of the same names as the
    new ones) with host, path, rule and verdict."""
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new]
    url = F.col(url_col)
    rows = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    places = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.join(matched(places, rules, keys_a_sweep), ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
