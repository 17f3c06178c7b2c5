"""Discovery of spelling variants.

The rare values at the head of D11 are read by eye to find the spellings that C11 maps.
Here they are proposed: distinct names, reduced to letters and digits, are related if

* ``prefix``: one begins with the other (three characters at least: "mtn", "mtn airtime"),
* ``words``: one has one word more ("zenith transfer", "zenith bank transfer"),
* ``edit``: they are at most ``edits`` single-character edits apart ("shoprlte"),

and hold the same digits in order ("Merchant 61" is no variant of "Merchant 62").
Related names form groups, named by their most frequent one; a person then decides.

Nothing is compared all against all. Prefixes and shortened word lists meet by equality.
For edits, names are blocked by n-grams: two names within ``edits`` share all but
``n * edits`` of their n-grams, so they must share one of the ``n * edits + 1`` rarest;
common n-grams never become blocks. Candidates are then checked by ``levenshtein``.
All of this runs on distinct names, after one aggregation over the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LEAST = 3
GRAM = 3
EDITS = 1
LEAST_FOR_EDITS = 5


def reduced(name: Column) -> Column:
    """Letters and digits of a name, lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def _digits(form: str) -> Column:
    return F.regexp_replace(form, r"[^\p{N}]", "")


def _names(df: DataFrame, column: str) -> DataFrame:
    """(name, form, n) of the distinct names."""
    name = F.lower(F.trim(F.col(column)))
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        "name", reduced(F.col("name")).alias("form"), "n").where(F.length("form") > 0)


def _pairs(left: DataFrame, right: DataFrame, key: str, relation: str) -> DataFrame:
    """Pairs a < b of forms that meet in ``key``."""
    both = left.select(key, F.col("form").alias("x")).join(right.select(key, F.col("form").alias("y")), key).where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(relation).alias("relation"))


def relations(names: DataFrame, edits: int = EDITS, gram: int = GRAM) -> DataFrame:
    """(a, b, relation) between forms of ``names`` (name, form), a < b."""
    forms = names.select("form").distinct()
    lengths = F.sequence(F.lit(LEAST), F.length("form") - 1)
    begins = forms.where(F.length("form") > LEAST).select(
        "form", F.explode(F.transform(lengths, lambda k: F.substring("form", 1, k))).alias("key"))
    prefix = _pairs(begins, forms.where(F.length("form") >= LEAST).withColumn("key", F.col("form")), "key", "prefix")

    words = names.select("form", F.split(F.col("name"), r"\s+").alias("words"))
    less = words.where(F.size("words") > 2).select("form", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_join(
        F.filter("words", lambda w, j: j != i), " "))).alias("key"))
    shorter = _pairs(less, words.withColumn("key", F.array_join("words", " ")), "key", "words")

    # Padded, so that every form has as many n-grams as characters and two more.
    padded = F.concat(F.lit("^" * (gram - 1)), F.col("form"), F.lit("$" * (gram - 1)))
    starts = F.sequence(F.lit(1), F.length("form") + gram - 1)
    grams = forms.where(F.length("form") >= LEAST_FOR_EDITS - edits).select(
        "form", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, gram)))).alias("key"))
    common = grams.groupBy("key").agg(F.count(F.lit(1)).alias("forms"))
    rarest = Window.partitionBy("form").orderBy("forms", "key")
    blocks = grams.join(common, "key").withColumn("at", F.row_number().over(rarest)).where(F.col("at") <= gram * edits + 1)
    near = _pairs(blocks, blocks, "key", "edit").distinct().where(
        (F.greatest(F.length("a"), F.length("b")) >= LEAST_FOR_EDITS) & (F.levenshtein("a", "b", edits) >= 0))
    same_digits = _digits("a") == _digits("b")
    return prefix.unionByName(shorter).unionByName(near).where(same_digits).distinct()


def _groups(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, root): the least form of each connected group, by rounds of taking the
    least root among neighbours and following roots; each round is written."""
    spark = forms.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/variants-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = kept(forms.select("form", F.col("form").alias("root")), "0")
    turn = 0
    while True:
        turn += 1
        heard = links.join(roots.withColumnRenamed("form", "b"), "b").groupBy(F.col("a").alias("form")).agg(F.min("root").alias("heard"))
        nearer = roots.join(heard, "form", "left").select("form", "root", F.least("root", "heard").alias("next"))
        jump = roots.select(F.col("form").alias("next"), F.col("root").alias("jump"))
        then = kept(nearer.join(jump, "next", "left").select("form", F.col("root").alias("was"), F.least("next", "jump").alias("root")), str(turn))
        if then.where("was <> root").isEmpty():
            return then.select("form", "root")
        roots = then.select("form", "root")


def variant_candidates(df: DataFrame, column: str = "merchant_name", edits: int = EDITS) -> DataFrame:
    """(name, name_count, proposal, group_names): each distinct name (trimmed, lower
    case) of a group of two or more, the group's most frequent name (ties: smallest)
    and how many names it has. Runs jobs while the plan is built."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/variants-{uuid.uuid4().hex}"
    _names(df, column).write.parquet(path)
    names = spark.read.parquet(path)
    named = names.join(_groups(names.select("form").distinct(), relations(names, edits)), "form")
    best = F.min_by("name", F.struct((-F.col("n")).alias("less"), F.col("name")))
    groups = named.groupBy("root").agg(best.alias("proposal"), F.count(F.lit(1)).alias("group_names")).where("group_names > 1")
    return named.join(groups, "root").select("name", F.col("n").alias("name_count"), "proposal", "group_names")
