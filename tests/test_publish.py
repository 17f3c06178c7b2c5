"""Atomic publication: failures midway, conflicting publishers, stored views, expiry."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerwash.plans.marts import publish_workflow
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.publish import Conflict, Publication, store_published_views


@pytest.fixture
def root(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"pub-{uuid.uuid4().hex[:8]}")


def _numbers(spark, n):
    return spark.range(n).withColumn("word", F.concat(F.lit("w"), F.col("id")))


def test_a_version_is_published_whole_and_old_versions_stay_readable(spark, root):
    p = Publication(spark, root)
    assert p.versions() == [] and p.version().number == 0
    with pytest.raises(KeyError):
        p.read("a")
    p.publish({"a": _numbers(spark, 3), "b": _numbers(spark, 4)}, notes={"by": "first"})
    p.publish({"a": _numbers(spark, 5)})
    assert p.versions() == [1, 2] and p.version().notes == {"by": "first"}
    assert (p.read("a").count(), p.read("b").count(), p.read("a", 1).count()) == (5, 4, 3)


def test_a_job_that_fails_midway_leaves_the_old_marts(spark, root):
    p = Publication(spark, root)
    p.publish({"a": _numbers(spark, 3), "b": _numbers(spark, 3)})
    failing = _numbers(spark, 50).withColumn("word", F.when(F.col("id") == 37, F.raise_error(F.lit("broken row"))).otherwise(F.col("word")))
    with pytest.raises(Exception, match="broken row"):
        p.publish({"a": _numbers(spark, 9), "b": failing})
    again = Publication(spark, root)
    assert again.versions() == [1]
    assert (again.read("a").count(), again.read("b").count()) == (3, 3)


def test_a_reader_keeps_its_version_while_the_next_is_published(spark, root):
    p = Publication(spark, root)
    p.publish({"a": _numbers(spark, 3)})
    held = p.read("a")
    p.publish({"a": _numbers(spark, 8)})
    assert held.count() == 3 and p.read("a").count() == 8


def test_of_two_publishers_from_one_version_the_second_fails(spark, root):
    p = Publication(spark, root)
    p.publish({"a": _numbers(spark, 1)})
    base = p.version()
    mine, theirs = p.write({"a": _numbers(spark, 2)}), p.write({"a": _numbers(spark, 3)})
    p.commit(base, replaced=theirs)
    with pytest.raises(Conflict):
        p.commit(base, replaced=mine)
    assert p.read("a").count() == 3
    assert not [f for f in os.listdir(f"{root}/commits") if f.endswith(".tmp")]
    p.commit(p.version(), appended=mine)
    assert p.read("a").count() == 5 and len(p.folders("a")) == 2


def test_expiry_keeps_what_the_last_versions_name(spark, root):
    p = Publication(spark, root)
    for n in range(1, 5):
        p.publish({"a": _numbers(spark, n), **({"b": _numbers(spark, 7)} if n == 1 else {})})
    orphan = p.write({"a": _numbers(spark, 2)})["a"][0]
    assert p.expire(keep=2) == []  # too young to tell from a publisher at work
    gone = p.expire(keep=2, grace_seconds=-5)
    assert len(gone) == 2 and orphan.split("/")[1] in gone  # and version 2's; version 1's still holds b
    assert p.versions() == [3, 4]
    assert (p.read("a").count(), p.read("a", 3).count(), p.read("b").count()) == (4, 3, 7)


def test_stored_views_move_last(spark, root):
    p = Publication(spark, root)
    spark.sql("CREATE DATABASE IF NOT EXISTS published_here")
    spark.sql("USE published_here")
    try:
        p.publish({"v_a": _numbers(spark, 3)})
        store_published_views(p, ["v_a"])
        p.commit(p.version(), appended=p.write({"v_a": _numbers(spark, 2)}))
        seen = lambda: spark.newSession().sql("SELECT count(*) FROM published_here.v_a").first()[0]
        assert seen() == 3
        store_published_views(p, ["v_a"])
        assert seen() == 5
    finally:
        spark.sql("DROP DATABASE published_here CASCADE")
        spark.sql("USE default")


def test_the_workflow_is_published_with_one_commit_or_not_at_all(spark, tables, root):
    names = ["vw_monthly_summary", "monthly_debit_line"]
    version = publish_workflow(spark, tables.raw, tables.customers_raw, root, only=names)
    p = Publication(spark, root)
    assert version.number == 1 and set(version.tables) == {"clean_fact", *names}
    months = p.read("monthly_debit_line").count()
    assert months > 0 and p.read("clean_fact").count() == tables.clean.count()
    twice = tables.customers_raw.unionByName(tables.customers_raw)
    with pytest.raises(AssertionError, match="not unique"):
        publish_workflow(spark, tables.raw, twice, root, only=names)
    assert p.versions() == [1] and p.read("monthly_debit_line").count() == months
