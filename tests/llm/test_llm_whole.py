"""Results that must be whole: moved passages, repeated rows, skewed labels, lonely
vectors, deep pages, long secrets."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwash.llm import ann, decontam, extract, licenses, pii, scratch, toxicity
from test_llm_edges import PROSE, brute_leaks, docs


# op10

def test_decontamination_finds_moved_parts(spark):
    rng = random.Random(11)
    vocabulary = [a + b + c for a in "bcdfghklm" for b in "aeiou" for c in "nrst"]
    items = [(i, " ".join(rng.sample(vocabulary, n))) for i, n in enumerate((44, 59, 59, 52))]
    items.append((4, " ".join(["again and again we say it"] * 8)))
    rows = [(9, "")]
    for i, item in items:
        words = item.split()
        for n, cut in enumerate((len(words) // 2, len(words) // 3, 12, len(words) - 9)):
            moved = words[cut:] + words[:cut]
            before, after = (rng.choices(vocabulary, k=k) for k in ((0, 0), (0, 30), (30, 0), (25, 25))[n])
            rows.append((100 + 10 * i + n, " ".join(before + moved + after)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.leaks(docs(spark, rows), bench).collect()}
    for i, text in rows:
        assert got[i].item_ids == ",".join(map(str, sorted(brute_leaks(text, items)))), (i, text)
    assert all(got[100 + 10 * i].contaminated for i in range(4))


# op6

def test_toxicity_scores_follow_the_labels_shares_in_a_small_sample(spark):
    rng = random.Random(7)
    words = PROSE.split()
    rows = [(i, " ".join(rng.choices(words, k=12)) + (" vile" * (i % 20 == 0))) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(3000)], "doc_id bigint, toxic int")
    every = docs(spark, rows)
    silent = docs(spark, [(1, None)])

    def prior(model):
        return silent.select(toxicity.toxicity_score(F.col("text"), model).alias("s")).first().s

    whole, small = toxicity.fit(every, labels), toxicity.fit(every, labels, per_class=60)
    odds = lambda s: math.log(s / (1 - s))
    assert abs(odds(prior(small)) - odds(prior(whole))) < 1.2
    scores = every.select("doc_id", toxicity.toxicity_score(F.col("text"), small).alias("s")).collect()
    assert not [r.doc_id for r in scores if r.s >= 0.5 and r.doc_id % 20]


# op7

def test_licenses_of_repeated_rows(spark):
    text = "Under the MIT license, and cc by nc"
    rows = [(1, text)] * 3 + [(None, text)] * 2 + [(2, text), (2, "cc by nc")]
    got = licenses.scan(docs(spark, rows), licenses.templates(spark)).collect()
    assert sorted((str(r.doc_id), r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == sorted(
        [("1", 2, 0, 5, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)] * 3 + [("None", 2, 0, 5, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)] * 2
        + [("2", 2, 0, 5, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), ("2", 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)])


# op3

def test_nearest_of_outliers_and_of_one_ids_vectors(spark):
    rng = np.random.default_rng(3)
    centers = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    x = centers[rng.integers(0, 40, 1500)] + 0.01 * rng.standard_normal((1500, 64))
    lonely = centers[40:] + 0.001 * rng.standard_normal((24, 64))
    rows = [(i, v.tolist()) for i, v in enumerate((*lonely, *x))]
    one = rng.standard_normal(64)
    rows += [(5000, (one + 1e-3 * rng.standard_normal(64)).tolist()) for _ in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {}
    for r in ann.search(df, F.col("vec_id").isin([*range(24), 100, 5000])).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == {*range(24), 100, 5000}
    for q, got in found.items():
        assert [n for n, _ in sorted(got)] == [1, 2, 3, 4, 5], (q, got)
        assert len({v for _, v in got}) == 5 and q not in {v for _, v in got}


@pytest.mark.parametrize("count,centers", [(60, 0), (700, 0), (700, 12), (6000, 40)])
def test_recall_at_any_size(spark, count, centers):
    rng = np.random.default_rng(count + centers)
    x = rng.standard_normal((count, 32))
    if centers:  # a third of all around one center
        owner = np.where(rng.random(count) < 1 / 3, 0, rng.integers(0, centers, count))
        x = rng.standard_normal((centers, 32))[owner] + 0.3 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, block=256).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = range(0, count, 20)
    assert set(found) == set(asked)
    hit = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -2
        assert len(found[q]) == 5
        hit += len(found[q] & set(np.argsort(-score)[:5].tolist()))
    assert hit / (5 * len(asked)) >= 0.9


def test_a_hot_list_copies_no_rows_of_others(spark):
    lists = [0] * 1000 + [n for n in range(1, 10) for _ in range(10)]
    probed = [0] * 500 + [n for n in range(1, 9) for _ in range(5)]
    base = spark.createDataFrame(list(enumerate(lists)), "id bigint, list int")
    asks = spark.createDataFrame(list(enumerate(probed)), "id bigint, list int")
    left, right = ann._dealt(base, asks, 50)
    copies = lambda df: {r.list: r["count"] for r in df.groupBy("list").count().collect()}
    assert copies(left) == {0: 1000 * 10} | dict.fromkeys(range(1, 9), 10)  # nobody probes list 9
    assert copies(right) == {0: 500 * 20} | dict.fromkeys(range(1, 9), 5)
    meet = left.join(right.withColumnRenamed("id", "q"), ["list", "part", "chunk"]).select("id", "q")
    assert meet.count() == meet.distinct().count() == 1000 * 500 + 8 * 10 * 5
    assert max(r["count"] for r in left.groupBy("list", "part", "chunk").count().collect()) < 2 * 50


# op8

def test_extraction_at_any_depth(spark):
    deep = "<div>" * 5000
    rows = [("nested", "<article>" + deep + "<p>a</p><p>b</p><nav>menu</nav><div class=ads>buy</div><form>mail</form>c" + "</div>" * 5000
             + "</article><p>after</p>"),
            ("unclosed", "<body>" + "<section>x" * 3000 + "<article><p>a</p><p>b</p></article><footer>f</footer><p>after"),
            ("plain", "<body>" + deep + "<nav>" + "menu " * 40 + "</nav><p>one</p><p>two</p>")]
    df = spark.createDataFrame([(n, f"http://{n}.org", page) for n, page in rows], "page_id string, url string, html string")
    got = {r.page_id: r.text for r in extract.extracted(df).collect()}
    assert got["nested"] == "a\nb\nc"
    assert got["unclosed"] == "a\nb"
    assert got["plain"] == "one\ntwo"


def test_closing_tags_equal_a_walk_down_the_stack():
    page = "<table><tr><td>1<p>x<td>2<tr><th>3<ul><li>a<ul><li>b</ul><li>c</ul></table><p>d<div>e<p>f</div>g<dl><dt>h<dd>i</dl>"
    out = [[]]
    extract._blocks(extract.tree(page), out)
    assert [t for t in map("".join, out) if t] == ["1", "x", "2", "3", "a", "b", "c", "d", "e", "f", "g", "h", "i"]


# op5

def test_long_secrets_are_found_whole():
    auto = pii._automaton()
    for size in (16, 512, 513, 5000):
        secret = "eyJ" + "x" * (size - 3)
        text = f'token = "{secret}" and password: \'{secret}\''
        spans = [(k, text[a:b]) for k, a, b in pii.find_spans(text, auto)]
        assert spans == [("secret", secret)] * 2
        assert secret not in pii._cleaned(text, pii.find_spans(text, auto))
    assert not pii.find_spans('token="' + "x" * 600, auto)
    started = time.monotonic()
    pii.find_spans("token=\"token:'x" * 100_000 + "token=" * 100_000, auto)
    assert time.monotonic() - started < 20


# pipeline

MORE = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, mark string, size string, fp string, n string, "
        "row string, label string, t string, buckets string, tags map<string,string>")


def odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (6, PROSE), (6, PROSE), (7, PROSE), (None, "nobody home at all"),
            (None, "nobody home at all"), (8, "x" * 200_000), (9, "word " * 40_000), (10, "mail me: ann@example.org \U0001f600"),
            (11, "before " + " ".join(f"w{i}" for i in range(30)) + " after")]
    more = [None, *"abcdefgh"]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None, None if k % 3 else 5, *more, {"k": str(k)} if k % 2 else None)
                                  for k, (i, t) in enumerate(rows)], MORE).repartition(3)


def side_tables(spark, folder, labels, items):
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P
    item = " ".join(f"w{i}" for i in range(30))
    sf = side_tables(spark, tmp_path, [(4, 1, None), (None, 1, 1), (77, 0, 1), (6, 1, 0)], [(1, item), (2, None), (3, ""), (4, "one"), (None, None)])
    docs = odd_documents(spark)
    before = docs.collect()
    stages = dict(P.STAGES)
    told = {n: [r for r in stages[n](spark, docs, sf).collect()] for n in stages}
    as_sorted = lambda rows: sorted(map(repr, rows))
    assert as_sorted(told["toxicity"]) == as_sorted(before)  # one kind of label teaches nothing
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in told["near_duplicates"]) == [
        (False, 1), (False, 4), (False, 6), (False, 8), (False, 9), (False, 10), (False, 11), (True, 0)]
    assert all(r in before for r in told["near_duplicates"])
    assert as_sorted(told["decontamination"]) == as_sorted(r for r in before if r.doc_id != 11)
    for r in told["personal_data"]:
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert r.text == ("mail me: [EMAIL] \U0001f600" if r.doc_id == 10 else next(b.text for b in before if b.doc_id == r.doc_id))
    assert sum(r.length for r in told["packing"] if r.doc_id == 1) == 1
    six = [r for r in told["packing"] if r.doc_id == 6]
    assert sum(r.length for r in six) == 2 * six[0].doc_tokens
    assert {r.doc_id for r in told["packing"]} == {r.doc_id for r in before}
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "packing":
            assert stage(spark, docs, sf).schema == docs.schema
    none = side_tables(spark, tmp_path / "none", [], [])
    for name in ("toxicity", "decontamination"):
        assert as_sorted(stages[name](spark, docs, none).collect()) == as_sorted(before)


def test_the_pipeline_deletes_what_its_operators_wrote(spark, tmp_path):
    import os

    import corpus_pipeline as P
    sf = side_tables(spark, tmp_path, [(4, 1, 0), (6, 1, 1)], [(1, PROSE)])
    odd_documents(spark).write.parquet(f"{sf}/documents.parquet")
    shared = scratch.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    with scratch.owned(spark):
        assert P.run(spark, sf).count() > 0
        left = {n for n in set(os.listdir(shared)) - before if n.startswith("llm-")}
        assert sorted(n.split("-")[1] for n in left) == sorted(n for n, _ in P.STAGES[:-1])
    assert not {n for n in set(os.listdir(shared)) - before if n.startswith("llm-")}
    with pytest.raises(ZeroDivisionError), scratch.owned(spark):
        scratch.written(spark.range(3), "lost")
        1 / 0  # noqa: B018
    assert not {n for n in set(os.listdir(shared)) - before if n.startswith("llm-")}


def test_a_bitmap_splits_rows_and_loses_no_key(spark):
    from ledgerwash.llm import bitmap
    rows = spark.range(4000).selectExpr("IF(id % 40 = 0, NULL, id) AS a", "CAST(id % 3 AS STRING) AS b", "id AS _n")
    keys = rows.where("_n % 9 = 0").select("a", "b").distinct()
    told = {(r.a, r.b) for r in keys.collect()}
    for most, spared in ((bitmap.MOST, 0.8), (0, 0.0)):
        clear, touched = (part.collect() for part in bitmap.split(rows, keys, ["a", "b"], most or 1))
        assert sorted(r["_n"] for r in [*clear, *touched]) == list(range(4000))
        assert not any((r.a, r.b) in told for r in clear) and len(clear) >= spared * 4000 * 8 / 9
    clear, touched = bitmap.split(rows, keys.limit(0), ["a", "b"])
    assert clear.count() == 4000 and touched.count() == 0
    # A full bitmap (more keys than bits) sends all rows the long way.
    full = spark.range(600_000).selectExpr("id AS a", "'x' AS b")
    clear, touched = bitmap.split(rows, full, ["a", "b"], 1)
    assert clear.count() == 0 and touched.count() == 4000


def test_only_rows_that_may_go_are_shuffled(spark, tmp_path):
    from ledgerwash.llm import bitmap, simhash
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(300)] + [(900, " ".join(f"w7x{j}" for j in range(12)))]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(300))
    clear, touched = bitmap.split(docs, docs.where("doc_id = 900").select("doc_id"), ["doc_id"])
    assert 1 <= touched.count() <= 3 and clear.count() + touched.count() == 301
    # The wide side of the join (above the broadcast one in the plan) passes no exchange.
    wide = clear._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in wide and "Exchange" not in wide
