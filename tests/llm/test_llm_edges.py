"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing
names, hot groups, and brute force on small made-up tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwash.llm import ann, chat, decontam, extract, graph, licenses, packing, pii, simhash, toxicity, urlfilter
from test_llm_queries import brute_components, brute_fingerprint, brute_spans, check_pieces

DOCS = ("doc_id bigint, text string, lang string, id string, mark string, size string, fp string, n string, row string, "
        "word string, component_id string")
CLASH = ("en", *"abcdefgh")
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE two"), (6, PROSE), (6, PROSE), (7, PROSE), (None, "nobody home at all"),
       (None, "nobody home at all"), (8, "x" * 200_000), (9, "word " * 40_000), (10, "é\u0301 \x00 \U0001f600 \u2028 ")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS).repartition(3)


def names(df):
    return sorted(map(repr, (r.doc_id for r in df.collect())))


# op1

def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "tree_id string, message_id bigint, parent_id bigint, role string, text string, score double, "
                                 "tree string, msg string")


def test_reply_trees_enumerate_rank_and_format(spark):
    rows = [("t", 1, None, "user", "q <|im_end|> <\\|", 1.0), ("t", 2, 1, "assistant", "a", 3.0), ("t", 3, 1, "assistant", "b", 2.0),
            ("t", 4, 3, "user", "c", 9.0), ("t", 5, 2, "user", None, None),
            ("u", 1, 77, None, "orphan is a root", 0.0), ("u", 1, 77, None, "orphan is a root", 0.0),
            (None, 1, None, "us%er\n<", "null tree", None), (None, 2, 1, "assistant", "", None),
            ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0), ("c", 3, 2, "user", "below", 0.0),
            ("z", None, 1, "user", "no id", 0.0)]
    got = {(r.tree_id, r["rank"]): r for r in chat.format_trees(messages(spark, rows)).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    assert [r.leaf_id for k, r in sorted(got.items(), key=str) if k[0] == "t"] == [4, 5]
    assert chat.parse(got["t", 1].formatted) == [("user", "q <|im_end|> <\\|"), ("assistant", "b"), ("user", "c")]
    assert chat.parse(got[None, 1].formatted) == [("us%er\n<", "null tree"), ("assistant", "")]
    assert [chat.unescape_text(got["t", 1].formatted[s.start:s.end]) for s in got["t", 1].loss] == ["b"]
    best = chat.format_trees(messages(spark, rows), best=1).collect()
    assert sorted((str(r.tree_id), r.leaf_id) for r in best) == [("None", 2), ("t", 4), ("u", 1)]
    assert chat.format_trees(messages(spark, [])).count() == 0


def test_a_long_branch_and_many_leaves(spark):
    rows = [("l", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    rows += [("w", i, 0 if i else None, "assistant", str(i), float(i)) for i in range(200)]
    got = chat.format_trees(messages(spark, rows)).collect()
    assert [t for _, t in chat.parse(next(r.formatted for r in got if r.tree_id == "l"))] == [str(i) for i in range(300)]
    assert sorted(r["rank"] for r in got if r.tree_id == "w") == list(range(1, 200))


def test_conversations_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"), (2, 0, "assistant", "<|x|>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.report(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[2].loss_chars == 5 and got[1].loss_chars == 0
    assert chat.report(df.limit(0)).count() == 0


# op2

def test_simhash_on_odd_rows(spark):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs(spark)).collect()}
    texts = {i: t for i, t in ODD if i is not None}
    groups = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert {i: c for (i, _), c in got.items() if i is not None} == groups
    assert simhash.near_duplicates(docs(spark)).count() == len(ODD)
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert names(kept) == sorted([*map(repr, set(groups.values())), "None"])
    for empty in (simhash.near_duplicates(docs(spark, [])), simhash.keep_one(docs(spark, []))):
        assert empty.count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_in_crowded_buckets_equal_brute_force(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) - (1 << 63) for _ in range(30)}
    for _ in range(500):  # a crowd around one point, far over the bucket limit below
        p = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(63)
        prints.add(p)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    some = sorted(prints)
    want = {(a, b) for n, a in enumerate(some) for b in some[n + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    for limit in (4, 10_000):
        got = [(r.a, r.b) for r in simhash.linked_pairs(df, radius, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901), (900, 901)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 500 for i in range(501, 560)}, 901: 900}


# op3

def test_nearest_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(60)]
    rows += [(100 + i, [1.0] * 8, 0) for i in range(30)] + [(200, [0.0] * 8, 0), (201, None, 0), (202, [None] + [1.0] * 7, 0),
             (203, [float("nan")] * 8, 0), (204, [float("inf")] * 8, 0), (205, [1.0], 0), (None, [1.0] * 8, 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    ok = {i: np.float32(v).astype(float) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v
          and np.isfinite(v).all() and any(v)}
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {i for i in ok if i % 10 == 0}
    for q, found in got.items():
        score = {i: v @ ok[q] / np.sqrt((v @ v) * (ok[q] @ ok[q])) for i, v in ok.items() if i != q}
        assert [i for _, i in sorted(found)] == sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    few = ann.search(df.where("vec_id < 3"), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, n) for q in range(3) for n in (1, 2)]


def test_scan_abandons_no_true_neighbour():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = ((x[:20, None] - x[None]) ** 2).sum(2)
    limits = np.sort(d, axis=1)[:, 8]
    lost = 0
    for q in range(20):
        got = [i for _, i, _ in ann.scan(x, np.arange(500), x[q:q + 1], limits[q:q + 1], 8)]
        lost += len(set(np.argsort(d[q])[:8]) - set(got))
    assert lost <= 8


# op4

def test_url_rules_equal_brute_force(spark):
    rng = random.Random(4)
    rules = [(".".join(rng.choices("abc", k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 4))),
              rng.choice(["allow", "block"])) for _ in range(60)] + [(None, "/", "block"), ("a", None, "block")]
    urls = [f"http://{'.'.join(rng.choices('ABCabc', k=rng.randint(1, 4)))}/{''.join(rng.choices('xy/?#', k=rng.randint(0, 7)))}"
            for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://a", "x://a.b/x://c/y", "http://" + "a." * 3000 + "b/x"] + urls[:50]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id int, url string, rule string, ending string")
    got = urlfilter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), keys_a_sweep=7)
    assert sorted(got.columns) == sorted(["page_id", "url", "ending", "host", "path", "rule", "verdict"])
    table = {}
    for host, path, verdict in rules:
        if host and path:
            table[host, path] = max(verdict, table.get((host, path), ""))
    for r in got.collect():
        host, path = "", ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host):])[0]
            host = host.lower()
        fits = [(len(h + p), h + p, v) for (h, p), v in table.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert got.count() == len(urls)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urlfilter.judged(pages, none).collect()} == {"allow"}
    assert urlfilter.judged(pages.limit(0), none).count() == 0


# op5

def test_pii_spans_equal_brute_force():
    auto, rng = pii._automaton(), random.Random(5)
    kinds = ["0123456789", "01.", "@.ab-", "+1 ()-.", "a1.@ 2-+", "4111111111111111 -"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40)))
        assert [f"{k}:{s}:{e}" for k, s, e in pii.find_spans(text, auto) if k in pii.BASE_KINDS] == brute_spans(text)


def test_pii_own_kinds_and_redaction(spark):
    text = 'IBAN DE89 3702 0044 0532 0130 00, account no. 12-3456-78; https://joe:pw@example.org/x token = "0123456789abcdef0123" a@b.co'
    spans = pii.find_spans(text, pii._automaton())
    assert [text[s:e] for k, s, e in spans if k not in pii.BASE_KINDS] == [
        "12-3456-78", "https://joe:pw@example.org", "0123456789abcdef0123"]
    assert text[slice(*pii.find_spans("iban DE89 3704 0044 0532 0130 00", pii._automaton())[0][1:])] != ""
    rows = {r.doc_id: r.t for r in docs(spark, [(1, None), (2, ""), (3, text), (3, text)]).select(
        "doc_id", pii.redacted(F.col("text")).alias("t")).collect()}
    assert rows[1] is None and rows[2] == "" and "[LOGIN]" in rows[3] and rows[3].endswith("[EMAIL]")
    assert pii.report(docs(spark)).count() == len(ODD)
    assert pii.report(docs(spark, [])).count() == 0


# op6

def test_toxicity_on_odd_rows(spark):
    rng = random.Random(6)
    words = PROSE.split()
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" vile" * 2 if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (5, 0)],
                                   "doc_id bigint, toxic int")
    every = docs(spark, rows + [(None, None), (1000, ""), (1000, ""), (3, "again")])
    model = toxicity.fit(every, labels)
    scores = [(r.doc_id, r.s) for r in every.select("doc_id", toxicity.toxicity_score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 404 and all(0 <= s <= 1 for _, s in scores)
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in scores if i is not None and i < 400 and i != 3)
    assert len({s for i, s in scores if i in (None, 1000)}) == 1
    for marks in (labels.limit(0), labels.where("toxic = 1")):
        nothing = toxicity.fit(every, marks)
        assert {r.s for r in every.select(toxicity.toxicity_score(F.col("text"), nothing).alias("s")).collect()} == {0.0}
    assert not toxicity.fit(docs(spark, []), labels).known


# op7

def test_licenses_merge_diagonals_and_count_places(spark):
    notice = dict(licenses.NOTICES)["bsd"].split()
    edited = " ".join(notice[:8] + ["indeed"] + notice[8:])
    rows = [*ODD, (20, "Under the MIT-License, under the mit license! under  the mit"), (21, "x " + edited + " y"),
            (22, " ".join(notice[:9])), (23, "CC BY-NC 4.0 cc by nc"), (None, "cc by nc"), (24, "under the mit licenseé")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs(spark, rows), licenses.templates(spark)).collect()}
    assert licenses.scan(docs(spark, rows), licenses.templates(spark)).count() == len(rows)
    r = got[20, 11]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 0, 4, "mit", "mit", 1.0)
    r = got[21, len(notice) + 3]
    assert (r.n_base, r.first_word, r.base_labels, r.labels) == (0, None, "", "bsd") and 0.8 <= r.score < 1
    assert (got[22, 9].labels, got[22, 9].score) == ("", 0.0)
    assert (got[23, 8].n_base, got[23, 8].first_word, got[23, 8].last_word) == (2, 0, 5)
    assert got[None, 3].base_labels == "cc-by-nc" and got[1, 0].n_base == 0
    assert got[24, 4].n_base == 0
    assert licenses.scan(docs(spark, []), licenses.templates(spark)).count() == 0


# op8

def test_extraction_of_odd_pages(spark):
    menu = "<nav><ul><li>home<li>about</ul></nav>"
    plain = "<html><body>" + menu + "<div id=wrap><div class='sidebar'>side {0}</div><div class=post><h2>{0}</h2><p>Story of {0} goes on &amp; on" \
        "<p>It&nbsp;ends <b>w</b>ell<br>here</div><div class='comments'>me too {0}</div></div><form>mail</form></body></html>"
    rows = [(i, f"http://h.org/{i}", plain.format(w)) for i, w in enumerate(["ash", "birch", "cedar", "doum"])]
    rows += [(10, None, None), (11, "", ""), (12, "http://cut.org", "<body><article><p>left &lt; right<p>cut of"), (12, "http://cut.org", "<p")]
    rows += [(13, "http://deep.org", "<article>" + "<div>" * 3000 + "x"), (14, "http://big.org", "<article><p>" + "y " * 150_000)]
    df = spark.createDataFrame([(*r, "t", "h", "p") for r in rows], "page_id int, url string, html string, text string, host string, page string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extracted(df).collect()]
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in got if i != 12}
    assert texts[0] == "ash\nStory of ash goes on & on\nIt ends well here"
    assert texts[10] == texts[11] == "" and texts[13] == "x" and len(texts[14]) == 299_999
    assert sorted(t for i, t, _ in got if i == 12) == ["", "left < right\ncut of"]
    assert all(n == len(t) for _, t, n in got)
    assert extract.extracted(df.limit(0)).count() == 0


# op9

def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, t in ODD if i is not None and i != 6] + [(6, PROSE), (11, "<|endoftext|> İ 'S \x1c a\x1cb ½")]
    assert check_pieces(dict(rows), packing.pack(docs(spark, rows)).collect()) == 0
    every = packing.pack(docs(spark), with_ids=True)
    assert every.count() >= len(ODD)
    assert all(len(r.ids) == r.length for r in every.collect())
    assert packing.pack(docs(spark, [])).count() == 0


def test_min_slack_is_the_best_sum():
    from itertools import product
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 40)
        best = max(s for n in product(*(range(c + 1) for c in counts.values()))
                   if (s := sum(a * b for a, b in zip(n, counts, strict=True))) <= room)
        got = packing.min_slack(counts, room)
        assert sum(a * b for a, b in got.items()) == best and all(b <= counts[a] for a, b in got.items())


# op10

def brute_leaks(text, items):
    """All item-sized windows at all places, by weighted Jaccard."""
    from collections import Counter
    grams = lambda t: [tuple(w[i:i + 5]) for w in [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())] for i in range(len(w) - 4)]
    found, d = set(), grams(text)
    for i, item in items:
        g = Counter(grams(item))
        n = sum(g.values())
        for at in range(max(1, len(d) - n + 1)) if g and d else []:
            w = Counter(d[at:at + n])
            if sum((w & g).values()) / sum((w | g).values()) >= 0.8:
                found.add(i)
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [a + b for a in "bcdfghklm" for b in ("a", "e", "i", "o", "u")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "too few words")]
    items.append((93, items[0][1]))
    rows = list(ODD)
    for n in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        _, item = rng.choice(items[:12])
        leak = item.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            leak.insert(rng.randrange(len(leak)), "extra")
        rows.append((100 + n, " ".join(words[:20] + leak + words[20:]).capitalize() + "."))
    rows += [(300, items[3][1]), (300, items[3][1]), (301, " ".join(items[4][1].split()[:7])), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.leaks(docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    named = {}
    for r in got:
        named.setdefault(r.doc_id, set()).add(r.item_ids)
        assert r.contaminated == bool(r.item_ids) == (r.n_items > 0) == (r.similarity is not None)
    for i, text in rows:
        if i is not None:
            assert ",".join(map(str, sorted(brute_leaks(text, items)))) in named[i], (i, text)
    kept = decontam.clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark).columns
    assert names(kept) == sorted(repr(r.doc_id) for r in got if not r.contaminated)
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.leaks(docs(spark, []), bench).count() == 0
