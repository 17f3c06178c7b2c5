"""Spelling variants, source mixing and conversation repair against brute force, and
the cases mended in the operators of earlier rounds."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwash.llm import ann, blocks, chat, mixing, repair, spelling, urlfilter
from ledgerwash.llm.registry import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def _rows(spark, table, *columns, sf=MIDDLE):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


# blocks

def test_numbered_rows_and_scans_follow_one_order(spark):
    rows = [(random.Random(i).randrange(40), i) for i in range(500)]
    got = blocks.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in got) == list(range(500))
    values = [(k, b, [ord(k) * 100 + b]) for k in "pq" for b in range(3, 60)] + [("lone", 7, [1])]
    df = spark.createDataFrame(values, "key string, block bigint, value array<bigint>")
    join = lambda a, b: np.concatenate([a, b])
    for last_first in (False, True):
        got = {(r.key, r.block): r.before for r in blocks.scan(df, join, last_first, radix=2).collect()}
        assert len(got) == len(values)
        for k, b, _ in values:
            want = [v[0] for x, y, v in values if x == k and (y > b if last_first else y < b)]
            assert (got[k, b] or []) == want


# op11

def brute_words(rows, damage=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            n[word] += len(word) >= 6
    return {w: c for w, c in n.items() if c >= 5}


def brute_variants(n):
    near = defaultdict(set)
    letters = set("".join(n))
    for w in n:
        for i in range(len(w)):
            for x in [w[:i] + w[i + 1:], *(w[:i] + c + w[i + 1:] for c in letters)]:
                if x != w and x in n:
                    near[w].add(x)
                    near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def test_spelling_equals_brute_force(spark):
    got = [tuple(r) for r in QUERIES["op11_spelling"](spark, MIDDLE).collect()]
    want = brute_variants(brute_words(_rows(spark, "documents", "doc_id", "text")))
    assert len(got) == len(want) > 1000
    assert {w: tuple(rest) for w, *rest in got} == want
    assert sum(v[0] is not None for v in want.values()) > 100


def test_spelling_of_repeated_letters_chains_and_long_words(spark):
    rng = random.Random(1)
    n = {"".join(rng.choice("aab") for _ in range(rng.randint(0, 6))): rng.choice([5, 7, 30, 200, 2000]) for _ in range(150)}
    n |= {"é" * k: 5 ** k for k in range(1, 9)} | {"x" * 3000: 9, "x" * 3001: 100, "y" + "x" * 3000: 7}
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(words, bits=2).collect()}
    assert got == brute_variants(n)
    assert got["ééé"][1] == "é" * 8  # a chain of forms is followed to its end


def test_spelling_of_odd_rows(spark):
    rows = [(None, "Straße straßE STRASSE " * 5), (1, None), (2, ""), (2, "abcdef" * 40_000), (3, "Größer größer grösser × ÷ÿÿÿÿÿÿĀbcdefg " * 9)]
    rows += [(4, "ÀBCdefg àbcdefg")] * 6
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, word string, n string").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling.report(df).collect()}
    assert got == brute_variants(brute_words(rows))
    assert "Àbcdefg" in got and got["Àbcdefg"][3] == 2
    assert spelling.report(df.limit(0)).collect() == []


def test_a_run_is_counted_alike_in_short_and_long_texts(spark):
    text = "Wondering wandering " * 60_000
    got = {r.word: r.n for r in spelling.counts(spark.createDataFrame([(1, text), (1, text[:4000])], "doc_id bigint, text string")).collect()}
    assert got == brute_words([(1, text), (1, text[:4000])])


# op12

def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return share | stopped
        stopped |= above


def check_mix(rows, got, near):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    assert Counter((i, s, n, round(t, 4)) for i, s, n, t, _ in got) == Counter(
        (i, words(text), sizes[source], round(targets[source], 4)) for i, text, source in rows)
    assert all(0 <= taken <= 3 * size for _, size, _, _, taken in got)
    taken, wanted = Counter(), Counter()
    for _, _, n, t, words_taken in got:
        taken[n, round(t, 4)] += words_taken
    for s, n in sizes.items():
        wanted[n, round(targets[s], 4)] += targets[s]
    for k, t in wanted.items():
        assert abs(taken[k] - t) <= max(near, 0.01 * t), (k, taken[k])


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rows = _rows(spark, "documents", "doc_id", "text", "source")
    got = [tuple(r) for r in QUERIES["op12_mixing"](spark, MIDDLE).collect()]
    check_mix(rows, got, 1)
    again = mixing.report(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter(got)


@pytest.fixture(scope="module")
def odd_sources():
    rng = random.Random(5)
    texts = [None, "", "a b", " \t one\n", "\x1c\xa0 \x0b", *("x " * k for k in range(0, 40, 3))]
    rows = [(rng.choice([None, *range(50)]), rng.choice(texts), rng.choice(["p", "q", "ü", None])) for _ in range(400)]
    return rows + [(None, "q w e", None)] * 6000 + [(9, None, "without words")] * 3 + [(8, "word " * 30_000, "long")]


def test_mix_of_odd_rows_and_small_blocks(spark, odd_sources):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd_sources], "doc_id bigint, text string, source string, s string, size int").repartition(4)
    check_mix(odd_sources, [tuple(r) for r in mixing.report(df, shard_blocks=10, bucket=50, block=7).collect()], 20)
    assert mixing.report(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.report(df.where("source = 'without words'")).collect()] == [0, 0, 0]


def test_mix_pieces_are_whole_and_shards_are_equal(spark, odd_sources):
    df = spark.createDataFrame(odd_sources, "doc_id bigint, text string, source string")
    items = mixing.written(mixing._dealt(df, "doc_id", "text", "source"), "items")
    plan = mixing.written(mixing.source_plan(items, block=50), "sources")
    quota = {r.s: r.quota for r in plan.collect()}
    drawn = mixing.drawn(plan, shard_blocks=16).collect()
    assert Counter(r.s for r in drawn) == Counter({s: q for s, q in quota.items() if q})
    assert len({(r.s, r.block, r["round"]) for r in drawn}) == len(drawn)
    shards = Counter(r.shard for r in drawn)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == -(-len(drawn) // 16)
    pieces = mixing.mix(items, plan, shard_blocks=16).collect()
    for r in pieces:
        assert 0 <= r["first"] < r["first"] + r.length <= r.size
    for shard, own in itertools.groupby(sorted(pieces, key=lambda r: (r.shard, r.place)), key=lambda r: r.shard):
        assert [r.place for r in own] == list(range(1, 1 + sum(p.shard == shard for p in pieces)))


def test_hypergeometric_draws_have_the_right_law(spark):
    for pool, own, want in ((20, 7, 9), (500, 100, 50), (6, 6, 2), (6, 0, 2), (10, 4, 10)):
        draw = mixing._hypergeometric(f"{pool}L", f"{own}L", f"{want}L", "u")
        got = np.array([r.x for r in spark.range(4000).selectExpr("(id + 0.5D) / 4000D AS u").selectExpr(f"{draw} AS x").collect()])
        mean = want * own / pool
        var = mean * (1 - own / pool) * (pool - want) / max(pool - 1, 1)
        assert max(0, want - (pool - own)) <= got.min() and got.max() <= min(own, want)
        assert abs(got.mean() - mean) < 0.02 and abs(got.var() - var) < 0.02 * max(var, 1)


# op13

FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            for _ in range(1 + (fate == 3)):
                yield conv, turn, "user" if fate == 4 else role, text


def brute_repair(rows):
    """Backwards over a conversation: least (cost, audit) behind each state."""
    out = {}
    damaged = defaultdict(list)
    for conv, turn, role, text in brute_damage(rows):
        damaged[conv].append((turn, role, text))
    for conv in {r[0] for r in rows}:
        own = sorted(damaged[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0d]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        ends = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", (("assistant", ""),)), "s": (6, "II", (("user", ""), ("assistant", "")))}
        for (_, role, text), fault in zip(reversed(own), reversed(faults), strict=True):
            here = {}
            for state in ends:
                ways = [(4 + ends[state][0], "D" + ends[state][1], ends[state][2])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    to = FOLLOWS.get((state, role[:1]))
                    if to:
                        ways.append((more + ends[to][0], "K" + ends[to][1], ((role, text), *ends[to][2])))
                    to = NEXT[state]
                    ways.append((3 + more + ends[to][0], "R" + ends[to][1], ((NAMES[to], text), *ends[to][2])))
                here[state] = min(ways)
            for _ in range(3):
                for state, to in NEXT.items():
                    here[state] = min(here[state], (3 + here[to][0], "I" + here[to][1], ((NAMES[to], ""), *here[to][2])))
            ends = here
        cost, audit, told = ends[""]
        turns, initials = [t for t, _, _ in own if t is not None], [r[:1] for _, r, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark):
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, MIDDLE).collect()}
    assert got == brute_repair(_rows(spark, "conversations", "conv_id", "turn", "role", "text"))
    assert {c for r in got.values() for c in r[6]} == set("DIKR")


def test_repair_over_many_blocks_with_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(300)]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
             rng.choice(["a.", "b", "", None, " \t", "c!\n", "d?", " ", str(rng.random())])) for _ in range(700)]
    rows += [(4, 1, "user", "again.")] * 60 + [(5, t, "ua"[t % 2], f"{t}.") for t in range(90)]
    monkeypatch.setattr(repair.judged, "__defaults__", (2,))  # blocks of four rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, place int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df, repair.damaged(df.repartition(5))).collect()}
    assert got == brute_repair(rows)
    assert repair.report(df.limit(0), df.limit(0)).collect() == []
    none_left = repair.report(df, df.limit(0)).collect()
    assert len(none_left) == 6 and {tuple(r)[1:] for r in none_left} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_least_paths_rank_equal_letters_by_what_follows():
    """Arcs of one letter to several nodes: the ranks of longer paths decide."""
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(2, 14)
        arcs = [(a, rng.randint(1, 2), b) for a in range(n - 1) for b in range(a + 1, n) if rng.random() < 0.35]
        word = {}
        for v in reversed(range(n)):
            word[v] = min(((x, *word[b]) for a, x, b in arcs if a == v), default=())
        src, letter, dst = (np.array(c, np.int64) for c in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
        levels = repair.least_paths(src, letter, dst, n)
        of, nodes, _ = repair.spelled(levels, np.arange(n))
        for v in range(n):
            assert tuple(levels[0][0][nodes[of == v]]) == word[v]
        last = levels[-1][0]
        assert [sorted(word.values()).index(word[v]) for v in range(n)] == [sum(last < last[v]) for v in range(n)]


# op1, op3, op4

def test_a_conversation_of_many_turns_is_walked_without_chained_broadcasts(spark):
    rows = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    got = chat.format_trees(chat.chains(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 3
    (r,) = got.select("n_turns", "formatted").collect()
    assert r.n_turns == 20_000 and [t for _, t in chat.parse(r.formatted)] == [f"t{i}" for i in range(20_000)]


def test_nearest_of_very_large_and_small_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.choice([-310, -200, -3, 0, 200, 307])).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    unit = ann._unit([v for _, v in rows])
    for q in (0, 20, 40):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(60), -score))[:5]
        assert [got[q, k + 1][0] for k in range(5)] == best.tolist()
        assert all(abs(got[q, k + 1][1] - score[best[k]]) < 1e-9 for k in range(5))


def test_parts_of_a_hot_ending_are_dealt_without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        places = spark.range(300).selectExpr("concat('h', id, '.com') AS host", "concat('/', id % 7, '/') AS path")
        rules = spark.createDataFrame([("com", "/1/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
        found = urlfilter.matched(places, rules, keys_a_sweep=20)
        assert "hashpartitioning(ending" in (plan := found._jdf.queryExecution().executedPlan().toString())
        window = plan[plan.index("Window"):]
        assert re.match(r"hashpartitioning\(ending#\d+, part#\d+", window[window.index("hashpartitioning"):])
        assert found.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# op10, pipeline

def test_the_hamming_index_finds_all_within_the_radius_and_few_others(spark):
    from ledgerwash.llm import decontam
    rng = random.Random(12)
    prints = [rng.getrandbits(64) for _ in range(400)]
    near = []
    for i, p in enumerate(prints[:300]):
        for bit in rng.sample(range(64), rng.randint(0, 15)):
            p ^= 1 << bit
        near.append(p)
    near += [rng.getrandbits(64) for _ in range(500)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    windows = spark.createDataFrame([(f"w{i}", 7, signed(p)) for i, p in enumerate(near)], "window_id string, n int, print bigint")
    items = spark.createDataFrame([(i, 7, signed(p)) for i, p in enumerate(prints)], "item_id bigint, n int, print bigint")
    met = {(r.window_id, r.item_id) for r in decontam.candidates(windows, items).select("window_id", "item_id").collect()}
    within = {(f"w{i}", j) for i, a in enumerate(near) for j, b in enumerate(prints) if (a ^ b).bit_count() <= decontam.RADIUS}
    assert within <= met and len(within) >= 300
    assert len(met - within) <= 0.05 * len(near) * len(prints)


def test_passages_at_the_threshold_are_found(spark):
    """Passages with one word in 25 replaced: recall against brute force."""
    from ledgerwash.llm import decontam
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(rng.randint(30, 60))] for _ in range(150)]
    rows, want = [], set()
    for i, item in enumerate(items):
        told = list(item)
        for at in rng.sample(range(len(told)), rng.choice([0, 1, 1])):
            told[at] = word()
        text = [word() for _ in range(20)] + told + [word() for _ in range(20)]
        rows.append((i, " ".join(text)))
        grams = Counter(zip(*(item[j:] for j in range(5)), strict=False))
        n, own = sum(grams.values()), list(zip(*(text[j:] for j in range(5)), strict=False))
        best = max((c := sum((Counter(own[s:s + n]) & grams).values())) / (2 * n - c) for s in range(len(own) - n + 1))
        want |= {i} if best >= 0.8 else set()
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {r.doc_id for r in decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).where("contaminated").collect()}
    assert got <= want and len(want) > 100 and len(got) >= 0.99 * len(want)


def test_one_row_of_each_group_stays_whatever_its_columns(spark):
    from ledgerwash.llm import simhash
    same = "one two three four five six seven"
    rows = [(3, same, 2, {"k": 1}), (3, same, 1, {"k": 2}), (3, same, 1, {"k": 2}), (5, same, 0, None), (None, same, 0, None),
            (None, "quite another text here", 4, {}), (None, "quite another text here", 3, {}), (8, "a third text of words", 9, {})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rank int, extra map<string,int>").repartition(3)
    got = sorted((r.doc_id or -1, r.text, r["rank"], r.extra) for r in simhash.keep_one(df).collect())
    assert got == [(-1, "quite another text here", 3, {}), (3, same, 1, {"k": 2}), (8, "a third text of words", 9, {})]
    assert simhash.keep_one(df.limit(0)).collect() == []


# op8

def neutral(page):
    """The page without any tag name or class word that tells what a group is."""
    names = {t: f"x{i}" for i, t in enumerate("article main nav aside footer header form button section".split())}
    page = re.sub(rf"<(/?)({'|'.join(names)})\b", lambda m: f"<{m[1]}{names[m[2]]}", page)
    words = lambda m: m[1] + '="' + " ".join(f"n{zlib.crc32(w.encode()) % 9973}" for w in m[2].split()) + '"'
    return re.sub(r'\b(class|id|role)="([^"]*)"', words, page)


def test_wrappers_find_the_article_where_nothing_names_it(spark):
    """All pages come out alike when tags and classes say nothing; not so without wrappers."""
    import json

    from ledgerwash.llm import extract
    told = {r.page_id: (r.text, r.url) for r in QUERIES["op8_extract"](spark, MIDDLE).collect()}
    pages = spark.createDataFrame([(i, u, neutral(h or "")) for i, u, h in _rows(spark, "pages", "page_id", "url", "html")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract.extracted(pages).collect()}
    assert got == {i: t for i, (t, _) in told.items()} and len(got) == 250
    alone = {r.page_id: extract.main_text(r.html, None) for r in pages.collect()}
    assert sum(alone[i] != t for i, t in got.items()) >= 4
    hosted = pages.select(extract.host_of(F.col("url")).alias("host"), F.col("html").alias("page"))
    assert {r.path and json.loads(r.path)[-1] for r in extract.wrappers(hosted).collect()} == {"x0"}


def test_alignment_is_a_longest_common_subsequence_of_any_length():
    from ledgerwash.llm import extract
    rng = random.Random(7)
    for _ in range(200):
        x, y = (np.array([rng.randrange(4) for _ in range(rng.randint(0, 14))], np.int64) for _ in "xy")
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(reversed(range(len(x))), reversed(range(len(y)))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        pairs = extract.common(x, y)
        assert len(pairs) == best[0][0] and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs))
    long = np.arange(4000) % 7
    assert len(extract.common(long, np.concatenate([long[5:], [9], long[:5]]))) >= 3995
    page = "<html><body>" + "".join(f"<p class=c{i % 900}>a{i}</p><div class=d{i % 901}>b{i}</div>" for i in range(3000)) + "</body></html>"
    other = re.sub(">([ab])", r">z\1", page).replace("<p class=c7>", "<h2>new</h2><p class=c7>")
    assert extract.article_path(extract.infer([page, other]), False) == ["html", "body"]


def test_a_host_of_long_pages_has_a_wrapper(spark):
    from ledgerwash.llm import extract
    pages = [(f"http://h/{i}", f"<html><body><x1>menu {i}</x1><x2><p>{'word ' * 60_000}</p><p>{i}</p></x2></body></html>") for i in range(3)]
    df = spark.createDataFrame(pages, "url string, html string")
    hosted = df.select(extract.host_of(F.col("url")).alias("host"), F.col("html").alias("page"))
    assert extract.wrappers(hosted).count() == 1


def test_wrappers_come_from_all_pages_of_a_host(spark, monkeypatch):
    """One long page of 300 tells that a group's text is not the same on all: no sample holds it for sure."""
    import json

    from ledgerwash.llm import extract
    shared = "terms of use " * 20
    pages = [(f"h{h}",
              f"<html><body><x0><p>{shared if i else 'an article ' * 500}</p><h2>end</h2></x0><x1><p>number</p><h2>{i}</h2></x1></body></html>") for h in range(2) for i in range(300)]
    hosted = spark.createDataFrame([*pages, *pages[:50], ("h2", pages[0][1]), ("h2", pages[0][1]), ("h3", ""), ("h3", None)], "host string, page string")
    for fan in (extract.FAN, 1000, 7):
        monkeypatch.setattr(extract, "FAN", fan)
        got = {r.host: json.loads(r.path)[:3] for r in extract.wrappers(hosted).collect()}
        assert got == {"h0": ["html", "body", "x0"], "h1": ["html", "body", "x0"], "h2": ["html", "body", "x0"]}


def test_patterns_survive_packing_at_any_depth():
    from ledgerwash.llm import extract
    page = "<html><body><ul><li>a<li>b</ul><p class='x y'>t</p><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end</body></html>"
    wrapper = extract.infer([page, page.replace("<ul>", "<h1>new</h1><ul>")])
    flat = lambda top: [(g.tag, g.names, g.text, g.size, g.optional, g.repeated, len(g.inner)) for g in extract._outwards(top)]
    assert flat(extract.unpacked(extract.packed(wrapper))) == flat(wrapper) and len(flat(wrapper)) > 3000


# op6

def test_training_equals_a_plain_loop_over_coordinates(spark):
    """FTRL-proximal, one coordinate at a time in plain Python, over the same rows."""
    import math

    from ledgerwash.llm import toxicity
    rng = random.Random(3)
    vocabulary = ["good", "fine", "calm", "vile", "hate", "scum", "word", "text", "more", "last"]
    rows = []
    for i in range(400):
        toxic = rng.random() < 0.5
        rows.append((i, " ".join(rng.choice(vocabulary[3:6] if toxic and rng.random() < 0.5 else vocabulary) for _ in range(rng.randint(1, 12))), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), bits=10)
    trains = df.where(~toxicity.held_out(F.col("doc_id")))
    order = [r.doc_id for r in trains.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    hasher = toxicity.Hasher(10)
    by_id = {i: (t, y) for i, t, y in rows}
    z, n, bias = defaultdict(float), defaultdict(float), 1 << 10

    def weight(c):
        penalty = 0.0 if c == bias else 8.0
        return 0.0 if abs(z[c]) <= penalty else -(z[c] - math.copysign(penalty, z[c])) / ((1.0 + math.sqrt(n[c])) / 1.0 + 1.0)

    for _ in range(4):
        for i in order:
            text, label = by_id[i]
            coordinates = [*sorted(set(hasher.buckets(text).tolist())), bias]
            w = {c: weight(c) for c in coordinates}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for c in coordinates:
                sigma = math.sqrt(n[c] + g * g) - math.sqrt(n[c])
                z[c] += g - sigma * w[c]
                n[c] += g * g
    want = {c: weight(c) for c in range(1 << 10) if weight(c) != 0.0}
    assert len(want) > 5 and model.bucket.tolist() == sorted(want)
    assert np.allclose(model.weight, [want[c] for c in sorted(want)], rtol=1e-9)
    assert abs(model.bias - weight(bias)) < 1e-9
