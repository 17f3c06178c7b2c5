"""The registered queries over whole tables, against SQL or brute force."""

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerwash.llm import extract, packing, pii, simhash
from ledgerwash.llm.registry import ORACLE_SQL, QUERIES
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


def _rows(spark, table, sf=SF):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    n, problems = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)
    assert n > 0
    assert not problems, problems


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in _rows(spark, "documents", MIDDLE)}
    groups = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, MIDDLE).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert len(set(groups.values())) < len(groups)


def test_nearest_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in _rows(spark, "embeddings", "/root/testdata/sf0.1")}
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = defaultdict(list)
    for r in QUERIES["op3_nearest"](spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    asked = [n for n, i in enumerate(ids) if i % 50 == 0]
    for n in asked:
        score = unit @ unit[n]
        score[n] = -2
        best = np.lexsort((ids, -score))[:5]
        got = sorted(found[ids[n]])
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(score[np.searchsorted(ids, v)] - s) < 1e-12 for _, v, s in got)
        hit += len({v for _, v, _ in got} & set(ids[best]))
    assert set(found) == {ids[n] for n in asked}
    assert hit / (5 * len(asked)) >= 0.9


def brute_spans(text):
    """The contract's patterns with plain regular expressions."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and sum(
                        sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                    "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), list(kinds).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_equals_brute_force(spark):
    import hashlib
    texts = {r.doc_id: r.text for r in _rows(spark, "documents", MIDDLE)}
    for r in QUERIES["op5_pii"](spark, MIDDLE).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS] == base
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in _rows(spark, "labels", sf)}
    rows = QUERIES["op6_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = ([s for s, y in judged if y == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert sum(s >= 0.5 for s in good) / len(good) < 0.01


def test_extraction_equals_a_plain_reader(spark):
    import html as entities
    for r in QUERIES["op8_extract"](spark, MIDDLE).join(
            spark.read.parquet(f"{MIDDLE}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = re.sub(r"<(/?[a-z0-9]*)?\Z", "", inside[1]) if inside else ""
        blocks = (re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", body))
        text = "\n".join(t for t in (" ".join(entities.unescape(b).split()) for b in blocks) if t)
        assert r.text == text
        assert r.n_chars == len(text)


def check_pieces(texts, rows):
    """Pieces tile each document, ids are the tokenizer's, sequences are gapless."""
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*whole.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def test_packing_is_an_exact_tiling_without_padding(spark):
    texts = {r.doc_id: r.text for r in _rows(spark, "documents", MIDDLE)}
    assert check_pieces(texts, QUERIES["op9_packing"](spark, MIDDLE).collect()) == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    leaked = {r.doc_id for r in QUERIES["op10_decontamination"](spark, SF).collect() if r.contaminated}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert P.ORACLE_SQL is None
    for name, stage in P.STAGES[:-1]:
        rows = {r.doc_id: r for r in stage(spark, docs, SF).collect()}
        if name == "toxicity":
            rejected = {r.doc_id for r in QUERIES["op6_toxicity"](spark, SF).collect() if r.predicted}
            assert set(rows) == set(before) - rejected
        elif name == "near_duplicates":
            groups = brute_components({i: brute_fingerprint(r.text) for i, r in before.items()})
            assert set(rows) == set(groups.values())
        elif name == "decontamination":
            assert set(rows) == set(before) - leaked
        else:
            assert set(rows) == set(before)
            assert not any(brute_spans(r.text) for r in rows.values())
            assert all(r.n_chars == len(r.text) for r in rows.values())
            assert all(r == before[i] for i, r in rows.items() if not pii.find_spans(before[i].text, pii._automaton()))
        if name != "personal_data":
            assert all(r == before[i] for i, r in rows.items())
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        before = {r.doc_id: r for r in docs.collect()}
    assert check_pieces({i: r.text for i, r in before.items()}, P.STAGES[-1][1](spark, docs, SF).collect()) == 0
    whole = P.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(before)


def test_wrappers_name_the_article(spark):
    page = "<html><body><nav>x</nav><article><h1>{0}</h1><p>{0} text</article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([("h", page.format(w)) for w in "abcdef"], "host string, page string")
    assert [json.loads(r.path) for r in extract.wrappers(pages).collect()] == [["html", "body", "article"]]


def test_covering_masks_miss_no_pair():
    for radius in (0, 1, 2):
        masks = simhash.covering_masks(radius)
        flips = [(a, b) for a in range(64) for b in range(a, 64)] if radius == 2 else [(a, a) for a in range(64)] if radius else []
        for a, b in flips:
            changed = (1 << a) | (1 << b)
            assert any(not m & changed for m in masks)
