"""Variant discovery: the known spellings are found, blocking loses nothing."""

import itertools
import random
import re

import pytest

from ledgerwash.operators import variants as V
from ledgerwash.sources.schema import MERCHANT_VARIANTS


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i + (len(short) == len(long)):] == long[i + 1:]


def brute(names):
    form = {n: re.sub("[^a-z0-9]", "", n) for n in names}
    out = set()
    for x, y in itertools.permutations(names, 2):
        a, b = form[x], form[y]
        if a == b or re.sub("[^0-9]", "", a) != re.sub("[^0-9]", "", b):
            continue
        u, v = x.split(), y.split()
        if len(a) >= 3 and b.startswith(a):
            out.add((min(a, b), max(a, b), "prefix"))
        if len(v) > 2 and any(v[:i] + v[i + 1:] == u for i in range(len(v))):
            out.add((min(a, b), max(a, b), "words"))
        if max(len(a), len(b)) >= 5 and distance_is_one(a, b):
            out.add((min(a, b), max(a, b), "edit"))
    return out


def relations(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "merchant string")
    return {tuple(r) for r in V.relations(V._names(rows, "merchant")).collect()}


def test_blocking_finds_every_related_pair(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() for _ in range(160)} - {""}
    names |= {" ".join(rng.choice(["zen", "bank", "go", "pay"]) for _ in range(rng.randint(1, 4))) for _ in range(40)}
    names |= {"shoprite", "shoprlte", "shopritte", "hoprite", "sho", "abcde", "bcde", "merchant 61", "merchant 62", "merchant 6"}
    names = {" ".join(n.split()) for n in names}
    assert relations(spark, names) == brute(names)


def test_the_known_spellings_are_found(spark):
    rows = [(s, 3) for variants in MERCHANT_VARIANTS.values() for s in variants]
    rows += [(f"Merchant {i}", 50) for i in range(60)] + [("Air Peace", 9), (None, 4), (" -- ", 2), ("", 1)]
    df = spark.createDataFrame([(n,) for n, c in rows for _ in range(c)] + [(canonical,) for canonical in MERCHANT_VARIANTS for _ in range(9)], "merchant_name string")
    got = {r.name: r for r in V.variant_candidates(df).collect()}
    for canonical, spellings in MERCHANT_VARIANTS.items():
        for s in {*spellings, canonical.lower()}:
            assert got[s].proposal == canonical.lower(), s
    assert sum(len(v) for v in MERCHANT_VARIANTS.values()) == 35
    assert not [n for n in got if n.startswith(("merchant", "air"))]


def test_chains_of_relations_are_one_group(spark):
    names = ["a" * 5 + "b" * k for k in range(12)] + ["lonely one"]
    df = spark.createDataFrame([(n,) for n in names] + [(names[6],)], "merchant_name string")
    got = V.variant_candidates(df).collect()
    assert {r.proposal for r in got} == {names[6]} and {r.group_names for r in got} == {12}
    assert V.variant_candidates(df.limit(0)).collect() == []
