"""Groups by exact similarity of shingle sets, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import shingle_sets


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def edited(rng, base, at):
    return " ".join(f"x{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base))


def least_of_groups(texts):
    sets = {i: grams(t) for i, t in texts.items() if t.split()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("chunk", [512, 7])
def test_pairs_near_the_threshold(spark, monkeypatch, chunk):
    monkeypatch.setattr(shingle_sets, "CHUNK", chunk)  # small, so that buckets are cut into cells
    rng = random.Random(3)
    texts = {}
    for k in range(120):  # pairs of 0.70 to 0.90: 4 to 14 edits of 400 words, each in five shingles
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = edited(rng, base, range(3, 400, 390 // (4 + k % 11)))
    hot = [f"h{i}" for i in range(40)]
    for k in range(60):  # a family below the threshold, with a few pairs above it
        texts[1000 + k] = edited(rng, hot, {k % 40} if k < 50 else {0} if k < 55 else {39})
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # neighbours are alike, ends are not
        texts[2000 + k] = edited(rng, chain, range(5, 5 + 8 * k, 8))
    texts |= {3000: texts[0].upper(), 3001: "", 3002: " \n", 3003: "one two", 3004: "One  two"}
    want = least_of_groups(texts) | {3002: 3001}
    assert len({want[i] for i in range(240)}) < 240 and any(want[2 * k + 1] != want[2 * k] for k in range(120))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in shingle_sets.groups(df).collect()} == want
    kept = dict(corpus_pipeline.STAGES)["near-deduplication"](spark, df.withColumn("source", F.lit("s")), "")
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000), dtype=np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert shingle_sets.overlaps(sets[:5], sets[5:]).tolist() == want


def test_hot_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "CHUNK", 20)
    written, write = {}, shingle_sets.materialise
    monkeypatch.setattr(shingle_sets, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = {k: edited(rng, base, {k % 200} if k < 200 else range(k % 5, 200, 25)) for k in range(260)}  # near copies, and some that are not
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in shingle_sets.groups(df).collect()} == least_of_groups(texts)
    assert written["set-members"].agg(F.max("n")).first()[0] > 100
    assert written["set-stars"].count() < 20 * len(texts)
    assert written["set-cells"].groupBy("t", "key", "i", "j").count().agg(F.max("count")).first()[0] <= 80


def test_fingerprints_propose(spark, monkeypatch):
    """the SimHash trie finds near copies by itself; what it links, the exact sets decide."""
    monkeypatch.setattr(shingle_sets, "band_keys", lambda hashes: np.bitwise_xor.reduce(hashes, keepdims=True).view(np.int64))  # bands that no two sets share
    rng = random.Random(8)
    texts = {}
    for k in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[:-1])
    short = {100: "a b c d e f", 101: "a b c d e f g h"}  # two of four shingles in common
    df = spark.createDataFrame(list((texts | short).items()), "doc_id long, text string")
    got, want = {r["id"]: r["component_id"] for r in shingle_sets.groups(df).collect()}, least_of_groups(texts | short)
    assert all(got[i] in (i, want[i]) for i in got) and got[101] == 101
    assert sum(got[i] != i for i in texts) >= 25


def test_links_as_they_met(spark):
    """A spanning forest of pairs within the budget, not of pairs with the first of the group."""
    prints = [0, 1, 3, 7, 15, 31, 1 << 40]
    df = spark.createDataFrame([(x,) for x in prints], "node long")
    met = {tuple(sorted((r["u"], r["v"]))) for r in shingle_sets.simhash.links(df, budget=2, as_met=True).collect()}
    assert all((u ^ v).bit_count() <= 2 for u, v in met)
    assert set().union(*met) == set(prints)
