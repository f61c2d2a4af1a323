"""The model of op9_ngram_lm keeps pairs and triples that the training texts hold once."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram_lm, queries


def test_all_pairs_and_triples_count(spark, monkeypatch):
    rng = random.Random(2)
    texts = {i: " ".join(f"w{rng.randrange(40)}" for _ in range(60)) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *a: df)
    got = {r["doc_id"]: r for r in queries.op9_ngram_lm(spark, "").collect()}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in texts.items():
        if not got[i]["held_out"]:
            w = [*t.split(), ""]
            c1.update(w)
            c2.update(zip(["", *w], w, strict=False))
            c3.update(zip(["", *w], w, w[1:], strict=False))
    n, v, d = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    g2, g3 = Counter(), Counter()
    for (h, _), x in c2.items():
        g2[h] += x - d
    for (a, h, _), x in c3.items():
        g3[a, h] += x - d

    def p2(h, w):
        return max(c2[h, w] - d, 0) / c1[h] + (1 - g2[h] / c1[h]) * (c1[w] + 1) / (n + v + 1)

    def p3(a, h, w):
        return p2(h, w) if not c2[a, h] else max(c3[a, h, w] - d, 0) / c2[a, h] + max(1 - g3[a, h] / c2[a, h], 1e-12) * p2(h, w)

    for i, t in texts.items():
        w = [*t.split(), ""]
        want = math.log10(p2("", w[0])) + sum(math.log10(p3(*x)) for x in zip(["", *w], w, w[1:], strict=False))
        assert got[i]["score"] == pytest.approx(want, rel=0.03), i


def test_lookups_bring_prices(spark):
    """op9_ngram_lm: a lookup returns the probabilities that a second pass over the nodes would; files are plain arrays."""
    rows = [(i, " ".join("abcdefg"[(i * k * k + k) % 7] for k in range(40))) for i in range(12)]
    model = ngram_lm.train(spark.createDataFrame(rows, "doc_id long, text string"), least=1)
    trie = ngram_lm.Trie(model)
    words = [w.encode() for w in "a b c d e f g".split()]
    ids = trie.ids([words * 5 + [b"unseen"] + words[::-1]])[0].astype(np.int64)
    context = trie.contexts(ids, np.array([0]))
    prices = np.full(len(ids), 7.0)
    node, _ = trie.pairs(ids, context, prices)
    assert (node >= 0).any() and (node < 0).any() and (prices[node < 0] == 7).all()
    assert (prices[node >= 0] == trie.log_p(1, node[node >= 0])).all()
    assert type(trie.held(1, 0)["p"]) is np.ndarray
    twice = trie.ids([[b"a", b"new", b"new"], [b"new", b"b", b"other"]])
    assert [x.tolist() for x in twice] == [[ids[0], -1, -1], [-1, ids[1], -1]]
    trie.older, trie.recent = dict(trie.recent), ngram_lm._Recent()
    assert trie.ids([words])[0].tolist() == ids[:7].tolist() and len(trie.recent) == 7
