"""Phrase collocations against plain counts, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    for lang in {r[2] if r[2] is not None else "und" for r in rows}:
        counts = Counter()
        for r in rows:
            if (r[2] if r[2] is not None else "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(lower)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    for k in (1, 2, 3):
                        counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        n = sum(f for p, f in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            s, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                ranked.append((-s, -a, " ".join(p).encode(), (" ".join(p), a, l, r, n, s)))
        out |= {(lang, i + 1, *row) for i, (*_, row) in enumerate(sorted(ranked)[:top])}
    return out


def documents():
    rng = random.Random(5)
    words = ["New", "york", "city", "the", "of", "ÉTÉ", "日本", "a\x00b", "x-y", "the.", "end!\n", "tab\t", " ", "q"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 15), k=rng.randrange(60))), rng.choice(["en", "de", None, "und"]), 7, "x") for i in range(150)]
    rows += rows[:5]
    return rows + [(900, None, "en", 0, ""), (901, "", "zz", 0, ""), (902, "... ,", "yy", 0, ""), (903, "a a a a a a a", "en", 0, ""), (904, "very long the of " * 9_000, "en", 0, "")]


@pytest.mark.parametrize("held, burst, part", [(1_000_000, 4096, 1 << 20), (20, 2, 1 << 20), (300, 5, 50)])
def test_against_plain_counts(spark, monkeypatch, held, burst, part):
    monkeypatch.setattr(C, "PART", part)
    rows = documents()
    got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=3, top=40, held=held, burst=burst).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 3, 40)


def test_parts_of_a_long_text():
    text = "One two, three four.Five  six\tseven ; eight".encode()
    whole = [w for words in C._words(text) for w in words]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "PART", 3)
        assert [w for words in C._words(text) for w in words] == whole
    assert whole == [b"one", b"two", b".", b"three", b"four", b".", b"five", b"six", b"seven", b".", b"eight"]


@pytest.mark.parametrize("batch", [1, 70, 200_000])
def test_trie_counts_and_spills_the_largest_first(monkeypatch, batch):
    monkeypatch.setattr(C, "BATCH", batch)
    rng = np.random.default_rng(9)
    trie, want, got = C.HatTrie(burst=4), Counter(), Counter()
    for _ in range(30):
        packed = rng.integers(0, 6, 50) << 42 | rng.integers(0, 7, 50) << 21 | rng.integers(0, 9, 50)
        trie.add(packed)
        want.update(packed.tolist())
        if len(trie) > 150:
            sizes = []
            for a, entries in trie.spill(75):
                sizes.append(len(entries))
                got.update({a << 42 | rest: n for rest, n in entries})
            assert sizes == sorted(sizes, reverse=True) and len(trie) <= 75
    trie.settle()
    assert any(isinstance(c, C._Branch) for c in trie.root.values())
    got.update({a << 42 | rest: n for a, entries in trie.spill(0) for rest, n in entries})
    assert got == want and not len(trie)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 123_456_789_012_345, 987_654_321_098_765, 199_999_999_999_999
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(C.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * a * a // (l * r)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 0, "")], SCHEMA)).count() == 0


def test_runs_are_in_byte_order():
    """op13_phrase_collocations: subtrees of both kinds leave as whole runs, made without a Python row for each phrase."""
    names = [b"b", b"\xc3\xa9", b"a", b"ab"]
    trie = C.HatTrie(burst=2)
    phrases = [(0, 1, 2), (0, 1, 0), (0, 3, 2), (0, 2, 3), (1, 0, 0), (0, 1, 2)]
    trie.add(np.array([a << 42 | b << 21 | c for a, b, c in phrases]))
    trie.settle()
    runs = C._Runs("en", names, 3)
    for first, node in trie.subtrees(0):
        runs.add(first, node)
    got = [tuple(r.values()) for r in runs.batch().to_pylist()]
    want = Counter((names[a] + b" " + names[b], names[c]) for a, b, c in phrases)
    assert got == [("en", *k, n) for k, n in sorted(want.items())] and len(runs) == 0
