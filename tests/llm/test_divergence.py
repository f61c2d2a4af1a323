"""Source divergence against a plain count, and its edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, `count` string, term int"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(lower))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top}
    return out


def documents():
    rng = random.Random(3)
    words = ["The", "ÉTÉ", "été", "z", "straße", "日本", "a1b", "x-y", "Ünder", "no", "end"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S4", None]), "c", 1) for i in range(120)]
    rows += rows[:7]  # repeated rows
    rows += [(500, None, "en", "no text", None, None), (501, "", "xx", "p", None, None), (502, "!!", "xx", "q", None, None), (503, "alone", "yy", "one", None, None)]
    return rows + [(504, "rare words only " * 20_000, "en", "s1", None, None)]


@pytest.mark.parametrize("block, tile, held", [(2048, 8, 300_000), (2, 1, 5), (3, 2, 1)])
def test_against_plain_counts(spark, block, tile, held):
    rows = documents()
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=3, top_terms=4, block=block, tile=tile, held=held).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 3, 4)


def test_no_rows_and_nulls_alone(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert divergence.divergence(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).count() == 0


def test_gallop_finds_what_sets_share():
    rng = np.random.default_rng(5)
    for n, m in [(0, 4), (4, 0), (1, 1), (70, 1000), (1000, 70), (300, 300)]:
        a, b = (np.unique(rng.integers(0, 1500, k)) for k in (n, m))
        at = divergence.gallop(a, b)
        assert (at >= 0).tolist() == np.isin(a, b).tolist() and (b[at[at >= 0]] == a[at >= 0]).all()


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = (9_123_456_789_012_345, 9_999_999_999_999_999, 1_000_003)
    got = spark.createDataFrame([row], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (row[0] + 5) // (row[1] + 5 * row[2])
