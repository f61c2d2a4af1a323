"""Removal of repeated passages against brute force, and its suffix arrays."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import passages
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, least=50):
    """rows (id, text) to (id, n_bytes, spans, kept)."""
    last = 2**63 - 1
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - least + 1):
            w = t[k : k + least]
            first[w] = min(first.get(w, last), i)
    out = []
    for (i, t), (given_id, _) in zip(texts, rows):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - least + 1):
            if first[t[k : k + least]] < i:
                gone[k : k + least] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((given_id, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def as_rows(found):
    return sorted(((r[0], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in found), key=repr)


def corpus():
    rng = random.Random(11)
    words = ["one", "zwei", "trois", "quatre", "été", "日本語", "a", "\x00", "\t", "sieben", "eight", "neuf", "naïve"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(200)) for _ in range(n))

    license_line = "Permission is hereby granted, free of charge, to any person obtaining it."
    rows = [(i, prose(rng.randrange(60))) for i in range(0, 120, 2)]
    rows += [(1001 - i, rows[i][1][: 40 + i] + license_line + prose(9) + rows[i // 2][1][5:]) for i in range(50)]
    rows += [(2000 + i, rows[3][1]) for i in range(6)] + rows[5:9]
    rows += [(3000, "a" * 500), (3001, "a" * 120 + "b" + "a" * 49), (3002, "ab" * 100), (3003, "b" + "ab" * 60)]
    rows += [(None, rows[2][1]), (None, license_line * 2), (4000, None), (4001, ""), (4002, "x" * 49), (4002, "x" * 50), (4003, "x" * 50)]
    return rows + [(-5, license_line[:60]), (4002, license_line + "!"), (7, rows[1][1][7:])]


@pytest.mark.parametrize("rows, hot", [(25_000, 20_000), (40, 20_000), (40, 3), (10, 0)])
def test_against_brute_force(spark, rows, hot):
    given_rows = [(t, i, "x") for i, t in corpus()]
    docs = spark.createDataFrame(given_rows, "text string, doc_id long, id string").repartition(3)
    got = passages.without_repeats(docs, rows=rows, hot=hot).collect()
    assert as_rows(got) == sorted(brute(corpus()), key=repr)


def test_segments_do_not_matter():
    text = np.frombuffer("".join(random.Random(2).choices("abcdefgh ", k=3000)).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 730, 3000])

    def windows(segment, monkeypatch):
        monkeypatch.setattr(passages, "SEGMENT", segment)
        out = {}
        for found in passages._runs(text, offsets):
            for t, a, b, h in zip(*(x.tolist() for x in found)):
                out |= {k: (t, h) for k in range(a, b + 1)}
        return out

    with pytest.MonkeyPatch.context() as m:
        whole = windows(1 << 20, m)
        assert sorted(whole) == [*range(0, 651), *range(730, 2951)]
        assert windows(64, m) == whole == windows(701, m)


@settings(max_examples=60, deadline=None)
@given(st.text("ab\x00", max_size=200), st.integers(1, 4))
def test_suffix_order(text, times):
    data = np.frombuffer((text * times).encode() + b"\xff", np.uint8)
    got = passages.two_stage(data, passages._words(data, len(data)))
    raw = data.tobytes()
    assert sorted(got.tolist()) == list(range(len(raw)))
    cut = [raw[i : i + 56] for i in got.tolist()]
    assert cut == sorted(cut)


def test_empty_table(spark):
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = {(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute([(d["doc_id"], d["text"]) for d in docs])}
    assert {tuple(r) for r in QUERIES["op12_repeated_passages"](spark, SF).collect()} == want and any(w[2] for w in want)
