"""The registered queries on the smallest tables, against SQL or brute force."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken

from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def same(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(same, r)) for r in got[columns].itertuples(index=False)) == sorted(tuple(map(same, r)) for r in want[columns].itertuples(index=False))


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == held(i, 4) for i, r in got.items())
    known = {r["lang"] for r in docs.values() if r["lang"]}
    assert {r["lang_pred"] for r in got.values()} <= known | {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    judged = [(got[i]["lang_pred"], r["lang"]) for i, r in docs.items() if r["lang"] and held(i, 4) and got[i]["lang_pred"] != "und"]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_training_order(spark, docs):
    rows = QUERIES["op2_training_order"](spark, SF).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = {}
    for r in rows:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["tokens"]
    assert size == {i: n for i, r in docs.items() if (n := len(own.encode_ordinary(r["text"] or "")))}
    assert {r["slot"] for r in rows} == set(range(max(r["slot"] for r in rows) + 1))


def test_simhash(spark, docs):
    from .test_corpus_operators import fingerprint, joined

    got = {r["doc_id"]: r for r in QUERIES["op5_simhash"](spark, SF).collect()}
    ids = sorted(docs)
    prints = [fingerprint(docs[i]["text"]) for i in ids]
    root = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, root, strict=True)}


def test_multiset_fingerprints(spark, docs):
    from .test_text_operators import likeness_of

    got = {r["doc_id"]: r for r in QUERIES["op6_multiset_fingerprints"](spark, SF).collect()}
    order = sorted(docs, reverse=True)
    by_text, off = {}, []
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        a, b = docs[i]["text"] or "", docs[j]["text"] or ""
        n = len(a) // 3
        edited = a[: len(a) - n] + b[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        by_text.setdefault(a, set()).add(got[i]["fingerprint"])
        by_text.setdefault(edited, set()).add(got[i]["edited_fingerprint"])
        off += [got[i]["near_edited"] - likeness_of(a, edited), got[i]["near_next"] - likeness_of(a, b)]
    assert all(len(f) == 1 for f in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    # an estimate with a standard error of about 0.09
    assert np.sqrt(np.mean(np.square(off))) < 0.12 and abs(np.mean(off)) < 0.03


def test_token_counts(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, r in docs.items() for t in [r["text"] or ""]}


def test_byte_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op8_byte_bpe"](spark, SF).collect():
        text = docs[r["doc_id"]]["text"] or ""
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
