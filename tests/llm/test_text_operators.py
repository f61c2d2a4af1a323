"""Operators on single texts: language, tokens, chat, fingerprints; brute force, round trips, edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, language_id, multiset_hash, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "</s><s><|endoftext|>", "▁mark ▁", "é" * 300, "x" * 3000, "中文 text 12 ³", "tabs\t\tand\r\nlines\x1c\x85\u3000end", "\0nul", "don't we'll", "😀👍🏽"]


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "the", "ing", "tion", "E", "é", "ü", "中", "😀", "\t", "'s", "12", "#", "</s>", "▁", "\0", "_", "=="]
    return ["".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.randrange(33, 0x2FF)) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, *texts(150), *ODD])], "doc_id long, text string, ids string")


def test_transducer_is_the_library():
    own = bpe.Words(P.PATTERN, bpe.Transducer(bpe.read_ranks(RANKS)))
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for t in [*texts(1500, 5), *(t for t in ODD if t)]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t), t


def test_transducer_after_resets(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ARCS", 50)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    monkeypatch.setattr(bpe, "MAX_PIECE_BYTES", 2_000)
    monkeypatch.setattr(bpe, "MAX_WORD_BYTES", 2_000)
    test_transducer_is_the_library()


def test_utf8_stream():
    text = "aé中😀" * 50
    data = text.encode()
    for step in (1, 2, 3, 5, 7):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.end() == text
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xff\xe4\xb8") + stream.end() == "a\ufffd\ufffd"


def test_bpe_round_trip(spark, odd):
    out = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS).collect()
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert len(out) == odd.count()
    for r in out:
        assert r["decoded"] == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == other.encode_ordinary(r["text"] or "")
    assert [r for r in bpe.encode(odd, RANKS, P.PATTERN, decoded="back").collect() if r["back"] != (r["text"] or "")] == []
    assert bpe.encode(odd, RANKS, P.PATTERN, restored="same").filter("same").count() == len(out)
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_counts(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = token_count.count_tokens(odd, PIECES, keep=["doc_id", "text"]).collect()
    assert len(out) == odd.count()
    assert [r for r in out if r["n_tokens"] != len(library.encode(r["text"] or ""))] == []
    assert token_count.count_tokens(odd.limit(0), PIECES, keep=["doc_id"]).count() == 0


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok\\"
    given = [
        (1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 2, "user", None), (2, 0, "assistant", "early"), (3, 0, "user", "a"), (3, 0, "user", "a"),
        (None, 0, "user", "x"), (4, None, None, "### User: "), (4, 1, "we:ird#", "y"), (5, 0, "system", "only"), (-7, 0, "user", hard), (-7, 1, "assistant", hard), (9007199254740993, 0, "user", "large id"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in given], "conv_id long, turn long, role string, text string, state string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, partitions=2)).collect()}
    for conv in {r[0] for r in given}:
        own = sorted((r for r in given if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = out[conv]
        assert got["n_turns"] == len(own)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: r["first_error"] for c, r in out.items()} == {1: -1, 2: 0, 3: 1, None: -1, 4: 0, 5: 1, -7: -1, 9007199254740993: -1}
    whole = chat.format_conversations(df.filter("conv_id = 1"), partitions=1).collect()
    assert "".join(s["text"] for s in whole).startswith("### User: hi</turn>\n### Assistant: \\\\\\#\\#\\# Assistant\\: \\</turn> ok\\\\</turn>\n")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    # more segments than are parsed at once
    many = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} #") for k in range(2_501)]
    long = chat.read_back(chat.format_conversations(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))).first()
    assert (long["n_turns"], long["valid"]) == (2_501, True)
    assert long["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in many).encode()).hexdigest()


def likeness_of(a, b):
    """What ``likeness`` estimates: 1 less the squared distance of the multisets of pieces over their squared norms."""
    def pieces(text):
        for line in text.split("\n"):
            w = regex.findall(multiset_hash.IN_LINE, line)
            yield from (p for p in zip(w, w[1:]) if xxhash.xxh64_intdigest(p[1].encode(), xxhash.xxh64_intdigest(p[0].encode(), 42)) % multiset_hash.ONE_IN == 0)
            yield from w[-1:]

    x, y = (Counter(pieces(t)) for t in (a, b))
    norms = sum(n * n for n in x.values()) + sum(n * n for n in y.values())
    return 1.0 if a == b or sorted(a.split("\n")) == sorted(b.split("\n")) else 1 - sum((x[k] - y[k]) ** 2 for k in x | y) / norms if norms else 0.0


def test_likeness_survives_an_insertion(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    cases = [words, ["extra", *words], words[1:], [*words[:200], "x", "y", *words[200:]], words[200:] + words[:200], words[::-1], ["other" + w for w in words]]
    texts = [" ".join(c) for c in cases]
    df = spark.createDataFrame([(k, texts[0], t) for k, t in enumerate(texts)], "k long, a string, b string")
    got = {r["k"]: r["l"] for r in df.select("k", multiset_hash.likeness(multiset_hash.fingerprint(F.col("a")), multiset_hash.fingerprint(F.col("b"))).alias("l")).collect()}
    assert got[0] == 1.0 and all(got[k] > 0.9 for k in (1, 2, 3, 4)) and got[5] < 0.4 and got[6] < 0.4
    assert all(abs(got[k] - max(0, likeness_of(texts[0], t))) < 0.35 for k, t in enumerate(texts))


@pytest.mark.parametrize("letters, end", [("абвгдежзиклмн", ""), ("天地玄黃宇宙洪荒日月", ""), ("ABCDEFGH", ""), ("abcfghijk", "e"), ("𐐀𐐁𐐂𐐃", "😀")])
def test_likeness_survives_an_insertion_in_any_script(spark, letters, end):
    rng = random.Random(8)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) + end for _ in range(400)]
    texts = [" ".join(c) for c in (words, ["x", *words], [*words, "x"], [*words[:200], "x", *words[200:]], words[1:], words[::-1])]
    df = spark.createDataFrame([(k, texts[0], t, "clash") for k, t in enumerate(texts)], "k long, a string, b string, next string")
    got = {r["k"]: r["l"] for r in df.select("k", multiset_hash.likeness(multiset_hash.fingerprint(F.col("a")), multiset_hash.fingerprint(F.col("b"))).alias("l")).collect()}
    assert got[0] == 1.0 and all(got[k] > 0.9 for k in (1, 2, 3, 4)) and got[5] < 0.4


def test_multiset_hash(spark):
    fp, both = multiset_hash.fingerprint, F.col
    words = " ".join(f"word{i}" for i in range(400))
    df = spark.createDataFrame([(f"{words}\nsecond line here", f"second line here\n{words}", f"{words}\nsecond line there", "nothing alike at all " * 40, None)], "a string, b string, c string, d string, e string")
    f = df.select(*[fp(both(c)).alias(c) for c in df.columns], both("a").alias("text"))
    r = f.select(
        (both("a") == both("b")).alias("moved"), (both("a") == both("c")).alias("changed"), multiset_hash.likeness(both("a"), both("b")).alias("ab"),
        multiset_hash.likeness(both("a"), both("c")).alias("ac"), multiset_hash.likeness(both("a"), both("d")).alias("ad"), multiset_hash.likeness(both("e"), both("e")).alias("ee"),
        multiset_hash.likeness(both("a"), both("e")).alias("ae"),
        (multiset_hash.delete(multiset_hash.insert(both("a"), both("d")), both("d")) == both("a")).alias("undone"), F.length(multiset_hash.as_text(both("a"))).alias("n"),
    ).first()
    assert r["moved"] and not r["changed"] and r["undone"]
    assert (r["ab"], r["ee"], r["ae"]) == (1.0, 1.0, 0.0)
    assert r["ac"] > 0.9 and r["ad"] < 0.3 and r["n"] == 16 * (2 + 4 + 42)
    joined = df.select(fp(F.lit("x y z\nsecond")).alias("whole"), multiset_hash.insert(fp(F.lit("x y z")), fp(F.lit("second"))).alias("sum")).first()
    assert joined["whole"] == joined["sum"]


def test_next_by_id(spark):
    ids = [5, 1, 9, None, 7, 7, 3, 12]
    df = spark.createDataFrame([(i, f"t{i}" + ("b" if k == 5 else "")) for k, i in enumerate(ids)], "doc_id long, text string")
    for rows in (2, 1_000):
        out = multiset_hash.with_next(df, "doc_id", "text", {"n": F.length("text")}, range_rows=rows).collect()
        follow = {r["text"]: r["next"]["text"] for r in out}
        assert follow == {"t12": "t9", "t9": "t7", "t7": "t7b", "t7b": "t5", "t5": "t3", "t3": "t1", "t1": "tNone", "tNone": "t12"}, rows
    assert multiset_hash.with_next(df.limit(0), "doc_id", "text", {}).count() == 0
    assert multiset_hash.with_next(df.limit(1), "doc_id", "text", {}).first()["next"]["text"] == df.first()["text"]


def test_language_id(spark):
    words = {"aa": "the cat sat on that mat with hats", "bb": "zum hund über grün mögen wüst böse", "cc": "qué niño señal canción año mañana"}
    rng, rows = random.Random(1), []
    for i in range(90):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang, i))
    rows += [(100, None, "aa", 0), (101, "", "bb", 0), (102, "123 !?", None, 0), (103, words["aa"] + " " + words["aa"] + " " + words["cc"], None, 0), (104, rows[0][1], None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    languages, logs = language_id.fit(df)
    out = {r["doc_id"]: r for r in language_id.predict(df, languages, logs, keep=df.columns).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(90))
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and out[100]["score"] == 0.0
    assert out[103]["languages"].split(",")[0] == "aa" and "cc" in out[103]["languages"] and 0.4 < out[103]["score"] < 0.95
    assert out[104]["lang_pred"] == out[0]["lang_pred"] and 0 <= out[104]["score"] <= 1
    assert language_id.predict(df.limit(0), languages, logs, keep=["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df, *language_id.fit(df.limit(0)), keep=["doc_id"]).collect()} == {"und"}
