import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, training_order
from tessera.llm.training_order import feistel, manifest_of, materialised, permuted, read, sequences

RANKS, END = P.path("byte_bpe_50k.tiktoken"), 50_256


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 7).tolist() != permuted(np.arange(1000), 1000, 8).tolist()
    assert len(np.unique(feistel(np.arange(4096, dtype=np.uint64), 6, 3))) == 4096


def texts():
    rows = [(i, f"text {i} " * (i * 7 % 50)) for i in range(60)]
    return rows + [(None, "no id"), (9007199254740993, "a large id"), (70, None), (71, ""), (1, rows[1][1]), (72, "long " * 9000), (73, "é😀" * 40)]


def placed(order, m):
    """For each (id, text's ids) the ids that the files hold at its pieces."""
    rows = np.array(list(sequences(order.folder)), m["kind"]).reshape(-1, m["stride"])
    out = {}
    for r in sorted(order.pieces.collect(), key=lambda r: r["part"]):
        out.setdefault(r["doc_id"], []).extend(rows[r["slot"], r["begin"] : r["begin"] + r["tokens"]].tolist())
    return out, rows


def test_files_hold_all_ids_in_any_partitioning(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    given = [(*r, 0, "x", 7) for r in texts()]
    df = spark.createDataFrame(given, "doc_id long, text string, slot long, shard string, h long")
    made = [materialised(df.repartition(p), RANKS, P.PATTERN, key=5, end=END, stride=64, shard_bytes=8_000) for p in (2, 5)]
    manifests = [manifest_of(o.folder) for o in made]
    assert manifests[0] == manifests[1] and len(manifests[0]["shards"]) > 3
    first, second = (placed(o, m) for o, m in zip(made, manifests, strict=True))
    assert (first[1] == second[1]).all() and manifests[0]["n"] == len(first[1])
    want = {}
    for i, t, *_ in given:
        if t:
            want.setdefault(i, []).append(own.encode_ordinary(t))
    assert set(first[0]) == set(want)
    for i, lists in want.items():
        assert sorted(first[0][i]) == sorted(x for ids in lists for x in ids) if len(lists) > 1 else first[0][i] == lists[0], i
    # every id is a text's, or the end that follows each text and fills each shard's last sequence
    total = sum(len(x) for ids in want.values() for x in ids)
    assert (first[1] != END).sum() == total
    assert made[0].pieces.select("slot").distinct().count() <= manifests[0]["n"]
    assert materialised(df, RANKS, P.PATTERN, key=6, end=END, stride=64, shard_bytes=8_000).pieces.exceptAll(made[0].pieces).count() > 0


def test_reads_resume_at_any_slot(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    order = materialised(df, RANKS, P.PATTERN, key=5, end=END, stride=32, shard_bytes=8_000)
    whole = [r.tobytes() for r in sequences(order.folder)]
    for slot in (0, 1, len(whole) // 2, len(whole) - 1, len(whole)):
        assert [r.tobytes() for r in sequences(order.folder, slot)] == whole[slot:]
        got = sorted(read(spark, order.folder, slot).collect())
        assert [r["slot"] for r in got] == list(range(slot, len(whole))) and [bytes(r["ids"]) for r in got] == whole[slot:]


def test_string_ids_large_ids_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    named = materialised(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), RANKS, P.PATTERN, key=5, end=END, folder=f"file://{tmp_path}/named")
    assert {"d9007199254740993", None, "d72"} <= {r["doc_id"] for r in named.pieces.collect()}
    assert {9007199254740993, None} <= {r["doc_id"] for r in materialised(df, RANKS, P.PATTERN, key=5, end=END).pieces.collect()}
    none = materialised(df.limit(0), RANKS, P.PATTERN, key=5, end=END)
    assert none.pieces.count() == 0 and list(sequences(none.folder)) == [] and read(spark, none.folder).count() == 0
    assert materialised(df, RANKS, P.PATTERN, key=5, end=1 << 17, shard_bytes=1 << 20).pieces.count() > 0


@pytest.mark.parametrize("size", [1, 63, 64, 65, 200])
def test_layout_at_the_edges_of_sequences(size):
    ids = [np.arange(size, dtype="<u2").tobytes(), np.arange(3, dtype="<u2").tobytes()]
    rows, (text, part, place, begin, tokens) = training_order._laid_out(ids, "<u2", 64, 60_000, 1, 0)
    for t, want in enumerate((list(range(size)), [0, 1, 2])):
        at = np.flatnonzero(text == t)
        assert part[at].tolist() == list(range(len(at)))
        assert [x for k in at for x in rows[place[k], begin[k] : begin[k] + tokens[k]].tolist()] == want
