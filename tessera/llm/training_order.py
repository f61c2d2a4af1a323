"""Training-order materialisation: keyed Feistel permutations give every sequence a global slot, kept in fixed-stride shards.

1. A text becomes its token ids and an end id (``end``). A Feistel network over 64 bits permutes the hash of (id, text);
   the result, its place in equal ranges, picks the text's shard and its place in the shard's stream. The number of shards
   follows from the bytes of all texts. So the order depends on the key and the corpus alone, not on how rows are split.
2. One shuffle deals the ids by ranges of shards. A task joins the texts of a shard to one stream and cuts it every
   ``STRIDE`` ids: these are the sequences. No id is padding but in the last sequence of a shard (``end`` again).
3. A second Feistel network, over the least even number of bits that holds the shard's number of sequences, permutes them,
   walking the cycle on while a result is no number of a sequence. A sequence's global slot is its shard's first slot plus
   its permuted number; together the slots are exactly 0 .. n - 1.
4. A task writes each shard as one file: a sequence every STRIDE * itemsize bytes. Ids take 2 bytes if the vocabulary
   allows it, else 4. A file appears whole or not at all, so tasks can be run again.

``manifest.json`` in the folder has key, stride, kind of number, end id, and each shard's first slot: ``sequences`` reads on
from any slot, in order, and ``read`` does so in Spark. The table of pieces says where every text went.

Edge cases: a null or empty text has no id and no piece; the same id and text twice stand side by side; ids of any type
that Spark can sort are kept as they are, null ids among them; texts are read whole; an empty table gives an empty table
and a manifest without shards; columns other than id and text are ignored. Equal (id, text) rows go to one shard.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import read_ranks
from .common import materialise, shared_dir

STRIDE, ROUNDS = 512, 6
#: Bytes of text to a shard.
SHARD_BYTES = 32 << 20
#: Bytes of ids that leave a task at once.
FLUSH_BYTES = 8 << 20
U64 = np.uint64


def _round(right: np.ndarray, key: int, r: int) -> np.ndarray:
    f = (right + U64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) * U64(0xBF58476D1CE4E5B9)
    f = (f ^ (f >> U64(29))) * U64(0x94D049BB133111EB)
    return f >> U64(32)


def feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    """A permutation of the numbers of 2 * half bits."""
    mask = U64((1 << half) - 1)
    left, right = x >> U64(half), x & mask
    for r in range(ROUNDS):
        left, right = right, left ^ (_round(right, key, r) & mask)
    return left << U64(half) | right


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    x = index.astype(U64)
    out = np.zeros(len(x), U64)
    live = np.arange(len(x))
    while len(live):
        x = feistel(x, half, key)
        done = x < U64(n)
        out[live[done]] = x[done]
        live, x = live[~done], x[~done]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Order:
    """Where the shards are, and the table (id, part, slot, shard, place, begin, tokens) of all pieces of texts."""

    folder: str
    pieces: DataFrame


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, key: int, shards: int, kind: str) -> DataFrame:
    """(id, shard, at, ids) of every text that has ids."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")).filter(F.octet_length("text") > 0)
    schema = T.StructType([given.schema["id"], T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary

        def rows(part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
            at = feistel(part.column(1).to_numpy().view(U64), 32, key)
            shard = ((at >> U64(32)) * U64(shards) >> U64(32)).astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(shard), pa.array(at.view(np.int64)), pa.array(ids, pa.binary())], names=["id", "shard", "at", "ids"])

        for batch in batches:
            begun, held, size = 0, [], 0
            for i, text in enumerate(batch.column(2)):
                held.append(np.array(encode(text.as_py()), kind).tobytes())
                size += len(held[-1])
                if size >= FLUSH_BYTES or i == batch.num_rows - 1:
                    yield rows(batch.slice(begun, i + 1 - begun), held)
                    begun, held, size = i + 1, [], 0

    return given.mapInArrow(run, schema)


def _laid_out(ids: list[bytes], kind: str, stride: int, end: int, key: int, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sequences of a shard in the order of their places; and for each piece: text, part, place, begin, tokens."""
    width = np.dtype(kind).itemsize
    close = np.array([end], kind).tobytes()
    stream = close.join([*ids, b""])
    sizes = np.array([len(x) // width for x in ids], np.int64)
    stops = np.cumsum(sizes + 1) - 1
    n = -(-(len(stream) // width) // stride)
    rows = np.frombuffer(stream + close * (n * stride - len(stream) // width), kind).reshape(n, stride)
    place = permuted(np.arange(n), n, key + shard)
    out = np.empty_like(rows)
    out[place] = rows
    starts = stops - sizes
    first, last = starts // stride, (stops - 1) // stride
    count = last - first + 1
    text = np.repeat(np.arange(len(ids)), count)
    part = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    row = first[text] + part
    begin = np.maximum(starts[text], row * stride)
    tokens = np.minimum(stops[text], (row + 1) * stride) - begin
    return out, [text, part, place[row], begin - row * stride, tokens]


def materialised(
    docs: DataFrame, path: str, pattern: str, *, key: int, end: int, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, shard_bytes: int = SHARD_BYTES, folder: str | None = None
) -> Order:
    """Write the shards of all texts, tokenised by the rank file at path, to the folder; one of its own in the shared folder, if None."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    kind = "<u2" if end < 1 << 16 else "<u4"
    encoded = _encoded(docs, path, pattern, id_col, text_col, key, shards, kind)
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = encoded.repartitionById(partitions, F.floor(F.col("shard").cast("long") * partitions / shards).cast("int")).sortWithinPartitions("shard", "at", "id")
    added = ["part", "shard", "place", "begin", "tokens"]
    schema = T.StructType([encoded.schema["id"], *(T.StructField(c, T.LongType()) for c in added), T.StructField("sequences", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def done(shard: int, names: list[pa.Array], ids: list[bytes]) -> pa.RecordBatch:
            rows, (text, part, place, begin, tokens) = _laid_out(ids, kind, stride, end, key, shard)
            name = f"{root}/{shard:08d}"
            temporary = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(rows)
            store.move(temporary, f"{name}.bin")
            held = pa.concat_arrays(names).take(pa.array(text))
            columns = [part, np.full(len(text), shard), place, begin, tokens, np.full(len(text), len(rows))]
            return pa.RecordBatch.from_arrays([held, *(pa.array(c, pa.int64()) for c in columns)], names=["id", *added, "sequences"])

        now, names, ids = -1, [], []
        for batch in batches:
            shard = batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != now:
                    if ids:
                        yield done(now, names, ids)
                    now, names, ids = int(shard[a]), [], []
                names.append(batch.column(0).slice(a, b - a))
                ids += batch.column(3).slice(a, b - a).to_pylist()
        if ids:
            yield done(now, names, ids)

    pieces = materialise(dealt.mapInArrow(write, schema), "training-pieces")
    sizes = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.max("sequences").alias("n")).collect()}
    used = sorted(sizes)
    starts = np.cumsum([0, *(sizes[s] for s in used)]).tolist()
    manifest = {"key": key, "n": starts[-1], "stride": stride, "kind": kind, "end": end, "shards": used, "starts": starts[:-1]}
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    first = spark.createDataFrame(list(zip(used, starts, strict=False)), "shard long, first long")
    slotted = pieces.join(first, "shard").withColumn("slot", F.col("first") + F.col("place"))
    return Order(folder, slotted.select(F.col("id").alias(id_col), "part", "slot", "shard", "place", "begin", "tokens"))


def manifest_of(folder: str) -> dict:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _shard_from(folder: str, m: dict, i: int, place: int) -> Iterator[np.ndarray]:
    """The sequences of the i-th shard from a place on, a few at a time."""
    store, root = fs.FileSystem.from_uri(folder)
    step = m["stride"] * np.dtype(m["kind"]).itemsize
    with store.open_input_file(f"{root}/{m['shards'][i]:08d}.bin") as f:
        f.seek(place * step)
        while block := f.read(step * 4096):
            yield np.frombuffer(block, m["kind"]).reshape(-1, m["stride"])


def sequences(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """All sequences from a slot on, in order: what a trainer reads after it stopped there."""
    m = manifest_of(folder)
    begin = max(0, int(np.searchsorted(m["starts"], slot, side="right")) - 1)
    for i in range(begin, len(m["shards"])):
        for block in _shard_from(folder, m, i, max(0, slot - m["starts"][i])):
            yield from block


def read(spark: SparkSession, folder: str, slot: int = 0) -> DataFrame:
    """(slot, ids) of all sequences from a slot on; each shard is read by one task from its first wanted place."""
    m = manifest_of(folder)
    begin = max(0, int(np.searchsorted(m["starts"], slot, side="right")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                at = max(slot, m["starts"][i])
                for block in _shard_from(folder, m, i, at - m["starts"][i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(block))), pa.array([r.tobytes() for r in block], pa.binary())], names=["slot", "ids"])
                    at += len(block)

    wanted = len(m["shards"]) - begin
    return spark.range(begin, len(m["shards"]), numPartitions=max(1, wanted)).mapInArrow(run, "slot long, ids binary")
