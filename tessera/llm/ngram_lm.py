"""Language-model scoring with an n-gram trie in Elias-Fano form.

Training counts words, pairs and triples over all training texts. Levels of the trie:

1. words, in the order of their 64-bit hashes (an Elias-Fano sequence; a word's id is its place), with exact counts;
2. pairs seen at least ``least`` times (1: all): pointers from a word to its successors and, below them, the successors' ids;
3. triples seen at least ``least`` times: pointers from a pair to its successors, each written as its place among the
   successors of the pair's second word (a context-relative id, far smaller than a word id).

A successor is found by a search in the monotone sequence of (parent, successor). Pairs and triples carry smoothed
probabilities, quantised to 255 levels of log10: p(w | h) = max(0, c(hw) - D) / c(h) + g(h) * p(w | shorter h), where g(h)
is what discounting and pruning leave, so that probabilities sum to one; the shortest is (c + 1) / (N + V + 1). The token
before a text is the end token of the text before.

Jobs: words are counted with map-side sums; then texts are read a last time and their word ids written, from which pairs,
triples and scores come. Pairs and triples are counted in each task, sent as sorted, packed keys by ranges of their
context, and each range is merged, pruned and written as one file of the model to the shared folder. A triple is only sent
if both of its pairs are in level 2 (a triple is never more frequent than its pairs). Ranges are cut
by hashed ids, so that frequent contexts are spread. Files are memory-mapped; workers need no more than the pages they use.
Nothing but counts of ranges reaches the driver. The files' size is checked against MAX_BYTES.

Words are told apart by 64-bit hashes; the chance that any two of ten million distinct words share one is below 1e-5.

Edge cases: a null text counts as empty and has one token, the end; a null id takes part in the fold as the empty text;
texts are read whole; without any training text every probability is that of an empty model; an empty table gives an
empty result; repeated rows count and are scored each.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir
from .elias_fano import EliasFano, inside, load, save, under

SEED = 42
MIN_COUNT = 2
DISCOUNT = 0.75
LEVELS = 255
BLOCK_BYTES = 4 << 20
FLUSH_KEYS = 3_000_000
CACHE_WORDS = 200_000
BLOCK_TOKENS = 1 << 20
MAX_WORDS_A_TASK = 500_000
WORDS_A_SHARD = 250_000
MAX_BYTES = 200 << 30
END = b""
U64 = np.uint64


@dataclass(frozen=True)
class Model:
    """What tasks need to open the files; offsets[level] has the first id of each shard, and the total."""

    path: str
    shards: int
    total: int
    words: int
    offsets: tuple[tuple[int, ...], ...]


# ---------------------------------------------------------------- texts


def token_blocks(batch: pa.RecordBatch, column: int) -> Iterator[list[list[bytes]]]:
    """The tokens of each text, the end token last, in runs of rows of about BLOCK_BYTES."""
    held, size = [], 0
    for x in batch.column(column).cast(pa.large_binary()):
        text = x.as_py() or b""
        words = text.lower().split()
        words.append(END)
        held.append(words)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(w, SEED) for w in words], U64, len(words))


# ---------------------------------------------------------------- the opened model


class _Recent(dict):
    """Words to ids; a word that is not here is taken from ``older``, or listed in ``new`` and stands as -2 less its place there."""

    older: dict[bytes, int] = {}
    new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if (found := self.older.get(word)) is None:
            found = -2 - len(self.new)
            self.new.append(word)
        self[word] = found
        return found


class Trie:
    """A model's files, opened in a worker when first used: lookups over arrays of ids."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.offsets = [np.array(at, np.int64) for at in model.offsets]
        self.files: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        self.seqs: dict[tuple[int, int, str], EliasFano] = {}
        # words met lately, and those met before them
        self.recent = _Recent()
        self.older: dict[bytes, int] = {}

    def held(self, level: int, shard: int) -> dict[str, np.ndarray]:
        if (key := (level, shard)) not in self.files:
            self.files[key] = load(f"{self.model.path}/{level}-{shard}")
        return self.files[key]

    def seq(self, level: int, shard: int, name: str) -> EliasFano:
        key = level, shard, name
        if key not in self.seqs:
            self.seqs[key] = EliasFano(inside(name, self.held(level, shard)))
        return self.seqs[key]

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        small = shard.astype(np.uint16 if self.model.shards < 1 << 16 else np.int64)  # 16 bits are sorted by radix
        order = np.argsort(small, kind="stable")
        cut = np.flatnonzero(np.diff(small[order])) + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(shard[part[0]]), part

    def word_ids(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if self.model.words:
            for s, at in self.by_shard(range_of(keys, self.model.shards)):
                place = self.seq(0, s, "keys").search(keys[at] - first_key(s, self.model.shards))
                out[at] = np.where(place >= 0, place + self.offsets[0][s], -1)
        return out

    def values(self, level: int, name: str, nodes: np.ndarray) -> np.ndarray:
        """A plain array of a level, at global ids."""
        out = None
        shard = np.searchsorted(self.offsets[level], nodes, side="right") - 1
        for s, at in self.by_shard(shard):
            found = self.held(level, s)[name][nodes[at] - self.offsets[level][s]]
            out = np.zeros(len(nodes), found.dtype) if out is None else out
            out[at] = found
        return np.zeros(0, np.int64) if out is None else out

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Word ids of all tokens of each text; -1 for words not seen in training."""
        if len(self.recent) > CACHE_WORDS:
            self.older, self.recent = dict(self.recent), _Recent()
        recent = self.recent
        recent.older, recent.new = self.older, []
        new = recent.new
        at = recent.__getitem__
        found = [np.fromiter(map(at, words), np.int32, len(words)) for words in texts]
        if new:
            known = self.word_ids(hashes(new)).astype(np.int32)
            recent.update(zip(new, known.tolist(), strict=True))
            for ids in found:
                later = np.flatnonzero(ids < -1)
                ids[later] = known[-2 - ids[later]]
        return found

    def parent_shard(self, level: int, parents: np.ndarray) -> np.ndarray:
        return context_range(parents, int(self.offsets[level - 1][-1]), self.model.shards)

    def children(self, level: int, parents: np.ndarray, successors: np.ndarray, relative: bool = False, prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Global ids of (parent, successor) on a level and, if relative, their places among their parents' successors; or -1.

        Equal queries are looked up once, in the order of the sequence. prices: gets their log10 probabilities, 0 for none.
        """
        out, places = np.full(len(parents), -1, np.int64), np.full(len(parents) if relative else 0, -1, np.int64)
        if len(self.model.offsets) <= level or not len(parents):
            return out, places
        key = parents << 32 | successors
        order = np.argsort(key)
        key = key[order]
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        key, back = key[new], np.cumsum(new) - 1
        p, w = key >> 32, key & 0xFFFFFFFF
        found, place = np.full(len(p), -1, np.int64), np.full(len(p), -1, np.int64)
        price = np.zeros(len(p) if prices is not None else 0)
        # parents ascend, and so do their shards
        shard = self.parent_shard(level, p)
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(p)]
        for a, b in zip(cut, cut[1:], strict=False):
            s = int(shard[a])
            held = self.held(level, s)
            first, width = held["frame"]
            fits = a + np.flatnonzero(w[a:b] < width)
            at = self.seq(level, s, "children").search((p[fits] - first).astype(U64) * U64(width) + w[fits].astype(U64))
            hit = np.flatnonzero(at >= 0)
            fits, at = fits[hit], at[hit]
            found[fits] = at + self.offsets[level][s]
            if prices is not None:
                price[fits] = held["p_book"][held["p"][at]]
            if relative and len(fits):
                head = np.flatnonzero(np.diff(p[fits], prepend=-1))
                start = self.seq(level, s, "pointers").access(p[fits[head]] - first).astype(np.int64)
                place[fits] = at - np.repeat(start, np.diff(np.append(head, len(fits))))
        out[order] = found[back]
        if prices is not None:
            prices[order] = price[back]
        if relative:
            places[order] = place[back]
        return out, places

    def starts(self, level: int, parents: np.ndarray) -> np.ndarray:
        """Global id of the first successor of each parent, by the parents' pointers."""
        out = np.zeros(len(parents), np.int64)
        for s, at in self.by_shard(self.parent_shard(level, parents)):
            out[at] = self.seq(level, s, "pointers").access(parents[at] - self.held(level, s)["frame"][0]).astype(np.int64) + self.offsets[level][s]
        return out

    def successor(self, pairs: np.ndarray) -> np.ndarray:
        """The second word of each pair."""
        out = np.zeros(len(pairs), np.int64)
        for s, at in self.by_shard(np.searchsorted(self.offsets[1], pairs, side="right") - 1):
            width = int(self.held(1, s)["frame"][1])
            out[at] = (self.seq(1, s, "children").access(pairs[at] - self.offsets[1][s]) % U64(width)).astype(np.int64)
        return out

    def rest(self, level: int, parents: np.ndarray) -> np.ndarray:
        """log10 of what a context leaves to the shorter one."""
        out = np.zeros(len(parents))
        for s, at in self.by_shard(self.parent_shard(level, parents)):
            held = self.held(level, s)
            out[at] = held["rest_book"][held["rest"][parents[at] - held["frame"][0]]]
        return out

    def log_p(self, level: int, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes))
        for s, at in self.by_shard(np.searchsorted(self.offsets[level], nodes, side="right") - 1):
            held = self.held(level, s)
            out[at] = held["p_book"][held["p"][nodes[at] - self.offsets[level][s]]]
        return out

    def count(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        if len(known):
            out[known] = self.values(0, "count", ids[known])
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.model.total + 1.0 * (self.model.words + 1)))

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The word before each token; before a text, the end."""
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[first] = self.ids([[END]])[0][0]
        return context

    def pairs(self, ids: np.ndarray, context: np.ndarray, prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each token the node of the pair it ends, and its place among the context's successors; -1 where there is none.

        prices: gets the pairs' log10 probabilities where there is one.
        """
        node, place = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        known = np.flatnonzero((ids >= 0) & (context >= 0))
        own = np.zeros(len(known)) if prices is not None else None
        node[known], place[known] = self.children(1, context[known], ids[known], relative=True, prices=own)
        if prices is not None:
            found = node[known] >= 0
            prices[known[found]] = own[found]
        return node, place

    def triples(self, node: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions with a pair before them that ends in their context; that pair, and the successor's relative id or -1."""
        before = np.full(len(node), -1, np.int64)
        before[1:] = node[:-1]
        before[first] = -1
        at = np.flatnonzero(before >= 0)
        return at, before[at], place[at]


_tries: dict[Model, Trie] = {}


def opened(model: Model) -> Trie:
    if model not in _tries:
        _tries.clear()
        _tries[model] = Trie(model)
    return _tries[model]


def first_of(texts: list[list[bytes]]) -> np.ndarray:
    return np.cumsum([0, *(len(t) for t in texts[:-1])])


# ---------------------------------------------------------------- ranges and packed keys


def range_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit keys, in equal ranges."""
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def first_key(shard: int, shards: int) -> np.uint64:
    return U64(-(-(shard << 32) // shards) << 32)


def context_range(ids: np.ndarray, total: int, shards: int) -> np.ndarray:
    return ids * shards // max(total, 1)


def first_context(shard: int, total: int, shards: int) -> int:
    return -(-shard * total // shards)


def packed(parents: np.ndarray, successors: np.ndarray, total: int, shards: int) -> pa.RecordBatch:
    """Sorted distinct keys of (parent, successor) with their counts, a row a shard, as byte planes of their differences."""
    keys, counts = np.unique(parents.astype(U64) << U64(32) | successors.astype(U64), return_counts=True)
    shard = context_range((keys >> U64(32)).astype(np.int64), total, shards)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    rows: tuple[list, list, list] = ([], [], [])
    for a, b in zip(cut, cut[1:], strict=False):
        steps = np.diff(keys[a:b], prepend=U64(0))
        rows[0].append(int(shard[a]))
        rows[1].append(steps.view(np.uint8).reshape(-1, 8).T.tobytes())
        rows[2].append(counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["shard", "keys", "counts"])


PACKED = "shard int, keys binary, counts binary"


def merged(frame: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a shard with their sums, those of at least ``least``."""
    keys, counts = [], []
    for k, c in zip(frame["keys"], frame["counts"], strict=True):
        if k:
            keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(8, -1).T).view(U64).ravel(), dtype=U64))
            counts.append(np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(4, -1).T).view("<u4").ravel())
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    every, number = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(every) != 0]))
    number = np.add.reduceat(number, first)
    kept = number >= least
    return every[first][kept], number[kept]


def quantised(name: str, logs: np.ndarray) -> dict[str, np.ndarray]:
    """One byte a value, and the book of means of as many equally filled levels."""
    if len(logs) <= 1 or logs.min() == logs.max():
        book = np.array([logs[0] if len(logs) else 0.0])
        return {name: np.zeros(len(logs), np.uint8), f"{name}_book": book}
    edges = np.unique(np.quantile(logs, np.linspace(0, 1, LEVELS + 1)[1:-1]))
    level = np.searchsorted(edges, logs, side="right")
    sums, n = np.bincount(level, logs, len(edges) + 1), np.bincount(level, minlength=len(edges) + 1)
    return {name: level.astype(np.uint8), f"{name}_book": sums / np.maximum(n, 1)}


# ---------------------------------------------------------------- training


def _sizes(df: DataFrame, shards: int) -> tuple[int, ...]:
    """Running totals of the shards' sizes; running this writes the files."""
    found = {r["shard"]: r["n"] for r in df.collect()}
    return tuple(np.cumsum([0, *(found.get(s, 0) for s in range(shards))]).tolist())


def _all_shards(df: DataFrame, shards: int) -> DataFrame:
    """A row of zeros or empty strings for each shard, so that every shard's file is written."""
    empty = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(b"" if t == "binary" else 0).cast(t).alias(c) for c, t in df.dtypes if c != "shard"])
    return df.unionByName(empty)


def words_of(texts: DataFrame, text_col: str = "text") -> Model:
    """The level of words of all texts."""
    spark = texts.sparkSession
    texts = texts.select(text_col)
    path = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for block in token_blocks(batch, 0):
                for words in block:
                    seen.update(words)
                if len(seen) >= MAX_WORDS_A_TASK:
                    yield out()
        yield out()

    counted = texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(counted.select(F.xxhash64("word").alias("key"), "n"), "lm-words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // WORDS_A_SHARD))

    def write_words(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard, frame = int(key[0]), frame[frame["n"] > 0]
        keys = frame["key"].to_numpy(np.int64).view(U64)
        order = np.argsort(keys)
        arrays = under("keys", EliasFano.encode(keys[order] - first_key(shard, shards), (1 << 64) // shards + (1 << 33)))
        save(f"{path}/0-{shard}", arrays | {"count": frame["n"].to_numpy(np.int64)[order]})
        return pd.DataFrame({"shard": [shard], "n": [len(frame)]})

    top = F.shiftrightunsigned("key", 32) * shards
    placed = _all_shards(words.select(F.shiftrightunsigned(top, 32).cast("int").alias("shard"), "key", "n"), shards)
    offsets = (_sizes(placed.groupBy("shard").applyInPandas(write_words, "shard int, n long"), shards),)
    return Model(path, shards, int(total), int(size), offsets)


#: The column of a text's word ids: each plus one, 0 for words not seen in training; the lowest bytes of all, then the next.
WORDS = "__words"


def indexed(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns and each text's word ids, written once; later passes read ids in place of texts."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(WORDS, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(model)
        for batch in batches:
            begun = 0
            for block in token_blocks(batch, batch.num_columns - 1):
                made = [np.ascontiguousarray((x + 1).view(np.uint8).reshape(-1, 4).T).tobytes() for x in trie.ids(block)]
                part = batch.slice(begun, len(block))
                begun += len(block)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(made, pa.binary())], names=[*keep, WORDS])

    return materialise(docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema), "lm-ids", "zstd")


def id_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, next row, the ids of all their tokens, and the place of each row's first token; about BLOCK_TOKENS at a time."""
    held, size, begun = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        held.append(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T)
        size += len(held[-1])
        if size >= BLOCK_TOKENS or i == batch.num_rows - 1:
            ids = np.ascontiguousarray(np.concatenate(held)).view("<i4").ravel().astype(np.int64) - 1
            yield begun, i + 1, ids, np.cumsum([0, *map(len, held[:-1])])
            held, size, begun = [], 0, i + 1


def train(docs: DataFrame, text_col: str = "text", least: int = MIN_COUNT) -> Model:
    """The model of all texts of docs, with the pairs and triples seen at least ``least`` times."""
    model = words_of(docs, text_col)
    return with_levels(indexed(docs, model, text_col=text_col, keep=[]), model, least)


def with_levels(texts: DataFrame, model: Model, least: int = MIN_COUNT) -> Model:
    """The model of words with the pairs and triples of the indexed texts, from which its words were counted."""
    for level in (1, 2):
        model = _add_level(texts.select(WORDS), model, level, least)
    return model


def _add_level(texts: DataFrame, model: Model, level: int, least: int) -> Model:
    parents = model.offsets[level - 1][-1]
    if parents >= 1 << 31 or model.offsets[0][-1] >= 1 << 31:
        raise ValueError(f"level {level} has {parents} parents; keys hold ids below 2**31, so raise least")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = opened(model), [], 0
        for batch in batches:
            for _, _, ids, first in id_blocks(batch, 0):
                context = trie.contexts(ids, first)
                if level == 1:
                    held.append((context, ids))
                else:
                    _, before, place = trie.triples(*trie.pairs(ids, context), first)
                    held.append((before[place >= 0], place[place >= 0]))
                size += len(held[-1][0])
                if size >= FLUSH_KEYS:
                    yield packed(*map(np.concatenate, zip(*held, strict=True)), parents, model.shards)
                    held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), parents, model.shards)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        trie, shard = opened(model), int(key[0])
        begin, end = (first_context(shard + i, parents, model.shards) for i in (0, 1))
        keys, counts = merged(frame, least)
        up, below = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
        contexts = np.arange(begin, end)
        seen = trie.count(contexts) if level == 1 else trie.values(1, "count", contexts).astype(np.int64)
        own = np.bincount(up - begin, counts - DISCOUNT, minlength=end - begin)
        rest = 1 - own / np.maximum(seen, 1)
        if level == 1:
            shorter = trie.base(trie.count(below))
        else:
            # the pair of the context's second word and the successor
            shorter = trie.log_p(1, trie.starts(1, trie.successor(contexts))[up - begin] + below)
        p = np.log10((counts - DISCOUNT) / np.maximum(seen[up - begin], 1) + rest[up - begin] * 10**shorter)
        width = int(below.max(initial=0)) + 1
        place = (up - begin).astype(U64) * U64(width) + below.astype(U64)
        pointers = np.searchsorted(up, np.arange(begin, end + 1)).astype(U64)
        arrays = under("children", EliasFano.encode(place, max(1, (end - begin) * width))) | under("pointers", EliasFano.encode(pointers, len(keys) + 1))
        arrays |= quantised("p", p) | quantised("rest", np.log10(np.maximum(rest, 1e-12)))
        arrays |= {"frame": np.array([begin, width], np.int64)}
        if level == 1:
            arrays |= {"count": counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)}
        save(f"{model.path}/{level}-{shard}", arrays)
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "size": [sum(a.nbytes for a in arrays.values())]})

    spread = _all_shards(texts.mapInArrow(count, PACKED), model.shards)
    done = materialise(spread.groupBy("shard").applyInPandas(write, "shard int, n long, size long"), "lm-sizes")
    if (size := done.agg(F.sum("size")).first()[0]) > MAX_BYTES:
        raise ValueError(f"level {level} has {size} bytes; raise least, or MAX_BYTES if executors have the disk")
    return Model(model.path, model.shards, model.total, model.words, (*model.offsets, _sizes(done, model.shards)))


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score."""
    return score_indexed(indexed(docs, model, text_col=text_col, keep=keep), model, keep=keep)


def score_indexed(texts: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """As ``score``, for indexed texts."""
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*(texts.schema[c] for c in keep), *(T.StructField(c, t) for c, t in added)])

    def block_scores(trie: Trie, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        counts = trie.count(ids)
        base = trie.base(counts)
        log_p = base.copy()
        context = trie.contexts(ids, first)
        node, place = trie.pairs(ids, context, log_p)
        known = np.flatnonzero((context >= 0) & (node < 0))
        if model.words:
            log_p[known] += trie.rest(1, context[known])
        at, before, relative = trie.triples(node, place, first)
        if len(at):
            some = np.flatnonzero(relative >= 0)
            prices = np.zeros(len(some))
            triple, _ = trie.children(2, before[some], relative[some], prices=prices)
            hit = some[triple >= 0]
            off = np.ones(len(at), bool)
            off[hit] = False
            log_p[at[off]] += trie.rest(2, before[off])
            log_p[at[hit]] = prices[triple >= 0]
        sums = [np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64), base, log_p)]
        return [np.diff(np.append(first, len(ids))), sums[0], np.full(len(first), model.total), sums[1], sums[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(model)
        for batch in batches:
            for a, b, ids, first in id_blocks(batch, batch.num_columns - 1):
                part = batch.slice(a, b - a)
                columns = block_scores(trie, ids, first)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *map(pa.array, columns)], names=[*keep, *(c for c, _ in added)])

    return texts.select(*keep, WORDS).mapInArrow(run, schema)
