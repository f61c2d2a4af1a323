"""Collocations: phrases of two and three words that are frequent and that their parts predict, by language.

Three narrow passes over the texts, one for each length. A phrase of LEAST occurrences has only parts of LEAST occurrences, so
a pass counts what the bitmap of the frequent shorter phrases lets through; the bitmap saves work and decides nothing.

A task counts phrases in a HAT-trie: a shallow trie over word ids whose nodes are hash containers. The root leads from the
first word to a container of the words that follow; a container of more than BURST entries bursts into containers by the
second word. When a task holds more than HELD entries, its largest subtrees leave it whole, each as a run of phrases in byte
order. Runs meet in the partition of their prefix, the first two words, and are merged there. A hot word or pair costs its
distinct continuations a task, never its occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_WORDS, bitmap, in_bitmap, materialise

LEAST, TOP, SCALE = 10, 2000, 1_000_000
#: Per cent of a phrase's occurrences in a longer one from which it counts as part of that.
ABSORBED = 50
#: Entries a task holds; entries of a container that bursts; bytes split into words at a time; words a task knows by id.
HELD, BURST, PART, KNOWN = 1_000_000, 4096, 1 << 20, 1_000_000
#: Phrases that a trie takes at a time; bits of a word's id: KNOWN and the words of one part stay below.
BATCH, _BITS = 200_000, 21
#: Rows that runs leave a task in; parts of a language's phrases that are ranked by themselves first.
RUN_ROWS, PARTS = 50_000, 64
_LAST = (1 << _BITS) - 1

#: A-Z lower-cased, a piece's end to a full stop, tab to space; a full stop is then no byte of any word.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in range(256))
_END = b"."
_RUNS = "lang string, head binary, tail binary, f long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, and _END wherever a piece ends, some PART bytes at a time."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PART) if start + PART < len(text) else len(text)
        end = len(text) if end < 0 else end
        # bytes.split() knows no white space that is left but the space
        yield text[start:end].translate(_BYTES).replace(_END, b" . ").split()
        start = end


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


class _Ids(dict):
    """Words to ids; -1 for words that the bitmap of frequent ones rules out, and for the end of a piece."""

    def __init__(self, lang: str, frequent: np.ndarray) -> None:
        self.names: list[bytes] = []
        self.hashes = np.zeros(1024, np.uint64)
        self.seed, self.frequent = _seed(lang), frequent
        self[_END] = -1

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh64_intdigest(word, self.seed)
        if int(self.frequent[(x >> 6) & (BITMAP_WORDS - 1)]) >> (x & 63) & 1:
            self[word] = found = len(self.names)
            self.names.append(word)
            if found == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(found, np.uint64)])
            self.hashes[found] = x
        else:
            self[word] = found = -1
        return found


class _Branch:
    """A burst container: containers by the second word."""

    def __init__(self, entries: dict[int, int]) -> None:
        self.children: dict[int, dict[int, int]] = {}
        self.size = 0
        self.add(list(entries), list(entries.values()))

    def add(self, rests: list[int], counts: list[int]) -> None:
        children = self.children
        for rest, n in zip(rests, counts):
            second = rest >> _BITS
            if second not in children:
                children[second] = {}
            child = children[second]
            if rest in child:
                child[rest] += n
            else:
                child[rest] = n
                self.size += 1

    def __len__(self) -> int:
        return self.size

    def items(self) -> Iterator[tuple[int, int]]:
        return (entry for child in self.children.values() for entry in child.items())


class HatTrie:
    """Counts of phrases of three ids, or of two (the third is 0), packed in 63 bits: by first id, then in containers by the rest.

    Phrases are taken in sorted batches of BATCH, so that each subtree is entered once a batch.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.root: dict[int, dict[int, int] | _Branch] = {}
        self.burst, self.waiting, self.n_waiting = burst, [], 0

    def add(self, packed: np.ndarray) -> None:
        self.waiting.append(packed)
        self.n_waiting += len(packed)
        if self.n_waiting >= BATCH:
            self.settle()

    def settle(self) -> None:
        """Count what was added since the last batch."""
        if not self.n_waiting:
            return
        different, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        firsts = different >> (2 * _BITS)
        rests, numbers = (different & ((1 << 2 * _BITS) - 1)).tolist(), counts.tolist()
        cuts = [0, *(np.flatnonzero(np.diff(firsts)) + 1).tolist(), len(rests)]
        for begin, end in zip(cuts, cuts[1:]):
            first = int(firsts[begin])
            node = self.root.get(first)
            if node is None:
                node = self.root[first] = dict(zip(rests[begin:end], numbers[begin:end]))
            elif isinstance(node, _Branch):
                node.add(rests[begin:end], numbers[begin:end])
            else:
                get = node.get
                for rest, n in zip(rests[begin:end], numbers[begin:end]):
                    node[rest] = get(rest, 0) + n
            if not isinstance(node, _Branch) and len(node) > self.burst:
                self.root[first] = _Branch(node)

    def __len__(self) -> int:
        return self.n_waiting + sum(map(len, self.root.values()))

    def subtrees(self, keep: int) -> Iterator[tuple[int, dict[int, int] | _Branch]]:
        """Take the largest subtrees out until keep entries are left: (first id, subtree)."""
        self.settle()
        size = len(self)
        for first in sorted(self.root, key=lambda a: len(self.root[a]), reverse=True):
            if size <= keep:
                return
            node = self.root.pop(first)
            size -= len(node)
            yield first, node

    def spill(self, keep: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """As subtrees: (first id, entries)."""
        return ((first, list(node.items())) for first, node in self.subtrees(keep))


class _Runs:
    """Subtrees of one language as runs: rows in byte order of their phrases, some RUN_ROWS at a time."""

    def __init__(self, lang: str, names: list[bytes], width: int) -> None:
        self.lang, self.width, self.names = lang, width, pa.array(names, pa.binary())
        self.rank = np.empty(len(names), np.int64)
        self.rank[pc.array_sort_indices(self.names).to_numpy()] = np.arange(len(names))
        self.clear()

    def clear(self) -> None:
        self.firsts, self.sizes, self.rests, self.numbers = [], [], [], []

    def add(self, first: int, node: dict[int, int] | _Branch) -> None:
        self.firsts.append(first)
        self.sizes.append(len(node))
        for held in node.children.values() if isinstance(node, _Branch) else (node,):
            self.rests.extend(held)
            self.numbers.extend(held.values())

    def __len__(self) -> int:
        return len(self.rests)

    def batch(self) -> pa.RecordBatch:
        rests, number = np.array(self.rests, np.int64), np.array(self.numbers, np.int64)
        first, run = np.repeat(self.firsts, self.sizes), np.repeat(np.arange(len(self.sizes)), self.sizes)
        second, third = rests >> _BITS, rests & _LAST
        order = np.lexsort((self.rank[third], self.rank[second], run) if self.width == 3 else (self.rank[second], run))
        word = lambda ids: self.names.take(pa.array(ids[order]))
        head = pc.binary_join_element_wise(word(first), word(second), b" ")
        tail = word(third) if self.width == 3 else pa.repeat(pa.scalar(b"", pa.binary()), len(rests))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(self.lang, pa.string()), len(order)), head, tail, pa.array(number[order])], ["lang", "head", "tail", "f"])


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield lang, text.as_py()


def _count_words(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to each task's counts of words; the empty word stands for all words of a language."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(_END, None)
            found[b""] = found.total()
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(found.keys(), pa.binary()), pa.array([b""] * n, pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "head", "tail", "f"])
        counts.clear()

    for lang, text in _texts(batches):
        for words in _words(text):
            counts[lang].update(words)
        if sum(map(len, counts.values())) > held:
            yield from rows()
    yield from rows()


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of two words' hashes; the same as _pair_column."""
    return first ^ (second << np.uint64(21) | second >> np.uint64(43))


def _pair_column(first: Column, second: Column) -> Column:
    return first.bitwiseXOR(F.shiftleft(second, 21).bitwiseOR(F.shiftrightunsigned(second, 43)))


def _allowed(ids: _Ids, at: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """Whether a phrase may begin at each place: its pairs of words are frequent (or, without pairs, its words)."""
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    if pairs is None:
        return both
    hashes = _pair_hash(ids.hashes[at[:-1][both]], ids.hashes[at[1:][both]])
    both[both] = in_bitmap(pairs, hashes.view(np.int64))
    return both[:-1] & both[1:]


def _count_phrases(batches: Iterator[pa.RecordBatch], frequent: Broadcast, width: int, held: int, burst: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to runs of phrases of width words; frequent: bitmaps of words and, for width 3, of pairs."""
    words_seen, pairs_seen = frequent.value
    state: dict[str, tuple[_Ids, HatTrie]] = {}
    added = 0

    def spilled(keep: int) -> Iterator[pa.RecordBatch]:
        for lang, (ids, trie) in state.items():
            runs = _Runs(lang, ids.names, width)
            for first, node in trie.subtrees(keep // len(state)):
                runs.add(first, node)
                if len(runs) >= RUN_ROWS:
                    yield runs.batch()
            if len(runs):
                yield runs.batch()

    for lang, text in _texts(batches):
        last: list[bytes] = []
        for words in _words(text):
            # what spans two parts of a long text is counted with the second
            words = last + words
            last = words[-(width - 1) :]
            if added > held:
                added = sum(len(trie) for _, trie in state.values())
                if added > held // 2:
                    yield from spilled(held // 4)
                    added = sum(len(trie) for _, trie in state.values())
            if sum(len(ids) for ids, _ in state.values()) > KNOWN:
                yield from spilled(0)
                state.clear()
                added = 0
            if lang not in state:
                state[lang] = _Ids(lang, words_seen), HatTrie(burst)
            ids, trie = state[lang]
            at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            if len(at) >= width:
                begin = np.flatnonzero(_allowed(ids, at, pairs_seen))
                packed = at[begin] << (2 * _BITS) | at[begin + 1] << _BITS
                trie.add(packed | at[begin + 2] if width == 3 else packed)
                added += len(begin)
    yield from spilled(0)


def _merged(runs: DataFrame, name: str, least: int) -> DataFrame:
    """Runs merged per prefix partition: (lang, phrase, f) of at least so many occurrences."""
    merged = runs.repartition("lang", "head").groupBy("lang", "head", "tail").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("head") == F.lit(b"")))
    phrase = F.when(F.octet_length("tail") > 0, F.concat("head", F.lit(b" "), "tail")).otherwise(F.col("head"))
    return materialise(merged.select("lang", phrase.cast("string").alias("phrase"), "f"), name)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a a / (left right)), exact for counts below 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases for documents (lang, text); see the module.

    Null lang counts as und, null text as empty; texts without words, and languages without phrases of `least` occurrences,
    give no rows. Repeated rows count each time. Very long texts are read whole, in parts. Ties in score go to the larger
    count, then to the phrase that comes first in UTF-8 order, so the result does not depend on partitions. Other columns
    are not looked at. An empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = _merged(texts.mapInArrow(lambda b: _count_words(b, held), _RUNS), "collocation-words", least)
    words, totals = counted.filter("phrase != ''"), counted.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    h = F.xxhash64("lang", "phrase").alias("h")
    frequent = context.broadcast((bitmap(words.select(h)), None))
    pairs = _merged(texts.mapInArrow(lambda b: _count_phrases(b, frequent, 2, held, burst), _RUNS), "collocation-pairs", least)
    first, second = (F.xxhash64("lang", F.split("phrase", " ")[i]) for i in (0, 1))
    frequent_pairs = context.broadcast((frequent.value[0], bitmap(pairs.select(_pair_column(first, second).alias("h")))))
    triples = _merged(texts.mapInArrow(lambda b: _count_phrases(b, frequent_pairs, 3, held, burst), _RUNS), "collocation-triples", least)

    part = F.split("phrase", " ")
    two, three = pairs.withColumn("w", part), triples.withColumn("w", part)
    head, tail = F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2])
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = two.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(cut(1, F.col("w")[0], F.col("w")[1])))).unionByName(
        three.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(cut(1, F.col("w")[0], tail), cut(2, head, F.col("w")[2]))))
    )
    parts = words.unionByName(pairs)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    best = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best)
    longer = three.select("lang", F.explode(F.array(head, tail)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < %d * a" % ABSORBED)
    # a language's phrases are cut in PARTS first, so that no task ranks them all
    order = (F.desc("best.score"), F.desc("a"), "phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    near = free.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return near.withColumn("rank", rank).filter(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
