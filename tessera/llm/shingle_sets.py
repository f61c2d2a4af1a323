"""Groups of texts whose sets of word shingles are similar: SimHash's trie and MinHash bands propose pairs, the exact sets decide.

Proposal: the 64-bit fingerprints of the sets (SimHash) go through the self-join of ``simhash``; its pairs within BUDGET bits, a
spanning forest of each cell's, are compared first. Fingerprints of texts of similarity 0.8 differ in about ten bits, which no
trie reaches, so bands add the rest: BANDS keys of ROWS least hashes each are taken of a text's set of 64-bit shingle hashes;
texts that share a key meet in a bucket. Two sets of Jaccard similarity 0.8 share none with a probability of
(1 - 0.8^4)^20 = 0.00003, less above.

Decision: a link stands only if |A and B| / |A or B| of the shingle hashes reaches the similarity. The trie's pairs, and each
member of a bucket with the bucket's smallest node, are compared in a join; components of these links are formed. Members that are not in
their representative's component by then are compared with every member of another component, in cells of at most about
CHUNK by CHUNK, each returning a spanning forest. So a family of near copies costs its size, while a bucket of texts that
are alike but below the similarity costs the number of its pairs, spread over cells. No pair of a bucket is left out.

Before sets are moved, sketches of BINS bytes are held against each other: the least hash of each of BINS ranges, a byte of
it. The share of equal bytes estimates the similarity; a pair goes on unless it lies MARGIN standard deviations below the
threshold, which happens to a similar pair with a probability of about 0.000001. A pair of a large bucket is looked at in
the first bucket only that its members share. Sets are computed again, for the documents of pairs that go on; a bitmap of
fixed size picks them.

Joins are by sorted shuffles, whatever the size: none of these tables stays small as the corpus grows, and Spark splits the
partitions of hot keys.

Only distinct sets take part, each with the smallest id of its documents.

Edge cases: as in ``simhash``; texts without words are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import bitmap, in_bitmap, materialise
from .components import components
from .simhash import SEED, forest, majority, named, shingle_hashes, stirred

#: Bits in which fingerprints that the trie links may differ.
BUDGET = 2
ROWS, BANDS = 4, 20
CHUNK = 512
BINS, MARGIN = 256, 5
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_SCALE = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, i : i + 1024] ^ _FLIP) * _SCALE).min(1), out=least)
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = stirred(key * np.uint64(0x9E3779B97F4A7C15) + row, 1)
    return key.view(np.int64)


def sketch_of(hashes: np.ndarray) -> bytes:
    """A byte for each range of hashes: 0 if the set has none there, else 1 to 255 of its least."""
    out = np.zeros(BINS, np.uint8)
    x = np.sort(stirred(hashes, 2))
    at = (x >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] = 1 + x[first] % np.uint64(255)
    return out.tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches a and b, bytes along the last axis, may be those of similar sets."""
    used = np.maximum(((a | b) != 0).sum(-1), 1)
    alike = ((a == b) & (a != 0)).sum(-1)
    return alike / used >= similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / used)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(-1, BINS)


def _set(text: bytes, width: int) -> tuple[np.ndarray, int]:
    """The sorted shingle hashes of a text, and the signed hash that names the set."""
    hashes = np.unique(shingle_hashes(text, width))
    return hashes, xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - (1 << 63)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """docs(id, text) to (id, node, print, keys, sketch); print: the set's fingerprint."""
    added = [T.StructField("node", T.LongType()), T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, sketches = [], [], [], []
            for x in batch.column(1).cast(pa.large_binary()):
                hashes, node = _set(x.as_py() or b"", width)
                nodes.append(node)
                prints.append(majority(hashes))
                keys.append(band_keys(hashes))
                sketches.append(sketch_of(hashes))
            printed = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [batch.column(0), pa.array(nodes, pa.int64()), printed, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "print", "keys", "sketch"])

    return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], *added]))


def _contents(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles), a row each, of at least the documents in ids(id)."""
    h = F.xxhash64("id")
    proposed = bitmap(ids.select(h.alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(proposed, batch.column(0).to_numpy())
            made = [_set(t.as_py() or b"", width) for t in batch.column(1).filter(pa.array(hit)).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in made], pa.int64()), pa.array([s.astype("<u8").tobytes() for s, _ in made], pa.binary())], names=["node", "shingles"])

    return docs.select(h.alias("h"), "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _reaches(common, total, similarity: float):
    """Whether sets with ``total`` elements together, the common ones counted twice, are similar."""
    return common * (1 + similarity) >= similarity * total - 1e-9


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each left and each right set."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)
    at_a, at_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    for k in range(0, len(both), 4096):
        some = both[k : k + 4096]
        sides = []
        for x, at, n in ((a, at_a, len(left)), (b, at_b, len(right))):
            place = np.searchsorted(some, x)
            hit = some[np.minimum(place, len(some) - 1)] == x
            dense = np.zeros((n, len(some)), np.float32)
            dense[at[hit], place[hit]] = 1
            sides.append(dense)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, proposed: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of at least the nodes in wanted(node)."""
    ids = wanted.distinct().join(proposed.select("node", "id"), "node").select("id")
    return materialise(_contents(docs, ids, width), "set-contents")


def _by_trie(nodes: DataFrame) -> DataFrame:
    """(node, rep): pairs of sets whose fingerprints the trie links, and those of one fingerprint with its smallest node."""
    printed = nodes.filter(F.size("keys") > 0).select("node", "print")
    prints = materialise(printed.groupBy("print").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "set-prints")
    met = simhash.links(prints.select(F.col("print").alias("node")), budget=BUDGET, as_met=True).distinct()
    pairs = met.join(prints.select(F.col("print").alias("u"), F.col("rep").alias("node")).hint("merge"), "u")
    pairs = pairs.join(prints.select(F.col("print").alias("v"), "rep").hint("merge"), "v").select("node", "rep")
    equal = printed.join(prints.filter("n > 1").select("print", "rep").hint("merge"), "print").filter("node != rep").select("node", "rep")
    return materialise(pairs.unionByName(equal).select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")), "set-fingerprint-pairs")


def _compared(docs: DataFrame, stars: DataFrame, proposed: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (node, rep) to the links (u, v) among them."""
    stars = stars.join(proposed.select("node", F.col("sketch").alias("own")).hint("merge"), "node")
    stars = stars.join(proposed.select(F.col("node").alias("rep"), F.col("sketch").alias("other")).hint("merge"), "rep").select("node", "rep", "own", "other")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = may_reach(_sketches(batch.column(2)), _sketches(batch.column(3)), similarity)
            yield batch.select([0, 1]).filter(pa.array(near))

    stars = materialise(stars.mapInArrow(likely, "node long, rep long"), "set-stars")
    sets = _sets_of(docs, stars.select("node").union(stars.select("rep")), proposed, width)
    pairs = stars.join(sets.withColumnRenamed("shingles", "own").hint("merge"), "node")
    pairs = pairs.join(sets.select(F.col("node").alias("rep"), F.col("shingles").alias("other")).hint("merge"), "rep").select("node", "rep", "own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                near.append(bool(_reaches(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), similarity)))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_())).rename_columns(["u", "v"])

    return materialise(pairs.mapInArrow(run, "u long, v long"), "set-links")


def _others(docs: DataFrame, members: DataFrame, near: DataFrame, proposed: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """The links of members that their representatives' components do not hold; None if there is no such member."""
    roots = materialise(components(near), "set-roots")
    wide = members.filter("n > 2").join(roots.select(F.col("u").alias("node"), "root"), "node", "left")
    wide = wide.join(roots.select(F.col("u").alias("rep"), F.col("root").alias("rep_root")), "rep", "left")
    root = F.coalesce("root", "node")
    wide = materialise(wide.select("t", "key", "n", "node", root.alias("root"), (root != F.coalesce("rep_root", "rep")).alias("far")), "set-rest")
    far = materialise(wide.filter("far").groupBy("t", "key").agg(F.count("*").alias("n_far")), "set-far")
    if not far.take(1):
        return None
    wide = wide.join(far, ["t", "key"])
    chunks, far_chunks = F.ceil(F.col("n") / CHUNK), F.ceil(F.col("n_far") / CHUNK)
    own = lambda k: F.pmod(F.xxhash64("node"), k)
    to = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    keep = ["t", "key", "node", "root"]
    left = wide.filter("far").select(*keep, F.lit(0).alias("side"), own(far_chunks).alias("i"), to(chunks).alias("j"))
    right = wide.select(*keep, F.lit(1).alias("side"), own(chunks).alias("j"), to(far_chunks).alias("i"))
    schema = "t int, key long, i long, j long, side int, node long, root long"

    def likely(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[frame["side"] == s] for s in (0, 1))
        held, other = (np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(-1, BINS) for x in (a, b))
        keys, other_keys = (np.stack(x["keys"].to_numpy()) if len(x) else np.zeros((0, BANDS), np.int64) for x in (a, b))
        root, other_root, t = a["root"].to_numpy(), b["root"].to_numpy(), frame["t"].iat[0]
        on, other_on = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for k in range(len(a)):
            j = np.flatnonzero(other_root != root[k])
            j = j[may_reach(held[k], other[j], similarity)]
            j = j[(other_keys[j] == keys[k]).argmax(1) == t]
            on[k] = len(j) > 0
            other_on[j] = True
        return pd.concat([a[on], b[other_on]])[["t", "key", "i", "j", "side", "node", "root"]]

    met = left.unionByName(right).join(proposed.select("node", "sketch", "keys"), "node")
    cells = materialise(met.groupBy("t", "key", "i", "j").applyInPandas(likely, schema), "set-cells")
    sets = _sets_of(docs, cells.select("node"), proposed, width)

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["side"] == s] for s in (0, 1)]
        if not (len(sides[0]) and len(sides[1])):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        held = [[np.frombuffer(x, "<u8") for x in s["shingles"]] for s in sides]
        names, place = np.unique(np.concatenate([s["root"].to_numpy() for s in sides]), return_inverse=True)
        p, q = place[: len(sides[0])], place[len(sides[0]) :]
        total = np.array([len(x) for x in held[0]])[:, None] + np.array([len(x) for x in held[1]])
        i, j = np.nonzero(_reaches(overlaps(*held), total, similarity) & (p[:, None] != q))
        parent = forest(np.arange(len(names)), p[i], q[j])
        member = np.flatnonzero(parent != np.arange(len(names)))
        return pd.DataFrame({"u": names[member], "v": names[parent[member]]})

    return materialise(cells.join(sets, "node").groupBy("t", "key", "i", "j").applyInPandas(local, "u long, v long"), "set-more")


def links(docs: DataFrame, nodes: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """docs(id, text) and nodes(node, id, print, keys, sketch), a row for each distinct set, to links (u, v) that span the groups."""
    codes = materialise(nodes.select("node", F.posexplode("keys").alias("t", "key")), "set-bands")
    buckets = codes.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("rep"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    # buckets of the same members count once
    once = buckets.filter("n > 1").groupBy("n", "rep", "mark").agg(F.min(F.struct("t", "key")).alias("at"))
    once = materialise(once.select("at.t", "at.key", "n", "rep"), "set-buckets")
    members = materialise(codes.join(once.hint("merge"), ["t", "key"]), "set-members")
    by_trie = _by_trie(nodes)
    met = members.select("node").union(by_trie.select("node")).union(by_trie.select("rep")).distinct()
    proposed = materialise(met.hint("merge").join(nodes.drop("print"), "node"), "set-proposed")
    stars = by_trie.unionByName(members.filter("node != rep").select("node", "rep")).distinct()
    near = _compared(docs, stars, proposed, width, similarity)
    more = _others(docs, members, near, proposed, width, similarity)
    return near if more is None else near.unionByName(more)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, node, component_id) of every document; component_id is the smallest id of its group."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialise(_signed(given, width), "set-keys")
    nodes = materialise(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("print").alias("print"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "set-nodes")
    return named(signed.select("id", "node"), nodes.select("node", "id"), links(given, nodes, width=width, similarity=similarity), "node")
