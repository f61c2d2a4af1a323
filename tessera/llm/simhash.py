"""SimHash near-duplicates by a binary-trie self-join.

Fingerprint: each bit is set if it is set in over half of the 64-bit hashes of a text's word shingles, repeats included.

Join: the fingerprints form a binary trie, bit by bit from the top. Pairs of nodes are walked together from (root, root):
a pair's children are the pairs of their children, a differing bit adds one to its error, and a pair whose error passes
the budget is cut off with all that lies below. The upper levels are walked by Spark: each fingerprint is sent to the
node pairs (cells) of the first bits in which it takes part, and cells that are still large are walked on through further
bits, round by round, until all are of bounded size; there the rest of the trie is walked over sorted arrays. A cell
returns a spanning forest of its links, never all pairs. Links then form components.

Only distinct fingerprints take part in the join, each with the smallest id of its documents; copies are pre-aggregated.

Edge cases: a text with fewer words than a shingle counts as one shingle of all its words; a text without words, or null,
has fingerprint zero, linked as any other. Null ids are kept in the result but never name a group, unless it has no other.
Repeated rows get the same result. An empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import components

SEED = 42
#: Fingerprints on each side of a cell that are walked in one task; and how the first round picks its bits.
CELL_ROWS = 65_536
NODE_ROWS = 16_384
LEAST_BITS = 4
SMALL_NODES = 64
ROUND_BITS = 6


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of all shingles of the text's words, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    join = b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes; zero of none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[i : i + 65_536])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def stirred(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same things: the k-th remix, 0 the hashes themselves."""
    if not k:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, sketch): the 64-bit fingerprint of each text, 8 bytes."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("sketch", T.BinaryType())])

    def sketch(text: bytes) -> bytes:
        return majority(shingle_hashes(text, width)).to_bytes(8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the trie below a cell


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... count[0] of them, then those of low[1], ..."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def _near(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget below small node pairs, a bounded number at a time."""
    size = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    block = np.cumsum(size) // 2_000_000
    for at in np.unique(block):
        lo_a, hi_a, lo_b, hi_b = nodes[:4, block == at]
        left = _ranges(lo_a, hi_a - lo_a)
        i = np.repeat(left, np.repeat(hi_b - lo_b, hi_a - lo_a))
        j = _ranges(np.repeat(lo_b, hi_a - lo_a), np.repeat(hi_b - lo_b, hi_a - lo_a))
        hit = np.bitwise_count(a[i] ^ b[j]) <= budget
        yield i[hit], j[hit]


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool, bit: int, budget: int, spent: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted 64-bit arrays with at most ``budget`` differing bits; if same, pairs i <= j at least.

    The bits above ``bit`` are equal within a and within b, and ``spent`` of them differ between a and b.
    """
    # rows: the ranges of a and of b below the two nodes, and the bits that differ so far
    nodes = np.array([[0], [len(a)], [0], [len(b)], [spent]], np.int64)
    while nodes.shape[1]:
        small = ((nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= SMALL_NODES) | (bit < 0)
        if small.any():
            yield from _near(a, b, nodes[:, small], budget)
            nodes = nodes[:, ~small]
            if not nodes.shape[1]:
                return
        mask = np.uint64(1 << bit)
        high = ~np.uint64((1 << (bit + 1)) - 1)
        lo_a, hi_a, lo_b, hi_b, cost = nodes
        mid_a = np.searchsorted(a, (a[lo_a] & high) | mask)
        mid_b = np.searchsorted(b, (b[lo_b] & high) | mask)
        children = [np.array(x) for x in ((lo_a, mid_a, lo_b, mid_b, cost), (mid_a, hi_a, mid_b, hi_b, cost), (lo_a, mid_a, mid_b, hi_b, cost + 1))]
        last = np.array((mid_a, hi_a, lo_b, mid_b, cost + 1))
        children.append(last[:, (lo_a != lo_b) | (hi_a != hi_b)] if same else last)
        nodes = np.concatenate(children, axis=1)
        nodes = nodes[:, (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget)]
        bit -= 1


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Join the groups of i[k] and j[k], where parent[x] is the smallest index of x's group; kept: gets a pair for each joining."""
    while len(i):
        p, q = parent[i], parent[j]
        apart = p != q
        if not apart.any():
            break
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        high, low = np.maximum(p, q), np.minimum(p, q)
        np.minimum.at(parent, high, low)
        if kept is not None:
            fits = np.flatnonzero(parent[high] == low)
            one = fits[np.unique(high[fits], return_index=True)[1]]
            kept.append((i[one], j[one]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


# ---------------------------------------------------------------- the trie above the cells


def _masks(bits: int, budget: int) -> Column:
    """All differences of ``bits`` bits within the budget, with their weights."""
    found = [(sum(1 << i for i in at), k) for k in range(min(budget, bits) + 1) for at in combinations(range(bits), k)]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("weight")) for m, k in found])


def _descend(cells: DataFrame, bits: int, budget: int, length: int) -> DataFrame:
    """cells(t, depth, a, b, side, spent, code, node) walked down by ``bits`` of the ``length`` bits that are left."""
    own = F.shiftrightunsigned("code", length - bits).bitwiseAND(F.lit((1 << bits) - 1))
    near = F.filter(_masks(bits, budget), lambda m: m["weight"] + F.col("spent") <= budget)
    wide = cells.withColumn("own", own).withColumn("m", F.explode(near)).withColumn("other", F.col("own").bitwiseXOR(F.col("m")["mask"]))
    same = F.col("a") == F.col("b")
    up = F.lit(1 << bits)
    # below one node, the pair's smaller half is side 0; below two, sides stay as they are
    a = F.when(same, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    b = F.when(same, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(same, F.when(F.col("own") <= F.col("other"), 0).otherwise(1)).otherwise(F.col("side"))
    return wide.select(
        "t", (F.col("depth") + bits).alias("depth"), (F.col("a") * up + a).alias("a"), (F.col("b") * up + b).alias("b"),
        side.alias("side"), (F.col("spent") + F.col("m")["weight"]).alias("spent"), "code", "node",
    )


CELL = ["t", "depth", "a", "b"]


def _rounds(codes: DataFrame, rows: int, budget: int, length: int) -> list[DataFrame]:
    """codes(t, code, node), ``rows`` a table, to cells of bounded size; one DataFrame a round."""
    start = codes.select("t", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), F.lit(0).alias("spent"), "code", "node")
    bits = min(length, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / NODE_ROWS)))))
    cells, depth, done = materialise(_descend(start, bits, budget, length), "trie-cells"), bits, []
    while True:
        large = materialise(cells.groupBy(CELL).count().filter(F.col("count") > 2 * CELL_ROWS).select(CELL), "trie-large")
        if depth >= length or not large.take(1):
            return [*done, cells]
        done.append(cells.join(large, CELL, "left_anti"))
        bits = min(ROUND_BITS, length - depth)
        cells = materialise(_descend(cells.join(large, CELL), bits, budget, length - depth), "trie-cells")
        depth += bits


def _cell_sides(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of both sides, in order of code; and whether there is one side."""
    codes = frame["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes, kind="stable")
    side = frame["side"].to_numpy()[order]
    same = frame["a"].iat[0] == frame["b"].iat[0]
    return (order, order, True) if same else (order[side == 0], order[side == 1], False)


def links(nodes: DataFrame, *, budget: int, as_met: bool = False) -> DataFrame:
    """nodes(node, ...), a row for each fingerprint, to links (u, v): a spanning forest of each cell's links within the budget.

    as_met: each row is a pair within the budget; else each node is linked with the first of its group, which may lie further.
    """
    codes = nodes.select(F.lit(0).alias("t"), F.col("node").alias("code"), "node")
    found = [_local(c, budget, as_met) for c in _rounds(codes, nodes.count(), budget, 64)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _local(cells: DataFrame, budget: int, as_met: bool) -> DataFrame:
    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _cell_sides(frame)
        codes, node = frame["code"].to_numpy().view(np.uint64), frame["node"].to_numpy()
        depth, spent = int(frame["depth"].iat[0]), int(frame["spent"].iat[0])
        parent, kept = np.arange(len(node)), []
        for i, j in close_pairs(codes[left], codes[right], same, 63 - depth, budget, spent):
            i, j = left[i], right[j]
            parent = forest(parent, i[i != j], j[i != j], kept if as_met else None)
        if as_met:
            i, j = (np.concatenate([k[side] for k in kept] or [np.zeros(0, np.int64)]) for side in (0, 1))
            return pd.DataFrame({"u": node[i], "v": node[j]})
        member = np.flatnonzero(parent != np.arange(len(node)))
        return pd.DataFrame({"u": node[member], "v": node[parent[member]]})

    return cells.groupBy(CELL).applyInPandas(linked, "u long, v long")


def named(docs: DataFrame, distinct: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """docs(id, by) with the smallest id of each group, where found(u, v) links the nodes of distinct(node, by, id)."""
    roots = materialise(components(found), "group-roots")
    ids = distinct.select("node", "id")
    members = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    least = materialise(members.join(ids, members["u"] == ids["node"]).groupBy("root").agg(F.min("id").alias("least")), "group-names")
    members = materialise(members.join(least, "root").select(F.col("u").alias("node"), "least"), "group-members")
    classes = distinct.join(members, "node", "left").select(by, F.coalesce("least", "id").alias("component_id"))
    return docs.join(materialise(classes, "group-classes"), by).select("id", by, "component_id")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """(id, sketch, component_id) of every document; component_id is the smallest id of its group."""
    sketched = materialise(sketches(docs, id_col=id_col, text_col=text_col, width=width), "sketches")
    distinct = sketched.groupBy("sketch").agg(F.min("id").alias("id")).withColumn("node", _as_long(F.col("sketch")))
    distinct = materialise(distinct, "sketch-nodes")
    return named(sketched, distinct, links(distinct, budget=budget), "sketch")


def _as_long(sketch: Column) -> Column:
    """The first 8 bytes, little-endian, as a signed long."""
    hexed = F.hex(sketch)
    big = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(big, 16, -10).cast("long")
