"""Source divergence: how differently the sources of a language use its frequent terms.

Every task counts its documents' terms per (language, source) under a bound on memory, so a hot source or word costs one
row a task. Kept terms are dealt to blocks of about BLOCK terms and numbered there; a group's block is a sorted array of
(term id, p). Sources are dealt to buckets of TILE; a pair task co-groups two buckets' arrays of one block and prices every
unordered pair in it by a galloping intersection, so a task holds 2 * TILE arrays of one block whatever the corpus is.

With a and b the shares of a term that a group does not have, and z = |a - b|, the sum over all V kept terms is
V z + sum over A's terms (|p - b| - z) + sum over B's terms (|a - q| - z) + sum over shared terms (|p - q| - |p - b| - |a - q| + z):
absent terms are priced without being listed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEAST_DOCS = 30
TOP_TERMS = 50
#: Kept terms a block, on average; sources a bucket of a pair task.
BLOCK, TILE = 2048, 8
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD = 300_000
SMOOTHING, SCALE = 5, 1_000_000_000

#: Bytes to term bytes: A-Z lower-cased, other ASCII to spaces; bytes of other code points stay.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term binary, count long, docs long"


def _terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _count_terms(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to each task's counts of occurrences and of documents by (lang, source, term)."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in counts.items():
            n = len(occurrences)
            terms = pa.array(occurrences.keys(), pa.binary())
            by_term = pa.array((documents[t] for t in occurrences), pa.int64(), size=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(occurrences.values(), pa.int64()), by_term],
                ["lang", "source", "term", "count", "docs"],
            )
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = _terms(text.as_py())
            if not words:
                continue
            occurrences, documents = counts[lang, source]
            before = len(occurrences)
            occurrences.update(words)
            documents.update(set(words))
            held += len(occurrences) - before
            if held > most:
                yield from rows()
                held = 0
    yield from rows()


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending short keys, where it lies in the ascending distinct long keys, or -1.

    Every 64th key is placed by binary search; the keys after it gallop from there in doubling steps and then halve the
    last step, so the cost follows the gaps between neighbours instead of the length of long.
    """
    n = len(long)
    start = np.repeat(np.searchsorted(long, short[::64]), 64)[: len(short)]
    reach = np.ones(len(short), np.int64)
    moving = start + reach < n
    while moving.any():
        moving[moving] = long[start[moving] + reach[moving]] < short[moving]
        reach[moving] *= 2
        moving &= start + reach < n
    low, high = start + reach // 2, np.minimum(start + reach, n)
    while (between := low < high).any():
        middle = (low + high) // 2
        right = between.copy()
        right[between] = long[middle[between]] < short[between]
        low, high = np.where(right, middle + 1, low), np.where(between & ~right, middle, high)
    found = low < n
    found[found] = long[low[found]] == short[found]
    return np.where(found, low, -1)


def _price(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], v: int) -> int:
    """The summed difference of two groups' (ids, shares, share of an absent term); v: the kept terms that it adds z for."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, p, absent_a), (others, q, absent_b) = a, b
    z = abs(absent_a - absent_b)
    at = gallop(ids, others)
    both = at >= 0
    met, other = p[both], q[at[both]]
    overlap = np.abs(met - other) - np.abs(met - absent_b) - np.abs(other - absent_a) + z
    one_sided = (np.abs(p - absent_b) - z).sum() + (np.abs(q - absent_a) - z).sum()
    return v * z + int(one_sided) + int(overlap.sum())


def _groups(found: pa.Table) -> list[tuple[int, tuple[np.ndarray, np.ndarray, int]]]:
    """(number of the source, its array) from rows (place, absent, terms: list of (id, p))."""
    out = []
    for place, absent, terms in zip(found["place"].to_pylist(), found["absent"].to_pylist(), found["terms"]):
        pairs = terms.values if terms.is_valid else None
        ids = pairs.field("id").to_numpy() if pairs is not None else np.empty(0, np.int32)
        shares = pairs.field("p").to_numpy().astype(np.int64) if pairs is not None else np.empty(0, np.int64)
        out.append((place, (ids, shares, absent)))
    return out


def _pair_task(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs between two buckets of sources in one block of terms."""
    lang, low, high, _ = (k.as_py() for k in key)
    v = left["v"][0].as_py() if left.num_rows else 0
    rows = []
    others = _groups(right)
    for a, mine in _groups(left):
        rows += [(lang, a, b, _price(mine, theirs, v)) for b, theirs in others if low != high or a < b]
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.table(
        {"lang": pa.array(columns[0], pa.string())} | {n: pa.array(c, t) for n, c, t in zip(("a", "b", "value"), columns[1:], (pa.int32(), pa.int32(), pa.int64()))}
    )


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (n + 5 v)), exact for any long counts."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(19,0)")
    below = (n + SMOOTHING * v).cast("decimal(19,0)")
    return F.when(v > 0, F.call_function("div", whole, below) + 1).otherwise(0).cast("long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents (lang, source, text); see the module.

    Null lang, source and text count as empty; empty texts give their group no terms; repeated rows count each time; other
    columns are not looked at. A language without kept terms (few documents, no letters) has pairs of value 0 and no term
    rows. A group alone in its language has no pairs. Ties go to the item that comes first in UTF-8 order. An empty table
    gives no rows. Texts may be of any length: a task holds one text and the given number of counts.
    """
    empty = F.lit("")
    named = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    # one shuffle: the aggregation by source and the window over sources both fit a partitioning by (lang, term)
    partial = named.mapInArrow(lambda batches: _count_terms(batches, held), _COUNTS).repartition("lang", "term")
    counted = partial.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    counted = counted.select("*", F.sum("docs").over(by_term).alias("lang_docs"), F.sum("count").over(by_term).alias("lang_count"))
    kept = materialise(counted.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count"), "divergence-kept")

    terms = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("lang_count"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    of_lang = Window.partitionBy("lang")
    groups = (
        named.groupBy("lang", "source")
        .agg(F.count("*").alias("documents"))
        .join(langs, "lang", "left")
        .join(sizes, ["lang", "source"], "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_n", "n")])
        .withColumn("place", F.row_number().over(of_lang.orderBy("source")) - 1)
        .withColumn("buckets", F.expr(f"int((count(*) OVER (PARTITION BY lang) - 1) div {tile} + 1)"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int"))
        .withColumn("absent", share(zero, F.col("n"), F.col("v")))
    )
    groups = materialise(groups, "divergence-groups")

    priced = kept.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "place",
        "term",
        share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
    )
    item = F.col("term").cast("string").alias("item")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), item, (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    numbered = priced.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")))
    arrays = numbered.groupBy("lang", "place", "block").agg(F.array_sort(F.collect_list(F.struct("id", F.col("p").cast("int").alias("p")))).alias("terms"))
    # every group takes part in every block, with no array where it has no term there
    cells = groups.select("lang", "place", "buckets", "absent", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = cells.join(arrays, ["lang", "place", "block"], "left").withColumn("bucket", F.floor(F.col("place") / tile).cast("int"))
    cells = cells.select("lang", "place", "buckets", "block", "bucket", "absent", "terms", F.when(F.col("block") == 0, F.col("v")).otherwise(0).alias("v"))
    key = ["lang", "low", "high", "block"]
    columns = ["place", "absent", "terms", "v"]
    # both sides come from the same rows: aliases tell their columns apart
    ranges = (F.col("bucket"), F.col("buckets") - 1), (F.lit(0), F.col("bucket"))
    lower, upper = (
        cells.select("bucket", F.explode(F.sequence(*span)).alias("other"), *[F.col(c).alias(c) for c in ("lang", "block", *columns)]) for span in ranges
    )
    lower = lower.withColumnsRenamed({"bucket": "low", "other": "high"})
    upper = upper.select(F.col("bucket").alias("high"), F.col("other").alias("low"), *[F.col(c).alias(c) for c in ("lang", "block", *columns)])
    pairs = lower.groupBy(*key).cogroup(upper.groupBy(*key)).applyInArrow(_pair_task, "lang string, a int, b int, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    name = groups.select("lang", F.col("place").alias("a"), "source")
    other = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    ranked = both.select("lang", "x.a", "x.b", "value").join(name, ["lang", "a"]).join(other, ["lang", "b"])
    ranked = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked.unionByName(over)
