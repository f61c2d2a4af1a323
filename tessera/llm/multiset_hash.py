"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is a multiset of paragraphs (its lines). Every paragraph is hashed to a wide vector, and the fingerprint is the
sum of these vectors, each component modulo a power of two. The sum does not depend on the paragraphs' order, and
``insert`` and ``delete`` change a fingerprint by a text's paragraphs without the rest of the document.

Components of the vector:

* 4 equality components of 62 bits: XXH64 of the whole paragraph under four seeds, modulo 2**62; and the number of
  paragraphs, modulo 2**62.
* 126 likeness components modulo 2**20, three to a 64-bit integer: each piece of a paragraph adds the bits of two XXH64
  values; and the number of pieces, modulo 2**62. Pieces are the pairs of neighbouring words whose own hash is divisible
  by four, and the last word of a paragraph. Which pairs these are follows from the words alone, in any script, so a word
  put in or taken out changes half a pair on average. A bit b
  stands for the sign 2b - 1, so differences of two fingerprints are sums of random signs, whose mean square estimates
  the squared norm of the difference of the two multisets of pieces. ``likeness`` is 1 less that norm over the sum of
  the two texts' own norms: 1 for equal fingerprints, near 0 for texts with nothing in common, within about 0.1. It is
  meaningful below 2**19 pieces a text; equality has no such bound.

Edge cases: a null text counts as the empty text, which is one empty paragraph and no piece; text without spaces has one
piece a paragraph; two fingerprints without
pieces are alike only if equal. Texts of any length are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 4
SLOTS = 21
LONGS = 2 * SLOTS
ONES = 1 | 1 << 21 | 1 << 42
LANE = (1 << 20) - 1
LANES = LANE | LANE << 21 | LANE << 42
WIDE = (1 << 62) - 1
#: A word of a paragraph; one pair of words in so many is a piece.
IN_LINE = r"[^ \t\x0B\f\r]++"
ONE_IN = 4


def _pieces(words: Column) -> Column:
    """Hashes of the pieces among a paragraph's words."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.xxhash64(a, b))
    kept = F.filter(pairs, lambda h: h.bitwiseAND(F.lit(ONE_IN - 1)) == 0)
    return F.when(F.size(words) > 0, F.concat(kept, F.array(F.xxhash64(F.try_element_at(words, F.lit(-1)))))).otherwise(kept)


def fingerprint(text: Column) -> Column:
    """struct<paragraphs long, e array<long>, pieces long, l array<long>> of a string column."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    long = F.lit(0).cast("long")

    def whole(acc: Column, x: Column) -> Column:
        return F.struct(*[((acc[f"e{i}"] + F.shiftrightunsigned(F.xxhash64(F.lit(i), x), 2)).bitwiseAND(F.lit(WIDE))).alias(f"e{i}") for i in range(SEEDS)])

    equality = F.aggregate(lines, F.struct(*[long.alias(f"e{i}") for i in range(SEEDS)]), whole, lambda acc: F.array(*[acc[f"e{i}"] for i in range(SEEDS)]))
    words = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(IN_LINE), 0))
    # hashed again, since the low bits of those that are kept are all alike
    hashes = F.transform(F.flatten(F.transform(words, _pieces)), lambda h: F.xxhash64(h))

    def bits(acc: Column, h: Column) -> Column:
        other = F.xxhash64(h)
        from_both = [(j, h if j < SLOTS else other) for j in range(LONGS)]
        return F.struct(
            *[((acc[f"l{j}"] + F.shiftrightunsigned(x, j % SLOTS).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LANES))).alias(f"l{j}") for j, x in from_both],
            (acc["n"] + 1).alias("n"),
        )

    lanes = F.aggregate(
        hashes,
        F.struct(*[long.alias(f"l{j}") for j in range(LONGS)], long.alias("n")),
        bits,
        lambda acc: F.struct(acc["n"].alias("pieces"), F.array(*[acc[f"l{j}"] for j in range(LONGS)]).alias("l")),
    )
    return F.struct(F.size(lines).cast("long").alias("paragraphs"), equality.alias("e"), lanes.alias("lanes"))


def _combine(a: Column, b: Column, sign: int) -> Column:
    def at(x: Column, y: Column, mask: int, borrow: int) -> Column:
        return ((x + y if sign > 0 else x + F.lit(borrow) - y)).bitwiseAND(F.lit(mask))

    guard = 1 << 20 | 1 << 41 | 1 << 62
    return F.struct(
        at(a["paragraphs"], b["paragraphs"], WIDE, 1 << 62).alias("paragraphs"),
        F.zip_with(a["e"], b["e"], lambda x, y: at(x, y, WIDE, 1 << 62)).alias("e"),
        F.struct(
            at(a["lanes"]["pieces"], b["lanes"]["pieces"], WIDE, 1 << 62).alias("pieces"),
            F.zip_with(a["lanes"]["l"], b["lanes"]["l"], lambda x, y: at(x, y, LANES, guard)).alias("l"),
        ).alias("lanes"),
    )


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs and b's together."""
    return _combine(a, b, 1)


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which must be among them."""
    return _combine(a, b, -1)


def as_text(fp: Column) -> Column:
    """All components, 16 hexadecimal digits each."""
    parts = F.concat(F.array(fp["paragraphs"]), fp["e"], F.array(fp["lanes"]["pieces"]), fp["lanes"]["l"])
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; null if a or b is null."""
    n, m = a["lanes"]["pieces"], b["lanes"]["pieces"]

    def field(x: Column, k: int) -> Column:
        return F.shiftrightunsigned(x, 21 * k).bitwiseAND(F.lit(LANE))

    def square(x: Column) -> Column:
        return (x * x).cast("double")

    def apart(x: Column, y: Column) -> Column:
        parts = []
        for k in range(3):
            d = (field(x, k) - field(y, k)).bitwiseAND(F.lit(LANE))
            parts.append(square(2 * F.when(d > LANE // 2, d - (LANE + 1)).otherwise(d) - (n - m)))
        return parts[0] + parts[1] + parts[2]

    def own(x: Column, count: Column) -> Column:
        return square(2 * field(x, 0) - count) + square(2 * field(x, 1) - count) + square(2 * field(x, 2) - count)

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    far = total(F.zip_with(a["lanes"]["l"], b["lanes"]["l"], apart))
    norms = total(F.transform(a["lanes"]["l"], lambda x: own(x, n))) + total(F.transform(b["lanes"]["l"], lambda x: own(x, m)))
    same = (a["paragraphs"] == b["paragraphs"]) & (a["e"] == b["e"])
    return F.when(same, 1.0).when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - far / norms))).when(norms.isNotNull(), 0.0)


#: Rows to an id range; each range is sorted by one task.
RANGE_ROWS = 20_000


def with_next(df: DataFrame, id_col: str, text_col: str, added: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the added columns and ``next``: a struct of text and added columns of the row that follows by descending id;
    after the last, the first.

    Ids are cut into ranges at quantiles, so that no task orders the whole table; each range is ordered by a window, and
    its last row takes the head of the next range that has rows from a table with one row a range, of which only the
    ids are broadcast. The added columns are computed before the one shuffle. Null ids come last; rows of one id follow
    by text.
    """
    n = df.count()
    cuts = max(1, n // range_rows)
    splits: list[int] = []
    if cuts > 1:
        at = [i / cuts for i in range(1, cuts)]
        splits = sorted(set(df.agg(F.percentile_approx(id_col, at, max(10_000, 20 * cuts))).first()[0] or []))
    if splits:
        wide = max(1, int(len(splits) ** 0.5))
        coarse, fine = F.array(*map(F.lit, splits[::wide])), F.array(*map(F.lit, splits))
        block = F.size(F.filter(coarse, lambda x: x <= F.col(id_col))) - 1
        within = F.filter(F.slice(fine, F.greatest(block, F.lit(0)) * wide + 1, F.lit(wide)), lambda x: x <= F.col(id_col))
        bucket = F.when(F.col(id_col).isNull(), -1).when(block < 0, 0).otherwise(block * wide + F.size(within))
    else:
        bucket = F.when(F.col(id_col).isNull(), -1).otherwise(0)
    carried = [text_col, *added]
    cut = df.withColumn("__range", bucket.cast("int"))
    falling = Window.partitionBy("__range").orderBy(F.col(id_col).desc_nulls_last(), F.col(text_col))
    here = cut.withColumns(added).withColumn("__next", F.lead(F.struct(*carried)).over(falling))

    # heads: one row a range, found by id first so that texts of other rows are not gathered
    ids = cut.groupBy("__range").agg(F.max(id_col).alias("__head"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("__range").desc())
    first = F.first("__head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = ids.select(
        "__range",
        F.when(F.lead("__range").over(whole).isNull(), F.struct(first.alias("id"))).otherwise(F.struct(F.lead("__head").over(whole).alias("id"))).alias("__follow"),
    )
    wanted = follow.select(F.col("__follow")["id"].alias("__head")).distinct()
    heads = (
        df.join(F.broadcast(wanted), df[id_col].eqNullSafe(wanted["__head"]), "left_semi")
        .withColumns(added)
        .groupBy(F.col(id_col).alias("__head"))
        .agg(F.min_by(F.struct(*carried), text_col).alias("__first"))
    )
    edges = follow.join(heads, F.col("__follow")["id"].eqNullSafe(F.col("__head"))).select(F.col("__range").alias("__edge"), "__first")
    out = here.join(edges, here["__range"] == edges["__edge"], "left")
    return out.select(*df.columns, *added, F.coalesce("__next", "__first").alias("next"))
