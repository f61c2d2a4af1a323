"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources take the weights 1, 2, 3, 1, ... in code-point order (null last) and share the sum of all sizes by
weight; a target stops at ``ceiling`` times its source's size and the excess is shared again by weight among the rest,
until no target is above its stop. The level of that sharing has a closed form once the sources are ordered by
stop / weight.

Copies: a source whose target is r times its size takes every document floor(r) times for certain. What is left of the
target is filled with documents in ascending order of random odds over inclusion odds, q = (u / (1 - u)) / (p / (1 - p)),
with p = r - floor(r) and u a uniform number hashed from seed, id and text, so that reruns agree. The sample's size is
fixed in words: documents enter in that order, and one that would pass the rest of the target is passed over, until the
gap is at most ``NEAR`` of the target or no document fits; at last the one document left over whose size is nearest to the
remaining gap enters, if that brings the source nearer to its target. No document of a source has a better claim than
another, so p differs between sources and is the same within one.

Scale: no source is ranked in one task. q is cut into bins, words are summed by (source, bin) with map-side
aggregation, and only the one bin in which a source's next document does not fit (one in ``BINS`` of its documents) is
ordered by a window. All sources take such a step together; the next one sees the documents behind that fit into what is
left, which is less than the document just passed over. Steps write a row a source and read ids and sizes only. Tables of
sources are the only ones that are broadcast, after their row count has been checked.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a null id takes part in the
hash as ``~``; repeated rows are documents of their own; sources of size 0 have target 0; an empty table gives an empty
result; other columns of the input are ignored unless they are carried, and working columns carry a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

BINS = 4096
#: Share of a target that may stay open.
NEAR = 0.001
MAX_SOURCES = 100_000
P = "__mix_"


def c(name: str) -> Column:
    return F.col(P + name)


def uniform(seed: int, id_col: str, text_col: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    key = F.concat(
        F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))
    )
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """A row for each source key: source_size, target, whole copies, inclusion probability and words left to fill."""
    sources = sized.groupBy(P + "key").agg(F.first(P + "source").alias(P + "source"), F.sum(P + "size").alias(P + "source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(c("source").isNull(), c("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn(P + "weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    sources = sources.withColumn(P + "stop", ceiling * c("source_size").cast("double"))
    rising = everything.orderBy(c("stop") / c("weight"), P + "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(c("source_size").cast("double")).over(everything)
    level = (total - F.coalesce(F.sum(c("stop")).over(before), F.lit(0.0))) / F.sum(c("weight")).over(onward)
    sources = sources.withColumn(P + "level", level)
    # the first level that its own source can take is the one for all sources from there on; those before stand at their stops
    fits = F.when(c("level") * c("weight") <= c("stop"), F.struct(c("stop") / c("weight"), P + "key", P + "level"))
    sources = sources.withColumn(P + "level", F.min(fits).over(everything)[P + "level"])
    target = F.when(c("level").isNull(), c("stop")).otherwise(F.least(c("stop"), c("level") * c("weight")))
    ratio = F.when(c("source_size") > 0, c("target") / c("source_size")).otherwise(0.0)
    return (
        sources.withColumn(P + "target", target)
        .withColumn(P + "whole", F.floor(ratio))
        .withColumn(P + "p", ratio - F.floor(ratio))
        .withColumn(P + "budget", c("target") - c("whole") * c("source_size"))
        .select(*[P + x for x in ("key", "source_size", "target", "whole", "p", "budget")])
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    ceiling: int = 3,
    seed: int = 20,
    carry: list[str] | None = None,
) -> DataFrame:
    """The documents with size, source_size, target, copies and taken = size * copies.

    carry: the columns that are carried through, id and source if None; they must not have the names of results.
    """
    carried = [id_col, source_col] if carry is None else carry
    sized = docs.select(
        *[F.col(f"`{x}`") for x in carried],
        word_count(F.col(text_col)).alias(P + "size"),
        uniform(seed, id_col, text_col).alias(P + "u"),
        F.col(source_col).alias(P + "source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias(P + "key"),
        F.col(id_col).alias(P + "id"),
        F.monotonically_increasing_id().alias(P + "row"),
    )
    sized = materialise(sized, "mix-sized")
    sources = materialise(source_targets(sized, weights, ceiling), "mix-sources")
    if (n := sources.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; the table of sources is broadcast and may have {MAX_SOURCES} rows at most")

    odds = (c("u") / (1 - c("u"))) * ((1 - c("p")) / c("p"))
    ranked = sized.join(F.broadcast(sources), P + "key").withColumn(P + "q", F.when(c("p") > 0, odds))
    ranked = ranked.withColumn(P + "v", F.when(c("p") > 0, c("q") / (1 + c("q"))).otherwise(1.0)).drop(P + "q")
    ranked = ranked.withColumn(P + "at", F.struct(*[c(x).alias(x) for x in ("v", "id", "size", "row")]))
    taken = _steps(ranked.filter(c("p") > 0), sources.filter(c("p") > 0))
    ranked = ranked.join(F.broadcast(taken), P + "key", "left")
    here = F.exists(P + "steps", lambda x: (c("size") <= x["gap"]) & (x["begin"].isNull() | (c("at") > x["begin"])) & (c("at") < x["stop"]))
    ranked = ranked.withColumn(P + "in", (c("p") > 0) & ((c("size") == 0) | F.coalesce(here, F.lit(False))))

    left = ranked.filter(~c("in") & (c("p") > 0))
    last = (
        left.filter(F.abs(c("size") - c("left")) < c("left"))
        .groupBy(P + "key")
        .agg(F.min(F.struct(F.abs(c("size") - c("left")), P + "v", P + "id", P + "size", P + "row")).alias(P + "last"))
        .select(P + "key", c("last")[P + "row"].alias(P + "last"))
    )
    out = ranked.join(F.broadcast(materialise(last, "mix-last")), P + "key", "left")
    copies = c("whole") + F.when(c("in") | F.coalesce(c("row") == c("last"), F.lit(False)), 1).otherwise(0)
    return out.select(
        *[F.col(f"`{x}`") for x in carried],
        c("size").alias("size"),
        c("source_size").alias("source_size"),
        c("target").alias("target"),
        copies.cast("long").alias("copies"),
        (c("size") * copies).cast("long").alias("taken"),
    )


def _steps(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, left, steps): of each source, in steps, the stretch of its order in which what is at most ``gap`` large is
    taken, and the words left at the end."""
    narrow = ranked.select(*[P + x for x in ("key", "at", "size")], F.least(F.floor(c("v") * BINS), F.lit(BINS - 1)).cast("int").alias(P + "bin"))
    at = narrow.schema[P + "at"].dataType.simpleString()
    border = lambda v: F.struct(v.alias("v"), F.lit(None).alias("id"), F.lit(None).alias("size"), F.lit(None).alias("row")).cast(at)
    state = sources.select(P + "key", c("budget").alias(P + "gap"), (NEAR * c("target")).alias(P + "near"), F.lit(None).cast(at).alias(P + "begin"))
    found: DataFrame | None = None
    while True:
        fits = (c("size") > 0) & (c("size") <= c("gap")) & (c("begin").isNull() | (c("at") > c("begin")))
        some = narrow.join(F.broadcast(state), P + "key").filter(fits)
        bins = some.groupBy(P + "key", P + "bin").agg(F.sum(P + "size").alias(P + "words"), F.first(P + "gap").alias(P + "gap"), F.first(P + "near").alias(P + "near"))
        bins = bins.withColumn(P + "after", F.sum(P + "words").over(Window.partitionBy(P + "key").orderBy(P + "bin")))
        full = F.when(c("after") > c("gap") - c("near"), F.struct(P + "bin", (c("after") - c("words")).alias(P + "start"), P + "after"))
        edges = bins.groupBy(P + "key").agg(F.min(full).alias(P + "edge"), F.max(P + "after").alias(P + "all"))
        edges = materialise(edges, "mix-edges")
        own = edges.filter(c("edge").isNotNull()).select(P + "key", c("edge")[P + "bin"].alias(P + "bin"), c("edge")[P + "start"].alias(P + "start"))
        in_order = Window.partitionBy(P + "key").orderBy(P + "at").rowsBetween(Window.unboundedPreceding, 0)
        inside = some.join(F.broadcast(own), [P + "key", P + "bin"]).withColumn(P + "after", c("start") + F.sum(P + "size").over(in_order))
        before = c("after") - c("size")
        stops = inside.filter((c("after") > c("gap")) | (c("gap") - before <= c("near"))).groupBy(P + "key").agg(F.min(F.struct(P + "at", before.alias(P + "before"))).alias(P + "stop"))
        ended = state.join(edges, P + "key", "left").join(stops, P + "key", "left")
        # without a stop the edge bin, or everything, is taken
        beyond = F.when(c("edge").isNull() | (c("edge")[P + "bin"] == BINS - 1), 2.0).otherwise((c("edge")[P + "bin"] + 1) / float(BINS))
        words = F.coalesce(c("stop")[P + "before"], c("edge")[P + "after"], P + "all", F.lit(0))
        step = materialise(
            ended.select(
                P + "key", P + "near", P + "gap", P + "begin", F.coalesce(c("stop")[P + "at"], border(beyond)).alias(P + "stop"),
                (c("gap") - words).alias(P + "left"), c("stop").isNotNull().alias(P + "open"),
            ),
            "mix-steps",
        )
        found = step if found is None else found.unionByName(step)
        state = step.filter(c("open") & (c("left") > c("near"))).select(P + "key", c("left").alias(P + "gap"), P + "near", c("stop").alias(P + "begin"))
        if not state.take(1):
            held = F.struct(c("gap").alias("gap"), c("begin").alias("begin"), c("stop").alias("stop"))
            return materialise(found.groupBy(P + "key").agg(F.min(P + "left").alias(P + "left"), F.collect_list(held).alias(P + "steps")), "mix-taken")
