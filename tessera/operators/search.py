"""Retrieval: keyword scores, set similarity, signals, vocabularies, score sharing and line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_score(fields: list[tuple[Column, int]], words: list[str]) -> Column:
    """The sum over words and fields of a field's weight where it holds the word."""
    score = F.lit(0)
    for field, weight in fields:
        for word in words:
            score = score + F.when(F.contains(field, F.lit(word)), weight).otherwise(0)
    return score


def confidence(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def set_similarity(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, terms), (right_id, terms) of distinct terms to pairs with a Jaccard similarity of at least ``least``.

    Terms are ordered the longest first, as long terms are mostly rare. Of n terms two similar sets share at least
    least * n, so both hold one of the other's among the first n - ceil(least * n) + 1: only these are joined, sets whose
    sizes alone rule a pair out are left, and whole sets are compared for the pairs that remain.
    """

    def first(df: DataFrame, id_col: str, size: str) -> DataFrame:
        n = F.size("terms")
        ordered = F.array_sort(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
        head = F.slice(ordered, F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
        return df.filter(n > 0).select(id_col, n.alias(size), F.explode(head).alias("x")).select(id_col, size, F.col("x.t").alias("term"))

    fits = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)
    pairs = first(left, "left_id", "n").join(first(right, "right_id", "m"), "term").filter(fits).select("left_id", "right_id").distinct()
    whole = pairs.join(left.select("left_id", F.col("terms").alias("a")), "left_id").join(right.select("right_id", F.col("terms").alias("b")), "right_id")
    both = F.size(F.array_intersect("a", "b"))
    similarity = both / (F.size("a") + F.size("b") - both)
    return whole.select("left_id", "right_id", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def signals(rows: DataFrame, key: str, value: Column, table: list[tuple[str, str, int]], high: int) -> DataFrame:
    """Rows whose value a signal's pattern finds, counted by key and signal; table: (name, pattern, least matches).

    The patterns are literals, so each is compiled once a task; a row is exploded to the signals it shows only.
    """
    shown = F.array_compact(F.array(*[F.when(value.rlike(pattern), F.lit(name)) for name, pattern, _ in table]))
    counted = rows.select(key, F.explode(shown).alias("name")).groupBy(key, "name").agg(F.count("*").alias("hits"))
    least = F.create_map(*[F.lit(x) for name, _, n in table for x in (name, n)])
    graded = F.when(F.col("hits") >= high, "high").otherwise("medium")
    return counted.filter(F.col("hits") >= least[F.col("name")]).select(key, "name", "hits", graded.alias("confidence"))


def vocabulary(named: DataFrame, names: dict[str, str]) -> DataFrame:
    """(project_id, name) to the ordered distinct entries that the names stand for."""
    entry = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("name")]
    known = named.select("project_id", entry.alias("entry")).filter("entry IS NOT NULL").distinct()
    return known.groupBy("project_id").agg(F.array_sort(F.collect_set("entry")).alias("names"))


def hand_on(scored: DataFrame, edges: DataFrame, share: int, least: int = 25) -> DataFrame:
    """(src, score) over edges(src, dst) to (dst, score): the best share of a neighbour's score, ``least`` at least."""
    part = F.greatest(F.lit(least), F.floor(F.col("score") / share))
    return edges.join(scored, "src").groupBy("dst").agg(F.max(part).cast("long").alias("score"))


def window(text: Column, words: list[str], size: int) -> tuple[Column, Column]:
    """First and last line (from 1) of a window around the first line that holds a word; null without one."""
    lines = F.split(text, "\n", -1)
    hits = F.transform(lines, lambda line: keyword_score([(F.lower(line), 1)], words) > 0)
    hit, n = F.array_position(hits, True).cast("int"), F.size(lines)
    first = F.when(hit > 0, F.greatest(F.lit(1), F.least(hit - size // 2, n - size + 1)))
    return first, F.least(n, first + size - 1)
