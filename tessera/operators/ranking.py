"""Scores, grades, ordered unions, fingerprints and changes over tables keyed by project_id and path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def additive(start: Column, rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """A score and its reasons in rule order: each rule that holds adds its points."""
    score = start
    for holds, points, _ in rules:
        score = score + F.when(holds, points).otherwise(0)
    return score, F.array_compact(F.array(*[F.when(holds, reason) for holds, _, reason in rules]))


def top_per_project(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each project, with their rank; Spark cuts each task's rows before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most)


def dominant(a: Column, b: Column, first: str, second: str) -> Column:
    """Which of two counts prevails: the only one, or one of at least twice the other; both zero is the first."""
    return F.when(b == 0, first).when(a == 0, second).when(a >= 2 * b, first).when(b >= 2 * a, second).otherwise("mixed")


def grade(strong: Column, all_evidence: Column) -> Column:
    return F.when(strong >= 2, "high").when((strong == 1) | (all_evidence >= 2), "medium").otherwise("low")


def ordered_union(buckets: list[DataFrame], most: int) -> DataFrame:
    """buckets of (path, ord), earlier buckets first, to (path, place): each path where it is first seen."""
    every = buckets[0].withColumn("bucket", F.lit(0))
    for i, more in enumerate(buckets[1:], 1):
        every = every.unionByName(more.withColumn("bucket", F.lit(i)))
    first = every.groupBy("path").agg(F.min(F.struct("bucket", "ord", "path")).alias("at")).orderBy("at").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("path", "place")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(project_id, path, hash) to one digest a project over its path:hash lines in order of path.

    One shuffle by project with a sort inside partitions; lines are digested as they stream by, so a project of any size
    needs the memory of one batch.
    """

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, files, md5 = None, 0, hashlib.md5()
        for frame in frames:
            done = []
            for project, path, hashed in zip(frame["project_id"], frame["path"], frame["hash"], strict=True):
                if files and project != at:
                    done.append((at, files, md5.hexdigest()))
                    files, md5 = 0, hashlib.md5()
                md5.update(("\n" if files else "").encode() + f"{path}:{hashed}".encode())
                at, files = project, files + 1
            yield pd.DataFrame(done, columns=["project_id", "files", "fingerprint"])
        if files:
            yield pd.DataFrame([(at, files, md5.hexdigest())], columns=["project_id", "files", "fingerprint"])

    ordered = rows.select("project_id", "path", "hash").repartition("project_id").sortWithinPartitions("project_id", "path")
    return ordered.mapInPandas(digest, "project_id string, files long, fingerprint string")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, path, hash) twice to (project_id, path, change): added, removed or changed."""
    old = before.select("project_id", "path", F.col("hash").alias("old"))
    both = old.join(after.select("project_id", "path", F.col("hash").alias("new")), ["project_id", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("project_id", "path", change.alias("change"))
