"""Features, services and behaviours that paths, imports, contents and routes show."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import vocabulary as V
from .detectors import manifests


def _term_pattern(terms: list[str]) -> str:
    """Short terms stand between delimiters, long ones anywhere."""
    short = "|".join(re.escape(t) for t in terms if len(t) <= 7)
    long = [re.escape(t) for t in terms if len(t) > 7]
    return "|".join([rf"(?:^|[/._-])(?:{short})(?:[/._-]|\z)", *long])


def _uses_ai() -> Column:
    known = F.arrays_overlap("imports", F.array(*map(F.lit, V.AI_IMPORTS)))
    prefixed = F.exists("imports", lambda i: i.rlike("^(" + "|".join(map(re.escape, V.AI_PREFIXES)) + ")"))
    return known | prefixed | F.col("content").rlike("|".join(map(re.escape, V.AI_HOSTS))) | (F.col("role") == "ai-integration")


def shown(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """(project_id, path, ord): each file with the features that its path, imports or contents show."""
    own = files.select("project_id", "path", "content", paths.role(F.col("path")).alias("role"))
    own = own.filter(~F.col("role").isin("test", "documentation", "config") & paths.is_production(F.col("path")))
    seen = own.join(analyses.select("project_id", "path", "imports"), ["project_id", "path"]).withColumn("all", F.lower(F.array_join("imports", "\n")))
    found = []
    for i, (_, _, terms) in enumerate(V.FEATURES):
        hit = _uses_ai() if not terms else F.lower("path").rlike(_term_pattern(terms)) | F.col("all").rlike("|".join(map(re.escape, terms)))
        found.append(F.when(hit, F.lit(i)))
    return seen.select("project_id", "path", F.explode(F.array_compact(F.array(*found))).alias("ord"))


def feature_signals(files: DataFrame, analyses: DataFrame, most: int = 5) -> DataFrame:
    """(project_id, ord, name, files): features with enough of their first ``most`` files by path.

    Each file is exploded only to the features it shows; one literal pattern a feature is compiled once a task.
    """
    each = shown(files, analyses)
    rank = F.row_number().over(Window.partitionBy("project_id", "ord").orderBy("path"))
    kept = each.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("project_id", "ord").agg(F.array_sort(F.collect_list("path")).alias("files"))
    at = F.col("ord") + 1
    enough = kept.filter(F.size("files") >= F.element_at(F.array(*[F.lit(n) for _, n, _ in V.FEATURES]), at))
    return enough.select("project_id", "ord", F.element_at(F.array(*[F.lit(n) for n, _, _ in V.FEATURES]), at).alias("name"), "files")


def services(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """(project_id, services): by exact names of dependencies and imports, and by words in source contents."""
    names = manifests(files.filter(paths.is_production(F.col("path")))).select("project_id", F.explode("names").alias("name"))
    names = names.unionByName(analyses.select("project_id", F.explode("imports").alias("name"))).select("project_id", F.lower("name").alias("name"))
    entry = F.create_map(*[F.lit(x) for pair in V.SERVICES.items() for x in pair])[F.col("name")]
    by_name = names.select("project_id", entry.alias("service")).filter("service IS NOT NULL")
    words = [F.when(F.lower("content").rlike("|".join(map(re.escape, w))), s) for s, w in V.SERVICE_CONTENTS.items()]
    sources = files.filter(paths.is_source(F.col("path")) & paths.is_production(F.col("path")))
    by_word = sources.select("project_id", F.explode(F.array_compact(F.array(*words))).alias("service"))
    return by_name.unionByName(by_word).groupBy("project_id").agg(F.array_sort(F.collect_set("service")).alias("services"))


def behaviours(routes: DataFrame, most: int = 5) -> DataFrame:
    """(project_id, kind, name, evidence, confidence) of what API routes show."""
    shown = F.array_compact(F.array(*[F.when(F.col("route").rlike(p), i) for i, (_, _, p, _, _) in enumerate(V.BEHAVIOURS)]))
    each = routes.filter("kind = 'api'").select("project_id", "route", "file", F.explode(shown).alias("at"))
    sums = each.groupBy("project_id", "at").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("file")), 1, most).alias("evidence"))

    def value(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(b[i]) for b in V.BEHAVIOURS]), F.col("at") + 1)

    graded = F.when(F.col("n") >= value(3), "high").otherwise("medium")
    return sums.filter(F.col("n") >= value(4)).select("project_id", value(0).alias("kind"), value(1).alias("name"), "evidence", graded.alias("confidence"))
