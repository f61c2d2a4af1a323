"""The whole file index: what a file is for, how much it matters, and the terms that find it; what an analysis lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, text
from ..operators import flows, graph
from .engine import AUTH_POINTS, Analysis

# What files with these names do, in our own words.
KNOWN_PURPOSES = [
    (r"/ai/provider\.[cm]?[jt]s\z", "chooses the model provider for each command."),
    (r"/ai/(groq|openrouter)\.[cm]?[jt]s\z", "talks to one model provider: requests, retries, streams, errors."),
    (r"/ai/contextbuilder\.[cm]?[jt]s\z", "picks what a model is shown of the repository."),
    (r"/ai/prompts\.[cm]?[jt]s\z", "words the questions that models are asked."),
    (r"/ai/completion\.[cm]?[jt]s\z", "runs completions, streamed or whole."),
    (r"/analyzers/projectmap\.[cm]?[jt]s\z", "runs the whole analysis, from scan to snapshot."),
    (r"/analyzers/filescanner\.[cm]?[jt]s\z", "lists a project's files by the ignore rules."),
    (r"(^|/)types?\.[cm]?[jt]s\z", "declares types that its neighbours share."),
]
FEATURE_CONFIG = r"(^|/)src/(lib|utils)/(config|constants)\.[cm]?[jt]sx?\z"


def purpose(path: Column, scope: Column, features: Column) -> Column:
    """One sentence on a file, or null for documents, tests and files of which nothing is known; features are its features' names."""
    known = F.coalesce(*[F.when(F.lower(path).rlike(p), F.concat(path, F.lit(" " + said))) for p, said in KNOWN_PURPOSES])
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    words = F.array_join(text.split_terms(stem), " ")
    about = F.when(words != "", words).otherwise(F.lower(stem))
    kind = F.when(scope == "unknown", "project").otherwise(scope)
    where = F.when(F.size(features) > 0, F.concat(F.lit(" for "), F.array_join(F.slice(features, 1, 2), " and "))).otherwise("")
    made = F.concat(path, F.lit(" implements "), about, F.lit(" "), kind, F.lit(" responsibilities"), where, F.lit("."))
    silent = scope.isin("docs", "test")
    return F.when(~silent, F.coalesce(known, F.when((scope != "unknown") | (F.size(features) > 0), made)))


def semantic_points(path: Column, names: Column, features: Column) -> Column:
    """Importance that a file's part in authentication, its settings of a feature, or any feature gives it."""
    part = evidence.auth_role(path, names, F.array().cast("array<string>"))
    out = F.when(F.lit(False), 0)
    for name, (_, points) in AUTH_POINTS.items():
        out = out.when(part == name, points)
    return out.when((F.size(features) > 0) & F.lower(path).rlike(FEATURE_CONFIG), 30).when(F.size(features) > 0, 20).otherwise(0)


def feature_names(features: DataFrame) -> DataFrame:
    """(project_id, path, features): names of the features that list a file or take it as evidence, in order."""
    every = features.select("project_id", "name", F.explode(F.array_distinct(F.concat("files", "evidence"))).alias("path"))
    return every.groupBy("project_id", "path").agg(F.array_sort(F.collect_set("name")).alias("features"))


def full(found: Analysis, features: DataFrame) -> DataFrame:
    """found.file_index with features, importance, purpose and search terms of scope and features besides the names."""
    both = ["project_id", "path"]
    named = found.analyses.select(*both, F.col("top_functions.name").alias("functions"))
    entries = found.entry_points.select(*both, F.lit(True).alias("is_entry"))
    critical = found.critical_files.select(*both, F.col("score").alias("critical"))
    every = found.file_index.drop("search_terms").join(named, both).join(feature_names(features), both, "left").join(entries, both, "left").join(critical, both, "left")
    none = F.array().cast("array<string>")
    every = every.withColumn("features", F.coalesce("features", none)).withColumn("critical", F.coalesce("critical", F.lit(0)))
    names = F.concat("exports", "functions")
    semantic = F.when(F.col("scope").isin("test", "docs"), 0).otherwise(semantic_points(F.col("path"), names, F.col("features")))
    points = flows.importance(F.col("refs"), F.col("critical"), F.size("features"), F.coalesce("is_entry", F.lit(False)), F.col("path"), semantic)
    terms = text.search_terms(
        F.col("path"), F.when(F.col("scope") != "unknown", F.col("scope")).otherwise(""), F.array_join("exports", " "), F.array_join("functions", " "), F.array_join("features", " ")
    )
    more = {"importance": points.cast("int"), "purpose": purpose(F.col("path"), F.col("scope"), F.col("features")), "search_terms": terms}
    return every.withColumns(more).drop("functions", "is_entry", "critical")


def warnings(files: DataFrame, found: Analysis, features: DataFrame) -> DataFrame:
    """(project_id, warnings): what the analysis of each project did not find."""
    projects = files.groupBy("project_id").agg(F.bool_or((F.col("path") == "package.json") & F.try_parse_json("content").isNull()).alias("broken"))
    for name, some in (("entries", found.entry_points), ("critical", found.critical_files), ("features", features)):
        projects = projects.join(some.select("project_id").distinct().withColumn(name, F.lit(True)), "project_id", "left")
    said = [
        F.when(F.col("entries").isNull(), "No entry points detected. The project structure may not be fully recognized."),
        F.when(F.col("critical").isNull(), "No critical files detected. Dependency analysis may be incomplete."),
        F.when(F.col("features").isNull(), "No features detected. Feature-based navigation may be unavailable."),
        F.when(F.col("broken"), "package.json could not be parsed. Dependency-based detection may be incomplete."),
    ]
    return projects.select("project_id", F.array_compact(F.array(*said)).alias("warnings"))


def change_impact(found: Analysis, features: DataFrame, told: DataFrame) -> DataFrame:
    """graph.change_impact over features and told flows(project_id, name, steps of label and file)."""
    start = F.when(F.col("entry_point").isNotNull(), F.array("entry_point")).otherwise(F.array().cast("array<string>"))
    members = features.select("project_id", F.explode(F.array_union("files", start)).alias("path"), "name")
    steps = told.select("project_id", F.explode("steps.file").alias("path"), "name").filter("path IS NOT NULL")
    return graph.change_impact(found.edges, members.unionByName(steps))
