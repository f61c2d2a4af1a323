"""Where to begin in a project and in each of its features: ranked files, and the documents that say so.

All ranks are windows over joined tables; each is cut to a few rows a project or feature in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..operators.ranking import top_per_project
from .engine import Analysis

STARTS, CRITICAL, PRIORITY = 8, 5, 8
BOTH = ["project_id", "path"]
UNICODE = "path COLLATE UNICODE"


def feature_id(name: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(dashed == "", "feature").otherwise(dashed)


def flow_files(told: DataFrame) -> DataFrame:
    """told(project_id, name, entry_point, steps of label and file) to (project_id, name, path), each file once a flow."""
    files = F.array_distinct(F.array_compact(F.concat(F.array("entry_point"), F.col("steps")["file"])))
    return told.select("project_id", "name", F.explode(files).alias("path")).distinct()


def start_scores(entry_points: DataFrame, distance: DataFrame, index: DataFrame, features: DataFrame, flowing: DataFrame, critical: DataFrame) -> DataFrame:
    """(project_id, path, score) of all files that a reader may start from: entry points, files of features and flows, critical ones.

    index(project_id, path, scope, features, importance); flowing(project_id, name, path). Documents and tests drop out.
    """
    starts = F.array_distinct(F.array_compact(F.concat(F.array("entry_point"), "entry_points")))
    led = features.select("project_id", "name", F.explode(starts).alias("path"))
    shown = features.filter("name <> 'Documentation'").select("project_id", F.explode(F.concat(starts, "files")).alias("path"))
    candidates = shown
    for more in (entry_points, flowing, critical):
        candidates = candidates.unionByName(more.select(*BOTH))
    flows = flowing.groupBy(*BOTH).agg(F.count("*").alias("flows"))
    leads = led.groupBy(*BOTH).agg(F.count("*").alias("leads"))
    rows = candidates.distinct().join(index.filter(~F.col("scope").isin("docs", "test")), BOTH)
    for more in (entry_points.select(*BOTH, F.col("rank").alias("entry")), distance, flows, leads):
        rows = rows.join(more, BOTH, "left")
    entry = F.coalesce(F.lit(1_000_000) - (F.col("entry") - 1) * 10_000, F.lit(0))
    near = F.coalesce(F.greatest(F.lit(0), 200 - 60 * F.col("distance")), F.lit(0))
    score = entry + F.when(F.col("scope") == "cli", 500).otherwise(0) + F.when(F.col("path").rlike("(^|/)commands?/"), 300).otherwise(0) + near
    score = score + 120 * F.coalesce("flows", F.lit(0)) + 100 * F.coalesce("leads", F.lit(0)) + 40 * F.size("features") + F.coalesce("importance", F.lit(0))
    return rows.select(*BOTH, score.cast("long").alias("score"))


def start_here(scores: DataFrame, most: int = STARTS) -> DataFrame:
    """(project_id, path, score, place): the files to read first."""
    return top_per_project(scores, most, F.desc("score"), F.expr(UNICODE), "path").withColumnRenamed("rank", "place")


def _top_of_feature(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("project_id", "name").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("project_id", "name", "path", "place")


def critical_of_features(members: DataFrame, critical: DataFrame, index: DataFrame, most: int = CRITICAL) -> DataFrame:
    """members(project_id, name, path, ord) to (project_id, name, path, place): a feature's critical files; without any, its
    most important ones."""
    known = members.join(critical.select(*BOTH, F.col("rank").alias("at")), BOTH)
    lacking = members.join(known.select("project_id", "name").distinct(), ["project_id", "name"], "left_anti").join(index.select(*BOTH, "importance"), BOTH)
    return _top_of_feature(known, most, "at", "path").unionByName(_top_of_feature(lacking, most, F.desc("importance"), F.expr(UNICODE), "path"))


def source_priority(members: DataFrame, features: DataFrame, index: DataFrame, most: int = PRIORITY) -> DataFrame:
    """(project_id, name, path, place): a feature's files in reading order, its entry points first."""
    starts = F.array_compact(F.concat(F.array("entry_point"), "entry_points"))
    leads = features.select("project_id", "name", F.explode(starts).alias("path")).distinct().withColumn("leads", F.lit(0))
    rows = members.join(index.select(*BOTH, "importance"), BOTH).join(leads, ["project_id", "name", "path"], "left")
    return _top_of_feature(rows, most, F.coalesce("leads", F.lit(1)), "ord", F.desc("importance"), "path")


def _listed(rows: DataFrame, name: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("p")).select(*by, F.col("p")["path"].alias(name))


def first_of_id(features: DataFrame) -> DataFrame:
    """features with id; of those whose names give one id the first by name."""
    order = Window.partitionBy("project_id", "id").orderBy(F.expr("name COLLATE UNICODE"), "name")
    return features.withColumn("id", feature_id(F.col("name"))).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def summary(name: Column, language: Column, types: Column, workspace: Column, features: Column) -> Column:
    """A sentence on a project and one on its features, the first four that are sure enough."""
    kinds = {"node-cli": "Node.js CLI", "web-app": "web application", "api-service": "API service", "library": "reusable library"}
    told = F.array_compact(F.array(*[F.when(F.array_contains(types, t), said) for t, said in kinds.items()]))
    place = F.when(workspace == "monorepo", "monorepo").otherwise("project")
    some = F.concat(place, F.lit(" containing "), F.array_join(F.slice(told, F.lit(1), F.greatest(F.size(told) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(told, -1))
    one = F.when(told[0] == "Node.js CLI", F.concat(place, F.lit(" centered on a Node.js CLI"))).otherwise(F.concat(place, F.lit(" containing a "), told[0]))
    kind = F.when(F.size(told) == 0, place).when(F.size(told) == 1, one).otherwise(some)
    spoken = F.when(language == "typescript", "TypeScript").when(language == "javascript", "JavaScript").otherwise(text.capitalise(language))
    able = F.when(F.size(features) > 0, F.concat(F.lit(" Main capabilities: "), F.array_join(F.slice(features, 1, 4), ", "), F.lit("."))).otherwise("")
    return F.concat(name, F.lit(" is a "), spoken, F.lit(" "), kind, F.lit("."), able)


def feature_documents(features: DataFrame, members: DataFrame, index: DataFrame, critical: DataFrame) -> DataFrame:
    """(project_id, name, id, document, summary parts): one JSON document a feature, names as readers of the files know them."""
    by = ("project_id", "name")
    roles = members.join(index.select(*BOTH, "purpose"), BOTH).select(
        *by, F.col("ord").alias("place"), F.struct("path", F.coalesce("purpose", F.concat(F.lit("Supports "), "name", F.lit("."))).alias("role")).alias("file")
    )
    related = roles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "file"))).alias("r")).select(*by, F.col("r")["file"].alias("relatedFiles"))
    rows = features
    for more in (related, _listed(critical_of_features(members, critical, index), "criticalFiles", *by), _listed(source_priority(members, features, index), "sourcePriority", *by)):
        rows = rows.join(more, list(by), "left")
    none = F.array().cast("array<string>")
    starts = F.array_distinct(F.array_compact(F.concat(F.array("entry_point"), "entry_points")))
    flow = F.filter("business_flow", lambda s: ~s.rlike("(?i)^identify files related to "))
    rows = rows.withColumns({"criticalFiles": F.coalesce("criticalFiles", none), "sourcePriority": F.coalesce("sourcePriority", none)})
    related = F.coalesce("relatedFiles", F.array().cast("array<struct<path:string,role:string>>")).alias("relatedFiles")
    document = F.struct(
        "id", "name", F.col("purpose").alias("summary"), starts.alias("entryPoints"), "criticalFiles", related, F.when(F.size(flow) > 1, flow).alias("flow"),
        F.slice("search_terms", 1, 12).alias("keywords"), "sourcePriority", "confidence",
    )
    listed = F.struct("id", "name", F.col("purpose").alias("summary"), F.slice("search_terms", 1, 8).alias("keywords"), "criticalFiles", F.concat(F.lit("features/"), "id").alias("map"))
    return rows.select("project_id", F.concat(F.lit("features/"), "id").alias("name"), F.to_json(document).alias("document"), listed.alias("listed"), "confidence", F.col("name").alias("feature"))


def documents(found: Analysis, index: DataFrame, features: DataFrame, told: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, name, document): the index document and all feature documents of every project, for sources.documents.

    index is of file_index.full, told of flows, projects(project_id, name, package_manager, types, workspace) of
    detectors.metadata.
    """
    kept = graph.written(first_of_id(features))
    members = graph.written(kept.select("project_id", "name", F.posexplode("files").alias("ord", "path")))
    each = graph.written(feature_documents(kept, members, index, found.critical_files))
    distance = graph.distances(found.edges, found.entry_points)
    scores = start_scores(found.entry_points, distance, index, features, flow_files(told), found.critical_files)
    order = F.array_sort(F.collect_list(F.struct(F.collate("feature", "UNICODE").alias("key"), "listed", "confidence", "feature")))
    listed = each.groupBy("project_id").agg(order.alias("f"))
    sure = F.transform(F.filter("f", lambda x: x["confidence"] != "low"), lambda x: x["feature"])
    entries = found.entry_points.filter(F.col("rank") <= STARTS).select(*BOTH, F.col("rank").alias("place"))
    rows = projects.join(found.languages, "project_id", "left").join(found.frameworks, "project_id", "left").join(listed, "project_id", "left")
    for name, some in (("entryPoints", entries), ("criticalFiles", start_here(scores))):
        rows = rows.join(_listed(some, name, "project_id"), "project_id", "left")
    none = F.array().cast("array<string>")
    able = F.coalesce(sure, none)
    project = F.struct(
        "name", F.array_compact(F.array("frontend", "backend")).alias("frameworks"), "language", F.col("package_manager").alias("packageManager"), F.col("types").alias("projectTypes"),
        F.col("workspace").alias("workspaceType"), summary(F.col("name"), F.col("language"), F.col("types"), F.col("workspace"), able).alias("summary"),
    )
    document = F.struct(project.alias("project"), F.coalesce("entryPoints", none).alias("entryPoints"), F.coalesce("criticalFiles", none).alias("criticalFiles"), F.col("f")["listed"].alias("features"))
    return rows.select("project_id", F.lit("index").alias("name"), F.to_json(document).alias("document")).unionByName(each.select("project_id", "name", "document"))
