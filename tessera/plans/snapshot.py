"""Snapshots of analyses: one JSON document a project, read back with a status, defaults filled in; what became stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from .engine import Analysis

VERSION = "1"
MISSING, VALID, CORRUPT, UNSUPPORTED = "missing", "valid", "corrupt", "unsupported"
SHAPE = (
    "schemaVersion string, project struct<name: string, language: string, frameworks: array<string>>, fingerprint string, "
    "stats struct<totalFiles: long, totalLines: long>, entryPoints array<string>, "
    "criticalFiles array<struct<path: string, referencedBy: long, score: long, reasons: array<string>>>, dependencyGraph map<string, array<string>>, "
    "features array<struct<name: string, purpose: string, files: array<string>, entryPoint: string, entryPoints: array<string>, businessFlow: array<string>, "
    "searchTerms: array<string>, evidence: array<string>, confidence: string>>, routes array<struct<path: string, file: string, kind: string, methods: array<string>>>, "
    "entityGraph struct<source: string, entityNames: array<string>, relations: array<struct<`from`: string, `to`: string, kind: string>>>, "
    "capabilities array<struct<kind: string, name: string, entities: array<string>, evidence: array<string>, confidence: string>>, warnings array<string>, "
    "fileIndex map<string, struct<hash: string, lines: int, scope: string, featureRefs: array<string>, searchTerms: array<string>, importance: int, purpose: string>>"
)


def _listed(df: DataFrame, name: str, order: str, value: Column) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy("project_id").agg(pairs.alias("p")).select("project_id", F.col("p")["v"].alias(name))


def feature_facts(features: DataFrame) -> DataFrame:
    """(project_id, features) of engine.features, in order of name."""
    value = F.struct(
        "name", "purpose", "files", F.col("entry_point").alias("entryPoint"), F.col("entry_points").alias("entryPoints"), F.col("business_flow").alias("businessFlow"),
        F.col("search_terms").alias("searchTerms"), "evidence", "confidence",
    )
    return _listed(features.withColumn("key", F.collate("name", "UNICODE")), "features", "key", value)


def route_facts(routes: DataFrame) -> DataFrame:
    """(project_id, routes) in order of path and file; pages have no methods."""
    value = F.struct(F.col("route").alias("path"), "file", "kind", "methods")
    return _listed(routes.withColumn("key", F.struct(F.collate("route", "UNICODE").alias("route"), "file")), "routes", "key", value)


def entity_facts(extracted: DataFrame, relations: DataFrame) -> DataFrame:
    """(project_id, entityGraph) of entities.extract and entities.graph_relations."""
    names = extracted.groupBy("project_id").agg(F.min("source").alias("source"), F.array_sort(F.collect_list(F.struct("seen", "entity"))).alias("e"))
    links = relations.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind"))).alias("relations"))
    none = F.array().cast("array<struct<from:string,to:string,kind:string>>")
    both = names.join(links, "project_id", "left")
    return both.select("project_id", F.struct("source", F.col("e")["entity"].alias("entityNames"), F.coalesce("relations", none).alias("relations")).alias("entityGraph"))


def index_facts(index: DataFrame) -> DataFrame:
    """(project_id, fileIndex) of file_index.full."""
    value = F.struct("hash", F.col("lines").cast("int").alias("lines"), "scope", F.col("features").alias("featureRefs"), F.col("search_terms").alias("searchTerms"), "importance", "purpose")
    return index.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", value.alias("v"))))).alias("fileIndex"))


def capability_facts(found: DataFrame) -> DataFrame:
    """(project_id, capabilities) of feature_list.capabilities."""
    return _listed(found, "capabilities", "at", F.struct("kind", "name", "entities", "evidence", "confidence"))


def documents(found: Analysis, *facts: DataFrame) -> DataFrame:
    """(project_id, document): the snapshot as JSON text; absent facts are left out, and no source text is held.

    facts: tables of project_id and one more column each, such as feature_facts or file_index.warnings give, under whose
    name it enters the document.
    """
    stats = found.file_index.groupBy("project_id").agg(F.struct(F.count("*").alias("totalFiles"), F.sum("lines").cast("long").alias("totalLines")).alias("stats"))
    prints = found.fingerprints.select("project_id", "fingerprint")
    critical = F.struct("path", F.col("refs").alias("referencedBy"), F.col("score").cast("long").alias("score"), "reasons")
    each = found.edges.groupBy("project_id", "src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("d"))
    graph = each.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", F.col("d")["dst"])))).alias("dependencyGraph"))
    joined = stats.join(prints, "project_id")
    for more in (found.frameworks, found.languages, found.databases.select("project_id", F.struct("provider", "files").alias("database")),
                 _listed(found.entry_points, "entryPoints", "rank", F.col("path")), _listed(found.critical_files, "criticalFiles", "rank", critical), graph, *facts):
        joined = joined.join(more, "project_id", "left")
    none = F.array().cast("array<string>")
    project = F.struct(F.col("project_id").alias("name"), "language", F.array_compact(F.array("frontend", "backend")).alias("frameworks"))
    document = F.struct(F.lit(VERSION).alias("schemaVersion"), project.alias("project"), "fingerprint", "stats", F.coalesce("entryPoints", none).alias("entryPoints"), "criticalFiles", "dependencyGraph", "database",
                        *[c for f in facts for c in f.columns if c != "project_id"])
    return joined.select("project_id", F.to_json(document).alias("document"))


def inspect(texts: DataFrame) -> DataFrame:
    """(project_id, document) to the same with status and the parsed snapshot, absent fields filled in."""
    parsed = F.from_json("document", SHAPE)
    version = F.get_json_object("document", "$.schemaVersion")
    sound = F.try_parse_json("document").isNotNull() & parsed["project"].isNotNull() & parsed["stats"].isNotNull()
    status = F.when(F.col("document").isNull(), MISSING).when(F.try_parse_json("document").isNull(), CORRUPT).when(version.isNull() | (version != VERSION), UNSUPPORTED).when(sound, VALID).otherwise(CORRUPT)
    none = F.array().cast("array<string>")
    filled = parsed.withField("entryPoints", F.coalesce(parsed["entryPoints"], none)).withField("project.frameworks", F.coalesce(parsed["project"]["frameworks"], none))
    return texts.withColumn("status", status).withColumn("snapshot", F.when(F.col("status") == VALID, filled))


def stale(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, stale): whether the files' fingerprint, computed without any analysis, differs from the snapshot's."""
    now = ranking.fingerprints(files.select("project_id", "path", F.md5(F.col("content").cast("binary")).alias("hash")))
    old = inspect(snapshots).select("project_id", F.col("snapshot.fingerprint").alias("old"))
    return old.join(now, "project_id", "left").select("project_id", (~F.col("old").eqNullSafe(F.col("fingerprint"))).alias("stale"))
