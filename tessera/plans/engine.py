"""The analysis of source projects as lazy tables: parse, resolve, detect, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, paths, text
from ..operators import business_flows, detectors, entities, feature_list, graph, parsing, ranking

CRITICAL = 10


@dataclass
class Analysis:
    analyses: DataFrame
    edges: DataFrame
    references: DataFrame
    entry_points: DataFrame
    critical_files: DataFrame
    file_index: DataFrame
    frameworks: DataFrame
    databases: DataFrame
    languages: DataFrame
    fields: DataFrame
    fingerprints: DataFrame
    flags: DataFrame


#: Points of a critical file, and of a file's importance, for its part in authentication.
AUTH_POINTS = {"auth-config": (50, 70), "guard": (40, 60), "provider": (35, 45), "consumer": (25, 35)}


def auth_parts(analyses: DataFrame, flags: DataFrame) -> DataFrame:
    """(project_id, path, part): files with a part in authentication, by names, imports and what their texts say."""
    names = F.concat("exports", F.col("symbols")["name"])
    both = analyses.select("project_id", "path", names.alias("names"), "imports").join(flags, ["project_id", "path"])
    part = evidence.auth_role(F.col("path"), F.col("names"), F.col("imports"), F.col("said"))
    return both.select("project_id", "path", part.alias("part")).filter("part IS NOT NULL")


def critical_files(files: DataFrame, references: DataFrame, entry_points: DataFrame, parts: DataFrame, most: int = CRITICAL) -> DataFrame:
    """(project_id, path, refs, score, reasons, rank): the production sources that most depends on; parts are of auth_parts."""
    path = F.col("path")
    own = files.filter(paths.is_production(path) & path.rlike(paths.SOURCE + r"|\.prisma\z") & (paths.tier(path) != "excluded")).select("project_id", "path")
    joined = own.join(references, ["project_id", "path"], "left").join(entry_points.select("project_id", "path", F.lit(True).alias("is_entry")), ["project_id", "path"], "left")
    joined = joined.join(parts, ["project_id", "path"], "left")
    refs = F.coalesce("refs", F.lit(0))
    imported = F.concat(F.lit("imported by "), refs, F.when(refs == 1, " file").otherwise(" files"))
    execution = F.lower("path").rlike(r"(^|/)(projectmap|filescanner|analyzerregistry|router|controller|orchestrator|engine)" + paths.CODE + r"|(^|/)commands?/[^/]+" + paths.CODE)
    first, why = ranking.additive(3 * refs, [(F.col("is_entry").isNotNull(), 12, "application entry point"), (execution, 16, "core execution responsibility")])
    declared = path.rlike(r"(^|/)(types?|constants?)" + paths.CODE)
    base = F.when(declared, F.greatest(F.lit(0), first - 8)).otherwise(first)
    concern = F.lower("path").rlike(r"(^|/)(auth|session|db|database|middleware|schema|config)([./-]|\z)")
    convention = path.rlike(r"(^|/)(page|layout|route|server|app|main|index)" + paths.CODE)
    anchors = [(F.col("part") == part, points, "semantic feature anchor") for part, (points, _) in AUTH_POINTS.items()]
    score, more = ranking.additive(base, [(concern, 3, "core project concern"), *anchors, (convention, 2, "framework convention")])
    reasons = F.concat(F.when(refs > 0, F.array(imported)).otherwise(F.array().cast("array<string>")), why, more)
    scored = joined.select("project_id", "path", refs.alias("refs"), score.alias("score"), reasons.alias("reasons")).filter("score > 0")
    return ranking.top_per_project(scored, most, F.desc("score"), F.expr("path COLLATE UNICODE"), "path")


def analyse(files: DataFrame) -> Analysis:
    """All tables of files(project_id, path, extension, size, lines, content).

    Parsed files and edges are written once to the shared folder; contents stay out of every join.
    """
    parsed = graph.written(parsing.analyse(files))
    imports = parsed.select("project_id", "path", F.posexplode("imports").alias("ord", "specifier"))
    meta = files.select("project_id", "path", "extension", "size", "lines", F.md5(F.col("content").cast("binary")).alias("hash"))
    edges = graph.written(graph.resolve_imports(meta, imports))
    references = graph.reference_counts(edges)
    flags = graph.written(files.select("project_id", "path", evidence.said(F.col("content")).alias("said")))
    entries = graph.entry_points(meta, edges)
    index = meta.join(references, ["project_id", "path"], "left").join(parsed.select("project_id", "path", "exports", "top_functions", "confidence"), ["project_id", "path"])
    targets = edges.groupBy("project_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    index = index.join(targets, ["project_id", "path"], "left")
    scope = evidence.scope(F.col("path"), F.col("exports"), F.coalesce("targets", F.array().cast("array<string>")))
    names = F.array_join("exports", " ")
    index = index.select("project_id", "path", "lines", "hash", F.coalesce("refs", F.lit(0)).alias("refs"), paths.role(F.col("path")).alias("role"), paths.tier(F.col("path")).alias("tier"), scope.alias("scope"),
                         paths.entry_rank(F.col("path")).alias("entry_rank"), text.search_terms(F.col("path"), names, F.array_join(F.col("top_functions.name"), " ")).alias("search_terms"), "exports", "confidence")
    return Analysis(
        parsed, edges, references, entries, critical_files(meta, references, entries, auth_parts(parsed, flags)), index, detectors.frameworks(files), detectors.database(files),
        detectors.language(meta), entities.prisma_fields(files), ranking.fingerprints(meta), flags,
    )


def routes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of every project under the frameworks that it uses."""
    used = detectors.frameworks(files).select("project_id", F.explode(F.array_compact(F.array("frontend", "backend"))).alias("framework"))
    used = graph.written(used)

    def of(framework: str) -> DataFrame:
        return files.join(used.filter(F.col("framework") == framework), "project_id", "left_semi")

    found = detectors.express_routes(of("express"), edges).unionByName(detectors.fastify_routes(of("fastify"), edges)).unionByName(detectors.nest_routes(of("nestjs")))
    for framework in ("nextjs", "astro", "nuxt", "sveltekit"):
        found = found.unionByName(detectors.page_routes(of(framework), framework))
    return found


def features(files: DataFrame, found: Analysis, routed: DataFrame) -> DataFrame:
    """The merged feature list of every project, each feature with its flow; routed are its routes."""
    listed = graph.written(feature_list.detect(files, found.analyses, found.edges, routed, found.fields, found.entry_points, found.flags))
    return business_flows.with_flows(listed, files, found.edges)
