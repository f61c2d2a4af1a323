"""Flows through the file graph: what a request touches, ordered reading lists, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .ranking import top_per_project

STEPS = 5
# Files that a reader should see first.
WELL_KNOWN = ["README.md", "readme.md", "AGENTS.md", "package.json"]
READING = 12


def chains(edges: DataFrame, seeds: DataFrame, most: int = STEPS) -> DataFrame:
    """seeds(project_id, path) to (project_id, seed, path, step): the first files of a breadth-first walk in edge order.

    A file's key is the list of edge numbers on its way from the seed; shorter keys, then smaller ones, come first. After
    every hop each seed keeps ``most`` files, so a walk stays small whatever the graph.
    """
    links = written(edges.select("project_id", "src", F.col("dst").alias("path"), F.col("ord").cast("int").alias("ord")))
    order = Window.partitionBy("project_id", "seed").orderBy(F.size("key"), "key", "path")
    seen = seeds.select("project_id", F.col("path").alias("seed"), "path", F.array().cast("array<int>").alias("key")).distinct()
    for hop in range(1, most):
        edge = seen.filter(F.size("key") == hop - 1).select("project_id", "seed", F.col("path").alias("src"), "key")
        more = edge.join(links, ["project_id", "src"]).select("project_id", "seed", "path", F.concat("key", F.array("ord")).alias("key"))
        every = seen.unionByName(more).groupBy("project_id", "seed", "path").agg(F.min(F.struct(F.size("key").alias("n"), "key")).alias("k"))
        every = every.select("project_id", "seed", "path", F.col("k.key").alias("key")).withColumn("step", F.row_number().over(order))
        seen = written(every.filter(F.col("step") <= most).drop("step"))
    return seen.withColumn("step", F.row_number().over(order) - 1).select("project_id", "seed", "path", "step")


def request_flows(routes: DataFrame, edges: DataFrame, most: int | None = 5) -> DataFrame:
    """(project_id, name, steps, confidence) of API routes, the first by route and file; all of them if most is None."""
    api = routes.filter("kind = 'api'").select("project_id", "route", "file").distinct()
    kept = top_per_project(api, most, "route", "file").drop("rank") if most else api
    walked = chains(edges, kept.select("project_id", F.col("file").alias("path")))
    steps = walked.groupBy("project_id", F.col("seed").alias("file")).agg(F.array_sort(F.collect_list(F.struct("step", "path"))).alias("s"))
    flows = kept.join(steps, ["project_id", "file"])
    paths = F.col("s")["path"]
    return flows.select("project_id", F.concat(F.lit("Request "), "route").alias("name"), paths.alias("steps"), F.when(F.size(paths) > 1, "high").otherwise("medium").alias("confidence"))


def importance(refs: Column, critical: Column, features: Column, is_entry: Column, path: Column, semantic: Column) -> Column:
    """0 to 100: references, critical score, number of features, entry points, conventional names, semantic points."""
    named = path.rlike(r"(^|/)(index|main|app|server|layout|page|route)\.")
    score = refs * 10 + critical * 5 + features * 8 + F.when(is_entry, 20).otherwise(0) + F.when(named, 5).otherwise(0) + semantic
    return F.least(F.lit(100), score)


def reading_path(files: DataFrame, entry_points: DataFrame, critical: DataFrame, ranked: DataFrame, most: int = READING) -> DataFrame:
    """(project_id, path, place): well-known files, entry points, critical files, then by importance; first seen counts.

    ranked: (project_id, path, importance, role).
    """
    known = F.array_position(F.array(*map(F.lit, WELL_KNOWN)), F.col("path"))
    buckets = [
        files.filter(known > 0).select("project_id", "path", known.cast("double").alias("ord")),
        entry_points.select("project_id", "path", F.col("rank").cast("double").alias("ord")),
        critical.select("project_id", "path", F.col("rank").cast("double").alias("ord")),
        ranked.filter(~F.col("role").isin("test", "documentation")).select("project_id", "path", (-F.col("importance")).cast("double").alias("ord")),
    ]
    every = buckets[0].withColumn("bucket", F.lit(0))
    for i, more in enumerate(buckets[1:], 1):
        every = every.unionByName(more.withColumn("bucket", F.lit(i)))
    first = every.groupBy("project_id", "path").agg(F.min(F.struct("bucket", "ord", "path")).alias("at"))
    return top_per_project(first, most, "at").select("project_id", "path", F.col("rank").alias("place"))
