"""Graphs as edge tables (project_id, src, dst, ord): import resolution, degrees, reverse edges, searches, ownership.

Every function works on all projects at once; project_id leads every key. Frontier loops write each step to the shared
folder (see ``written``), so a lost executor repeats one step.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths

# What a specifier may stand for, in order of preference.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue", "/index.svelte", "/index.astro"]
COMPILED = [(".js", ".ts"), (".js", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts")]
# Sizes: bytes of a table's values, as JSON, up to which a join may send it to every task.
SENT_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; under a local master a temporary one will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/tessera-shared"
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df for a join with many rows: broadcast if its values have SENT_BYTES at most, else merged by sorted keys.

    The other side is never broadcast. Spark guesses its size from its files and knows nothing of rows that were exploded.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return df.hint("broadcast" if size <= SENT_BYTES else "merge")


def normal_path(path: Column) -> Column:
    """. and empty segments drop out; .. takes the segment before it along, if there is one."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "..", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(parts, "/")


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files(project_id, path), imports(project_id, path, ord, specifier) to edges: the first candidate file that exists.

    Only specifiers that begin with a dot are resolved. Two specifiers that mean one file are two edges.
    """
    local = imports.filter(F.startswith("specifier", F.lit(".")))
    folder = F.regexp_replace("path", "[^/]*$", "")
    target = normal_path(F.concat(folder, F.col("specifier")))
    compiled = [F.when(F.endswith("target", F.lit(a)), F.concat(F.regexp_replace("target", a.replace(".", r"\.") + r"\z", ""), F.lit(b))) for a, b in COMPILED]
    tried = F.array(*[F.concat("target", F.lit(s)) for s in SUFFIXES + INDEXES], *compiled)
    tries = local.withColumn("target", target).select("project_id", F.col("path").alias("src"), "ord", F.posexplode(tried).alias("rank", "dst")).filter("dst IS NOT NULL")
    there = files.select("project_id", F.col("path").alias("dst")).distinct()
    found = tries.join(there, ["project_id", "dst"])
    return found.groupBy("project_id", "src", "ord").agg(F.min_by("dst", "rank").alias("dst")).select("project_id", "src", "dst", "ord")


def reference_counts(edges: DataFrame) -> DataFrame:
    """(project_id, path, refs): edges into each file, repeated ones counted."""
    return edges.groupBy("project_id", F.col("dst").alias("path")).agg(F.count("*").alias("refs"))


def dependents(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """(project_id, path, dependents): who refers to a file; in order, once each or once an edge."""
    who = F.collect_set("src") if distinct else F.collect_list("src")
    return edges.groupBy("project_id", F.col("dst").alias("path")).agg(F.array_sort(who).alias("dependents"))


def entry_points(files: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Production sources with an entry name, or that refer to others and are referred to by none; the first by path."""
    candidates = files.filter(paths.is_source(F.col("path")) & paths.is_production(F.col("path"))).select("project_id", "path")
    out = edges.select("project_id", F.col("src").alias("path")).distinct().withColumn("goes", F.lit(True))
    into = edges.select("project_id", F.col("dst").alias("path")).distinct().withColumn("used", F.lit(True))
    joined = candidates.join(out, ["project_id", "path"], "left").join(into, ["project_id", "path"], "left")
    picked = joined.filter(F.col("path").rlike(paths.ENTRY) | (F.col("used").isNull() & F.col("goes").isNotNull()))
    order = Window.partitionBy("project_id").orderBy(F.expr("path COLLATE UNICODE"), "path")
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("project_id", "path", "rank")


def distances(edges: DataFrame, seeds: DataFrame, most: int = 1_000) -> DataFrame:
    """seeds(project_id, path) to (project_id, path, distance) over edges src to dst, for all that is reached.

    Each step writes only what it reaches first. A path longer than ``most`` edges is an error, never cut off.
    """
    links = written(edges.select("project_id", "src", "dst").distinct())
    front = written(seeds.select("project_id", "path").distinct().withColumn("distance", F.lit(0)))
    reached = front
    for step in range(1, most + 2):
        edge = front.select("project_id", F.col("path").alias("src"))
        more = links.join(edge, ["project_id", "src"]).select("project_id", F.col("dst").alias("path")).distinct()
        front = written(more.join(reached, ["project_id", "path"], "left_anti").withColumn("distance", F.lit(step)))
        if not front.take(1):
            return reached
        if step <= most:
            reached = reached.unionByName(front)
    raise RuntimeError(f"paths of more than {most} edges")


def owned(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(project_id, path) to the files that only they reach: no referrer lies outside what is reached; seeds always."""
    reached = distances(edges, seeds).select("project_id", "path")
    outside = edges.join(reached.withColumnRenamed("path", "src"), ["project_id", "src"], "left_anti")
    foreign = outside.select("project_id", F.col("dst").alias("path")).distinct()
    return reached.join(foreign, ["project_id", "path"], "left_anti").unionByName(seeds.select("project_id", "path")).distinct()


def owned_by_name(edges: DataFrame, seeds: DataFrame, most: int = 1_000) -> DataFrame:
    """seeds(project_id, name, path) to (project_id, name, path): as owned, for the seeds of each name by themselves."""
    links = written(edges.select("project_id", "src", "dst").distinct())
    own = written(seeds.select("project_id", "name", "path").distinct())
    front, reached = own, own
    for _ in range(most + 1):
        edge = front.select("project_id", "name", F.col("path").alias("src"))
        more = links.join(edge, ["project_id", "src"]).select("project_id", "name", F.col("dst").alias("path")).distinct()
        front = written(more.join(reached, ["project_id", "name", "path"], "left_anti"))
        if not front.take(1):
            break
        reached = reached.unionByName(front)
    else:
        raise RuntimeError(f"paths of more than {most} edges")
    into = reached.join(links.withColumnRenamed("dst", "path"), ["project_id", "path"])
    inside = reached.withColumnRenamed("path", "src")
    foreign = into.join(inside, ["project_id", "name", "src"], "left_anti").select("project_id", "name", "path").distinct()
    return reached.join(foreign, ["project_id", "name", "path"], "left_anti").unionByName(own).distinct()


def bounded_paths(edges: DataFrame, roots: DataFrame, depth: int, children: int = 25, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """(*keys, root, depth, path, is_cycle, hidden): the tree below each root as paths; keys tell graphs apart.

    A node that is on its own branch already closes a cycle and is not followed. Of each node's edges the first
    ``children`` by ord are shown; hidden counts the others.
    """
    order = Window.partitionBy(*keys, "src").orderBy("ord", "dst")
    ranked = edges.withColumn("rank", F.row_number().over(order)).withColumn("hidden", F.greatest(F.count("*").over(Window.partitionBy(*keys, "src")) - children, F.lit(0)))
    shown = written(ranked.filter(F.col("rank") <= children).select(*keys, "src", "dst", "rank"))
    hidden = written(ranked.select(*keys, F.col("src").alias("node"), "hidden").distinct())
    level = roots.select(*keys, F.col("path").alias("root"), F.lit(0).alias("depth"), F.array("path").alias("path"), F.lit(False).alias("is_cycle"))
    found = [level]
    for step in range(1, depth + 1):
        grown = level.filter(~F.col("is_cycle")).withColumn("src", F.element_at("path", -1)).join(shown, [*keys, "src"])
        level = grown.select(*keys, "root", F.lit(step).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("is_cycle"))
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    followed = ~F.col("is_cycle") & (F.col("depth") < depth)
    joined = out.withColumn("node", F.element_at("path", -1)).join(hidden, [*keys, "node"], "left")
    return joined.select(*keys, "root", "depth", "path", "is_cycle", F.when(followed, F.coalesce("hidden", F.lit(0))).otherwise(0).alias("hidden"))


def change_impact(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members(project_id, path, name) to (project_id, path, impacts, dependents) of all files with either."""
    names = members.groupBy("project_id", "path").agg(F.array_sort(F.collect_set("name")).alias("impacts"))
    empty = F.array().cast("array<string>")
    joined = names.join(dependents(edges, distinct=False), ["project_id", "path"], "full_outer")
    return joined.select("project_id", "path", F.coalesce("impacts", empty).alias("impacts"), F.coalesce("dependents", empty).alias("dependents"))
