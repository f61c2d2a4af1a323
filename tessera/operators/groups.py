"""Groups of files against the graph: what lies inside a group, at its border, and between groups.

members(project_id, name, rank, path, ord): rank orders a project's groups, ord a group's files. Every edge is held against
the groups of its two ends by joins on (project_id, path); no group is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 25
KEYS = ("project_id", "name")


def members_of(features: DataFrame) -> DataFrame:
    """features(project_id, name, files) as members, groups in order of name."""
    order = Window.partitionBy("project_id").orderBy(F.expr("name COLLATE UNICODE"), "name")
    ranked = features.withColumn("rank", F.row_number().over(order))
    return ranked.select("project_id", "name", "rank", F.posexplode("files").alias("ord", "path"))


def first_group(members: DataFrame) -> DataFrame:
    """(project_id, path, name): the first group that lists a file."""
    best = members.groupBy("project_id", "path").agg(F.min(F.struct("rank", "name")).alias("first"))
    return best.select("project_id", "path", F.col("first.name").alias("name"))


def sides(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, name, side, src, dst, at): every edge that touches a group, as inner, out of it or into it.

    at orders a side as a reader of the group's files would meet its edges: by member, then by edge out of it, or by the
    file that an edge into it comes from.
    """
    own = members.select(*KEYS, "path", F.col("ord").alias("member"))
    there = members.select(*KEYS, F.col("path").alias("other"), F.lit(True).alias("inside"))
    out = edges.join(own.withColumnRenamed("path", "src"), ["project_id", "src"]).withColumn("other", F.col("dst"))
    into = edges.join(own.withColumnRenamed("path", "dst"), ["project_id", "dst"]).withColumn("other", F.col("src"))
    out = out.join(there, [*KEYS, "other"], "left").select(
        *KEYS, F.when(F.col("inside"), "inner").otherwise("out").alias("side"), "src", "dst", F.struct("member", F.lit("").alias("from"), F.col("ord").cast("long").alias("ord")).alias("at")
    )
    into = into.join(there, [*KEYS, "other"], "left_anti").select(
        *KEYS, F.lit("in").alias("side"), "src", "dst", F.struct("member", F.col("src").alias("from"), F.col("ord").cast("long").alias("ord")).alias("at")
    )
    return out.unionByName(into)


def _shown(rows: DataFrame, most: int | None, *order: Column | str) -> DataFrame:
    """The first rows of each side of a group, with their place and how many there are in all."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS, "side").orderBy(*order)))
    total = rows.groupBy(*KEYS, "side").agg(F.count("*").alias("total"))
    kept = ranked.filter(F.col("place") <= most) if most else ranked
    return kept.join(total, [*KEYS, "side"]).select(*KEYS, "side", "path", "place", "total")


def boundary(labelled: DataFrame, most: int | None = SHOWN) -> DataFrame:
    """sides to (project_id, name, side, path, place, total): the files outside a group that it uses (out) or that use it (in).

    Each file once, in the order of its first edge; the first ``most`` of a side, total tells of all.
    """
    other = F.when(F.col("side") == "out", F.col("dst")).otherwise(F.col("src"))
    files = labelled.filter("side <> 'inner'").groupBy(*KEYS, "side", other.alias("path")).agg(F.min("at").alias("at"))
    return _shown(files, most, "at", "path")


def unreached(members: DataFrame, tree: DataFrame, roots: DataFrame, most: int | None = SHOWN) -> DataFrame:
    """Members that the tree (rows of bounded_paths) does not show, as rows of boundary with the side rest."""
    seen = tree.select(*KEYS, F.explode("path").alias("path")).unionByName(roots.select(*KEYS, "path")).distinct()
    rest = members.join(seen, [*KEYS, "path"], "left_anti").select(*KEYS, F.lit("rest").alias("side"), "path", "ord")
    return _shown(rest, most, "ord", "path")


def quotient(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, src, dst, place): the graph contracted to groups, without loops, each edge once.

    A file's edges count for every group that lists it and lead to the first group that lists their end. place is the order
    in which a reader of the groups, their files and the files' edges first meets an edge.
    """
    ends = first_group(members).select("project_id", F.col("path").alias("dst"), F.col("name").alias("to"))
    starts = members.select("project_id", F.col("path").alias("src"), F.col("name").alias("from"), "rank", F.col("ord").alias("member"))
    met = edges.join(ends, ["project_id", "dst"]).join(starts, ["project_id", "src"]).filter("from <> to")
    first = met.groupBy("project_id", "from", "to").agg(F.min(F.struct("rank", "member", "ord")).alias("at"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("at", "to"))
    return first.select("project_id", F.col("from").alias("src"), F.col("to").alias("dst"), place.alias("place"))


def coverage(files: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, mapped, total): files in any group, and all files."""
    total = files.groupBy("project_id").agg(F.count("*").alias("total"))
    mapped = members.groupBy("project_id").agg(F.count_distinct("path").alias("mapped"))
    return total.join(mapped, "project_id", "left").select("project_id", F.coalesce("mapped", F.lit(0)).alias("mapped"), "total")
