"""Dependency maps of a file, a feature or a project as text.

Texts are made on the driver from rows whose number a cap bounds, except where a map of everything is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import graph, groups

USES, USED_BY, INSIDE = 2, 1, 4


def tree_text(rows: list[Row]) -> str:
    """Box-drawn lines of one root's paths."""
    children: dict[tuple, list[Row]] = {}
    for r in sorted(rows, key=lambda r: (r["depth"], r["order"])):
        children.setdefault(tuple(r["path"][:-1]), []).append(r)

    def lines(row: Row, lead: str) -> list[str]:
        below, out = children.get(tuple(row["path"]), []) if not row["is_cycle"] else [], []
        for i, child in enumerate(below):
            last = i == len(below) - 1 and not row["hidden"]
            out.append(f"{lead}{'└── ' if last else '├── '}{child['path'][-1]}{' (cycle)' if child['is_cycle'] else ''}")
            out += lines(child, lead + ("    " if last else "│   "))
        if row["hidden"]:
            out.append(f"{lead}└── … +{row['hidden']} more")
        return out

    (root,) = children[()]
    return "\n".join([root["path"][0], *lines(root, "")])


def mermaid(edges: list[tuple[str, str]]) -> str:
    """A diagram of distinct edges, nodes numbered as they come."""
    names: dict[str, str] = {}
    body = []
    for a, b in dict.fromkeys(edges):
        for n in (a, b):
            if n not in names:
                names[n] = f"n{len(names)}"
                body.append(f'  {names[n]}["{n.replace(chr(34), "#quot;")}"]')
        body.append(f"  {names[a]} --> {names[b]}")
    return "\n".join(["graph TD", *body])


def file_map(edges: DataFrame, project: str, path: str, uses: int = USES, used_by: int = USED_BY, children: int = 25) -> dict[str, str]:
    """What a file uses and what uses it, as trees and one diagram; reads a bounded neighbourhood only."""
    own = edges.filter(F.col("project_id") == project)
    back = own.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("ord")).distinct()
    seed = edges.sparkSession.createDataFrame([(project, path)], "project_id string, path string")
    out, shown = {}, []
    for name, links, depth in (("uses", own, uses), ("used_by", back, used_by)):
        found = graph.bounded_paths(links, seed, depth, children).withColumn("order", F.array_join("path", "\n")).collect()
        out[name] = tree_text(found)
        steps = [(r["path"][-2], r["path"][-1]) for r in sorted(found, key=lambda r: (r["depth"], r["order"])) if r["depth"]]
        shown += steps if name == "uses" else [(b, a) for a, b in steps]
    return out | {"mermaid": mermaid(shown)}


def flat_text(paths: list[str], total: int) -> str:
    """Listed files, and how many more there are."""
    lines = [f"  - {p}" for p in paths] + ([f"  … +{total - len(paths)} more"] if total > len(paths) else [])
    return "\n".join(lines) or "  (none)"


def document(title: str, sections: list[tuple[str, str]], diagram: str) -> str:
    """One page of Markdown: sections, then the diagram."""
    body = "".join(f"\n## {heading}\n\n{text}\n" for heading, text in sections)
    return f"# {title} map\n{body}\n```mermaid\n{diagram}\n```\n"


def feature_tables(edges: DataFrame, features: DataFrame, depth: int = INSIDE, most: int | None = groups.SHOWN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tree, lists, drawn) of all features of all projects.

    tree: rows of bounded_paths below each feature's entry point, or its first file, through its own files only. lists: rows
    of groups.boundary, with its files that the tree misses as side rest. drawn: (project_id, name, side, src, dst, at), the
    edges between its files and the listed ones.
    """
    members = graph.written(groups.members_of(features))
    labelled = graph.written(groups.sides(edges, members))
    start = F.coalesce("entry_point", F.try_element_at("files", F.lit(1)))
    roots = features.select("project_id", "name", start.alias("path")).filter("path IS NOT NULL")
    inner = labelled.filter("side = 'inner'").select("project_id", "name", "src", "dst", F.col("at.ord").alias("ord"))
    tree = graph.written(graph.bounded_paths(inner, roots, depth, most or 2**31 - 1, keys=groups.KEYS))
    border = graph.written(groups.boundary(labelled, most))
    other = F.when(F.col("side") == "out", F.col("dst")).otherwise(F.col("src"))
    drawn = labelled.withColumn("path", other).join(border.select(*groups.KEYS, "side", "path"), [*groups.KEYS, "side", "path"], "left_semi").drop("path")
    return tree, border.unionByName(groups.unreached(members, tree, roots, most)), drawn


def feature_map(edges: DataFrame, features: DataFrame, project: str, name: str, depth: int = INSIDE, most: int | None = groups.SHOWN) -> dict[str, str]:
    """One feature's files as a tree, and what it uses and is used by outside itself."""
    one = features.filter((F.col("project_id") == project) & (F.col("name") == name))
    if not one.take(1):
        raise LookupError(f"{name!r} is no feature of {project}")
    tree, lists, drawn = feature_tables(edges.filter(F.col("project_id") == project), one, depth, most)
    paths = sorted(tree.withColumn("order", F.array_join("path", "\n")).collect(), key=lambda r: (r["depth"], r["order"]))
    listed = {side: ([], 0) for side in ("rest", "out", "in")}
    for r in sorted(lists.collect(), key=lambda r: r["place"]):
        listed[r["side"]] = ([*listed[r["side"]][0], r["path"]], r["total"])
    inside = [(r["path"][-2], r["path"][-1]) for r in paths if r["depth"]]
    border = [(r["src"], r["dst"]) for r in sorted(drawn.collect(), key=lambda r: (r["side"] == "in", r["at"]))]
    diagram = mermaid(inside + border)
    sections = [("Internal structure", tree_text(paths) if paths else name)]
    sections += [("Other files in this feature", flat_text(*listed["rest"]))] if listed["rest"][1] else []
    sections += [("Depends on (outside this feature)", flat_text(*listed["out"])), ("Used by (outside this feature)", flat_text(*listed["in"]))]
    return {"markdown": document(name, sections, diagram), "mermaid": diagram}


def project_map(edges: DataFrame, features: DataFrame, files: DataFrame, entry_points: DataFrame, project: str) -> dict[str, str]:
    """A project's features and how they depend on each other; its entry points; how much of it the features cover."""
    own = features.filter(F.col("project_id") == project)
    members = groups.members_of(own)
    between = groups.quotient(edges.filter(F.col("project_id") == project), members).orderBy("place").collect()
    sizes = members.groupBy("name", "rank").agg(F.count("*").alias("n")).orderBy("rank").collect()
    starts = [r[0] for r in entry_points.filter(F.col("project_id") == project).orderBy("rank").select("path").collect()]
    covered = groups.coverage(files.filter(F.col("project_id") == project), members).first()
    diagram = mermaid([(r["src"], r["dst"]) for r in between])
    sections = [
        ("Features", "\n".join(f"  - {r['name']} ({r['n']} file{'' if r['n'] == 1 else 's'})" for r in sizes) or "(none detected)"),
        ("Feature relationships", "\n".join(f"  - {r['src']} → {r['dst']}" for r in between) or "(no cross-feature dependencies detected)"),
        ("Entry points", flat_text(starts, len(starts))),
        ("Coverage", f"{covered['mapped']} of {covered['total']} files belong to a detected feature." if covered else "(no files scanned)"),
    ]
    return {"markdown": document("Project", sections, diagram), "mermaid": diagram}


def full_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, line): every file with all that it imports, as a map of everything lists it."""
    uses = edges.groupBy("project_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("d"))
    line = F.concat(F.lit("  - "), "path", F.when(F.size("d") > 0, F.concat(F.lit(" → "), F.array_join(F.col("d")["dst"], ", "))).otherwise(""))
    return files.select("project_id", "path").join(uses, ["project_id", "path"], "left").select("project_id", "path", line.alias("line"))
