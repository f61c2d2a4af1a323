"""What is told of a project to whoever names its domain from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import entities
from .engine import Analysis


def _in_order(rows: DataFrame, name: str, order: Column, value: Column) -> DataFrame:
    listed = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))).alias("x"))
    return listed.select("project_id", F.array_distinct(F.col("x")["v"]).alias(name))


def domain_facts(found: Analysis, features: DataFrame, extracted: DataFrame, capabilities: DataFrame, routes: DataFrame) -> DataFrame:
    """The facts of memo.domain_questions: entities as declared, relations, kinds of capabilities, sure features, framework,
    number of routes, ownership. extracted is of entities.extract, capabilities of feature_list.capabilities."""
    relations = entities.graph_relations(found.fields)
    said = F.concat_ws(" ", "src", "kind", "dst")
    rows = found.frameworks.select("project_id", F.coalesce("frontend", "backend", F.lit("unknown")).alias("framework"))
    for more in (
        _in_order(extracted, "entities", F.col("seen"), F.col("entity")),
        _in_order(relations, "relations", said, said),
        _in_order(capabilities, "capabilities", F.col("at"), F.col("kind")),
        _in_order(features.filter("confidence <> 'low'"), "features", F.collate("name", "UNICODE"), F.col("name")),
        routes.groupBy("project_id").agg(F.count("*").cast("int").alias("routes")),
        entities.ownership(extracted, found.fields, relations),
    ):
        rows = rows.join(more, "project_id", "left")
    none = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, none) for c in ("entities", "relations", "capabilities", "features", "shared_fields")}
    return rows.withColumns(filled | {"routes": F.coalesce("routes", F.lit(0)), "ownership": F.coalesce("ownership", F.lit("unclear"))})
