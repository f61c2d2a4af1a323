"""Data-model entities: Prisma models and their relations, tables named in SQL strings, API resources, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import entity_name

# Scalar types of the schema language; names in queries that are no entity; words of plain copy; clients.
SCALARS = ["String", "Boolean", "Int", "BigInt", "Float", "Decimal", "DateTime", "Json", "Bytes", "Unsupported"]
CATALOGS = [
    "information_schema", "pg_catalog", "pg_stat_activity", "sqlite_master", "sqlite_sequence", "sqlite_temp_master",
    "migrations", "schema_migrations", "knex_migrations", "_prisma_migrations",
]
NO_TABLE = [
    "a", "an", "the", "this", "that", "these", "those", "your", "my", "our", "their", "his", "her", "its", "all", "any", "some", "each", "us", "you", "me", "them",
]
NO_ENTITY = ["api", "v1", "v2", "v3", "public", "internal", "private", "auth", "oauth", "callback", "health", "ping", "status", "static", "assets", "files", "me", "self"]
CLIENTS = ["pg", "pg-promise", "mysql2", "mysql2/promise", "mysql", "better-sqlite3", "sqlite3", "node:sqlite"]
MODEL = r"(?m)^model\s+(\w+)\s*\{([\s\S]*?)\n\}"
FIELD = r"(?m)^\s+(\w+)\s+(\w+)(\[\])?(\?)?"
#: Comments and string literals, whichever begins first.
LITERAL = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
TABLE = r"(?i)\b(?:from|into|update|join)\s+[\"'`]?([A-Za-z_][A-Za-z0-9_]*)"
DRIVERS = r"""(?i)(from\s+|require\(\s*)["'](""" + "|".join(CLIENTS) + r""")["']"""


def prisma_fields(files: DataFrame) -> DataFrame:
    """(project_id, entity, ord, name, type, is_list, is_optional, is_relation, seen) of all models; the first of a name counts.

    seen (path, at) is where a model is declared."""
    schemas = files.filter(F.endswith("path", F.lit(".prisma"))).select("project_id", "path", "content")
    zipped = F.arrays_zip(F.regexp_extract_all("content", F.lit(MODEL), 1).alias("entity"), F.regexp_extract_all("content", F.lit(MODEL), 2).alias("body"))
    models = schemas.select("project_id", "path", F.posexplode(zipped).alias("at", "m")).select("project_id", F.struct("path", "at").alias("seen"), "m.entity", "m.body")
    first = models.groupBy("project_id", "entity").agg(F.min_by("body", "seen").alias("body"), F.min("seen").alias("seen"))
    lines = F.regexp_extract_all("body", F.lit(FIELD), 0)
    fields = first.select("project_id", "entity", "seen", F.posexplode(lines).alias("ord", "line"))
    kind = F.regexp_extract("line", FIELD, 2)
    return fields.select(
        "project_id", "entity", "ord", F.regexp_extract("line", FIELD, 1).alias("name"), kind.alias("type"), (F.regexp_extract("line", FIELD, 3) != "").alias("is_list"),
        (F.regexp_extract("line", FIELD, 4) != "").alias("is_optional"), (kind.rlike("^[A-Z]") & ~kind.isin(SCALARS)).alias("is_relation"), "seen",
    )


def _relations(fields: DataFrame) -> DataFrame:
    known = fields.select("project_id", F.col("entity").alias("type")).distinct()
    own = fields.filter("is_relation").join(known, ["project_id", "type"])
    back = fields.filter("is_list").select("project_id", F.col("entity").alias("type"), F.col("type").alias("entity")).distinct().withColumn("back", F.lit(True))
    return own.join(back, ["project_id", "type", "entity"], "left").withColumn("back", F.coalesce("back", F.lit(False)))


def ownership_relations(fields: DataFrame) -> DataFrame:
    """(project_id, src, dst, kind): a list field owns many; a single field without a list on the other side is one to one,
    once for both sides; relations to oneself do not count."""
    own = _relations(fields).filter("type <> entity")
    many = own.filter("is_list").select("project_id", F.col("entity").alias("src"), F.col("type").alias("dst"), F.lit("one-to-many").alias("kind")).distinct()
    single = own.filter("NOT is_list AND NOT back")
    pair = single.groupBy("project_id", F.least("entity", "type").alias("a"), F.greatest("entity", "type").alias("b")).agg(F.min(F.struct("entity", "type")).alias("x"))
    return many.unionByName(pair.select("project_id", F.col("x.entity").alias("src"), F.col("x.type").alias("dst"), F.lit("one-to-one").alias("kind")))


def graph_relations(fields: DataFrame) -> DataFrame:
    """(project_id, src, dst, kind), another rule: lists on both sides are many to many, kept once; a list is one to many;
    all else one to one, from either side and to oneself."""
    kind = F.when(F.col("is_list") & F.col("back"), "many-to-many").when(F.col("is_list"), "one-to-many").otherwise("one-to-one")
    every = _relations(fields).withColumn("kind", kind)
    both = every.filter("kind = 'many-to-many'").groupBy("project_id", F.least("entity", "type").alias("a"), F.greatest("entity", "type").alias("b"))
    first = both.agg(F.min(F.struct("entity", "type")).alias("x")).select("project_id", F.col("x.entity").alias("src"), F.col("x.type").alias("dst"), F.lit("many-to-many").alias("kind"))
    others = every.filter("kind <> 'many-to-many'").select("project_id", F.col("entity").alias("src"), F.col("type").alias("dst"), "kind")
    return first.unionByName(others)


def sql_tables(files: DataFrame) -> DataFrame:
    """(project_id, entity, files, seen): tables in the SQL strings of production sources, if one of these imports a raw client.

    Comments, and template strings with holes, are no SQL; nor are names that begin like a sentence or a product.
    """
    code = files.filter(paths.is_production(F.col("path"))).select("project_id", "path", "extension", "content")
    active = code.filter(F.col("content").rlike(DRIVERS)).select("project_id").distinct()
    scanned = code.filter(F.col("extension").isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")).join(active, "project_id", "left_semi")
    literals = scanned.select("project_id", "path", F.posexplode(F.regexp_extract_all("content", F.lit(LITERAL), 0)).alias("at", "sql"))
    literals = literals.filter(~F.startswith("sql", F.lit("/")) & ~(F.startswith("sql", F.lit("`")) & F.contains("sql", F.lit("${"))))
    bare = F.substring(F.col("sql"), F.lit(2), F.length("sql") - 2)
    queries = literals.withColumn("sql", bare).filter(F.col("sql").rlike(r"(?i)\b(?:select|insert|update|delete|with)\b"))
    tables = queries.select("project_id", "path", "at", F.posexplode(F.regexp_extract_all("sql", F.lit(TABLE), 1)).alias("place", "t"))
    named = tables.filter(~F.lower("t").isin(CATALOGS + NO_TABLE) & ~F.col("t").rlike("^[A-Z][a-z]"))
    return named.groupBy("project_id", entity_name(F.lower("t")).alias("entity")).agg(
        F.array_sort(F.collect_set("path")).alias("files"), F.min(F.struct("path", "at", "place")).alias("seen")
    )


def route_hints(routes: DataFrame) -> DataFrame:
    """(project_id, entity, files, seen): what the fixed folders of API routes are named after; files is null.

    Only folders in brackets count as parameters, so ":id" names an entity of its own.
    """
    parts = F.filter(F.split("route", "/"), lambda s: s != "")
    each = routes.filter("kind = 'api'").select("project_id", F.col("route").alias("path"), F.posexplode(parts).alias("at", "part"))
    named = each.filter(~F.startswith("part", F.lit("[")) & (F.length("part") > 2) & ~F.lower("part").isin(NO_ENTITY))
    seen = F.min(F.struct("path", "at", F.lit(0).alias("place"))).alias("seen")
    return named.groupBy("project_id", entity_name(F.col("part")).alias("entity")).agg(F.lit(None).cast("array<string>").alias("files"), seen)


def extract(files: DataFrame, fields: DataFrame, routes: DataFrame) -> DataFrame:
    """(project_id, source, entity, files, seen) by the first source that a project has: its schema, SQL strings, API routes.

    One aggregate finds each project's source; SQL strings are only looked for in projects without a schema, routes only in
    projects without both. A project without any has no rows.
    """
    none = F.lit(None).cast("array<string>").alias("files")
    declared = F.min(F.struct("seen.path", "seen.at", F.lit(0).alias("place"))).alias("seen")
    schema = fields.groupBy("project_id", "entity").agg(declared).select("project_id", F.lit("prisma").alias("source"), "entity", none, "seen")
    modelled = schema.select("project_id").distinct()
    tables = sql_tables(files.join(modelled, "project_id", "left_anti")).select("project_id", F.lit("sql").alias("source"), "entity", "files", "seen")
    known = modelled.unionByName(tables.select("project_id")).distinct()
    hints = route_hints(routes.join(known, "project_id", "left_anti")).select("project_id", F.lit("route-hint").alias("source"), "entity", "files", "seen")
    return schema.unionByName(tables).unionByName(hints)


# Fields that let several users at one row.
SHARED_FIELDS = ["participants", "members", "invitedby", "sharedwith", "sharedby", "recipientid", "senderid", "collaborators", "inviteeid", "inviterid"]


def _bare(name: Column) -> Column:
    """Letters other than a-z and digits drop out before lower-casing, so the capitals of camel case vanish."""
    return F.lower(F.regexp_replace(name, "[^a-z0-9]", ""))


def ownership(extracted: DataFrame, fields: DataFrame, relations: DataFrame) -> DataFrame:
    """(project_id, ownership, shared_fields) of every project with entities: how its users share data.

    direct_messaging with an entity that holds two users' ids, a sender's or recipient's among them, and shared fields;
    shared_access with shared fields or a many-to-many relation of the user; single_user_isolated with several entities and
    neither; else unclear. The user is the first entity of that name in any case.
    """
    mine = extracted.filter(F.lower("entity") == "user").groupBy("project_id").agg(F.min_by("entity", "seen").alias("user"))
    every = extracted.groupBy("project_id").agg(F.count_distinct("entity").alias("n")).join(mine, "project_id", "left").withColumn("user", F.coalesce("user", F.lit("User")))
    place = F.struct("seen", "ord", F.concat("entity", F.lit("."), "name").alias("field"))
    shared = fields.filter(_bare(F.col("name")).isin(SHARED_FIELDS)).groupBy("project_id").agg(F.array_sort(F.collect_list(place)).alias("s"))
    held = fields.join(every.select("project_id", "user"), "project_id").filter((F.col("entity") != F.col("user")) & (F.col("type").isin("String", "Int") | (F.col("type") == F.col("user"))))
    held = held.filter(F.col("name").rlike(r"(id|Id)\z") & F.contains(_bare(F.col("name")), _bare(F.col("user"))))
    sent = F.bool_or(_bare(F.col("name")).rlike("sender|recipient")).alias("sent")
    direct = held.groupBy("project_id", "entity").agg(F.count("*").alias("held"), sent).filter("held >= 2 AND sent").select("project_id", F.lit(True).alias("direct")).distinct()
    many = relations.filter("kind = 'many-to-many'").join(every.select("project_id", "user"), "project_id").filter("src = user OR dst = user")
    many = many.select("project_id", F.lit(True).alias("many")).distinct()
    rows = every.join(shared, "project_id", "left").join(direct, "project_id", "left").join(many, "project_id", "left")
    some = F.coalesce(F.size("s"), F.lit(0)) > 0
    kind = F.when(F.col("direct") & some, "direct_messaging").when(F.col("many") | some, "shared_access").when(F.col("n") > 1, "single_user_isolated").otherwise("unclear")
    return rows.select("project_id", kind.alias("ownership"), F.coalesce(F.col("s")["field"], F.array().cast("array<string>")).alias("shared_fields"))
