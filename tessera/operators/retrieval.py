"""Questions over a file index: keywords, intent, weighted scores, graph neighbours, the best files with their windows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import split_terms
from . import search
from .graph import written
from .ranking import top_per_project

# Points for a keyword as a whole term or inside a path, an export, an import; cuts and limits.
PATH_TERM, PATH_PART, EXPORT_TERM, EXPORT_PART, IMPORT_PART = 30, 6, 26, 8, 3
INDEX_TERM = 30
LEAST, BEST_NEIGHBOURS, MOST = 25, 5, 5
FOCUSED = 2
# Points for keywords and for expanded terms by where they are met; for evidence of other tables.
KEYWORD, EXPANDED = (30, 6, 26, 8, 3), (14, 4, 12, 4, 2)
FEATURE_NAME, FEATURE_TERM, FEATURE_REF, PURPOSE, ROUTE, ENTRY = 10, 30, 14, 6, 30, 40
# Words that ask for entry points, for data at run time, for tests and for a scope; features that only say where to look.
ENTRY_WORDS = ["entry", "entrypoint", "main", "start", "startup"]
DATA_WORDS = ["access", "client", "connect", "connection", "init", "initialization", "initialize", "initialized", "initializes", "koneksi", "module"]
TEST_WORDS = ["coverage", "fixture", "fixtures", "spec", "specs", "test", "testing", "tests"]
SCOPE_WORDS = {"cli": ["cli", "command", "commands", "terminal"], "docs": ["documentation", "docs", "readme"], "web": ["component", "frontend", "page", "ui", "web"]}
SCOPE_PATHS = {"cli": r"/cli/|^cli/|/commands/", "docs": r"^docs/|\.md\z", "web": r"/web/|/components/|/pages/|/app/"}
SCOPE_NAMES = {"cli": ("cli", "CLI"), "docs": ("docs", "documentation"), "web": ("ui", "web")}
TEST_PATH = r"^tests?/|/tests?/|/__tests__/|/fixtures/|\.(?:test|spec)\.[cm]?[jt]sx?\z"


def tokens(question: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", question.lower()) if w]


def keywords(question: str) -> list[str]:
    """Telling words of a question, with all words of every concept that one of them belongs to."""
    action = {w for words in V.INTENTS.values() for w in words}
    found = dict.fromkeys(w for w in tokens(question) if len(w) > 1 and w not in V.STOP_WORDS and w not in action)
    for group in V.CONCEPTS:
        if any(w in found for w in group):
            found |= dict.fromkeys(group)
    return list(found)


def intent(question: str) -> str:
    words = set(tokens(question))
    return next((name for name, terms in V.INTENTS.items() if words & set(terms)), "general")


def _points(word: str) -> Column:
    w = F.lit(word)
    path = F.when(F.array_contains("path_terms", w), PATH_TERM).when(F.contains(F.lower("path"), w), PATH_PART).otherwise(0)
    export = F.when(F.array_contains("export_terms", w), EXPORT_TERM).when(F.contains("export_text", w), EXPORT_PART).otherwise(0)
    other = F.when(F.contains("import_text", w), IMPORT_PART).otherwise(0) + F.when(F.array_contains("search_terms", w), INDEX_TERM).otherwise(0)
    return path + export + other


def answer(index: DataFrame, analyses: DataFrame, edges: DataFrame, question: str, most: int = MOST) -> DataFrame:
    """(project_id, path, score, confidence, rank): the best files of every project for a question.

    Files that the best ones import, or that import them, take a share of their score unless the question asks where
    something is or for a change.
    """
    words = keywords(question)
    seen = index.select("project_id", "path", "search_terms").join(analyses.select("project_id", "path", "exports", "imports"), ["project_id", "path"])
    seen = seen.withColumns({
        "path_terms": split_terms(F.col("path")), "export_terms": F.flatten(F.transform("exports", split_terms)),
        "export_text": F.lower(F.array_join("exports", " ")), "import_text": F.lower(F.array_join("imports", " ")),
    })
    direct = seen.select("project_id", "path", reduce(lambda a, b: a + b, map(_points, words), F.lit(0)).alias("score")).filter("score > 0")
    scored = direct.withColumn("direct", F.col("score"))
    if intent(question) not in ("add_feature", "change", "navigate"):
        best = top_per_project(direct, BEST_NEIGHBOURS, F.desc("score"), "path").select("project_id", "path", "score")
        used = edges.join(best.withColumnRenamed("path", "src"), ["project_id", "src"]).select("project_id", F.col("dst").alias("path"), F.greatest(F.lit(LEAST), F.floor(F.col("score") / 4)).alias("score"))
        users = edges.join(best.withColumnRenamed("path", "dst"), ["project_id", "dst"]).select("project_id", F.col("src").alias("path"), F.greatest(F.lit(LEAST), F.floor(F.col("score") / 5)).alias("score"))
        every = scored.unionByName(used.unionByName(users).withColumn("direct", F.lit(0)))
        scored = every.groupBy("project_id", "path").agg(F.max("score").alias("score"), F.max("direct").alias("direct"))
    ranked = top_per_project(scored.filter(F.col("score") >= LEAST), most, F.desc("score"), F.desc("direct"), "path")
    return ranked.select("project_id", "path", "score", search.confidence(F.col("score")).alias("confidence"), "rank")


def scopes(question: str) -> list[str]:
    words = set(tokens(question))
    return [scope for scope, terms in SCOPE_WORDS.items() if words & set(terms)]


def _row(place: int, holds: Column, points: Column | int, reason: Column | str) -> Column:
    return F.when(holds, F.struct(F.lit(place).alias("place"), F.lit(points).cast("int").alias("points") if isinstance(points, int) else points.cast("int").alias("points"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))


def _term_rows(word: str, kind: str, points: tuple[int, ...]) -> list[Column]:
    parts, w = tokens(word), F.lit(word)
    whole = lambda column: reduce(lambda a, b: a & b, [F.array_contains(column, F.lit(p)) for p in parts]) if parts else F.lit(False)
    path, export = whole("path_terms"), whole("export_terms")
    return [
        _row(0, path, points[0], f'{kind} path term matches "{word}"'), _row(0, ~path & F.contains(F.lower("path"), w), points[1], f'{kind} path contains "{word}"'),
        _row(0, export, points[2], f'{kind} export term matches "{word}"'), _row(0, ~export & F.contains("export_text", w), points[3], f'{kind} export contains "{word}"'),
        _row(0, F.contains("import_text", w), points[4], f'{kind} dependency matches "{word}"'),
    ]


def _own_evidence(words: list[str], expanded: list[str], asked: list[str]) -> Column:
    """What a file's own row of the index says, as rows (place, points, reason)."""
    rows = [r for w in words for r in _term_rows(w, "keyword", KEYWORD)]
    for w in words:
        rows += [
            _row(1, F.array_contains("search_terms", F.lit(w)), INDEX_TERM, f'snapshot search term matches "{w}"'),
            _row(1, F.array_contains("feature_words", F.lit(w)), FEATURE_REF, f'feature reference matches "{w}"'),
            _row(1, F.contains(F.lower(F.coalesce("purpose", F.lit(""))), F.lit(w)), PURPOSE, f'purpose mentions "{w}"'),
        ]
    rows += [r for w in expanded for r in _term_rows(w, "expanded term", EXPANDED)]
    for scope in asked:
        value, said = SCOPE_NAMES[scope]
        rows += [_row(5, F.lower("path").rlike(SCOPE_PATHS[scope]), 8, f"matches {said} scope")]
    matched = F.lit(False)
    for scope in asked:
        value, said = SCOPE_NAMES[scope]
        rows += [_row(6, ~matched & (F.col("scope") == value), 10, f"matches {said} scope")]
        matched = matched | (F.col("scope") == value)
    if set(words) & set(DATA_WORDS):
        schema = F.lower("path").rlike(r"(^|/)(schema|migrations?)\b|\.prisma\z")
        stored = F.col("scope") == "database"
        live = (F.size("exports") > 0) | (F.col("import_text") != "")
        rows += [_row(7, stored & schema, -35, "database schema is less relevant to runtime data access"), _row(7, stored & ~schema & live, 20, "matches runtime data access")]
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<place:int,points:int,reason:string>>")


def _has_any(values: Column, words: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, words))) if words else F.lit(False)


def evidence_rows(index: DataFrame, analyses: DataFrame, features: DataFrame, routes: DataFrame, entry_points: DataFrame, question: str, expanded: list[str]) -> DataFrame:
    """(project_id, path, place, points, reason): all that speaks for a file, from its own row, features, routes, entry points."""
    words, both = keywords(question), ["project_id", "path"]
    every = [*words, *expanded]
    seen = index.join(analyses.select(*both, "imports"), both)
    seen = seen.withColumns({
        "path_terms": split_terms(F.col("path")), "export_terms": F.flatten(F.transform("exports", split_terms)), "export_text": F.lower(F.array_join("exports", " ")),
        "import_text": F.lower(F.array_join("imports", " ")), "feature_words": F.flatten(F.transform("features", split_terms)),
    })
    rows = seen.select(*both, F.explode(_own_evidence(words, expanded, scopes(question))).alias("e")).select(*both, "e.*")
    action = [w for terms in V.INTENTS.values() for w in terms]
    named = F.filter(split_terms(F.col("name")), lambda w: (F.length(w) > 1) & ~w.isin(V.STOP_WORDS + action))
    grouped = [(F.arrays_overlap(named, F.array(*map(F.lit, g))), g) for g in V.CONCEPTS]
    by_name = reduce(lambda a, b: a | b, [F.lit(False), *[holds for holds, g in grouped if set(g) & set(every)]], _has_any(named, every))
    by_term = _has_any(F.col("search_terms"), every)
    structural = F.col("name").isin("CLI Commands", "Documentation", "Web Landing") & ~by_name
    members = features.filter(~structural & (by_name | by_term)).select(
        "project_id", F.explode(F.array_union("files", "evidence")).alias("path"), F.lit(2).alias("place"), F.when(by_term, FEATURE_TERM).otherwise(FEATURE_NAME).alias("points"),
        F.concat(F.lit("evidence for "), "name").alias("reason"),
    )
    spoken = F.lower(F.concat_ws(" ", "route", F.array_join(F.coalesce("methods", F.array().cast("array<string>")), " ")))
    hit = reduce(lambda a, b: a | b, [F.contains(spoken, F.lit(w)) for w in every], F.lit(False))
    routed = routes.filter(hit).select("project_id", F.col("file").alias("path"), F.lit(3).alias("place"), F.lit(ROUTE).alias("points"), F.concat(F.lit("handles route "), "route").alias("reason"))
    out = rows.unionByName(members).unionByName(routed)
    if set(every) & set(ENTRY_WORDS):
        out = out.unionByName(entry_points.select(*both, F.lit(4).alias("place"), F.lit(ENTRY).alias("points"), F.lit("project entry point").alias("reason")))
    known = index.select(*both) if set(tokens(question)) & set(TEST_WORDS) else index.select(*both).filter(~F.lower("path").rlike(TEST_PATH))
    return out.join(known, both, "left_semi")


def ranked(index: DataFrame, analyses: DataFrame, edges: DataFrame, features: DataFrame, routes: DataFrame, entry_points: DataFrame, critical: DataFrame, question: str, expanded: list[str] | None = None) -> DataFrame:
    """(project_id, path, score, confidence, reasons, rank): the best files of every project, all evidence fused.

    index is of file_index.full. Points of all tables are summed in one aggregation with their reasons in order; critical and
    important files gain a little, neighbours of the best take a share unless the question asks where something is or for a
    change, when two files will do.
    """
    both = ["project_id", "path"]
    rows = evidence_rows(index, analyses, features, routes, entry_points, question, expanded or [])
    summed = rows.groupBy(*both).agg(F.sum("points").cast("long").alias("score"), F.array_sort(F.collect_list(F.struct("place", "reason"))).alias("r"))
    summed = summed.filter("score > 0").join(critical.select(*both, F.col("score").alias("critical")), both, "left").join(index.select(*both, "importance"), both)
    boost = F.coalesce(F.least(F.ceil(F.col("critical") / 3), F.lit(15)), F.lit(0)) + F.least(F.ceil(F.col("importance") / 10), F.lit(10))
    why = F.concat(F.col("r")["reason"], F.array_compact(F.array(F.when(F.col("critical").isNotNull(), "critical project file"), F.when(F.col("importance") > 0, "important snapshot file"))))
    direct = written(summed.select(*both, (F.col("score") + boost).cast("long").alias("score"), F.array_distinct(why).alias("reasons"), F.lit(1).alias("direct")))
    focused = intent(question) in ("add_feature", "change", "navigate")
    scored = direct
    if not focused:
        best = top_per_project(direct, BEST_NEIGHBOURS, F.desc("score"), "path").select("project_id", F.col("path").alias("best"), "score")
        known = index.select(*both) if set(tokens(question)) & set(TEST_WORDS) else index.select(*both).filter(~F.lower("path").rlike(TEST_PATH))
        share = lambda n: F.greatest(F.lit(LEAST).cast("long"), F.floor(F.col("score") / n)).alias("score")
        used = edges.join(best, (edges["project_id"] == best["project_id"]) & (edges["src"] == best["best"])).select(best["project_id"], F.col("dst").alias("path"), share(4), F.array(F.concat(F.lit("imported by relevant file "), "best")).alias("reasons"))
        users = edges.join(best, (edges["project_id"] == best["project_id"]) & (edges["dst"] == best["best"])).select(best["project_id"], F.col("src").alias("path"), share(5), F.array(F.concat(F.lit("imports relevant file "), "best")).alias("reasons"))
        near = used.unionByName(users).distinct().join(known, both, "left_semi").withColumn("direct", F.lit(0))
        every = direct.unionByName(near).groupBy(*both).agg(F.max("score").alias("score"), F.max("direct").alias("direct"), F.array_sort(F.collect_list(F.struct((-F.col("direct")).alias("d"), "reasons"))).alias("r"))
        scored = every.select(*both, "score", F.array_distinct(F.flatten(F.col("r")["reasons"])).alias("reasons"), "direct")
    kept = top_per_project(scored.filter(F.col("score") >= LEAST), FOCUSED if focused else MOST, F.desc("score"), F.desc("direct"), F.expr("path COLLATE UNICODE"), "path")
    return kept.select(*both, "score", search.confidence(F.col("score")).alias("confidence"), "reasons", "rank")
