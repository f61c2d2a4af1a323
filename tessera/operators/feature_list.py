"""The features of every project: what roles, signals, capabilities, entities and pages propose, merged in that order.

Each producer gives rows (project_id, part, at, name, purpose, files, entry_points, search_terms, confidence); part and at
set the order in which the fold of ``features`` takes a project's candidates. Proposals are cut to a few files by windows
that Spark prunes in each task, so neither a large project nor a common signal gathers its files in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence, paths, text
from ..functions import vocabulary as V
from . import detectors, entities, features, graph, ranking, signals

# Names, roles and terms of features that files' roles alone show; purposes are our own words.
ROLES = [
    ("Documentation", "documentation", "Explains the project to its readers: guides, references, readme files.", ["documentation", "docs", "guide", "reference", "api", "wiki"]),
    ("Web Landing", "landing-ui", "Presents the product to visitors: landing pages and their sections.", ["web", "landing", "marketing", "hero", "ui", "homepage"]),
    ("CLI Commands", "cli-command", "Runs commands from a terminal: entry files and what each command does.", ["cli", "command", "bin", "argv", "commander", "yargs"]),
]
# What signals' features do.
SIGNAL_PURPOSES = {
    "Authentication": "Says who a user is and what they may do.",
    "Payments": "Takes payments and keeps track of what was billed.",
    "File Upload": "Receives files and stores them.",
    "Email": "Writes and sends mail.",
    "AI Integration": "Asks language models and uses their answers.",
    "Notifications": "Tells users that something happened.",
    "Caching": "Keeps results at hand that are costly to get.",
    "Search": "Finds records by words and filters.",
    "Background Jobs": "Does work later, in queues or on a schedule.",
    "Logging & Monitoring": "Records what the program does and what goes wrong.",
    "Testing": "Tests the program.",
    "Internationalization": "Speaks the user's language.",
    "Analytics": "Measures how the product is used.",
    "Rate Limiting": "Turns away requests that come too often.",
    "CMS & Content": "Edits and serves structured content.",
}
# What capabilities do.
CAPABILITY_PURPOSES = {
    "sharing": "Lets others see content by a link.",
    "collaboration": "Lets several people work in one place.",
    "discovery": "Shows content that anyone may browse.",
    "publishing": "Decides what content is public.",
    "social": "Lets people react to each other's content.",
    "file-management": "Receives and serves media files.",
    "real-time": "Pushes changes to clients as they happen.",
    "search": "Answers searches over the content.",
    "reporting": "Sums up usage in figures and reports.",
}
# Entities of sign-in libraries and of bookkeeping, and endings of parts of another entity.
INFRASTRUCTURE = [
    "Account", "Session", "VerificationToken", "VerificationCode", "Authenticator", "PasswordResetToken", "RefreshToken", "OAuthToken",
    "OAuthAccount", "AuditLog", "ActivityLog", "EventLog",
]
PART_OF = r"(Item|Entry|Detail|Line|Row|Part|Step|Variant|Option)\z"
AUTH_TERMS = ["auth", "authentication", "login", "session", "jwt", "next-auth"]
# Page folders that name no feature.
NO_PAGE = ["auth", "oauth", "callback", "api", "static", "assets", "public"]
# How client routers pair a path with a component: elements, objects, lazy imports, and a map of hash routes.
CLIENT_ROUTES = [
    r"<Route\s+[^>]*?path=[\"'`]([^\"'`]+)[\"'`][^>]*?element=\{<(\w+)",
    r"<Route\s+[^>]*?path=[\"'`]([^\"'`]+)[\"'`][^>]*?component=\{?(\w+)",
    r"\{\s*path:\s*[\"'`]([^\"'`]+)[\"'`][^}]*?element:\s*<(\w+)",
    r"\{\s*path:\s*[\"'`]([^\"'`]+)[\"'`][^}]*?Component:\s*(\w+)",
    r"\{\s*path:\s*[\"'`]([^\"'`]+)[\"'`][^}]*?component:\s*(\w+)\s*[,}]",
]
LAZY_ROUTE = r"\{\s*path:\s*[\"'`]([^\"'`]+)[\"'`][^}]*?component:\s*\(\)\s*=>\s*import\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)"
HASH_ROUTE = r"[\"'`](/[^\"'`]*)[\"'`]\s*:\s*(\w+)"
HASH_ROUTER = r"from\s+[\"']svelte-spa-router[\"']|require\(\s*[\"']svelte-spa-router[\"']\s*\)"
PARTS = ["project_id", "part", "at", "name", "purpose", "files", "entry_points", "search_terms", "confidence"]
UNICODE = "path COLLATE UNICODE"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _nth(values: list, at: str) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.col(at) + 1)


def _backed(file: Column) -> Column:
    return paths.tier(file).isin("primary", "supporting")


def best_entries(files: Column) -> Column:
    """The two files that one would best start from, if any are fit."""
    ranked = F.transform(files, lambda f, i: F.struct(paths.entry_rank(f).alias("rank"), i.alias("at"), f.alias("path")))
    fit = F.array_sort(F.filter(ranked, lambda r: (r["rank"] < 90) & _backed(r["path"])))
    return F.transform(F.slice(fit, 1, 2), lambda r: r["path"])


def _first_files(shown: DataFrame, most: int) -> DataFrame:
    """shown(project_id, at, priority, path, confidence) to (project_id, at, files, grade): the first by priority and path."""
    order = Window.partitionBy("project_id", "at").orderBy("priority", F.expr(UNICODE), "path")
    kept = shown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    sums = kept.groupBy("project_id", "at").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("f"), F.count_if(F.col("confidence") == "high").alias("strong"))
    return sums.select("project_id", "at", F.col("f")["path"].alias("files"), ranking.grade(F.col("strong"), F.size("f")).alias("confidence"))


def by_role(files: DataFrame, analyses: DataFrame, most: int = 12) -> DataFrame:
    """Documentation, landing pages and commands."""
    path, role = F.col("path"), paths.role(F.col("path"))
    scoped = files.filter(paths.is_production(path) & evidence.is_evidence(path)).select("project_id", "path")
    holds = [(role == r) & (evidence.is_document(path) if n == "Documentation" else F.lit(True)) for n, r, _, _ in ROLES]
    holds[2] = holds[2] | F.lower("path").rlike(r"(^|/)src/index\.[cm]?[jt]s\z")
    shown = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(i).alias("at"), evidence.priority(ROLES[i][0], path).alias("priority"))) for i, h in enumerate(holds)]))
    each = scoped.select("project_id", "path", F.explode(shown).alias("s")).select("project_id", "path", "s.*")
    found = _first_files(each.join(analyses.select("project_id", "path", "confidence"), ["project_id", "path"], "left"), most)
    return found.select(
        "project_id", F.lit(0).alias("part"), "at", _nth([r[0] for r in ROLES], "at").alias("name"), _nth([r[2] for r in ROLES], "at").alias("purpose"), "files",
        best_entries(F.col("files")).alias("entry_points"), _nth([_strings(r[3]) for r in ROLES], "at").alias("search_terms"), "confidence",
    )


def by_signal(files: DataFrame, analyses: DataFrame, most: int = 5) -> DataFrame:
    """Features that words in paths and imports show, in enough of their first files."""
    path = F.col("path")
    shown = signals.shown(files.filter(evidence.is_evidence(path) & ~evidence.is_vocabulary(path)), analyses)
    placed = F.coalesce(*[F.when(F.col("ord") == i, evidence.priority(n, path)) for i, (n, _, _) in enumerate(V.FEATURES)])
    each = shown.select("project_id", F.col("ord").alias("at"), placed.alias("priority"), "path")
    found = _first_files(each.join(analyses.select("project_id", "path", "confidence"), ["project_id", "path"], "left"), most)
    least, backed = _nth([n for _, n, _ in V.FEATURES], "at"), F.size(F.filter("files", _backed))
    terms = [_strings(t or V.AI_TERMS) for _, _, t in V.FEATURES]
    return found.filter((least == 1) | (backed >= least)).select(
        "project_id", F.lit(1).alias("part"), "at", _nth([n for n, _, _ in V.FEATURES], "at").alias("name"), _nth([SIGNAL_PURPOSES[n] for n, _, _ in V.FEATURES], "at").alias("purpose"),
        "files", best_entries(F.col("files")).alias("entry_points"), _nth(terms, "at").alias("search_terms"), "confidence",
    )


def capabilities(routes: DataFrame, names: DataFrame) -> DataFrame:
    """(project_id, at, kind, name, entities, evidence, confidence): one of each kind; names(project_id, entity) are known.

    All resources that are read or written make one capability, named after the first.
    """
    made = detectors.crud(routes).withColumn("one", text.resource_name(F.col("resource")))
    known = names.groupBy("project_id", F.lower("entity").alias("low")).agg(F.min("entity").alias("entity"))
    for key, out in (("resource", "direct"), ("one", "single")):
        made = made.join(known.select("project_id", F.col("low").alias(key), F.col("entity").alias(out)), ["project_id", key], "left")
    made = made.withColumn("entity", F.coalesce("direct", "single", text.capitalise(F.col("one"))))
    sums = made.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seen", "resource", "entity", "evidence"))).alias("all"), F.max(F.col("confidence") == "high").alias("full"))
    every, files = F.array_distinct(F.col("all")["entity"]), F.array_distinct(F.flatten(F.col("all")["evidence"]))
    crud = sums.select(
        "project_id", F.lit(0).alias("at"), F.lit("crud").alias("kind"), F.concat(F.col("all")[0]["entity"], F.lit(" Management")).alias("name"), every.alias("entities"),
        F.when(F.size("all") > 1, F.slice(files, 1, 5)).otherwise(files).alias("evidence"), F.when(F.col("full"), "high").otherwise("medium").alias("confidence"),
    )
    at = F.array_position(_strings([b[0] for b in V.BEHAVIOURS]), F.col("kind")).cast("int")
    shown = signals.behaviours(routes).select("project_id", at.alias("at"), "kind", "name", F.array().cast("array<string>").alias("entities"), "evidence", "confidence")
    return crud.unionByName(shown)


def by_capability(found: DataFrame) -> DataFrame:
    """Capabilities with a file to start from, or of high confidence."""
    about = F.when(F.size("entities") > 0, F.array_join("entities", ", ")).otherwise("resources")
    purpose = F.when(F.col("kind") == "crud", F.concat(F.lit("Reads and changes "), about, F.lit(".")))
    for kind, said in CAPABILITY_PURPOSES.items():
        purpose = purpose.when(F.col("kind") == kind, said)
    terms = F.array_distinct(F.concat(F.array("kind"), F.transform("entities", lambda e: F.lower(e))))
    rows = found.withColumn("entry_points", best_entries(F.col("evidence"))).filter((F.size("entry_points") > 0) | (F.col("confidence") == "high"))
    return rows.select("project_id", F.lit(2).alias("part"), "at", "name", purpose.alias("purpose"), F.col("evidence").alias("files"), "entry_points", terms.alias("search_terms"), "confidence")


def _named_files(files: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """names(project_id, entity) to (project_id, entity, files): files that share a word of a path segment with a name."""
    path = F.col("path")
    plain = paths.is_production(path) & evidence.is_evidence(path) & ~F.lower("path").rlike(r"\.(sql|lock|log)(\.[^/]+)?\z") & ~(F.lower("path").rlike(r"\.md\z") & ~F.lower("path").contains("/docs/"))
    stems = F.transform(F.split(F.lower("path"), r"[/\\]"), lambda s: F.regexp_replace(s, r"\.[^/.]+$", ""))
    words = F.flatten(F.transform(stems, lambda s: F.split(s, "[^a-z0-9]+")))
    tokens = files.filter(plain).select("project_id", "path", F.explode(F.array_distinct(F.concat(stems, words))).alias("token")).filter("token <> ''")
    low = F.lower("entity")
    wanted = names.select("project_id", "entity", F.explode(F.array_distinct(F.concat(F.array(low), F.split(low, "[^a-z0-9]+")))).alias("token"))
    hits = tokens.join(wanted, ["project_id", "token"]).select("project_id", "entity", "path").distinct()
    late = F.when(path.rlike(r"\.prisma\z"), 50).when(path.rlike("/migrations?/"), 100).otherwise(0)
    order = Window.partitionBy("project_id", "entity").orderBy(late, F.expr(UNICODE), "path")
    kept = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    sums = kept.groupBy("project_id", "entity").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("f"))
    return sums.select("project_id", "entity", F.col("f")["path"].alias("files"))


def by_entity(files: DataFrame, fields: DataFrame, others: DataFrame, most: int = 8) -> DataFrame:
    """Entities of the schema, those with relations; or, without a schema, others(project_id, entity, files, seen).

    The first ``most`` entities in order of declaration are looked at; then those drop out that belong to one other alone, and bookkeeping.
    """
    relations = graph.written(entities.graph_relations(fields))
    many = relations.filter("kind = 'one-to-many'")
    parents = many.groupBy("project_id", F.col("dst").alias("entity")).agg(F.count("*").alias("parents"))
    children = many.select("project_id", F.col("src").alias("entity"), F.lit(True).alias("owns")).distinct()
    parts = parents.join(children, ["project_id", "entity"], "left").filter((F.col("parents") == 1) & (F.col("owns").isNull() | F.col("entity").rlike(PART_OF))).select("project_id", "entity")
    parts = graph.written(parts)
    ends = relations.select("project_id", F.explode(F.array("src", "dst")).alias("entity")).distinct()
    declared = fields.groupBy("project_id", "entity").agg(F.min(F.struct("seen.path", "seen.at", F.lit(0).alias("place"))).alias("seen"))
    every = ends.join(declared, ["project_id", "entity"]).withColumn("prisma", F.lit(True))
    every = every.unionByName(others.select("project_id", "entity", "seen", F.lit(False).alias("prisma")))
    first = ranking.top_per_project(every, most, "seen", "entity").withColumnRenamed("rank", "at")
    kept = first.filter(~F.col("entity").isin(INFRASTRUCTURE)).join(parts, ["project_id", "entity"], "left_anti")
    told = relations.join(parts.withColumnRenamed("entity", "dst"), ["project_id", "dst"], "left_anti").filter(~F.col("dst").isin(INFRASTRUCTURE))
    back = relations.filter("kind = 'many-to-many'").select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    back = back.join(parts.withColumnRenamed("entity", "dst"), ["project_id", "dst"], "left_anti").filter(~F.col("dst").isin(INFRASTRUCTURE))
    each = told.unionByName(back).withColumn("place", F.array_position(_strings(["one-to-many", "one-to-one", "many-to-many"]), F.col("kind")))
    sums = each.groupBy("project_id", F.col("src").alias("entity")).agg(
        F.array_sort(F.collect_set(F.when(F.col("place") < 3, F.struct("place", "dst")))).alias("o"), F.array_sort(F.collect_set(F.when((F.col("place") == 3) & (F.col("dst") != F.col("src")), F.col("dst")))).alias("peers")
    )
    sums = sums.select("project_id", "entity", F.array_distinct(F.col("o")["dst"]).alias("own"), "peers")
    none = F.array().cast("array<string>")
    unnamed = kept.join(others.filter("files IS NOT NULL"), ["project_id", "entity"], "left_anti").select("project_id", "entity")
    named = _named_files(files, unnamed).unionByName(others.filter("files IS NOT NULL").select("project_id", "entity", "files"))
    rows = kept.join(sums, ["project_id", "entity"], "left").join(named, ["project_id", "entity"])
    rows = rows.withColumn("own", F.coalesce("own", none)).withColumn("peers", F.coalesce("peers", none))
    owned, peers = F.array_join("own", ", "), F.array_join("peers", ", ")
    head = F.concat(F.lit("Manages "), "entity")
    purpose = F.when((F.size("own") > 0) & (F.size("peers") > 0), F.concat(head, F.lit(" (including "), owned, F.lit(") and its associations with "), peers, F.lit(".")))
    purpose = purpose.when(F.size("own") > 0, F.concat(head, F.lit(" and its owned items: "), owned, F.lit("."))).when(F.size("peers") > 0, F.concat(head, F.lit(" and its associations with "), peers, F.lit(".")))
    lowered = F.transform(F.concat(F.array("entity"), "own", "peers"), lambda e: F.lower(e))
    alone = (F.size("files") == 1) & (paths.tier(F.col("files")[0]) == "reference")
    return rows.select(
        "project_id", F.lit(3).alias("part"), "at", F.concat("entity", F.lit(" Management")).alias("name"), purpose.otherwise(F.concat(head, F.lit(" data and operations."))).alias("purpose"), "files",
        best_entries(F.col("files")).alias("entry_points"), F.array_distinct(F.concat(lowered, _strings(["management", "crud"]))).alias("search_terms"),
        F.when(alone, "low").when(F.col("prisma"), "high").otherwise("medium").alias("confidence"),
    )


def _by_segment(pages: DataFrame, edges: DataFrame, part: int, noun: str, counted: str, dynamic: str) -> DataFrame:
    """pages(project_id, route, path) by the first folder of the route, with all files that only these pages reach."""
    segment = F.try_element_at(F.filter(F.split("route", "/"), lambda s: s != ""), F.lit(1))
    pages = pages.withColumn("name", segment).filter(F.col("name").isNotNull() & ~F.col("name").rlike(dynamic) & ~F.lower("name").isin(NO_PAGE))
    pages = graph.written(pages.select("project_id", "name", "route", "path"))
    own = graph.owned_by_name(edges, pages).groupBy("project_id", "name").agg(F.array_sort(F.collect_set("path")).alias("files"))
    seeds = pages.groupBy("project_id", "name").agg(F.array_sort(F.collect_set("path")).alias("seeds"), F.count_distinct(counted).alias("n"))
    one = text.entity_name(F.col("name"))
    purpose = F.concat(F.lit(noun), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(' under "'), "name", F.lit('".'))
    at = F.row_number().over(Window.partitionBy("project_id").orderBy("name"))
    return own.join(seeds, ["project_id", "name"]).select(
        "project_id", F.lit(part).alias("part"), at.alias("at"), one.alias("name"), purpose.alias("purpose"), "files", F.slice("seeds", 1, 2).alias("entry_points"),
        F.array_distinct(F.array(F.lower("name"), F.lower(one))).alias("search_terms"), F.lit("medium").alias("confidence"),
    )


def by_page(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Features of page routes; folders in brackets name none."""
    pages = routes.filter("kind = 'page'").select("project_id", "route", F.col("file").alias("path"))
    return _by_segment(pages, edges, 4, "Frontend page", "route", r"^\[")


def client_routes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, route, path): routes that scripts declare for a component, with the component's file.

    A named component is the imported file of that name; a lazily imported one is found as any import is.
    """
    own = files.filter(paths.is_production(F.col("path"))).select("project_id", F.col("path").alias("src"), "content")
    pairs = [F.arrays_zip(F.regexp_extract_all("content", F.lit(p), 1).alias("route"), F.regexp_extract_all("content", F.lit(p), 2).alias("target")) for p in CLIENT_ROUTES]
    hash_map = F.arrays_zip(F.regexp_extract_all("content", F.lit(HASH_ROUTE), 1).alias("route"), F.regexp_extract_all("content", F.lit(HASH_ROUTE), 2).alias("target"))
    pairs.append(F.when(F.col("content").rlike(HASH_ROUTER), hash_map).otherwise(F.slice(hash_map, 1, 0)))
    named = own.select("project_id", "src", F.explode(F.concat(*pairs)).alias("c")).select("project_id", "src", "c.route", F.lower("c.target").alias("target"))
    stem = F.lower(F.regexp_replace(paths.file_name(F.col("dst")), r"\.[^/.]+$", ""))
    imported = edges.select("project_id", "src", "ord", "dst", stem.alias("target"))
    by_name = named.join(imported, ["project_id", "src", "target"]).groupBy("project_id", "src", "route", "target").agg(F.min_by("dst", F.struct("ord", "dst")).alias("path"))
    lazy = F.arrays_zip(F.regexp_extract_all("content", F.lit(LAZY_ROUTE), 1).alias("route"), F.regexp_extract_all("content", F.lit(LAZY_ROUTE), 2).alias("specifier"))
    late = own.select("project_id", F.col("src").alias("path"), F.posexplode(lazy).alias("ord", "c")).select("project_id", "path", "ord", "c.route", "c.specifier")
    found = graph.resolve_imports(files.select("project_id", "path"), late.select("project_id", "path", "ord", "specifier"))
    by_file = late.withColumnRenamed("path", "src").join(found.select("project_id", "src", "ord", "dst"), ["project_id", "src", "ord"])
    return by_name.select("project_id", "route", "path").unionByName(by_file.select("project_id", "route", F.col("dst").alias("path"))).distinct()


def by_client_route(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Features of routes that the browser resolves; parameters and wildcards name none."""
    return _by_segment(client_routes(files, edges), edges, 5, "Client-side route", "path", r"^[:*]")


def auth_files(files: DataFrame, analyses: DataFrame, flags: DataFrame) -> DataFrame:
    """(project_id, path, priority, confidence) of files that have a part in authentication; flags(project_id, path, said)."""
    path, role = F.col("path"), paths.role(F.col("path"))
    scoped = files.filter(paths.is_production(path) & evidence.is_evidence(path) & ~evidence.is_analyzer(path) & ~role.isin("test", "documentation", "config", "ai-integration"))
    both = scoped.select("project_id", "path").join(analyses.select("project_id", "path", "symbols", "imports", "confidence"), ["project_id", "path"]).join(flags, ["project_id", "path"])
    part = evidence.auth_role(path, F.col("symbols")["name"], F.col("imports"), F.col("said"))
    return both.filter(part.isNotNull()).select("project_id", "path", evidence.auth_priority(path).alias("priority"), "confidence")


def with_auth(merged: DataFrame, found: DataFrame) -> DataFrame:
    """Authentication takes in all files that have a part in it, in their order; it is made where there are such files."""
    order = F.array_sort(F.collect_list(F.struct("priority", "path")))
    sums = found.groupBy("project_id").agg(order.alias("a"), F.count_if(F.col("confidence") == "high").alias("strong"))
    mine = F.col("name") == "Authentication"
    both = merged.filter(mine).join(sums, "project_id", "full_outer")
    auth = F.coalesce(F.col("a")["path"], F.array().cast("array<string>"))
    union = F.array_distinct(F.concat(F.coalesce("files", F.array().cast("array<string>")), auth))
    placed = F.array_sort(F.transform(union, lambda f: F.struct(evidence.auth_priority(f).alias("priority"), f.alias("path"))))
    ordered = F.transform(placed, lambda r: r["path"])
    graded = ranking.grade(F.coalesce("strong", F.lit(0)), F.size(union))
    changed = F.col("a").isNotNull()
    rows = both.select(
        "project_id", F.coalesce("ord", F.lit(0)).alias("ord"), F.lit("Authentication").alias("name"), F.coalesce("purpose", F.lit("Identifies authentication capability in the project.")).alias("purpose"),
        F.when(changed, ordered).otherwise(F.col("files")).alias("files"), F.coalesce("entry_points", best_entries(ordered)).alias("entry_points"),
        F.coalesce("search_terms", _strings(AUTH_TERMS)).alias("search_terms"), F.when(changed, ordered).otherwise(F.col("evidence")).alias("evidence"),
        F.coalesce("business_flow", F.array().cast("array<string>")).alias("business_flow"), F.when(changed, graded).otherwise(F.col("confidence")).alias("confidence"),
    )
    return merged.filter(~mine).unionByName(rows)


def routed_imports(each: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """each(project_id, name, path) to (project_id, name, routed): the file of the first route that imports a feature's file."""
    at = F.struct(F.collate("route", "UNICODE").alias("route"), F.col("file").alias("file"))
    starts = routes.groupBy("project_id", F.col("file").alias("src")).agg(F.min(at).alias("at"))
    used = edges.join(starts, ["project_id", "src"]).select("project_id", F.col("dst").alias("path"), "at")
    return each.join(used, ["project_id", "path"]).groupBy("project_id", "name").agg(F.min("at").alias("at")).select("project_id", "name", F.col("at.file").alias("routed"))


def with_entries(rows: DataFrame, analyses: DataFrame, routes: DataFrame, entry_points: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points become the feature's files that are a route's or the project's; with a file read in full beside
    another, or an entry point, confidence is high. Without such a file, the first route that imports one is the entry point."""
    each = rows.select("project_id", "name", F.explode("files").alias("path"))
    starts = routes.select("project_id", F.col("file").alias("path")).unionByName(entry_points.select("project_id", "path")).distinct().withColumn("starts", F.lit(True))
    sure = analyses.filter("confidence = 'high'").select("project_id", "path", F.lit(True).alias("sure"))
    sums = each.join(starts, ["project_id", "path"], "left").join(sure, ["project_id", "path"], "left").groupBy("project_id", "name").agg(
        F.array_sort(F.collect_set(F.when(F.col("starts"), F.col("path")))).alias("related"), F.max(F.coalesce("sure", F.lit(False))).alias("sure")
    )
    both = rows.join(sums, ["project_id", "name"], "left").join(routed_imports(each, routes, edges), ["project_id", "name"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    high = F.col("sure") & ((F.size("files") >= 2) | (F.size("related") > 0))
    api = F.try_element_at(F.filter("related", lambda f: f.rlike("(^|/)api/")), F.lit(1))
    config = F.try_element_at(F.filter("files", lambda f: evidence.auth_priority(f) == 20), F.lit(1))
    own = F.when(F.col("name") == "Authentication", F.coalesce(api, config))
    entry = F.coalesce(own, F.try_element_at("related", F.lit(1)), F.col("routed"), F.try_element_at("files", F.lit(1)))
    return both.withColumn("confidence", F.when(high, "high").otherwise(F.col("confidence"))).select(
        "project_id", "name", "purpose", "files", entry.alias("entry_point"), F.col("related").alias("entry_points"), "search_terms", "evidence", "confidence"
    )


def detect(files: DataFrame, analyses: DataFrame, edges: DataFrame, routes: DataFrame, fields: DataFrame, entry_points: DataFrame, flags: DataFrame) -> DataFrame:
    """(project_id, name, purpose, files, entry_point, entry_points, search_terms, evidence, confidence) of all projects."""
    found = graph.written(entities.extract(files, fields, routes))
    every = by_role(files, analyses).select(PARTS)
    for more in (by_signal(files, analyses), by_capability(capabilities(routes, found)), by_entity(files, fields, found.filter("source <> 'prisma'")), by_page(routes, edges), by_client_route(files, edges)):
        every = every.unionByName(more.select(PARTS))
    terms = F.array_distinct(F.transform("search_terms", lambda t: F.lower(t)))
    ready = every.withColumn("search_terms", terms).withColumn("ord", F.col("part") * 1_000_000 + F.col("at")).withColumn("evidence", F.col("files"))
    merged = graph.written(features.merge(ready.withColumn("business_flow", F.array().cast("array<string>")), apart=1_000_000))
    return with_entries(graph.written(with_auth(merged, auth_files(files, analyses, flags))), analyses, routes, entry_points, edges)
