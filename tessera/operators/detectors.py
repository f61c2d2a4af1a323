"""Facts about projects: frameworks, database, language, routes, CRUD capabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .ranking import dominant

# Dependencies and paths that show a framework; the first of each list that is found wins.
FRONTEND = ["nextjs", "nuxt", "sveltekit", "astro", "react", "vue", "svelte"]
BACKEND = ["nestjs", "fastify", "express", "koa"]
BY_DEPENDENCY = [
    ("nextjs", ["next"]), ("express", ["express"]), ("astro", ["astro"]), ("nuxt", ["nuxt"]), ("fastify", ["fastify"]),
    ("nestjs", ["@nestjs/core", "@nestjs/common"]), ("sveltekit", ["@sveltejs/kit"]),
]
#: Framework, its library, packages of which one must be there, packages of which none may be.
BY_RUNTIME = [
    ("react", "react", ["react-dom", "react-scripts", "@vitejs/plugin-react", "@vitejs/plugin-react-swc"], ["next", "astro"]),
    ("vue", "vue", ["@vitejs/plugin-vue", "@vitejs/plugin-vue2", "vue-cli-service"], ["nuxt"]),
    ("svelte", "svelte", ["@sveltejs/vite-plugin-svelte"], ["@sveltejs/kit"]),
]
#: Framework, pattern, whether only production sources count.
BY_PATH = [
    ("nextjs", r"(^|/)next\.config\.[cm]?[jt]s\z", False),
    ("nextjs", r"(^|/)(src/)?app/(.+/)?(page|layout|route)\.[jt]sx?\z|(^|/)(src/)?pages/(_app|_document)", True),
    ("astro", r"(^|/)src/pages/.+\.astro\z", True),
    ("nuxt", r"(^|/)nuxt\.config\.[cm]?[jt]s\z", False),
    ("vue", r"(^|/)(src/)?App\.vue\z", True),
    ("sveltekit", r"(^|/)src/routes/.+\+page\.svelte\z", True),
    ("nestjs", r"(^|/)nest-cli\.json\z", False),
]
DATABASES = [
    ("Prisma", ["@prisma/client", "prisma"], r"(^|/)schema\.prisma\z|(^|/)prisma/"),
    ("Drizzle", ["drizzle-orm"], r"(^|/)drizzle\.config\.[cm]?[jt]s\z|(^|/)drizzle/"),
    ("Mongoose", ["mongoose"], r"(^|/)(models?|schemas?)/"),
    ("Supabase", ["@supabase/supabase-js"], r"(^|/)supabase/"),
    ("PostgreSQL (raw SQL)", ["pg", "pg-promise"], None),
    ("MySQL (raw SQL)", ["mysql2", "mysql"], None),
    ("SQLite (raw SQL)", ["better-sqlite3", "sqlite3"], None),
]
NO_RESOURCE = [
    "auth", "oauth", "callback", "health", "ping", "status", "public", "internal", "static", "assets", "files", "me", "self",
    "history", "session", "sessions", "dashboard", "settings", "profile", "search",
]
VERBS = r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b"

ROUTES = ["project_id", "route", "file", "kind", "methods"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def manifests(files: DataFrame) -> DataFrame:
    """(project_id, path, names): the lower-case dependencies of each manifest that parses."""
    found = files.filter(F.endswith("path", F.lit("package.json")))
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.array_union(*[F.coalesce(F.map_keys(parsed[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    sound = F.coalesce(F.try_parse_json("content").isNotNull(), F.lit(False))
    return found.filter(sound).select("project_id", "path", F.transform(names, lambda x: F.lower(x)).alias("names"))


def frameworks(files: DataFrame) -> DataFrame:
    """(project_id, frontend, backend): at most one of each kind, null if none."""

    def has(*names: str) -> Column:
        return _any([F.array_contains("names", n) for n in names])

    shown = [F.when(has(*names), F.lit(f)) for f, names in BY_DEPENDENCY]
    shown += [F.when(has(lib) & has(*runtime) & ~has(*without), F.lit(f)) for f, lib, runtime, without in BY_RUNTIME]
    own = manifests(files)
    by_name = own.select("project_id", F.explode(F.array_compact(F.array(*shown))).alias("f"))
    production = paths.is_production(F.col("path"))
    by_path = files.select("project_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col("path").rlike(p) & (production if only else F.lit(True)), F.lit(f)) for f, p, only in BY_PATH
    ]))).alias("f"))
    called = files.filter(production & F.col("content").rlike(r"\bexpress\(\)|require\([\"']express[\"']\)|from\s+[\"']express[\"']"))
    without = called.join(own.filter(production).select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.lit("express").alias("f"))
    every = by_name.unionByName(by_path).unionByName(without).groupBy("project_id").agg(F.collect_set("f").alias("found"))
    projects = files.select("project_id").distinct().join(every, "project_id", "left")

    def first(order: list[str]) -> Column:
        return F.try_element_at(F.filter(F.array(*map(F.lit, order)), lambda f: F.array_contains("found", f)), F.lit(1))

    found = projects.withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return found.select("project_id", first(FRONTEND).alias("frontend"), first(BACKEND).alias("backend"))


def database(files: DataFrame) -> DataFrame:
    """(project_id, provider, files): the first provider with a dependency or a path."""
    scoped = files.filter(paths.is_production(F.col("path"))).select("project_id", "path", "content")
    by_name = manifests(scoped).select("project_id", F.explode("names").alias("name"))
    by_name = by_name.select("project_id", F.explode(F.array_compact(F.array(*[F.when(F.col("name").isin(names), i) for i, (_, names, _) in enumerate(DATABASES)]))).alias("at"), F.lit(None).cast("string").alias("path"))
    by_path = scoped.select("project_id", F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(p), i) for i, (_, _, p) in enumerate(DATABASES) if p]))).alias("at"), "path")
    found = by_name.unionByName(by_path).groupBy("project_id", "at").agg(F.array_sort(F.collect_set("path")).alias("files"))
    best = found.groupBy("project_id").agg(F.min(F.struct("at", "files")).alias("best"))
    return best.select("project_id", F.element_at(F.array(*[F.lit(n) for n, _, _ in DATABASES]), F.col("best.at") + 1).alias("provider"), F.col("best.files").alias("files"))


def language(files: DataFrame) -> DataFrame:
    typed = F.count_if(F.col("extension").isin(".ts", ".tsx", ".mts", ".cts"))
    plain = F.count_if(F.col("extension").isin(".js", ".jsx", ".mjs", ".cjs"))
    sums = files.groupBy("project_id").agg(typed.alias("a"), plain.alias("b"))
    return sums.select("project_id", dominant(F.col("a"), F.col("b"), "typescript", "javascript").alias("language"))


def _methods() -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(VERBS), 1)))


def _segments(text: Column) -> Column:
    return F.filter(F.split(text, "/"), lambda s: s != "")


def _route(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(segments, lambda s: ~s.rlike(r"^[(@]")), "/"))


def _cut_index(segments: Column) -> Column:
    return F.when(F.try_element_at(segments, F.lit(-1)) == "index", F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(segments)


def page_routes(files: DataFrame, framework: str) -> DataFrame:
    """Routes that the file names of nextjs, astro, nuxt or sveltekit projects stand for."""
    own = files.filter(paths.is_production(F.col("path"))).select("project_id", "path", "content")
    none = F.lit(None).cast("array<string>")
    if framework == "nextjs":
        app = r"(?:^|/)(?:src/)?app/(.+/)?(page|route)\.[jt]sx?\z"
        pages = r"(?:^|/)(?:src/)?pages/(.+)\.[jt]sx?\z"
        in_app, kind = F.col("path").rlike(app), F.regexp_extract("path", app, 2)
        page = F.regexp_extract("path", pages, 1)
        found = own.filter(in_app | ((page != "") & ~F.startswith(page, F.lit("_"))))
        segments = F.when(in_app, _segments(F.regexp_extract("path", app, 1))).otherwise(_segments(F.regexp_replace(page, r"/index\z", "")))
        api = F.when(in_app, kind == "route").otherwise(F.startswith(page, F.lit("api/")))
        methods = F.when(in_app & (kind == "route"), _methods())
    elif framework == "astro":
        pattern = r"(?:^|/)src/pages/(.+)\.(astro|md|mdx|[cm]?[jt]s)\z"
        raw = _segments(F.regexp_extract("path", pattern, 1))
        found = own.filter(F.col("path").rlike(pattern) & ~F.exists(raw, lambda s: F.startswith(s, F.lit("_"))))
        segments, api = _cut_index(raw), ~F.regexp_extract("path", pattern, 2).isin("astro", "md", "mdx")
        methods = F.when(api, _methods())
    elif framework == "nuxt":
        pattern = r"(?:^|/)pages/(.+)\.vue\z"
        found = own.filter(F.col("path").rlike(pattern))
        segments, api, methods = _cut_index(_segments(F.regexp_extract("path", pattern, 1))), F.lit(False), none
    else:
        pattern = r"(?:^|/)src/routes/(.*/)?(\+page\.svelte|\+server\.[cm]?[jt]s)\z"
        found = own.filter(F.col("path").rlike(pattern))
        segments = _segments(F.regexp_extract("path", pattern, 1))
        api = F.col("path").rlike(r"\+server\.[cm]?[jt]s\z")
        methods = F.when(api, _methods())
    return found.select("project_id", _route(segments).alias("route"), F.col("path").alias("file"), F.when(api, "api").otherwise("page").alias("kind"), methods.alias("methods"))


# Calls that declare routes, and that hang a router or plugin under a prefix. A mounted router may have any
# name that ends in router.
DIRECT = r"(?i)\b(?:app|router)\.(get|post|put|patch|delete|options|head)\(\s*[\"'`]([^\"'`]+)[\"'`]"
MOUNTED = r"(?i)\b(?:app|\w*router)\.(get|post|put|patch|delete|options|head)\(\s*[\"'`]([^\"'`]+)[\"'`]"
MOUNT = r"\b(?:app|router)\.use\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*(\w+)\s*\)"
FASTIFY = r"(?i)\b(?:fastify|app|server)\.(get|post|put|patch|delete|options|head)\(\s*[\"'`]([^\"'`]+)[\"'`]"
FASTIFY_OBJECT = r"(?s)\.route\(\s*\{[^}]*?method:\s*[\"'`]?(\w+)[\"'`]?[^}]*?url:\s*[\"'`]([^\"'`]+)[\"'`]"
FASTIFY_REGISTER = r"\.register\(\s*(\w+)\s*,\s*\{[^}]*?prefix:\s*[\"'`]([^\"'`]+)[\"'`]"


def _scripts(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_production(F.col("path")) & F.col("path").rlike(r"\.[cm]?[jt]s\z")).select("project_id", F.col("path").alias("file"), "content")


def _calls(scripts: DataFrame, *patterns: str) -> DataFrame:
    """(project_id, file, verb, sub) of all calls that a pattern finds."""
    found = [F.arrays_zip(F.transform(F.regexp_extract_all("content", F.lit(p), 1), lambda v: F.upper(v)).alias("verb"), F.regexp_extract_all("content", F.lit(p), 2).alias("sub")) for p in patterns]
    return scripts.select("project_id", "file", F.explode(F.concat(*found)).alias("c")).select("project_id", "file", "c.verb", "c.sub").distinct()


def _mounts(scripts: DataFrame, pattern: str, prefix: int, name: int) -> DataFrame:
    """(project_id, src, mount, prefix, name) of all mounting calls."""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), prefix).alias("prefix"), F.regexp_extract_all("content", F.lit(pattern), name).alias("name"))
    return scripts.select("project_id", F.col("file").alias("src"), F.posexplode(both).alias("mount", "m")).select("project_id", "src", "mount", "m.prefix", "m.name")


def _targets(mounts: DataFrame, scripts: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """mounts with the imported file that holds the mounted routes: the one that has the mounted name as a word or, if none
    has, the one that declares routes; without routes, or if there is no single one, the mount is left out."""
    imported = edges.select("project_id", "src", F.col("dst").alias("file")).distinct()
    declares = calls.select("project_id", "file").distinct().withColumn("declares", F.lit(True))
    tried = mounts.join(imported, ["project_id", "src"]).join(scripts, ["project_id", "file"]).join(declares, ["project_id", "file"], "left")
    named = F.regexp_like("content", F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b")))
    tried = tried.select(*mounts.columns, "file", named.alias("named"), F.coalesce("declares", F.lit(False)).alias("declares"))
    each = tried.groupBy(*mounts.columns).agg(
        F.count_if("named").alias("n"), F.min(F.when(F.col("named"), F.col("file"))).alias("by_name"), F.count_if("declares").alias("d"), F.min(F.when(F.col("declares"), F.col("file"))).alias("by_routes")
    )
    file = F.when(F.col("n") == 1, F.col("by_name")).when((F.col("n") == 0) & (F.col("d") == 1), F.col("by_routes"))
    return each.select(*mounts.columns, file.alias("file")).join(declares.select("project_id", "file"), ["project_id", "file"])


def _composed(resolved: DataFrame, calls: DataFrame) -> DataFrame:
    """The mounted routes under their prefixes, as routes of the mounting files."""
    under = F.when(F.col("sub").isin("/", ""), F.col("prefix")).otherwise(F.concat(F.regexp_replace("prefix", r"/\z", ""), F.lit("/"), F.regexp_replace("sub", "^/", "")))
    return resolved.join(calls, ["project_id", "file"]).select("project_id", under.alias("route"), F.col("src").alias("file"), "verb")


def _alone(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    return calls.join(resolved.select("project_id", "file"), ["project_id", "file"], "left_anti").select("project_id", F.col("sub").alias("route"), "file", "verb")


def express_routes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of router calls; a mounted router's routes go to the mounting file under the mount's prefix.

    A mount whose router is not found keeps the method USE.
    """
    scripts = _scripts(files)
    mounts, mounted = _mounts(scripts, MOUNT, 1, 2), _calls(scripts, MOUNTED)
    resolved = _targets(mounts, scripts, edges, mounted)
    left = mounts.join(resolved, ["project_id", "src", "mount"], "left_anti").select("project_id", F.col("prefix").alias("route"), F.col("src").alias("file"), F.lit("USE").alias("verb"))
    return _api(_composed(resolved, mounted).unionByName(left).unionByName(_alone(_calls(scripts, DIRECT), resolved)))


def crud(routes: DataFrame) -> DataFrame:
    """(project_id, resource, evidence, seen, confidence) of API routes: high with read, write and delete; seen is its first route."""
    segments = F.filter(_segments(F.col("route")), lambda s: ~F.startswith(s, F.lit("[")) & ~F.lower(s).isin("api", "v1", "v2", "v3"))
    resource = F.lower(F.try_element_at(segments, F.lit(1)))
    named = routes.filter("kind = 'api'").withColumn("resource", resource).filter((F.length("resource") > 2) & ~F.col("resource").isin(NO_RESOURCE))
    sums = named.groupBy("project_id", "resource").agg(
        F.array_sort(F.collect_set("file")).alias("evidence"), F.min(F.struct("route", "file")).alias("seen"), *[F.bool_or(_any([F.array_contains("methods", v) for v in verbs])).alias(n)
        for n, verbs in (("r", ["GET"]), ("w", ["POST", "PUT", "PATCH"]), ("d", ["DELETE"]))]
    )
    return sums.filter("r OR w").select("project_id", "resource", "evidence", "seen", F.when(F.expr("r AND w AND d"), "high").otherwise("medium").alias("confidence"))


# Verbs of the catch-all decorator.
ALL_VERBS = ["DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT"]
NEST_FILE = r"\.[cm]?[jt]s\z"
#: Comments, and strings, which may hold what looks like one.
COMMENT = r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*[\s\S]*?\*/"
NEST_CLASS = r"@Controller\(([^)]*)\)[\s\S]*?(?=@Controller\(|\z)"
NEST_METHOD = r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?"


def _joined(prefix: Column, sub: Column) -> Column:
    parts = F.filter(F.concat(F.split(prefix, "/"), F.split(sub, "/")), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _api(found: DataFrame) -> DataFrame:
    """(project_id, route, file, verb) to routes."""
    every = found.groupBy("project_id", "route", "file").agg(F.array_sort(F.collect_set("verb")).alias("methods"))
    return every.select("project_id", "route", "file", F.lit("api").alias("kind"), "methods")


def nest_routes(files: DataFrame) -> DataFrame:
    """Controller prefix with each method's path; an object or no argument is the empty prefix."""
    scripts = files.filter(F.col("path").rlike(NEST_FILE) & F.contains("content", F.lit("@Controller")))
    own = scripts.select("project_id", F.col("path").alias("file"), F.regexp_replace("content", COMMENT, "$1").alias("content"))
    classes = own.select("project_id", "file", F.explode(F.regexp_extract_all("content", F.lit(NEST_CLASS), 0)).alias("body"))
    prefix = F.regexp_extract(F.regexp_extract("body", NEST_CLASS, 1), r"^\s*[\"'`]([^\"'`]*)[\"'`]", 1)
    verbs, subs = (F.regexp_extract_all("body", F.lit(NEST_METHOD), i) for i in (1, 2))
    each = classes.select("project_id", "file", prefix.alias("prefix"), F.explode(F.arrays_zip(verbs.alias("verb"), subs.alias("sub"))).alias("m"))
    names = F.when(F.col("m.verb") == "All", F.array(*map(F.lit, ALL_VERBS))).otherwise(F.array(F.upper("m.verb")))
    return _api(each.select("project_id", _joined(F.col("prefix"), F.col("m.sub")).alias("route"), "file", F.explode(names).alias("verb")))


def fastify_routes(files: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Routes of verb calls and of route objects; a registered plugin's routes go to the registering file under its prefix.

    Without edges no plugin is found.
    """
    scripts = _scripts(files)
    calls = _calls(scripts, FASTIFY, FASTIFY_OBJECT)
    if edges is None:
        return _api(calls.select("project_id", F.col("sub").alias("route"), "file", "verb"))
    resolved = _targets(_mounts(scripts, FASTIFY_REGISTER, 2, 1), scripts, edges, calls)
    return _api(_composed(resolved, calls).unionByName(_alone(calls, resolved)))


def metadata(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project_id, name, package_manager, types, workspace): from the root manifest, all manifests and the frameworks.

    facts(project_id, fact, value) of sources.tree tell of lock files, which count where no manager is declared, and of the
    folder's name; without them both stay unknown.
    """
    found = files.filter(F.endswith("path", F.lit("package.json")) & F.coalesce(F.try_parse_json("content").isNotNull(), F.lit(False)))
    parsed = F.from_json("content", "name string, bin string, main string, exports string, packageManager string, workspaces string")
    each = found.select("project_id", "path", parsed.alias("m"))
    root = F.col("path") == "package.json"
    sums = each.groupBy("project_id").agg(
        F.count("*").alias("n"), F.max(F.when(root, F.trim("m.name"))).alias("declared"), F.max(F.when(root, F.element_at(F.split("m.packageManager", "@"), 1))).alias("manager"),
        F.bool_or(root & F.col("m.workspaces").isNotNull()).alias("shared"), F.bool_or(F.col("m.bin").isNotNull()).alias("cli"),
        F.bool_or((F.col("m.main").isNotNull() | F.col("m.exports").isNotNull()) & F.col("m.bin").isNull()).alias("library"),
    )
    every = frameworks(files).join(sums, "project_id", "left")
    none = F.lit(None).cast("string")
    if facts is None:
        every = every.withColumns({"lock": none, "folder": none})
    else:
        told = facts.groupBy("project_id").agg(*[F.max(F.when(F.col("fact") == f, F.col("value"))).alias(n) for f, n in (("lock_manager", "lock"), ("folder_name", "folder"))])
        every = every.join(told, "project_id", "left")
    types = F.array_compact(F.array(
        F.when(F.col("frontend").isNotNull(), "web-app"), F.when(F.col("backend").isNotNull(), "api-service"), F.when(F.col("cli"), "node-cli"), F.when(F.col("library"), "library")
    ))
    return every.select(
        "project_id", F.when(F.col("declared") != "", F.col("declared")).otherwise(F.coalesce("folder", "project_id")).alias("name"),
        F.coalesce(F.when(F.col("manager").isin("pnpm", "npm", "yarn", "bun"), F.col("manager")), "lock", F.lit("unknown")).alias("package_manager"),
        F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("unknown"))).alias("types"),
        F.when(F.coalesce("shared", F.lit(False)) | (F.coalesce("n", F.lit(0)) > 1), "monorepo").otherwise("single-package").alias("workspace"),
    )
