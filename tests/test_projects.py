"""Source projects with literal expectations."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import detectors, entities, features, flows, graph, parsing, retrieval, signals
from tessera.plans import engine, maps, snapshot
from tessera.sources import tree

NEXT = {
    "package.json": '{"name": "shop", "dependencies": {"@prisma/client": "1", "next": "1", "react": "1"}}',
    "app/layout.tsx": "export default function Layout() { return null }\n",
    "app/page.tsx": 'import { getSession } from "../lib/auth.js";\nexport default function Page() { return getSession() }\n',
    "app/api/session/route.ts": 'import { getSession } from "../../../lib/auth.js";\n\nexport async function GET() { return getSession() }\n',
    "lib/auth.ts": 'import NextAuth from "next-auth";\nimport { db } from "./db.js";\n\nexport const auth = NextAuth({});\n\nexport async function getSession() { return db.find() }\n',
    "lib/db.ts": 'import { PrismaClient } from "@prisma/client";\nexport const db = new PrismaClient();\n',
    "prisma/schema.prisma": "model User {\n  id String @id\n  todos Todo[]\n}\n\nmodel Todo {\n  id String @id\n  owner User\n}\n",
}
EXPRESS = {
    "package.json": '{"dependencies": {"express": "1"}}',
    "src/server.ts": 'import express from "express";\nimport { paymentsRouter } from "./routes/payments.js";\nconst app = express();\napp.use("/payments", paymentsRouter);\n',
    "src/routes/payments.ts": 'import { Router } from "express";\n\nexport const paymentsRouter = Router();\npaymentsRouter.get("/", list);\npaymentsRouter.post("/:id", pay);\n',
}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def both(spark):
    return tree.from_rows(spark, "next", NEXT).unionByName(tree.from_rows(spark, "express", EXPRESS))


def test_analysis(spark):
    found = engine.analyse(both(spark))
    assert rows(found.references, "project_id", "path", "refs") == [("express", "src/routes/payments.ts", 1), ("next", "lib/auth.ts", 2), ("next", "lib/db.ts", 1)]
    assert rows(found.frameworks, "project_id", "frontend", "backend") == [("express", None, "express"), ("next", "nextjs", None)]
    assert rows(found.databases, "project_id", "provider") == [("next", "Prisma")]
    assert rows(found.languages, "project_id", "language") == [("express", "typescript"), ("next", "typescript")]
    assert ("next", "app/page.tsx") in rows(found.entry_points, "project_id", "path")
    best = found.critical_files.filter("project_id = 'next' AND rank = 1").first()
    assert (best["path"], best["refs"], best["score"], best["reasons"]) == ("app/api/session/route.ts", 0, 17 + 50, ["application entry point", "core project concern", "semantic feature anchor", "framework convention"])
    assert found.file_index.filter("path = 'lib/db.ts'").first()["search_terms"] == ["lib", "db", "ts"]


def test_routes(spark):
    files = both(spark)
    found = rows(engine.routes(files, engine.analyse(files).edges).withColumn("m", F.array_join("methods", ",")), "project_id", "route", "file", "kind", "m")
    assert found == [
        ("express", "/payments", "src/server.ts", "api", "GET"), ("express", "/payments/:id", "src/server.ts", "api", "POST"),
        ("next", "/", "app/page.tsx", "page", None), ("next", "/api/session", "app/api/session/route.ts", "api", "GET"),
    ]


def test_astro_and_sveltekit_routes(spark):
    astro = {"src/pages/index.astro": "", "src/pages/blog/[slug].astro": "", "src/pages/_components/x.astro": "", "src/pages/api/subscribe.ts": "export async function POST() {}"}
    found = detectors.page_routes(tree.from_rows(spark, "a", astro), "astro")
    assert rows(found, "route", "kind") == [("/", "page"), ("/api/subscribe", "api"), ("/blog/[slug]", "page")]
    kit = {"src/routes/+page.svelte": "", "src/routes/(app)/shop/+page.svelte": "", "src/routes/api/+server.ts": "export const GET = 1"}
    assert rows(detectors.page_routes(tree.from_rows(spark, "k", kit), "sveltekit"), "route", "kind") == [("/", "page"), ("/api", "api"), ("/shop", "page")]


def test_script_structure():
    source = '''import { a } from "./a";
import type { B } from "./b";
export { join } from "node:path";
// import x from "./no"
export interface Options { deep: boolean }
export type Id = string;
export enum Kind { A }
export class Box<T> {
  private size = 1;
  async open(x: number) { if (x) { return x } }
}
const hidden = "function notMe() {}";
export const run = async () => { const inner = 1; function nested() {} };
export async function main() {}
let later = require("./late");
'''
    imports, exports, symbols = parsing.scan_script(source)
    assert imports == ["./a", "./b", "node:path", "./late"]
    assert exports == ["Box", "Id", "Kind", "Options", "join", "main", "run"]
    assert [(s["name"], s["kind"], s["line"]) for s in symbols] == [
        ("Options", "interface", 5), ("Id", "type", 6), ("Kind", "enum", 7), ("Box", "class", 8), ("open", "method", 10), ("hidden", "const", 12),
        ("run", "const", 13), ("main", "function", 14),
    ]
    assert [s["is_async"] for s in symbols if s["name"] in ("open", "run", "main")] == [True, True, True]


def test_component_scripts():
    assert parsing.script_of("a.vue", '<template/><script lang="ts">\nimport x from "./x"\n</script>') == '\nimport x from "./x"\n'
    assert parsing.script_of("a.svelte", '<script context="module">m</script><script>own</script>') == "own"
    assert parsing.script_of("a.astro", "---\nconst x = 1\n---\n<p/>") == "const x = 1"
    assert parsing.analyse_one("a.vue", ".vue", "<template/>")[1] == "medium"
    assert parsing.analyse_one("a.py", ".py", "class A:\n  pass")[4][0]["name"] == "A"


def test_entities(spark):
    fields = entities.prisma_fields(both(spark))
    assert rows(entities.ownership_relations(fields), "src", "dst", "kind") == [("User", "Todo", "one-to-many")]
    assert rows(entities.graph_relations(fields), "src", "dst", "kind") == [("Todo", "User", "one-to-one"), ("User", "Todo", "one-to-many")]
    sql = {"a.ts": 'import { Pool } from "pg";\nconst q = "SELECT * FROM verses WHERE id = 1"; // FROM comments\n', "b.ts": 'const t = "Choose from Options";'}
    assert rows(entities.sql_tables(tree.from_rows(spark, "s", sql)), "entity") == [("Verse",)]


def test_words(spark):
    words = {"verses": "Verse", "houses": "House", "addresses": "Address", "classes": "Class", "churches": "Church", "boxes": "Box", "categories": "Category", "media": "Media"}
    df = spark.createDataFrame(list(words.items()), "word string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", text.entity_name(F.col("word")).alias("got")).collect())
    df = spark.createDataFrame([("getHTTPServer_v2", "Some File.ts")], "a string, b string")
    assert df.select(text.split_terms(F.col("a")), text.slug(F.col("b"))).first() == (["get", "http", "server", "v2"], "some-file")


def test_roles(spark):
    want = {
        "src/a.test.ts": "test", "README.md": "documentation", "next.config.js": "config", "src/landing/Hero.tsx": "landing-ui", "bin/x.js": "cli-command",
        "src/routes/a.ts": "api-handler", "src/services/pay.ts": "service", "src/guards/a.ts": "middleware", "src/db/client.ts": "repository",
        "src/x/Card.tsx": "ui-component", "src/ai/p.ts": "ai-integration", "src/x/y.ts": "application-source",
    }
    df = spark.createDataFrame(list(want.items()), "path string, want string")
    assert [r for r in df.select("path", "want", paths.role(F.col("path")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_graph_walks(spark):
    e = [("p", "a", "b", 0), ("p", "a", "c", 1), ("p", "b", "a", 0), ("p", "c", "d", 0), ("p", "x", "d", 0)]
    edges = spark.createDataFrame(e, "project_id string, src string, dst string, ord int")
    seed = spark.createDataFrame([("p", "a")], "project_id string, path string")
    assert rows(graph.distances(edges, seed), "path", "distance") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.owned(edges, seed), "path") == [("a",), ("b",), ("c",)]
    tree_rows = rows(graph.bounded_paths(edges, seed, 3, children=1), "depth", "path", "is_cycle", "hidden")
    assert tree_rows == [(0, ["a"], False, 1), (1, ["a", "b"], False, 0), (2, ["a", "b", "a"], True, 0)]
    assert rows(graph.dependents(edges), "path", "dependents") == [("a", ["b"]), ("b", ["a"]), ("c", ["a"]), ("d", ["c", "x"])]


def test_feature_merge(spark):
    def feature(i, name, files, terms, purpose=""):
        return ("p", i, name, purpose, files, [], terms, [], [], "low")

    given = [
        feature(0, "Plan Management", ["a.ts", "b.ts"], ["plan", "Plan"], "Manages plan data and operations."),
        feature(1, "Authentication", ["auth.ts"], ["login"]), feature(2, "Customizable Plans", ["a.ts", "b.ts"], ["plan"], "Lets users shape plans."),
    ]
    merged = features.merge(spark.createDataFrame(given, features.FEATURE)).orderBy("ord").collect()
    assert [(r["name"], r["purpose"]) for r in merged] == [("Plan Management", "Lets users shape plans."), ("Authentication", "")]
    one = features._identity(dict(name="x", files=[], search_terms=[]))
    assert abs(features.score(one, one) - 1) < 1e-9


def test_tree_source(spark, tmp_path):
    for path, content in {"pages/_app.tsx": "x", ".github/x.md": "y\nz", "node_modules/a.js": "n", ".env": "s", "dist/a.js": "n", "keep/a.log": "n", "sub/secret.txt": "n", ".gitignore": "secret.txt\n"}.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    (tmp_path / "bad.ts").write_bytes(b"a\xff")
    found = tree.read_tree(spark, str(tmp_path), "t")
    assert rows(found, "path", "lines") == [(".github/x.md", 2), (".gitignore", 2), ("bad.ts", 1), ("pages/_app.tsx", 1)]
    assert found.filter("path = 'bad.ts'").first()["content"] == "a\ufffd"


def test_signals_and_services(spark):
    files = both(spark)
    found = engine.analyse(files)
    names = rows(signals.feature_signals(files, found.analyses), "project_id", "name")
    assert ("next", "Authentication") in names and ("express", "Payments") in names and ("next", "Payments") not in names
    assert rows(signals.services(files, found.analyses), "project_id", "services") == [("next", ["NextAuth", "Prisma"])]
    routes = spark.createDataFrame([("p", "/api/search", "a.ts", "api"), ("p", "/api/x/find", "b.ts", "api"), ("p", "/likes", "c.ts", "api"), ("p", "/live", "d.ts", "page")], "project_id string, route string, file string, kind string")
    assert rows(signals.behaviours(routes), "kind", "evidence", "confidence") == [("search", ["a.ts", "b.ts"], "high")]


def test_questions(spark):
    assert retrieval.keywords("Where is login handled?") == ["login", "handled", "auth", "authentication", "autentikasi", "session", "sesi", "nextauth"]
    assert [retrieval.intent(q) for q in ("fix the bug", "where is it", "hello")] == ["debug", "navigate", "general"]
    files = both(spark)
    found = engine.analyse(files)
    best = retrieval.answer(found.file_index, found.analyses, found.edges, "How does login work?").filter("project_id = 'next'").orderBy("rank").collect()
    assert best[0]["path"] in ("lib/auth.ts", "app/api/session/route.ts") and {r["path"] for r in best} >= {"lib/auth.ts", "lib/db.ts"}
    found = retrieval.answer(found.file_index, found.analyses, found.edges, "where is the database").filter("project_id = 'next'").orderBy("rank").collect()
    assert [r["path"] for r in found][0] == "lib/db.ts"


def test_flows_and_reading_path(spark):
    files = both(spark)
    found = engine.analyse(files)
    routed = engine.routes(files, found.edges)
    got = rows(flows.request_flows(routed, found.edges), "name", "steps", "confidence")
    assert ("Request /api/session", ["app/api/session/route.ts", "lib/auth.ts", "lib/db.ts"], "high") in got
    ranked = found.file_index.withColumn("importance", flows.importance(F.col("refs"), F.lit(0), F.lit(0), F.lit(False), F.col("path"), F.lit(0)))
    read = flows.reading_path(files, found.entry_points, found.critical_files, ranked).filter("project_id = 'next'").orderBy("place").collect()
    assert read[0]["path"] == "package.json" and len({r["path"] for r in read}) == len(read) <= 12


def test_snapshots(spark):
    files = both(spark)
    saved = snapshot.documents(engine.analyse(files))
    states = {"a": None, "b": "{oops", "c": '{"schemaVersion": "9", "project": {}, "stats": {}}', "d": '{"schemaVersion": "1"}'}
    odd = spark.createDataFrame(list(states.items()), "project_id string, document string")
    assert rows(snapshot.inspect(odd), "project_id", "status") == [("a", "missing"), ("b", "corrupt"), ("c", "unsupported"), ("d", "corrupt")]
    read = {r["project_id"]: r for r in snapshot.inspect(saved).collect()}
    assert read["next"]["status"] == "valid" and read["next"]["snapshot"]["stats"]["totalFiles"] == len(NEXT)
    assert read["next"]["snapshot"]["dependencyGraph"]["lib/auth.ts"] == ["lib/db.ts"]
    edited = files.withColumn("content", F.when(F.col("path") == "lib/db.ts", "changed").otherwise(F.col("content")))
    assert rows(snapshot.stale(saved, edited), "project_id", "stale") == [("express", False), ("next", True)]


def test_maps(spark):
    e = [("p", "hub", f"c{i:02d}", i) for i in range(30)] + [("p", "c00", "hub", 0)]
    found = maps.file_map(spark.createDataFrame(e, "project_id string, src string, dst string, ord int"), "p", "hub")
    assert "… +5 more" in found["uses"] and "hub (cycle)" in found["uses"] and found["uses"].count("├── c") == 25
    assert found["used_by"] == "hub\n└── c00" and found["mermaid"].count("-->") == 26


def test_other_routes_and_metadata(spark):
    nest = {"src/users.controller.ts": '@Controller("users")\nexport class Users {\n  @Get(":id") one() {}\n  @Post() add() {}\n}\n@Controller()\nclass Root { @Get() home() {} }'}
    assert rows(detectors.nest_routes(tree.from_rows(spark, "n", nest)), "route", "methods") == [("/", ["GET"]), ("/users", ["POST"]), ("/users/:id", ["GET"])]
    fast = {"src/server.ts": 'fastify.get("/a", x);\nserver.post("/b", y)'}
    assert rows(detectors.fastify_routes(tree.from_rows(spark, "f", fast)), "route", "methods") == [("/a", ["GET"]), ("/b", ["POST"])]
    told = detectors.metadata(both(spark).unionByName(tree.from_rows(spark, "cli", {"package.json": '{"name": "c", "bin": {"c": "x"}, "packageManager": "pnpm@9"}', "a/package.json": "{}"})))
    assert rows(told, "project_id", "name", "package_manager", "types", "workspace") == [
        ("cli", "c", "pnpm", ["node-cli"], "monorepo"), ("express", "express", "unknown", ["api-service"], "single-package"), ("next", "shop", "unknown", ["web-app"], "single-package"),
    ]


def test_mounts_are_resolved_by_name(spark):
    two = {
        "package.json": '{"dependencies": {"express": "1"}}',
        "src/server.ts": 'import { usersRouter } from "./users.js";\nimport { postsRouter } from "./posts.js";\napp.use("/users", usersRouter);\napp.use("/posts", postsRouter);\napp.use("/static", serve);\napp.get("/health", ok);\n',
        "src/users.ts": 'export const usersRouter = Router();\nusersRouter.get("/", list);\nusersRouter.post("/:id", add);\n',
        "src/posts.ts": 'export const postsRouter = Router();\npostsRouter.get("/", list);\n',
        "src/client.ts": 'apiRouter.get("/elsewhere", x);\n',
    }
    files = tree.from_rows(spark, "two", two)
    found = engine.analyse(files)
    assert rows(engine.routes(files, found.edges), "route", "file", "methods") == [
        ("/health", "src/server.ts", ["GET"]), ("/posts", "src/server.ts", ["GET"]), ("/static", "src/server.ts", ["USE"]), ("/users", "src/server.ts", ["GET"]), ("/users/:id", "src/server.ts", ["POST"]),
    ]


def test_every_backend_has_routes(spark):
    fast = {
        "package.json": '{"dependencies": {"fastify": "5"}}',
        "src/server.ts": 'import payments from "./plugins/payments.js";\nconst app = Fastify();\napp.get("/health", ok);\napp.route({ method: \'PUT\', url: \'/users/:id\', handler: x });\napp.register(payments, { prefix: \'/api/payments\' });\n',
        "src/plugins/payments.ts": 'export default async function payments(fastify) {\n  fastify.get("/", x);\n  fastify.get("/:id", y);\n}\n',
    }
    nest = {"package.json": '{"dependencies": {"@nestjs/core": "1"}}', "src/users.controller.ts": '@Controller("users")\nexport class Users {\n  @Get(":id") one() {}\n}\n'}
    files = tree.from_rows(spark, "fast", fast).unionByName(tree.from_rows(spark, "nest", nest))
    assert rows(engine.routes(files, engine.analyse(files).edges), "project_id", "route", "file", "methods") == [
        ("fast", "/api/payments", "src/server.ts", ["GET"]), ("fast", "/api/payments/:id", "src/server.ts", ["GET"]), ("fast", "/health", "src/server.ts", ["GET"]),
        ("fast", "/users/:id", "src/server.ts", ["PUT"]), ("nest", "/users/:id", "src/users.controller.ts", ["GET"]),
    ]


def test_sql_strings_only(spark):
    code = {
        "src/db.ts": 'import { DatabaseSync } from "node:sqlite";\n/* SELECT * FROM comments */ const a = "update your profile"; const b = "select a file from this page";\n',
        "src/run.ts": "// don't: SELECT * FROM notes\nq('SELECT 1 FROM schema_migrations'); q(`WITH x AS (SELECT * FROM order_items) SELECT 1`); q(`SELECT * FROM ${t}`); q(\"Update Acme now\");\n",
        "test/run.test.ts": 'q("SELECT * FROM widgets");',
    }
    assert rows(entities.sql_tables(tree.from_rows(spark, "s", code)), "entity", "files") == [("Order_item", ["src/run.ts"])]


def test_bindings_and_strings():
    text = """export const { GET, POST: post = 1, ...rest } = handlers
export const a = 1, b = async () => { const inner = 2, other = 3 }, [c, d] = pair;
export let e = 1
const f = x
  .map(y)
import real from "./real";
const s = `import a from "./fake"`, t = "require('./nope')"
const r = require("./needed")
"""
    imports, exports, symbols = parsing.scan_script(text)
    assert imports == ["./real", "./needed"]
    assert exports == ["GET", "a", "b", "c", "d", "e", "post", "rest"]
    assert [(s["name"], s["line"], s["is_async"]) for s in symbols] == [
        ("GET", 1, False), ("post", 1, False), ("rest", 1, False), ("a", 2, False), ("b", 2, True), ("c", 2, False), ("d", 2, False), ("f", 4, False), ("s", 7, False), ("t", 7, False), ("r", 8, False),
    ]


def test_distances_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([("p", str(i), str(i + 1)) for i in range(4)] + [("p", "4", "0")], "project_id string, src string, dst string")
    seeds = spark.createDataFrame([("p", "0")], "project_id string, path string")
    assert rows(graph.distances(chain, seeds), "path", "distance") == [(str(i), i) for i in range(5)]
    assert graph.distances(chain, seeds, most=4).count() == 5
    with pytest.raises(RuntimeError):
        graph.distances(chain, seeds, most=3)
