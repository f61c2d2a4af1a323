"""The assembled feature list, and what it is made of, with literal expectations."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import evidence
from tessera.operators import entities, feature_list, graph
from tessera.plans import engine
from tessera.sources import tree

SHOP = {
    "package.json": '{"dependencies": {"next": "1", "@prisma/client": "1"}}',
    "README.md": "Shop\n",
    "CHANGELOG.md": "1\n",
    "src/index.ts": "export const x = 1;\n",
    "app/verses/page.tsx": 'import { all } from "../../lib/verse.js";\nimport { log } from "../../lib/log.js";\nexport default function Page() { return all }\n',
    "app/verses/[id]/page.tsx": "export default function Page() { return null }\n",
    "app/other/page.tsx": 'import { log } from "../../lib/log.js";\nexport default function Page() { return log }\n',
    "app/callback/page.tsx": "export default function Page() { return null }\n",
    "lib/verse.ts": "export const all = [];\n",
    "lib/log.ts": "export const log = 1;\n",
    "src/auth.ts": "export const auth = 1;\n",
    "middleware.ts": 'import { auth } from "./src/auth.js";\nexport const middleware = auth;\n',
    "app/api/orders/route.ts": "export async function GET() {}\nexport async function POST() {}\nexport async function DELETE() {}\n",
    "lib/order-store.ts": "export const orders = [];\n",
    "prisma/schema.prisma": (
        "model Order {\n  id String @id\n  items OrderItem[]\n  tags Tag[]\n}\n\nmodel OrderItem {\n  id String @id\n  order Order\n}\n\n"
        "model Tag {\n  id String @id\n  orders Order[]\n}\n\nmodel Session {\n  id String @id\n  order Order\n}\n\nmodel Alone {\n  id String @id\n}\n"
    ),
}


@pytest.fixture(scope="module")
def shop(spark):
    files = tree.from_rows(spark, "shop", SHOP)
    found = engine.analyse(files)
    routed = graph.written(engine.routes(files, found.edges))
    return files, found, routed


def test_feature_list(shop):
    files, found, routed = shop
    told = {r["name"]: r for r in engine.features(files, found, routed).collect()}
    assert sorted(told) == ["Authentication", "CLI Commands", "Documentation", "Order Management", "Other", "Verse"]
    auth = told["Authentication"]
    assert (auth["files"], auth["entry_point"], auth["confidence"]) == (["middleware.ts", "src/auth.ts"], "src/auth.ts", "high")
    assert told["Verse"]["files"] == ["app/verses/[id]/page.tsx", "app/verses/page.tsx", "lib/verse.ts"]
    assert told["Verse"]["purpose"] == 'Frontend pages under "verses".'
    assert told["Other"]["files"] == ["app/other/page.tsx"]
    assert told["Documentation"]["files"] == ["README.md"]
    order = told["Order Management"]
    assert order["entry_points"] == ["app/api/orders/route.ts"]
    assert set(order["files"]) >= {"app/api/orders/route.ts", "lib/order-store.ts"}
    assert order["purpose"].startswith("Reads and changes Order")


def test_scopes_of_the_index(shop):
    _, found, _ = shop
    told = {r["path"]: r["scope"] for r in found.file_index.collect()}
    assert (told["app/api/orders/route.ts"], told["lib/log.ts"], told["prisma/schema.prisma"], told["README.md"], told["src/index.ts"]) == ("api", "service", "database", "docs", "unknown")


def test_low_evidence_is_never_high(spark):
    rows = tree.from_rows(spark, "low", {"package.json": '{"name": "low"}', "docs.md": "x", "README.md": "y"})
    found = engine.analyse(rows)
    assert {r["confidence"] for r in engine.features(rows, found, engine.routes(rows, found.edges)).collect()} == {"low"}


def test_capabilities(spark):
    routes = spark.createDataFrame(
        [("p", "/api/boxes", "b.ts", "api", ["GET"]), ("p", "/api/people", "p.ts", "api", ["POST", "DELETE"]), ("p", "/x/share", "s.ts", "api", ["POST"]), ("p", "/shared/a", "t.ts", "api", [])],
        "project_id string, route string, file string, kind string, methods array<string>",
    )
    names = spark.createDataFrame([("p", "People"), ("q", "Boxes")], "project_id string, entity string")
    found = {r["kind"]: r for r in feature_list.capabilities(routes, names).collect()}
    assert set(found) == {"crud", "sharing"}
    assert (found["crud"]["name"], found["crud"]["entities"], found["crud"]["evidence"], found["crud"]["confidence"]) == ("Box Management", ["Box", "People"], ["b.ts", "p.ts"], "medium")
    assert (found["sharing"]["evidence"], found["sharing"]["confidence"]) == (["s.ts", "t.ts"], "high")
    assert feature_list.capabilities(routes.limit(0), names).count() == 0


def test_entities(shop):
    files, found, _ = shop
    told = {r["name"]: r for r in feature_list.by_entity(files, found.fields, entities.sql_tables(files)).collect()}
    # a part of one order only, bookkeeping, and models without relations make no feature; no file has the word "tag"
    assert list(told) == ["Order Management"]
    assert told["Order Management"]["purpose"] == "Manages Order and its associations with Tag."
    assert (told["Order Management"]["files"], told["Order Management"]["confidence"]) == (["lib/order-store.ts"], "high")


def test_path_rules(spark):
    cases = spark.createDataFrame(
        [
            ("src/auth.ts", ["x"], [], ""), ("src/guard.ts", ["x"], ["next-auth"], ""), ("src/providers.tsx", ["sessionProvider"], [], ""), ("app/layout.tsx", [], [], "useSession()"),
            ("app/layout.tsx", [], [], ""), ("lib/x.ts", [], ["passport"], "getSession"), ("lib/author.ts", [], [], ""), (None, None, None, None),
        ],
        "path string, symbols array<string>, imports array<string>, content string",
    )
    got = [r[0] for r in cases.select(evidence.auth_role(*map(F.col, cases.columns[:3]), evidence.said(F.col("content")))).collect()]
    assert got == ["auth-config", "guard", "provider", "consumer", None, "auth-config", None, None]
    scopes = spark.createDataFrame(
        [
            ("src/commands/config.ts", [], []), ("a/test/x.ts", [], []), ("docs/x.ts", [], []), ("src/index.ts", [], ["src/routes/a.ts"]), ("src/index.ts", [], []), ("x/vite.config.ts", [], []),
            ("x/a.ts", ["GET"], []), ("x/a.ts", ["HomePage", "Page"], []), ("x/schema.ts", [], []), ("x/a.ts", ["program"], []), ("x/a.ts", [], ["y/adapter.ts"]), ("x/a.ts", [], []),
        ],
        "path string, exports array<string>, imports array<string>",
    )
    got = [r[0] for r in scopes.select(evidence.scope(*map(F.col, scopes.columns))).collect()]
    assert got == ["cli", "test", "docs", "api", "unknown", "config", "api", "ui", "database", "cli", "service", "unknown"]
    ranks = spark.createDataFrame([("readme.md",), ("docs/a.md",), ("packages/a/readme.md",), ("a/b.md",)], "path string")
    assert [r[0] for r in ranks.select(evidence.priority("Documentation", F.col("path"))).collect()] == [0, 20, 10, 32]


def test_owned_by_name(spark):
    edges = spark.createDataFrame([("p", "a", "x"), ("p", "x", "y"), ("p", "b", "z"), ("p", "a", "z"), ("p", "y", "x")], "project_id string, src string, dst string")
    seeds = spark.createDataFrame([("p", "one", "a"), ("p", "two", "b"), ("p", "two", "b")], "project_id string, name string, path string")
    got = sorted((r["name"], r["path"]) for r in graph.owned_by_name(edges, seeds).collect())
    assert got == [("one", "a"), ("one", "x"), ("one", "y"), ("two", "b")]


def test_client_routes(spark):
    spa = {
        "src/App.tsx": 'import QuranPage from "./QuranPage.js";\nimport Doa from "./Doa.js";\nexport const r = <><Route path="/quran/:id" element={<QuranPage />} /><Route path="/:id" element={<Doa />} /></>;\n',
        "src/router.ts": 'import Doa from "./Doa.js";\nexport const routes = [{ path: "/doa", component: Doa }, { path: "/about", component: () => import("./views/About.vue") }, { path: "/gone", component: Gone }];\n',
        "src/hash.ts": 'import { wrap } from "svelte-spa-router";\nimport Doa from "./Doa.js";\nexport default { "/prayers": Doa };\n',
        "src/plain.ts": 'import Doa from "./Doa.js";\nexport default { "/never": Doa };\n',
        "src/QuranPage.tsx": "export default 1;\n", "src/Doa.tsx": "export default 1;\n", "src/views/About.vue": "<script>export default {}</script>\n",
    }
    files = tree.from_rows(spark, "spa", spa)
    found = engine.analyse(files)
    got = sorted((r["route"], r["path"]) for r in feature_list.client_routes(files, found.edges).collect())
    assert got == [("/:id", "src/Doa.tsx"), ("/about", "src/views/About.vue"), ("/doa", "src/Doa.tsx"), ("/prayers", "src/Doa.tsx"), ("/quran/:id", "src/QuranPage.tsx")]
    told = {r["name"]: (r["purpose"], r["files"], r["search_terms"]) for r in feature_list.by_client_route(files, found.edges).collect()}
    assert told["Quran"] == ('Client-side route under "quran".', ["src/QuranPage.tsx"], ["quran"])
    assert set(told) == {"About", "Doa", "Prayer", "Quran"}
