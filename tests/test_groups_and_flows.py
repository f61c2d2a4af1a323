"""Feature and project maps, and flows of features, with literal expectations."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import business_flows, features, feature_list, graph, groups
from tessera.plans import engine, maps
from tessera.sources import tree

FEATURES = "project_id string, name string, files array<string>, entry_point string, entry_points array<string>, confidence string"
EDGES = "project_id string, src string, dst string, ord int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def small(spark):
    edges = [("p", "a.ts", "b.ts", 0), ("p", "a.ts", "lib/x.ts", 1), ("p", "b.ts", "a.ts", 0), ("p", "b.ts", "lib/x.ts", 1), ("p", "b.ts", "lib/y.ts", 2), ("p", "main.ts", "a.ts", 0), ("p", "main.ts", "c.ts", 1), ("p", "c.ts", "c.ts", 0), ("q", "a.ts", "b.ts", 0)]
    listed = [("p", "Base", ["lib/x.ts", "b.ts"], None, [], "high"), ("p", "Alpha", ["a.ts", "b.ts", "c.ts"], "a.ts", [], "high"), ("q", "Alpha", ["a.ts"], None, [], "medium")]
    return graph.written(spark.createDataFrame(edges, EDGES)), graph.written(spark.createDataFrame(listed, FEATURES))


def test_sides_of_every_edge(small):
    edges, listed = small
    got = rows(groups.sides(edges, groups.members_of(listed)), "project_id", "name", "side", "src", "dst")
    assert got == [
        ("p", "Alpha", "in", "main.ts", "a.ts"), ("p", "Alpha", "in", "main.ts", "c.ts"), ("p", "Alpha", "inner", "a.ts", "b.ts"), ("p", "Alpha", "inner", "b.ts", "a.ts"),
        ("p", "Alpha", "inner", "c.ts", "c.ts"), ("p", "Alpha", "out", "a.ts", "lib/x.ts"), ("p", "Alpha", "out", "b.ts", "lib/x.ts"), ("p", "Alpha", "out", "b.ts", "lib/y.ts"),
        ("p", "Base", "in", "a.ts", "b.ts"), ("p", "Base", "in", "a.ts", "lib/x.ts"), ("p", "Base", "inner", "b.ts", "lib/x.ts"), ("p", "Base", "out", "b.ts", "a.ts"),
        ("p", "Base", "out", "b.ts", "lib/y.ts"), ("q", "Alpha", "out", "a.ts", "b.ts"),
    ]


def test_feature_map(small):
    edges, listed = small
    text = maps.feature_map(edges, listed, "p", "Alpha")["markdown"]
    assert "a.ts\n└── b.ts\n    └── a.ts (cycle)" in text
    assert "## Other files in this feature\n\n  - c.ts\n" in text
    assert "## Depends on (outside this feature)\n\n  - lib/x.ts\n  - lib/y.ts\n" in text
    assert "## Used by (outside this feature)\n\n  - main.ts\n" in text
    with pytest.raises(LookupError):
        maps.feature_map(edges, listed, "q", "Base")


def test_long_lists_are_cut_and_counted(spark):
    edges = spark.createDataFrame([("p", f"use{i:02}.ts", "hub.ts", 0) for i in range(30)] + [("p", "hub.ts", f"lib{i:02}.ts", i) for i in range(26)], EDGES)
    hub = spark.createDataFrame([("p", "Hub", ["hub.ts"], None, [], "high")], FEATURES)
    text = maps.feature_map(edges, hub, "p", "Hub")
    assert "  - use24.ts\n  … +5 more" in text["markdown"] and "  - lib24.ts\n  … +1 more" in text["markdown"]
    assert "use25" not in text["mermaid"] and "lib25" not in text["mermaid"] and text["mermaid"].count("-->") == 50
    assert "use29" in maps.feature_map(edges, hub, "p", "Hub", most=None)["mermaid"]


def test_project_map(small, spark):
    edges, listed = small
    members = groups.members_of(listed)
    assert rows(groups.quotient(edges, members), "project_id", "src", "dst", "place") == [("p", "Alpha", "Base", 1), ("p", "Base", "Alpha", 2)]
    files = spark.createDataFrame([("p", x) for x in ("a.ts", "b.ts", "c.ts", "main.ts", "lib/x.ts", "lib/y.ts")], "project_id string, path string")
    text = maps.project_map(edges, listed, files, spark.createDataFrame([("p", "main.ts", 1)], "project_id string, path string, rank int"), "p")["markdown"]
    assert "  - Alpha (3 files)\n  - Base (2 files)" in text and "  - Alpha → Base\n  - Base → Alpha" in text
    assert "4 of 6 files belong to a detected feature." in text and "  - main.ts" in text
    assert rows(maps.full_edges(files, edges).filter("path = 'b.ts'"), "line") == [("  - b.ts → a.ts, lib/x.ts, lib/y.ts",)]


def test_flows_by_template_by_part_and_by_walk(spark):
    names = ["src/index.ts", "src/commands/run.ts", "src/output.ts", "src/services/order-item.ts", "src/routes/all.ts", "src/repositories/orders.ts", "src/ai/openai.ts", "src/ai/provider.ts", "src/ai/prompt.ts",
             "src/ai/context.ts", "auth.ts", "app/login-form.tsx", "app/api/session/route.ts", "z/orderitem/list.ts"]
    files = spark.createDataFrame([("p", n) for n in names] + [("q", "one.ts"), ("q", "two.ts")], "project_id string, path string")
    edges = spark.createDataFrame([("p", "app/api/session/route.ts", "auth.ts", 0), ("q", "one.ts", "two.ts", 0)], EDGES)
    listed = [
        ("p", "CLI Commands", ["src/index.ts"], "src/index.ts", [], "high"), ("p", "AI Integration", ["src/ai/openai.ts"], "src/ai/openai.ts", [], "medium"),
        ("p", "Order Item Management", ["z/orderitem/list.ts", "src/services/order-item.ts"], "z/orderitem/list.ts", [], "high"),
        ("p", "Authentication", ["auth.ts", "app/api/session/route.ts", "app/login-form.tsx"], "app/api/session/route.ts", [], "low"),
        ("q", "Walk", ["one.ts"], "one.ts", [], "high"), ("q", "Lost", [], None, [], "high"),
    ]
    told = graph.written(business_flows.with_flows(spark.createDataFrame(listed, FEATURES), files, edges))
    flow = {r["name"]: r["business_flow"] for r in told.collect()}
    assert flow["CLI Commands"] == ["Parse and dispatch command in src/index.ts.", "Execute command handler in src/commands/run.ts.", "Render output in src/output.ts."]
    assert flow["AI Integration"] == ["Build context in src/ai/context.ts.", "Construct prompt in src/ai/prompt.ts.", "Call AI provider in src/ai/openai.ts and src/ai/provider.ts."]
    assert flow["Order Item Management"] == ["Handle API request in app/api/session/route.ts.", "Apply business logic in src/services/order-item.ts.", "Access data in src/repositories/orders.ts."]
    assert flow["Authentication"] == [
        "Start at app/api/session/route.ts.", "Configure authentication in auth.ts, including providers, session/JWT callbacks, and shared auth helpers.",
        "Render login UI in app/login-form.tsx and submit credentials to the auth provider.",
    ]
    assert (flow["Walk"], flow["Lost"]) == (["Start at one.ts.", "Follow dependency two.ts."], ["Identify files related to Lost."])
    shown = {r["name"]: r for r in business_flows.feature_flows(told).collect()}
    assert sorted(shown) == ["CLI Commands flow", "Order Item Management flow", "Walk flow"]
    assert [s["file"] for s in shown["Order Item Management flow"]["steps"]] == [None, "src/services/order-item.ts", None]
    assert rows(business_flows.feature_flows(told, None, "medium"), "name") == [("AI Integration flow",), ("CLI Commands flow",), ("Order Item Management flow",), ("Walk flow",)]
    assert rows(business_flows.feature_flows(told, None, "medium", exactly=True), "name") == [("AI Integration flow",)]


def test_features_named_in_folders(spark):
    paths = spark.createDataFrame([("p", x) for x in ("b/order-items.ts", "a/ORDERITEM/x.ts", "order-item/root.ts", "c/o-rderitem.ts", "d/c++.ts")], "project_id string, path string")
    listed = spark.createDataFrame([("p", "Order Item Management"), ("p", "C++"), ("p", "None")], "project_id string, name string")
    assert rows(business_flows.named_first(paths, listed), "name", "path") == [("C++", "d/c++.ts"), ("Order Item Management", "a/ORDERITEM/x.ts")]


def test_cut_segments_are_never_broadcast(spark, monkeypatch):
    files = graph.written(spark.range(400).selectExpr("'p' AS project_id", "concat('src/lib/red-', elt(id % 2 + 1, 'bolt', 'ring'), '-', id, '.ts') AS path", "concat('red ', elt(id % 2 + 1, 'bolt', 'ring')) AS word"))
    listed = files.selectExpr("project_id", "concat(word, ' Management') AS name").distinct()
    for most, kind in ((graph.SENT_BYTES, "BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(graph, "SENT_BYTES", most)
        found = business_flows.named_first(files.select("project_id", "path"), listed)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and plan.count(kind) == 2 and (most or "BroadcastHashJoin" not in plan)
        assert rows(found, "name", "path") == [("red bolt Management", "src/lib/red-bolt-0.ts"), ("red ring Management", "src/lib/red-ring-1.ts")]


def test_mended_rules(spark):
    wiki = tree.from_rows(spark, "w", {"wiki/src/index.ts": "export const x = 1;\n"})
    found = engine.analyse(wiki)
    assert rows(engine.features(wiki, found, graph.written(engine.routes(wiki, found.edges))), "name") == [("CLI Commands",), ("Documentation",)]
    nest = {
        "package.json": '{"dependencies": {"@nestjs/core": "1"}}', "examples/a.controller.ts": '@Controller("cats")\nclass A {\n  // @Get("no") no() {}\n  @Get("yes") yes() {}\n}\n',
        "a.controller.txt": '@Controller("text")\nclass B { @Get() x() {} }\n',
    }
    files = tree.from_rows(spark, "n", nest)
    assert rows(engine.routes(files, engine.analyse(files).edges), "route", "file") == [("/cats/yes", "examples/a.controller.ts")]
    ring = ["Zed", "Yak", "Xen", "Wig", "Vat", "Urn", "Tin", "Sip", "Ant", "Bee"]
    models = "\n\n".join(f"model {a} {{\n  id String @id\n  next {b}\n}}" for a, b in zip(ring, ring[1:] + ring[:1]))
    code = {"prisma/schema.prisma": models + "\n"} | {f"src/{n.lower()}.ts": "export const x = 1;\n" for n in ring}
    files = tree.from_rows(spark, "r", code)
    found = engine.analyse(files)
    told = feature_list.by_entity(files, found.fields, spark.createDataFrame([], "project_id string, entity string, files array<string>, seen struct<path: string, at: int, place: int>"))
    assert rows(told, "name") == sorted((f"{n} Management",) for n in ring[:8])
    routes = spark.createDataFrame([("p", "/api/zebras", "z.ts", "api", ["GET"]), ("p", "/api/a/b", "z.ts", "api", ["GET"]), ("p", "/api/apples", "b.ts", "api", ["GET"]), ("p", "/aaa/x", "c.ts", "api", ["POST"])], "project_id string, route string, file string, kind string, methods array<string>")
    (crud,) = feature_list.capabilities(routes, spark.createDataFrame([], "project_id string, entity string")).filter("kind = 'crud'").collect()
    assert crud["name"] == "Aaa Management"
