"""File index, navigation documents, entity sources, targets, evidence and answers from outside, with literal expectations."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import business_flows, detectors, entities, feature_list, features, graph, memo, parsing, retrieval, targets
from tessera.plans import engine, file_index, navigation, questions, snapshot
from tessera.sources import documents, tree

SHOP = {
    "package.json": '{"name": "shop", "dependencies": {"next": "1"}}',
    "README.md": "Shop\n",
    "src/auth.ts": "export const auth = 1;\nexport const handlers = 2;\n",
    "middleware.ts": 'import { auth } from "./src/auth.js";\nexport const middleware = auth;\n',
    "app/api/orders/route.ts": 'import { orders } from "../../../lib/order-store.js";\nexport async function GET() {}\nexport async function POST() {}\nexport async function DELETE() {}\n',
    "lib/order-store.ts": 'import { db } from "./db.js";\nexport const orders = [];\n',
    "lib/db.ts": "export const db = 1;\n",
    "lib/types.ts": "export type Order = {};\n",
    "src/commands/run.ts": 'import { db } from "../../lib/db.js";\nexport function run() {}\n',
}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def shop(spark):
    files = tree.from_rows(spark, "shop", SHOP)
    found = engine.analyse(files)
    routed = graph.written(engine.routes(files, found.edges))
    listed = graph.written(engine.features(files, found, routed))
    index = graph.written(file_index.full(found, listed))
    told = graph.written(business_flows.feature_flows(listed).select("project_id", "name", "entry_point", "steps"))
    return files, found, routed, listed, index, told


def test_full_index(shop):
    files, found, _, listed, index, _ = shop
    told = {r["path"]: r for r in index.collect()}
    assert told["src/auth.ts"]["importance"] == 100 and told["src/auth.ts"]["features"] == ["Authentication"]
    # one reference, its critical score of 3 points, two features, a sentence from scope and features
    store = told["lib/order-store.ts"]
    assert store["purpose"].startswith("lib/order-store.ts implements order store service responsibilities")
    assert told["lib/types.ts"]["purpose"] == "lib/types.ts declares types that its neighbours share."
    assert told["README.md"]["purpose"] is None and told["README.md"]["scope"] == "docs"
    assert told["lib/db.ts"]["search_terms"] == ["lib", "db", "ts"]
    best = {r["path"]: r for r in found.critical_files.collect()}
    assert "semantic feature anchor" in best["src/auth.ts"]["reasons"] and best["src/auth.ts"]["score"] == 3 + 3 + 50
    assert best["middleware.ts"]["score"] >= 12 + 3 + 40
    assert rows(file_index.warnings(files, found, listed), "project_id", "warnings") == [("shop", [])]
    broken = tree.from_rows(files.sparkSession, "b", {"package.json": "{", "a.txt": ""})
    nothing = engine.analyse(broken)
    (said,) = file_index.warnings(broken, nothing, listed).collect()
    assert len(said["warnings"]) == 4 and said["warnings"][3].startswith("package.json could not be parsed")


def test_snapshot_with_all_facts(shop):
    files, found, routed, listed, index, _ = shop
    known = entities.extract(files, found.fields, routed)
    facts = [
        snapshot.feature_facts(listed), snapshot.route_facts(routed), snapshot.entity_facts(known, entities.graph_relations(found.fields)),
        snapshot.capability_facts(feature_list.capabilities(routed, known)), snapshot.index_facts(index), file_index.warnings(files, found, listed),
    ]
    (read,) = snapshot.inspect(snapshot.documents(found, *facts)).collect()
    kept = read["snapshot"]
    assert read["status"] == "valid" and [f["name"] for f in kept["features"]] == sorted(r["name"] for r in listed.collect())
    assert [(r["path"], r["methods"]) for r in kept["routes"]] == [("/api/orders", ["DELETE", "GET", "POST"])]
    assert (kept["entityGraph"]["source"], kept["entityGraph"]["entityNames"], kept["entityGraph"]["relations"]) == ("route-hint", ["Order"], [])
    assert [c["name"] for c in kept["capabilities"]] == ["Order Management"] and kept["warnings"] == []
    assert set(kept["fileIndex"]) == set(SHOP) and kept["fileIndex"]["src/auth.ts"]["importance"] == 100
    assert "entityGraph" not in snapshot.documents(found).first()["document"]


def test_change_impact_over_features_and_flows(shop):
    _, found, _, listed, _, told = shop
    got = {r["path"]: r for r in file_index.change_impact(found, listed, told).collect()}
    assert got["lib/db.ts"]["dependents"] == ["lib/order-store.ts", "src/commands/run.ts"]
    assert "Authentication" in got["src/auth.ts"]["impacts"]


def test_start_scores(spark):
    make = spark.createDataFrame
    entries = make([("p", "main.ts", 1), ("p", "other.ts", 2)], "project_id string, path string, rank int")
    index = make([("p", "main.ts", "cli", ["A"], 30), ("p", "lib.ts", "service", ["A", "B"], 7), ("p", "far.ts", "unknown", [], 1), ("p", "t.test.ts", "test", [], 99), ("p", "src/commands/x.ts", "cli", [], 0)], "project_id string, path string, scope string, features array<string>, importance int")
    listed = make([("p", "A", ["main.ts", "lib.ts"], "main.ts", ["lib.ts"]), ("p", "Documentation", ["far.ts"], None, []), ("p", "T", ["t.test.ts", "src/commands/x.ts"], None, [])], "project_id string, name string, files array<string>, entry_point string, entry_points array<string>")
    distance = make([("p", "main.ts", 0), ("p", "lib.ts", 1), ("p", "far.ts", 4)], "project_id string, path string, distance int")
    flowing = make([("p", "A flow", "lib.ts"), ("p", "B flow", "lib.ts")], "project_id string, name string, path string")
    critical = make([("p", "far.ts", 1)], "project_id string, path string, rank int")
    scores = navigation.start_scores(entries, distance, index, listed, flowing, critical)
    assert rows(scores, "path", "score") == [("far.ts", 1), ("lib.ts", 140 + 240 + 100 + 80 + 7), ("main.ts", 1_000_000 + 500 + 200 + 100 + 40 + 30), ("src/commands/x.ts", 800)]
    assert [r["path"] for r in navigation.start_here(scores, 2).orderBy("place").collect()] == ["main.ts", "src/commands/x.ts"]


def test_documents_are_replaced_a_project_at_a_time(shop, spark, tmp_path):
    files, found, _, listed, index, told = shop
    folder = str(tmp_path / "nav")
    made = graph.written(navigation.documents(found, index, listed, told, detectors.metadata(files)))
    other = spark.createDataFrame([("other", "index", "{}"), ("other", "features/../x", "{}")], documents.DOCUMENTS)
    documents.write_documents(made.unionByName(other), folder)
    got = {(r["project_id"], r["name"]): r["document"] for r in documents.read_documents(spark, folder).collect()}
    assert {n for p, n in got if p == "other"} == {"index", "features/../x"}
    main = json.loads(got["shop", "index"])
    assert main["project"]["summary"].startswith("shop is a TypeScript project containing a web application. Main capabilities: ")
    assert main["entryPoints"] and len(main["criticalFiles"]) <= 8 and main["criticalFiles"][0] == main["entryPoints"][0]
    assert [f["name"] for f in main["features"]] == sorted(f["name"] for f in main["features"])
    auth = json.loads(got["shop", "features/authentication"])
    assert auth["sourcePriority"][0] in auth["entryPoints"] and {f["path"] for f in auth["relatedFiles"]} == {"middleware.ts", "src/auth.ts"}
    documents.write_documents(spark.createDataFrame([("shop", "index", '{"new": 1}')], documents.DOCUMENTS), folder)
    assert rows(documents.read_documents(spark, folder), "project_id", "name") == [("other", "features/../x"), ("other", "index"), ("shop", "index")]
    fails = F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.lit("{}"))
    bad = spark.range(4, numPartitions=4).select(F.lit("shop").alias("project_id"), F.col("id").cast("string").alias("name"), fails.alias("document"))
    with pytest.raises(Exception, match="stop"):
        documents.write_documents(bad, folder)
    assert rows(documents.read_documents(spark, folder).filter("project_id = 'shop'"), "name", "document") == [("index", '{"new": 1}')]
    # a task that was still running may have left files of the lost version; the next commit clears them
    documents.write_documents(spark.createDataFrame([("shop", "index", '{"newer": 1}')], documents.DOCUMENTS), folder)
    assert len(os.listdir(os.path.join(folder, "shop"))) == 2 and os.path.isfile(os.path.join(folder, "shop", "CURRENT"))
    assert documents.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_answers_are_asked_once(spark, tmp_path):
    folder, log = str(tmp_path / "memo"), str(tmp_path / "log")

    def ask(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if any('"bad"' in t for t in texts):
            raise OSError("no answer")
        return [None if '"none"' in t else json.dumps({"domain": t, "summary": "s"}) for t in texts]

    def asked(names):
        facts = spark.createDataFrame([(f"p{i}", n, None, [], None, "f", 0, "unclear", None) for i, n in enumerate(names)], "project_id string, entities array<string>, relations array<string>, capabilities array<string>, features array<string>, framework string, routes int, ownership string, shared_fields array<string>")
        return memo.fill(memo.domain_questions(facts), ask, folder, batch=2, tasks=1).collect()

    got = asked([["A", "B"], ["B", "A"], ["C"], [], ["none"]])
    assert len(got) == 4 and len({r["key"] for r in got}) == 3 and sum(r["answer"] is None for r in got) == 1
    assert len(open(log).read().splitlines()) == 3
    # the known ones are not asked again; a batch that fails leaves the other batch alone, and is asked again
    again = asked([["A", "B"], ["C"], ["bad"], ["D"], ["E"]])
    assert sum(r["answer"] is not None for r in again) >= 3 and len(open(log).read().splitlines()) == 6
    later = asked([["D"], ["E"], ["A", "B"]])
    assert all(r["answer"] for r in later) and len(open(log).read().splitlines()) <= 8
    assert memo.answers(spark, folder).count() == 4


def test_answers_are_read_with_care(spark):
    told = ['```json\n{"domain": "d", "summary": "s", "confidence": 7, "domainFeatures": [{"name": "Plan B", "purpose": "p", "relatedEntities": ["Plan"]}, {"name": ""}]}\n```', '{"domain": "d"}', "no json", None, '{"domain": "d", "summary": "s"}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(told)], "project_id string, answer string").withColumn("domain", memo.domain(F.col("answer")))
    got = {r["project_id"]: r["domain"] for r in df.collect()}
    assert (got["0"]["confidence"], len(got["0"]["features"]), got["4"]["confidence"], got["4"]["features"]) == (1.0, 1, 0.7, [])
    assert got["1"] is got["2"] is got["3"] is None
    assert rows(memo.domain_features(df), "project_id", "name", "search_terms") == [("0", "Plan B", ["plan", "b"])]
    cases = spark.createDataFrame([("  One  line. Two.", ["Order   Store!", "app", "a b c d", "x", "API"])], "t string, w array<string>")
    assert cases.select(memo.first_sentence(F.col("t")), memo.telling_terms(F.col("w"))).first()[:] == ("One line.", ["order store", "api"])


def test_eligible_files_are_enriched(shop):
    _, found, _, _, index, _ = shop
    some = memo.eligible(index, found.analyses, found.critical_files)
    assert {r["path"] for r in some.collect()} >= {"src/auth.ts", "middleware.ts"} and "README.md" not in {r["path"] for r in some.collect()}
    told = some.filter("path = 'lib/db.ts'").select("project_id", "path", F.lit('{"purpose": "Opens the database. More.", "searchTerms": ["Pool!", "data"]}').alias("answer"))
    got = {r["path"]: r for r in memo.enriched(index, told).collect()}
    assert (got["lib/db.ts"]["purpose"], got["lib/db.ts"]["search_terms"][-1]) == ("Opens the database.", "pool")
    assert got["lib/types.ts"]["purpose"].startswith("lib/types.ts")


def test_entity_sources_in_order(spark):
    model = "model Order {\n  id String @id\n}\n"
    sql = 'import pg from "pg";\nq("SELECT * FROM order_items");\n'
    files = tree.from_rows(spark, "both", {"a.prisma": model, "db.ts": sql}).unionByName(tree.from_rows(spark, "sql", {"db.ts": sql})).unionByName(tree.from_rows(spark, "none", {"x.ts": ""}))
    routes = spark.createDataFrame([(p, r, "f.ts", "api") for p in ("both", "sql", "hint") for r in ("/api/v1/people/[id]", "/users/:id", "/api/media")] + [("page", "/boxes", "f.ts", "page")], "project_id string, route string, file string, kind string")
    got = rows(entities.extract(files, entities.prisma_fields(files), routes), "project_id", "source", "entity")
    assert got == [("both", "prisma", "Order"), ("hint", "route-hint", ":id"), ("hint", "route-hint", "Media"), ("hint", "route-hint", "Person"), ("hint", "route-hint", "User"), ("sql", "sql", "Order_item")]


def test_targets(spark):
    files = spark.createDataFrame([("p", x) for x in ["lib/auth.ts", "app/page.tsx", "auth.ts", *[f"d{i}/index.ts" for i in range(7)]]] + [("q", "lib/auth.ts")], "project_id string, path string")
    listed = spark.createDataFrame([("p", "Order Store"), ("p", "page.tsx")], "project_id string, name string")
    asked = spark.createDataFrame([("p", t) for t in ("auth.ts", "page.tsx", "ORDER store", "index.ts", "uth.ts", " ", "app/page.tsx", None)] + [("q", "auth.ts")], "project_id string, target string")
    got = {(r["project_id"], r["target"]): (r["mode"], r["value"], r["candidates"], r["more"]) for r in targets.resolve(asked, files, listed).collect()}
    assert got["p", "auth.ts"] == ("file", "auth.ts", None, False) and got["q", "auth.ts"] == ("file", "lib/auth.ts", None, False)
    assert got["p", "page.tsx"][:2] == ("feature", "page.tsx") and got["p", "ORDER store"][:2] == ("feature", "Order Store") and got["p", "app/page.tsx"][:2] == ("file", "app/page.tsx")
    assert got["p", "index.ts"] == ("ambiguous", None, [f"d{i}/index.ts" for i in range(5)], True) and got["p", "uth.ts"][0] == "unknown" and got["p", " "][0] == got["p", None][0] == "project"
    told = spark.createDataFrame([("p", "Order flow"), ("p", "Border flow"), ("p", "Request /api/x")], "project_id string, name string")
    asked = spark.createDataFrame([("p", t) for t in ("order FLOW", "order", "/API", "x", "zzz", "")], "project_id string, target string")
    got = {r["target"]: (r["mode"], r["names"]) for r in targets.resolve_flows(asked, told).collect()}
    assert got == {"order FLOW": ("exact", ["Order flow"]), "order": ("ambiguous", ["Border flow", "Order flow"]), "/API": ("partial", ["Request /api/x"]), "x": ("partial", ["Request /api/x"]), "zzz": ("unknown", None), "": ("all", None)}


def test_fused_evidence(shop):
    _, found, routed, listed, index, _ = shop
    ask = lambda q, *more: retrieval.ranked(index, found.analyses, found.edges, listed, routed, found.entry_points, found.critical_files, q, *more).orderBy("rank").collect()
    got = ask("explain orders")
    assert got[0]["path"] == "app/api/orders/route.ts" and got[0]["confidence"] == "high"
    assert {"handles route /api/orders", 'keyword path term matches "orders"', "important snapshot file"} <= set(got[0]["reasons"])
    assert got[0]["reasons"].index('keyword path term matches "orders"') < got[0]["reasons"].index("handles route /api/orders")
    assert any("imported by relevant file app/api/orders/route.ts" in r["reasons"] for r in got)
    assert len(ask("where are orders")) <= 2
    entry = ask("explain the main entry")
    assert all("project entry point" in r["reasons"] for r in entry if r["score"] >= 40)
    weak = retrieval.evidence_rows(index, found.analyses, listed, routed, found.entry_points, "explain zebra", ["order store"])
    assert ("lib/order-store.ts", 14, 'expanded term path term matches "order store"') in rows(weak, "path", "points", "reason")


def test_explained_similarity_and_followed_features(spark):
    make = "project_id string, name string, files array<string>, search_terms array<string>"
    pair = spark.createDataFrame([("p", "Plan Management", ["a", "b", "c"], ["plan"]), ("p", "Plans", ["b", "c", "d"], ["plan", "x"]), ("p", "Bare", [], [])], make)
    full = pair.withColumn("entities", features.entities(F.col("name"), F.col("search_terms")))
    side = lambda name, as_: full.filter(F.col("name") == name).select(F.struct("name", "files", "search_terms", "entities").alias(as_))
    got = side("Plan Management", "a").join(side("Plans", "b")).select(features.explained("a", "b").alias("e")).first()["e"]
    factors = {f["name"]: f for f in got["factors"]}
    assert factors["files"]["detail"] == "overlap 2/3 files" and factors["entities"]["detail"] == "one side empty" and factors["search_terms"]["detail"] == "jaccard 0.500"
    assert abs(got["score"] - sum(f["contribution"] for f in got["factors"])) < 1e-9 and got["similar"] and got["weaknesses"] == []
    lone = side("Plans", "a").join(side("Bare", "b")).select(features.explained("a", "b").alias("e")).first()["e"]
    assert not lone["similar"] and "no files" in lone["weaknesses"][0] and len(lone["weaknesses"]) == 1 + (lone["score"] >= 0.25)
    old = features.signatures(pair)
    new = features.signatures(spark.createDataFrame([("p", "Subscriptions", ["c", "a", "b"], ["plan"]), ("p", "Fresh", ["z"], [])], make))
    got = {r["name"]: (r["was"], r["score"] and round(r["score"], 3)) for r in features.followed(old, new).collect()}
    assert got["Fresh"] == (None, None) and got["Subscriptions"][0] == "Plan Management"


def test_facts_of_pruned_files_and_lines_of_script_blocks(spark, tmp_path):
    for name, text in {"package.json": "{}", "yarn.lock": "x", "package-lock.json": "{}", "a.ts": ""}.items():
        (tmp_path / name).write_text(text)
    files, facts = tree.read_tree(spark, str(tmp_path), "t"), tree.read_facts(spark, str(tmp_path), "t")
    assert rows(files, "path") == [("a.ts",), ("package.json",)]
    assert rows(facts, "fact", "value") == [("folder_name", tmp_path.name), ("lock_manager", "npm")]
    assert rows(detectors.metadata(files, facts), "name", "package_manager") == [(tmp_path.name, "npm")]
    declared = tree.from_rows(spark, "t", {"package.json": '{"name": "n", "packageManager": "bun@1"}'})
    assert rows(detectors.metadata(declared, facts), "name", "package_manager") == [("n", "bun")] and rows(detectors.metadata(files), "name", "package_manager") == [("t", "unknown")]
    (tmp_path / "package-lock.json").unlink()
    (tmp_path / "yarn.lock").unlink()
    assert {r["value"] for r in tree.read_facts(spark, str(tmp_path)).collect()} == {None, tmp_path.name}
    vue = tree.from_rows(spark, "v", {"a.vue": "<template>\n</template>\n<script>\nexport function f() {}\n</script>\n", "b.astro": "---\nconst x = 1\n---\n"})
    lines = lambda remap: [(r["path"], [s["line"] for s in r["symbols"]]) for r in parsing.analyse(vue, remap).orderBy("path").collect()]
    assert lines(False) == [("a.vue", [2]), ("b.astro", [1])] and lines(True) == [("a.vue", [4]), ("b.astro", [2])]


def test_how_users_share_data(spark):
    model = lambda name, *lines: f"model {name} {{\n  id String @id\n" + "".join(f"  {x}\n" for x in lines) + "}\n"
    schemas = {
        "chat": model("User", "name String") + "\n" + model("Message", "senderuserid String", "recipientuserid String", "senderid String"),
        "team": model("User", "groups Group[]") + "\n" + model("Group", "users User[]"),
        "camel": model("User", "name String") + "\n" + model("Note", "senderId String"),
        "one": model("Note", "x String"),
        "late": model("Note", "members String"),
    }
    files = None
    for name, text in schemas.items():
        more = tree.from_rows(spark, name, {"a.prisma": text})
        files = more if files is None else files.unionByName(more)
    fields = graph.written(entities.prisma_fields(files))
    extracted = entities.extract(files, fields, spark.createDataFrame([], "project_id string, route string, file string, kind string"))
    assert rows(entities.ownership(extracted, fields, entities.graph_relations(fields)), "project_id", "ownership", "shared_fields") == [
        ("camel", "single_user_isolated", []), ("chat", "direct_messaging", ["Message.senderid"]), ("late", "shared_access", ["Note.members"]), ("one", "unclear", []), ("team", "shared_access", []),
    ]


def test_questions_on_a_project(shop):
    _, found, routed, listed, _, _ = shop
    known = entities.extract(shop[0], found.fields, routed)
    (q,) = memo.domain_questions(questions.domain_facts(found, listed, known, feature_list.capabilities(routed, known), routed)).collect()
    asked = q["question"]
    assert (asked["entities"], asked["capabilities"], asked["framework"], asked["routes"], asked["ownership"]) == (["Order"], ["crud"], "nextjs", 1, "unclear")
    assert "Authentication" in asked["features"] and "crud" not in asked["absent"]
