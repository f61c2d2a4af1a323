"""The operators on projects of files, on the star-schema tables: rows stand for files, links between rows for imports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import business_flows, entities, features, graph, groups, memo, targets
from . import navigation
from .registry import query, read

SHIPMENTS = """
e AS (
    SELECT 's' || s_suppkey AS src, 'c' || c_custkey AS dst, min(l_orderkey * 10 + l_linenumber) AS ord
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), m AS (
    SELECT n_name AS name, dense_rank() OVER (ORDER BY n_name) AS rank, path, ord FROM nation JOIN (
        SELECT s_nationkey AS n, 's' || s_suppkey AS path, s_suppkey AS ord FROM supplier
        UNION ALL SELECT c_nationkey, 'c' || c_custkey, 1000000000 + c_custkey FROM customer) ON n = n_nationkey
)"""


def _shipments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, members): suppliers lead to customers whom they ship to, a nation's group holds its suppliers and customers."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    orders, suppliers, customers = (read(spark, sf_dir, t) for t in ("orders", "supplier", "customer"))
    sold = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(suppliers.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    sold = sold.join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy("l_suppkey", "o_custkey").agg(F.min("ord").alias("ord"))
    edges = sold.select(F.lit("all").alias("project_id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), "ord")
    own = suppliers.select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("s_suppkey").cast("long").alias("ord"))
    own = own.unionByName(customers.select(F.col("c_nationkey").alias("n_nationkey"), F.concat(F.lit("c"), "c_custkey").alias("path"), (F.col("c_custkey") + 1_000_000_000).alias("ord")))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.dense_rank().over(Window.orderBy("n_name")).alias("rank"))
    return edges, own.join(nations, "n_nationkey").select(F.lit("all").alias("project_id"), "name", "rank", "path", "ord")


@query(f"""
WITH {SHIPMENTS}, touched AS (
    SELECT m.name, CASE WHEN o.name = m.name THEN 'inner' ELSE 'out' END AS side, dst AS path, m.ord AS member, '' AS origin, e.ord FROM e JOIN m ON m.path = src JOIN m o ON o.path = dst
    UNION ALL SELECT m.name, 'in', src, m.ord, src, e.ord FROM e JOIN m ON m.path = dst JOIN m o ON o.path = src WHERE o.name <> m.name
), first AS (
    SELECT name, side, path, min({{'member': member, 'origin': origin, 'ord': ord}}) AS seen FROM touched WHERE side <> 'inner' GROUP BY ALL
)
SELECT name AS nation, side, path AS partner, row_number() OVER (PARTITION BY name, side ORDER BY seen, path)::INTEGER AS place, count(*) OVER (PARTITION BY name, side)::BIGINT AS total
FROM first QUALIFY place <= 25
""")
def nation_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first partners abroad of every nation's suppliers and customers, with how many there are."""
    edges, members = _shipments(spark, sf_dir)
    found = groups.boundary(graph.written(groups.sides(edges, graph.written(members))))
    return found.select(F.col("name").alias("nation"), "side", F.col("path").alias("partner"), "place", "total")


@query(f"""
WITH {SHIPMENTS}, met AS (
    SELECT a.name AS seller, b.name AS buyer, min({{'rank': a.rank, 'member': a.ord, 'ord': e.ord}}) AS seen FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.name <> b.name GROUP BY ALL
)
SELECT seller, buyer, row_number() OVER (ORDER BY seen, buyer)::INTEGER AS place FROM met
""")
def nation_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments contracted to nations, in the order in which a reader of the nations would meet them."""
    edges, members = _shipments(spark, sf_dir)
    return groups.quotient(edges, graph.written(members)).select(F.col("src").alias("seller"), F.col("dst").alias("buyer"), "place")


PART_FILES = """
f AS (
    SELECT p_type AS project, 'src/' || CASE p_size % 6 WHEN 0 THEN 'services' WHEN 1 THEN 'routes' WHEN 2 THEN 'repositories' WHEN 3 THEN 'commands' WHEN 4 THEN 'lib' ELSE 'models' END
        || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.ts' AS path, p_partkey, p_size, p_brand, p_name FROM part
)"""


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, ...): a file for every part, in a folder by its size; the types are projects."""
    folders = F.array(*map(F.lit, ["services", "routes", "repositories", "commands", "lib", "models"]))
    folder = F.element_at(folders, (F.col("p_size") % 6 + 1).cast("int"))
    path = F.concat(F.lit("src/"), folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("project_id"), path.alias("path"), "p_partkey", "p_size", "p_brand", "p_name")


@query(f"""
WITH {PART_FILES}, n AS (SELECT DISTINCT project, p_name FROM f), steps AS (
    SELECT project, p_name, 0 AS step, 'Handle API request in ' || min(path) || '.' AS line
    FROM (SELECT n.project, n.p_name, path FROM n JOIN f ON f.project = n.project AND f.path LIKE '%/routes/%'
          UNION ALL SELECT project, p_name, path FROM f
          UNION ALL SELECT n.project, n.p_name, path FROM n JOIN f ON f.project = n.project AND f.p_name <> n.p_name AND starts_with(replace(f.p_name, ' ', '') || '-', replace(n.p_name, ' ', ''))) GROUP BY ALL
    UNION ALL SELECT n.project, n.p_name, 1, 'Apply business logic in ' || min(path) || '.' FROM n JOIN f USING (project) WHERE path LIKE '%/services/%' GROUP BY ALL
    UNION ALL SELECT n.project, n.p_name, 2, 'Access data in ' || min(path) || '.' FROM n JOIN f USING (project) WHERE path LIKE '%/repositories/%' GROUP BY ALL
)
SELECT project, p_name || ' Management' AS feature, string_agg(line, chr(10) ORDER BY step) AS flow FROM steps GROUP BY ALL HAVING count(*) >= 3
""")
def part_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a feature for every part name, by templates over the files of its type."""
    files = _part_files(spark, sf_dir)
    listed = files.select("project_id", F.concat("p_name", F.lit(" Management")).alias("name")).distinct()
    found = business_flows.structural(files.select("project_id", "path"), listed)
    return found.select(F.col("project_id").alias("project"), F.col("name").alias("feature"), F.array_join("flow", "\n").alias("flow"))


@query(f"""
WITH {PART_FILES}, entries AS (
    SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY p_partkey) AS rank FROM f QUALIFY rank <= 20
), brands AS (SELECT project, p_brand, min(path) AS entry FROM f GROUP BY ALL), suppliers AS (
    SELECT project, path, count(DISTINCT l_suppkey) AS flows FROM f JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL
), scored AS (
    SELECT f.project, f.path, coalesce(1000000 - (rank - 1) * 10000, 0) + CASE WHEN p_size % 6 = 3 THEN 800 ELSE 0 END + greatest(0, 200 - 60 * (p_partkey % 7))
        + 120 * coalesce(flows, 0) + CASE WHEN entry IS NOT NULL THEN 100 ELSE 0 END + 40 + p_size AS score
    FROM f LEFT JOIN entries USING (project, path) LEFT JOIN suppliers USING (project, path) LEFT JOIN (SELECT project, entry FROM brands) b ON b.project = f.project AND entry = f.path
    WHERE p_size % 6 <> 5
)
SELECT project, path, score::BIGINT AS score, row_number() OVER (PARTITION BY project ORDER BY score DESC, path)::INTEGER AS place FROM scored QUALIFY place <= 8
""")
def part_start_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files to read first of every part type: brands are features, suppliers are flows through the parts that they ship."""
    files = graph.written(_part_files(spark, sf_dir))
    scope = F.when(F.col("p_size") % 6 == 3, "cli").when(F.col("p_size") % 6 == 5, "test").otherwise("service")
    index = files.select("project_id", "path", scope.alias("scope"), F.array("p_brand").alias("features"), F.col("p_size").alias("importance"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("p_partkey"))
    entries = files.select("project_id", "path", rank.alias("rank")).filter("rank <= 20")
    none = F.array().cast("array<string>")
    brands = files.groupBy("project_id", F.col("p_brand").alias("name")).agg(F.collect_list("path").alias("files"), F.min("path").alias("entry_point")).withColumn("entry_points", none)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("name"))
    flowing = lines.join(files, "p_partkey").select("project_id", "name", "path").distinct()
    distance = files.select("project_id", "path", (F.col("p_partkey") % 7).alias("distance"))
    scores = navigation.start_scores(entries, distance, index, brands, flowing, entries.limit(0))
    return navigation.start_here(scores).select(F.col("project_id").alias("project"), "path", "score", "place")


def _told(questions: list[str]) -> list[str]:
    """Stands for a model: fenced answers, plain ones, and one in five that is no answer."""
    out = []
    for q in map(json.loads, questions):
        said = json.dumps({"domain": q["brand"], "summary": q["type"], "confidence": q["parts"] / 8})
        out.append("no idea" if q["parts"] % 5 == 0 else f"```json\n{said}\n```" if q["parts"] % 2 else said)
    return out


@query("""
WITH q AS (SELECT p_brand, p_type, count(*) AS parts FROM part GROUP BY ALL)
SELECT p_brand AS brand, p_type AS type, substr(sha256('{"brand":"' || p_brand || '","type":"' || p_type || '","parts":' || parts || '}'), 1, 16) AS key,
    CASE WHEN parts % 5 <> 0 THEN p_type END AS summary, CASE WHEN parts % 5 <> 0 THEN least(1.0, parts / 8.0)::DOUBLE END AS confidence FROM q
""")
def brand_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on brands answered from outside, each distinct one once, kept by content."""
    asked = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("parts"))
    questions = graph.written(asked.withColumn("question", F.struct("brand", "type", "parts")))
    folder = f"{graph.shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    told = memo.fill(questions, _told, folder).withColumn("domain", memo.domain(F.col("answer")))
    return told.select("brand", "type", "key", F.col("domain.summary").alias("summary"), F.col("domain.confidence").alias("confidence"))


@query("""
WITH w AS (SELECT DISTINCT p_brand AS project, unnest(string_split(p_name, ' ')) AS word FROM part),
schema AS (SELECT DISTINCT p_brand AS project, 'prisma' AS source, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS entity FROM part WHERE p_size >= 48),
hints AS (SELECT project, 'route-hint' AS source, upper(substr(word, 1, 1)) || substr(word, 2) AS entity FROM w WHERE length(word) > 2 AND project NOT IN (SELECT project FROM schema))
SELECT * FROM schema UNION ALL SELECT * FROM hints
""")
def brand_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every brand: of its schema where it has one, else of what its routes are named after."""
    part = read(spark, sf_dir, "part").withColumn("project_id", F.col("p_brand"))
    entity = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring(F.col("p_type"), F.lit(2), F.length("p_type"))))
    fields = part.filter("p_size >= 48").select("project_id", entity.alias("entity"), F.struct(F.col("p_type").alias("path"), F.lit(0).alias("at")).alias("seen"))
    route = F.concat(F.lit("/api/"), F.replace("p_name", F.lit(" "), F.lit("s/")), F.lit("s/[id]"))
    routes = part.select("project_id", route.alias("route"), F.lit("routes.ts").alias("file"), F.lit("api").alias("kind"))
    files = part.select("project_id", F.lit("a.ts").alias("path"), F.lit(".ts").alias("extension"), F.col("p_name").alias("content"))
    return entities.extract(files, fields, routes).select(F.col("project_id").alias("project"), "source", "entity")


@query("""
WITH f AS (SELECT DISTINCT p_type AS project, p_brand || '/' || replace(p_name, ' ', '/') AS path FROM part),
t AS (SELECT DISTINCT project, target FROM f, unnest([path, string_split(path, '/')[3], string_split(path, '/')[2] || '/' || string_split(path, '/')[3], string_split(path, '/')[1]]) AS x(target)),
hits AS (SELECT t.project, target, path, path = target AS whole FROM t JOIN f ON f.project = t.project AND (path = target OR ends_with(path, '/' || target))),
sums AS (SELECT project, target, count(*) AS n, bool_or(whole) AS whole, string_agg(path, ',' ORDER BY path) AS every, (list(path ORDER BY path))[:5] AS firsts FROM hits GROUP BY ALL)
SELECT t.project, t.target, CASE WHEN whole OR n = 1 THEN 'file' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS mode,
    CASE WHEN whole THEN t.target WHEN n = 1 THEN firsts[1] END AS value, CASE WHEN n > 1 AND NOT whole THEN array_to_string(firsts, ',') END AS candidates, coalesce(n > 5 AND NOT whole, false) AS more
FROM t LEFT JOIN sums USING (project, target)
""")
def part_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and partial paths of parts resolved to the files that they mean."""
    path = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")))
    files = read(spark, sf_dir, "part").select(F.col("p_type").alias("project_id"), path.alias("path")).distinct()
    step = F.split("path", "/")
    asked = files.select("project_id", F.explode(F.array(F.col("path"), step[2], F.concat(step[1], F.lit("/"), step[2]), step[0])).alias("target")).distinct()
    none = files.select("project_id", F.lit("").alias("name")).limit(0)
    found = targets.resolve(asked, files, none)
    return found.select(F.col("project_id").alias("project"), "target", "mode", "value", F.array_join("candidates", ",").alias("candidates"), "more")


def _features(parts: DataFrame, name: Column) -> DataFrame:
    grouped = parts.groupBy(F.col("p_type").alias("project_id"), name.alias("name"))
    return grouped.agg(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))).alias("files"), F.array_sort(F.collect_set("p_name")).alias("search_terms"))


@query("""
WITH old AS (SELECT p_type AS project, p_brand AS name, list(DISTINCT p_partkey::VARCHAR) AS files, list(DISTINCT lower(trim(p_name))) AS terms FROM part WHERE p_size % 4 <> 0 GROUP BY ALL),
new AS (SELECT p_type AS project, replace(p_brand, 'Brand#', 'mark ') AS name, list(DISTINCT p_partkey::VARCHAR) AS files, list(DISTINCT lower(trim(p_name))) AS terms FROM part WHERE p_size % 4 <> 1 GROUP BY ALL),
scored AS (
    SELECT n.project, n.name, o.name AS was, len(list_intersect(n.files, o.files)) / len(list_distinct(list_concat(n.files, o.files)))::DOUBLE * (0.45::DOUBLE / 0.9::DOUBLE)
        + len(list_intersect(n.terms, o.terms)) / len(list_distinct(list_concat(n.terms, o.terms)))::DOUBLE * (0.25::DOUBLE / 0.9::DOUBLE) + 0.2::DOUBLE / 0.9::DOUBLE AS score
    FROM new n JOIN old o ON n.project = o.project WHERE len(list_intersect(n.files, o.files)) > 0 OR len(list_intersect(n.terms, o.terms)) > 0
), best AS (SELECT * FROM scored WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY round(score, 9) DESC, was) = 1)
SELECT n.project, n.name, was, round(score, 6) AS score FROM new n LEFT JOIN best b ON b.project = n.project AND b.name = n.name
""")
def brand_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of a later state of the parts under other names, each with the brand that it was before."""
    part = read(spark, sf_dir, "part")
    old = features.signatures(_features(part.filter("p_size % 4 <> 0"), F.col("p_brand")))
    new = features.signatures(_features(part.filter("p_size % 4 <> 1"), F.replace("p_brand", F.lit("Brand#"), F.lit("mark "))))
    return features.followed(old, new).select(F.col("project_id").alias("project"), "name", "was", F.round("score", 6).alias("score"))
