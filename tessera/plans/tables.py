"""The operators on the star-schema, text and page tables: documents stand for files, links between rows for imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, ranking, search
from .registry import query, read



def one() -> Column:
    """One project for tables that have no project of their own."""
    return F.lit("all").alias("project_id")


@query("""
SELECT p_partkey, count(*)::BIGINT AS refs, (3 * count(*) + CASE WHEN p_size >= 45 THEN 12 ELSE 0 END + CASE WHEN p_type LIKE '%ECONOMY%' THEN 3 ELSE 0 END)::BIGINT AS score
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_size, p_type ORDER BY score DESC, p_partkey LIMIT 10
""")
def critical_parts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference counts, additive score, ten best: parts by the lines that name them."""
    edges = read(spark, sf_dir, "lineitem").select(one(), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", "p_type")
    scored = graph.reference_counts(edges).join(parts, "path")
    score = ranking.additive(3 * F.col("refs"), [(F.col("p_size") >= 45, 12, "large"), (F.col("p_type").contains("ECONOMY"), 3, "economy")])[0]
    return scored.select(F.col("path").alias("p_partkey"), "refs", score.cast("long").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


@query("""
SELECT doc_id, md5(text) AS md5, strlen(text)::BIGINT AS size, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\r?\n')) END::INTEGER AS lines FROM documents
""")
def file_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: digest, bytes, lines."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("size"), text.line_count(F.col("text")).alias("lines")
    )


@query("""
SELECT source, count(*)::BIGINT AS files, md5(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents GROUP BY source
""")
def corpus_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over the ordered path:digest lines of each source's documents."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return ranking.fingerprints(rows).select(F.col("project_id").alias("source"), "files", "fingerprint")


@query("""
WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages)
SELECT page_id, '/' || array_to_string(list_filter(string_split(p, '/'), lambda s: s <> ''), '/') AS route,
    len(list_filter(string_split(p, '/'), lambda s: s <> ''))::INTEGER AS depth FROM t
""")
def page_route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as routes."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.array_join(segments, "/")).alias("route"), F.size(segments).alias("depth"))


@query("""
SELECT page_id, regexp_extract(html, '(?is)<script(\\s[^>]*)?\\s*>(.*?)</script>', 2) AS script FROM pages
""".replace("\\\\", "\\"))
def page_script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first script block of every page."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<script(\s[^>]*)?\s*>(.*?)</script>", 2).alias("script"))


@query("""
WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(DISTINCT page_id)::BIGINT AS pages, count(*)::BIGINT AS links FROM links GROUP BY href
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with the pages that name them."""
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    by_page = links.groupBy("href", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("href").agg(F.count("*").alias("pages"), F.sum("n").alias("links"))


@query("""
WITH names AS (SELECT DISTINCT p_name FROM part),
grams AS (SELECT DISTINCT p_name, substr('  ' || lower(p_name) || '  ', i::BIGINT, 3) AS g FROM names, unnest(range(1, length(p_name) + 3)) AS t(i)),
sizes AS (SELECT p_name, count(*) AS n FROM grams GROUP BY p_name),
pairs AS (SELECT a.p_name AS left_name, b.p_name AS right_name, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.p_name < b.p_name GROUP BY 1, 2)
SELECT left_name, right_name, round(2.0 * shared / (l.n + r.n), 6) AS similarity
FROM pairs JOIN sizes l ON left_name = l.p_name JOIN sizes r ON right_name = r.p_name WHERE 2.0 * shared / (l.n + r.n) >= 0.5
""")
def part_name_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose trigrams overlap: an equi-join over trigrams of distinct names, each with its set's size."""
    names = read(spark, sf_dir, "part").select("p_name").distinct().withColumn("grams", text.trigrams(F.col("p_name")))
    grams = names.select("p_name", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    left, right = (grams.select(F.col("p_name").alias(f"{s}_name"), F.col("n").alias(f"{s}_n"), "g") for s in ("left", "right"))
    both = left.join(right, "g").filter("left_name < right_name").groupBy("left_name", "right_name", "left_n", "right_n").count()
    dice = 2.0 * F.col("count") / (F.col("left_n") + F.col("right_n"))
    return both.filter(dice >= 0.5).select("left_name", "right_name", F.round(dice, 6).alias("similarity"))


@query("""
WITH RECURSIVE e AS (
    SELECT DISTINCT a.s_nationkey AS src, c.c_nationkey AS dst FROM supplier a JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
), walk(node, distance) AS (
    SELECT (SELECT min(src) FROM e), 0 UNION SELECT dst, distance + 1 FROM walk JOIN e ON src = node WHERE distance < 25
)
SELECT node AS nation, min(distance)::INTEGER AS distance FROM walk GROUP BY node
""")
def nation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first distance from the first nation over shipments."""
    edges = graph.written(_nation_edges(spark, sf_dir))
    seed = edges.agg(F.min("src").alias("path")).select(one(), "path")
    return graph.distances(edges, seed).select(F.col("path").alias("nation"), "distance")


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation to customer nation, once for each pair of nations, ord by destination."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sold = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(one(), F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("c_nationkey").alias("ord")).distinct()


@query("""
WITH e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.n_name AS supplier_nation, b.n_name AS customer_nation FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey
""")
def nation_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between nations of different regions."""
    nations = read(spark, sf_dir, "nation")
    a = nations.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("ra"))
    b = nations.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("customer_nation"), F.col("n_regionkey").alias("rb"))
    return _nation_edges(spark, sf_dir).join(a, "src").join(b, "dst").filter("ra <> rb").select("supplier_nation", "customer_nation")


@query("""
WITH e AS (
    SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM e),
l0 AS (SELECT n_nationkey AS root, 0 AS depth, [n_nationkey] AS path, false AS is_cycle FROM nation),
l1 AS (SELECT root, 1 AS depth, list_append(path, dst) AS path, list_contains(path, dst) AS is_cycle FROM l0 JOIN r ON src = path[-1] AND k <= 3),
l2 AS (SELECT root, 2 AS depth, list_append(path, dst) AS path, list_contains(path, dst) AS is_cycle FROM l1 JOIN r ON src = path[-1] AND k <= 3 WHERE NOT is_cycle),
al AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT root, depth::INTEGER AS depth, array_to_string(path, '>') AS path, is_cycle,
    CASE WHEN is_cycle OR depth = 2 THEN 0 ELSE coalesce((SELECT greatest(max(n) - 3, 0) FROM r WHERE src = path[-1]), 0) END::BIGINT AS hidden FROM al
""")
def neighbourhood_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of depth 2 with 3 children a node, cycles marked and hidden children counted."""
    roots = read(spark, sf_dir, "nation").select(one(), F.col("n_nationkey").alias("path"))
    found = graph.bounded_paths(_nation_edges(spark, sf_dir), roots, depth=2, children=3)
    return found.select("root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "is_cycle", "hidden")


@query("""
SELECT l_partkey AS p_partkey, string_agg(DISTINCT lpad(l_suppkey::VARCHAR, 8, '0'), ',' ORDER BY lpad(l_suppkey::VARCHAR, 8, '0')) AS suppliers, count(*)::BIGINT AS uses, count(DISTINCT l_suppkey)::BIGINT AS distinct_uses
FROM lineitem GROUP BY l_partkey
""")
def reverse_graph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each part: once each in order, and the number of edges."""
    supplier = F.lpad(F.col("l_suppkey").cast("string"), 8, "0")
    edges = read(spark, sf_dir, "lineitem").select(one(), supplier.alias("src"), F.col("l_partkey").alias("dst"))
    each = graph.dependents(edges).join(graph.reference_counts(edges), ["project_id", "path"])
    return each.select(F.col("path").alias("p_partkey"), F.array_join("dependents", ",").alias("suppliers"), F.col("refs").alias("uses"), F.size("dependents").cast("long").alias("distinct_uses"))


@query("""
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
AND NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 0)
""")
def owned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that only suppliers of the chosen nations deliver."""
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    node = F.concat(F.lit("s"), F.col("l_suppkey"))
    edges = lines.select(one(), node.alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    seeds = suppliers.filter("s_nationkey <> 0").select(one(), F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"))
    parts = graph.owned(edges, seeds).filter(F.startswith("path", F.lit("p")))
    return parts.select(F.substring("path", 2, 20).cast("long").alias("p_partkey"))


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000) ORDER BY c_acctbal DESC, c_custkey LIMIT 20
""")
def entry_points_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large open order: an anti-join and a bounded top-k."""
    orders = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    free = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey", "left_anti")
    return free.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")


@query("""
WITH d AS (SELECT o_orderkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS impacts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT o_orderkey, impacts, count(*)::BIGINT AS dependents FROM d JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def change_impact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the nations it touches, in order, and its dependent lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    suppliers = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "name")
    members = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(one(), F.col("l_orderkey").alias("path"), "name")
    edges = lines.select(one(), F.col("l_linenumber").cast("string").alias("src"), F.col("l_orderkey").alias("dst"))
    found = graph.change_impact(edges, members)
    return found.select(F.col("path").alias("o_orderkey"), F.array_join("impacts", ",").alias("impacts"), F.size("dependents").cast("long").alias("dependents"))


@query("""
WITH n AS (SELECT lang, count(*) AS files, sum(strlen(text)) AS bytes FROM documents GROUP BY lang),
s AS (SELECT sum(files) FILTER (lang = 'en') AS a, sum(files) FILTER (lang <> 'en') AS b, sum(files) AS files, sum(bytes) AS bytes FROM n)
SELECT files::BIGINT AS files, bytes::BIGINT AS bytes, CASE WHEN b = 0 THEN 'en' WHEN a = 0 THEN 'other' WHEN a >= 2 * b THEN 'en' WHEN b >= 2 * a THEN 'other' ELSE 'mixed' END AS dominant FROM s
""")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, and the dominance rule: pure, twice the other, or mixed."""
    rows = read(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("bytes"))
    sums = rows.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") != "en").alias("b"))
    return sums.select("files", "bytes", ranking.dominant(F.col("a"), F.col("b"), "en", "other").alias("dominant"))


@query("""
WITH v AS (SELECT user_id, ts::DATE AS day, bool_or(event_type IN ('view', 'click')) AS r, bool_or(event_type = 'purchase') AS w, bool_or(event_type = 'error') AS d, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n::BIGINT AS events, concat_ws('+', CASE WHEN r THEN 'read' END, CASE WHEN w THEN 'write' END) AS actions, CASE WHEN r AND w AND d THEN 'high' ELSE 'medium' END AS confidence FROM v WHERE r OR w
""")
def user_crud_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as verbs on a user's day: read, write, and all three for high confidence."""
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.bool_or(F.col("event_type").isin("view", "click")).alias("r"),
        F.bool_or(F.col("event_type") == "purchase").alias("w"), F.bool_or(F.col("event_type") == "error").alias("d"),
    )
    actions = F.concat_ws("+", F.when(F.col("r"), "read"), F.when(F.col("w"), "write"))
    confidence = F.when(F.col("r") & F.col("w") & F.col("d"), "high").otherwise("medium")
    return days.filter("r OR w").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "events", actions.alias("actions"), confidence.alias("confidence"))


@query("""
SELECT user_id, event_type, count(*)::BIGINT AS n, round(avg((props::JSON ->> 'k')::DOUBLE), 6) AS mean_k, max((props::JSON ->> 'k')::BIGINT) AS max_k FROM events GROUP BY 1, 2
""")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values of a text column; malformed text is null."""
    k = F.from_json("props", "k double")["k"]
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean_k"), F.max(k.cast("long")).alias("max_k"))


@query("""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1
""")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal documents: a map-side minimum, no window over copies."""
    rows = read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("hash"), "doc_id", "source")
    return rows.groupBy("hash").agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("""
WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 4)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h
""")
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two versions of a corpus that are derived from the documents."""
    docs = read(spark, sf_dir, "documents")
    digest = F.md5(F.col("text").cast("binary"))
    before = docs.filter("doc_id % 7 <> 3").select(one(), F.col("doc_id").alias("path"), digest.alias("hash"))
    edited = F.when(F.col("doc_id") % 5 == 1, F.md5(F.concat("text", F.lit("!")).cast("binary"))).otherwise(digest)
    after = docs.filter("doc_id % 11 <> 4").select(one(), F.col("doc_id").alias("path"), edited.alias("hash"))
    return ranking.changes(before, after).select(F.col("path").alias("doc_id"), "change")


@query("""
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark),
wt AS (SELECT doc_id, len(t) AS n, unnest(t) AS x FROM w), bt AS (SELECT item_id, len(t) AS m, unnest(t) AS x FROM b)
SELECT item_id, doc_id, round(count(*)::DOUBLE / (n + m - count(*)), 6) AS similarity FROM wt JOIN bt USING (x) GROUP BY item_id, doc_id, n, m HAVING count(*)::DOUBLE / (n + m - count(*)) >= 0.15
""")
def doc_jaccard_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose word sets overlap with a benchmark item's, by an equi-join over words."""
    return search.set_similarity(
        read(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_id"), F.array_distinct(text.split_words(F.col("text"))).alias("terms")),
        read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("right_id"), F.array_distinct(text.split_words(F.col("text"))).alias("terms")),
        0.15,
    ).select(F.col("right_id").alias("item_id"), F.col("left_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


@query("""
WITH k AS (SELECT unnest(['the', 'tion', 'script', 'atonre']) AS w),
h AS (SELECT page_id, url, sum(CASE WHEN contains(lower(url), w) THEN 30 ELSE 0 END + CASE WHEN contains(lower(html), w) THEN 6 ELSE 0 END) AS score FROM pages, k GROUP BY 1, 2)
SELECT page_id, score::BIGINT AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM h WHERE score >= 12
""")
def keyword_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted keyword scores over URL and body, cut and graded."""
    words = ["the", "tion", "script", "atonre"]
    scored = read(spark, sf_dir, "pages").select("page_id", search.keyword_score([(F.lower("url"), 30), (F.lower("html"), 6)], words).alias("score"))
    return scored.filter("score >= 12").select("page_id", F.col("score").cast("long").alias("score"), search.confidence(F.col("score")).alias("confidence"))


@query("""
WITH s AS (SELECT p_partkey, 100 * (p_size + 50) AS score FROM part), top AS (SELECT * FROM s ORDER BY score DESC, p_partkey LIMIT 5),
e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), out AS (
    SELECT dst AS node, 's' AS kind, max(greatest(25, score // 4)) AS score FROM top JOIN e ON src = p_partkey GROUP BY 1
), back AS (SELECT src AS node, 'p' AS kind, max(greatest(25, score // 5)) AS score FROM out JOIN e ON dst = node GROUP BY 1)
SELECT kind, node, score::BIGINT AS score FROM out UNION ALL SELECT kind, node, score::BIGINT FROM back
""")
def graph_neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best parts hand a share of their score to their suppliers, and these to all their parts."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (100 * (F.col("p_size") + 50)).alias("score"))
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    best = parts.orderBy(F.desc("score"), "src").limit(5)
    out = search.hand_on(best, edges, 4)
    back = search.hand_on(out.withColumnRenamed("dst", "src"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 5)
    return out.select(F.lit("s").alias("kind"), F.col("dst").alias("node"), "score").unionByName(back.select(F.lit("p").alias("kind"), F.col("dst").alias("node"), "score"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
f AS (SELECT doc_id, any_value(n) AS n, min(i) FILTER (contains(lower(line), 'thonin') OR contains(lower(line), 'aient')) AS hit FROM l GROUP BY doc_id)
SELECT doc_id, greatest(1, least(hit - 1, n - 2))::INTEGER AS first_line, least(n, greatest(1, least(hit - 1, n - 2)) + 2)::INTEGER AS last_line FROM f WHERE hit IS NOT NULL
""")
def relevant_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of three lines around the first line with a keyword, kept inside the text."""
    docs = read(spark, sf_dir, "documents")
    first, last = search.window(F.col("text"), ["thonin", "aient"], 3)
    return docs.select("doc_id", first.alias("first_line"), last.alias("last_line")).filter("first_line IS NOT NULL")


@query("""
WITH c AS (
    SELECT 0 AS b, o_orderkey AS k, 0 AS o, o_orderkey AS key FROM orders WHERE o_orderkey IN (3, 5, 7)
    UNION ALL SELECT 1, o_orderkey, o_orderkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 4)
    UNION ALL SELECT 2, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey), o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 12
), f AS (SELECT key, min((b, o, k)) AS seen FROM c GROUP BY key)
SELECT key AS o_orderkey, row_number() OVER (ORDER BY seen)::INTEGER AS place FROM f ORDER BY seen LIMIT 12
""")
def onboarding_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered buckets in one list, first seen wins, twelve at most."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", "o_totalprice")
    known = orders.filter(F.col("path").isin(3, 5, 7)).select("path", F.lit(0).cast("double").alias("ord"))
    partial = orders.filter("o_orderstatus = 'P'").orderBy("path").limit(4).select("path", F.col("path").cast("double").alias("ord"))
    large = orders.orderBy(F.desc("o_totalprice"), "path").limit(12).select("path", (-F.col("o_totalprice")).alias("ord"))
    return ranking.ordered_union([known, partial, large], 12).select(F.col("path").alias("o_orderkey"), "place")


@query("""
SELECT page_id, CASE WHEN regexp_matches(lower(url), '/(api|routes?)/') THEN 'api' WHEN regexp_matches(lower(url), 'page=') THEN 'listing' WHEN regexp_matches(lower(url), '://(m|mobile)\\.') THEN 'mobile'
    WHEN regexp_matches(lower(url), '/(de|fr|es)/') THEN 'localised' ELSE 'unknown' END AS scope FROM pages
""".replace("\\\\", "\\"))
def first_match_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered patterns, the first match decides."""
    from ..functions.paths import first_match

    rules = [("api", "/(api|routes?)/"), ("listing", "page="), ("mobile", r"://(m|mobile)\."), ("localised", "/(de|fr|es)/")]
    return read(spark, sf_dir, "pages").select("page_id", first_match(F.lower("url"), rules, "unknown").alias("scope"))


@query("""
SELECT p_partkey, array_to_string(list_slice(list_filter(list_distinct_ordered, lambda t: length(t) > 1 AND t NOT IN ('app', 'data', 'feature', 'file', 'handler', 'logic', 'page', 'service', 'system')), 1, 12), ' ') AS terms
FROM (SELECT p_partkey, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM
    (SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name || ' ' || p_brand || ' ' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM part))
""".replace("\\\\", "\\"))
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct telling terms of names, in order."""
    terms = text.search_terms(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(terms, " ").alias("terms"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+(?:s|ies|ses|xes|ches)')) AS word FROM documents)
SELECT word,
    upper(substr(e, 1, 1)) || substr(e, 2) AS entity, r AS resource FROM (SELECT word,
    CASE WHEN word LIKE '%ies' THEN left(word, length(word) - 3) || 'y' WHEN regexp_matches(word, '(sses|xes|ches|shes)$') THEN left(word, length(word) - 2)
         WHEN word LIKE '%ses' THEN left(word, length(word) - 1) WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS e,
    CASE WHEN word LIKE '%ies' THEN left(word, length(word) - 3) || 'y' WHEN regexp_matches(word, '(sses|xes|ches|ses)$') THEN left(word, length(word) - 2)
         WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS r FROM w)
""")
def singularize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both singular forms of all words that end like plurals."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:s|ies|ses|xes|ches)"), 0)).alias("word")).distinct()
    return words.select("word", text.entity_name(F.col("word")).alias("entity"), text.resource_name(F.col("word")).alias("resource"))


@query("""
WITH s AS (SELECT * FROM (VALUES ('listing', '[?&]page=', 2), ('deep', '/[0-9]+', 1), ('anchor', '#', 3), ('never', 'zzzz', 1)) t(name, pattern, least)),
h AS (SELECT name, least, split_part(url, '/', 3) AS host FROM pages JOIN s ON regexp_matches(url, pattern))
SELECT host, name, count(*)::BIGINT AS hits, CASE WHEN count(*) >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM h GROUP BY host, name, least HAVING count(*) >= least
""")
def behavioral_signals_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of patterns over URLs, with least matches a host."""
    signals = [("listing", "[?&]page=", 2), ("deep", "/[0-9]+", 1), ("anchor", "#", 3), ("never", "zzzz", 1)]
    pages = read(spark, sf_dir, "pages").select(F.element_at(F.split("url", "/"), 3).alias("host"), "url")
    return search.signals(pages, "host", F.col("url"), signals, high=4)


@query("""
WITH l AS (SELECT source, count(*) FILTER (quality = 1) AS strong, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, n::BIGINT AS evidence, CASE WHEN strong >= 2 THEN 'high' WHEN strong = 1 OR n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM l
""")
def confidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and other evidence, graded by counts."""
    labels = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = labels.groupBy("source").agg(F.count("*").alias("evidence"), F.count_if(F.col("quality") == 1).alias("strong"))
    return sums.select("source", "evidence", ranking.grade(F.col("strong"), F.col("evidence")).alias("confidence"))


@query("""
WITH l AS (SELECT page_id, lower(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS name FROM pages), v AS (SELECT * FROM (VALUES ('the', 'The'), ('and', 'And'), ('la', 'La'), ('der', 'Der')) t(name, service))
SELECT page_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM l JOIN v USING (name) GROUP BY page_id
""")
def service_detection_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lower-case names against a small vocabulary."""
    vocabulary = {"the": "The", "and": "And", "la": "La", "der": "Der"}
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("name"))
    found = search.vocabulary(links.select(F.col("page_id").alias("project_id"), F.lower("name").alias("name")), vocabulary)
    return found.select(F.col("project_id").alias("page_id"), F.array_join("names", ",").alias("services"))


@query("""
WITH s AS (SELECT p_brand, list_distinct(list(p_type)) AS types, list_distinct(list(p_size // 5)) AS sizes FROM part GROUP BY p_brand),
p AS (SELECT a.p_brand AS brand, b.p_brand AS other, 0.6 * len(list_intersect(a.types, b.types)) / len(list_distinct(list_concat(a.types, b.types))) + 0.4 * len(list_intersect(a.sizes, b.sizes)) / len(list_distinct(list_concat(a.sizes, b.sizes))) AS score
    FROM s a JOIN s b ON a.p_brand <> b.p_brand)
SELECT brand, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY round(score, 9) DESC, other) AS k FROM p WHERE score >= 0.35) WHERE k = 1
""")
def feature_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other brand by weighted set similarities, the first of equals, at 0.35 or more."""
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), F.collect_set(F.floor(F.col("p_size") / 5)).alias("sizes"))
    other = brands.select(F.col("p_brand").alias("other"), F.col("types").alias("other_types"), F.col("sizes").alias("other_sizes"))
    # brands that share nothing in either set score 0: only pairs with a common element are formed
    shared = brands.select("p_brand", F.explode("types").alias("t")).join(other.select("other", F.explode("other_types").alias("t")), "t")
    sized = brands.select("p_brand", F.explode("sizes").alias("t")).join(other.select("other", F.explode("other_sizes").alias("t")), "t")
    pairs = shared.select("p_brand", "other").union(sized.select("p_brand", "other")).filter("p_brand <> other").distinct()
    score = 0.6 * text.jaccard(F.col("types"), F.col("other_types")) + 0.4 * text.jaccard(F.col("sizes"), F.col("other_sizes"))
    scored = pairs.join(brands, "p_brand").join(other, "other").withColumn("score", score).filter("score >= 0.35")
    best = Window.partitionBy("p_brand").orderBy(F.round("score", 9).desc(), "other")
    return scored.withColumn("k", F.row_number().over(best)).filter("k = 1").select(F.col("p_brand").alias("brand"), "other", F.round("score", 6).alias("score"))
