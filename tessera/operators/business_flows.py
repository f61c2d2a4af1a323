"""How a feature works, step by step: patterns over all files of a project, else parts in authentication, else a walk.

The fixed templates are matched in one pass over the paths: each file is exploded to the steps whose pattern it fits, and
each step keeps its first file. Steps that name the feature itself are found through prefixes of path segments, so no
feature is held against all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence
from . import flows
from .graph import bounded, written

CODE = r"\.[cm]?[jt]sx?\z"
SCRIPT = r"\.[cm]?[jt]s\z"
DATA = r"/(repositories?|lib/prisma|lib/db)"
# Steps of features that are built alike everywhere: (feature, action, pattern, whether all its files are named).
TEMPLATES = [
    ("Authentication", "Guard protected routes", r"middleware" + CODE + r"|proxy" + CODE, False),
    ("Authentication", "Configure auth provider", r"/auth" + CODE + r"|/auth/config", False),
    ("Authentication", "Handle login", r"login.*route" + SCRIPT + r"|/api/auth/.*sign", False),
    ("Authentication", "Handle registration", r"register.*route" + SCRIPT + r"|/api/auth/register", False),
    ("Authentication", "Expose session context", r"provider.*" + CODE + r"|session.*provider", False),
    ("API Layer", "Receive and validate request", r"/(routes?|controllers?|handlers?)/", False),
    ("API Layer", "Apply business logic", r"/(services?|usecases?|domain)/", False),
    ("API Layer", "Access data layer", DATA, False),
    ("API Layer", "Return response", r"/(routes?|controllers?|handlers?)/", False),
    ("Service Layer", "Entry via service interface", r"/(services?|usecases?)/", False),
    ("Service Layer", "Validate business rules", r"/(validators?|schemas?|dto)/", False),
    ("Service Layer", "Persist via data layer", DATA, False),
    ("CLI Commands", "Parse and dispatch command", r"/(src/)?index" + SCRIPT + r"|/bin/", False),
    ("CLI Commands", "Execute command handler", r"/(commands?|cli)/", False),
    ("CLI Commands", "Render output", r"/(output|reporter|formatter|render)" + SCRIPT, False),
    ("AI Integration", "Build context", r"/(context|contextbuilder)" + SCRIPT, False),
    ("AI Integration", "Construct prompt", r"/(prompt|prompts)" + SCRIPT, False),
    ("AI Integration", "Call AI provider", r"/(openai|groq|openrouter|anthropic|gemini|provider)" + SCRIPT, True),
    ("AI Integration", "Process completion", r"/(completion|response|stream)" + SCRIPT, False),
]
# Steps of all other features; the first also fits files named after the feature.
OWN = "Handle API request"
GENERIC = [(OWN, r"/(routes?|controllers?|api)/"), ("Apply business logic", r"/(services?|usecases?|actions?)/"), ("Access data", r"/(repositories?|lib/prisma|db/)/")]
# What a file with a part in authentication does there, and what follows the file's name.
AUTH_STEPS = [
    (r"(^|/)(src/)?(proxy|middleware)" + CODE, "Guard requests in ", " by checking authentication state before protected routes"),
    (r"(^|/)(src/)?auth" + CODE, "Configure authentication in ", ", including providers, session/JWT callbacks, and shared auth helpers"),
    (r"register.*/route" + SCRIPT + r"|/api/.*register", "Handle registration in ", ", validating new users before creating credentials"),
    (r"login.*(page|form)" + CODE, "Render login UI in ", " and submit credentials to the auth provider"),
    (r"register.*(page|form)" + CODE, "Render registration UI in ", " and collect account creation details"),
    (r"providers?" + CODE, "Expose session context in ", " so client components can read authentication state"),
    (r"(app-shell|layout)" + CODE, "Consume session state in ", " for authenticated layouts, user navigation, or sign-out behavior"),
    (r"", "Review authentication-related behavior in ", ""),
]
LEAST_STEPS, AUTH_MOST, WALK = 3, 8, 4
RANK = {"high": 2, "medium": 1, "low": 0}


def _ordered(path: Column) -> Column:
    return F.struct(F.collate(path, "UNICODE").alias("key"), path.alias("path"))


def _line(action: Column, files: Column) -> Column:
    return F.concat(action, F.lit(" in "), files, F.lit("."))


def slug(name: Column) -> Column:
    """A feature's name without its last common noun, in lower case; words may then be parted by a dash, an underscore or nothing."""
    return F.regexp_replace(F.lower(name), r"\s+(management|system|module|feature)\z", "")


def named_first(paths: DataFrame, features: DataFrame) -> DataFrame:
    """(project_id, name, path): the first file of each feature with a folder or file below the root that begins like it.

    Segments are cut to the lengths that the project's features have, so the join is on equal strings; the pattern decides.
    The cut segments are many times the paths and never broadcast.
    """
    plain = F.regexp_replace("slug", r"\s+", "")
    wanted = written(features.select("project_id", "name", slug(F.col("name")).alias("slug")).withColumn("key", plain).filter("key <> ''"))
    lengths = wanted.groupBy("project_id").agg(F.collect_set(F.length("key")).alias("lengths"))
    low = F.lower("path")
    segments = F.slice(F.split(low, "/"), F.lit(2), F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    heads = F.array_distinct(F.flatten(F.transform(F.col("segments"), lambda s: F.transform(F.col("lengths"), lambda n: F.substring(s, F.lit(1), n)))))
    cut = paths.join(bounded(lengths), "project_id").withColumn("segments", F.transform(segments, lambda s: F.regexp_replace(s, "[-_]", "")))
    keyed = cut.select("project_id", "path", F.explode(heads).alias("key")).join(bounded(wanted), ["project_id", "key"])
    exact = F.concat(F.lit("/"), F.array_join(F.transform(F.split("slug", r"\s+"), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "[-_]?"))
    fits = keyed.filter(F.regexp_like(low, exact))
    return fits.groupBy("project_id", "name").agg(F.min(_ordered(F.col("path"))).alias("first")).select("project_id", "name", F.col("first.path").alias("path"))


def structural(paths: DataFrame, features: DataFrame) -> DataFrame:
    """(project_id, name, flow): steps of templates and their files, for features with LEAST_STEPS of them."""
    every = [(t, i, a, p, many) for i, (t, a, p, many) in enumerate(TEMPLATES)] + [(None, i, a, p, False) for i, (a, p) in enumerate(GENERIC)]
    low = F.lower("path")
    fits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(t).cast("string").alias("template"), F.lit(i).alias("step"), F.lit(a).alias("action"), F.lit(many).alias("many"))) for t, i, a, p, many in every]))
    hits = paths.select("project_id", "path", F.explode(fits).alias("s")).select("project_id", "path", "s.*")
    files = F.when(F.first("many"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("many"), _ordered(F.col("path"))))), lambda r: r["path"]), " and "))
    found = hits.groupBy("project_id", "template", "step", "action").agg(files.alias("all"), F.min(_ordered(F.col("path"))).alias("first"))
    found = written(found.select("project_id", "template", "step", "action", F.coalesce("all", F.col("first.path")).alias("files"), F.col("first.path").alias("path")))
    fixed = [t for t in dict.fromkeys(t for t, *_ in TEMPLATES)]
    names = features.select("project_id", "name")
    known = names.join(found.filter("template IS NOT NULL").withColumnRenamed("template", "name"), ["project_id", "name"]).select("project_id", "name", "step", "action", "files")
    others = names.filter(~F.col("name").isin(fixed))
    generic = others.join(found.filter("template IS NULL").drop("template"), "project_id").select("project_id", "name", "step", "action", "files", "path")
    own = named_first(paths, others).select("project_id", "name", F.lit(0).alias("step"), F.lit(OWN).alias("action"), F.col("path").alias("files"), "path")
    generic = generic.unionByName(own).groupBy("project_id", "name", "step", "action").agg(F.min_by("files", _ordered(F.col("path"))).alias("files"))
    lines = known.unionByName(generic.select("project_id", "name", "step", "action", "files"))
    told = lines.groupBy("project_id", "name").agg(F.array_sort(F.collect_list(F.struct("step", _line(F.col("action"), F.col("files")).alias("line")))).alias("s"))
    return told.filter(F.size("s") >= LEAST_STEPS).select("project_id", "name", F.col("s")["line"].alias("flow"))


def _auth_line(path: Column, entry: Column, uses: Column) -> Column:
    linked = F.when(F.size(uses) > 0, F.concat(F.lit(" and connects to "), F.array_join(F.slice(uses, 1, 2), ", "))).otherwise("")
    text = F.when((path == entry) & path.rlike("(^|/)api/"), F.concat(F.lit("Start at "), path, F.lit(".")))
    for pattern, before, after in AUTH_STEPS:
        text = text.when(F.lower(path).rlike(pattern), F.concat(F.lit(before), path, F.lit(after), linked, F.lit(".")))
    return text


def authentication(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, name, flow): what the first files of Authentication do, its entry point before all others."""
    own = features.filter("name = 'Authentication' AND size(files) > 0")
    rest = F.filter("files", lambda f: F.coalesce(f != F.col("entry_point"), F.lit(True)))
    ordered = F.slice(F.concat(F.array_compact(F.array("entry_point")), rest), 1, AUTH_MOST)
    each = own.select("project_id", "name", "entry_point", F.posexplode(ordered).alias("place", "src"))
    linked = each.join(edges.select("project_id", "src", F.col("ord").alias("at"), "dst"), ["project_id", "src"], "left")
    uses = linked.groupBy("project_id", "name", "entry_point", "place", "src").agg(F.array_sort(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("at", "dst")))).alias("u"))
    line = _auth_line(F.col("src"), F.col("entry_point"), F.col("u")["dst"])
    told = uses.groupBy("project_id", "name").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("s"))
    return told.select("project_id", "name", F.col("s")["line"].alias("flow"))


def walks(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, name, flow): the entry point and the first files of a walk from it."""
    seeds = features.filter("entry_point IS NOT NULL").select("project_id", "name", F.col("entry_point").alias("seed"))
    walked = flows.chains(edges, seeds.select("project_id", F.col("seed").alias("path")).distinct()).filter(F.col("step") < WALK)
    line = F.when(F.col("step") == 0, F.concat(F.lit("Start at "), "path", F.lit("."))).otherwise(F.concat(F.lit("Follow dependency "), "path", F.lit(".")))
    told = walked.groupBy("project_id", "seed").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("s"))
    found = seeds.join(told, ["project_id", "seed"]).select("project_id", "name", F.col("s")["line"].alias("flow"))
    lost = features.filter("entry_point IS NULL").select("project_id", "name", F.array(F.concat(F.lit("Identify files related to "), "name", F.lit("."))).alias("flow"))
    return found.unionByName(lost)


def with_flows(features: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """features(project_id, name, files, entry_point, ...) with business_flow; files(project_id, path) are all of the project."""
    kinds = (structural(files.select("project_id", "path"), features), authentication(features, edges), walks(features, edges))
    out = features
    for i, kind in enumerate(kinds):
        out = out.join(kind.withColumnRenamed("flow", f"flow{i}"), ["project_id", "name"], "left")
    return out.withColumn("business_flow", F.coalesce(*[f"flow{i}" for i in range(len(kinds))])).drop(*[f"flow{i}" for i in range(len(kinds))])


def feature_flows(features: DataFrame, most: int | None = 3, least: str = "high", exactly: bool = False) -> DataFrame:
    """(project_id, name, rank, entry_point, steps, confidence): the flows of the first features that are sure enough.

    Each step (label, file) names the first of the feature's files that its label contains. exactly: only features of that
    very confidence, as opposed to that or better.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("confidence")]
    sure = F.col("confidence") == least if exactly else rank >= RANK[least]
    unknown = F.exists("business_flow", lambda s: s.rlike("(?i)^identify files related to "))
    kept = features.filter(sure & (F.size("business_flow") > 1) & ~unknown)
    order = Window.partitionBy("project_id").orderBy(F.expr("name COLLATE UNICODE"), "name")
    kept = kept.withColumn("rank", F.row_number().over(order))
    kept = kept.filter(F.col("rank") <= most) if most else kept
    candidates = F.array_distinct(F.concat(F.array_compact(F.array("entry_point")), F.coalesce("entry_points", F.array().cast("array<string>")), "files"))
    steps = F.transform(F.slice("business_flow", 1, 6), lambda s: F.struct(s.alias("label"), F.try_element_at(F.filter(F.col("candidates"), lambda c: F.contains(s, c)), F.lit(1)).alias("file")))
    return kept.withColumn("candidates", candidates).select(
        "project_id", F.concat("name", F.lit(" flow")).alias("name"), "rank", "entry_point", steps.alias("steps"), F.when(F.col("confidence") == "high", "high").otherwise("medium").alias("confidence")
    )
