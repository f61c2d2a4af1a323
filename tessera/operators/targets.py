"""What users mean by a name: whole batches of targets resolved by joins against every way in which a path may be cut.

Files are indexed by all their suffixes that begin at a folder, so a target is looked up and never searched for. Of several
candidates the first five are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 5


def suffixes(files: DataFrame) -> DataFrame:
    """(project_id, suffix, path): every path, and what follows each of its slashes."""
    parts = F.split("path", "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("project_id", "path", F.explode(cut).alias("suffix")).distinct()


def _first(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the first SHOWN values in order, with how many there are."""
    order = Window.partitionBy(*by).orderBy(F.expr(f"{value} COLLATE UNICODE"), value)
    kept = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SHOWN)
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    listed = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))).alias("c"))
    return listed.join(n, by).select(*by, F.col("c")["v"].alias("candidates"), "n")


def resolve(targets: DataFrame, files: DataFrame, features: DataFrame) -> DataFrame:
    """targets(project_id, target) to (project_id, target, mode, value, candidates, more).

    mode is project for a blank target, feature for a feature's name in any case, file for a whole path or the end of one
    path alone, ambiguous for the end of several, of which candidates are the first and more tells of others, else unknown.
    """
    by = ["project_id", "target"]
    asked = targets.select(*by).distinct()
    lowered = asked.withColumn("low", F.lower("target")).join(features.select("project_id", "name", F.lower("name").alias("low")), ["project_id", "low"])
    named = lowered.groupBy(*by).agg(F.min("name").alias("feature"))
    exact = asked.join(files.select("project_id", F.col("path").alias("target"), F.lit(True).alias("whole")).distinct(), by)
    ends = asked.join(suffixes(files).withColumnRenamed("suffix", "target"), by)
    rows = asked.join(named, by, "left").join(exact, by, "left").join(_first(ends, by, "path"), by, "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    mode = (
        F.when(F.coalesce(F.trim("target"), F.lit("")) == "", "project").when(F.col("feature").isNotNull(), "feature")
        .when(F.col("whole") | (F.col("n") == 1), "file").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    )
    value = F.when(F.col("mode") == "feature", F.col("feature")).when((F.col("mode") == "file") & F.col("whole"), F.col("target")).when(F.col("mode") == "file", F.col("candidates")[0])
    several = F.col("mode") == "ambiguous"
    return rows.withColumn("mode", mode).select(
        *by, "mode", value.alias("value"), F.when(several, F.col("candidates")).alias("candidates"), (several & (F.col("n") > SHOWN)).alias("more")
    )


def trigrams(text: str) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def resolve_flows(targets: DataFrame, told: DataFrame) -> DataFrame:
    """targets(project_id, target) against told(project_id, name) to (project_id, target, mode, names, more).

    all for a blank target; exact for all flows of that name in any case; partial for the one whose name contains it; ambiguous
    with the first candidates; else unknown. Parts of three letters or more are looked up by their rarest trigram's list
    of names and then tested; shorter ones meet all names of their project.
    """
    by = ["project_id", "target"]
    asked = targets.select(*by, F.lower("target").alias("low")).distinct()
    names = told.select("project_id", "name", F.lower("name").alias("flow")).distinct()
    exact = asked.join(names.withColumnRenamed("flow", "low"), ["project_id", "low"]).select(*by, "name")
    grams = names.select("project_id", "name", "flow", F.explode(trigrams("flow")).alias("gram"))
    common = grams.groupBy("project_id", "gram").agg(F.count("*").alias("n"))
    cut = asked.filter(F.length("low") >= 3).select(*by, "low", F.explode(trigrams("low")).alias("gram")).join(common, ["project_id", "gram"], "left")
    rarest = cut.groupBy(*by, "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select(*by, "low", F.col("g.gram").alias("gram"))
    found = rarest.join(grams, ["project_id", "gram"]).filter(F.contains("flow", F.col("low"))).select(*by, "name")
    short = asked.filter((F.length("low") < 3) & (F.trim("low") != "")).join(names, "project_id").filter(F.contains("flow", F.col("low"))).select(*by, "name")
    whole = _first(exact.distinct(), by, "name").select(*by, F.col("candidates").alias("exact"), F.col("n").alias("n_exact"))
    part = _first(found.unionByName(short).distinct(), by, "name")
    rows = asked.join(whole, by, "left").join(part, by, "left")
    mode = (
        F.when(F.trim("target") == "", "all").when(F.col("n_exact") > 0, "exact").when(F.col("n") == 1, "partial").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    )
    return rows.select(*by, mode.alias("mode"), F.coalesce("exact", "candidates").alias("names"), (F.coalesce("n_exact", "n", F.lit(0)) > SHOWN).alias("more"))
