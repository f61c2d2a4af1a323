"""Answers from outside, asked once for each distinct question: a table of answers keyed by the question's content.

A question is a struct; its key is a digest of its JSON with arrays in order, so that neither the order of rows nor of names
asks anew. What the table holds is left out by an anti-join; the rest goes to the caller's function in batches inside tasks.
A batch that fails leaves no answers and stops no other. Answers are appended by one Spark write, whose commit keeps
one copy of each task's rows however often the task ran; of several answers to one key, as two runs at a time may
give, the earliest run's counts for all readers.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import written

BATCH = 20
ANSWERS = "key string, answer string, run string"
#: Takes the questions of a batch as JSON texts, gives as many answers; None where there is none.
Ask = Callable[[list[str]], list[str | None]]


def key(question: Column) -> Column:
    """16 hex digits of a question's digest. Arrays inside the question should be sorted by the caller where order is no matter."""
    return F.substring(F.sha2(F.to_json(question), 256), 1, 16)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(key, answer): what is known, one row a key."""
    try:
        held = spark.read.schema(ANSWERS).parquet(folder)
    except Exception as e:  # the folder does not exist before the first answer
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], ANSWERS)
    return held.groupBy("key").agg(F.min_by("answer", "run").alias("answer"))


def _asked(ask: Ask, run: str, batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    told = list(ask(part["question"].tolist()))
                    if len(told) != len(part):
                        raise ValueError(f"{len(told)} answers to {len(part)} questions")
                except Exception:  # whatever the outside did: this batch stays unanswered and is asked again by the next run
                    continue
                yield pd.DataFrame({"key": part["key"].tolist(), "answer": told, "run": run}).dropna(subset=["answer"])

    return task


def fill(questions: DataFrame, ask: Ask, folder: str, batch: int = BATCH, tasks: int | None = None) -> DataFrame:
    """questions(question struct, ...) to themselves with key and answer, null where the outside gave none.

    Distinct keys that the table in folder lacks are asked, batch at a time, in so many tasks at once, and appended to it.
    """
    spark = questions.sparkSession
    keyed = questions.withColumn("key", key(F.col("question")))
    new = keyed.select("key", F.to_json("question").alias("question")).dropDuplicates(["key"]).join(answers(spark, folder).select("key"), "key", "left_anti")
    # the outside is asked while this is written, and what is written is what is appended
    new = written(new)
    if new.take(1):
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        spread = new.repartition(tasks, "key") if tasks else new.repartition("key")
        spread.mapInPandas(_asked(ask, run, batch), ANSWERS).write.mode("append").parquet(folder)
    return keyed.join(answers(spark, folder), "key", "left")


# Kinds of capabilities that a project may lack; words that say nothing; bounds on what is asked and taken.
KINDS = ["crud", "sharing", "collaboration", "discovery", "publishing", "social", "file-management", "real-time", "search", "reporting"]
VAGUE = ["app", "data", "feature", "logic", "handler", "page", "service", "system"]
ENTITIES, RELATIONS, FEATURES, FIELDS, ABSENT, TAKEN, TERMS, KEPT_TERMS, SENTENCE = 15, 10, 10, 5, 8, 6, 8, 12, 180


def _some(values: Column, most: int) -> Column:
    return F.array_sort(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, most))


def domain_questions(facts: DataFrame) -> DataFrame:
    """facts(project_id, entities, relations, capabilities, features, framework, routes, ownership, shared_fields) to
    (project_id, question): what is told of each project that has entities or capabilities; lists are cut, then sorted."""
    absent = F.array_except(F.array(*map(F.lit, KINDS)), F.coalesce("capabilities", F.array().cast("array<string>")))
    question = F.struct(
        _some(F.col("entities"), ENTITIES).alias("entities"), _some(F.col("relations"), RELATIONS).alias("relations"), F.array_sort("capabilities").alias("capabilities"),
        _some(F.col("features"), FEATURES).alias("features"), "framework", "routes", "ownership", _some(F.col("shared_fields"), FIELDS).alias("shared_fields"), _some(absent, ABSENT).alias("absent"),
    )
    known = (F.size(F.coalesce("entities", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("capabilities", F.array().cast("array<string>"))) > 0)
    return facts.filter(known).select("project_id", question.alias("question"))


def domain(answer: Column) -> Column:
    """An answer's text as (domain, summary, confidence, features), or null where it is no such answer.

    Fences around the JSON are taken off, features without name or purpose dropped, six kept; confidence lies in 0 to 1.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?i)\A\s*```(json)?\s*", ""), r"```\s*\z", ""))
    told = F.from_json(bare, "domain string, summary string, confidence double, domainFeatures array<struct<name: string, purpose: string, relatedEntities: array<string>>>")
    none = F.array().cast("array<struct<name: string, purpose: string, relatedEntities: array<string>>>")
    named = F.filter(F.coalesce(told["domainFeatures"], none), lambda f: (F.coalesce(f["name"], F.lit("")) != "") & (F.coalesce(f["purpose"], F.lit("")) != ""))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(told["confidence"], F.lit(0.7))))
    sound = (F.coalesce(told["domain"], F.lit("")) != "") & (F.coalesce(told["summary"], F.lit("")) != "")
    return F.when(sound, F.struct(told["domain"].alias("domain"), told["summary"].alias("summary"), sure.alias("confidence"), F.slice(named, 1, TAKEN).alias("features")))


def domain_features(domains: DataFrame) -> DataFrame:
    """domains(project_id, domain) to features without files, for the merge: (project_id, ord, name, purpose, search_terms, ...)."""
    each = domains.filter("domain IS NOT NULL").select("project_id", F.posexplode("domain.features").alias("ord", "f"))
    none = F.array().cast("array<string>")
    words = F.filter(F.split(F.lower("f.name"), r"\s+"), lambda w: w != "")
    related = F.transform(F.coalesce("f.relatedEntities", none), lambda e: F.lower(e))
    terms = F.slice(F.array_distinct(F.concat(related, words)), 1, KEPT_TERMS)
    return each.select(
        "project_id", "ord", "f.name", "f.purpose", none.alias("files"), none.alias("entry_points"), terms.alias("search_terms"), none.alias("evidence"), none.alias("business_flow"),
        F.lit("medium").alias("confidence"),
    )


def eligible(index: DataFrame, analyses: DataFrame, critical: DataFrame) -> DataFrame:
    """(project_id, path, question): files of the full index that are worth a sentence from outside, with what is told of them."""
    both = ["project_id", "path"]
    rows = index.join(analyses.select(*both, "imports"), both).join(critical.select(*both, F.lit(True).alias("critical")), both, "left")
    low = F.lower("path")
    text = F.lower(F.concat_ws(" ", "path", F.array_join("exports", " "), F.array_join("imports", " ")))
    code = r"\.[cm]?[jt]sx?\z"
    anchor = low.rlike(r"(^|/)(src/)?(auth|proxy|middleware)" + code) | (low.rlike("providers?" + code) & F.contains(text, F.lit("next-auth")))
    anchor = anchor | (low.rlike("(app-shell|layout)" + code) & text.rlike(r"\b(signout|usesession|sessionprovider)\b"))
    telling = F.col("critical").isNotNull() | (F.col("importance") >= 20) | (F.size("features") > 0) | anchor
    question = F.struct(
        "path", "scope", F.slice("exports", 1, 8).alias("exports"), F.slice("imports", 1, 8).alias("imports"), F.slice("features", 1, 5).alias("features"), "importance"
    )
    return rows.filter(~F.col("scope").isin("test", "docs") & telling).select(*both, question.alias("question"))


def first_sentence(text: Column) -> Column:
    """Without repeated white space, to the first full stop, at most SENTENCE characters; null if nothing is left."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(bare != "", F.substring(F.element_at(F.split(bare, r"(?<=[.!?])\s+"), 1), 1, SENTENCE))


def telling_terms(terms: Column) -> Column:
    """Terms from outside in lower-case words, up to three each, without vague ones; the first TERMS."""
    clean = F.transform(terms, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\s-]+", " "), r"\s+", " ")))
    return F.slice(F.filter(clean, lambda t: (F.length(t) > 1) & (F.size(F.split(t, r"\s+")) <= 3) & ~t.isin(VAGUE)), 1, TERMS)


def enriched(index: DataFrame, told: DataFrame) -> DataFrame:
    """The full index with purposes and terms of told(project_id, path, answer: JSON with purpose and searchTerms) taken in."""
    said = F.from_json("answer", "purpose string, searchTerms array<string>")
    more = told.select("project_id", "path", first_sentence(said["purpose"]).alias("new_purpose"), telling_terms(said["searchTerms"]).alias("new_terms"))
    both = index.join(more, ["project_id", "path"], "left")
    terms = F.slice(F.array_distinct(F.concat("search_terms", F.coalesce("new_terms", F.array().cast("array<string>")))), 1, KEPT_TERMS)
    return both.withColumns({"purpose": F.coalesce("new_purpose", "purpose"), "search_terms": terms}).drop("new_purpose", "new_terms")
