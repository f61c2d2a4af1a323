"""Product features: weighted similarity of two features, and the order-dependent merge of a project's feature list.

The merge is a fold: a feature joins the most similar one so far (the earliest of equals) at THRESHOLD or more and may
thereby change later matches, so it is neither a join nor connected components. Tens of rows a project are folded in one
group; all projects run in parallel.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Weights of files, terms, entities and name; the cut; most terms after a merge.
WEIGHTS = {"files": 0.45, "search_terms": 0.25, "entities": 0.20, "name": 0.10}
THRESHOLD = 0.35
MAX_TERMS = 8
RANK = {"high": 2, "medium": 1, "low": 0}

FEATURE = (
    "project_id string, ord int, name string, purpose string, files array<string>, entry_points array<string>, "
    "search_terms array<string>, evidence array<string>, business_flow array<string>, confidence string"
)


def normal_terms(terms: Column) -> Column:
    return F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def entities(name: Column, terms: Column) -> Column:
    """What a feature's name says before its last word, and terms in title case."""
    of_name = F.regexp_extract(name, r"(?i)^(.+?)\s+(?:Management|System|Module|Feature|Service)\z", 1)
    return F.array_distinct(F.concat(F.when(of_name != "", F.array(F.trim(of_name))).otherwise(F.array().cast("array<string>")), F.filter(terms, lambda t: t.rlike("^[A-Z]"))))


def similarity(a: str, b: str) -> Column:
    """Of two struct columns with name, files, search_terms and entities: 0 to 1."""
    parts = [WEIGHTS["files"] * text.jaccard(F.col(f"{a}.files"), F.col(f"{b}.files"))]
    parts += [WEIGHTS[k] * text.jaccard(normal_terms(F.col(f"{a}.{k}")), normal_terms(F.col(f"{b}.{k}"))) for k in ("search_terms", "entities")]
    parts.append(WEIGHTS["name"] * text.dice(text.trigrams(F.col(f"{a}.name")), text.trigrams(F.col(f"{b}.name"))))
    return parts[0] + parts[1] + parts[2] + parts[3]


def explained(a: str, b: str, threshold: float = THRESHOLD) -> Column:
    """Of two struct columns as for similarity: (score, threshold, similar, factors, weaknesses).

    factors(name, score, weight, contribution, detail), one a part of the score; weaknesses tell of scores just below the
    threshold and of features without files.
    """
    terms = {k: (normal_terms(F.col(f"{a}.{k}")), normal_terms(F.col(f"{b}.{k}"))) for k in ("search_terms", "entities")}
    scores = {"files": text.jaccard(F.col(f"{a}.files"), F.col(f"{b}.files"))} | {k: text.jaccard(*v) for k, v in terms.items()}
    scores["name"] = text.dice(text.trigrams(F.col(f"{a}.name")), text.trigrams(F.col(f"{b}.name")))

    def detail(k: str, said: Column) -> Column:
        x, y = F.size(F.col(f"{a}.{k}")), F.size(F.col(f"{b}.{k}"))
        return F.when((x == 0) & (y == 0), "both empty").when((x == 0) | (y == 0), "one side empty").otherwise(said)

    shared = F.size(F.filter(F.col(f"{b}.files"), lambda f: F.array_contains(F.col(f"{a}.files"), f)))
    most = F.greatest(F.size(F.col(f"{a}.files")), F.size(F.col(f"{b}.files")))
    said = {"files": detail("files", F.when(shared > 0, F.format_string("overlap %d/%d files", shared, most)).otherwise("overlap none"))}
    said |= {k: detail(k, F.format_string("jaccard %.3f", scores[k])) for k in terms} | {"name": F.format_string("trigram %.3f", scores["name"])}
    factors = [
        F.struct(F.lit(k).alias("name"), scores[k].alias("score"), F.lit(w).alias("weight"), (scores[k] * w).alias("contribution"), said[k].alias("detail")) for k, w in WEIGHTS.items()
    ]
    total = similarity(a, b)
    bare = (F.size(F.col(f"{a}.files")) == 0) | (F.size(F.col(f"{b}.files")) == 0)
    near = (total < threshold) & (total >= threshold - 0.1)
    weak = F.array_compact(F.array(
        F.when(bare, "one or both sides have no files, so their overlap says little"), F.when(near, F.format_string(f"score %.3f is close to threshold {threshold}", total))
    ))
    return F.struct(total.alias("score"), F.lit(threshold).alias("threshold"), (total >= threshold).alias("similar"), F.array(*factors).alias("factors"), weak.alias("weaknesses"))


def signatures(features: DataFrame) -> DataFrame:
    """(project_id, name, files, terms, entities): what a feature is made of, each sorted and joined by bars, for storing."""
    kinds = {"files": F.col("files"), "terms": normal_terms(F.col("search_terms")), "entities": normal_terms(entities(F.col("name"), F.col("search_terms")))}
    return features.select("project_id", "name", *[F.array_join(F.array_sort(v), "|").alias(k) for k, v in kinds.items()])


def signature_similarity(a: str, b: str) -> Column:
    """Of two structs of signatures: as similarity without names, their weight shared out over the rest."""
    def part(x: str, k: str) -> Column:
        return F.filter(F.split(F.col(f"{x}.{k}"), r"\|"), lambda t: t != "")

    weights = {"files": WEIGHTS["files"], "terms": WEIGHTS["search_terms"], "entities": WEIGHTS["entities"]}
    scores = [text.jaccard(part(a, k), part(b, k)) * (w / (1 - WEIGHTS["name"])) for k, w in weights.items()]
    return scores[0] + scores[1] + scores[2]


def followed(before: DataFrame, after: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Signatures of two analyses to (project_id, name, was, score): the feature that each one was before, the most similar one.

    Only features that share a file, term or entity are held against each other; was is null for new ones.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        def marked(kind: str) -> Column:
            return F.transform(F.filter(F.split(kind, r"\|"), lambda t: t != ""), lambda t: F.concat(F.lit(f"{kind}:"), t))

        tagged = F.concat(*map(marked, ("files", "terms", "entities")))
        return df.select("project_id", F.col("name").alias(name), F.explode(F.array_distinct(tagged)).alias("part"))

    pairs = parts(after, "name").join(parts(before, "was"), ["project_id", "part"]).select("project_id", "name", "was").distinct()
    a = after.select("project_id", "name", F.struct("files", "terms", "entities").alias("a"))
    b = before.select("project_id", F.col("name").alias("was"), F.struct("files", "terms", "entities").alias("b"))
    scored = pairs.join(a, ["project_id", "name"]).join(b, ["project_id", "was"]).withColumn("score", signature_similarity("a", "b")).filter(F.col("score") >= threshold)
    best = scored.groupBy("project_id", "name").agg(F.min(F.struct((-F.col("score")).alias("s"), "was")).alias("m"))
    joined = after.select("project_id", "name").join(best, ["project_id", "name"], "left")
    return joined.select("project_id", "name", F.col("m.was").alias("was"), (-F.col("m.s")).alias("score"))


def _jaccard(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def _identity(row: dict) -> tuple[set, set, set, set]:
    named = re.match(r"^(.+?)\s+(?:Management|System|Module|Feature|Service)$", row["name"], re.IGNORECASE)
    about = ([named[1].strip()] if named else []) + [t for t in row["search_terms"] if re.match("[A-Z]", t)]
    padded = f"  {row['name'].lower()}  "
    return set(row["files"]), {t.strip().lower() for t in row["search_terms"]} - {""}, {t.strip().lower() for t in about} - {""}, {padded[i : i + 3] for i in range(len(padded) - 2)}


def score(a: tuple, b: tuple) -> float:
    grams = 2 * len(a[3] & b[3]) / (len(a[3]) + len(b[3]))
    return WEIGHTS["files"] * _jaccard(a[0], b[0]) + WEIGHTS["search_terms"] * _jaccard(a[1], b[1]) + WEIGHTS["entities"] * _jaccard(a[2], b[2]) + WEIGHTS["name"] * grams


def _generic(purpose: str) -> bool:
    return not purpose or bool(re.match(r"identifies .+ capability|manages .+ data and operations\.?$", purpose, re.IGNORECASE))


def _together(old: dict, new: dict) -> dict:
    def union(key: str) -> list:
        return list(dict.fromkeys([*old[key], *new[key]]))

    flow = old["business_flow"]
    empty = not flow or len(flow) == 1 and flow[0].lower().startswith("identify files related to ")
    return old | {
        "purpose": new["purpose"] if _generic(old["purpose"]) and not _generic(new["purpose"]) else old["purpose"],
        "files": union("files"), "evidence": union("evidence"), "entry_points": union("entry_points"), "search_terms": union("search_terms")[:MAX_TERMS],
        "business_flow": (new["business_flow"] or flow) if empty else flow,
        "confidence": max(old["confidence"], new["confidence"], key=RANK.__getitem__),
    }


def fold(rows: list[dict], threshold: float = THRESHOLD, apart: int = 0) -> list[dict]:
    """The list after each row, in order, has joined the most similar one before it or been added; always if ord < apart."""
    merged: list[dict] = []
    known: list[tuple] = []
    for row in rows:
        own = _identity(row)
        best, at = max(((score(k, own), -i) for i, k in enumerate(known)), default=(0.0, 0))
        if known and best >= threshold and row["ord"] >= apart:
            merged[-at] = _together(merged[-at], row)
            known[-at] = _identity(merged[-at])
        else:
            merged.append(row)
            known.append(own)
    return merged


def merge(features: DataFrame, threshold: float = THRESHOLD, apart: int = 0) -> DataFrame:
    """features of FEATURE, with ord unique in a project, to the merged lists; the first name stays.

    Those with ord below apart begin the list as they are; later ones may join them."""
    columns = [c.split()[0] for c in FEATURE.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("ord").to_dict("records")
        rows = [{k: list(v) if hasattr(v, "tolist") else v for k, v in r.items()} for r in rows]
        return pd.DataFrame(fold(rows, threshold, apart), columns=columns)

    return features.select(columns).groupBy("project_id").applyInPandas(run, FEATURE)
