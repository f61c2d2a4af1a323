"""Text functions as Column expressions: term splitting, slugs, singular forms, set and trigram similarity, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a file, and irregular plurals.
VAGUE_TERMS = ["app", "data", "feature", "file", "handler", "logic", "page", "service", "system"]
IRREGULAR = {"children": "child", "data": "data", "feedback": "feedback", "media": "media", "men": "man", "people": "person", "women": "woman"}


def split_terms(text: Column) -> Column:
    """Lower-case ASCII words of a name; a lower-to-upper step and the end of a run of capitals also part words."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def search_terms(*texts: Column, most: int = 12) -> Column:
    """The first distinct telling terms of several names, in order."""
    terms = F.array_distinct(F.flatten(F.array(*map(split_terms, texts))))
    return F.slice(F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(VAGUE_TERMS)), 1, most)


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes, without a last file extension; "map" if nothing is left."""
    bare = F.regexp_replace(F.lower(text), r"\.[a-z0-9]+\z", "")
    dashed = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "map").otherwise(dashed)


def _without(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.greatest(F.length(text), F.lit(1))))


def _ends(text: Column, *ends: str) -> Column:
    found = F.endswith(text, F.lit(ends[0]))
    for e in ends[1:]:
        found = found | F.endswith(text, F.lit(e))
    return found


def entity_name(word: Column) -> Column:
    """The singular of a table or route name, as an entity name: verses is Verse, boxes is Box, categories is Category."""
    w = F.lower(word)
    out = F.when(F.lit(False), w)
    for plural, singular in IRREGULAR.items():
        out = out.when(w == plural, singular)
    out = out.when(_ends(w, "ies"), F.concat(_without(w, 3), F.lit("y"))).when(_ends(w, "sses", "xes", "ches", "shes"), _without(w, 2))
    out = out.when(_ends(w, "ses"), _without(w, 1)).when(_ends(w, "s") & ~_ends(w, "ss"), _without(w, 1))
    return capitalise(out.otherwise(w))


def resource_name(word: Column) -> Column:
    """The singular of a route resource; unlike entity_name it cuts "es" after any s and keeps the case."""
    out = F.when(_ends(word, "ies"), F.concat(_without(word, 3), F.lit("y"))).when(_ends(word, "sses", "xes", "ches", "ses"), _without(word, 2))
    return out.when(_ends(word, "s") & ~_ends(word, "ss"), _without(word, 1)).otherwise(word)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def trigrams(text: Column) -> Column:
    """The distinct three-letter windows of the lower-case text between two spaces on either side."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of trigrams."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\r?\n", -1)))


def split_words(text: Column) -> Column:
    """ASCII words and numbers of a text in lower case, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
