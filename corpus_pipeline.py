"""A training corpus from documents: language identification, near-deduplication, mixing, tokens.

Every stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a DataFrame.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language_id, mixing, shingle_sets
from tessera.llm.common import bitmap, in_bitmap, materialise, table

#: A document goes if no learned language explains at least this share of its words.
LEAST_EXPLAINED = 0.1


def _small_batches(spark: SparkSession) -> None:
    """Whole texts cross to Python in batches of so many rows, unless the session asks for other than the default."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one, so that none clashes with what an operator adds; and those that operators read."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach; those without a letter go.

    Null and empty texts have no language and go. Without any label nothing can be told apart, and all texts with a
    letter stay.
    """
    _small_batches(spark)
    languages, logs = language_id.fit(docs)
    if not languages:
        return docs.filter(language_id.has_letter(F.col("text")))
    # names that none of the operator's clash with; each text crosses to Python once
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    told = language_id.predict(plain, languages, logs, text_col=own["text"], keep=list(own.values()))
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("other_share") <= 1 - LEAST_EXPLAINED))
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more, by their exact sets:
    that with the smallest doc_id. The SimHash trie proposes, MinHash bands add what it cannot reach. Null ids come last; of repeated rows one stays."""
    _small_batches(spark)
    mark = F.xxhash64(*docs.columns)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), mark.alias("mark"))
    found = shingle_sets.groups(docs.select(key.alias("key"), "text"), id_col="key", width=5, similarity=0.8)
    told = found.groupBy("id").agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
    told = told.select(F.col("id")["mark"].alias("__mark"), "n", (F.col("id") == F.col("first")).alias("stays"))
    told = materialise(told, "told-documents")
    # texts of documents that no bit of the bitmap doubts stay where they are; the others are looked up
    doubts = bitmap(told.filter("n > 1 OR NOT stays").select(F.col("__mark").alias("h")))

    @F.pandas_udf("boolean")
    def doubted(marks: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(doubts, marks.to_numpy()))

    marked = docs.withColumn("__mark", mark)
    clear, unclear = marked.filter(~doubted("__mark")), marked.filter(doubted("__mark"))
    # what is kept grows with the corpus: a join that never broadcasts it
    kept = told.filter("stays")
    out = clear.unionByName(unclear.join(kept.filter("n = 1").hint("merge"), "__mark", "left_semi"))
    if kept.filter("n > 1").take(1):
        out = out.unionByName(unclear.join(kept.filter("n > 1").hint("merge"), "__mark", "left_semi").dropDuplicates(["__mark"]))
    return out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 1, 2, 3, repeating, at most three times their size."""
    mixed = mixing.mix(_packed(docs), carry=["doc"])
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts (little-endian, 32 bits each), their number, and whether decoding gives the text back."""
    _small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], restored="restored")
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "restored")


STAGES = [
    ("language identification", identify_language),
    ("near-deduplication", drop_near_duplicates),
    ("mixing", mix),
    ("byte-level tokens", tokenise),
]

#: Hash sketches and transducers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
