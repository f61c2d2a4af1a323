"""What the operators share: the folder that all executors see, written tables, and the word definition."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: 64-bit words of a bitmap of hashes (8 MB).
BITMAP_WORDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, which only a local master allows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/tessera-shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts lineage with files that outlive any executor. An empty df gives an empty table of the same schema.
    codec: the compression of the files, the session's if None.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (see WORD) of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id takes part as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def bitmap(hashes: DataFrame) -> np.ndarray:
    """hashes(h) as bits of an array of fixed size: a hash that was not given may seem to be there, none is missed."""
    at = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    words = hashes.groupBy(at.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each of the signed 64-bit hashes may be among those that the bitmap was made of."""
    x = hashes.view(np.uint64)
    return (bits[(x >> np.uint64(6)) & np.uint64(BITMAP_WORDS - 1)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
