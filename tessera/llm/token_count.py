"""Token counts by a map-side two-tier lookup; pre-tokens are never shuffled.

Pre-tokens of a SentencePiece BPE model are runs of spaces with the characters up to the next space: merges never cross
their borders, because no piece of the vocabulary has a word-start mark after another character (checked when the
operator is built; a model without this property is encoded text by text).

Tier one is a compact table of the lengths of frequent pre-tokens, two arrays and one string that are broadcast. It is
taken from a bounded sample of rows, and it only makes counting faster: counts do not depend on it. Tier two: what is
not in the table is encoded by the library and remembered in a bounded cache of the worker process.

Edge cases: a null text counts as empty, with no token; texts are counted whole, whatever their length; strings that
look like special tokens are ordinary text; repeated rows are counted each; an empty table gives an empty result. Columns
that are not named stay out of the way: only the id columns asked for are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 2_000
TABLE_ROWS = 50_000
TABLE_UNIT = 48
CACHE_ROWS = 400_000
#: Texts that are looked up at once.
BLOCK = 256
MARK = "▁"
UNIT = re.compile(" +[^ ]*")


def units(text: str) -> list[str]:
    """The pre-tokens, each with its spaces; the space that the model puts before a text is the first one's."""
    return UNIT.findall(" " + text.replace(MARK, " ")) if text else []


class Model:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        probe = " a  b <s> </s>\n c\t d   "
        whole = len(self.library.encode(probe))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and whole == sum(map(self.length, units(probe)))

    def length(self, unit: str) -> int:
        return len(self.library.encode(unit[1:])) if len(unit) > 1 else self.bare

    @property
    def bare(self) -> int:
        """Tokens of a single space at the end of a text."""
        return len(self.library.encode("x ")) - len(self.library.encode("x"))


class Lengths:
    """The table and the worker's cache as one dict; what is missing is encoded by the library in batches."""

    def __init__(self, model: Model, frequent: dict[str, int]) -> None:
        self.model, self.frequent, self.known = model, frequent, dict(frequent)

    def count(self, texts: list[str]) -> list[int]:
        found = [units(x) for x in texts]
        if len(self.known) >= len(self.frequent) + CACHE_ROWS:
            self.known = dict(self.frequent)
        missing = list(set().union(*found) - self.known.keys())
        more = {u: len(ids) for u, ids in zip(missing, self.model.library.encode([u[1:] for u in missing], num_threads=1), strict=True)}
        if " " in more:
            more[" "] = self.model.bare
        self.known |= {u: n for u, n in more.items() if len(u) <= 64}
        rare = {u: n for u, n in more.items() if len(u) > 64}
        at = self.known.__getitem__ if not rare else (self.known | rare).__getitem__
        return [sum(map(at, us)) for us in found]


_lengths: dict[int, Lengths] = {}


def _frequent(docs: DataFrame, text_col: str, model: bytes) -> dict:
    """The compact table: all pre-tokens in one string, their ends and their token counts."""
    rows = docs.count()
    kept = docs.select(text_col).filter(F.col(text_col).isNotNull())
    if rows > SAMPLE_ROWS:
        share = SAMPLE_ROWS / rows
        kept = kept.filter(F.pmod(F.xxhash64(text_col, F.length(text_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for text in frame[text_col]:
                seen.update(u for u in units(text) if len(u) <= TABLE_UNIT)
        top = [x for x in seen.most_common(TABLE_ROWS // 4) if x[1] > 1]
        yield pd.DataFrame({"units": [[u for u, _ in top]], "counts": [[n for _, n in top]]})

    total: Counter = Counter()
    for row in kept.mapInPandas(count, "units array<string>, counts array<long>").toLocalIterator():
        total.update(dict(zip(row["units"], row["counts"], strict=True)))
        if len(total) > 4 * TABLE_ROWS:
            total = Counter(dict(total.most_common(2 * TABLE_ROWS)))
    top = [u for u, _ in total.most_common(TABLE_ROWS)]
    local = Model(model)
    return {
        "model": model, "text": "".join(top), "ends": np.cumsum([len(u) for u in top], dtype="u4"),
        "lengths": np.array([local.length(u) for u in top], "u2"),
    }


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str], out: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of each text, as the library for the .model file at path gives them."""
    with open(path, "rb") as f:
        model = f.read()
    table = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col, model))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def lengths() -> Lengths:
        t = table.value
        key = id(t)
        if key not in _lengths:
            ends = t["ends"].tolist()
            frequent = {t["text"][a:b]: n for a, b, n in zip([0, *ends], ends, t["lengths"].tolist(), strict=False)}
            _lengths.clear()
            _lengths[key] = Lengths(Model(t["model"]), frequent)
        return _lengths[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lengths()
        count = known.count if known.model.splits else lambda texts: [len(known.model.library.encode(x)) for x in texts]
        for batch in batches:
            n = []
            for begun in range(0, batch.num_rows, BLOCK):
                n += count([x or "" for x in batch.column(text_col).slice(begun, BLOCK).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
