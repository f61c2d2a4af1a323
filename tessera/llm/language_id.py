"""Language identification by multilingual mixture inference.

Model: for every language, smoothed probabilities of letter trigrams (three UTF-8 bytes around each letter of a word, with
word borders), hashed to ``BUCKETS``. It is fitted on at most ``SAMPLE_DOCS`` labelled documents a language, picked by a
hash of their id; a further component, ``other``, gives every bucket the same probability.

Inference, for each document: a word's likelihood under a language is the product of its trigrams' probabilities.
Expectation-maximisation estimates the proportions of the components among the words. The language set is then selected
by penalised likelihood: of the nested sets of the k components with the largest proportions, each fitted by itself, the
one with the largest log-likelihood less PENALTY * log(words) for each component after the first. Documents for which all
components together gain less than one penalty over the best single one need no search.

Result: lang_pred, the language with the largest share; score, its share of the words (0 to 1); other_share, the share of
words that no language explains; languages, the selected set. Label, source and id of a document take no part in it.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language by code point;
texts are read whole; rows with null text or label are not learned from; without any labelled row every document is
``und``; an empty table gives an empty result; an input column with the name of a result column is replaced.

Scale: fitting reads the ids and labels once and the sampled texts once, and sends at most BUCKETS sums a language to the
driver; prediction is one pass without a shuffle, with the tables (BUCKETS floats a language) broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
SAMPLE_DOCS = 2_000
MAX_LANGUAGES = 200
#: Share of a language's probability that is spread evenly over all buckets.
SMOOTHING = 0.05
PENALTY = 2.0
#: Expectation-maximisation ends for a document once no share moves further than this, or after so many rounds.
TOLERANCE = 1e-3
MAX_ROUNDS = 200
BLOCK_BYTES = 2 << 20

LETTER = np.zeros(256, np.uint8)
LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all letters of all texts, the index of each word's first letter, and each word's text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x = LETTER[np.frombuffer(b"".join(texts), np.uint8)]
    ends = np.cumsum(sizes)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    full = sizes > 0
    before[(ends - sizes)[full]] = 0
    after[ends[full] - 1] = 0
    at = np.flatnonzero(x)
    gram = (before[at].astype(np.uint32) << 16) | (x[at].astype(np.uint32) << 8) | after[at]
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = np.flatnonzero(before[at] == 0)
    return bucket, first, np.searchsorted(ends, at[first], side="right")


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of about BLOCK_BYTES, each with its first row; nulls are empty."""
    begun, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column).cast(pa.large_binary())):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= BLOCK_BYTES or i == batch.num_rows - 1:
            yield begun, held
            begun, held, size = i + 1, [], 0


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and log-probabilities[bucket, language], from at most SAMPLE_DOCS rows a language."""
    known = labelled.select(id_col, text_col, lang_col).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE_DOCS / sizes[lang]))])
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(drawn < share[F.col(lang_col)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(lang_col).to_pylist()
            for begun, texts in blocks(batch, text_col):
                for lang in set(langs[begun : begun + len(texts)]):
                    own = [t for t, at in zip(texts, langs[begun : begun + len(texts)], strict=True) if at == lang]
                    n = np.bincount(trigrams(own)[0], minlength=BUCKETS)
                    totals[lang] = totals[lang] + n if lang in totals else n
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype("i4")), pa.array(n[at].astype("i8"))], names=["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    row = {lang: i for i, lang in enumerate(languages)}
    counts[sums["bucket"].to_numpy(), [row[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    return languages, np.log((1 - SMOOTHING) * counts / np.maximum(counts.sum(0), 1) + SMOOTHING / BUCKETS).astype(np.float32)


def maximise(likely: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each document after expectation-maximisation from the given shares."""
    share = share.copy()
    live, rows, own, begins = np.arange(len(n)), likely, doc, first
    for step in range(1, MAX_ROUNDS + 1):
        part = rows * share[live][own]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        now = np.add.reduceat(part, begins, axis=0) / n[live][:, None]
        moved = np.abs(now - share[live]).max(1)
        share[live] = now
        if step % 4 == 0:
            on = moved > TOLERANCE
            if not on.any():
                break
            if not on.all():
                # documents that have settled leave
                kept = on[own]
                rows, sizes = rows[kept], np.diff(np.append(begins, len(own)))[on]
                live, begins, own = live[on], np.cumsum(sizes) - sizes, np.repeat(np.arange(on.sum()), sizes)
    total = np.log(np.maximum((likely * share[doc]).sum(1), 1e-30))
    return share, np.add.reduceat(total, first)


def infer(texts: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Shares[text, component] of the selected set; zeros for texts without words. The last component is ``other``."""
    bucket, begins, owner = trigrams(texts)
    parts = logs.shape[1]
    out = np.zeros((len(texts), parts), np.float32)
    if not len(begins):
        return out
    words = np.stack([np.add.reduceat(logs[:, k][bucket], begins) for k in range(parts)], axis=1)
    docs, first, doc = np.unique(owner, return_index=True, return_inverse=True)
    n = np.diff(np.append(first, len(owner))).astype(np.float32)
    top = words.max(1)
    likely = np.exp(words - top[:, None])
    base = np.add.reduceat(top, first)
    alone = np.add.reduceat(words, first, axis=0) - base[:, None]
    single = alone.argmax(1)
    best = alone[np.arange(len(docs)), single]
    chosen = np.zeros((len(docs), parts), np.float32)
    chosen[np.arange(len(docs)), single] = 1
    full, reached = maximise(likely, doc, first, n, np.full((len(docs), parts), 1 / parts, np.float32))
    cost = PENALTY * np.log(n + 1)
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, parts + 1):
        open_docs = np.flatnonzero(reached - (k - 1) * cost > best)
        if not len(open_docs):
            break
        rows = np.isin(doc, open_docs)
        some, part_doc = likely[rows], np.searchsorted(open_docs, doc[rows])
        starts = np.searchsorted(part_doc, np.arange(len(open_docs)))
        start = np.zeros((len(open_docs), parts), np.float32)
        np.put_along_axis(start, order[open_docs, :k], np.take_along_axis(full[open_docs], order[open_docs, :k], 1) + 1e-3, 1)
        share, likelihood = maximise(some, part_doc, starts, n[open_docs], start / start.sum(1, keepdims=True))
        gain = likelihood - (k - 1) * cost[open_docs]
        better = gain > best[open_docs]
        best[open_docs[better]] = gain[better]
        chosen[open_docs[better]] = share[better]
    out[docs] = chosen
    return out


def predict(docs: DataFrame, languages: list[str], logs: np.ndarray, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred, score, other_share and languages."""
    added = ["lang_pred", "score", "other_share", "languages"]
    keep = [c for c in keep if c not in added]
    schema = T.StructType(
        [*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
         T.StructField("other_share", T.DoubleType()), T.StructField("languages", T.StringType())]
    )
    model = docs.sparkSession.sparkContext.broadcast(np.hstack([logs, np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.asfortranarray(model.value)
        for batch in batches:
            lettered = batch.column("__lettered").to_pylist()
            for begun, texts in blocks(batch, text_col):
                made: list[list] = [[], [], [], []]
                shares = infer(texts, table)
                own = shares[:, :-1]
                pick = own.argmax(1) if own.shape[1] else np.zeros(len(texts), int)
                for i, share in enumerate(shares):
                    if not lettered[begun + i] or not languages:
                        row = ("und", 0.0, 1.0, "")
                    else:
                        held = np.flatnonzero(share[:-1] > 0)
                        held = held[np.argsort(-share[held], kind="stable")]
                        row = (languages[pick[i]], float(min(1.0, share[pick[i]])), float(share[-1]), ",".join(languages[k] for k in held))
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                part = batch.slice(begun, len(texts))
                arrays = [pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.float64()), pa.array(made[3], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names=[*keep, *added])

    return docs.select(*dict.fromkeys([*keep, text_col]), has_letter(F.col(text_col)).alias("__lettered")).mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
