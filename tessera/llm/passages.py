"""Passages of LEAST bytes that documents with smaller ids hold too, found by suffix arrays over buckets of text.

All suffixes of a corpus in one order would shuffle many times its size. Instead each text is cut into runs: consecutive
windows of LEAST bytes that have the same smallest K-byte hash. Equal windows have the same smallest hash, so
windows that are equal meet in the bucket of that hash, whatever surrounds them. Three narrow passes read the texts:

1. every hash with its number of documents, combined in each task; those of two documents or more are marked in a bitmap;
2. runs of marked hashes go to their bucket, where a two-stage suffix array over the different runs finds equal windows;
3. the bytes that marked windows cover are cut out where the text is.

The bitmap saves work and decides nothing: a hash of one document that passes it finds no partner in its bucket. Buckets hold
about ROWS runs. A hash of more than HOT documents would overfill one, so its runs are first reduced to the different ones
with their least id, and their windows are compared by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, materialise

LEAST = 50
K = 16
#: Windows that one place can be the smallest hash of.
WINDOWS = LEAST - K + 1
#: Positions hashed at a time; runs a bucket; documents from which a hash is hot.
SEGMENT, ROWS, HOT = 1 << 18, 25_000, 20_000
#: Rows without an id count as the largest.
NO_ID = 2**63 - 1

_RUNS = "bucket long, id long, text_hash long, at long, run binary"
_MARKS = "id long, text_hash long, first long, last long"


def _words(buffer: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as big-endian numbers; zeros follow the buffer."""
    padded = np.zeros(n + 16, np.uint8)
    padded[: min(len(buffer), n + 16)] = buffer[: n + 16]
    out = np.empty(n + 8, np.uint64)
    for shift in range(8):
        part = padded[shift : shift + (n + 8 - shift + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view(">u8")
        out[shift::8][: len(part)] = part
    return out[:n]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive keys."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[: len(keys) - (width - step)], keys[width - step :]) if width > step else keys


def _runs(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, last window, hash) of the runs of the texts at values[offsets[i]:offsets[i + 1]], by segments.

    Places are those in values. Every window of LEAST bytes inside a text lies in one run. Windows with one smallest hash at
    several places, as in repeated patterns, stay together, but no run has more than WINDOWS windows.
    """
    spread = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
    end = int(offsets[-1])
    for start in range(int(offsets[0]), end - LEAST + 1, SEGMENT):
        n = min(SEGMENT, end - LEAST + 1 - start)
        reach = n + LEAST - K
        words = _words(values[start : start + reach + 16], reach + 8)
        h = words[:reach] * spread[0] ^ words[8 : reach + 8] * spread[1]
        h ^= h >> np.uint64(29)
        h *= spread[2]
        h ^= h >> np.uint64(32)
        keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(reach, dtype=np.uint64)
        place = (_least(keys, WINDOWS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # a window that would pass its text's end belongs to no run
        low, high = np.searchsorted(offsets, [start, start + n], "right")
        ends = offsets[max(low, 1) : high + 1]
        past = np.zeros(n + 1, np.int32)
        starts = np.maximum(offsets[max(low, 1) - 1 : high][: len(ends)], ends - LEAST + 1)
        np.add.at(past, np.clip(starts - start, 0, n), 1)
        np.add.at(past, np.clip(ends - start, 0, n), -1)
        outside = np.cumsum(past[:n]) > 0
        least = h[place]
        first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (outside[1:] != outside[:-1])))
        last = np.append(first[1:], n) - 1
        inside = ~outside[first]
        first, last = first[inside], last[inside]
        pieces = (last - first) // WINDOWS + 1
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * WINDOWS
        last = np.minimum(first + WINDOWS - 1, np.repeat(last, pieces))
        text = np.searchsorted(offsets, first + start, "right") - 1
        yield text, first + start, last + start, h[place[first]].view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values begin and end."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8), offsets


def _count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, text) to (h, number of this batch's texts that have it)."""
    for batch in batches:
        if not len(batch):
            continue
        found = [(text, h) for text, _, _, h in _runs(*_buffers(batch.column(2)))]
        if not found:
            continue
        text, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((text, h))
        text, h = text[order], h[order]
        once = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        h, n = np.unique(h[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])


def _cut(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of values that begin at first and are of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    index = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(values[index])])


def _probes(h: Column) -> Column:
    """Two independent parts of a hash, to be looked up one by one: a hash that is not marked passes both far more rarely."""
    return F.explode(F.array(h, F.shiftrightunsigned(h, 26))).alias("h")


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return in_bitmap(bits, h) & in_bitmap(bits, (h.view(np.uint64) >> np.uint64(26)).view(np.int64))


def _runs_of(wanted: Callable[[np.ndarray], np.ndarray], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text_hash, text) to the runs whose hashes are wanted, with their bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, offsets = _buffers(batch.column(2))
            for text, first, last, h in _runs(values, offsets):
                kept = wanted(h)
                text, first, last, h = text[kept], first[kept], last[kept], h[kept]
                columns = [(h.view(np.uint64) % np.uint64(buckets)).view(np.int64), ids[text], hashes[text], first - offsets[text]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), _cut(values, first, last - first + LEAST)], ["bucket", "id", "text_hash", "at", "run"]
                )

    return task


def two_stage(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The suffix array of text (bytes, the last one 0xFF), right to the first 56 bytes of every suffix; words: see _words.

    Suffixes smaller than their successors are sorted directly, by eight bytes at a time and only while they tie. The others
    are induced: their bucket (first byte) is filled in the order of the suffixes that follow them, which lie in smaller
    buckets, or among those of a repeated byte that the bucket already has.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    # of a run of equal bytes, what follows the run decides
    ahead = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    smaller = step[ahead] > 0

    order = np.flatnonzero(smaller)
    order = order[np.argsort(words[order], kind="stable")]
    open_ = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    padded = np.append(words, np.zeros(64, np.uint64))
    for depth in range(0, 56, 8):
        key = padded[order[open_] + depth]
        if depth:
            by = np.lexsort((key, group))
            order[open_], key = order[open_[by]], key[by]
        change = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(key)]
        number = np.cumsum(change)
        tied = np.bincount(number)[number] > 1
        open_, group = open_[tied], number[tied]
        if not len(open_):
            break

    heads = text[order]
    out: list[np.ndarray] = []
    pending: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([n - 1])]}
    for symbol in np.unique(text).tolist():
        parts = pending.pop(symbol, [])
        level = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):
            level = level[level > 0] - 1
            level = level[text[level] == symbol]
            bucket.append(level)
        low, high = np.searchsorted(heads, [symbol, symbol + 1])
        whole = np.concatenate([*bucket, order[low:high]])
        out.append(whole)
        before = whole[whole > 0] - 1
        first = text[before]
        before, first = before[first > symbol], first[first > symbol]
        by = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[by])) + 1
        for part in np.split(before[by], cuts):
            if len(part):
                pending.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out)


def _share(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffixes at a and at b have a common prefix of LEAST bytes or more."""
    same = np.ones(len(a), bool)
    for offset in (*range(0, LEAST - 8, 8), LEAST - 8):
        same &= words[a + offset] == words[b + offset]
    return same


def later_windows(runs: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each run, which of its windows a run with a smaller id has too."""
    sizes = np.array([len(r) for r in runs])
    text = np.frombuffer(b"\xff".join(runs) + b"\xff", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    words = _words(text, len(text))
    suffixes = two_stage(text, words)
    owner = np.repeat(np.arange(len(runs)), sizes + 1)
    suffixes = suffixes[suffixes + LEAST <= (starts + sizes)[owner[suffixes]]]
    late = np.zeros(len(text), bool)
    if len(suffixes):
        groups = np.flatnonzero(np.append(True, ~_share(words, suffixes[:-1], suffixes[1:])))
        mine = ids[owner[suffixes]]
        least = np.repeat(np.minimum.reduceat(mine, groups), np.diff(np.append(groups, len(mine))))
        late[suffixes[mine > least]] = True
    return [late[s : s + n - LEAST + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _spans(late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal ranges of bytes that marked windows cover."""
    at = np.flatnonzero(late)
    breaks = np.flatnonzero(np.diff(at) > LEAST) + 1
    return at[np.append(0, breaks)], at[np.append(breaks, len(at)) - 1] + LEAST


def _bucket(found: pa.Table) -> pa.Table:
    """The runs of one bucket to the ranges of bytes that documents with smaller ids have too."""
    found = found.combine_chunks()
    coded = pc.dictionary_encode(found["run"].combine_chunks())
    code, runs = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    ids = found["id"].to_numpy()
    least = np.full(len(runs), NO_ID)
    np.minimum.at(least, code, ids)
    sizes = np.array([len(r) for r in runs])
    at, hashes = found["at"].to_numpy(), found["text_hash"].to_numpy()
    whole = ids > least[code]
    out = [(ids[whole], hashes[whole], at[whole], at[whole] + sizes[code[whole]])]
    # a run that is alone with its hash meets no other run's windows
    of_run = np.zeros(len(runs), np.int64)
    for run, _, _, h in _runs(*_buffers(coded.dictionary)):
        of_run[run] = h
    _, where, n = np.unique(of_run, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[where] > 1)
    if len(several):
        late = later_windows([runs[i] for i in several.tolist()], least[several])
        place = np.full(len(runs), -1)
        place[several] = np.arange(len(several))
        some = np.array([x.any() for x in late])
        for row in np.flatnonzero(~whole & (place[code] >= 0)).tolist():
            k = place[code[row]]
            if some[k]:
                first, last = _spans(late[k])
                out.append((np.full(len(first), ids[row]), np.full(len(first), hashes[row]), at[row] + first, at[row] + last))
    return pa.table(dict(zip(("id", "text_hash", "first", "last"), map(np.concatenate, zip(*out)))))


def _hot_marks(runs: DataFrame) -> DataFrame:
    """Marks among runs of hashes that very many documents have: different runs first, then their windows, by joins."""
    runs = materialise(runs.select("id", "text_hash", "at", "run"), "passages-hot")
    different = materialise(runs.groupBy("run").agg(F.min("id").alias("least")), "passages-hot-runs")
    windows = different.select("run", "least", F.explode(F.sequence(F.lit(1), F.octet_length("run") - LEAST + 1)).alias("i"))
    windows = windows.withColumn("window", F.substring("run", F.col("i"), F.lit(LEAST)))
    firsts = windows.groupBy("window").agg(F.min("least").alias("first"))
    late = windows.join(firsts, "window").filter("least > first").groupBy("run").agg(F.collect_list(F.col("i").cast("long") - 1).alias("late"))
    judged = runs.join(different, "run").join(late, "run", "left")
    whole = F.array(F.struct(F.col("at").alias("first"), (F.col("at") + F.octet_length("run")).alias("last")))
    parts = F.transform("late", lambda i: F.struct((F.col("at") + i).alias("first"), (F.col("at") + i + LEAST).alias("last")))
    return judged.select("id", "text_hash", F.inline(F.when(F.col("id") > F.col("least"), whole).otherwise(parts)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with their last column, the text, compressed: half as much to shuffle."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        texts = pa.array((pack(text.as_py()) for text in batch.columns[-1]), pa.binary(), size=len(batch))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, packed text, spans: list of (first, last)) to the bytes left and the maximal removed ranges."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        left, removed, n_bytes = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            text, merged = unpack(text.as_py()), []
            n_bytes.append(len(text))
            if spans.is_valid:
                first, last = (spans.values.field(name).to_numpy() for name in ("first", "last"))
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                breaks = np.flatnonzero(first[1:] > last[:-1]) + 1
                merged = list(zip(first[np.append(0, breaks)].tolist(), last[np.append(breaks, len(last)) - 1].tolist()))
            edges = [0, *(place for span in merged for place in span), len(text)]
            left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"first": a, "last": b} for a, b in merged])
        spans = pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), spans, pa.array(left, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept): each text's bytes that no passage of LEAST bytes starting in a smaller id's text covers.

    spans lists the maximal removed ranges (first, last exclusive) in bytes; kept holds the other bytes in order and may break
    characters apart. Null and empty texts give empty bytes. A null id counts as the largest one. Rows with equal ids remove
    nothing from each other; repeated rows come back as often as they are given, each with the same result. Texts shorter than
    LEAST stay. Texts of any length are read whole, SEGMENT bytes at a time. Other columns are not looked at. An empty table
    gives no rows.
    """
    context = docs.sparkSession.sparkContext
    keyed = docs.select(
        F.col(id_col).cast("long").alias("given"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    texts = keyed.select("id", "text_hash", "text")
    counted = texts.mapInArrow(_count_hashes, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))
    shared = materialise(counted.filter("n > 1"), "passages-hashes")
    n_rows, n_hot = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > hot)).first()
    bits = [bitmap(some.select(_probes(F.col("h")))) for some in (shared, shared.filter(F.col("n") > hot))]
    marked, buckets = context.broadcast(bits), max(1, -(-n_rows // rows))

    def in_buckets(h: np.ndarray) -> np.ndarray:
        return _marked(marked.value[0], h) & ~_marked(marked.value[1], h)

    def in_joins(h: np.ndarray) -> np.ndarray:
        return _marked(marked.value[1], h)

    marks = texts.mapInArrow(_runs_of(in_buckets, buckets), _RUNS).groupBy("bucket").applyInArrow(_bucket, _MARKS)
    if n_hot:
        marks = marks.unionByName(_hot_marks(texts.mapInArrow(_runs_of(in_joins, buckets), _RUNS)))
    spans = marks.groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    packed = keyed.mapInArrow(_packed, keyed.schema)
    joined = packed.join(spans, ["id", "text_hash"], "left").select("given", "text", "spans")
    cleaned = joined.mapInArrow(_cleaned, "id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")
    return cleaned.withColumnRenamed("id", id_col)
