"""Exact top-k search by inner product: a Voronoi kNN join.

1. Components become the integers floor(1024 * x); scores are integer inner products.
2. Pivots (a bounded number of vectors, picked by a hash of their id) cut the space into Voronoi groups; queries and data
   both go to their nearest pivot.
3. Summaries of the groups give distance bounds. For data group j with pivot p_j: the norms and radii of its k + 1 vectors
   nearest to the pivot. For query group i: the number of queries, their largest distance R_i from p_i and their largest
   norm. Any query q of group i and any x of group j satisfy
   q.x >= p_i.p_j - |p_i| |x - p_j| - R_i |x|, so the k + 1 best of these lower bounds (one for the query itself) give a
   score theta_i that the k-th best answer of every query in group i reaches.
4. A vector x is sent to query group i only if p_i.x + R_i |x| >= theta_i, which bounds q.x from above.
5. Each cell (query group, part of the queries, part of the data) is solved by a matrix product; its best k per query are
   merged by a window over at most k rows a cell and query.

Cells have at most about CELL_QUERIES queries and CELL_ROWS vectors: large groups of either kind, groups of equal vectors
among them, are dealt over several cells by a hash of the id, so no group meets in one task. Only pivots and summaries
(k + 1 numbers a pivot, MAX_PIVOTS pivots) go to the driver and are broadcast.

Edge cases: vectors that are null or empty, or hold null, NaN or infinite components, and rows with null id take no part;
rows that repeat an id are rows of their own: each is a query or a candidate, and a query meets every row but itself;
vectors of different lengths have no inner product, so each length (MAX_LENGTHS at most) is searched by itself; ties go to
the smaller id; a query with fewer than k candidates returns all; an empty table gives an empty result; other columns are
ignored. Scores are exact; one that does not fit 64 bits counts as the nearest integer that does. Vectors with a component
of 2**62 or more (WIDE) travel as doubles, lie in no group's summary and reach every query group, as distances to them may
pass any bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 1024
MAX_PIVOTS = 256
QUERIES_A_PIVOT = 64
CELL_QUERIES = 2_048
CELL_ROWS = 8_192
MAX_LENGTHS = 100
WIDE = 2.0**62
LEAST, MOST = -(2**63), 2**63 - 1
#: Of the terms of a bound: far more than the rounding of sums of products.
SLACK = 1e-9


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1)


def _clamped(a: list[int], b: list[int]) -> int:
    return min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, integers below WIDE; in doubles where these are exact.

    By Cauchy and Schwarz no sum of a product's terms passes the product of the norms. Products modulo 2**64 are right
    where the score fits; whether it does is seen in doubles, and counted out only for pairs near the ends of the range.
    """
    x, y = a.astype(float), b.astype(float)
    norms = [np.sqrt((v * v).sum(1)) for v in (x, y)]
    bound = norms[0].max(initial=0) * norms[1].max(initial=0) * (1 + SLACK)
    if bound < 2**53:
        return (x @ y.T).astype(np.int64)
    out = a @ b.T
    if bound >= 2**63:
        near, off = x @ y.T, SLACK * np.outer(*norms) + 1
        out = np.where(near - off >= 2.0**63, MOST, np.where(near + off < -(2.0**63), LEAST, out))
        unsure = (np.abs(near) + off >= 2.0**63) & (np.abs(near) - off <= 2.0**63)
        for i, j in zip(*np.nonzero(unsure)):
            out[i, j] = _clamped(a[i].tolist(), b[j].tolist())
    return out


def _scores(a: tuple[np.ndarray, dict[int, list[int]]], b: tuple[np.ndarray, dict[int, list[int]]]) -> np.ndarray:
    """_exact for unpacked vectors, wide ones among them."""
    out = _exact(a[0], b[0])
    for i, row in a[1].items():
        out[i] = [_clamped(row, b[1].get(j) or v) for j, v in enumerate(b[0].tolist())]
    for j, row in b[1].items():
        out[:, j] = [_clamped(row, a[1].get(i) or v) for i, v in enumerate(a[0].tolist())]
    return out


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, wide, row): whole vectors as integers, or the given doubles of wide ones; row tells rows apart once this is written."""
    x = F.col(vector_col)
    finite = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    doubles = F.transform(x, lambda e: e.cast("double"))
    wide = F.exists(doubles, lambda e: F.abs(e) >= WIDE / SCALE)
    whole = F.transform(doubles, lambda e: F.when(wide, F.lit(0).cast("long")).otherwise(F.floor(e * SCALE).cast("long")))
    sound = df.filter(F.col(id_col).isNotNull() & finite & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.when(wide, doubles).alias("wide"))
    return sound.withColumn("row", F.monotonically_increasing_id())


def _assign(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, row, blob, cell, far, norm): the vector, its nearest pivot and its distance from it; infinite for wide vectors."""
    shared = data.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value.astype(float)
        for frame in frames:
            if not len(frame):
                continue
            v = np.stack(frame["v"].to_numpy())
            x = v.astype(float)
            square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
            near = square.argmin(1)
            blobs = [r.tobytes() for r in v.astype("<i8")]
            far, norm = np.sqrt(np.maximum(square[np.arange(len(x)), near], 0)), np.sqrt((x * x).sum(1))
            for i, given in enumerate(frame["wide"]):
                if given is not None:
                    blobs[i], near[i], far[i], norm[i] = np.asarray(given, "<f8").tobytes(), 0, np.inf, np.inf
            yield pd.DataFrame({
                "id": frame["id"], "row": frame["row"], "blob": blobs, "cell": near.astype(np.int32), "far": far, "norm": norm,
            })

    return data.mapInPandas(run, "id long, row long, blob binary, cell int, far double, norm double")


def _bounds(queries: pd.DataFrame, near: pd.DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """theta for each query group; nan for groups without queries. near: (cell, far, norm) of the vectors next to the pivots.

    The bounds are computed in doubles, so each is lowered by more than the rounding of its terms.
    """
    p = pivots.astype(float)
    theta = np.full(len(p), np.nan)
    inner, norms = p @ p.T, np.sqrt((p * p).sum(1))
    j, far, size = near["cell"].to_numpy(), near["far"].to_numpy(), near["norm"].to_numpy()
    for row in queries.itertuples():
        if not np.isfinite(row.reach):
            theta[row.cell] = -np.inf
            continue
        low = inner[row.cell, j] - norms[row.cell] * far - row.reach * size
        low -= SLACK * (norms[row.cell] * (norms[j] + far) + row.reach * size) + 1
        theta[row.cell] = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k else -np.inf
    return theta


def top_k(df: DataFrame, *, id_col: str, vector_col: str, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, the k best other vectors."""
    data = materialise(vectors(df, id_col, vector_col), "vectors")
    lengths = [r["n"] for r in data.select(F.size("v").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors")
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for n in sorted(lengths):
        out = out.unionByName(_top_k(data.filter(F.size("v") == n), every, k))
    return out


def _top_k(data: DataFrame, every: int, k: int) -> DataFrame:
    """For vectors of one length."""
    spark = data.sparkSession
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    n, asked = data.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(MAX_PIVOTS, max(8, math.ceil(asked / QUERIES_A_PIVOT)))
    picked = data.filter("wide IS NULL").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(wanted).collect()
    pivots = np.unique(np.array([r["v"] for r in picked] or [data.first()["v"]], np.int64), axis=0)

    data = materialise(_assign(data, pivots), "voronoi")
    queries = data.filter(is_query).groupBy("cell").agg(F.max("far").alias("reach"), F.count("*").alias("n")).toPandas()
    order = Window.partitionBy("cell").orderBy("far", "id", "row")
    near = data.filter(F.col("far") < float("inf")).select("cell", "far", "norm", "id", "row").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    theta = _bounds(queries, near.select("cell", "far", "norm").toPandas(), pivots, k)
    reach = np.zeros(len(pivots))
    reach[queries["cell"]] = queries["reach"]
    parts = np.zeros(len(pivots), np.int64)
    parts[queries["cell"]] = np.ceil(queries["n"] / CELL_QUERIES)
    data_parts = max(1, math.ceil(n / CELL_ROWS))
    shared = spark.sparkContext.broadcast((pivots, theta, reach, parts))

    def replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, low, far, count = shared.value
        used = np.flatnonzero(count)
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["blob"]).astype(float)
            size, size_of = p[used].astype(float), frame["norm"].to_numpy()[:, None]
            with np.errstate(invalid="ignore"):
                high = x @ size.T + far[used] * size_of
                high += SLACK * size_of * (np.sqrt((size * size).sum(1)) + far[used]) + 1
                # what is not below a bound may reach it: nan is an infinite reach times nothing
                own, group = np.nonzero(~(high < low[used]) | np.isinf(size_of))
            each = count[used][group]
            own, group = np.repeat(own, each), np.repeat(used[group], each)
            part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            some = frame.iloc[own]
            # small components travel as 16 bits
            yield pd.DataFrame({"grp": group.astype(np.int32), "part": part.astype(np.int32), "slice": (some["hash"] % data_parts).astype(np.int32), "id": some["id"], "row": some["row"], "blob": _packed(some)})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = shared.value[3]
        for frame in frames:
            some = frame.loc[frame.index.repeat(data_parts)]
            part = some["hash"] % np.maximum(count[some["cell"]], 1)
            yield pd.DataFrame({"grp": some["cell"].astype(np.int32), "part": part.astype(np.int32), "slice": np.tile(np.arange(data_parts, dtype=np.int32), len(frame)), "id": some["id"], "row": some["row"], "blob": _packed(some)})

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(left) and len(right):
            order = right["id"].to_numpy().argsort(kind="stable")
            ids, rows, vectors = right["id"].to_numpy()[order], right["row"].to_numpy()[order], _unpacked(right["blob"].iloc[order])
            for begun in range(0, len(left), 512):
                some = left.iloc[begun : begun + 512]
                asked, own = some["id"].to_numpy(), some["row"].to_numpy()
                score = _scores(_unpacked(some["blob"]), vectors)
                for i, row in enumerate(score):
                    # one more than k, as the query itself may be among them
                    cut = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else row.min()
                    best = np.flatnonzero((row >= cut) & (rows != own[i]))
                    best = best[np.lexsort((ids[best], ~row[best]))][:k]
                    for column, value in zip(out, (np.full(len(best), own[i]), np.full(len(best), asked[i]), ids[best], row[best]), strict=True):
                        column.append(value)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(("row", "query_id", "vec_id", "score"), out, strict=True)})

    hashed = data.select("id", "row", "blob", "cell", "norm", F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)).alias("hash"))
    schema = "grp int, part int, slice int, id long, row long, blob binary"
    cells = ["grp", "part", "slice"]
    asked_rows = hashed.filter(is_query).mapInPandas(ask, schema).groupBy(cells)
    solved = asked_rows.cogroup(hashed.mapInPandas(replicate, schema).groupBy(cells)).applyInPandas(solve, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = solved.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _packed(rows: pd.DataFrame) -> list[bytes]:
    """Vectors whose components all fit 16 bits in 2 bytes a component, others in 8, wide ones as doubles; the first byte tells."""
    out = []
    for b, norm in zip(rows["blob"], rows["norm"]):
        if np.isinf(norm):
            out.append(b"\100" + b)
            continue
        v = np.frombuffer(b, "<i8")
        out.append(b"\2" + v.astype("<i2").tobytes() if -32768 <= v.min() and v.max() <= 32767 else b"\10" + b)
    return out


def _whole(x: float) -> int:
    """floor(SCALE * x), of doubles of any size: those from 2**53 on are integers."""
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)


def _unpacked(blobs: pd.Series) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Vectors as integers; wide ones are zero there and listed by place."""
    wide = {i: [_whole(x) for x in np.frombuffer(b, "<f8", offset=1).tolist()] for i, b in enumerate(blobs) if b[0] == 64}
    rows = [np.zeros(len(wide[i]), np.int64) if b[0] == 64 else np.frombuffer(b, "<i2" if b[0] == 2 else "<i8", offset=1).astype(np.int64) for i, b in enumerate(blobs)]
    return np.stack(rows), wide
