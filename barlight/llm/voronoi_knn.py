"""Operator 2: exact top-k search by inner product, as a Voronoi kNN join.

With one more component that fills every data vector up to the same length,
and 0 there for queries, the largest inner products are the smallest Euclidean
distances. Data and queries go to their nearest pivot. A query group's kNN
distance is bounded from above by the summaries of the cells (the distances of
their points nearest to the pivot), a data point's distance to the group from
below by the triangle inequality; a point is sent only to groups that these
bounds leave open, and each group is solved locally, in parts. Groups whose
bounds leave much open are solved together, so that a point goes to that one
group and, in sum, to no more than twice as many others as there are points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, shuffle_partitions

#: Pivots at most, vectors of a cell on average below that, queries of a group solved together, data vectors of a part on average.
PIVOTS = 64
CELL_ROWS = 64
QUERY_BLOCK = 16_384
PART_ROWS = 100_000


def _quantised(embeddings: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component as bytes of int64; vectors with a null or non-finite component are left out."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False))
            size = np.asarray(pa.compute.list_value_length(lists).fill_null(0)).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            ids = batch.column(0).to_pylist()
            rows = [(i, n, x[a : a + n].astype(np.int64).tobytes()) for i, n, a in zip(ids, size.tolist(), edge[:-1].tolist(), strict=True) if n and np.isfinite(x[a : a + n]).all()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["id", "dim", "v"])

    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "id long, dim int, v binary")


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, dim)


def _distances(x: np.ndarray, fill: np.ndarray, pivots: np.ndarray, pivot_fill: np.ndarray) -> np.ndarray:
    square = (x.astype(float) ** 2).sum(1) + fill**2
    other = (pivots.astype(float) ** 2).sum(1) + pivot_fill**2
    return np.sqrt(np.maximum(0, square[:, None] + other[None] - 2 * (x.astype(float) @ pivots.T.astype(float) + fill[:, None] * pivot_fill[None])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row the ids and scores of the k largest, ties to the smaller id; ids ascend."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
        tie = scores == edge
        keep = (scores > edge) | (tie & (np.cumsum(tie, axis=1) <= k))
    else:
        keep = np.ones(scores.shape, dtype=bool)
    return [(ids[m], row[m]) for m, row in zip(keep, scores, strict=True)]


def _solver(dim: int, k: int):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        q, x = frame[frame["query"]], frame[~frame["query"]]
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(q) or not len(x):
            return none
        parts = lambda f, column: np.concatenate([np.frombuffer(b, dtype=np.int64) for b in f[column]])
        qi, xi = parts(q, "ids"), parts(x, "ids")
        qv, xv = _matrix(q["v"], dim), _matrix(x["v"], dim)
        order = np.argsort(xi, kind="stable")
        xi, xv = xi[order], xv[order]
        # Products of floats are exact below 2 ** 53; beyond that int64 is used.
        exact = float(np.abs(qv).max()) * float(np.abs(xv).max()) * dim < 2**53
        qv, xv = (qv.astype(float), xv.astype(float)) if exact else (qv, xv)
        least = -np.inf if exact else np.iinfo(np.int64).min
        out = []
        step = max(1, (1 << 22) // max(1, len(qi)))
        for low in range(0, len(xi), step):
            ids = xi[low : low + step]
            scores = qv @ xv[low : low + step].T
            own = qi[:, None] == ids[None]
            scores[own] = least
            for i, (found, score) in enumerate(_best(scores, ids, k)):
                ok = (found != qi[i]) & (score > least)
                out.append(np.stack([np.full(int(ok.sum()), qi[i]), found[ok], score[ok].astype(np.int64)]))
        table = np.concatenate(out, axis=1)
        table = table[:, np.lexsort((table[1], -table[2], table[0]))]
        first = np.searchsorted(table[0], table[0])
        table = table[:, np.arange(table.shape[1]) - first < k]
        return pd.DataFrame({"query_id": table[0], "vec_id": table[1], "score": table[2]})

    return solve


def least_distances(apart: np.ndarray, near: dict[int, list[float]], far: dict[int, float], k: int, slack: float) -> np.ndarray:
    """Of each query group and data cell: points of the cell nearer to its pivot than this are needed by no query of the group.

    apart: distances of the pivots; near: of each cell the smallest distances
    of its points to the pivot, k + 1 at most; far: of each group the largest
    distance of a query to the pivot, negative without queries. A query's own
    vector may be among the k + 1 points that bound its k nearest.
    """
    needed = np.full(apart.shape, np.inf)
    for g in range(len(apart)):
        if far.get(g, -1) < 0:
            continue
        above = sorted(far[g] + apart[g, c] + d for c in range(len(apart)) for d in near.get(c, ()))
        theta = above[k] if len(above) > k else np.inf
        needed[g] = apart[g] - far[g] - theta - slack
    return needed


def merged_groups(needed: np.ndarray, size: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group that each one is solved in, and the least distances of these.

    size and wide: points of each cell, and the largest distance of one to the
    pivot. A group that needs more than its share of twice all points is merged
    with all others that do; the bound of these is the smallest of theirs.
    """
    cost = (size[None] * (wide[None] >= needed)).sum(1)
    into = np.arange(len(needed))
    rest = np.flatnonzero(cost * len(needed) > 2 * size.sum())
    out = needed.copy()
    if len(rest):
        into[rest] = rest[0]
        out[rest] = np.inf
        out[rest[0]] = needed[rest].min(0)
    return into, out


def _search(data: DataFrame, dim: int, k: int, modulus: int) -> DataFrame:
    spark = data.sparkSession
    is_query = F.pmod("id", F.lit(modulus)) == 0
    n, asked = data.agg(F.count("*"), F.count_if(is_query)).first()
    count = max(1, min(PIVOTS, n // CELL_ROWS))
    picked = data.orderBy(F.xxhash64("id"), "id").limit(count).select("v").toArrow()
    pivots = _matrix(picked.column("v").to_pylist(), dim)

    def squares(batches):
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dim).astype(float)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float((x**2).sum(1).max())])], ["most"])

    most = data.mapInArrow(squares, "most double").agg(F.max("most")).first()[0] or 0.0
    fill_of = lambda x: np.sqrt(np.maximum(0, most - (x.astype(float) ** 2).sum(1)))
    pivot_fill = fill_of(pivots)
    slack = 1e-6 * (np.sqrt(most) + 1)

    def summaries(batches):
        """Of each cell: the k + 1 smallest distances of data, their largest and their number; of each group: the largest distance of a query."""
        near, far, wide, size = [[] for _ in range(count)], np.full(count, -1.0), np.full(count, -1.0), np.zeros(count, np.int64)
        for batch in batches:
            x, ids = _matrix(batch.column("v").to_pylist(), dim), np.asarray(batch.column("id"))
            if not len(x):
                continue
            d = _distances(x, fill_of(x), pivots, pivot_fill)
            cell = d.argmin(1)
            np.maximum.at(wide, cell, d.min(1))
            size += np.bincount(cell, minlength=count)
            for c in range(count):
                near[c] = sorted([*near[c], *np.sort(d[cell == c, c])[: k + 1].tolist()])[: k + 1]
            q = x[ids % modulus == 0]
            if len(q):
                d = _distances(q, np.zeros(len(q)), pivots, pivot_fill)
                np.maximum.at(far, d.argmin(1), d.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(near, pa.list_(pa.float64())), pa.array(far), pa.array(wide), pa.array(size)], ["cell", "near", "far", "wide", "size"])

    rows = data.mapInArrow(summaries, "cell int, near array<double>, far double, wide double, size long")
    table = rows.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.max("far").alias("far"), F.max("wide").alias("wide"), F.sum("size").alias("size")).orderBy("cell").collect()
    near, far = {r.cell: r.near for r in table}, {r.cell: r.far for r in table}
    needed = least_distances(_distances(pivots, pivot_fill, pivots, pivot_fill), near, far, k, slack)
    into, needed = merged_groups(needed, np.array([r["size"] for r in table]), np.array([r.wide for r in table]))
    parts = max(shuffle_partitions(spark), -(-n // PART_ROWS))
    blocks = max(1, -(-asked // QUERY_BLOCK))

    def send(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("v").to_pylist(), dim), np.asarray(batch.column("id"))
            rows = []
            if len(x):
                d = _distances(x, fill_of(x), pivots, pivot_fill)
                cell, nearest = d.argmin(1), d.min(1)
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                mine = into[_distances(x, np.zeros(len(x)), pivots, pivot_fill).argmin(1)]
                block = (ids // modulus) % blocks
                for g in np.unique(into).tolist():
                    open_ = nearest >= needed[g, cell]
                    for p in np.unique(part[open_]):
                        m = open_ & (part == p)
                        rows += [(g, b, int(p), False, ids[m].tobytes(), x[m].tobytes()) for b in range(blocks)]
                    asks = (ids % modulus == 0) & (mine == g)
                    for b in np.unique(block[asks]):
                        m = asks & (block == b)
                        rows += [(g, int(b), p, True, ids[m].tobytes(), x[m].tobytes()) for p in range(parts)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["g", "block", "part", "query", "ids", "v"])

    sent = data.mapInArrow(send, "g int, block int, part int, query boolean, ids binary, v binary")
    local = sent.groupBy("g", "block", "part").applyInPandas(_solver(dim, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_search(embeddings: DataFrame, k: int = 5, modulus: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) for each row whose id is divisible by modulus.

    Candidates are all rows but the query's own; ties go to the smaller id.
    Null vectors, empty ones, those with a null or non-finite component and
    rows with a null id take no part. Vectors of different lengths are not
    compared. Repeated rows of an id count once; of different vectors of an id
    the shortest is taken, then the one whose bytes are least. Other columns are
    ignored; an empty table gives an empty result.
    """
    # Every cap and bound below counts rows, so an id must have one.
    once = _quantised(embeddings, id_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x"))
    data = materialise(once.select("id", "x.dim", "x.v"), "vectors")
    dims = [r.dim for r in data.select("dim").distinct().collect()]
    out = [_search(data.where(F.col("dim") == d), d, k, modulus) for d in dims]
    if not out:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole
