"""Searches of a table's vectors for all those of another table, as in exact neighbours and recall studies.

Both tables are cut into blocks by hashes of their ids, and each pair of blocks meets in a task, which holds the best ``k``
of its queries and a tile of scores. Nothing but ``k`` rows a query and block leaves it, and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import ranking as R

#: Most rows of a block of queries and of vectors; blocks of queries are smaller while there are less than ``SPREAD``.
QUERIES, VECTORS, FEWEST, SPREAD = 1 << 15, 1 << 16, 1 << 11, 24
#: Queries and vectors of a tile of scores.
TILE = (256, 8192)


class Best:
    """The ``k`` best of each query so far: scores and places of vectors, which are in the order of their ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.place = np.full((n, k), -np.inf), np.full((n, k), -1)

    def offer(self, rows: np.ndarray, places: np.ndarray, score: np.ndarray) -> None:
        """Take scores of ``rows`` by ``places``; a pair may come again."""
        k = self.score.shape[1]
        least = self.score[rows, -1]
        if len(places) > k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(score, len(places) - k, axis=1)[:, len(places) - k])
        r, c = np.nonzero(score >= (least - 2 * 10.0**-R.DIGITS)[:, None])
        s, r, c = np.round(score[r, c], R.DIGITS) + 0.0, rows[r], places[c]
        last, at = self.score[r, -1], self.place[r, -1]
        better = (s > last) | ((s == last) & (c < at))
        s, r, c = s[better], r[better], c[better]
        if not len(r):
            return
        own = np.unique(r)
        s, r, c = np.concatenate([s, self.score[own].ravel()]), np.concatenate([r, np.repeat(own, k)]), np.concatenate([c, self.place[own].ravel()])
        held = c >= 0
        s, r, c = s[held], r[held], c[held]
        _, once = np.unique(r * (int(c.max()) + 1) + c, return_index=True)
        s, r, c = s[once], r[once], c[once]
        order = np.lexsort((c, -s, r))
        s, r, c = s[order], r[order], c[order]
        n = np.arange(len(r)) - np.searchsorted(r, r)
        s, r, c, n = s[n < k], r[n < k], c[n < k], n[n < k]
        self.score[own], self.place[own] = -np.inf, -1
        self.score[r, n], self.place[r, n] = s, c


def tiles(best: Best, q: np.ndarray, v: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
    """Score ``rows`` of ``q`` by ``places`` of ``v``."""
    for i in range(0, len(rows), TILE[0]):
        for j in range(0, len(places), TILE[1]):
            a, b = rows[i : i + TILE[0]], places[j : j + TILE[1]]
            best.offer(a, b, q[a] @ v[b].T)


def exact(best: Best, q: np.ndarray, v: np.ndarray) -> None:
    tiles(best, q, v, np.arange(len(q)), np.arange(len(v)))


def hashed(tables: int, bits: int, seed: int) -> Callable[[Best, np.ndarray, np.ndarray], None]:
    """Signs of random projections are keys: a query meets the vectors of its key in each table, and those of the key
    with its least certain bit flipped."""

    def search(best: Best, q: np.ndarray, v: np.ndarray) -> None:
        planes = np.random.default_rng([seed, q.shape[1]]).standard_normal((tables * bits, q.shape[1]))
        sides = (q @ planes.T).reshape(len(q), tables, bits)
        code = lambda s: ((s > 0) << np.arange(bits)).sum(axis=-1)
        asked, held = code(sides), code((v @ planes.T).reshape(len(v), tables, bits))
        flipped = asked ^ (1 << np.abs(sides).argmin(axis=-1))
        for t in range(tables):
            order = np.argsort(held[:, t], kind="stable")
            bounds = np.searchsorted(held[order, t], np.arange((1 << bits) + 1))
            for key in range(1 << bits):
                places, rows = order[bounds[key] : bounds[key + 1]], np.flatnonzero((asked[:, t] == key) | (flipped[:, t] == key))
                if len(places) and len(rows):
                    tiles(best, q, v, rows, places)

    return search


def matrices(table: pa.Table, own: str) -> dict[int, tuple[list, np.ndarray]]:
    """By length: ids in order, and their vectors at unit length (zero vectors as they are). Vectors that are null, empty
    or hold null or non-finite components are left out."""
    ids, lists = table.column(own).to_pylist(), table.column("embedding").combine_chunks()
    flat, sizes = lists.flatten(), set(np.diff(lists.offsets.to_numpy()).tolist()) if len(lists) else set()
    if len(sizes) == 1 and not lists.null_count and not flat.null_count and 0 not in sizes:
        n = sizes.pop()
        by = {n: (ids, flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n))}
    else:
        kept: dict[int, tuple[list, list]] = {}
        for i, x in zip(ids, lists.to_pylist(), strict=True):
            if x and None not in x:
                known = kept.setdefault(len(x), ([], []))
                known[0].append(i)
                known[1].append(x)
        by = {n: (i, np.array(x, float)) for n, (i, x) in kept.items()}
    out = {}
    for n, (i, x) in by.items():
        size = np.linalg.norm(x, axis=1)
        order = sorted(np.flatnonzero(np.isfinite(size)).tolist(), key=i.__getitem__)
        out[n] = ([i[j] for j in order], x[order] / np.where(size > 0, size, 1.0)[order, None])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, search: Callable[[Best, np.ndarray, np.ndarray], None] = exact) -> DataFrame:
    """``qid, chunk_id, score, rank``: the ``k`` nearest by cosine that ``search`` meets, of vectors as long as the query.

    Scores are rounded before they order; ties go to the smaller id. The work grows with the product of both tables.
    """
    nq, nv = queries.count(), vectors.count()
    high = max(1, math.ceil(nv / VECTORS))
    wide = max(1, min(SPREAD, math.ceil(nq / FEWEST)), math.ceil(nq / QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select("qid", "embedding", block("qid", wide).alias("a"), every(high).alias("b")).repartition(wide * high, "a", "b")
    held = vectors.select("chunk_id", "embedding", every(wide).alias("a"), block("chunk_id", high).alias("b")).repartition(wide * high, "a", "b")
    kinds = [dict(df.dtypes)[c] for df, c in ((queries, "qid"), (vectors, "chunk_id"))]
    types = [pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64() for t in kinds]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        found = matrices(right, "chunk_id")
        for n, (qids, q) in matrices(left, "qid").items():
            ids, v = found.get(n, ([], None))
            if not len(ids) or not len(qids):
                continue
            best = Best(len(qids), k)
            search(best, q, v)
            r, c = np.nonzero(best.place >= 0)
            out[0].extend(qids[i] for i in r)
            out[1].extend(ids[i] for i in best.place[r, c])
            out[2].extend(best.score[r, c].tolist())
        return pa.Table.from_arrays([pa.array(out[0], types[0]), pa.array(out[1], types[1]), pa.array(out[2], pa.float64())], names=["qid", "chunk_id", "score"])

    both = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(meet, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double")
    return R.top_k(both, k, ["qid"], [F.desc("score"), F.asc("chunk_id")])
