"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

Trees are fitted on a bounded sample of distinct vectors and broadcast; every distinct vector is
indexed in one leaf of each tree. A query walks all trees through one priority queue ordered by the
distance to the splitting planes and opens the nearest leaves until its budget of leaves is spent;
the budget is the smallest that finds ``target_recall`` of the sample's true neighbours. Leaf members
and queries meet in a cogroup and candidates are scored exactly, in double precision, on the
original vectors.

Rows with equal vectors are indexed once, with their ``k + 1`` smallest ids: they tie, so no other can
be in a result. Queries with equal vectors are searched once. Leaves that hold many vectors are split
into chunks of bounded size that all queries of the leaf visit; nothing is capped.

Defined results: vectors that are null, zero, of a length other than the commonest, or hold null or
non-finite components take no part; of rows that repeat an id the least vector counts; fewer
candidates than ``k`` are all returned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import Shipped, materialise


@dataclass(frozen=True)
class ForestSettings:
    """Bounds of the sample and of leaves, and the recall to reach on the sample."""

    trees: int = 4
    sample: int = 16_000
    leaf: int = 128
    chunk_rows: int = 8_192
    target_recall: float = 0.97
    probes: int = 200
    seed: int = 11


@dataclass
class Tree:
    """Inner node ``i`` sends ``x`` left if ``x . normal[i] <= offset[i]``; children < 0 are leaf ``-1 - c``."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offset) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            goes_left = np.einsum("ij,ij->i", x[inner], self.normal[node]) <= self.offset[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
        return -1 - at


def grow_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the difference of two random members until leaves are small."""
    normals, offsets, left, right, leaves = [], [], [], [], 0

    def grow(members: np.ndarray) -> int:
        nonlocal leaves
        if len(members) > leaf:
            a, b = x[members[rng.choice(len(members), 2, replace=False)]]
            direction = a - b
            size = np.linalg.norm(direction)
            if size > 0:
                along = x[members] @ (direction / size)
                middle = float(np.median(along))
                low = along <= middle
                if low.any() and not low.all():
                    node = len(offsets)
                    normals.append(direction / size)
                    offsets.append(middle)
                    left.append(0)
                    right.append(0)
                    left[node] = grow(members[low])
                    right[node] = grow(members[~low])
                    return node
        leaves += 1
        return -leaves

    grow(np.arange(len(x)))
    return Tree(np.array(normals).reshape(len(offsets), x.shape[1]), np.array(offsets), np.array(left, np.int64), np.array(right, np.int64), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    budget: int = 1

    def nearest_leaves(self, q: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """Leaves in the order of the shared queue, at most ``budget``: (tree, leaf)."""
        margins = [t.normal @ q - t.offset if len(t.offset) else np.zeros(0) for t in self.trees]
        heap = [(-np.inf, k, 0 if len(t.offset) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < budget:
            far, k, node = heapq.heappop(heap)
            if node < 0:
                out.append((k, -1 - node))
                continue
            t, m = self.trees[k], float(margins[k][node])
            near, away = (t.left, t.right) if m <= 0 else (t.right, t.left)
            heapq.heappush(heap, (far, k, int(near[node])))
            heapq.heappush(heap, (max(far, abs(m)), k, int(away[node])))
        return out


def fit_forest(x: np.ndarray, settings: ForestSettings, k: int) -> Forest:
    """Trees over unit vectors, and the least budget of leaves that reaches the target on the sample."""
    rng = np.random.default_rng(settings.seed)
    forest = Forest([grow_tree(x, settings.leaf, rng) for _ in range(settings.trees)])
    total = sum(t.leaves for t in forest.trees)
    probes = rng.permutation(len(x))[: settings.probes]
    leaf_of = [t.assign(x) for t in forest.trees]
    opened = []
    for p in probes:
        score = x @ x[p]
        score[p] = -np.inf
        want = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        place = {leaf: n for n, leaf in enumerate(forest.nearest_leaves(x[p], total))}
        opened += [min(place[t, int(leaf_of[t][w])] for t in range(settings.trees)) + 1 for w in want]
    forest.budget = int(np.quantile(opened, settings.target_recall, method="higher")) if opened else total
    return forest


def _scaled(rows: list) -> np.ndarray:
    """Vectors times a power of two each, so that their largest component is below one: squares neither overflow nor
    vanish, and a cosine keeps its bits."""
    x = np.array(rows, dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(rows: list) -> np.ndarray:
    x = _scaled(rows)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """``mark, vec, ids``: usable distinct vectors, a hash of each and its ``k + 1`` smallest ids."""
    x = F.col("vec")
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("vec")).where(
        F.col("id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    sizes = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    usable = usable.where(F.size("vec") == (sizes[0].d if sizes else 0)).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("mark", F.xxhash64("vec"))
    order = Window.partitionBy("mark", "vec").orderBy("id")
    least = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    return least.groupBy("mark", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _leaves(holder, every: bool):
    """Index rows of all trees, or the leaves that queries open."""

    def run(batches):
        forest = holder.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vec").to_pylist())
            if every:
                tree = np.repeat(np.arange(len(forest.trees)), len(x))
                leaf = np.concatenate([t.assign(x) for t in forest.trees])
                row = np.tile(np.arange(len(x)), len(forest.trees))
            else:
                opened = [forest.nearest_leaves(q, forest.budget) for q in x]
                row = np.repeat(np.arange(len(x)), [len(o) for o in opened])
                tree, leaf = np.array([p for o in opened for p in o], dtype=np.int64).reshape(-1, 2).T
            taken = batch.take(pa.array(row)).select(["rep", "vec", "ids"])
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), *taken.columns], names=["tree", "leaf", "rep", "vec", "ids"])

    return run


def _score(k: int):
    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            v = _scaled(members["vec"].tolist())
            norms = np.sqrt((v * v).sum(axis=1))
            ids = members["ids"].tolist()
            for first in range(0, len(queries), 256):
                part = queries.iloc[first : first + 256]
                q = _scaled(part["vec"].tolist())
                q_norms = np.sqrt((q * q).sum(axis=1))
                rough = (q @ v.T) / norms / q_norms[:, None]
                n = min(k + 1, rough.shape[1])
                edge = np.partition(rough, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n]
                for i, rep in enumerate(part["rep"].tolist()):
                    near = np.flatnonzero(rough[i] >= edge[i] - 1e-12)
                    exact = (v[near] * q[i]).sum(axis=1) / (norms[near] * q_norms[i])
                    best = sorted((-s, x) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for x in ids[j])[: k + 1]
                    out += [(rep, x, -s) for s, x in best]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, *, k: int = 5, key: str = "vec_id", embedding: str = "embedding", settings: ForestSettings = ForestSettings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query``, its ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    table = materialise(distinct_vectors(vectors, key, embedding, k).withColumn("rep", F.element_at("ids", 1)), "vectors")
    asked = vectors.where(is_query).select(F.col(key).cast("long").alias("query_id"), F.col(embedding).alias("vec")).withColumn("mark", F.xxhash64("vec"))
    asked = asked.join(table.select("mark", "vec", "rep"), ["mark", "vec"]).select("query_id", "rep").distinct()
    asked = materialise(asked, "queries")
    sample = table.select("vec", "mark", "rep").orderBy("mark", "rep").limit(settings.sample).collect()
    forest = fit_forest(_unit([r.vec for r in sample]), settings, k) if sample else Forest([])
    holder = Shipped(spark, forest)
    vec = table.schema["vec"].dataType.simpleString()
    ddl = f"tree long, leaf long, rep long, vec {vec}, ids array<long>"
    queries = table.join(asked.select("rep").distinct(), "rep", "left_semi").mapInArrow(_leaves(holder, False), ddl)
    index = table.mapInArrow(_leaves(holder, True), ddl)
    n = table.count()
    # a group is a chunk of a leaf's rows and a chunk of its queries, both buckets of hashes, so its size is bounded
    # whatever the leaf holds and however many queries open it; the table of leaves is bounded by the sample
    by = ["tree", "leaf", "chunk", "part"]
    if n <= settings.chunk_rows:
        index, queries = (df.withColumns({"chunk": F.lit(0).cast("long"), "part": F.lit(0).cast("long")}) for df in (index, queries))
    else:
        pieces = lambda df, name: df.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / settings.chunk_rows).cast("long").alias(name))
        leaves = F.broadcast(pieces(index, "chunks").join(pieces(queries, "parts"), ["tree", "leaf"]))
        own = lambda of: F.pmod(F.xxhash64("rep"), F.col(of))
        each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
        index = index.join(leaves, ["tree", "leaf"]).withColumn("chunk", own("chunks")).withColumn("part", each("parts")).drop("chunks", "parts")
        queries = queries.join(leaves, ["tree", "leaf"]).withColumn("part", own("parts")).withColumn("chunk", each("chunks")).drop("chunks", "parts")
    met = queries.drop("ids").groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(_score(k), "rep long, vec_id long, score double")
    best = met.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    # each query drops its own row from its vector's list, which holds one more than it needs
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = asked.join(lists, "rep").select("query_id", F.posexplode(own).alias("pos", "x"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def neighbour_report(vectors: DataFrame, **options) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0, **options)
