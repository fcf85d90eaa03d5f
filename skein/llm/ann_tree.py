"""Approximate nearest neighbours in a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is dealt to a leaf. A query
walks the tree best bin first: a priority queue holds nodes by an upper bound
of the inner product with any of their vectors, the best is opened, and leaves
come out in order. How many leaves are visited is calibrated: for CALIBRATION
queries the true neighbours are found among all rows (in blocks), and visits
widen until the mean recall of these reaches the target plus its uncertainty.
Every visited vector is scored exactly.

Leaves hold few vectors unless many are alike; blocks of at most BLOCK rows split
them, so no leaf, however common its vector, lands in one task. Null, zero or
non-finite vectors, and those of another length than most, take no part; neither
do rows without an id. Rows that repeat an id are rows like any other, but none
is a neighbour of a query with its own id. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored, table

SAMPLE = 40_000  #: rows that the tree is fitted on at most; those with the least hashes of their ids
BRANCH = 8
LEAF = 256  #: sample rows under which a node isn't split
BLOCK = 4096  #: rows of a block: a part of a large leaf, or some leaves side by side
PACE = 0.5  #: part of a node's radius that counts in its promise
CALIBRATION = 96  #: queries with known neighbours
RECALL = 0.95


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    children: list[Node] | None
    leaf: int = -1


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """The cluster of each row; Lloyd's rounds from rows drawn by a fixed seed."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return own


def fit(x: np.ndarray) -> tuple[Node, int]:
    """(root, number of leaves) of a tree over the sample."""
    leaves = 0

    def grow(rows: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        centre = rows.mean(0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(1).max()))
        if len(rows) > LEAF and radius > 0 and depth < 12:
            own = kmeans(rows, BRANCH, depth)
            parts = [rows[own == k] for k in range(BRANCH) if (own == k).any()]
            if len(parts) > 1:
                return Node(centre, radius, [grow(p, depth + 1) for p in parts])
        leaves += 1
        return Node(centre, radius, None, leaves - 1)

    return grow(x, 0), leaves


class Tree:
    """The fitted tree; the traversal's nodes are numbered and their centres and radii held as arrays."""

    def __init__(self, sample: np.ndarray):
        self.root, self.leaves = fit(sample)
        nodes = [self.root]
        self.below: list[list[int]] = []
        for node in nodes:  # grows as it is walked
            self.below.append(list(range(len(nodes), len(nodes) + len(node.children or []))))
            nodes += node.children or []
        self.leaf = [n.leaf for n in nodes]
        self.centres, self.radii = np.stack([n.centre for n in nodes]), np.array([n.radius for n in nodes])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)

        def go(node: Node, at: np.ndarray) -> None:
            if node.children is None:
                out[at] = node.leaf
                return
            c = np.stack([n.centre for n in node.children])
            own = np.argmax(x[at] @ c.T - 0.5 * (c**2).sum(1), axis=1)
            for k, child in enumerate(node.children):
                some = at[own == k]
                if len(some):
                    go(child, some)

        if len(x):
            go(self.root, np.arange(len(x)))
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first traversal."""
        # a bin's promise: the centre's product and a part of what its radius could add
        promise = (self.centres @ q + PACE * float(np.sqrt((q**2).sum())) * self.radii).tolist()
        heap = [(0.0, 0)]
        out: list[int] = []
        while heap and len(out) < most:
            n = heapq.heappop(heap)[1]
            if self.leaf[n] >= 0:
                out.append(self.leaf[n])
            for child in self.below[n]:
                heapq.heappush(heap, (-promise[child], child))
        return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _peak(x: np.ndarray) -> float:
    return float(np.abs(x).sum(1).max(initial=0))


def _top(scores: np.ndarray, q: np.ndarray, x: np.ndarray, peak: float, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, products) of the k best rows of x for a query, ties to the smaller id; -inf scores are none. peak: the largest sum of a row's magnitudes.

    The last bits of a matrix product depend on its shape, so all rows within the rounding
    of the cut are multiplied anew, each in the same order, before any is left out.
    """
    cut = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    if cut > -np.inf:
        at = np.flatnonzero(scores >= cut - 4 * len(q) * np.finfo(float).eps * float(np.abs(q).max()) * peak)
    else:
        at = np.flatnonzero(scores > -np.inf)
    exact = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return at[order], exact[order]


def best_in_block(table: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best rows of a block for each query that visits any of its leaves."""
    leaves = table["leaves"].combine_chunks()
    counts = leaves.value_lengths().to_numpy(zero_copy_only=False)
    flat = leaves.flatten().to_numpy(zero_copy_only=False)
    is_query = table["is_query"].to_numpy()
    ids, x = table["id"].to_numpy(), _matrix(table["vec"].combine_chunks(), dim)
    own, asking = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    mine = x[own]
    peak = _peak(mine)
    names, flat = np.unique(flat, return_inverse=True)
    home = flat[np.repeat(~is_query, counts)]
    wanted = np.zeros((len(asking), len(names)), bool)
    wanted[np.repeat(np.arange(len(asking)), counts[is_query]), flat[np.repeat(is_query, counts)]] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(asking) if len(own) else 0, 256):
        some = asking[a : a + 256]
        s = x[some] @ mine.T
        s[~wanted[a : a + 256][:, home]] = -np.inf
        s[ids[some][:, None] == ids[own][None]] = -np.inf
        for r in range(len(some)):
            at, exact = _top(s[r], x[some[r]], mine, peak, ids[own], k)
            found.append((np.full(len(at), some[r]), own[at], exact))
    q, c, s = (np.concatenate([f[n] for f in found] or [np.zeros(0, np.int64)]) for n in range(3))
    return pa.table({"query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()), "score": pa.array(s, pa.float64())})


FOUND = "query_id bigint, vec_id bigint, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the k best."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def calibrate(tree: Tree, queries: np.ndarray, truth: list[list[int]], target: float) -> int:
    """Leaves to visit: the least number by which the queries' mean recall, less two standard errors, reaches the target.

    truth: the leaves of each query's true neighbours."""
    if not len(queries):
        return tree.leaves
    need = np.full((len(queries), max(map(len, truth), default=0)), np.inf)
    for i, (q, leaves) in enumerate(zip(queries, truth, strict=True)):
        at = {leaf: n + 1 for n, leaf in enumerate(tree.visit(q, tree.leaves))}
        need[i, : len(leaves)] = [at[x] for x in leaves]
    has = np.array([max(len(t), 1) for t in truth])
    for most in range(1, tree.leaves):
        recall = (need <= most).sum(1) / has
        if recall.mean() - 2 * recall.std() / np.sqrt(len(recall)) >= target:
            return most
    return tree.leaves


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query among all rows but those of its id. is_query: of the column `id`."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = common["dim"]
    rows = rows.where(F.size("vec") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    tree = spark.sparkContext.broadcast(Tree(_matrix(sample, dim)))

    def deal(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": b.column(1), "leaf": pa.array(tree.value.leaf_of(x), pa.int32())})

    dealt = rows.select("id", "vec").mapInArrow(deal, "id bigint, vec array<double>, leaf int")
    dealt = stored(dealt, "leaves")
    sizes = dict(dealt.groupBy("leaf").count().collect())  # as many as the tree has leaves, fewer than SAMPLE
    blocks, block, held = [], 0, 0
    for leaf in range(tree.value.leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        parts = -(-n // BLOCK) or 1
        blocks.append((leaf, block, parts))
        held += n
        if parts > 1:
            block, held = block + parts, 0
    places = F.broadcast(spark.createDataFrame(blocks, "leaf int, first int, parts int"))

    # true neighbours of the calibration queries, all rows against them in blocks
    probe = dealt.where(is_query).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).select("id", "vec").toArrow()
    qi, q = probe["id"].to_numpy(), _matrix(probe["vec"].combine_chunks(), dim) if probe.num_rows else np.zeros((0, dim))
    given = spark.sparkContext.broadcast((qi, q))

    def against(batches):
        ids, x = given.value
        for b in batches:
            ci, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            mine = _matrix(b.column(1), dim)
            peak = _peak(mine)
            s = x @ mine.T
            s[ids[:, None] == ci[None]] = -np.inf
            for r in range(len(ids)):
                at, exact = _top(s[r], x[r], mine, peak, ci, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(at), ids[r]), pa.int64()), "vec_id": pa.array(ci[at], pa.int64()), "score": pa.array(exact, pa.float64()), "leaf": pa.array(leaf[at], pa.int32())})

    true = dealt.select("id", "vec", "leaf").mapInArrow(against, FOUND + ", leaf int")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()
    leaves_of = {r["query_id"]: r["leaves"] for r in true}
    most = calibrate(tree.value, q, [leaves_of.get(i, []) for i in qi.tolist()], recall)

    def visits(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            row, block, leaves = [], [], []
            for r, v in enumerate(x):
                to: dict[int, list[int]] = {}
                for leaf in tree.value.visit(v, most):
                    _, first, parts = blocks[leaf]
                    for n in range(first, first + parts):
                        to.setdefault(n, []).append(leaf)
                row += [r] * len(to)
                block += to.keys()
                leaves += to.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "id": b.column(0).take(at), "vec": b.column(1).take(at), "leaves": pa.array(leaves, pa.list_(pa.int32()))})

    asked = dealt.where(is_query).select("id", "vec").mapInArrow(visits, "block int, id bigint, vec array<double>, leaves array<int>")
    rows = dealt.join(places, "leaf").select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("block"), "id", "vec", F.array("leaf").alias("leaves"), F.lit(False).alias("is_query"))
    both = rows.unionByName(asked.select("block", "id", "vec", "leaves", F.lit(True).alias("is_query")))
    found = both.groupBy("block").applyInArrow(lambda t: best_in_block(t, dim, k), FOUND)
    return ranked(found, k)


def op10_ann_tree(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
