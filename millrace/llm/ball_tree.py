"""k-means over integer vectors, filtered by partition-local ball trees.

1. Vectors become integers and are packed, a few thousand at a time, into ball trees that are written once. A node holds
   its count, the exact integer sum of its vectors and the radius about their mean.
2. Every round walks the trees from their roots. A centroid c can be nearest to a vector of a ball with mean m and
   radius r only if ``d(m, c) - r <= d(m, best) + r`` (triangle inequality), so the others are left out below it. A ball
   with one centroid left goes to it whole, by its count and sum; a leaf's vectors are told apart by exact integer
   distances. A task sends one row per centroid.
3. The driver holds the centroids only: k rows, however many vectors there are.

Vectors that have another number of components than asked for, or a null, NaN or infinite one, are left out; so is a null
embedding. ``vec_id`` may be null or repeated: every row counts by itself. Components are held to +-2**27, so that
distances fit 64 bits. Ties go to the centroid with the smaller number. An empty table gives an empty result, and with
fewer than k vectors each is a centroid. Other columns are ignored. The inertias stop at 2**63 - 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

CENTROIDS, ROUNDS, SEED, COMPONENTS, SCALE = 40, 5, 2, 64, 256
#: Vectors of a tree and of a leaf, and nodes whose distances are taken at once.
TREE, LEAF, AT_ONCE = 4096, 32, 128
#: Largest absolute value of a component; up to EXACT, sums of 64 products are exact in floating point.
MOST, EXACT = 1 << 27, 1 << 22


@dataclass
class Tree:
    """Nodes in an order in which children come after their parent; ``left`` is -1 at leaves, else ``left + 1`` is the right child."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def grow(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """(the order in which the tree holds the points, the tree); halves at the median of the widest component."""
    order = np.arange(len(points))
    start, stop, left = [0], [len(points)], [-1]
    radius, sums = [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        own = points[order[a:b]]
        total = own.sum(axis=0, dtype=np.int64)
        apart = own - total / (b - a)
        sums.append(total)
        radius.append(np.sqrt(np.einsum("ij,ij->i", apart, apart).max()))
        spread = own.max(axis=0) - own.min(axis=0)
        if b - a > LEAF and spread.any():
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], half)]
            left[at] = len(start)
            start += [a, a + half]
            stop += [a + half, b]
            left += [-1, -1]
        at += 1
    return order, Tree(points[order], np.array(start), np.array(stop), np.array(left), np.array(radius), np.array(sums, np.int64))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per point."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def descend(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes that go to one centroid whole, those centroids, leaves to tell apart, which centroids each may need)."""
    nodes, may = np.array([0]), np.ones((1, len(centroids)), bool)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0, int), may[:0])]
    while len(nodes):
        means = tree.sums[nodes] / (tree.stop[nodes] - tree.start[nodes])[:, None]
        far = np.concatenate([np.sqrt(((means[at : at + AT_ONCE, None] - centroids) ** 2).sum(axis=2)) for at in range(0, len(nodes), AT_ONCE)])
        r = tree.radius[nodes][:, None]
        near = np.where(may, far, np.inf).min(axis=1)[:, None]
        may = may & (far - r <= near + r + 1e-6 + 1e-9 * (far + r))  # rounding only ever keeps a centroid
        whole = may.sum(axis=1) == 1
        leaf = ~whole & (tree.left[nodes] < 0)
        found.append((nodes[whole], may[whole].argmax(axis=1), nodes[leaf], may[leaf]))
        deeper = ~whole & ~leaf
        nodes = np.concatenate([tree.left[nodes[deeper]], tree.left[nodes[deeper]] + 1])
        may = np.concatenate([may[deeper], may[deeper]])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaf_labels(tree: Tree, leaves: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the leaves' points, the nearest centroid of each), by exact distances to the centroids that are left."""
    size = tree.stop[leaves] - tree.start[leaves]
    of = np.repeat(np.arange(len(leaves)), size)
    at = np.repeat(tree.start[leaves] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    label = np.empty(len(at), np.int64)
    for k in range(0, len(at), TREE):
        far = distances(tree.points[at[k : k + TREE]], centroids)
        label[k : k + TREE] = np.where(may[of[k : k + TREE]], far, np.iinfo(np.int64).max).argmin(axis=1)
    return at, label


def labels(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of every point of the tree."""
    nodes, to, leaves, may = descend(tree, centroids)
    out = np.empty(len(tree.points), np.int64)
    for n, c in zip(nodes.tolist(), to.tolist(), strict=True):
        out[tree.start[n] : tree.stop[n]] = c
    at, label = leaf_labels(tree, leaves, may, centroids)
    out[at] = label
    return out


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, integer sum) of the tree's points per centroid; balls that go whole add what their node holds."""
    nodes, to, leaves, may = descend(tree, centroids)
    count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    np.add.at(count, to, tree.stop[nodes] - tree.start[nodes])
    np.add.at(sums, to, tree.sums[nodes])
    at, label = leaf_labels(tree, leaves, may, centroids)
    order = np.argsort(label, kind="stable")
    met, first = np.unique(label[order], return_index=True)
    if len(met):
        count[met] += np.diff(first, append=len(order))
        sums[met] += np.add.reduceat(tree.points[at[order]].astype(np.int64), first, axis=0)
    return count, sums


def _integers(embedding: Column, components: int, scale: int) -> Column:
    """The vector as integers; null where it is not kept."""
    doubles = embedding.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(doubles, lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(x * scale).cast("double"))).cast("int"))
    return F.when((F.size(doubles) == components) & ~bad, whole)


_NODES = "points binary, start binary, stop binary, left binary, radius binary, sums binary"
_KINDS = {"points": np.int32, "start": np.int64, "stop": np.int64, "left": np.int64, "radius": np.float64, "sums": np.int64}


def _packed(components: int, kind: str):
    @tidy
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def tree() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            order, t = grow(np.concatenate(parts))
            cols = [pa.array([np.ascontiguousarray(getattr(t, f), k).tobytes()], pa.binary()) for f, k in _KINDS.items()]
            return pa.record_batch([pa.array([own.take(pa.array(order)).to_pylist()], pa.list_(own.type)), *cols], ["ids", *_KINDS])

        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                piece = batch.slice(at, TREE)
                ids.append(piece.column("vec_id"))
                parts.append(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int32))
                held += piece.num_rows
                if held >= TREE:
                    yield tree()
                    ids, parts, held = [], [], 0
        if held:
            yield tree()

    return pack, f"ids array<{kind}>, {_NODES}"


def _trees(batches: Iterable[pa.RecordBatch], components: int) -> Iterator[tuple[pa.RecordBatch, Tree]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            own = {f: np.frombuffer(row.column(f)[0].as_py(), k) for f, k in _KINDS.items()}
            yield row, Tree(own["points"].reshape(-1, components), own["start"], own["stop"], own["left"], own["radius"], own["sums"].reshape(-1, components))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:vec_id``; null ids come last, equal hashes in the order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE, embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = vectors.select("vec_id", _integers(F.col(embedding), components, scale).alias("v")).filter("v IS NOT NULL")
    with Scratch(spark, "ball_tree") as scratch:
        centroids = first_centroids(kept, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], schema)
        trees = scratch.settle(kept.mapInArrow(*_packed(components, kind)), "trees")
        for _ in range(rounds):
            centroids = _moved(trees.drop("ids"), centroids, components)

        @tidy
        def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, tree in _trees(batches, components):
                own = labels(tree, centroids)
                apart = tree.points.astype(np.int64) - centroids[own]
                yield pa.record_batch([row.column("ids").flatten(), pa.array(own, pa.int32()), pa.array((apart * apart).sum(axis=1), pa.int64())], ["vec_id", "cluster", "distance"])

        assigned = scratch.settle(trees.mapInArrow(told, f"vec_id {kind}, cluster int, distance long"), "assigned", keep=True)
        most = (1 << 63) - 1
        sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
        facts = [(c, min(s, most), min(sum(sums.values()), most), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
        named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(trees: DataFrame, centroids: np.ndarray, components: int) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors; one without vectors stays."""

    @tidy
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, tree in _trees(batches, components):
            n, s = totals(tree, centroids)
            count, sums = count + n, sums + s
        met = np.flatnonzero(count)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(count[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(partial, "cluster int, n long, sums array<bigint>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(components))).alias("sums")).collect()  # at most k rows
    moved = centroids.copy()
    for r in found:
        moved[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    return moved
