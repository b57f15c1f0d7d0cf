"""Communities of a small graph, k-means, hierarchical and medoid clustering, embeddings, matrix completion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strandlake.operators import relational


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, refine: bool = False, seed: int = 386, start: np.ndarray | None = None) -> np.ndarray:
    """Communities (numbered from 0) of a weighted graph, from the communities `start` (else every node alone), by moving nodes while modularity rises, then merging communities.

    With refine (Leiden), what is merged are the well-connected parts of each community instead, and the next moves start from the
    communities as they are; in the end every community is connected.
    """
    names, start = np.arange(n), np.arange(n) if start is None else start
    rng = np.random.default_rng(seed)
    first = (n, a, b)
    while True:
        nbrs, loops = _adjacency(n, a, b, w)
        degree = np.array([sum(d.values()) for d in nbrs]) + 2 * loops
        total = degree.sum()
        if total == 0:
            return np.unique(names, return_inverse=True)[1]
        home, moved = start.copy(), False
        mass = np.bincount(home, degree, n)
        active = True
        while active:
            active = False
            for x in rng.permutation(n):
                links: dict[int, float] = {}
                for y, v in nbrs[x].items():
                    links[home[y]] = links.get(home[y], 0.0) + v
                here = home[x]
                mass[here] -= degree[x]
                gain = {c: v - resolution * degree[x] * mass[c] / total for c, v in links.items()}
                stay = links.get(here, 0.0) - resolution * degree[x] * mass[here] / total
                there = max(gain, key=lambda c: (gain[c], -c), default=here)
                if gain.get(there, stay) <= stay + 1e-12:
                    there = here
                mass[there] += degree[x]
                if there != here:
                    home[x], active, moved = there, True, True
        part = _refined(n, nbrs, degree, total, home, resolution, rng) if refine else home
        kinds, at, part = np.unique(part, return_index=True, return_inverse=True)
        if len(kinds) == n or not refine and not moved:
            out = home[names]
            return np.unique(_connected(first[0], _adjacency(*first, w)[0], out) if refine else out, return_inverse=True)[1]
        start = np.unique(home[at], return_inverse=True)[1] if refine else np.arange(len(kinds))
        names, a, b, n = part[names], part[a], part[b], len(kinds)


def _adjacency(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[list[dict[int, float]], np.ndarray]:
    """Neighbours with their weights, and the weights of loops."""
    nbrs: list[dict[int, float]] = [{} for _ in range(n)]
    loops = np.zeros(n)
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist()):
        if x == y:
            loops[x] += v
        else:
            nbrs[x][y] = nbrs[x].get(y, 0.0) + v
            nbrs[y][x] = nbrs[y].get(x, 0.0) + v
    return nbrs, loops


def _refined(n: int, nbrs: list[dict[int, float]], degree: np.ndarray, total: float, home: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Parts of the communities: each node that is well connected to its community, and still alone, joins the well-connected part
    of it with the largest gain, if that is no loss."""
    part, mass, alone = np.arange(n), degree.astype(float).copy(), np.ones(n, bool)
    whole = np.bincount(home, degree, n)
    inside = [{y: v for y, v in nbrs[x].items() if home[y] == home[x]} for x in range(n)]
    outward = np.array([sum(d.values()) for d in inside])  # of each part, to the rest of its community

    def connected(links: float, own: float, c: int) -> bool:
        return links >= resolution * own * (whole[c] - own) / total - 1e-12

    for x in rng.permutation(n):
        if not alone[x] or not connected(outward[x], degree[x], home[x]):
            continue
        links: dict[int, float] = {}
        for y, v in inside[x].items():
            links[part[y]] = links.get(part[y], 0.0) + v
        gain = {c: v - resolution * degree[x] * mass[c] / total for c, v in links.items() if c != part[x] and connected(outward[c], mass[c], home[x])}
        there = max(gain, key=lambda c: (gain[c], -c), default=None)
        if there is not None and gain[there] >= 0:
            outward[there] += outward[x] - 2 * links[there]
            mass[there] += degree[x]
            part[x], mass[x], alone[x], alone[there] = there, 0.0, False, False
    return part


def _connected(n: int, nbrs: list[dict[int, float]], home: np.ndarray) -> np.ndarray:
    out, label = np.full(n, -1), 0
    for s in range(n):
        if out[s] < 0:
            out[s], stack = label, [s]
            while stack:
                x = stack.pop()
                for y in nbrs[x]:
                    if out[y] < 0 and home[y] == home[x]:
                        out[y] = label
                        stack.append(y)
            label += 1
    return out


def modularity(labels: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0) -> float:
    n = len(labels)
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    inside = w[labels[a] == labels[b]].sum()
    return float(inside / w.sum() - resolution * (np.bincount(labels, degree) ** 2).sum() / (degree.sum() ** 2))


def vectors(reads: DataFrame, mods: DataFrame, length: int) -> DataFrame:
    """reads with features: an MLlib vector of length 0s and 1s."""
    lists = mods.groupBy("read_id").agg(F.collect_set(F.col("pos").cast("int")).alias("_p"))
    return vectors_of_sets(reads.join(lists, "read_id", "left"), length, "_p").drop("_p")


#: Numbers of vectors that a task makes at a time.
VECTOR_CELLS = 1 << 20


def vectors_of_sets(sets: DataFrame, length: int, column: str = "p") -> DataFrame:
    """sets, with positions in a column (null: none), with features. The numbers are filled in from the positions in Arrow batches,
    not looked up in each read's array for each of `length` positions."""
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VECTOR_CELLS // max(length, 1))
        for whole in batches:
            for b in (whole.slice(first, step) for first in range(0, whole.num_rows, step)):
                row, pos = relational.flat_positions(b.column(column))
                known, x = (pos >= 0) & (pos < length), np.zeros((b.num_rows, length))
                x[row[known], pos[known]] = 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * length), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "features"])

    made = sets.mapInArrow(run, StructType([*sets.schema.fields, StructField("features", ArrayType(DoubleType()))]))
    return made.withColumn("features", array_to_vector("features"))


def k_means(points: DataFrame, k: int, seed: int = 386) -> DataFrame:
    """points (features) with cluster."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    return model.transform(points).withColumn("cluster", F.col("cluster").cast("long"))


def lloyd_step(reads: DataFrame, mods: DataFrame, assignments: DataFrame, length: int) -> DataFrame:
    """(read_id, cluster, distance): one step of k-means from assignments (read_id, cluster): each read goes to the cluster with
    the nearest mean by squared distance, ties to the smallest; the means, clusters x length numbers at most, are broadcast."""
    lists = mods.groupBy("read_id").agg(F.collect_list("pos").alias("p"))
    # what an explode makes looks small to the planner, which would broadcast it
    sets = reads.select("read_id").join(lists.hint("merge"), "read_id", "left").join(assignments.select("read_id", "cluster").hint("merge"), "read_id", "left")
    return lloyd_step_of_sets(sets)


def lloyd_step_of_sets(sets: DataFrame) -> DataFrame:
    """lloyd_step() of reads (read_id, cluster, p), p being the positions (null: none); reads without a cluster are in no mean. Only
    counts by cluster and position are shuffled."""
    clusters, size, counts = relational.counted_sets(sets)
    mean = counts / size[:, None]
    norm = (mean * mean).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos = relational.flat_positions(b.column("p"))
            known = pos < mean.shape[1]
            # |x - m|^2 = |m|^2 + sum over the read's positions of 1 - 2 m
            hit = np.stack([np.bincount(row[known], m[pos[known]], b.num_rows) for m in mean], 1)
            far = norm + np.bincount(row, minlength=b.num_rows)[:, None] - 2 * hit
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(mean), dtype=np.int32)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("read_id"), lists], ["read_id", "far"])

    if not len(clusters):
        return sets.where("false").select("read_id", "cluster", F.lit(0.0).alias("distance"))
    far = sets.select("read_id", "p").mapInArrow(run, f"read_id {sets.schema['read_id'].dataType.simpleString()}, far array<double>")
    best = far.select("read_id", F.array_min(F.transform("far", lambda d, k: F.struct(F.round(d, 9).alias("d"), k.alias("k")))).alias("m"))
    return best.select("read_id", F.get(F.array(*[F.lit(c) for c in clusters.to_pylist()]), F.col("m.k")).cast(sets.schema["cluster"].dataType).alias("cluster"), F.col("m.d").alias("distance"))


def principal_components(points: DataFrame, k: int = 2) -> DataFrame:
    """points (features) with pc (array of k)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(points)
    return model.transform(points).withColumn("pc", vector_to_array("_pc")).drop("_pc")


def squared_distances(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(1)
    return np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)


def hierarchical(distance: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """k clusters by merging the closest two; distance: squared for ward, any for complete. For the K profiles of clusters or
    a bounded sample: it holds all pairs."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - max(1, min(k, n))):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if linkage == "ward":
            other = size + size[i] + size[j]
            new = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / other
        else:
            new = np.maximum(d[i], d[j])
        d[i, :] = d[:, i] = new
        d[i, i], d[j, :], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def k_medoids(distance: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Labels and medoids by alternation, from the points of least total distance on."""
    medoids = [int(np.argmin(distance.sum(1)))]
    while len(medoids) < min(k, len(distance)):
        near = distance[:, medoids].min(1)
        medoids.append(int(np.argmax(np.maximum(near[:, None] - distance, 0).sum(0))))
    m = np.array(medoids)
    for _ in range(rounds):
        labels = np.argmin(distance[:, m], 1)
        new = np.array([(g := np.flatnonzero(labels == c))[np.argmin(distance[np.ix_(g, g)].sum(1))] if (labels == c).any() else m[c] for c in range(len(m))])
        if (new == m).all():
            break
        m = new
    return np.argmin(distance[:, m], 1), m


def classical_scaling(distance: np.ndarray, k: int = 2) -> np.ndarray:
    """Coordinates whose distances follow the given ones (classical MDS)."""
    n = len(distance)
    centre = np.eye(n) - 1.0 / n
    values, axes = np.linalg.eigh(-0.5 * centre @ (distance**2) @ centre)
    top = np.argsort(values)[::-1][:k]
    return axes[:, top] * np.sqrt(np.maximum(values[top], 0))


def soft_impute(x: np.ndarray, rounds: int = 100, shrink: float | None = None, tolerance: float = 1e-4) -> np.ndarray:
    """Fill the zeros of x, taken as missing, by singular value shrinkage, within 0 and 1."""
    seen = x != 0
    z = np.where(seen, x, 0.0)
    shrink = np.linalg.norm(z, 2) / 50 if shrink is None else shrink
    for _ in range(rounds):
        u, s, v = np.linalg.svd(np.where(seen, x, z), full_matrices=False)
        new = np.clip((u * np.maximum(s - shrink, 0)) @ v, 0, 1)
        done = np.linalg.norm(new - z) <= tolerance * max(np.linalg.norm(z), 1e-12)
        z = new
        if done:
            break
    return np.where(seen, x, z)


def binarise(x: np.ndarray, percentile: float = 70) -> np.ndarray:
    return (x > np.percentile(x, percentile)).astype(np.int8)
