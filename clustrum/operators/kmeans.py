"""k-means and spherical k-means by Lloyd iterations; all starts share each pass over the vectors.

A pass sends one small table of sums a task: the coordinates of every start and cluster, added up by Spark. Starts come from
k-means++, drawn by an exponential race: every row has a waiting time with a rate of its squared distance, hashed from its
values, and the shortest wait wins, so a draw is one minimum and does not depend on the partitioning.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.vectors import stacked_rows

#: Rows that a task compares with all centroids at a time.
BLOCK_ROWS = 4096


def _nearest(x: np.ndarray, centers: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Label (the lowest of equally near ones) and distance of each row: 1 - cosine, or the squared Euclidean distance."""
    if spherical:
        products = x @ centers.T
        labels = products.argmax(axis=1)
        return labels, np.maximum(1 - products[np.arange(len(x)), labels], 0)
    labels = ((centers * centers).sum(axis=1) / 2 - x @ centers.T).argmin(axis=1)
    gap = x - centers[labels]
    return labels, (gap * gap).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], spherical: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the first column as a matrix (of unit rows where `spherical`), and their row hashes from the second."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = stacked_rows(part.column(0))
            if spherical:
                lengths = np.linalg.norm(x, axis=1, keepdims=True)
                if not lengths.all():
                    raise ValueError("a zero vector has no direction")
                x = x / lengths
            yield x, part.column(1).to_numpy().view(np.uint64)


def _uniform(hashes: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1] from row hashes and a salt."""
    with np.errstate(over="ignore"):
        for s in salt:
            hashes = (hashes ^ np.uint64(s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            hashes = hashes ^ (hashes >> np.uint64(32))
    return ((hashes >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def _least_rows(vectors: DataFrame, starts: list[int], score: Callable, count: int, spherical: bool) -> dict[int, list[np.ndarray]]:
    """Of each start the `count` distinct rows of least score (infinite scores left out), by tasks first, then over all tasks."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, float]] = {s: {} for s in starts}
        for x, hashes in _blocks(batches, spherical):
            for s in starts:
                values = score(s, x, hashes)
                for i in np.argsort(values, kind="stable")[:4 * count].tolist() if count > 1 else [int(values.argmin())]:
                    if np.isfinite(values[i]):
                        held[s].setdefault(x[i].tobytes(), float(values[i]))
                held[s] = dict(sorted(held[s].items(), key=lambda e: (e[1], e[0]))[:count])
        rows = [(s, v, np.frombuffer(k).tolist()) for s, found in held.items() for k, v in found.items()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else ([], [], []), (pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["start", "score", "row"])

    found = vectors.mapInArrow(best, "start int, score double, row array<double>")
    if count == 1:
        kept = found.groupBy("start").agg(F.min(F.struct("score", "row")).alias("r")).select("start", "r.score", "r.row").collect()
    else:
        # One list of `count` rows a start: merged in the executors.
        merged = found.distinct().groupBy("start").agg(F.array_sort(F.collect_list(F.struct("score", "row"))).alias("all"))
        kept = merged.select("start", F.inline(F.slice("all", 1, count))).collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(kept, key=lambda r: (r.start, r.score, r.row)):
        out.setdefault(r.start, []).append(np.array(r.row))
    return out


def plus_plus_starts(vectors: DataFrame, k: int, n_init: int, seed: int | Sequence[int], spherical: bool) -> np.ndarray:
    """k-means++ centroids of all starts (start, cluster, dimension): k passes. With fewer than k different rows the rest are copies.

    Of several seeds the `n_init` starts of each, one seed after the other; they share the passes and are drawn as they would be alone.
    """
    salts = [(s, i) for s in ([seed] if isinstance(seed, int) else seed) for i in range(n_init)]
    centers: list[np.ndarray] = []
    for step in range(k):
        chosen = np.stack(centers, axis=1) if centers else None

        def wait(start: int, x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            rate = _nearest(x, chosen[start], spherical)[1] if chosen is not None else np.ones(len(x))
            with np.errstate(divide="ignore"):
                return np.where(rate > 1e-15, -np.log(_uniform(hashes, *salts[start], step)) / rate, np.inf)

        drawn = _least_rows(vectors, list(range(len(salts))), wait, 1, spherical)
        centers.append(np.stack([drawn[s][0] if s in drawn else centers[0][s] for s in range(len(salts))]))
    return np.stack(centers, axis=1)


def lloyd_sums(vectors: DataFrame, centers: dict[int, np.ndarray], spherical: bool) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One pass: of each start the vector sums and row counts per cluster, and the sum of the distances."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((c.shape[0], c.shape[1] + 2)) for s, c in centers.items()}
        for x, _ in _blocks(batches, spherical):
            for s, c in centers.items():
                labels, distances = _nearest(x, c, spherical)
                member = np.zeros((len(c), len(x)))
                member[labels, np.arange(len(x))] = 1
                sums[s] += member @ np.concatenate([x, np.ones((len(x), 1)), distances[:, None]], axis=1)
        rows = [(s, j, row.tolist()) for s, total in sums.items() for j, row in enumerate(total)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["start", "cluster", "row"])

    cells = vectors.mapInArrow(add, "start int, cluster int, row array<double>").select("start", "cluster", F.posexplode("row").alias("i", "v"))
    totals = {s: np.zeros((c.shape[0], c.shape[1] + 2)) for s, c in centers.items()}
    for r in cells.groupBy("start", "cluster", "i").agg(F.sum("v").alias("v")).collect():  # starts * k * (dimension + 2) numbers
        totals[r.start][r.cluster, r.i] = r.v
    return {s: (t[:, :-2], t[:, -2], float(t[:, -1].sum())) for s, t in totals.items()}


def _moved(old: np.ndarray, sums: np.ndarray, counts: np.ndarray, spherical: bool) -> np.ndarray:
    """Means of the clusters (unit ones where `spherical`); clusters without rows or direction stay where they are."""
    new, some = old.copy(), counts > 0
    new[some] = sums[some] / counts[some, None]
    if spherical:
        lengths = np.linalg.norm(new, axis=1)
        new = np.where((lengths > 1e-12)[:, None], new / np.where(lengths > 1e-12, lengths, 1)[:, None], old)
    return new


def lloyd(
    vectors: DataFrame, centers: np.ndarray, max_iter: int, tol: float, spherical: bool, per_fit: int | None = None,
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Final centroids and inertia of every start, and how many iterations each took.

    A start ends when no centroid moves by more than `tol`. Clusters without rows take the rows farthest from their centroid,
    so that all k are used as long as the rows hold k different vectors. `per_fit` starts after each other belong to one fit, by
    default all; the starts of a fit draw the same number of far rows.
    """
    per_fit = per_fit or len(centers)
    current, taken = {s: c.copy() for s, c in enumerate(centers)}, [0] * len(centers)
    active = set(current)
    for _ in range(max_iter):
        if not active:
            break
        totals = lloyd_sums(vectors, {s: current[s] for s in sorted(active)}, spherical)
        empty = {s: np.flatnonzero(counts == 0) for s, (_, counts, _) in totals.items() if (counts == 0).any()}
        far = {}
        if empty:
            now = {s: current[s] for s in empty}

            def nearness(start: int, x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
                distance = _nearest(x, now[start], spherical)[1]
                return np.where(distance > 1e-12, -distance, np.inf)

            needed: dict[int, int] = {}
            for s, clusters in empty.items():
                needed[s // per_fit] = max(needed.get(s // per_fit, 0), len(clusters))
            for count in sorted(set(needed.values())):
                far |= _least_rows(vectors, [s for s in sorted(empty) if needed[s // per_fit] == count], nearness, count, spherical)
        for s in sorted(active):
            sums, counts, _ = totals[s]
            new = _moved(current[s], sums, counts, spherical)
            for cluster, row in zip(empty.get(s, ()), far.get(s, ())):
                new[cluster] = row
            shift, current[s] = float(np.abs(new - current[s]).max()), new
            taken[s] += 1
            if shift <= tol:
                active.discard(s)
    final = lloyd_sums(vectors, current, spherical)
    return np.stack([current[s] for s in sorted(current)]), np.array([final[s][2] for s in sorted(final)]), taken


def fit(
    df: DataFrame, n_clusters: int, n_init: int, max_iter: int, seed: int, tol: float, spherical: bool, vector: str = "embedding",
    initial: np.ndarray | None = None,
) -> tuple[np.ndarray, float, int]:
    """Centroids, inertia and iterations of the best start. `initial` (k x d) replaces the drawn starts by one given one.

    Always k centroids: copies only where the rows hold fewer than k different vectors. Vectors have to be of one length and
    without nulls. Equal inertias go to the earlier start.
    """
    return fit_seeds(df, n_clusters, n_init, max_iter, [seed], tol, spherical, vector, initial)[0]


def fit_seeds(
    df: DataFrame, n_clusters: int, n_init: int, max_iter: int, seeds: Sequence[int], tol: float, spherical: bool,
    vector: str = "embedding", initial: np.ndarray | None = None,
) -> list[tuple[np.ndarray, float, int]]:
    """What `fit` finds for each of the seeds; the starts of all of them share the passes."""
    if not seeds:
        return []
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(F.col(vector).cast("array<double>")).alias("hash")).persist()
    try:
        rows = vectors.count()
        if rows < n_clusters:
            raise ValueError("n_clusters must not exceed the row count")
        if initial is None:
            starts, per_fit = plus_plus_starts(vectors, n_clusters, n_init, seeds, spherical), n_init
        else:
            starts, per_fit = np.stack([np.asarray(initial, np.float64)] * len(seeds)), 1
        centers, costs, taken = lloyd(vectors, starts, max_iter, tol, spherical, per_fit)
    finally:
        vectors.unpersist()
    best = [at + int(np.argmin(costs[at:at + per_fit])) for at in range(0, len(starts), per_fit)]
    return [(centers[b], float(costs[b]), taken[b]) for b in best]
